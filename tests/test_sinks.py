import json

import pytest

from docweft.sources import sinks


def test_json_keeps_nulls(spark, tmp_path):
    sinks.write_json(spark.createDataFrame([("a", None)], "x string, y string"), str(tmp_path / "j"))
    lines = [json.loads(x) for f in (tmp_path / "j").glob("*.json") for x in f.read_text().splitlines()]
    assert lines == [{"x": "a", "y": None}]


def test_batches_and_evidence(spark, tmp_path):
    sinks.write_batches(spark.createDataFrame([(0, "a"), (1, "b"), (0, "c")], "batch_index int, s string"), str(tmp_path / "b"))
    assert sorted(p.name for p in (tmp_path / "b").iterdir() if p.is_dir()) == ["batch_index=0", "batch_index=1"]
    sinks.write_evidence(spark.createDataFrame([("x",), ("x",), ("y",)], "c string"), str(tmp_path / "e"), "c")
    assert spark.read.parquet(str(tmp_path / "e")).count() == 2


def test_register_never_replaces(spark, tmp_path):
    df = spark.range(1)
    sinks.register(df, str(tmp_path / "p"))
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        sinks.register(df, str(tmp_path / "p"))


def test_publish_and_lookup(spark, tmp_path):
    from docweft.operators import cache

    rows = spark.createDataFrame([("s", "k", "m", "1")], "stage string, key string, member string, sha256 string")
    cache.publish(rows, rows, str(tmp_path / "c"))
    again = spark.read.parquet(str(tmp_path / "c" / "manifest"))
    assert cache.lookup(rows.select("key"), again, spark.read.parquet(str(tmp_path / "c" / "members"))).collect()[0].cache_status == "HIT"
