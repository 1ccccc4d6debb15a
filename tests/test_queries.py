"""Every query against its SQL over the small test tables, and a guard against empty passes."""

import os
from collections import Counter
from decimal import Decimal

import duckdb
import pytest

from docweft.plans import checks, more  # noqa: F401 - they register their queries
from docweft.plans import queries as core

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
MAY_BE_EMPTY = {"mobile_signals", "labelled_phone_signals", "repeated_assets", "schema_violations", "organisation_signals", "decided_unresolved_overlap", "template_similarity", "page_gaps", "email_signals", "identity_contradictions", "probe_agreement", "overlapping_reviews", "duplicate_ids", "conflicting_candidates", "ordered_checks", "fragment_findings"}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def plain(value):
    return round(float(value), 6) if isinstance(value, (float, Decimal)) else value


@pytest.fixture(scope="module")
def other():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in os.listdir(FOLDER):
        if name.endswith(".parquet"):
            con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, other, name):
    df = core.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = Counter(tuple(map(plain, r)) for r in df.select(*columns).collect())
    assert got or name in MAY_BE_EMPTY
    if name in core.ORACLE_SQL:
        result = other.execute(core.ORACLE_SQL[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        assert got == Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall())


def test_streaming(spark, tmp_path):
    from pyspark.sql import functions as F

    from docweft.streaming import ingest

    rows = [("d", "a", "text", "2024-01-01 00:00:00"), ("d", "a", "text", "2024-01-01 05:00:00"), ("d", "b", "table", "2024-01-02 00:00:00"), (None, "c", "text", "2024-01-02 00:00:00")]
    batch = spark.createDataFrame(rows, "document string, source_id string, kind string, t string").withColumn("ingested_at", F.to_timestamp("t")).drop("t")
    batch.write.parquet(str(tmp_path / "in"))
    stream = ingest.without_redeliveries(ingest.deliveries(spark, str(tmp_path / "in"), batch.schema))
    ingest.write_partitioned(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    counted = ingest.arrivals(ingest.deliveries(spark, str(tmp_path / "in"), batch.schema)).writeStream.format("memory").queryName("arrivals").outputMode("complete").trigger(availableNow=True).start()
    counted.awaitTermination()
    assert {(r.kind, r.items) for r in spark.table("arrivals").collect()} == {("text", 2), ("table", 1), ("text", 1)}
