import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docweft.functions import grids, patterns, text


def one(spark, column, **values):
    names = list(values)
    schema = ", ".join(f"{n} {t}" for n, (t, _) in values.items())
    return spark.createDataFrame([tuple(v for _, v in values.values())], schema).select(column.alias("x")).collect()[0].x if names else None


@pytest.mark.parametrize(("raw", "clean"), [("  a  　 b\x1c\x1fc ", "a b c"), ("", ""), (None, ""), ("\n\t", "")])
def test_normalize(spark, raw, clean):
    assert one(spark, text.normalize_text(F.col("t")), t=("string", raw)) == clean


@settings(max_examples=1, suppress_health_check=[HealthCheck.function_scoped_fixture], deadline=None)
@given(st.lists(st.text(max_size=30), min_size=200, max_size=200))
def test_normalize_is_idempotent(spark, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(text.normalize_text(F.col("t")).alias("a"))
    assert df.where(text.normalize_text(F.col("a")) != F.col("a")).count() == 0


def test_stable_id(spark):
    got = one(spark, text.stable_id(F.col("k"), F.col("l"), F.col("t")), k=("string", "text"), l=("string", "page:1/line:2"), t=("string", "压力"))
    assert got == "TEXT-" + hashlib.sha256("text|page:1/line:2|压力|".encode()).hexdigest()[:12].upper()


def test_canonical_json_ignores_order(spark):
    df = spark.createDataFrame([("x", None)], "a string, b string")
    first = text.canonical_json({"b": F.col("b"), "a": F.col("a")})
    second = text.canonical_json({"a": F.col("a"), "b": F.col("b")})
    row = df.select(first.alias("x"), second.alias("y")).collect()[0]
    assert row.x == row.y == '{"a":"x","b":null}'


def test_preview(spark):
    assert one(spark, text.preview_text(F.col("t")), t=("string", " a \x07 b\r\n\r\n\r\n\tc ")) == "a b\n\nc"
    long = one(spark, text.preview_text(F.col("t"), 50), t=("string", "x" * 80))
    assert len(long) == 50 and long.endswith("……")


@pytest.mark.parametrize(
    ("line", "found"),
    [("mail a.b@c-d.example.org.", ["a.b@c-d.example.org"]), ("邮箱x@y.com", []), ("x@y.com在", []), ("a@b.cn, c@d.cn", ["a@b.cn", "c@d.cn"]), ("M12@24V", []), (None, None)],
)
def test_email(spark, line, found):
    assert one(spark, patterns.signal_values(F.col("t"), patterns.EMAIL), t=("string", line)) == found


def test_other_signals(spark):
    def values(line, pattern, group=0):
        return one(spark, patterns.signal_values(F.col("t"), pattern, group), t=("string", line))

    assert values("see https://a.example/x?y=1，then", patterns.URL) == ["https://a.example/x?y=1"]
    assert values("91380013800138000 and +86-13800138000.", patterns.MOBILE) == ["+86-13800138000"]
    assert values("电话：010-12345678转12", patterns.LABELLED_PHONE, 1) == ["010-12345678转12"]
    assert values("由上海某某有限公司制造", patterns.ORGANISATION) == ["由上海某某有限公司"]
    assert values("user@mail.example.com but shop.example.com/", patterns.DOMAIN) == ["example.com", "shop.example.com"]  # a part of an address behind a dot counts


def test_facts(spark):
    df = spark.createDataFrame([("型号 XO-1O5 在 10-20 ℃ 下 3.5kg，符合 ISO 9001",)], "t string")
    rows = df.select(F.explode(patterns.fact_tokens(F.col("t"))).alias("f")).select("f.kind", "f.token", patterns.fact_key(F.col("f.kind"), F.col("f.token")).alias("k")).collect()
    got = {(r.kind, r.k) for r in rows}
    assert ("model", "X0-105") in got and ("number_unit", "10-20°C") in got and ("certification", "ISO9001") in got and ("certification", "符合") in got


@pytest.mark.parametrize(("target", "host"), [("mailto:a@B.org?x=1", "b.org"), ("https://u@H.example:8/x", "h.example"), ("www.x.example/a", "www.x.example"), ("", ""), (None, "")])
def test_host(spark, target, host):
    assert one(spark, patterns.target_host(F.col("t")), t=("string", target)) == host


def test_occurrences_without_overlap(spark):
    assert one(spark, patterns.occurrences(F.col("t"), F.lit("aA")), t=("string", "aaaAa")) == 2
    assert one(spark, patterns.occurrences(F.col("t"), F.lit("")), t=("string", "aaa")) == 0


GRID = "array<array<string>>"


@pytest.mark.parametrize(
    ("rows", "serial"),
    [
        ([["序号", "a"], ["1", "x"], ["二", "y"]], True), ([["序号", "a"], ["x", "x"]], False), ([["①", "a"], ["②", "b"]], True), ([["①", "a"], ["Ⅱ", "b"]], False), ([["1", ""], ["2"]], False), ([["1", "a"]], False), ([], False), (None, False), ([None, ["1", "b"], ["2", "c"]], True), ([["", "x"], ["", "y"]], False),
    ],
)
def test_serial_column(spark, rows, serial):
    assert one(spark, grids.has_serial_column(F.col("r")), r=(GRID, rows)) is serial


def test_grid_shapes(spark):
    rows = [["a"], None, ["b", None, "c"]]
    assert one(spark, grids.joined_text(F.col("r")), r=(GRID, rows)) == "a\n\nb\t\tc"
    assert one(spark, grids.width(F.col("r")), r=(GRID, rows)) == 3
    assert one(spark, grids.padded(F.col("r")), r=(GRID, rows)) == [["a", "", ""], ["", "", ""], ["b", "", "c"]]
    assert one(spark, grids.width(F.col("r")), r=(GRID, None)) == 0


@pytest.mark.parametrize(("css", "inches"), [("72", 1.0), ("2.54cm", 1.0), ("25.4 mm", 1.0), ("96px", 1.0), ("1in", 1.0), ("0pt", None), ("x", None), (None, None)])
def test_css(spark, css, inches):
    got = one(spark, grids.css_inches(F.col("c")), c=("string", css))
    assert got == pytest.approx(inches) if inches else got is None
