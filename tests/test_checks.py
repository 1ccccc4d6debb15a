import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from docweft.functions import dates, geometry, grids, text
from docweft.operators import reports, templates, validation
from docweft.plans import checks
from docweft.plans import queries as core
from docweft.session import shared_folder
from docweft.sources import packages, pdf, writers


def test_pdf_lines():
    made = writers.pdf_bytes([["Hello (world)", "back\\slash"], [], ["Ünï"]])
    assert packages.probe(made) == ("pdf", "pdf", "") and pdf.page_lines(made) == [["Hello (world)", "back\\slash"], [], ["Ünï"]]
    assert pdf.page_lines(b"%PDF-1.4 nothing") == [] and pdf.page_lines(b"") == []
    mapped = b"1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj 2 0 obj << /Type /Pages /Kids [3 0 R] >> endobj 3 0 obj << /Type /Page /Resources << /Font << /F1 4 0 R >> >> /Contents 6 0 R >> endobj 4 0 obj << /Type /Font /ToUnicode 5 0 R >> endobj 5 0 obj << >>\nstream\nbeginbfchar <0001> <6cf5> <0002> <9600> endbfchar beginbfrange <0010> <0012> <0041> endbfrange\nendstream endobj 6 0 obj << >>\nstream\nBT /F1 9 Tf [<0001> -300 <0002>] TJ 0 -12 Td <00100012> Tj ET\nendstream endobj"
    assert pdf.page_lines(mapped) == [["泵 阀", "AC"]]


def test_canonical_packages():
    members = writers.office_members("docx", ["a < b & c", [["x", ""], ["1", "2"]]])
    made = writers.canonical_zip(members)
    assert made == writers.canonical_zip(dict(reversed(members.items()))) == writers.repacked(made)
    rows = packages.docx_items("p", made)
    assert [(r[3], r[5], r[6]) for r in rows] == [("text", "a < b & c", None), ("table", None, [["x", ""], ["1", "2"]])]
    slides = writers.canonical_zip(writers.office_members("pptx", ["one", "two"]))
    assert [r[5] for r in packages.pptx_items("p", slides)] == ["one", "two"]


def test_broken_packages_are_findings(spark):
    good = writers.canonical_zip(writers.office_members("docx", ["fine"]))
    members = writers.office_members("docx", ["x"])
    members["word/document.xml"] = b"<w:document"
    slides = writers.office_members("pptx", ["x"])
    slides.pop("ppt/slides/slide1.xml")
    at = good.index(b"word/document.xml") + len("word/document.xml")
    crushed = good[:at] + b"\xff" * 12 + good[at + 12 :]
    files = {"good": good, "bad_xml": writers.canonical_zip(members), "no_slide": writers.canonical_zip(slides), "crushed": crushed, "text": b"plain", "empty": b""}
    df = spark.createDataFrame(list(files.items()), "path string, content binary")
    found = {r.path: (r.status, r.code) for r in packages.package_findings(df).collect()}
    assert set(found) == set(files) - {"good"} and {s for s, _ in found.values()} == {"BLOCKED"}
    assert found["bad_xml"][1] == "OOXML_PART_INVALID" and found["crushed"][1] == "OOXML_MEMBER_CORRUPT"
    assert {r.path for r in packages.package_items(df).collect()} == {"good"}
    with pytest.raises(zipfile.BadZipFile):
        writers.repacked(b"plain")


def test_schema_keywords(spark):
    df = spark.createDataFrame([("a", {"x1": 1, "y": 2}, "2024-02-29T00:00:00Z"), ("b", {"x1": -1}, "2023-02-29T00:00:00Z"), ("c", {}, "2024-01-01"), (None, None, None)], "kind string, m map<string,int>, t string")
    schema = {
        "definitions": {"positive": {"minimum": 0}}, "properties": {"m": {"patternProperties": {"^x": {"$ref": "#/definitions/positive"}}, "additionalProperties": False, "minProperties": 1, "maxProperties": 2}, "t": {"format": "date-time"}},
        "if": {"properties": {"kind": {"const": "a"}}}, "then": {"properties": {"t": {"maxLength": 5}}}, "else": {"properties": {"t": {"minLength": 15}}},
    }
    errors = validation.schema_errors(F.struct("kind", "m", "t"), schema)
    got = [sorted((e.path, e.keyword) for e in r[0]) for r in df.select(errors).collect()]
    assert got == [[("$.m", "additionalProperties"), ("$.t", "maxLength")], [("$.m/^x", "minimum"), ("$.t", "format")], [("$.m", "minProperties"), ("$.t", "format"), ("$.t", "minLength")], []]
    with pytest.raises(ValueError):
        validation.schema_errors(F.col("t"), {"$ref": "#/definitions/a", "definitions": {"a": {"$ref": "#/definitions/a"}}})


def test_reports_handle_nothing(spark):
    keys = "document string, source_id string"
    empty = spark.createDataFrame([], keys + ", confidence double")
    assert reports.decision_report(empty, empty, empty, ["document", "source_id"]).count() == 0
    one = spark.createDataFrame([("d", "s", None), (None, None, 0.9)], keys + ", confidence double")
    rows = {(r.document, r.code) for r in reports.decision_report(empty, one, empty, ["document", "source_id"]).collect()}
    assert rows == {("d", "SOURCE_UNKNOWN"), ("d", "CONFIDENCE_INVALID"), (None, "SOURCE_UNKNOWN")}


def test_plan_digests_know_no_order(spark):
    rows = [("d", i, f"s{i}", "a") for i in range(50)]
    one, two = (reports.plan_digest(spark.createDataFrame(r, "document string, execution_order int, source_id string, action string").repartition(3), "document", ["execution_order", "source_id", "action"]).first().digest for r in (rows, rows[::-1]))
    assert one == two
    other = reports.plan_digest(spark.createDataFrame(rows[1:], "document string, execution_order int, source_id string, action string"), "document", ["execution_order", "source_id", "action"]).first().digest
    assert other != one


@pytest.fixture(scope="module")
def long_plans(spark, tmp_path_factory):
    """A folder with a plan whose digests add up to more than a bigint holds, and two short ones."""
    folder = tmp_path_factory.mktemp("long")
    document = F.when(F.col("id") < 100_000, "PKG-1").when(F.col("id") < 100_100, "PKG-3").otherwise("PKG-7")
    rows = spark.range(100_200).select(F.col("id").alias("row_id"), document.alias("document"), F.concat(F.lit("TEXT-"), F.upper(F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 12))).alias("source_id"), F.col("id").cast("int").alias("ordinal"), F.timestamp_seconds(F.col("id")).alias("ingested_at"))
    rows.write.parquet(str(folder / "inventory_item.parquet"))
    return str(folder)


def of_sql(folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW inventory_item AS SELECT * FROM '{folder}/inventory_item.parquet/*.parquet'")
    result = con.execute(core.ORACLE_SQL[name])
    return [d[0] for d in result.description], sorted(result.fetchall())


def test_long_plans_are_validated(spark, long_plans):
    columns, rows = of_sql(long_plans, "content_plan_validation")
    assert {("PKG-3", "PLAN_DIGEST_WRONG", 1), ("PKG-7", "ORDER_GAP", 1)} <= set(rows)
    assert sorted(map(tuple, checks.content_plan_validation(spark, long_plans).select(*columns).collect())) == rows


def test_digests_of_long_plans(spark, long_plans):
    columns, rows = of_sql(long_plans, "plan_digests")
    assert len(rows) == 3 and max(int(x) for r in rows for x in r[columns.index("digest")].split("-")) >= 2**63
    assert sorted(map(tuple, checks.plan_digests(spark, long_plans).select(*columns).collect())) == rows


def test_functions(spark):
    df = spark.createDataFrame([(["a", "", None], "é", '{"a/b":[1,{"c":"x"}]}'), ([], None, None), (["", ""], "é", "no")], "r array<string>, t string, j string")
    got = df.select(grids.trailing_span(F.col("r")).alias("s"), text.composed(F.col("t")).alias("t"), text.json_pointer(F.col("j"), "/a~1b/1/c").alias("j"), dates.is_date_time(F.col("t")).alias("d")).collect()
    assert [(r.s, r.t, r.j, r.d) for r in got] == [(3, "é", "x", False), (None, None, None, False), (2, "é", None, False)]
    m = geometry.after(geometry.matrix(*(F.lit(float(x)) for x in (0, 2, -3, 0, 1, 1))), geometry.matrix(*(F.lit(float(x)) for x in (1, 0, 0, 1, 5, 5))))
    assert df.select(geometry.extent(m).alias("e"), m.alias("m")).first() == ((2.0, 3.0), (0.0, 2.0, -3.0, 0.0, 6.0, 6.0))


def test_resolution(spark):
    catalog = spark.createDataFrame([("p1", "a", "r"), ("p2", "b", "r"), ("p3", "b", None)], "reference string, name string, route string")
    asked = spark.createDataFrame([(1, "a", "r"), (2, "b", None), (3, None, "r"), (4, None, None), (5, "zz", "r")], "request int, name string, route string")
    got = {r.request: (r.via, r.reference, r.status) for r in templates.resolved(asked, catalog, "request", ["name", "route"]).collect()}
    assert got == {1: ("name", "p1", "RESOLVED"), 2: ("name", None, "HUMAN_REVIEW"), 3: ("route", None, "HUMAN_REVIEW"), 4: (None, None, "HUMAN_REVIEW"), 5: ("name", None, "HUMAN_REVIEW")}


def test_a_cluster_names_its_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError):
        shared_folder(Session())
