import random

import pytest
from pyspark.sql import functions as F

from docweft.operators import bundles, cache, coverage, groups, items, pages, redaction, signals, templates, validation

ITEM = "row_id long, document string, source_id string, ordinal int, ingested_at timestamp, kind string, location string, text string, rows array<array<string>>, name string, title string, description string, sha256 string, visual_sha256 string, bytes long, source_part string, relationship_id string, relationship_type string, target string, target_mode string, extraction string"
NAMES = [c.split()[0] for c in ITEM.split(", ")]


def inventory(spark, *rows):
    return spark.createDataFrame([tuple(r.get(n) for n in NAMES) for r in rows], ITEM)


def sets(df):
    return sorted(tuple(r) for r in df.collect())


def test_first_delivery(spark):
    df = inventory(spark, {"row_id": 2, "document": "d", "source_id": "a", "ordinal": 1}, {"row_id": 1, "document": "d", "source_id": "a", "ordinal": 1}, {"row_id": 3, "document": "d"}, {"row_id": 4, "document": "e", "source_id": "a"})
    assert sets(items.first_deliveries(df).select("row_id")) == [(1,), (4,)]
    assert items.first_deliveries(df.where("false")).count() == 0


def test_payload_errors(spark):
    df = inventory(spark, {"row_id": 1, "kind": "table", "location": "t"}, {"row_id": 2, "kind": "image", "location": "i", "sha256": "xy"}, {"row_id": 3, "kind": "image", "location": "i", "sha256": "aB" * 32}, {"row_id": 4, "kind": "what", "location": " "})
    rows = {r.row_id: r for r in items.typed_payload(df).collect()}
    assert rows[1].error == "INVENTORY_TABLE_INVALID" and rows[2].error == "INVENTORY_ASSET_SHA_INVALID" and rows[4].error == "INVENTORY_LOCATION_MISSING"
    assert rows[3].error is None and rows[3].payload.sha256 == "AB" * 32 and rows[4].payload.type == "generic"


def test_region_order(spark):
    df = spark.createDataFrame([("slide:1/shape:2", "ppt/notesSlides/n1.xml", None, "body"), (None, "ppt\\SlideMasters\\m.xml", None, None), (None, None, None, " header "), ("ppt/slides/slide3.xml", None, None, None)], "l string, p string, s string, r string")
    cols = [F.col(c) for c in "lpsr"]
    assert [r[0] for r in df.select(items.region(*cols)).collect()] == ["slide", "slide_master", "header", "slide"]
    assert df.select(items.region(*cols, explicit_first=True)).collect()[0][0] == "body"


def fold(rows):
    out = {}
    for d in {r[0] for r in rows}:
        batch = count = chars = 0
        for _, i, n in sorted(r for r in rows if r[0] == d):
            n = n or 0
            if count and (count >= 40 or chars + n > 16_000):
                batch, count, chars = batch + 1, 0, 0
            count, chars = count + 1, chars + n
            out[d, i] = batch
    return out


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_greedy_packing_is_the_fold(spark, partitions):
    """Also where one document fills many partitions, and where partitions hold less than a batch."""
    rng = random.Random(partitions)
    rows = [(d, i, rng.choice([0, 5, 900, 4000, 8000, None])) for d in range(5) for i in range(60 if d else 900)] + [(9, 0, 20_000), (9, 1, 1)]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r.d, r.i): r.batch_index for r in bundles.pack(spark.createDataFrame(rows, "d int, i int, n int"), "d", ["i"], "n").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == fold(rows)
    assert bundles.pack(spark.createDataFrame([], "d int, i int, n int"), "d", ["i"], "n").count() == 0
    report = bundles.batch_report(bundles.pack(spark.createDataFrame([(1, i, 10) for i in range(41)], "d int, i int, n int"), "d", ["i"], "n"), "d", "n")
    assert sets(report.select("batch_index", "items")) == [(0, 40), (1, 1)]


def test_exact_budget(spark):
    df = spark.createDataFrame([(1, i, 4000) for i in range(5)], "d int, i int, n int")
    assert [r.batch_index for r in bundles.pack(df, "d", ["i"], "n").orderBy("i").collect()] == [0, 0, 0, 0, 1]


def test_signal_offsets(spark):
    df = spark.createDataFrame([(1, "f", "😀 a@b.cn and a@b.cn.")], "id int, field string, text string")
    rows = signals.signal_offsets(df, ["id"]).where("type = 'email'").orderBy("start").collect()
    assert [(r.start, r.end, r.value) for r in rows] == [(2, 8, "a@b.cn"), (13, 19, "a@b.cn")] and len({r.signal_id for r in rows}) == 2


def test_identity_domains(spark):
    links = inventory(spark, {"row_id": 1, "kind": "relationship", "target": "https://x.firm.example/a"}, {"row_id": 2, "kind": "relationship", "target": "mailto:a@firm.example"}, {"row_id": 3, "kind": "relationship", "target": "https://notfirm.example"}, {"row_id": 4, "kind": "text", "target": "https://firm.example"})
    terms = spark.createDataFrame([("info@firm.example",), (None,), ("no domain",)], "term string")
    assert sets(signals.identity_removals(links, terms, ["row_id"]).select("row_id")) == [(1,), (2,)]


def test_term_hits(spark):
    parts = spark.createDataFrame([(1, "aaaAa Firm firm"), (2, None), (3, ""), (4, "nothing")], "id int, text string")
    terms = spark.createDataFrame([("aA",), ("firm",), ("FIRM",), (None,), (" ",)], "term string")
    assert sets(signals.term_hits(parts, terms, ["id"])) == [(1, "FIRM", 2), (1, "aA", 2), (1, "firm", 2)]
    assert signals.term_hits(parts, terms.where("false"), ["id"]).count() == 0
    with pytest.raises(ValueError):
        signals.term_hits(parts, terms, ["id"], most_terms=1)


def test_every_query_plan_is_free_of_loops(spark):
    """No Cartesian product and no nested loop in any of the engine's queries."""
    import os

    from docweft.plans import more  # noqa: F401 - registers its queries
    from docweft.plans import queries

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    for name, query in queries.QUERIES.items():
        plan = query(spark, folder)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


def test_rollups(spark):
    stages = spark.createDataFrame([(1, "PASS"), (1, "HUMAN_REVIEW"), (2, "PASS"), (3, "odd"), (3, "PASS"), (4, "BLOCKED"), (4, "FAIL")], "run int, status string")
    runs = spark.range(1, 6).selectExpr("CAST(id AS INT) AS run")
    assert sets(groups.status_rollup(stages, ["run"], universe=runs)) == [(1, "HUMAN_REVIEW"), (2, "PASS"), (3, "FAIL"), (4, "BLOCKED"), (5, "FAIL")]
    acts = spark.createDataFrame([(1, "APPROVE"), (1, "APPROVE"), (2, "APPROVE"), (2, "REJECT"), (3, "REQUEST_REVISION"), (4, "APPROVE"), (4, None)], "d int, action string")
    assert sets(groups.review_rollup(acts, ["d"])) == [(1, "APPROVED"), (2, "REJECTED"), (3, "REVISION_REQUESTED"), (4, "FACT_PENDING")]
    tele = spark.createDataFrame([("s", 1.5, "HIT"), ("s", 2.0, "MISS"), ("s", 1.0, None), ("t", 1.0, None)], "stage string, duration_ms double, cache_status string")
    assert sets(groups.telemetry(tele, ["stage"])) == [("s", 3, 4.5, 1, 2, 0.5), ("t", 1, 1.0, 0, 0, 0.0)]


def test_pages(spark):
    have = spark.createDataFrame([("d", 1), ("d", 1), ("d", 4), ("d", None)], "document string, page int")
    declared = spark.createDataFrame([("d", 3), ("e", None), ("f", 0)], "document string, page_count int")
    assert sets(groups.sequence_findings(have, declared, "document", "page", "page_count")) == [("d", 1, "DUPLICATE"), ("d", 2, "MISSING"), ("d", 3, "MISSING"), ("d", 4, "EXTRA")]
    assert sets(groups.gaps(have, "document", "page")) == [("d", 1, 4)]
    metrics = spark.createDataFrame([("d", 1, 0, 0.5, 0.0), ("d", 2, 0, 0.5, 0.0), ("d", 3, 2, 9.0, 0.3), ("d", 4, 2, 9.0, 0.3)], "document string, page int, content_objects int, gray_stddev double, content_bottom_ratio double")
    assert sets(pages.page_findings(metrics, ["document"])) == [("d", 1, "EDGE_PAGE_BLANK"), ("d", 2, "BLANK_PAGE"), ("d", 3, "LARGE_GAP")]


def test_islands_and_sections(spark):
    rows = spark.createDataFrame([("d", i, k) for i, k in enumerate("tiitiii")], "d string, o int, k string")
    assert sets(groups.islands(rows, "d", "o", "k = 'i'").select("o", "island", "place")) == [(1, 1, 1), (2, 1, 2), (4, 2, 1), (5, 2, 2), (6, 2, 3)]
    heads = spark.createDataFrame([("d", 2, "A"), ("d", 5, "B")], "d string, o int, title string")
    assert sets(coverage.in_section(rows, heads, "d", "o", "title").select("o", "section").where("section IS NOT NULL")) == [(2, "A"), (3, "A"), (4, "A"), (5, "B"), (6, "B")]


def test_subsequence(spark):
    have = spark.createDataFrame([(1, 0, "a"), (1, 1, "x"), (1, 2, "b"), (2, 0, "b"), (2, 1, "a")], "d int, o int, v string")
    want = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "a"), (2, 1, "b"), (3, 0, "a")], "d int, o int, v string")
    assert sets(groups.ordered_subsequence(want, have, "d", "o", "v")) == [(1, True), (2, False), (3, False)]


def test_coverage(spark):
    have, decided = spark.createDataFrame([("a",), ("b",)], "k string"), spark.createDataFrame([("b",), ("c",), ("c",)], "k string")
    assert sets(coverage.coverage(have, decided, ["k"])) == [("a", "SOURCE_NOT_DECIDED"), ("c", "DECISION_UNKNOWN_SOURCE")]
    assert sets(coverage.duplicates(decided, ["k"], "X")) == [("c", 2, "X")]
    refs = spark.createDataFrame([("a", "e1"), ("a", "e2"), ("a", "e9")], "source_id string, evidence_id string")
    ev = spark.createDataFrame([("a", "e1"), ("b", "e2"), ("b", "e2")], "source_id string, evidence_id string")
    assert sets(coverage.evidence_findings(refs, ev, [], "source_id")) == [("a", "e2", "EVIDENCE_OF_OTHER_SOURCE"), ("a", "e9", "EVIDENCE_UNKNOWN")]
    tasks = spark.createDataFrame([("t", "a"), ("t", "b")], "task_id string, k string")
    parts = spark.createDataFrame([("t", "a"), ("u", "a"), ("t", "z")], "task_id string, k string")
    assert sets(coverage.union_fragments(parts, tasks, ["k"])) == [("a", "DECIDED_TWICE"), ("a", "NOT_IN_TASK"), ("z", "NOT_IN_TASK")]


def test_redaction(spark):
    df = spark.createDataFrame([("a Firm b FIRM", ["Firm", None, ""]), (None, None), ("x", [])], "text string, redactions array<string>")
    out = [r[0] for r in df.select(redaction.redacted(F.col("text"), F.col("redactions"))).collect()]
    assert out == ["a b FIRM", "", "x"]
    again = df.withColumn("t", redaction.redacted(F.col("text"), F.col("redactions"))).where(redaction.redacted(F.col("t"), F.col("redactions")) != F.col("t"))
    assert again.count() == 0


def test_decisions(spark):
    df = spark.createDataFrame([(1, 0.8), (2, 0.79), (3, None), (4, 1.2)], "k int, confidence double")
    assert sets(validation.decision_findings(df, ["k"])) == [(2, "LOW_CONFIDENCE", "REVIEW"), (3, "CONFIDENCE_INVALID", "FAIL"), (4, "CONFIDENCE_INVALID", "FAIL")]


def test_schema(spark):
    schema = {"required": ["id"], "properties": {"id": {"pattern": "^[A-Z]+$"}, "n": {"minimum": 1, "maximum": 3}, "tags": {"minItems": 1, "uniqueItems": True, "items": {"maxLength": 2}}, "kind": {"anyOf": [{"const": "a"}, {"enum": ["b", "c"]}]}}}
    df = spark.createDataFrame([("AB", 2, ["x"], "b"), (None, 0, [], "z"), ("a", 4, ["xxx", "xxx"], "a")], "id string, n int, tags array<string>, kind string")
    got = [sorted(e.keyword for e in r[0]) for r in df.select(validation.schema_errors(F.struct(*df.columns), schema)).collect()]
    assert got == [[], ["anyOf", "minItems", "minimum", "required:id"], ["maxLength", "maxLength", "maximum", "pattern", "uniqueItems"]]


def test_templates(spark):
    ops = spark.createDataFrame([("t", 1, "insert_text", {"slot": "a"}), ("t", 2, "run", {}), ("t", 3, "page_break", {"Python": "x"})], "template_id string, ordinal int, op string, args map<string,string>")
    assert sets(templates.program_findings(ops, ["template_id"])) == [("t", 2, "UNKNOWN_OPERATION"), ("t", 3, "FORBIDDEN_KEY")]
    slots = spark.createDataFrame([("t", "a", "text", True, 1, 2), ("t", "b", "image", False, 2, 3)], "t string, slot_id string, kind string, required boolean, min_items int, max_items int")
    material = spark.createDataFrame([("t", "b"), ("t", "q")], "t string, slot_id string")
    assert sets(templates.slot_findings(material, slots, "t").select("slot_id", "code")) == [("a", "REQUIRED_SLOT_EMPTY"), ("b", "TOO_FEW_ITEMS"), ("q", "UNKNOWN_SLOT")]
    packs = spark.createDataFrame([("p", "released", "APPROVED", "PASS", 0), ("q", "draft", "APPROVED", "PASS", 0), ("r", "released", "APPROVED", "PASS", 1)], "reference string, lifecycle string, approval_status string, validation_status string, open_findings int")
    assert sets(templates.released(packs).select("reference")) == [("p",)]


def test_cache(spark):
    manifest = spark.createDataFrame([("k", "a", "1"), ("k", "b", "2"), ("l", "a", "1")], "key string, member string, sha256 string")
    members = spark.createDataFrame([("k", "a", "1"), ("k", "b", "2"), ("l", "a", "9")], "key string, member string, sha256 string")
    wanted = spark.createDataFrame([("k",), ("l",), ("m",)], "key string")
    assert sets(cache.lookup(wanted, manifest, members)) == [("k", "HIT"), ("l", "CORRUPT"), ("m", "MISS")]


def test_plans_stay_free_of_cross_joins(spark):
    links = inventory(spark, {"row_id": 1, "kind": "relationship", "target": "https://x.firm.example/a"})
    plan = signals.identity_removals(links, spark.createDataFrame([("firm.example",)], "term string"), ["row_id"])._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
