"""Queries of reports, packages, geometry and times."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.functions import dates, geometry, grids, text
from docweft.operators import bundles, groups, reports, templates, validation
from docweft.plans import derived
from docweft.plans.derived import with_sql
from docweft.plans.queries import _items, _norm, query
from docweft.session import ship_code
from docweft.sources import packages, pdf, writers
from docweft.sources.tables import table


def _codes(*pairs: tuple[str, str]) -> str:
    return "unnest(list_filter([" + ", ".join(f"CASE WHEN {bad} THEN '{code}' END" for code, bad in pairs) + "], lambda c: c IS NOT NULL)) AS code"


# ---- reports -----------------------------------------------------------------------------------------------------

_TAGGED = """, s AS (SELECT document, source_id, sum(i) AS i, sum(d) AS d, sum(u) AS u, sum(bad) AS bad, sum(low) AS low FROM (
    SELECT document, source_id, 1 AS i, 0 AS d, 0 AS u, 0 AS bad, 0 AS low FROM items
    UNION ALL SELECT document, source_id, 0, 1, 0, (confidence IS NULL OR confidence < 0 OR confidence > 1)::INT, coalesce(confidence >= 0 AND confidence < 0.8, false)::INT FROM decisions
    UNION ALL SELECT document, source_id, 0, 0, 1, 0, 0 FROM unresolved) GROUP BY ALL), f AS (SELECT document, source_id, """ + _codes(
    ("SOURCE_UNDECIDED", "i > 0 AND d = 0 AND u = 0"), ("SOURCE_UNKNOWN", "i = 0 AND d > 0"), ("DECIDED_TWICE", "d > 1"), ("DECIDED_AND_UNRESOLVED", "d > 0 AND u > 0"), ("CONFLICT_OPEN", "u > 0"), ("CONFIDENCE_INVALID", "bad > 0"), ("LOW_CONFIDENCE", "low > 0")
) + " FROM s), g AS (SELECT *, CASE WHEN code IN ('CONFLICT_OPEN', 'LOW_CONFIDENCE') THEN 'REVIEW' ELSE 'FAIL' END AS severity FROM f)"


def _report(spark: SparkSession, folder: str) -> DataFrame:
    rows = _items(spark, folder)
    return reports.decision_report(rows, derived.decisions(rows), derived.unresolved(rows), ["document", "source_id"])


@query(with_sql("items", "decisions", "unresolved") + _TAGGED + " SELECT document, source_id, code, severity FROM g")
def decision_validation(spark: SparkSession, folder: str) -> DataFrame:
    """L4: all findings on a set of decisions."""
    return _report(spark, folder)


@query(with_sql("items", "decisions", "unresolved") + _TAGGED + " SELECT d.document, CASE WHEN bool_or(severity = 'FAIL') THEN 'FAIL' WHEN bool_or(severity = 'REVIEW') THEN 'HUMAN_REVIEW' ELSE 'PASS' END AS verdict FROM source_document d LEFT JOIN g USING (document) GROUP BY d.document")
def decision_status(spark: SparkSession, folder: str) -> DataFrame:
    """The verdict on each document's decisions."""
    return groups.verdict(_report(spark, folder).select("document", "code", "severity"), ["document"], table(spark, folder, "source_document", "document"))


_MAP = """, m AS (SELECT document, source_id, CASE WHEN ordinal % 23 = 0 THEN 'invented' ELSE action END AS action, CASE WHEN (action IN ('exclude_from_output', 'remove_identity', 'remove_template_background') AND target_order % 5 <> 0) OR target_order % 17 = 0 THEN NULL ELSE target_slot END AS target_slot, target_order // 7 AS target_order FROM (SELECT *, target_order AS ordinal FROM decisions))"""
_SHOWN = "action IN ('preserve_exact', 'reviewed_text', 'redact_identity', 'preserve_image', 'preserve_sanitized_image')"


def _map(rows: DataFrame) -> DataFrame:
    d = derived.decisions(rows)
    hidden = F.col("action").isin(*reports.HIDDEN_ACTIONS) & (F.col("target_order") % 5 != 0)
    slot = F.when(~(hidden | (F.col("target_order") % 17 == 0)), F.col("target_slot"))
    return d.select("document", "source_id", F.when(F.col("target_order") % 23 == 0, "invented").otherwise(F.col("action")).alias("action"), slot.alias("target_slot"), F.expr("target_order DIV 7").cast("int").alias("target_order"))


@query(with_sql("items", "decisions") + _MAP + f""", k AS (SELECT document, target_slot, target_order FROM m WHERE {_SHOWN} AND target_slot IS NOT NULL GROUP BY ALL HAVING count(*) > 1)
    SELECT document, source_id, {_codes(("ACTION_UNKNOWN", "action = 'invented'"), ("TARGET_MISSING", f"{_SHOWN} AND target_slot IS NULL"), ("TARGET_OF_HIDDEN", "action IN ('exclude_from_output', 'remove_identity', 'remove_template_background') AND target_slot IS NOT NULL"))} FROM m
    UNION ALL SELECT document, source_id, 'TARGET_TWICE' FROM m JOIN k USING (document, target_slot, target_order) WHERE {_SHOWN}
    UNION ALL SELECT document, source_id, 'EVIDENCE_MISSING' FROM m WHERE action = 'reviewed_text' AND NOT EXISTS (SELECT 1 FROM evidence e WHERE e.document = m.document AND e.source_id = m.source_id)""")
def content_map_validation(spark: SparkSession, folder: str) -> DataFrame:
    """All findings on a content map."""
    rows = _items(spark, folder)
    return reports.content_map_report(_map(rows), table(spark, folder, "evidence", "document", "source_id"), "document", tuple(derived.ACTIONS.values()))


_PLAN = ", plan AS (SELECT document, source_id, action, row_number() OVER (PARTITION BY document ORDER BY target_slot, target_order, source_id) + CASE WHEN document LIKE '%7' THEN 1 ELSE 0 END AS execution_order FROM decisions)"
_HEX = "lower(sha256(concat_ws(chr(31), execution_order, source_id, action)))"
_DIGEST = "count(*) || '-' || sum(('0x' || substring(h, 1, 12))::BIGINT) || '-' || sum(('0x' || substring(h, 13, 12))::BIGINT)"


def _plan(rows: DataFrame) -> DataFrame:
    n = reports.numbered(derived.decisions(rows), ["document"], ["target_slot", "target_order", "source_id"], "execution_order")
    return n.select("document", "source_id", "action", (F.col("execution_order") + F.col("document").endswith("7").cast("int")).cast("bigint").alias("execution_order"))


@query(with_sql("items", "decisions") + _PLAN + f" SELECT document, {_DIGEST} AS digest FROM (SELECT document, {_HEX} AS h FROM plan) GROUP BY document")
def plan_digests(spark: SparkSession, folder: str) -> DataFrame:
    """A plan's digest, the same in any order of its rows."""
    return reports.plan_digest(_plan(_items(spark, folder)), "document", ["execution_order", "source_id", "action"])


@query(with_sql("items", "decisions") + _PLAN + f""", o AS (SELECT document, count(*) AS n, count(DISTINCT execution_order) AS d, min(execution_order) AS lo, max(execution_order) AS hi FROM plan GROUP BY document)
    SELECT document, code, 1::BIGINT AS n FROM (SELECT document, {_codes(("ORDER_TWICE", "d < n"), ("ORDER_GAP", "lo <> 1 OR hi <> d"))} FROM o)
    UNION ALL SELECT document, 'PLAN_DIGEST_WRONG', 1 FROM o WHERE document LIKE '%3'
    UNION ALL SELECT document, 'OUTPUT_MISSING', count(*) FROM plan WHERE action IN ('preserve_exact', 'preserve_image') AND (right(source_id, 1) = '5' OR source_id LIKE 'GHOST-%') GROUP BY document""")
def content_plan_validation(spark: SparkSession, folder: str) -> DataFrame:
    """Order, digest and output of content plans."""
    rows = _items(spark, folder)
    plan, columns = _plan(rows), ["execution_order", "source_id", "action"]
    stated = reports.plan_digest(plan, "document", columns).withColumn("digest", F.when(F.col("document").endswith("3"), "stale").otherwise(F.col("digest")))
    return reports.content_plan_report(plan, stated, rows.where("right(source_id, 1) <> '5'"), "document", columns)


_BOUND = ("source", "inventory", "decision", "plan", "output", "render", "template")
_KNOWN = "(SELECT evidence_id FROM evidence WHERE evidence_id IS NOT NULL)"


@query(f"""
    WITH q AS (SELECT review_id, status FROM identity_review WHERE review_id % 5 <> 0), r AS (SELECT review_id, evidence_ids, CASE WHEN review_id % 13 = 0 THEN 'SHRUG' ELSE 'APPROVE' END AS action FROM identity_review WHERE review_id % 6 <> 0),
    j AS (SELECT coalesce(q.review_id, r.review_id) AS review_id, q.review_id IS NOT NULL AS inq, r.review_id IS NOT NULL AS inr, action FROM q FULL JOIN r ON q.review_id = r.review_id)
    SELECT review_id, {_codes(("DECISION_MISSING", "NOT inr"), ("DECISION_UNKNOWN_ITEM", "NOT inq"), ("ACTION_INVALID", "inr AND action = 'SHRUG'"), *((f"STALE_{b.upper()}", f"inq AND inr AND review_id % {n} = 0") for n, b in enumerate(_BOUND, 7)))} FROM j
    UNION ALL SELECT DISTINCT review_id, 'EVIDENCE_UNKNOWN' FROM (SELECT review_id, unnest(evidence_ids) AS e FROM r) WHERE e NOT IN {_KNOWN}
""")
def receipt_bindings(spark: SparkSession, folder: str) -> DataFrame:
    """Receipts against the seven digests they are bound to, and against their evidence."""
    rows = table(spark, folder, "identity_review", "review_id", "status", "evidence_ids")
    digests = [text.sha256_hex(F.concat_ws("|", F.col("review_id").cast("string"), F.lit(b), "status")).alias(b) for b in _BOUND]
    queue = rows.where("review_id % 5 <> 0").select("review_id", *digests)
    receipt = rows.where("review_id % 6 <> 0").select("review_id", "evidence_ids", F.when(F.col("review_id") % 13 == 0, "SHRUG").otherwise("APPROVE").alias("action"), *digests)
    receipt = receipt.withColumns({b: F.when(F.col("review_id") % n == 0, "old").otherwise(F.col(b)) for n, b in enumerate(_BOUND, 7)})
    return reports.receipt_report(queue, receipt, table(spark, folder, "evidence", "evidence_id").where("evidence_id IS NOT NULL"), ["review_id"], list(_BOUND), ("APPROVE", "REJECT"))


@query("SELECT item_id, unnest(list_filter([CASE WHEN payload.type = 'table' AND payload.rows IS NULL THEN '$.rows required' END, CASE WHEN payload.type = 'asset' AND payload.sha256 IS NOT NULL AND NOT regexp_full_match(payload.sha256, '[0-9A-F]{64}') THEN '$.sha256 pattern' END, CASE WHEN len(list_filter(map_keys(attributes), lambda k: NOT regexp_matches(k, '^[a-l]'))) > 0 THEN '$.attributes additionalProperties' END, CASE WHEN len(map_keys(attributes)) > 1 THEN '$.attributes maxProperties' END], lambda c: c IS NOT NULL)) AS error FROM typed_item")
def schema_rules(spark: SparkSession, folder: str) -> DataFrame:
    """L1: references, conditions, and rules on the names of properties."""
    rows = table(spark, folder, "typed_item", "item_id", "payload", "attributes")
    schema = {
        "$defs": {"digest": {"pattern": "^[0-9A-F]{64}$"}, "named": {"patternProperties": {"^[a-l]": {}}, "additionalProperties": False, "maxProperties": 1}},
        "allOf": [{"if": {"properties": {"type": {"const": "table"}}}, "then": {"required": ["rows"]}}, {"if": {"properties": {"type": {"const": "asset"}}}, "then": {"properties": {"sha256": {"$ref": "#/$defs/digest"}}}}],
        "properties": {"attributes": {"$ref": "#/$defs/named"}},
    }
    value = F.struct(F.col("payload.type").alias("type"), F.col("payload.rows").alias("rows"), F.col("payload.sha256").alias("sha256"), F.col("attributes").alias("attributes"))
    error = F.explode(validation.schema_errors(value, schema))
    return rows.select("item_id", error.alias("e")).select("item_id", F.when(F.col("e.keyword").startswith("required:"), F.concat(F.lit("$."), F.substring_index("e.keyword", ":", -1), F.lit(" required"))).otherwise(F.concat_ws(" ", "e.path", "e.keyword")).alias("error"))


@query(with_sql("items") + """, t AS (SELECT document, source_id, CASE WHEN right(source_id, 1) IN ('0', '1', '2', '3', '4', '5', '6', '7') THEN kind ELSE 'image' END AS kind, (ordinal % 10) / 10.0 + 0.1 AS confidence FROM items), s AS (SELECT document, source_id, list_distinct(list(kind)) AS kinds FROM evidence WHERE kind IS NOT NULL GROUP BY ALL)
    SELECT t.document, t.source_id, """ + _codes(("SIGNAL_MISSING", "kinds IS NULL"), ("SIGNAL_OF_OTHER_KIND", "kinds IS NOT NULL AND NOT coalesce(list_contains(kinds, t.kind), false)"), ("CONFIDENCE_TOO_LOW", "confidence < 0.8")) + " FROM t LEFT JOIN s USING (document, source_id)")  # fmt: skip
def candidate_provenance(spark: SparkSession, folder: str) -> DataFrame:
    """Resolved candidates and the evidence of their kind."""
    rows = _items(spark, folder)
    kind = F.when(F.right("source_id", F.lit(1)).isin(*"01234567"), F.col("kind")).otherwise("image")
    candidates = rows.select("document", "source_id", kind.alias("kind"), (F.col("ordinal") % 10 / 10.0 + 0.1).alias("confidence"))
    return reports.unproven(candidates, table(spark, folder, "evidence", "document", "source_id", "kind").withColumnRenamed("kind", "type").where("type IS NOT NULL"), ["document", "source_id"])


@query(with_sql("items", "decisions") + "SELECT document, target_slot, source_id, row_number() OVER (PARTITION BY document, target_slot ORDER BY target_order, source_id) AS position FROM decisions")
def section_entries(spark: SparkSession, folder: str) -> DataFrame:
    """H2: entries of a section in the order of their targets."""
    return reports.numbered(derived.decisions(_items(spark, folder)), ["document", "target_slot"], ["target_order", "source_id"]).select("document", "target_slot", "source_id", "position")


@query("SELECT document, evidence_id, row_number() OVER (PARTITION BY document ORDER BY source_id NULLS FIRST, evidence_id, path NULLS FIRST, page_or_position NULLS FIRST) AS position FROM (SELECT DISTINCT document, source_id, evidence_id, path, page_or_position FROM evidence)")
def canonical_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """H8: evidence in its canonical order once it is merged."""
    rows = table(spark, folder, "evidence", "document", "source_id", "evidence_id", "path", "page_or_position").distinct()
    return reports.numbered(rows, ["document"], ["source_id", "evidence_id", "path", "page_or_position"]).select("document", "evidence_id", "position")


@query("WITH q AS (SELECT review_id, status, document FROM identity_review WHERE review_id % 4 <> 0), d AS (SELECT review_id, CASE WHEN review_id % 3 = 0 THEN 'REJECT' ELSE 'APPROVE' END AS action, 'r' || (review_id % 5) AS reviewer FROM identity_review WHERE review_id % 5 <> 0) SELECT review_id, action, reviewer, 'RECEIPT-' || upper(substring(sha256(concat_ws(chr(31), review_id, coalesce(document, ''), coalesce(status, ''), action)), 1, 16)) AS receipt_id FROM q JOIN d USING (review_id)")
def built_receipts(spark: SparkSession, folder: str) -> DataFrame:
    """Receipts of decided reviews."""
    rows = table(spark, folder, "identity_review", "review_id", "status", "document")
    decided = rows.where("review_id % 5 <> 0").select("review_id", F.when(F.col("review_id") % 3 == 0, "REJECT").otherwise("APPROVE").alias("action"), F.concat(F.lit("r"), (F.col("review_id") % 5).cast("string")).alias("reviewer"))
    return reports.receipts(rows.where("review_id % 4 <> 0"), decided, ["review_id"], ["document", "status"]).withColumn("receipt_id", F.upper("receipt_id"))


@query(with_sql("stages") + "SELECT stage, status, count(*) AS findings, CASE status WHEN 'PASS' THEN 0 WHEN 'HUMAN_REVIEW' THEN 3 ELSE 2 END AS exit_code FROM stages GROUP BY ALL")
def stage_reports(spark: SparkSession, folder: str) -> DataFrame:
    """B2: stages by status, with the exit code of each."""
    return reports.stage_reports(derived.stages(spark, folder), ["stage"])


@query(with_sql("stages") + ", w AS (SELECT run, stage, status, CASE WHEN run % 3 = 0 THEN event_id::VARCHAR ELSE 'same' END AS digest FROM stages) SELECT run, coalesce(count(DISTINCT stage) FILTER (stage IN ('view', 'click')) = 2 AND bool_and(status = 'PASS') FILTER (stage IN ('view', 'click')) AND count(DISTINCT digest) FILTER (stage IN ('view', 'click')) = 1, false) AS reusable FROM w GROUP BY run")
def cached_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Runs whose passed stages may be used again."""
    runs = derived.stages(spark, folder).withColumn("digest", F.when(F.col("run") % 3 == 0, F.col("event_id").cast("string")).otherwise("same"))
    return reports.cached_evidence(runs, ("view", "click"), "run")


@query(with_sql("stages") + ", d AS (SELECT run, stage, event_id, event_id - lag(event_id) OVER (PARTITION BY run ORDER BY event_id) AS waited FROM stages) SELECT run, count(*) AS stages, max(waited) AS longest_wait FROM d GROUP BY run")
def stage_waits(spark: SparkSession, folder: str) -> DataFrame:
    """What lies between a run's stages."""
    from pyspark.sql import Window

    rows = derived.stages(spark, folder).withColumn("waited", F.col("event_id") - F.lag("event_id").over(Window.partitionBy("run").orderBy("event_id")))
    return rows.groupBy("run").agg(F.count("*").alias("stages"), F.max("waited").alias("longest_wait"))


_PAGES = "pages AS (SELECT document, page, abs(max(ordinal) - 40) / 100.0 AS difference FROM items WHERE page IS NOT NULL GROUP BY ALL)"


@query(with_sql("items") + f", {_PAGES}, h AS (SELECT document, count(*) AS n, max(page) AS hi, min(page) AS lo, max(difference) AS worst FROM pages GROUP BY document), j AS (SELECT document, pages, n, hi, lo, worst FROM (SELECT document, page_count AS pages FROM source_document) FULL JOIN h USING (document)) SELECT document, " + _codes(("PAGES_UNDECLARED", "pages IS NULL"), ("PAGES_MISSING", "coalesce(n, 0) < pages"), ("PAGES_EXTRA", "hi > pages OR lo < 1"), ("DIFFERENCE_TOO_LARGE", "worst > 0.12")) + " FROM j")
def render_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Renderings by the completeness of their pages and the largest difference."""
    pages = _items(spark, folder).where("page IS NOT NULL").groupBy("document", "page").agg((F.abs(F.max("ordinal") - 40) / 100.0).alias("difference"))
    return reports.render_evidence(pages, table(spark, folder, "source_document", "document", "page_count").withColumnRenamed("page_count", "pages"), "document", 0.12)


@query(with_sql("items", "headings") + ", t AS (SELECT document, ordinal, title, try_cast(split_part(title, '.', 1) AS INTEGER) AS number FROM headings), b AS (SELECT *, lag(number) OVER (PARTITION BY document ORDER BY ordinal) AS before FROM t), s AS (SELECT document, count(*) AS n, count(DISTINCT title) AS d, count(*) FILTER (before > number) AS back, count(*) FILTER (contains(title, 'XX') OR contains(title, 'TBD')) AS open, max(length(title)) AS long FROM b GROUP BY document) SELECT document, " + _codes(("TITLES_MISSING", "coalesce(n, 0) < 2"), ("TITLE_TWICE", "d < n"), ("TITLES_OUT_OF_ORDER", "back > 0"), ("PLACEHOLDER_LEFT", "open > 0"), ("TITLE_TOO_LONG", "long > 24")) + " FROM source_document LEFT JOIN s USING (document)")
def document_structure(spark: SparkSession, folder: str) -> DataFrame:
    """Outlines of documents."""
    titles = derived.headings(_items(spark, folder)).withColumn("number", F.try_to_number(F.substring_index("title", ".", 1), F.lit("99")).cast("int"))
    expected = table(spark, folder, "source_document", "document").withColumn("least", F.lit(2))
    return reports.structure_report(titles, expected, "document", F.col("title").contains("XX") | F.col("title").contains("TBD"), 24)


# ---- templates ---------------------------------------------------------------------------------------------------

_SLOTS = ", material AS (SELECT document, source_id, kind, 'slot-' || (ordinal % 4) AS slot_id, ordinal FROM items WHERE kind IN ('text', 'table', 'image')), slots AS (SELECT document, 'slot-' || k AS slot_id, k = 0 AS required, 2 AS min_items, 30 AS max_items FROM source_document, (SELECT unnest([0, 1, 2]) AS k))"


def _slots(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    material = _items(spark, folder).where("kind IN ('text', 'table', 'image')").select("document", "source_id", "kind", F.concat(F.lit("slot-"), (F.col("ordinal") % 4).cast("string")).alias("slot_id"), "ordinal")
    slots = table(spark, folder, "source_document", "document").select("document", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"))
    return material, slots.select("document", F.concat(F.lit("slot-"), F.col("k").cast("string")).alias("slot_id"), (F.col("k") == 0).alias("required"), F.lit(2).alias("min_items"), F.lit(30).alias("max_items"), F.lit("any").alias("kind"), F.array(F.lit("text"), F.lit("table")).alias("accepts"))


_BAD_SLOTS = """, h AS (SELECT document, slot_id, count(*) AS items FROM material GROUP BY ALL), b AS (SELECT document, slot_id, coalesce(items, 0) AS items, CASE WHEN required IS NULL THEN 'UNKNOWN_SLOT' WHEN required AND coalesce(items, 0) = 0 THEN 'REQUIRED_SLOT_EMPTY' WHEN items > max_items THEN 'TOO_MANY_ITEMS' WHEN items > 0 AND items < min_items THEN 'TOO_FEW_ITEMS' END AS code FROM slots FULL JOIN h USING (document, slot_id))"""


@query(with_sql("items") + _SLOTS + _BAD_SLOTS + " SELECT document, slot_id, items, code FROM b WHERE code IS NOT NULL")
def slot_material(spark: SparkSession, folder: str) -> DataFrame:
    """M7: slots by what they need and what is there."""
    return templates.slot_findings(*_slots(spark, folder), "document")


@query(with_sql("items") + _SLOTS + _BAD_SLOTS + " SELECT m.document, m.slot_id, row_number() OVER (PARTITION BY m.document, m.slot_id ORDER BY m.ordinal, m.source_id) AS position, m.source_id, CASE m.kind WHEN 'text' THEN 'insert_text' WHEN 'table' THEN 'insert_table' END AS op FROM material m JOIN b ON b.document = m.document AND b.slot_id = m.slot_id AND b.code IS NULL")
def filled_slots(spark: SparkSession, folder: str) -> DataFrame:
    """M7: the program that places the material of sound slots."""
    return templates.filled_slots(*_slots(spark, folder), "document", ["ordinal", "source_id"])


@query("WITH p AS (SELECT document, CASE WHEN page_count % 2 = 0 THEN 'released' ELSE 'draft' END AS lifecycle, CASE WHEN page_count % 3 = 0 THEN 'REJECTED' ELSE 'APPROVED' END AS a, CASE WHEN page_count % 5 = 0 THEN 'FAIL' ELSE 'PASS' END AS v, page_count % 7 AS o FROM source_document) SELECT document FROM p WHERE lifecycle = 'released' AND a = 'APPROVED' AND v = 'PASS' AND coalesce(o % 2, 0) = 0")
def released_packs(spark: SparkSession, folder: str) -> DataFrame:
    """Packs that may be used."""
    n = F.col("page_count")
    rows = table(spark, folder, "source_document", "document", "page_count").select("document", F.when(n % 2 == 0, "released").otherwise("draft").alias("lifecycle"), F.when(n % 3 == 0, "REJECTED").otherwise("APPROVED").alias("approval_status"), F.when(n % 5 == 0, "FAIL").otherwise("PASS").alias("validation_status"), (n % 7 % 2).alias("open_findings"))
    return templates.released(rows).select("document")


_OPS = "['retain_part', 'bind_slot', 'insert_text', 'launch', NULL, 'page_break', 'repeat_block']"


@query(f"WITH o AS (SELECT document, ordinal, ({_OPS})[(ordinal % 7 + 1)::INT] AS op, CASE WHEN ordinal % 11 = 0 THEN 'Script' ELSE 'slot' END AS k FROM (SELECT document, ordinal FROM inventory_item WHERE ordinal IS NOT NULL)) SELECT document, ordinal, 'UNKNOWN_OPERATION' AS code FROM o WHERE op IS NULL OR op = 'launch' UNION ALL SELECT document, ordinal, 'FORBIDDEN_KEY' FROM o WHERE k = 'Script'")
def program_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    """M6: programs by the operations and keys they may use."""
    ops = F.array(*(F.lit(x) for x in ("retain_part", "bind_slot", "insert_text", "launch", None, "page_break", "repeat_block")))
    rows = table(spark, folder, "inventory_item", "document", "ordinal").where("ordinal IS NOT NULL")
    rows = rows.select("document", "ordinal", F.element_at(ops, (F.col("ordinal") % 7 + 1).cast("int")).alias("op"), F.create_map(F.when(F.col("ordinal") % 11 == 0, "Script").otherwise("slot"), F.lit("x")).alias("args"))
    return templates.program_findings(rows, ["document"])


@query("WITH c AS (SELECT document AS reference, file_name, family || '/' || lang AS route FROM source_document WHERE page_count >= 5), r AS (SELECT document AS request, CASE WHEN page_count % 3 = 0 THEN file_name END AS file_name, CASE WHEN page_count % 2 = 0 THEN family || '/' || lang END AS route FROM source_document), f AS (SELECT file_name, count(*) AS n, min(reference) AS one FROM c WHERE file_name IS NOT NULL GROUP BY 1), g AS (SELECT route, count(*) AS n, min(reference) AS one FROM c WHERE route IS NOT NULL GROUP BY 1), x AS (SELECT request, CASE WHEN r.file_name IS NOT NULL THEN 'file_name' WHEN r.route IS NOT NULL THEN 'route' END AS via, CASE WHEN r.file_name IS NOT NULL THEN CASE WHEN f.n = 1 THEN f.one END WHEN r.route IS NOT NULL AND g.n = 1 THEN g.one END AS reference FROM r LEFT JOIN f ON f.file_name = r.file_name LEFT JOIN g ON g.route = r.route) SELECT request, via, reference, CASE WHEN reference IS NULL THEN 'HUMAN_REVIEW' ELSE 'RESOLVED' END AS status FROM x")
def resolved_templates(spark: SparkSession, folder: str) -> DataFrame:
    """M9: a template by its name, else by its route, if only one fits."""
    rows = table(spark, folder, "source_document", "document", "file_name", "family", "lang", "page_count").withColumn("route", F.concat("family", F.lit("/"), "lang"))
    catalog = rows.where("page_count >= 5").withColumnRenamed("document", "reference")
    asked = rows.select(F.col("document").alias("request"), F.when(F.col("page_count") % 3 == 0, F.col("file_name")).alias("file_name"), F.when(F.col("page_count") % 2 == 0, F.col("route")).alias("route"))
    return templates.resolved(asked, catalog, "request", ["file_name", "route"])


@query(with_sql("items") + "SELECT document, source_id, row_number() OVER (PARTITION BY document ORDER BY part NULLS FIRST, ordinal, source_id) AS new_id FROM items WHERE kind IN ('image', 'shape_description')")
def renumbered_drawings(spark: SparkSession, folder: str) -> DataFrame:
    """Running numbers of drawings over all parts of a package."""
    return templates.renumbered(_items(spark, folder).where("kind IN ('image', 'shape_description')"), "document", ["part", "ordinal", "source_id"]).select("document", "source_id", "new_id")


@query("WITH d AS (SELECT document, family, lang, sha256(coalesce(family, '')) AS h FROM source_document) SELECT document, CASE WHEN lang IS NULL THEN 'PACK_MISSING' WHEN lang = 'en' THEN 'PLAN_HASH_STALE' END AS code FROM d WHERE lang IS NULL OR lang = 'en'")
def compiler_bindings(spark: SparkSession, folder: str) -> DataFrame:
    """Whether plan and pack are those that a program was compiled for."""
    rows = table(spark, folder, "source_document", "document", "family", "lang")
    digest = text.sha256_hex(F.coalesce("family", F.lit("")))
    rows = rows.select("document", F.col("lang").alias("pack"), digest.alias("plan"), F.when(F.col("lang") == "en", "old").otherwise(digest).alias("compiled_for"))
    return reports.coded(rows, ["document"], {"PACK_MISSING": F.col("pack").isNull(), "PLAN_HASH_STALE": F.col("pack").isNotNull() & ~F.col("plan").eqNullSafe(F.col("compiled_for"))})


# ---- packages ----------------------------------------------------------------------------------------------------


def _made(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content): a file for each document, of its detected format, some of them broken, as a scan would give them."""
    ship_code(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = []
            for row in batch.to_pylist():
                form, n = row["detected_format"], row["page_count"] or 0
                if form in ("docx", "pptx"):
                    members = writers.office_members(form, [row["file_name"] or ""])
                    if n % 5 == 1:
                        members.pop("[Content_Types].xml")
                    elif n % 5 == 2:
                        members["_rels/.rels"] = members["_rels/.rels"].replace(b"officeDocument\"", b"other\"")
                    data = writers.canonical_zip(members)
                elif form == "pdf":
                    data = writers.pdf_bytes([["page"]])
                    data = data.replace(b"%%EOF", b"") if n % 5 == 1 else data.replace(b"/Catalog", b"/Catalog /Encrypt 9 0 R") if n % 5 == 2 else data
                else:
                    data = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" if n % 5 == 1 else b"plain"
                files.append(data)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(files, pa.binary())], names=["path", "content"])

    rows = table(spark, folder, "source_document", "document", "detected_format", "page_count", "file_name")
    return rows.select(F.col("document").alias("path"), "detected_format", "page_count", "file_name").mapInArrow(run, "path string, content binary")


@query("SELECT document, CASE WHEN detected_format IN ('docx', 'pptx') THEN 'ooxml' WHEN detected_format = 'pdf' THEN 'pdf' WHEN n = 1 THEN 'ole' ELSE 'unknown' END AS container, CASE WHEN detected_format IN ('docx', 'pptx', 'pdf') AND n NOT IN (1, 2) THEN detected_format END AS format, CASE WHEN detected_format IN ('docx', 'pptx') THEN CASE n WHEN 1 THEN 'OOXML_CONTENT_TYPES_MISSING' WHEN 2 THEN 'OOXML_ROOT_RELATIONSHIP_INVALID' ELSE '' END WHEN detected_format = 'pdf' THEN CASE n WHEN 1 THEN 'PDF_CONTAINER_CORRUPT' WHEN 2 THEN 'ENCRYPTED_DOCUMENT' ELSE '' END WHEN n = 1 THEN 'OLE_CONTAINER_CORRUPT' ELSE 'UNKNOWN_FORMAT' END AS finding FROM (SELECT document, detected_format, coalesce(page_count, 0) % 5 AS n FROM source_document)")
def package_probes(spark: SparkSession, folder: str) -> DataFrame:
    """A1, A2, A3, A5: formats and findings by the contents of files."""
    return packages.probed(_made(spark, folder)).select(F.col("path").alias("document"), "container", F.col("detected_format").alias("format"), F.coalesce("code", F.lit("")).alias("finding"))


_ROUND = f"SELECT item_id, CASE WHEN payload.type = 'table' THEN 'table' ELSE 'text' END AS kind, CASE WHEN payload.type = 'table' THEN len(payload.rows)::VARCHAR ELSE upper(sha256({_norm('payload.text')})) END AS content FROM typed_item WHERE (payload.type = 'text' AND {_norm('payload.text')} <> '') OR (payload.type = 'table' AND len(payload.rows) > 0)"


@query(_ROUND)
def package_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Items written as canonical documents and read again."""
    ship_code(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = [writers.canonical_zip(writers.office_members("docx", [row["text"] if row["text"] is not None else [[c or "" for c in r or []] for r in row["rows"]]])) for row in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(files, pa.binary())], names=["path", "content"])

    rows = table(spark, folder, "typed_item", "item_id", "payload").where("(payload.type = 'text' AND payload.text IS NOT NULL) OR (payload.type = 'table' AND size(payload.rows) > 0)")
    made = rows.select(F.col("item_id").cast("string").alias("path"), F.when(F.col("payload.type") == "text", F.col("payload.text")).alias("text"), F.col("payload.rows").alias("rows")).mapInArrow(run, "path string, content binary")
    read = packages.package_items(made)
    content = F.when(F.col("kind") == "table", F.size("rows").cast("string")).otherwise(F.upper(F.sha2(text.normalize_text(F.col("text")), 256)))
    return read.select(F.col("path").cast("bigint").alias("item_id"), "kind", content.alias("content"))


@query(f"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE regexp_full_match(text, '[ -~\\n]*')) SELECT doc_id, count(*) AS lines, upper(sha256(string_agg({_norm('line')}, '|' ORDER BY n))) AS digest FROM l WHERE trim(line) <> '' GROUP BY doc_id")
def pdf_page_lines(spark: SparkSession, folder: str) -> DataFrame:
    """A10, A5: texts in plain Latin written as PDF pages and read again by the PDF reader."""
    ship_code(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = [pdf.page_lines(writers.pdf_bytes([t.split("\n")])) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[line for page in pages for line in page] for pages in read], pa.list_(pa.string()))], names=["doc_id", "lines"])

    rows = table(spark, folder, "documents", "doc_id", "text").where(F.col("text").rlike(r"\A[ -~\n]*[!-~][ -~\n]*\z"))
    lines = rows.mapInArrow(run, "doc_id bigint, lines array<string>")
    return lines.select("doc_id", F.size("lines").cast("bigint").alias("lines"), F.upper(F.sha2(F.array_join(F.transform("lines", text.normalize_text), "|"), 256)).alias("digest"))


# ---- functions ---------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, round(max(l_quantity * (l_partkey % 7 + 1) / 10.0 * 3 / 4), 6) AS width, round(min(sqrt(pow(l_discount * 10, 2) + pow(l_tax * 10, 2))), 6) AS height FROM lineitem GROUP BY ALL")
def scaled_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes within nested groups, and extents under two maps."""
    rows = table(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_tax")
    group = lambda ext, chext: F.struct(ext.cast("double").alias("ext"), F.lit(chext).cast("double").alias("chext"))
    width = geometry.group_scaled(F.col("l_quantity"), F.array(group(F.col("l_partkey") % 7 + 1, 10), group(F.lit(3), 4), group(F.lit(5), 0)))
    zero, one = F.lit(0.0), F.lit(1.0)
    turned = geometry.after(geometry.matrix(one, zero, F.col("l_discount"), F.col("l_tax"), zero, zero), geometry.matrix(F.lit(10.0), zero, zero, F.lit(10.0), one, one))
    return rows.groupBy("l_orderkey", "l_linenumber").agg(F.round(F.max(width), 6).alias("width"), F.round(F.min(geometry.extent(turned)["height"]), 6).alias("height"))


@query("SELECT document, strftime(uploaded_at, '%Y-%m-%dT%H:%M:%SZ') AS uploaded, page_count % 2 = 0 AND page_count IS NOT NULL AS strict FROM source_document")
def iso_times(spark: SparkSession, folder: str) -> DataFrame:
    """2.10: times as texts, and which texts are strict date-times."""
    rows = table(spark, folder, "source_document", "document", "uploaded_at", "page_count")
    iso = dates.iso_utc(F.col("uploaded_at"))
    shown = F.when(F.col("page_count") % 2 == 0, iso).when(F.col("page_count") % 3 == 0, F.lit("2024-02-30T00:00:00Z")).otherwise(F.regexp_replace(iso, "Z$", ""))
    return rows.select("document", iso.alias("uploaded"), dates.is_date_time(shown).alias("strict"))


@query("SELECT item_id, json_extract_string(payload.value_json, '$.f0') AS f0, json_extract_string(payload.value_json, '$.f1') AS f1 FROM typed_item WHERE payload.type = 'generic'")
def json_values(spark: SparkSession, folder: str) -> DataFrame:
    """2.10: values of JSON texts by pointer."""
    rows = table(spark, folder, "typed_item", "item_id", "payload").where("payload.type = 'generic'")
    return rows.select("item_id", *(text.json_pointer(F.col("payload.value_json"), f"/f{n}").alias(f"f{n}") for n in (0, 1)))


@query("SELECT row_id, upper(sha256(nfc_normalize(text))) AS digest FROM inventory_item WHERE kind = 'text' AND text IS NOT NULL")
def nfc_digests(spark: SparkSession, folder: str) -> DataFrame:
    """2.10: texts in composed form."""
    ship_code(spark)
    rows = table(spark, folder, "inventory_item", "row_id", "kind", "text").where("kind = 'text' AND text IS NOT NULL")
    return rows.select("row_id", F.upper(F.sha2(text.composed(F.col("text")), 256)).alias("digest"))


@query("WITH t AS (SELECT row_id, unnest(rows) AS r, generate_subscripts(rows, 1) AS n FROM inventory_item WHERE kind = 'table' AND rows IS NOT NULL), c AS (SELECT row_id, n, len(r) AS width, coalesce(list_max(list_filter(generate_series(1, len(r)), lambda k: coalesce(trim(r[k]), '') <> '')), 0) AS last FROM t WHERE r IS NOT NULL) SELECT row_id, n::INTEGER AS row, (CASE WHEN last = 0 THEN width ELSE width - last + 1 END)::INTEGER AS span FROM c WHERE width > 0 AND last < width")
def merged_cells(spark: SparkSession, folder: str) -> DataFrame:
    """2.10: rows whose last filled cell spans the empty ones behind it."""
    rows = table(spark, folder, "inventory_item", "row_id", "kind", "rows").where("kind = 'table' AND rows IS NOT NULL")
    return rows.select("row_id", F.posexplode("rows").alias("_n", "_r")).select("row_id", (F.col("_n") + 1).alias("row"), grids.trailing_span(F.col("_r")).alias("span")).where("span IS NOT NULL")


@query("SELECT document, coalesce(nullif(trim(CASE WHEN page_count % 4 = 0 THEN file_name END), ''), nullif(trim(CASE WHEN page_count % 3 = 0 THEN lang END), ''), family) AS binding, CASE WHEN coalesce(trim(CASE WHEN page_count % 4 = 0 THEN file_name END), '') <> '' THEN 'explicit' WHEN coalesce(trim(CASE WHEN page_count % 3 = 0 THEN lang END), '') <> '' THEN 'config' WHEN family IS NOT NULL THEN 'common' END AS origin FROM source_document")
def dependency_choices(spark: SparkSession, folder: str) -> DataFrame:
    """A value from the first origin that has one."""
    n = F.col("page_count")
    rows = table(spark, folder, "source_document", "document", "file_name", "family", "lang", "page_count")
    return rows.select("document", *text.first_of({"explicit": F.when(n % 4 == 0, F.col("file_name")), "config": F.when(n % 3 == 0, F.col("lang")), "common": F.col("family")}, "binding", "origin"))


@query("SELECT item_id, source_id, kind, location, coalesce(payload.text, payload.description, payload.value_json) AS text, len(payload.rows) AS table_rows, upper(payload.sha256) AS sha256 FROM typed_item")
def legacy_items(spark: SparkSession, folder: str) -> DataFrame:
    """C11: typed items flattened to the old columns."""
    rows = table(spark, folder, "typed_item", "item_id", "source_id", "kind", "location", "payload")
    p = F.col("payload")
    return rows.select("item_id", "source_id", "kind", "location", F.coalesce(p["text"], p["description"], p["value_json"]).alias("text"), F.when(p["rows"].isNotNull(), F.size(p["rows"])).alias("table_rows"), F.upper(p["sha256"]).alias("sha256"))


@query(with_sql("items") + """, n AS (SELECT document, source_id, length(coalesce(text, '')) % 5000 AS size, row_number() OVER (PARTITION BY document ORDER BY ordinal, source_id) AS k FROM items),
    r AS (SELECT document, source_id, k, size, 0 AS batch, 1 AS held, size AS chars FROM n WHERE k = 1), w AS (
        WITH RECURSIVE f AS (SELECT * FROM r UNION ALL SELECT n.document, n.source_id, n.k, n.size, CASE WHEN f.held >= 40 OR f.chars + n.size > 16000 THEN f.batch + 1 ELSE f.batch END, CASE WHEN f.held >= 40 OR f.chars + n.size > 16000 THEN 1 ELSE f.held + 1 END, CASE WHEN f.held >= 40 OR f.chars + n.size > 16000 THEN n.size ELSE f.chars + n.size END FROM f JOIN n ON n.document = f.document AND n.k = f.k + 1) SELECT * FROM f)
    SELECT document, source_id, batch FROM w""")
def greedy_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Tasks of at most 40 items and 16 000 characters, by the length of texts."""
    rows = _items(spark, folder).where("document IS NOT NULL").select("document", "ordinal", "source_id", (F.length(F.coalesce("text", F.lit(""))) % 5000).alias("size"))
    packed = bundles.pack(rows, "document", ["ordinal", "source_id"], "size")
    return packed.select("document", "source_id", F.col("batch_index").alias("batch"))
