"""Relations that the test tables don't hold, derived from them in the same way on both sides of a check.

Decisions, stages and the like are inputs from outside. Here they follow from the items themselves: the last hex digit
of an item's id picks what was decided about it. ``SQL`` has the same relations for the other engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.operators.items import first_deliveries
from docweft.sources.tables import table

#: Last digit of a source id to the action decided; E has no decision, D is left unresolved.
ACTIONS = {
    "0": "preserve_exact", "1": "preserve_exact", "2": "preserve_exact", "3": "preserve_exact", "4": "preserve_exact", "5": "preserve_exact", "6": "reviewed_text", "7": "reviewed_text", "8": "redact_identity", "9": "remove_identity",
    "A": "exclude_from_output", "B": "remove_template_background", "C": "preserve_image", "F": "preserve_sanitized_image",
}
_CASE = "CASE right(source_id, 1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ACTIONS.items()) + " END"

SQL = {
    "items": "items AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY document, source_id ORDER BY ordinal NULLS LAST, ingested_at NULLS LAST, row_id) AS n FROM inventory_item WHERE source_id IS NOT NULL) WHERE n = 1)",
    "decisions": f"decisions AS (SELECT document, source_id, {_CASE} AS action, CASE WHEN ordinal % 11 = 0 THEN NULL ELSE (ordinal % 10) / 10.0 + 0.15 END AS confidence, 'slot-' || (ordinal % 7) AS target_slot, ordinal AS target_order FROM items WHERE right(source_id, 1) NOT IN ('D', 'E') UNION ALL SELECT document, 'GHOST-' || source_id, 'preserve_exact', 0.9, 'slot-0', ordinal FROM items WHERE right(source_id, 2) = '00')",
    "unresolved": "unresolved AS (SELECT document, source_id FROM items WHERE right(source_id, 1) = 'D' OR right(source_id, 2) = '10')",
    "stages": "stages AS (SELECT user_id AS run, event_type AS stage, CASE event_type WHEN 'view' THEN 'PASS' WHEN 'click' THEN 'PASS' WHEN 'purchase' THEN 'HUMAN_REVIEW' WHEN 'signup' THEN 'BLOCKED' ELSE 'ODD' END AS status, value AS duration_ms, CASE event_id % 5 WHEN 0 THEN 'HIT' WHEN 1 THEN 'MISS' WHEN 2 THEN 'CORRUPT' WHEN 3 THEN 'BYPASS' END AS cache_status, event_id FROM events)",
    "reviews": "reviews AS (SELECT document, review_id, CASE review_id % 7 WHEN 0 THEN 'REJECT' WHEN 1 THEN 'REQUEST_REVISION' WHEN 2 THEN 'CONFIRM_FACT' ELSE 'APPROVE' END AS action FROM identity_review WHERE document IS NOT NULL)",
    "headings": r"headings AS (SELECT document, ordinal, text AS title FROM items WHERE kind = 'text' AND regexp_matches(text, '^[0-9]{1,2}\.[0-9]{1,2} '))",
}


def with_sql(*names: str) -> str:
    return "WITH " + ", ".join(SQL[n] for n in names) + " "


def items(spark: SparkSession, folder: str) -> DataFrame:
    return first_deliveries(table(spark, folder, "inventory_item"))


def decisions(rows: DataFrame) -> DataFrame:
    actions = F.create_map(*(F.lit(x) for pair in ACTIONS.items() for x in pair))
    given = rows.where(~F.right("source_id", F.lit(1)).isin("D", "E")).select(
        "document", "source_id", actions[F.right("source_id", F.lit(1))].alias("action"), F.when(F.col("ordinal") % 11 != 0, F.col("ordinal") % 10 / 10.0 + 0.15).alias("confidence"),
        F.concat(F.lit("slot-"), (F.col("ordinal") % 7).cast("string")).alias("target_slot"), F.col("ordinal").alias("target_order"),
    )
    ghosts = rows.where(F.right("source_id", F.lit(2)) == "00").select("document", F.concat(F.lit("GHOST-"), "source_id").alias("source_id"), F.lit("preserve_exact").alias("action"), F.lit(0.9).alias("confidence"), F.lit("slot-0").alias("target_slot"), F.col("ordinal").alias("target_order"))
    return given.unionByName(ghosts)


def unresolved(rows: DataFrame) -> DataFrame:
    return rows.where((F.right("source_id", F.lit(1)) == "D") | (F.right("source_id", F.lit(2)) == "10")).select("document", "source_id")


def stages(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events", "event_id", "user_id", "event_type", "value")
    status = F.when(F.col("event_type").isin("view", "click"), "PASS").when(F.col("event_type") == "purchase", "HUMAN_REVIEW").when(F.col("event_type") == "signup", "BLOCKED").otherwise("ODD")
    cache = F.element_at(F.array(*map(F.lit, ("HIT", "MISS", "CORRUPT", "BYPASS")), F.lit(None)), (F.col("event_id") % 5 + 1).cast("int"))
    return e.select(F.col("user_id").alias("run"), F.col("event_type").alias("stage"), status.alias("status"), F.col("value").alias("duration_ms"), cache.alias("cache_status"), "event_id")


def reviews(spark: SparkSession, folder: str) -> DataFrame:
    action = F.when(F.col("review_id") % 7 == 0, "REJECT").when(F.col("review_id") % 7 == 1, "REQUEST_REVISION").when(F.col("review_id") % 7 == 2, "CONFIRM_FACT").otherwise("APPROVE")
    return table(spark, folder, "identity_review", "document", "review_id").where("document IS NOT NULL").select("document", "review_id", action.alias("action"))


def headings(rows: DataFrame) -> DataFrame:
    return rows.where((F.col("kind") == "text") & F.col("text").rlike(r"^[0-9]{1,2}\.[0-9]{1,2} ")).select("document", "ordinal", F.col("text").alias("title"))
