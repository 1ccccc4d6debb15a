"""Validation reports: each is one table of findings, from one pass over tagged rows, and its status per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweft.functions.text import sha256_hex

# What is shown of a source, what hides an identity, and what leaves no trace in the output.
CONTENT_ACTIONS = ("preserve_exact", "reviewed_text", "redact_identity", "preserve_image", "preserve_sanitized_image")
IDENTITY_ACTIONS = ("redact_identity", "remove_identity", "preserve_sanitized_image")
HIDDEN_ACTIONS = ("remove_identity", "exclude_from_output", "remove_template_background")
EXIT_CODES = {"PASS": 0, "HUMAN_REVIEW": 3, "FAIL": 2, "BLOCKED": 2}


def coded(rows: DataFrame, keys: list[str], checks: dict[str, Column]) -> DataFrame:
    """(*keys, code): one row for each check that is true; null counts as false."""
    codes = F.filter(F.array(*(F.when(F.coalesce(bad, F.lit(False)), code) for code, bad in checks.items())), lambda c: c.isNotNull())
    return rows.select(*keys, F.explode(codes).alias("code"))


def decision_report(items: DataFrame, decisions: DataFrame, unresolved: DataFrame, keys: list[str], threshold: float = 0.8) -> DataFrame:
    """(*keys, code, severity) of everything that speaks against a set of decisions.

    Items, decisions and unresolved conflicts are tagged and counted per key in one exchange: sources nobody decided,
    decisions on nothing, doubled ones, decisions on open conflicts, open conflicts, and confidences that are missing,
    impossible or low.
    """
    tag = lambda df, name, confidence=None: df.select(*keys, F.lit(name).alias("_from"), (F.lit(None).cast("double") if confidence is None else F.col(confidence)).alias("_c"))
    rows = tag(items, "item").unionByName(tag(decisions, "decision", "confidence")).unionByName(tag(unresolved, "open"))
    decided = F.col("_from") == "decision"
    impossible = decided & (F.col("_c").isNull() | (F.col("_c") < 0) | (F.col("_c") > 1))
    seen = rows.groupBy(*keys).agg(F.count_if(F.col("_from") == "item").alias("i"), F.count_if(decided).alias("d"), F.count_if(F.col("_from") == "open").alias("u"), F.count_if(impossible).alias("bad"), F.count_if(decided & ~impossible & (F.col("_c") < threshold)).alias("low"))
    c = F.col
    checks = {
        "SOURCE_UNDECIDED": (c("i") > 0) & (c("d") == 0) & (c("u") == 0), "SOURCE_UNKNOWN": (c("i") == 0) & (c("d") > 0), "DECIDED_TWICE": c("d") > 1, "DECIDED_AND_UNRESOLVED": (c("d") > 0) & (c("u") > 0), "CONFLICT_OPEN": c("u") > 0, "CONFIDENCE_INVALID": c("bad") > 0, "LOW_CONFIDENCE": c("low") > 0,
    }
    return coded(seen, keys, checks).withColumn("severity", F.when(F.col("code").isin("CONFLICT_OPEN", "LOW_CONFIDENCE"), "REVIEW").otherwise("FAIL"))


def content_map_report(entries: DataFrame, evidence: DataFrame, by: str, actions: tuple[str, ...]) -> DataFrame:
    """(by, source_id, code) of a content map: actions outside of the vocabulary, content without a place, hidden content
    with one, places given twice, and reviewed texts without evidence."""
    keys = [by, "source_id"]
    shown, placed = F.col("action").isin(*CONTENT_ACTIONS), F.col("target_slot").isNotNull()
    checks = {"ACTION_UNKNOWN": ~F.coalesce(F.col("action").isin(*actions), F.lit(False)), "TARGET_MISSING": shown & ~placed, "TARGET_OF_HIDDEN": F.col("action").isin(*HIDDEN_ACTIONS) & placed}
    own = coded(entries, keys, checks)
    twice = entries.where(shown & placed).groupBy(by, "target_slot", "target_order").agg(F.count("*").alias("n")).where("n > 1")
    twice = entries.where(shown).join(twice, [by, "target_slot", "target_order"], "left_semi").select(*keys, F.lit("TARGET_TWICE").alias("code"))
    bare = entries.where("action = 'reviewed_text'").join(evidence.select(*keys).distinct(), keys, "left_anti").select(*keys, F.lit("EVIDENCE_MISSING").alias("code"))
    return own.unionByName(twice).unionByName(bare)


def plan_digest(plan: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """(by, digest): a digest of a group's rows that is the same in any order: the sums of the rows' own digests.

    Sums are added before the exchange, so a group of any size is never collected. They are decimals: a bigint holds those
    of some 65 000 rows only.
    """
    line = sha256_hex(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)))
    part = lambda at: F.sum(F.conv(F.substring(line, at, 12), 16, 10).cast("decimal(18,0)")).cast("string")
    return plan.groupBy(by).agg(F.concat_ws("-", F.count("*").cast("string"), part(1), part(13)).alias("digest"))


def content_plan_report(plan: DataFrame, stated: DataFrame, outputs: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """(by, code, n) of content plans: orders that don't run from 1 without gaps, digests that aren't the stated ones, and
    shown sources that the output lacks. ``plan`` has execution_order, source_id and action."""
    orders = plan.groupBy(by).agg(F.count("*").alias("_n"), F.countDistinct("execution_order").alias("_d"), F.min("execution_order").alias("_lo"), F.max("execution_order").alias("_hi"))
    gaps = coded(orders, [by], {"ORDER_TWICE": F.col("_d") < F.col("_n"), "ORDER_GAP": (F.col("_lo") != 1) | (F.col("_hi") != F.col("_d"))}).withColumn("n", F.lit(1).cast("bigint"))
    digests = plan_digest(plan, by, columns).join(stated.select(by, F.col("digest").alias("_stated")), by, "full_outer")
    wrong = digests.where(~F.col("digest").eqNullSafe(F.col("_stated"))).select(by, F.lit("PLAN_DIGEST_WRONG").alias("code"), F.lit(1).cast("bigint").alias("n"))
    shown = plan.where(F.col("action").isin("preserve_exact", "preserve_image")).select(by, "source_id")
    missing = shown.join(outputs.select(by, "source_id").distinct(), [by, "source_id"], "left_anti").groupBy(by).agg(F.count("*").alias("n")).select(by, F.lit("OUTPUT_MISSING").alias("code"), "n")
    return gaps.unionByName(wrong).unionByName(missing)


def receipt_report(queue: DataFrame, receipt: DataFrame, evidence: DataFrame, keys: list[str], bound: list[str], allowed: tuple[str, ...]) -> DataFrame:
    """(*keys, code) of a receipt: items it doesn't decide, items it doesn't know, actions outside of the allowed ones, one
    code for each bound digest that is stale, and cited evidence that nobody knows."""
    q = queue.select(*keys, *(F.col(b).alias(f"_q_{b}") for b in bound), F.lit(1).alias("_q"))
    rows = q.join(receipt.select(*keys, "action", *bound, F.lit(1).alias("_r")), keys, "full_outer")
    both = F.col("_q").isNotNull() & F.col("_r").isNotNull()
    checks = {"DECISION_MISSING": F.col("_r").isNull(), "DECISION_UNKNOWN_ITEM": F.col("_q").isNull(), "ACTION_INVALID": F.col("_r").isNotNull() & ~F.coalesce(F.col("action").isin(*allowed), F.lit(False))}
    checks |= {f"STALE_{b.upper()}": both & ~F.col(b).eqNullSafe(F.col(f"_q_{b}")) for b in bound}
    cited = receipt.select(*keys, F.explode("evidence_ids").alias("evidence_id")).distinct()
    unknown = cited.join(evidence.select("evidence_id").distinct(), "evidence_id", "left_anti").select(*keys, F.lit("EVIDENCE_UNKNOWN").alias("code")).distinct()
    return coded(rows, keys, checks).unionByName(unknown)


def unproven(candidates: DataFrame, signals: DataFrame, keys: list[str], confidence: float = 0.8) -> DataFrame:
    """(*keys, code) of resolved candidates whose provenance doesn't hold: no signal of the item, none of the kind that
    the action needs, or too low a confidence. ``candidates`` has kind, ``signals`` the types of an item's signals."""
    have = signals.groupBy(*keys).agg(F.collect_set("type").alias("_types"))
    rows = candidates.join(have, keys, "left")
    fits = F.array_contains("_types", F.col("kind"))
    return coded(rows, keys, {"SIGNAL_MISSING": F.col("_types").isNull(), "SIGNAL_OF_OTHER_KIND": F.col("_types").isNotNull() & ~fits, "CONFIDENCE_TOO_LOW": F.coalesce(F.col("confidence"), F.lit(0.0)) < confidence})


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str = "position") -> DataFrame:
    """``rows`` with their place in a group's canonical order, from 1; nulls come first."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def receipts(queue: DataFrame, decisions: DataFrame, keys: list[str], bound: list[str]) -> DataFrame:
    """(*keys, action, reviewer, receipt_id): the decided items of a queue, with an id over what they are bound to."""
    rows = queue.join(decisions, keys)
    bind = F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (*keys, *bound, "action")))
    return rows.select(*keys, "action", "reviewer", F.concat(F.lit("RECEIPT-"), F.substring(sha256_hex(bind), 1, 16)).alias("receipt_id"))


def stage_reports(stages: DataFrame, by: list[str]) -> DataFrame:
    """(*by, status, findings, exit_code): each stage's report as the code that a shell would see."""
    codes = F.create_map(*(F.lit(x) for pair in EXIT_CODES.items() for x in pair))
    return stages.groupBy(*by, "status").agg(F.count("*").alias("findings")).withColumn("exit_code", F.coalesce(F.try_element_at(codes, F.col("status")), F.lit(2)))


def cached_evidence(runs: DataFrame, required: tuple[str, ...], by: str) -> DataFrame:
    """(by, reusable): whether all required stages are there, passed, and agree on one output digest."""
    stages = runs.where(F.col("stage").isin(*required)).groupBy(by).agg(F.countDistinct("stage").alias("_n"), F.every(F.coalesce(F.col("status") == "PASS", F.lit(False))).alias("_pass"), F.min("digest").alias("_lo"), F.max("digest").alias("_hi"), F.count_if(F.col("digest").isNull()).alias("_none"))
    return runs.select(by).distinct().join(stages, by, "left").select(by, F.coalesce((F.col("_n") == len(required)) & F.col("_pass") & (F.col("_lo") == F.col("_hi")) & (F.col("_none") == 0), F.lit(False)).alias("reusable"))


def render_evidence(pages: DataFrame, declared: DataFrame, by: str, limit: float) -> DataFrame:
    """(by, code) of renderings: pages that are missing or not declared, and a largest difference above the limit."""
    have = pages.groupBy(by).agg(F.countDistinct("page").alias("_n"), F.max("page").alias("_hi"), F.min("page").alias("_lo"), F.max("difference").alias("_worst"))
    rows = declared.join(have, by, "full_outer")
    checks = {"PAGES_UNDECLARED": F.col("pages").isNull(), "PAGES_MISSING": F.coalesce("_n", F.lit(0)) < F.col("pages"), "PAGES_EXTRA": (F.col("_hi") > F.col("pages")) | (F.col("_lo") < 1), "DIFFERENCE_TOO_LARGE": F.col("_worst") > limit}
    return coded(rows, [by], checks)


def structure_report(titles: DataFrame, expected: DataFrame, by: str, placeholders: Column, limit: int) -> DataFrame:
    """(by, code) of a document's outline: titles out of order or doubled, missing ones, unfilled placeholders, long titles.

    ``titles`` has ordinal, number and title; ``expected`` the least number of titles for each document."""
    order = Window.partitionBy(by).orderBy("ordinal")
    rows = titles.withColumn("_before", F.lag("number").over(order)).withColumn("_bad", placeholders)
    seen = rows.groupBy(by).agg(F.count("*").alias("_n"), F.countDistinct("title").alias("_d"), F.count_if(F.col("_before") > F.col("number")).alias("_back"), F.count_if("_bad").alias("_open"), F.max(F.length("title")).alias("_long"))
    joined = expected.join(seen, by, "left")
    n = F.coalesce("_n", F.lit(0))
    return coded(joined, [by], {"TITLES_MISSING": n < F.col("least"), "TITLE_TWICE": F.col("_d") < F.col("_n"), "TITLES_OUT_OF_ORDER": F.col("_back") > 0, "PLACEHOLDER_LEFT": F.col("_open") > 0, "TITLE_TOO_LONG": F.col("_long") > limit})
