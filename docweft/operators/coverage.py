"""Relations between items, decisions and evidence: coverage, ownership, merging and migration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def coverage(sources: DataFrame, decisions: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, code): SOURCE_NOT_DECIDED and DECISION_UNKNOWN_SOURCE, by two anti joins on the same partitioning."""
    have, decided = sources.select(*keys).distinct(), decisions.select(*keys).distinct()
    return have.join(decided, keys, "left_anti").withColumn("code", F.lit("SOURCE_NOT_DECIDED")).unionByName(decided.join(have, keys, "left_anti").withColumn("code", F.lit("DECISION_UNKNOWN_SOURCE")))


def duplicates(rows: DataFrame, keys: list[str], code: str) -> DataFrame:
    """(*keys, copies, code) of keys that come more than once."""
    return rows.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1").withColumn("code", F.lit(code))


def conflicts(decisions: DataFrame, unresolved: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are both decided and unresolved."""
    return decisions.select(*keys).intersect(unresolved.select(*keys))


def evidence_findings(references: DataFrame, evidence: DataFrame, scope: list[str], owner: str) -> DataFrame:
    """(*scope, owner, evidence_id, code) of cited evidence that is unknown or belongs to another source.

    Evidence may be listed several times; it is owned by a source if any of its rows names that source.
    """
    cited = references.select(*scope, owner, "evidence_id").distinct()
    owned = evidence.select(*scope, "evidence_id", F.col(owner)).distinct()
    bad = cited.join(owned, [*scope, owner, "evidence_id"], "left_anti")
    known = evidence.select(*scope, "evidence_id").distinct().withColumn("_known", F.lit(True))
    return bad.join(known, [*scope, "evidence_id"], "left").select(*scope, owner, "evidence_id", F.when(F.col("_known"), "EVIDENCE_OF_OTHER_SOURCE").otherwise("EVIDENCE_UNKNOWN").alias("code"))


def plan(decisions: DataFrame, items: DataFrame, keys: list[str], by: list[str], order: list[str]) -> DataFrame:
    """Decisions with their items in execution order (from 1 in each group)."""
    joined = decisions.join(items, keys)
    return joined.withColumn("execution_order", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def subtract_baseline(hits: DataFrame, baseline: DataFrame, part: str, term: str) -> DataFrame:
    """Hits whose (part, term) the baseline doesn't have, case aside."""
    known = baseline.select(F.col(part).alias("_p"), F.lower(F.trim(F.col(term))).alias("_t")).distinct()
    return hits.join(known, (hits[part] == F.col("_p")) & (F.lower(F.trim(hits[term])) == F.col("_t")), "left_anti")


def merge_missing(decisions: DataFrame, additions: DataFrame, keys: list[str]) -> DataFrame:
    """Decisions and those additions that decide something undecided; nothing is overwritten."""
    return decisions.withColumn("origin", F.lit("given")).unionByName(additions.join(decisions.select(*keys).distinct(), keys, "left_anti").withColumn("origin", F.lit("added")))


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows by key: the change's values where there is a change, else the current ones."""
    new = changes.select(*keys, *(F.col(v).alias(f"_new_{v}") for v in values), F.lit(True).alias("_changed"))
    return current.join(new, keys, "full_outer").select(*keys, *(F.when(F.col("_changed"), F.col(f"_new_{v}")).otherwise(F.col(v)).alias(v) for v in values))


def union_fragments(fragments: DataFrame, tasks: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, code) of fragment rows that break the union: decided in several fragments, or outside of their task."""
    twice = fragments.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys, F.lit("DECIDED_TWICE").alias("code"))
    strange = fragments.join(tasks, ["task_id", *keys], "left_anti").select(*keys, F.lit("NOT_IN_TASK").alias("code")).distinct()
    return twice.unionByName(strange)


def matched_by_cardinality(old: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """Old mappings with ``match``: NONE, ONE or SEVERAL items of their key; an item is named only for ONE."""
    found = items.groupBy(key).agg(F.count("*").alias("_n"), F.min("row_id").alias("_one"))
    rows = old.join(found, key, "left")
    return rows.select(*old.columns, F.when(F.col("_n").isNull(), "NONE").when(F.col("_n") == 1, "ONE").otherwise("SEVERAL").alias("match"), F.when(F.col("_n") == 1, F.col("_one")).alias("row_id"))


def unique_resolution(wanted: DataFrame, images: DataFrame, key: str, by: list[str]) -> DataFrame:
    """(key, resolved, by): images found by the first of several digests that has exactly one match."""
    rows = wanted.select(key, *by)
    for column in by:
        single = images.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n"), F.min("row_id").alias(f"_via_{column}")).where("_n = 1").drop("_n")
        rows = rows.join(single, column, "left")
    how = F.coalesce(*(F.when(F.col(f"_via_{c}").isNotNull(), c) for c in by))
    return rows.select(key, F.coalesce(*(F.col(f"_via_{c}") for c in by)).alias("resolved"), how.alias("via"))


def in_section(anchors: DataFrame, headings: DataFrame, by: str, order: str, title: str) -> DataFrame:
    """Anchors with the heading above them: a range join that becomes one union and a running last value."""
    marked = headings.select(by, F.col(order), F.col(title).alias("_title"), F.lit(0).alias("_kind"), *(F.lit(None).cast(anchors.schema[c].dataType).alias(c) for c in anchors.columns if c not in (by, order)))
    rows = anchors.withColumn("_title", F.lit(None).cast("string")).withColumn("_kind", F.lit(1)).unionByName(marked)
    w = Window.partitionBy(by).orderBy(F.col(order), F.col("_kind")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("section", F.last("_title", ignorenulls=True).over(w)).where("_kind = 1").drop("_title", "_kind")
