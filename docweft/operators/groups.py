"""Groupings, roll-ups, ordinals and neighbour logic."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Statuses from the worst.
STATUSES = ("BLOCKED", "FAIL", "HUMAN_REVIEW", "PASS")


def id_lists(items: DataFrame, by: list[str], categories: dict[str, str], order: str = "ordinal", key: str = "source_id") -> DataFrame:
    """(*by, one sorted id list for each category): conditional collections in one aggregation."""
    lists = [F.transform(F.array_sort(F.collect_list(F.when(F.expr(condition), F.struct(order, key)))), lambda x: x[key]).alias(name) for name, condition in categories.items()]
    return items.groupBy(*by).agg(*lists)


def densified(counts: DataFrame, declared: DataFrame, by: str, number: str, last: str, values: list[str]) -> DataFrame:
    """Rows for every number from 1 to a document's declared last one; values of numbers without rows are 0."""
    every = declared.where(F.col(last) >= 1).select(by, F.explode(F.sequence(F.lit(1), F.col(last))).alias(number))
    return every.join(counts, [by, number], "left").select(by, number, *(F.coalesce(v, F.lit(0)).alias(v) for v in values))


def sequence_findings(pages: DataFrame, declared: DataFrame, by: str, number: str, last: str) -> DataFrame:
    """(by, number, code): MISSING numbers of 1..last, EXTRA ones outside of it, DUPLICATE ones."""
    have = pages.where(F.col(number).isNotNull()).groupBy(by, number).agg(F.count("*").alias("n"))
    every = declared.where(F.col(last) >= 1).select(by, F.explode(F.sequence(F.lit(1), F.col(last))).alias(number))
    missing = every.join(have, [by, number], "left_anti").select(by, number, F.lit("MISSING").alias("code"))
    extra = have.join(declared.select(by, last), by).where((F.col(number) < 1) | (F.col(number) > F.col(last))).select(by, number, F.lit("EXTRA").alias("code"))
    return missing.unionByName(extra).unionByName(have.where("n > 1").select(by, number, F.lit("DUPLICATE").alias("code")))


def gaps(pages: DataFrame, by: str, number: str) -> DataFrame:
    """(by, after, before): neighbouring numbers with others missing between them."""
    order = Window.partitionBy(by).orderBy(number)
    seen = pages.where(F.col(number).isNotNull()).select(by, number).distinct().withColumn("before", F.lead(number).over(order))
    return seen.where(F.col("before") > F.col(number) + 1).select(by, F.col(number).alias("after"), "before")


def status_rollup(stages: DataFrame, by: list[str], status: str = "status", universe: DataFrame | None = None) -> DataFrame:
    """(*by, status): the worst status; an unknown one, and a member of ``universe`` without any, is FAIL."""
    rank = F.coalesce(*(F.when(F.col(status) == s, i) for i, s in enumerate(STATUSES)), F.lit(STATUSES.index("FAIL")))
    worst = stages.groupBy(*by).agg(F.min(rank).alias("_r"))
    if universe is not None:
        worst = universe.select(*by).distinct().join(worst, by, "left")
    return worst.select(*by, F.element_at(F.array(*map(F.lit, STATUSES)), F.coalesce("_r", F.lit(1)) + 1).alias("status"))


def verdict(findings: DataFrame, by: list[str], universe: DataFrame) -> DataFrame:
    """(*by, verdict): FAIL with any failing finding, else HUMAN_REVIEW with any for review, else PASS."""
    counted = findings.groupBy(*by).agg(F.count_if(F.col("severity") == "FAIL").alias("_f"), F.count_if(F.col("severity") == "REVIEW").alias("_r"))
    rows = universe.select(*by).distinct().join(counted, by, "left")
    return rows.select(*by, F.when(F.col("_f") > 0, "FAIL").when(F.col("_r") > 0, "HUMAN_REVIEW").otherwise("PASS").alias("verdict"))


def review_rollup(decisions: DataFrame, by: list[str], action: str = "action") -> DataFrame:
    """(*by, overall): all approved, else any rejected, else any revision requested, else facts pending."""
    a = F.col(action)
    rows = decisions.groupBy(*by).agg(F.coalesce(F.every(a == "APPROVE"), F.lit(False)).alias("_all"), F.coalesce(F.some(a == "REJECT"), F.lit(False)).alias("_no"), F.coalesce(F.some(a == "REQUEST_REVISION"), F.lit(False)).alias("_rev"), F.count_if(a.isNull()).alias("_null"))
    return rows.select(*by, F.when(F.col("_all") & (F.col("_null") == 0), "APPROVED").when(F.col("_no"), "REJECTED").when(F.col("_rev"), "REVISION_REQUESTED").otherwise("FACT_PENDING").alias("overall"))


def telemetry(stages: DataFrame, by: list[str]) -> DataFrame:
    """(*by, stages, duration_ms, hits, lookups, hit_rate): a cache lookup is a HIT, MISS or CORRUPT; 0 without any."""
    c = F.col("cache_status")
    rows = stages.groupBy(*by).agg(F.count("*").alias("stages"), F.round(F.sum("duration_ms"), 3).alias("duration_ms"), F.count_if(c == "HIT").alias("hits"), F.count_if(c.isin("HIT", "MISS", "CORRUPT")).alias("lookups"))
    return rows.withColumn("hit_rate", F.when(F.col("lookups") > 0, F.round(F.col("hits") / F.col("lookups"), 6)).otherwise(F.lit(0.0)))


def ranges_to_next(rows: DataFrame, by: str, order: str) -> DataFrame:
    """Each row with ``until``, the order of the next row of its group; null for the last."""
    return rows.withColumn("until", F.lead(order).over(Window.partitionBy(by).orderBy(order)))


def islands(rows: DataFrame, by: str, order: str, condition: str) -> DataFrame:
    """Rows that fulfil the condition with ``island`` (runs of neighbours, from 1) and ``place`` (row in its run, from 1)."""
    w = Window.partitionBy(by).orderBy(order)
    numbered = rows.withColumn("_a", F.row_number().over(w)).withColumn("_hit", F.expr(condition)).where("_hit")
    numbered = numbered.withColumn("_g", F.col("_a") - F.row_number().over(w))
    numbered = numbered.withColumn("island", F.dense_rank().over(Window.partitionBy(by).orderBy("_g")))
    return numbered.withColumn("place", F.row_number().over(Window.partitionBy(by, "_g").orderBy(order))).drop("_a", "_hit", "_g")


def edges(rows: DataFrame, by: str, order: str) -> DataFrame:
    """Each row with ``is_edge``: whether it is the first or last of its group."""
    w = Window.partitionBy(by)
    return rows.withColumn("is_edge", (F.col(order) == F.min(order).over(w)) | (F.col(order) == F.max(order).over(w)))


def first_of(rows: DataFrame, by: list[str], order: list[str], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each group."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def examples(rows: DataFrame, by: list[str], value: str, order: list[str], limit: int = 5, shown: int = 3) -> DataFrame:
    """(*by, total, shown): up to ``limit`` values listed; of more only the first ``shown``. Only these are collected."""
    total = rows.groupBy(*by).agg(F.count("*").alias("total"))
    few = first_of(rows, by, order, limit).withColumn("_o", F.struct(*order))
    listed = few.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", value))), lambda x: x[value]).alias("_l"))
    return total.join(listed, by).select(*by, "total", F.array_join(F.when(F.col("total") > limit, F.slice("_l", 1, shown)).otherwise(F.col("_l")), "; ").alias("shown"))


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of ``left`` as often as they are more frequent there than in ``right``."""
    return left.exceptAll(right.select(*left.columns))


def ordered_subsequence(expected: DataFrame, actual: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """(by, contained): whether a group's expected values appear in its actual ones in that order, others between.

    Each expected value is searched behind the match before it; the fold holds one position.
    """
    want = expected.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias("_want"))
    have = actual.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias("_have"))
    found = F.aggregate("_have", F.lit(0), lambda at, x: F.when((at < F.size("_want")) & (F.get("_want", at) == x), at + 1).otherwise(at))
    return want.join(have, by, "left").select(by, (F.coalesce(found, F.lit(0)) == F.size("_want")).alias("contained"))
