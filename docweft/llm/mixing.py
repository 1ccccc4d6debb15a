"""Problem 8: a mixture of sources at target shares, by Pareto order sampling.

Every source gets ``goal = total * share`` tokens. Documents that the goal needs several times over get that many
certain whole copies. Of what is left, a document gets one copy more with a probability of its own that grows with
its size, ``p = min(1, rate * size ** POWER)``, at the rate that makes the source's expected tokens the goal; where that
is 1 the copy is certain, too. The other copies go to the documents in the order of Pareto's ranking variable ``q = (u / (1 - u)) / (p / (1 - p))``, with ``u`` uniform from
a hash of key and seed, until the source's tokens are filled: a sample of fixed size (in tokens) and unequal
probabilities. A source holding a third of all rows is never sorted in one task: ``q`` is binned, the bins' token
sums are accumulated, and only the one bin in which a source's goal is reached is ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweft.llm.bpe import count_tokens
from docweft.session import cut_lineage

#: Bins of the ranking variable for each source.
BINS = 4096
#: How a document's probability grows with its size: 0 not at all, 1 in proportion.
POWER = 0.5
#: Sources whose plan is handed to all workers; with more of them it is joined.
BROADCAST_SOURCES = 10_000


def sized(documents: DataFrame, vocabulary: str | None = None, seed: int = 17) -> DataFrame:
    """(doc_id, source, n_tokens, size, u) of each document that has a source and tokens, written once.

    ``size`` are the tokens, rounded to three digits: so few sizes that a table of them stays small for any corpus.
    """
    rows = count_tokens(documents.where(F.col("source").isNotNull() & (F.length("text") > 0)), vocabulary=vocabulary, keep=("source",))
    return cut_lineage(ranked(rows.where("n_tokens > 0"), seed))


def ranked(rows: DataFrame, seed: int) -> DataFrame:
    u = (F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    unit = F.pow(F.lit(10.0), F.greatest(F.length(F.col("n_tokens").cast("string")) - 3, F.lit(0)))
    return rows.withColumn("size", (F.ceil(F.col("n_tokens") / unit) * unit).cast("bigint")).withColumn("u", u)


def goals(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """One row for each target source, written once: what it has, may give and shall give, and the rate of its copies.

    ``total_tokens`` null takes the largest total that all sources with documents can fill at their shares. A larger
    number is honoured as far as ``max_repeats`` allows; the shortfall is then reported, not filled by others.
    """
    # at most some 900 sizes for each power of ten
    classes = cut_lineage(sizes.groupBy("source", "size").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n")))
    have = classes.groupBy("source").agg(F.sum("tokens").alias("available_tokens"), F.sum("n").alias("documents"))
    # one row for each source, however often it is listed
    wanted = targets.where("source IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    rows = wanted.join(have, "source", "left").select(
        "source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(1)).alias("max_repeats"), F.coalesce("available_tokens", F.lit(0)).alias("available_tokens"), F.coalesce("documents", F.lit(0)).alias("documents")
    )
    rows = rows.withColumn("capacity_tokens", F.col("available_tokens") * F.col("max_repeats"))
    feasible = F.min(F.when((F.col("capacity_tokens") > 0) & (F.col("target_share") > 0), F.col("capacity_tokens") / F.col("target_share"))).over(Window.partitionBy(F.lit(0)))  # a row a target source
    total = F.lit(float(total_tokens)) if total_tokens is not None else F.coalesce(feasible, F.lit(0.0))
    rows = rows.withColumn("requested_tokens", F.round(total * F.col("target_share")).cast("bigint")).withColumn("goal", F.least("requested_tokens", "capacity_tokens"))
    rows = rows.withColumn("whole", F.when(F.col("available_tokens") > 0, F.floor(F.col("goal") / F.col("available_tokens"))).otherwise(F.lit(0)).cast("int"))
    rows = rows.withColumn("left", F.col("goal") - F.col("whole") * F.col("available_tokens"))
    # sum(min(1, rate * weight) * tokens) = left: with all sizes above one at 1, that is linear in the rate, and as the
    # capped sum is nowhere above such a line, the largest of the lines' rates is the rate
    by_size = Window.partitionBy("source").orderBy("size")
    lines = classes.join(rows.select("source", "left", "available_tokens"), "source")
    lines = lines.withColumn("above", F.col("available_tokens") - F.sum("tokens").over(by_size)).withColumn("below", F.sum(F.pow("size", F.lit(POWER)) * F.col("tokens")).over(by_size))
    rates = lines.groupBy("source").agg(F.greatest(F.max((F.col("left") - F.col("above")) / F.col("below")), F.lit(0.0)).alias("rate"))
    rows = rows.join(rates, "source", "left")
    certain = classes.join(rows.select("source", "rate"), "source").where(_chance() >= 1).groupBy("source").agg(F.sum("tokens").alias("certain_tokens"))
    rows = rows.join(certain, "source", "left").withColumn("rest", F.col("left") - F.coalesce("certain_tokens", F.lit(0)))
    return cut_lineage(rows.drop("left"))


def _chance() -> Column:
    """A document's probability of one copy more, by its source's rate and its size."""
    chance = F.col("rate") * F.pow("size", F.lit(POWER))
    return F.when(chance >= 1 - 1e-9, F.lit(1.0)).otherwise(chance)


def _shared(plan: DataFrame) -> DataFrame:
    return F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan


def planned(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """``sizes`` of the target sources with each document's certain copies ``whole``, probability ``p`` and rank ``q``."""
    rows = sizes.join(_shared(plan.select("source", "max_repeats", "whole", "rate", "rest")), "source").withColumn("p", _chance())
    rows = rows.withColumn("whole", F.col("whole") + (F.col("p") >= 1).cast("int")).withColumn("p", F.when(F.col("p") < 1, F.col("p")).otherwise(F.lit(0.0)))
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    return rows.withColumn("q", F.when(F.col("p") > 0, odds))


def mixture(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """(doc_id, source, n_tokens, copies, expected_copies) of each document that enters the mixture at least once.

    Documents without a source, with a source that has no target, or without tokens never enter. No document is used
    more than ``max_repeats`` times; ties of ``q`` are broken by key. A source's tokens differ from its goal by less
    than one document.
    """
    return mixed(sizes, goals(sizes, targets, total_tokens))


def mixed(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    rows = planned(sizes, plan)
    # bins are even where they matter: q / (1 + q) spreads the neighbourhood of the cut, q = 1
    rows = rows.withColumn("bin", F.least(F.floor(F.col("q") / (1 + F.col("q")) * BINS), F.lit(BINS - 1)).cast("int"))
    bins = rows.where("bin IS NOT NULL AND rest > 0").groupBy("source", "bin").agg(F.sum("n_tokens").alias("bin_tokens"), F.max("rest").alias("goal_rest"))
    before = F.coalesce(F.sum("bin_tokens").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = bins.withColumn("before", before).where((F.col("before") < F.col("goal_rest")) & (F.col("before") + F.col("bin_tokens") >= F.col("goal_rest")))
    rows = rows.join(_shared(cut_lineage(cut.select("source", F.col("bin").alias("cut_bin"), "before"))), "source", "left")
    running = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("source", "bin").orderBy("q", "doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # in the bin of the cut, a document enters if more than half of it lies below the goal
    last = rows.where("bin = cut_bin").withColumn("extra", (F.col("before") + running + F.col("n_tokens") / 2 <= F.col("rest")).cast("int"))
    # a source whose documents end before its goal has no cut: all that may enter do
    others = rows.where("bin IS NULL OR cut_bin IS NULL OR bin <> cut_bin").withColumn("extra", F.coalesce(F.col("bin") < F.coalesce("cut_bin", F.when(F.col("rest") > 0, F.lit(BINS))), F.lit(False)).cast("int"))
    copies = F.least(F.col("whole") + F.col("extra"), F.col("max_repeats")).cast("int")
    return last.unionByName(others).select("doc_id", "source", "n_tokens", copies.alias("copies"), F.round(F.col("whole") + F.col("p"), 6).alias("expected_copies")).where("copies > 0")


def mixture_report(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """One row for each target source: requested against actual tokens and shares, copies used and what is missing."""
    plan = goals(sizes, targets, total_tokens)
    got = mixed(sizes, plan).groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("actual_tokens"), F.count("*").alias("documents_used"), F.sum("copies").alias("copies_used"), F.sum("expected_copies").alias("expected_copies"), F.max("copies").alias("most_copies"))
    rows = plan.select("source", "target_share", "max_repeats", "documents", "available_tokens", "requested_tokens").join(got, "source", "left")
    total = F.sum("actual_tokens").over(Window.partitionBy(F.lit(0)))
    actual = F.coalesce("actual_tokens", F.lit(0))
    return rows.select(
        "source", "target_share", F.coalesce(F.round(actual / total, 6), F.lit(0.0)).alias("actual_share"), "requested_tokens", actual.alias("actual_tokens"), "available_tokens", "documents",
        *(F.coalesce(c, F.lit(0)).alias(c) for c in ("documents_used", "copies_used", "most_copies")), "max_repeats", F.greatest(F.col("requested_tokens") - actual, F.lit(0)).alias("missing_tokens"),
    )
