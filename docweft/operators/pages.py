"""Rendered pages: blank and gappy pages, and the comparison of two renderings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLANK_STDDEV, GAP_RATIO, DIFFERENCE = 1.0, 0.55, 0.12


def page_findings(pages: DataFrame, by: list[str]) -> DataFrame:
    """(*by, page, code): BLANK_PAGE without content and nearly one shade, EDGE_PAGE_BLANK where it is the first or last,
    LARGE_GAP where an inner page's content ends above a share of its height."""
    w = Window.partitionBy(*by)
    blank = (F.col("content_objects") == 0) & (F.col("gray_stddev") <= BLANK_STDDEV)
    edge = (F.col("page") == F.min("page").over(w)) | (F.col("page") == F.max("page").over(w))
    rows = pages.withColumn("_edge", edge)
    code = F.when(blank & F.col("_edge"), "EDGE_PAGE_BLANK").when(blank, "BLANK_PAGE").when(~F.col("_edge") & (F.col("content_bottom_ratio") < GAP_RATIO), "LARGE_GAP")
    return rows.select(*by, "page", code.alias("code")).where("code IS NOT NULL")


def compare_renderings(left: DataFrame, right: DataFrame, by: list[str], metric: str, limit: float = DIFFERENCE) -> DataFrame:
    """(*by, page, difference, code) of pages that one side lacks or whose metric differs by more than the limit."""
    a, b = left.select(*by, "page", F.col(metric).alias("_a"), F.lit(1).alias("_l")), right.select(*by, "page", F.col(metric).alias("_b"), F.lit(1).alias("_r"))
    rows = a.join(b, [*by, "page"], "full_outer").withColumn("difference", F.round(F.abs(F.col("_a") - F.col("_b")), 6))
    code = F.when(F.col("_l").isNull() | F.col("_r").isNull(), "PAGE_MISSING").when(F.col("difference") > limit, "PAGE_DIFFERS")
    return rows.select(*by, "page", "difference", code.alias("code")).where("code IS NOT NULL")


def pixel_statistics(pixels: DataFrame, key: list[str], values: str) -> DataFrame:
    """(*key, gray_mean, gray_stddev) of an array of grey values, by a fold that holds three numbers."""
    v = F.transform(F.col(values), lambda x: x.cast("double"))
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))
    sums = F.aggregate(v, zero, lambda a, x: F.struct((a["s"] + x).alias("s"), (a["q"] + x * x).alias("q")))
    n = F.size(F.col(values))
    rows = pixels.where(n > 0).select(*key, n.alias("_n"), sums.alias("_s"))
    mean = F.col("_s.s") / F.col("_n")
    return rows.select(*key, F.round(mean, 5).alias("gray_mean"), F.round(F.sqrt(F.greatest(F.col("_s.q") / F.col("_n") - mean * mean, F.lit(0.0))), 5).alias("gray_stddev"))
