"""A content-addressed result table: keys, lookups and publication, manifest last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweft.functions.text import canonical_json, sha256_hex


def cache_key(stage: str, inputs: dict[str, Column]) -> Column:
    """SHA-256 of the canonical JSON of the stage and its input digests; the order of inputs doesn't matter."""
    return sha256_hex(canonical_json({"stage": F.lit(stage)} | {f"in_{k}": v for k, v in inputs.items()}))


def lookup(wanted: DataFrame, manifest: DataFrame, members: DataFrame) -> DataFrame:
    """(key, cache_status): HIT if all of an entry's members are there with their digests, CORRUPT if not, else MISS."""
    have = members.select("key", "member", F.col("sha256").alias("_have"))
    checked = manifest.select("key", "member", "sha256").join(have, ["key", "member"], "left").groupBy("key").agg(F.every(F.col("sha256").eqNullSafe(F.col("_have"))).alias("_whole"))
    return wanted.select("key").distinct().join(checked, "key", "left").select("key", F.when(F.col("_whole").isNull(), "MISS").when(F.col("_whole"), "HIT").otherwise("CORRUPT").alias("cache_status"))


def publish(results: DataFrame, manifest: DataFrame, folder: str) -> None:
    """Writes members first and the manifest last, so that a reader never sees an entry without its members."""
    results.write.mode("append").partitionBy("stage").parquet(f"{folder}/members")
    manifest.write.mode("append").partitionBy("stage").parquet(f"{folder}/manifest")
