"""Writers: JSON documents, batches by folder, evidence by digest, packs that must not exist yet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweft.functions.text import sha256_hex


def write_json(df: DataFrame, folder: str) -> None:
    """One JSON object a line; nulls are kept, so that every row has all fields."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(folder)


def write_batches(df: DataFrame, folder: str) -> None:
    """Bundles by batch: a reader takes one batch's folder. Rows of a batch meet in one file first."""
    df.repartition("batch_index").write.mode("overwrite").partitionBy("batch_index").json(folder)


def write_evidence(df: DataFrame, folder: str, content: str) -> None:
    """Snapshots keyed by their digest: the same content is written once, however often it is cited."""
    df.select(sha256_hex(F.col(content)).alias("sha256"), F.col(content).alias("content")).dropDuplicates(["sha256"]).write.mode("append").parquet(folder)


def register(df: DataFrame, folder: str) -> None:
    """Publishes under a new name; an existing one is an error, never replaced."""
    df.write.mode("errorifexists").parquet(folder)
