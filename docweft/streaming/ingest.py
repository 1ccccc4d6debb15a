"""Streaming ingestion of item deliveries (an extension: the batch engine needs none of it)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def deliveries(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def without_redeliveries(stream: DataFrame, lateness: str = "7 days") -> DataFrame:
    """One row for each (document, source_id) within the lateness; the state that older ones need is dropped."""
    return stream.where("document IS NOT NULL AND source_id IS NOT NULL").withWatermark("ingested_at", lateness).dropDuplicatesWithinWatermark(["document", "source_id"])


def arrivals(stream: DataFrame, window: str = "1 day", lateness: str = "7 days") -> DataFrame:
    """(window_start, kind, items, documents) per window of delivery, late rows counted up to the lateness."""
    counted = stream.withWatermark("ingested_at", lateness).groupBy(F.window("ingested_at", window).alias("w"), "kind").agg(F.count("*").alias("items"), F.approx_count_distinct("document").alias("documents"))
    return counted.select(F.col("w.start").alias("window_start"), "kind", "items", "documents")


def write_partitioned(stream: DataFrame, folder: str, checkpoint: str):  # noqa: ANN201
    """Appends to Parquet by kind, exactly once through the checkpoint; ends when all present files are read."""
    return stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).partitionBy("kind").trigger(availableNow=True).start(folder)
