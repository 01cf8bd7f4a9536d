"""Streams: the same facts as they arrive, by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, at="ts", kind="event_type", value="value", width="5 minutes", late="10 minutes") -> DataFrame:
    """Counts and sums by kind and window of time; rows later than ``late`` are dropped by the watermark."""
    timed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    out = timed.groupBy(F.window(at, width), kind).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("start"), kind, "n", "total")


def follow_tables(spark: SparkSession, path: str, schema) -> DataFrame:
    """Parquet files of a folder as a stream, a few at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(path)
