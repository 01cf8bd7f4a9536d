"""Readers of the engine's named tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One named parquet table of a data folder; any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def placed_table(spark: SparkSession, sf_dir: str, name: str, place: str) -> DataFrame:
    """A named table with each row's own place in it, in column ``place``: its file, and its number in the file."""
    return table(spark, sf_dir, name).select("*", F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")).alias(place))
