"""The folder that driver and executors share, for checkpoints and scratch tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or in local mode, where that is unset, a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        base = tempfile.mkdtemp(prefix="folioscope-")
        spark.conf.set("spark.checkpoint.dir", base)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def _width(kind: T.DataType) -> int:
    """Bytes of a value in memory, at a guess."""
    if isinstance(kind, T.StructType):
        return 16 + sum(_width(f.dataType) for f in kind.fields)
    return 8 if isinstance(kind, (T.NumericType, T.BooleanType, T.DatetimeType)) else 32


def written(df: DataFrame) -> DataFrame:
    """The same rows from a table in the shared folder.

    For loops: a checkpoint keeps the planner's guess of the rows' size, which
    joins multiply from round to round, while a table has its files' size.
    Files of ids and places are many times smaller than their rows, so where
    the rows are too large to be sent to every task, joins are told to sort.
    """
    spark, rows = df.sparkSession, Observation()
    path = f"{shared_dir(spark).rstrip('/')}/rows-{uuid.uuid4().hex}"
    df.observe(rows, F.count(F.lit(1)).alias("n")).write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    return out.hint("merge") if rows.get["n"] * _width(df.schema) > SENT_BYTES else out


#: Bytes of a written table's rows, at a guess, that a join may still send to every task.
SENT_BYTES = 10 << 20
