"""Ordered operators: ranks, islands, fills and ranges within a partition.

All take partition columns ``by`` and ordering columns ``order``; add a unique
tie-break to ``order`` where the result must not depend on row order.  Every
operator is one window over one hash partitioning, so a chain of them with the
same ``by`` and ``order`` shares one shuffle and one sort.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.sources.shared import written


def _window(by, order):
    return Window.partitionBy(*by).orderBy(*order)


def dense_sequence(df: DataFrame, by, order, name="seq") -> DataFrame:
    """1, 2, 3, ... in order within each partition."""
    return df.withColumn(name, F.row_number().over(_window(by, order)))


def ranged_sequence(df: DataFrame, by, order, name="seq") -> DataFrame:
    """The same numbers where a partition may hold a great part of all rows.

    Rows are ranged over (by, order); each range numbers its own, and adds what
    the ranges before it hold of the same partition, one row a range and
    partition.  The ranges are kept in the shared folder, as later passes must
    see the same ones.
    """
    ranged = written(df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part", *by).orderBy(*order)
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_part", *by).agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    starts = starts.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], "_before")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)], F.col("_part") == F.col("_p"))
    rows = ranged.withColumn("_at", F.row_number().over(inside)).join(starts, same)
    return rows.withColumn(name, (F.col("_before") + F.col("_at")).cast("long")).select(*df.columns, name)


def first_rows(df: DataFrame, by, order, n: int = 1) -> DataFrame:
    """The first ``n`` rows of each partition: first wins."""
    return df.withColumn("_row", F.row_number().over(_window(by, order))).filter(F.col("_row") <= n).drop("_row")


def islands(df: DataFrame, by, order, same, name="island") -> DataFrame:
    """Numbers runs of adjacent rows that agree in all of ``same``; null equals null, and differs from false."""
    w = _window(by, order)
    differs = F.lit(False)
    for c in same:
        differs = differs | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    starts = F.when(F.lag(F.lit(1)).over(w).isNull() | differs, 1).otherwise(0)
    return df.withColumn("_start", starts).withColumn(name, F.sum("_start").over(w)).drop("_start")


def fold_runs(df: DataFrame, by, order, same, text, name="island", members=None) -> DataFrame:
    """One row for each run of equal rows: its texts joined in order, its first place and its size.

    ``members`` names a column whose values are kept as a list, in order.
    """
    numbered = islands(dense_sequence(df, by, order, "_at"), by, order, same, name)
    item = F.struct("_at", F.coalesce(F.col(text), F.lit("")).alias("text"), *([F.col(members).alias("member")] if members else []))
    out = numbered.groupBy(*by, name, *same).agg(F.min("_at").alias("first_at"), F.count(F.lit(1)).alias("n_rows"), F.array_sort(F.collect_list(item)).alias("_rows"))
    out = out.withColumn("text", F.array_join(F.transform("_rows", lambda r: r["text"]), ""))
    if members:
        out = out.withColumn("members", F.transform("_rows", lambda r: r["member"]))
    return out.drop("_rows")


def integer_ranges(df: DataFrame, by, value) -> DataFrame:
    """Maximal runs of consecutive integers as (start, end, n); repeats count once."""
    distinct = df.select(*by, value).filter(F.col(value).isNotNull()).distinct()
    # first and last values of the runs alone, in the order of one sort: a row has its run's end, or the next row is that
    w, v = _window(by, [value]), F.col(value)
    edges = distinct.withColumns({"_first": F.coalesce(F.lag(v).over(w) + 1 < v, F.lit(True)), "_last": F.coalesce(v < F.lead(v).over(w) - 1, F.lit(True))}).filter("_first OR _last")
    ends = edges.withColumn("_end", F.when(F.col("_last"), v).otherwise(F.lead(v).over(w))).filter("_first")
    return ends.select(*by, v.alias("start"), F.col("_end").alias("end"), (F.col("_end") - v + 1).cast("long").alias("n"))


def last_known(column, by, order, current: bool = True) -> Column:
    """The nearest non-null value before a row, the row's own included if ``current``."""
    return F.last(column, ignorenulls=True).over(_window(by, order).rowsBetween(Window.unboundedPreceding, 0 if current else -1))


def next_known(column, by, order, current: bool = True) -> Column:
    """The nearest non-null value after a row, the row's own included if ``current``."""
    return F.first(column, ignorenulls=True).over(_window(by, order).rowsBetween(0 if current else 1, Window.unboundedFollowing))


def neighbour_fill(df: DataFrame, by, order, column, name, one_sided: bool = False) -> DataFrame:
    """Fills a null where the nearest known values on both sides agree; with ``one_sided`` also where one side has none."""
    before, after = last_known(column, by, order, False), next_known(column, by, order, False)
    agreed = F.when(before == after, before)
    if one_sided:
        agreed = F.coalesce(agreed, F.when(before.isNull(), after), F.when(after.isNull(), before))
    return df.withColumn(name, F.coalesce(F.col(column), agreed))


def unanimous_fill(df: DataFrame, key, column, name) -> DataFrame:
    """Fills nulls of a group whose known values are all the same.

    Groups are summed up by partial aggregation and joined back as one row each,
    so that a hot group is not one task; a null in the key is a key like others.
    """
    known = df.groupBy(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)]).agg(F.min(column).alias("_low"), F.max(column).alias("_high"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(key)])
    filled = F.coalesce(F.col(column), F.when(F.col("_low") == F.col("_high"), F.col("_low")))
    return df.join(known, same, "left").withColumn(name, filled).select(*df.columns, name)


def segments(df: DataFrame, by, order, boundary, name="segment") -> DataFrame:
    """Counts the boundary rows up to and with each row."""
    counted = F.sum(F.when(F.col(boundary), 1).otherwise(0)).over(_window(by, order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(name, counted)


def ends_before_next(df: DataFrame, by, start, order=(), name="end") -> DataFrame:
    """Ends each range one before the next start; the last stays open (null)."""
    return df.withColumn(name, F.lead(start).over(_window(by, [start, *order])) - 1)


def running_offsets(df: DataFrame, by, order, length, name="offset") -> DataFrame:
    """Sum of the lengths of all rows before, 0 for the first."""
    before = F.sum(length).over(_window(by, order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn(name, F.coalesce(before, F.lit(0)))


def inherited(df: DataFrame, by, order, kind, value, name="effective") -> DataFrame:
    """Values that stay in force until the same kind is set again."""
    return df.withColumn(name, last_known(value, [*by, *kind], order))


def first_bad(df: DataFrame, by, order, bad: Column, columns) -> DataFrame:
    """Of each partition the first row in order that is bad; partitions without one have nulls."""
    key = F.struct(*order)
    aggs = [F.min_by(F.col(c), F.when(bad, key)).alias(f"first_bad_{c}") for c in columns]
    return df.groupBy(*by).agg(*aggs)
