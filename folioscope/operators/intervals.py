"""Operators on intervals: cover, overlap, containment, gaps.

Half-open ranges are [start, end); closed ones include the end, and say so.
Range joins are equi-joins on a group key and on a bucket of the range, with
the overlap tested within, so no pair is made outside a shared bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlaps_half_open(a_start, a_end, b_start, b_end) -> Column:
    """Whether [a) and [b) share a point; an empty range meets the range that its place lies in, ends included."""
    a0, a1, b0, b1 = (F.col(c) if isinstance(c, str) else c for c in (a_start, a_end, b_start, b_end))
    empty = (a0 == a1) | (b0 == b1)
    return F.when(empty, (F.greatest(a0, b0) <= F.least(a1, b1))).otherwise(F.greatest(a0, b0) < F.least(a1, b1))


def overlaps_closed(a_start, a_end, b_start, b_end, unknown: bool | None = None) -> Column:
    """Whether closed ranges share a point; with ``unknown`` given, that is the answer where an end is null."""
    a0, a1, b0, b1 = (F.col(c) if isinstance(c, str) else c for c in (a_start, a_end, b_start, b_end))
    test = (a0 <= b1) & (b0 <= a1)
    return test if unknown is None else F.coalesce(test, F.lit(unknown))


def covered(ranges: DataFrame, targets: DataFrame, by, name="covered", empty_needs_touch: bool = False) -> DataFrame:
    """Whether the ranges of each target cover it: ranges (by, start, end), targets (by, target_start, target_end), half-open.

    An empty target is covered; with ``empty_needs_touch`` only where some range
    holds its place, ends included.  A running greatest end finds the first gap in one pass.
    """
    w = Window.partitionBy(*by).orderBy("start", "end")
    touch = (F.col("start") <= F.col("target_start")) & (F.col("end") >= F.col("target_start"))
    joined = targets.join(ranges, by, "left").withColumn("_touch", F.coalesce(touch, F.lit(False))).withColumn("start", F.greatest("start", "target_start"))
    joined = joined.withColumn("_reach", F.greatest(F.coalesce(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("target_start")), F.col("target_start")))
    gap = F.max(F.when((F.col("start") > F.col("_reach")) & (F.col("_reach") < F.col("target_end")), 1).otherwise(0))
    done = joined.groupBy(*by, "target_start", "target_end").agg(gap.alias("_gap"), F.max("end").alias("_end"), F.bool_or("_touch").alias("_touch"))
    empty = F.col("target_end") <= F.col("target_start")
    whole = (empty & F.col("_touch") if empty_needs_touch else empty) | (~empty if empty_needs_touch else F.lit(True)) & ((F.col("_gap") == 0) & F.coalesce(F.col("_end") >= F.col("target_end"), F.lit(False)))
    return done.withColumn(name, whole).drop("_gap", "_end", "_touch")


def uncovered(ranges: DataFrame, targets: DataFrame, by) -> DataFrame:
    """The parts of each target that no range covers, as (by, start, end)."""
    w = Window.partitionBy(*by).orderBy("start", "end")
    edge = targets.select(*by, F.col("target_end").alias("start"), F.col("target_end").alias("end"))
    both = ranges.select(*by, "start", "end").unionByName(edge).join(targets, by)
    both = both.filter((F.col("start") <= F.col("target_end")) & (F.col("end") >= F.col("target_start")))
    reach = F.greatest(F.coalesce(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("target_start")), F.col("target_start"))
    gaps = both.withColumn("_from", reach).filter(F.col("start") > F.col("_from"))
    return gaps.select(*by, F.col("_from").alias("start"), F.col("start").alias("end"))


def overlap_join(left: DataFrame, right: DataFrame, by, width: int, l=("l_start", "l_end"), r=("r_start", "r_end"), how="inner") -> DataFrame:
    """Pairs of closed integer ranges of one group that overlap, with the size of the overlap.

    Both sides are dealt to the buckets of ``width`` that they touch; a pair is
    kept in the bucket where its overlap begins, so it comes once.  ``how`` left
    keeps left ranges without a partner.
    """
    bucket = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor(F.col(e) / width)))
    named = left.withColumn("_id", F.monotonically_increasing_id()) if how == "left" else left
    a = named.withColumn("_bucket", bucket(*l))
    b = right.withColumn("_bucket", bucket(*r))
    low, high = F.greatest(l[0], r[0]), F.least(l[1], r[1])
    pairs = a.join(b, [*by, "_bucket"]).filter((low <= high) & (F.floor(low / width) == F.col("_bucket"))).withColumn("overlap", high - low + 1).drop("_bucket")
    if how != "left":
        return pairs
    extra = [c for c in pairs.columns if c not in named.columns]
    return named.join(pairs.select("_id", *extra), "_id", "left").drop("_id")


def longest_overlap(pairs: DataFrame, key, chosen, order) -> DataFrame:
    """Of each key's partners the one with the longest overlap, the first in ``order`` among equals."""
    w = Window.partitionBy(*key).orderBy(F.col("overlap").desc(), *order)
    return pairs.withColumn("_row", F.row_number().over(w)).filter("_row = 1").select(*key, *chosen, "overlap")


def owners_of_points(points: DataFrame, ranges: DataFrame, by, point, width: int, start="start", end="end", owner="owner") -> DataFrame:
    """Each point with its one owner, how many owners it has, and whether that is a conflict."""
    spread = ranges.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    keyed = points.withColumn("_bucket", F.floor(F.col(point) / width))
    hit = keyed.join(spread, [*by, "_bucket"], "left").withColumn("_own", F.when(F.col(point).between(F.col(start), F.col(end)), F.col(owner)))
    out = hit.groupBy(*by, point).agg(F.countDistinct("_own").alias("n_owners"), F.min("_own").alias("_one"))
    return out.withColumn("owner", F.when(F.col("n_owners") == 1, F.col("_one"))).withColumn("conflict", F.col("n_owners") > 1).drop("_one")


def range_contract(ranges: DataFrame, by, total, start="start", end="end", order=()) -> DataFrame:
    """How closed ranges break the contract of covering 1..total once: gaps, overlaps, wrong ends."""
    w = Window.partitionBy(*by).orderBy(start, end, *order)
    last = F.coalesce(F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = ranges.withColumn("_last", last)
    count = lambda c: F.count_if(c)
    return x.groupBy(*by).agg(
        count(F.col(start) > F.col("_last") + 1).alias("n_gaps"), count(F.col(start) <= F.col("_last")).alias("n_overlaps"),
        count(F.col(end) < F.col(start)).alias("n_inverted"), (F.max(end) != F.max(total)).alias("wrong_end"),
    )


def boundaries_between(pairs: DataFrame, boundaries: DataFrame, by, low, high, at, name="n_between", width: int = 64) -> DataFrame:
    """How many boundaries of the group lie in (low, high] of each row."""
    rows = pairs.withColumn("_id", F.monotonically_increasing_id())
    spread = rows.select("_id", *by, low, high).withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.greatest(low, high) / width))))
    keyed = boundaries.select(*by, at).withColumn("_bucket", F.floor(F.col(at) / width))
    hits = spread.join(keyed, [*by, "_bucket"]).filter((F.col(at) > F.col(low)) & (F.col(at) <= F.col(high))).groupBy("_id").agg(F.count(F.lit(1)).alias(name))
    return rows.join(hits, "_id", "left").withColumn(name, F.coalesce(name, F.lit(0))).drop("_id")


def with_slack(df: DataFrame, start, end, before: int, after: int, least: int) -> DataFrame:
    """Widens ranges: ``before`` places earlier, and ``after`` later but ``least`` places from the start at least."""
    return df.withColumn("slack_start", F.col(start) - before).withColumn("slack_end", F.greatest(F.coalesce(F.col(end), F.col(start)) + after, F.col(start) + least))
