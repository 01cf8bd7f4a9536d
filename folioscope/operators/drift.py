"""Expectations against rows whose ids have moved: alignment by unique anchors and longest increasing runs.

Texts that stand once on either side are anchors.  Of a document's anchors the
longest run that rises on both sides is kept (found by patience sorting); rows
between two anchors are matched by text and occurrence, and of all matches again
the longest rising run.  Joins and windows do the rest; Python sees pairs of
numbers, a document at a time.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators.assembly import _starts
from folioscope.sources.shared import written


def longest_rise(values: list[int]) -> list[int]:
    """Places of a longest strictly rising run of ``values``; of equally long ones that with the smallest values."""
    tails: list[int] = []
    ends: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        if k == len(tails):
            tails.append(v)
            ends.append(i)
        else:
            tails[k], ends[k] = v, i
        before[i] = ends[k - 1] if k else -1
    out, at = [], ends[-1] if ends else -1
    while at >= 0:
        out.append(at)
        at = before[at]
    return out[::-1]


def _rising(batches, keys: list[str]):
    """Rows of longest rising runs; batches are sorted by key, and one key's rows and a batch are held."""

    def whole(rows: list[pa.RecordBatch]):
        table = pa.Table.from_batches(rows).combine_chunks()
        r, starts = table["r"].to_numpy(), np.flatnonzero(_starts(table, keys)).tolist()
        kept = [np.array(longest_rise(r[a:b].tolist()), np.int64) + a for a, b in zip(starts, [*starts[1:], len(r)])]
        yield from table.take(pa.array(np.concatenate(kept))).combine_chunks().to_batches()

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = [held[-1].slice(held[-1].num_rows - 1)] if held else []
        new = _starts(pa.Table.from_batches([*last, batch]), keys)[len(last) :]
        cuts = np.flatnonzero(new[0 if last else 1 :]) + (0 if last else 1)
        if len(cuts):
            at = int(cuts[-1])
            rows = [*held, *([batch.slice(0, at)] if at else [])]
            yield from whole(rows)
            held, batch = [], batch.slice(at)
        held.append(batch)
    if held:
        yield from whole(held)


def rising(pairs: DataFrame, by) -> DataFrame:
    """Of pairs (by, l, r) of each document those of a longest run that rises on both sides."""
    keys = [f"k{i}" for i in range(len(by))]
    rows = pairs.select(*[F.col(b).alias(k) for b, k in zip(by, keys)], F.col("l").cast("long").alias("l"), F.col("r").cast("long").alias("r"))
    # of pairs with one left place the larger right one comes first, so that no two of them rise
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, "l", F.desc("r"))
    out = ordered.mapInArrow(lambda batches: _rising(batches, keys), rows.schema)
    return out.select(*[F.col(k).alias(b) for b, k in zip(by, keys)], "l", "r")


def aligned(left: DataFrame, right: DataFrame, by, order: str, text: str) -> DataFrame:
    """(by, l, r): orders of the rows of both sides that stand for each other.

    Both sides have ``order``, a number that is one row's own in its document,
    and ``text``; null and empty texts match nothing.  Matches have equal texts
    and never cross.  Rows without a document are left out.
    """
    def side(df, name):
        rows = df.dropna(subset=[*by, order]).filter(F.col(text) != "")
        return rows.select(*by, F.col(order).cast("long").alias(name), F.sha2(F.col(text).cast("string"), 256).alias("text"))

    a, b = side(left, "l"), side(right, "r")
    once = [df.groupBy(*by, "text").agg(F.count(F.lit(1)).alias("n"), F.max(name).alias(name)).filter("n = 1").drop("n") for df, name in ((a, "l"), (b, "r"))]
    anchors = written(rising(once[0].join(once[1], [*by, "text"]), by))

    def between(df, name):
        marks = anchors.select(*by, F.col(name), F.lit(None).cast("string").alias("text"), F.lit(1).alias("mark"))
        before = Window.partitionBy(*by).orderBy(name, F.desc("mark")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = df.withColumn("mark", F.lit(0)).unionByName(marks).withColumn("gap", F.sum("mark").over(before)).filter("mark = 0")
        own = anchors.select(*by, name, F.lit(True).alias("anchor"))
        loose = rows.join(own, [*by, name], "left").filter(F.col("anchor").isNull())
        return loose.withColumn("nth", F.row_number().over(Window.partitionBy(*by, "gap", "text").orderBy(name))).select(*by, "gap", "text", "nth", name)

    rest = between(a, "l").join(between(b, "r"), [*by, "gap", "text", "nth"]).select(*by, "l", "r")
    return rising(anchors.unionByName(rest), by)


def expectation_audit(expected: DataFrame, actual: DataFrame, by) -> DataFrame:
    """(by, order, ref, found_ref, via, finding, status): what became of each expected row.

    Both sides hold (by, order, ref, text, action).  A row is found by its ref
    where the text is the same, else by alignment, else not at all
    (``expected_row_missing``, UNKNOWN).  An action other than expected is
    ``action_mismatch``, FAIL; null actions differ from all but null.  Of actual
    rows that repeat a ref the first counts.
    """
    theirs = actual.dropna(subset=[*by, "order"])
    first = theirs.filter(F.col("ref").isNotNull()).groupBy(*by, "ref").agg(F.min_by(F.struct("text", "action"), "order").alias("same"))
    pairs = aligned(expected, actual, by, "order", "text")
    moved = pairs.join(theirs.select(*by, F.col("order").cast("long").alias("r"), F.struct(F.col("ref"), F.col("action")).alias("other")), [*by, "r"])
    mine = expected.dropna(subset=[*by, "order"])
    both = mine.join(first, [*by, "ref"], "left").join(moved.select(*by, F.col("l").alias("order"), "other"), [*by, "order"], "left")
    by_ref = F.col("same").isNotNull() & F.col("same.text").eqNullSafe(F.col("text"))
    via = F.when(by_ref, "ref").when(F.col("other").isNotNull(), "anchor")
    action = F.when(by_ref, F.col("same.action")).otherwise(F.col("other.action"))
    finding = F.when(via.isNull(), "expected_row_missing").when(~action.eqNullSafe(F.col("action")), "action_mismatch")
    status = F.when(finding.isNull(), "PASS").when(finding == "action_mismatch", "FAIL").otherwise("UNKNOWN")
    return both.select(*by, "order", "ref", F.when(by_ref, F.col("ref")).otherwise(F.col("other.ref")).alias("found_ref"), via.alias("via"), finding.alias("finding"), status.alias("status"))
