"""Joins with the rules that lookups by code have: last or first wins, ranked fallbacks, as-of, text containment."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.operators.sequence import ranged_sequence
from folioscope.sources.shared import written


def one_each(df: DataFrame, key, order, last: bool = True) -> DataFrame:
    """One row for each key: the last in ``order``, or the first."""
    place = F.struct(*[F.col(c) for c in order])
    rest = [c for c in df.columns if c not in key]
    pick = (F.max_by if last else F.min_by)(F.struct(*rest), place)
    return df.groupBy(*key).agg(pick.alias("_row")).select(*key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def lookup(left: DataFrame, right: DataFrame, key, order, last: bool = True) -> DataFrame:
    """Left join against the last (or first) right row of each key: the left side is never multiplied."""
    return left.join(one_each(right, key, order, last), key, "left")


def ranked_match(left: DataFrame, key, tries, order) -> DataFrame:
    """The best match of each left row over several joins, tried by rank.

    ``tries`` is a list of (right, left columns, right columns); the rank is the
    place in the list.  Among equals the first in ``order`` (columns of the right)
    wins.  Each try is an equi-join with one right row a value, the first in
    order, so the left side is never multiplied; rows without any match stay, with nulls.
    """
    found = None
    for rank, (right, own, theirs) in enumerate(tries, 1):
        first = F.min_by(F.struct(*right.columns), F.struct(*order)).alias("_right")
        firsts = right.dropna(subset=list(theirs)).groupBy(*[F.col(t).alias(f"_k{i}") for i, t in enumerate(theirs)]).agg(first)
        on = [F.col(c) == F.col(f"_k{i}") for i, c in enumerate(own)]
        hit = left.join(firsts, on).select(*key, F.lit(rank).alias("rank"), "_right")
        found = hit if found is None else found.unionByName(hit)
    place = F.struct("rank", *[F.col(f"_right.{c}") for c in order])
    best = found.groupBy(*key).agg(F.min_by(F.struct("rank", "_right"), place).alias("_best"))
    names = [c for c in tries[0][0].columns]
    return left.join(best, key, "left").select(*left.columns, F.col("_best.rank").alias("rank"), *[F.col(f"_best._right.{c}").alias(f"m_{c}") for c in names])


def prefix_match(left: DataFrame, right: DataFrame, by, left_ref, right_ref, key, order, length: int) -> DataFrame:
    """An equal reference, or else the first right row of which either reference begins with the other.

    The shorter reference must have ``length`` characters, or be equal.  Each
    text has one right row, the first in order; texts that begin a reference
    are found by its beginnings, cut at the lengths that the texts of its group
    have, and the first of the texts that go on from it by theirs.  So no rows
    are made for pairs of texts, however many begin alike.
    """
    groups = [f"_by{i}" for i in range(len(by))]
    named = [F.col(b).alias(g) for b, g in zip(by, groups)]
    place = F.struct(*order)
    rows = right.dropna(subset=[*by, right_ref]).select(*named, F.col(right_ref).alias("_text"), place.alias("_place"), F.struct(*[c for c in right.columns if c not in by]).alias("_right"))
    texts = rows.groupBy(*groups, "_text").agg(F.min_by(F.struct("_place", "_right"), F.col("_place")).alias("_first"))
    asked = left.dropna(subset=[*by, left_ref]).select(*named, F.col(left_ref).alias("_ref")).distinct()

    def beginnings(whole, text, others, other):
        """Rows of ``whole`` for the beginnings of ``text`` that are as long as an ``other`` of the group, as ``_cut``."""
        lengths = others.groupBy(*groups).agg(F.collect_set(F.length(other)).alias("_lengths"))
        fits = F.filter("_lengths", lambda n: (n <= F.length(text)) & ((n >= length) | (n == F.length(text))))
        return whole.join(lengths, groups).withColumn("_n", F.explode(fits)).withColumn("_cut", F.substring(F.col(text), F.lit(1), F.col("_n"))).drop("_lengths", "_n")

    shorter = beginnings(asked, "_ref", texts, "_text").join(texts.withColumnRenamed("_text", "_cut"), [*groups, "_cut"])
    shorter = shorter.select(*groups, "_ref", (F.col("_cut") == F.col("_ref")).alias("exact"), "_first")
    longer = beginnings(texts, "_text", asked, "_ref").groupBy(*groups, F.col("_cut").alias("_ref")).agg(F.min_by("_first", F.col("_first._place")).alias("_first"))
    longer = longer.join(asked, [*groups, "_ref"]).select(*groups, "_ref", F.lit(False).alias("exact"), "_first")
    best = shorter.unionByName(longer).groupBy(*groups, "_ref").agg(F.min_by(F.struct("exact", "_first"), F.struct(~F.col("exact"), F.col("_first._place"))).alias("_best"))
    on = [F.col(b) == F.col(g) for b, g in zip([*by, left_ref], [*groups, "_ref"])]
    pairs = left.join(best, on).withColumns({"_place": F.col("_best._first._place"), "exact": F.col("_best.exact")})
    w = Window.partitionBy(*key).orderBy(F.col("exact").desc(), "_place")
    rest = [F.col(f"_best._first._right.{c}").alias(c) for c in right.columns if c not in by]
    return pairs.withColumn("_row", F.row_number().over(w)).filter("_row = 1").select(*by, *[c for c in left.columns if c not in by], *rest, "exact")


def asof_backward(left: DataFrame, right: DataFrame, by, at, value, tie=()) -> DataFrame:
    """For each left row the value of the last right row at or before it, by one sorted union."""
    a = left.withColumn("_side", F.lit(1)).withColumn("_value", F.lit(None).cast(right.schema[value].dataType))
    b = right.select(*by, at, F.col(value).alias("_value"), *tie).withColumn("_side", F.lit(0))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(at, "_side", *tie).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(f"asof_{value}", F.last("_value", ignorenulls=True).over(w)).filter("_side = 1").drop("_side", "_value")


def asof_forward(left: DataFrame, right: DataFrame, by, at, value, tie=(), or_last: bool = False) -> DataFrame:
    """The value of the first right row at or after; with ``or_last`` the last before where there is none."""
    a = left.withColumn("_side", F.lit(0)).withColumn("_value", F.lit(None).cast(right.schema[value].dataType))
    b = right.select(*by, at, F.col(value).alias("_value"), *tie).withColumn("_side", F.lit(1))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(at, "_side", *tie)
    ahead = F.first("_value", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    if or_last:
        ahead = F.coalesce(ahead, F.last("_value", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return both.withColumn(f"next_{value}", ahead).filter("_side = 0").drop("_side", "_value")


#: Bytes of needles that are broadcast at once; more needles take several passes over the texts.
NEEDLE_BYTES = 16 << 20
#: Bytes by which places in a text are looked up, at most.
RUN = 16
_RADIX = np.uint64(0x9E3779B97F4A7C15)


def _runs(data: bytes, g: int) -> np.ndarray:
    """Hashes of all runs of g bytes."""
    x = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    out = np.zeros(max(len(x) - g + 1, 0), np.uint64)
    for i in range(g if len(out) else 0):
        out = out * _RADIX + x[i : i + len(out)]
    return out * _RADIX ^ out >> np.uint64(32)


class _Needles:
    """Needles by the hash of their first bytes."""

    def __init__(self, texts: list[str]):
        raw = [t.encode() for t in texts]
        self.g = min(RUN, min(map(len, raw)))
        self.by_run: dict[int, list[tuple[bytes, str]]] = {}
        for data, text in zip(raw, texts):
            self.by_run.setdefault(int(_runs(data[: self.g], self.g)[0]), []).append((data, text))
        self.hit = np.zeros(1 << 20, bool)
        self.hit[np.array(list(self.by_run), np.uint64) >> np.uint64(44)] = True

    def inside(self, data: bytes) -> list[str]:
        """The needles that stand in a text."""
        hashes, found = _runs(data, self.g), set()
        at = np.flatnonzero(self.hit[hashes >> np.uint64(44)])
        for i, h in zip(at.tolist(), hashes[at].tolist()):
            found.update(text for needle, text in self.by_run.get(h, ()) if text not in found and data.startswith(needle, i))
        return sorted(found)


def _holding(batches, shared, column: str):
    for batch in batches:
        found = [shared.value.inside((x or "").encode()) for x in batch.column(column).to_pylist()]
        rows = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
        yield pa.RecordBatch.from_arrays([*batch.take(rows).columns, pa.array([n for f in found for n in f], pa.string())], [*batch.schema.names, "_needle"])


def contains_match(texts: DataFrame, needles: DataFrame, text, needle, key, order, n: int = 1, needle_bytes: int = NEEDLE_BYTES) -> DataFrame:
    """The first ``n`` texts, in order, that contain each needle; null and empty needles match nothing.

    Texts are streamed once past the needles, ``needle_bytes`` of them at a time,
    and looked up at every place by the hash of a needle's first bytes; texts are
    not shuffled, only the pairs found are.
    """
    spark = texts.sparkSession
    distinct = needles.filter(F.length(needle) > 0).select(F.col(needle).alias("needle")).distinct()
    size = distinct.agg(F.sum(F.octet_length("needle"))).first()[0] or 0
    blocks, pairs = max(1, -(-size // needle_bytes)), texts.limit(0).withColumn("_needle", F.lit(""))
    schema = T.StructType([*texts.schema.fields, T.StructField("_needle", T.StringType())])
    for b in range(blocks):
        own = [r[0] for r in distinct.filter(F.pmod(F.xxhash64("needle"), F.lit(blocks)) == b).collect()]
        if own:
            shared = spark.sparkContext.broadcast(_Needles(own))
            pairs = pairs.unionByName(texts.mapInArrow(lambda batches, s=shared: _holding(batches, s, text), schema))
    pairs = pairs.join(needles, F.col("_needle") == F.col(needle)).drop("_needle")
    w = Window.partitionBy(*key).orderBy(*order)
    return pairs.withColumn("match_no", F.row_number().over(w)).filter(F.col("match_no") <= n)


#: Bitmaps of 4 KB that one task unites.
TASK_BITMAPS = 1 << 16


def tokens_spread(items: DataFrame, places: DataFrame, key, by, token, place, least: int, close: bool = False) -> DataFrame:
    """(key, by, n_tokens, n_places, first_place): items of which ``least`` or more distinct tokens stand in the places of a group.

    ``items`` has rows (key, token), ``places`` rows (by, place, token).  The
    places of a token are a posting bitmap, one for each 32,768 of them; an item
    takes the union of its tokens' bitmaps, so no row stands for an item and a
    place, however common a token is.  Only tokens that some item has are
    posted.  ``close`` says that places are integers with few gaps; others are
    numbered first.  Null tokens and null places are none; repeats count once.
    """
    wanted = items.select(*key, F.col(token).alias("token")).dropna(subset=["token"]).distinct()
    posted = places.select(*[F.col(c).alias(f"by_{i}") for i, c in enumerate(by)], F.col(place).alias("place"), F.col(token).alias("token")).dropna(subset=["place", "token"])
    posted = posted.join(wanted.select("token").distinct(), "token", "left_semi")
    if not close:
        numbers = ranged_sequence(posted.select("place").distinct(), [], ["place"], "number")
        posted = posted.join(numbers, "place")
    else:
        posted = posted.withColumn("number", F.col("place").cast("long"))
    groups = [f"by_{i}" for i in range(len(by))]
    # rows are dealt before bitmaps are made of them, as a bitmap is a hundred times its size in a shuffle, by which tasks are cut
    dealt = posted.withColumn("bucket", F.bitmap_bucket_number("number")).repartition(*groups, "token", "bucket")
    bitmaps = written(dealt.groupBy(*groups, "token", "bucket").agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits"), F.min("place").alias("first")))
    named = wanted.select(*[F.col(c).alias(f"key_{i}") for i, c in enumerate(key)], "token")
    owners = [f"key_{i}" for i in range(len(key))]
    both = named.join(bitmaps, "token")
    n_rows = named.groupBy("token").agg(F.count(F.lit(1)).alias("n")).join(bitmaps.groupBy("token").agg(F.count(F.lit(1)).alias("m")), "token").agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0
    spread = both.repartition(max(1, -(-n_rows // TASK_BITMAPS)), *owners, *groups, "bucket").groupBy(*owners, *groups, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"), F.min("first").alias("first"))
    n_places = spread.select(*owners, *groups, F.lit(0).cast("long").alias("n_tokens"), F.bitmap_count("bits").alias("n_places"), "first")
    n_tokens = both.groupBy(*owners, *groups).agg(F.countDistinct("token").alias("n_tokens")).withColumns({"n_places": F.lit(0).cast("long"), "first": F.lit(None).cast(places.schema[place].dataType)})
    out = n_places.unionByName(n_tokens).groupBy(*owners, *groups).agg(F.sum("n_tokens").alias("n_tokens"), F.sum("n_places").alias("n_places"), F.min("first").alias("first_place"))
    names = [F.col(a).alias(b) for a, b in zip([*owners, *groups], [*key, *by])]
    return out.filter(F.col("n_tokens") >= least).select(*names, "n_tokens", "n_places", "first_place")


def best_scored(candidates: DataFrame, key, score: Column, order) -> DataFrame:
    """The candidate with the highest score, the earliest in order among equals; scores of 0 or less are none."""
    x = candidates.withColumn("score", score).filter("score > 0")
    w = Window.partitionBy(*key).orderBy(F.col("score").desc(), *order)
    return x.withColumn("_row", F.row_number().over(w)).filter("_row = 1").drop("_row")


def array_overlap_match(left: DataFrame, right: DataFrame, by, own, theirs, key) -> DataFrame:
    """Pairs of one group whose arrays share a value, with how many, joined on the values."""
    a = left.withColumn("_v", F.explode(F.array_distinct(own)))
    b = right.withColumn("_v", F.explode(F.array_distinct(theirs)))
    return a.join(b, [*by, "_v"]).groupBy(*by, *key).agg(F.count(F.lit(1)).alias("n_shared"))
