"""Document fingerprints from closed syncmers.

A k-mer is taken where the least of its inner substrings of s bytes lies at
one of its two edges.  Whether it is taken depends on its own bytes alone, so
an edit moves or removes only the anchors that it touches.  Two texts are
compared by the anchors that they share on common diagonals, that is at a
common shift of position.  K-mers are read over the UTF-8 bytes, lower-cased
over A-Z, at one scale for texts of any length; the start of a text is marked.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.common import mix64, slices, source_bytes

K, S = 16, 7
#: Anchors that the fingerprint string shows with place and hash, those with the smallest hashes; its digest stands for all.
SHOWN = 32
#: Input bytes of a run of documents.
RUN_BYTES = 1 << 20
#: Runs that a task goes through, on average: a few, as they are dealt out by hash.
TASK_RUNS = 4
#: Runs at most: of a corpus beyond so many RUN_BYTES the runs are longer; a task streams through them all the same.
MOST_RUNS = 10_000
_RADIX = np.uint64(0x9E3779B97F4A7C13)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _rolled(x: np.ndarray, n: int) -> np.ndarray:
    """Mixed hashes of all substrings of n values, by doubling: n is a sum of powers of two."""
    out, size, part, power, radix = None, 0, x, 1, _RADIX
    while power <= n:
        if n & power:
            count = len(x) - size - power + 1
            out = part[:count].copy() if out is None else out[:count] * radix + part[size : size + count]
            size += power
        power *= 2
        if power <= n:
            count = len(part) - power // 2
            part = part[:count] * radix + part[power // 2 : power // 2 + count]
            radix = np.uint64(int(radix) ** 2 % (1 << 64))
    return mix64(out)


def _closed(x: np.ndarray, k: int, s: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the closed syncmers of a sequence of k values or more."""
    small = _rolled(x, s)
    width = k - s + 1
    least, span = small, 1
    while span < width:
        step = min(span, width - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    place = np.flatnonzero((least == small[: len(least)]) | (least == small[width - 1 :]))
    middle = small[place + width // 2] << np.uint64(1)
    return place, mix64(small[place] ^ (small[place + width - 1] * _RADIX) ^ middle ^ np.uint64(k))


def anchors(text: bytes, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of a text's closed syncmers.

    The start of a text is marked by k - 1 blanks of its own, so that a text of
    any length has k-mers; those that reach into the mark have negative places.
    A text without any anchor, such as the empty one, has itself as its one anchor.
    """
    data = _LOWER[np.frombuffer(text, np.uint8)]
    if len(data):
        place, hashes = _closed(np.concatenate([np.zeros(k - 1, np.uint64), data.astype(np.uint64) + np.uint64(1)]), k, s)
        if len(place):
            return place - (k - 1), hashes
    whole = int.from_bytes(hashlib.sha256(data.tobytes()).digest()[:8], "little")
    return np.zeros(1, np.int64), np.array([whole], np.uint64)


def fingerprint(found: tuple[np.ndarray, np.ndarray]) -> str:
    """The anchors as text: their number, a digest of all places and hashes, then ``place.hash`` of those with the smallest hashes.

    Numbers are hex; a shown hash is the upper half of its 64 bits.  Two strings
    are equal if and only if (but for chance) all anchors are, and what is shown
    can be matched by position.
    """
    place, hashes = found
    small = np.lexsort((place, hashes))[:SHOWN] if len(hashes) <= SHOWN else np.argpartition(hashes, SHOWN - 1)
    if len(hashes) > SHOWN:
        small = np.flatnonzero(hashes <= hashes[small[SHOWN - 1]])
        small = small[np.lexsort((place[small], hashes[small]))][:SHOWN]
    digest = hashlib.blake2b(place.astype("<i8").tobytes() + hashes.astype("<u8").tobytes(), digest_size=8).hexdigest()
    shown = " ".join(f"{p:x}.{h >> 32:08x}" for p, h in zip(place[small].tolist(), hashes[small].tolist()))
    return f"{len(hashes):x} {digest} {shown}"


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Share of the anchors of both texts that have a partner in the other at a common shift.

    A hash that a text repeats pairs off in order.  Of several shared anchors,
    those whose shift no other has are taken for chance.
    """
    (pa_, ha), (pb, hb) = a, b
    if len(ha) == len(hb) and np.array_equal(ha, hb):
        return 1.0
    ka, kb = _numbered(ha), _numbered(hb)
    _, i, j = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    _, inverse, count = np.unique(pa_[i] - pb[j], return_inverse=True, return_counts=True)
    shared = int((count[inverse] > 1).sum()) if len(i) > 1 else 1
    return 2.0 * shared / (len(ha) + len(hb))


def _numbered(hashes: np.ndarray) -> np.ndarray:
    """Hashes told apart by how often they came before."""
    order = np.argsort(hashes, kind="stable")
    sorted_ = hashes[order]
    first = np.flatnonzero(np.diff(sorted_, prepend=~sorted_[:1]))
    nth = np.arange(len(hashes)) - np.repeat(first, np.diff(first, append=len(hashes)))
    out = np.empty_like(hashes)
    out[order] = sorted_ + nth.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return out


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by the first as many characters of the next."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compared(batches):
    """Runs of (run, ahead, doc_id, text) in order to one row for each that is not ahead.

    The row marked ahead is the first of the next run, the next of a run's last.
    """
    held = None
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_anchors"]

    def row(doc_id, text, own, following, nearest):
        other = edited(text, following)
        raw = other.encode()
        changed = anchors(raw)
        return (doc_id, len(text), hashlib.sha256(raw).hexdigest(), fingerprint(own), fingerprint(changed), likeness(own, changed), likeness(own, nearest), len(own[1]))

    for batch in batches:
        for part in slices(batch, "text"):
            out = []
            for run, ahead, doc_id, text in zip(*(part.column(c).to_pylist() for c in ("run", "ahead", "doc_id", "text"))):
                text = text or ""
                own = anchors(text.encode())
                if held and held[0] == run:
                    out.append(row(*held[1:], text, own))
                held = None if ahead else (run, doc_id, text, own)
            kinds = [part.schema.field("doc_id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
            columns = list(zip(*out)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


class Bounds:
    """Sorted (id, tie) pairs of rows that exist; ids in their own type, nulls first."""

    def __init__(self, ids: pa.Array, ties: pa.Array):
        self.ties = ties.to_pylist()
        self.nulls = ids.null_count
        known = ids.slice(self.nulls)
        self.exact = pa.types.is_integer(ids.type) or pa.types.is_floating(ids.type)
        self.ids = known.to_numpy(zero_copy_only=False) if self.exact else known.to_pylist()

    def place(self, ids: pa.Array, ties: pa.Array) -> pa.Array:
        """The number of bounds that are not above each row, negative where the row is one of them."""
        low, high = np.zeros(len(ids), np.int64), np.full(len(ids), self.nulls)
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        own = ids.drop_null()
        if self.exact:
            own = own.to_numpy(zero_copy_only=False)
            low[known], high[known] = (self.nulls + np.searchsorted(self.ids, own, side) for side in ("left", "right"))
        else:
            own = own.to_pylist()
            low[known], high[known] = (self.nulls + np.fromiter((find(self.ids, x) for x in own), np.int64, len(own)) for find in (bisect_left, bisect_right))
        out = high.copy()
        for i in np.flatnonzero(high > low):
            a, tie = int(low[i]), ties[i].as_py()
            at = bisect_right(self.ties, tie, a, int(high[i]))
            out[i] = -at if at > a and self.ties[at - 1] == tie else at
        return pa.array(out, pa.int32())


def _bounds(keys: DataFrame, runs: int) -> pa.Table:
    """The first (id, tie) of every range of rows but the first: rows that exist, in their own types."""
    first = F.min(F.struct("doc_id", "tie"))
    ranged = keys.repartitionByRange(runs, F.col("doc_id").asc_nulls_first(), "tie")
    firsts = ranged.groupBy(F.spark_partition_id().alias("at")).agg(first.alias("first")).select("first.*").distinct()
    return firsts.orderBy(F.col("doc_id").asc_nulls_first(), "tie").toArrow().combine_chunks().slice(1)


def compare_with_next(docs: DataFrame, text="text", doc_id="doc_id", run_bytes: int = RUN_BYTES, most_runs: int = MOST_RUNS) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness, in order of the id.

    Rows are ordered by (id, hash of the text), null ids first, and cut into runs of about
    ``run_bytes`` of input at rows that exist, so that the text after a run is
    known: the rows equal to the next run's first go to both runs, those ahead
    of the run's own rows last.  Ids may be of any type that Spark orders but
    structs and arrays, and are compared in that type.  Each text is shuffled once.
    Rows that repeat an id follow one another by hash of the text, and may fall
    into several runs unless their texts are the same too; a null text is empty;
    a single document is its own next one; an empty table gives no rows.
    """
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("tie", F.xxhash64("text"))
    runs = max(1, min(most_runs, -(-source_bytes(docs, text) // run_bytes)))
    head = chosen.orderBy(F.col("doc_id").asc_nulls_first(), "tie").limit(1)
    cuts = _bounds(chosen.select("doc_id", "tie"), runs) if runs > 1 else None
    n = cuts.num_rows if cuts else 0
    own = F.struct(F.col("run").alias("run"), F.lit(False).alias("ahead"))
    if n:
        shared = docs.sparkSession.sparkContext.broadcast(Bounds(*(c.chunk(0) for c in cuts.columns)))
        place = F.arrow_udf(lambda ids, ties: shared.value.place(ids, ties), "int")
        rows = chosen.withColumn("at", place("doc_id", "tie")).withColumn("run", F.expr("abs(at)"))
        before = F.struct((F.col("run") - 1).alias("run"), F.lit(True).alias("ahead"))
        rows = rows.withColumn("place", F.explode(F.when(F.col("at") < 0, F.array(own, before)).otherwise(F.array(own))))
    else:
        rows = chosen.withColumn("run", F.lit(0)).withColumn("place", own)
    rows = rows.select("place.run", "place.ahead", "doc_id", "text", "tie")
    last = head.select(F.lit(n).alias("run"), F.lit(True).alias("ahead"), "doc_id", "text", "tie")
    rows = rows.unionByName(last).repartition(n // TASK_RUNS + 1, "run").sortWithinPartitions("run", "ahead", F.col("doc_id").asc_nulls_first(), "tie")
    schema = T.StructType([chosen.schema["doc_id"]]).add("n_chars", "long").add("edited_sha256", "string").add("fingerprint", "string").add("edited_fingerprint", "string")
    schema = schema.add("near_edited", "double").add("near_next", "double").add("n_anchors", "long")
    return rows.select("run", "ahead", "doc_id", "text").mapInArrow(_compared, schema)


def syncmers(docs: DataFrame, text="text", doc_id="doc_id", k: int = K, s: int = S) -> DataFrame:
    """(doc_id, place, hash) of every anchor: the operator's real output, for positional joins."""
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = T.StructType([chosen.schema["doc_id"]]).add("place", "long").add("hash", "long")

    def found(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                each = [anchors((x or "").encode(), k, s) for x in part.column("text").to_pylist()]
                rows = np.repeat(np.arange(len(each)), [len(p) for p, _ in each])
                place, hashes = (np.concatenate(x) for x in zip(*each))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(rows)), pa.array(place), pa.array(hashes.view(np.int64))], ["doc_id", "place", "hash"])

    return chosen.mapInArrow(found, schema)


def op8_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, with their likeness."""
    return compare_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
