"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits.  Two
fingerprints at 4 or fewer differing bits have two segments with 2 or fewer
differing bits between them.  A segment, zero-padded to 23 bits, is decoded to
the indices of all codewords of the binary Golay code [23, 12, 7] within
distance 4: one index, or six.  Two words at distance 2 or less share such an
index, so a pair of linked fingerprints shares an index in both segments of
some pair.  Fingerprints are dealt out by (pair, index of its first segment),
joined on the index of its second segment within that, and verified by the
distance itself; what leaves a task are the stars of its local components, not
the pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from folioscope.llm.common import byte_rows, checkpointed, free_name, release_memory, slices
from folioscope.llm.components import component_roots, local_stars

SHINGLE = 4
MOST_BITS = 4
#: Shift and width of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = tuple(combinations(range(3), 2))
#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, the generator of the Golay code.
GENERATOR = 0b101011100011
_BLOCK = 1 << 16


def fingerprint(text: bytes) -> int:
    """The 64-bit SimHash of a text's 4-word shingles; 0 for a text without words."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest = xxhash.xxh64_intdigest
    n = len(words) - SHINGLE + 1
    hashes = np.fromiter((digest(joined[s:e], 42) for s, e in zip(starts[:n].tolist(), ends[SHINGLE - 1 :].tolist())), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, _BLOCK):
        part = hashes[i : i + _BLOCK]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches, columns):
    for batch in batches:
        for part in slices(batch, "text"):
            prints = np.fromiter(map(fingerprint, byte_rows(part.column("text"))), np.uint64, part.num_rows)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(prints.view(np.int64))], [*columns, "fp"])
    release_memory()


def _remainder(x: int) -> int:
    for bit in range(22, 10, -1):
        if x >> bit & 1:
            x ^= GENERATOR << bit - 11
    return x


def _golay():
    """Remainders of the three bytes of a 23-bit word; per remainder the error patterns of weight 4 or less, and how many."""
    parts = np.array([[_remainder(v << 8 * k) if v << 8 * k < 1 << 23 else 0 for v in range(256)] for k in range(3)], np.int64)
    found: dict[int, list[int]] = {}
    for weight in range(5):
        for bits in combinations(range(23), weight):
            pattern = sum(1 << b for b in bits)
            found.setdefault(_remainder(pattern), []).append(pattern)
    patterns = np.array([(found[r] + found[r][:1] * 6)[:6] for r in range(2048)], np.int64)
    return parts, patterns, np.array([len(found[r]) for r in range(2048)])


_tables = None


def segment_keys(prints: np.ndarray, segment: int) -> tuple[np.ndarray, np.ndarray]:
    """Codeword indices of a segment of all fingerprints, and the row that each belongs to."""
    global _tables
    _tables = _tables or _golay()
    parts, patterns, counts = _tables
    shift, width = SEGMENTS[segment]
    x = (prints >> np.uint64(shift)).astype(np.int64) & ((1 << width) - 1)
    remainder = parts[0][x & 255] ^ parts[1][x >> 8 & 255] ^ parts[2][x >> 16]
    keys = (x[:, None] ^ patterns[remainder]) >> 11
    real = np.arange(6) < counts[remainder][:, None]
    return keys[real], np.nonzero(real)[0]


def _deal(batches):
    """(bucket, fp): a bucket is a pair of segments and an index of its first."""
    for batch in batches:
        prints = batch.column("fp").to_numpy(zero_copy_only=False)
        for p, (first, _) in enumerate(PAIRS):
            keys, row = segment_keys(prints.view(np.uint64), first)
            yield pa.RecordBatch.from_arrays([pa.array((keys + (p << 12)).astype(np.int32)), pa.array(prints[row])], ["bucket", "fp"])


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= MOST_BITS


def _absorb(prints: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Spanning edges of one large group: each print, once reached, looks among those not reached yet."""
    edges, rest = [], np.unique(prints)
    queue: list[np.uint64] = []
    while len(rest):
        if not queue:
            queue, rest = [rest[0]], rest[1:]
        at = queue.pop()
        hit = _near(rest, at)
        if hit.any():
            reached, rest = rest[hit], rest[~hit]
            edges.append((np.full(len(reached), at), reached))
            queue.extend(reached)
    return edges


def _verified(bucket: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges of the links between rows that share a bucket and an index of its second segment."""
    edges = []
    for p, (_, second) in enumerate(PAIRS):
        own = np.flatnonzero(bucket >> 12 == p)
        if len(own) < 2:
            continue
        keys, row = segment_keys(prints[own], second)
        key = bucket[own][row].astype(np.int64) << 12 | keys
        order = np.argsort(key, kind="stable")
        key, fp = key[order], prints[own][row[order]]
        bounds = np.flatnonzero(np.diff(key, prepend=-1, append=-1))
        sizes = np.diff(bounds)
        for start, n in zip(bounds[:-1][sizes > 64], sizes[sizes > 64]):
            edges += _absorb(fp[start : start + n])
        small = np.repeat(sizes <= 64, sizes)
        key, fp = key[small], fp[small]
        for step in range(1, int(sizes[sizes <= 64].max(initial=1))):
            same = np.flatnonzero(key[step:] == key[:-step])
            if not len(same):
                break
            a, b = fp[same], fp[same + step]
            hit = _near(a, b)
            edges.append((a[hit], b[hit]))
    if not edges:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = (np.concatenate(x).view(np.int64) for x in zip(*edges))
    return local_stars(a, b) if len(a) else (a, b)


def _links(batches, rows: int = 200_000):
    """Batches sorted by bucket to (u, v); buckets are gathered whole, several at a time."""

    def flush(buckets, prints):
        u, v = _verified(np.concatenate(buckets), np.concatenate(prints).view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    buckets, prints, held = [], [], 0
    for batch in batches:
        b, f = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "fp"))
        if held + len(b) > rows and held:
            # the bucket that was open may go on in this batch
            cut = int(np.searchsorted(b, buckets[-1][-1], "right"))
            buckets.append(b[:cut])
            prints.append(f[:cut])
            if cut < len(b):
                yield flush(buckets, prints)
                buckets, prints, held = [], [], 0
            b, f = b[cut:], f[cut:]
        if len(b):
            buckets.append(b)
            prints.append(f)
        held = sum(map(len, buckets))
    if buckets:
        yield flush(buckets, prints)


def fingerprints(docs: DataFrame, text="text", doc_id="doc_id", keep=()) -> DataFrame:
    """Rows (doc_id, *keep, fp): the fingerprint as a signed long; a null text counts as empty."""
    columns = ["doc_id", *(f"keep_{i}" for i in range(len(keep)))]
    chosen = docs.select(F.col(doc_id).alias("doc_id"), *(k.alias(f"keep_{i}") for i, k in enumerate(keep)), F.col(text).alias("text"))
    schema = T.StructType([*(chosen.schema[c] for c in columns), T.StructField("fp", T.LongType())])
    return chosen.mapInArrow(lambda batches: _fingerprints(batches, columns), schema)


def fingerprint_roots(prints: DataFrame) -> DataFrame:
    """Rows (fp, root): for fingerprints linked to a smaller one, the smallest that is reachable."""
    spark = prints.sparkSession
    dealt = prints.select("fp").distinct().mapInArrow(_deal, "bucket int, fp long")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    links = dealt.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_links, "u long, v long")
    return component_roots(links).select(F.col("u").alias("fp"), F.col("v").alias("root"))


def components(prints: DataFrame) -> DataFrame:
    """``prints`` (doc_id, ..., fp) with root and component_id, the smallest doc_id of the component.

    Every fingerprint is in a component, alone if nothing is near; texts without
    words have fingerprint 0 and are linked like others.  Null ids are never the
    smallest; a component with null ids only has a null component_id.  Joins
    carry narrow rows; one side has one row per fingerprint, so a hot
    fingerprint's rows can be split by the adaptive skew join.
    """
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    by_print = least.join(fingerprint_roots(prints), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    by_root = by_print.groupBy("root").agg(F.min("least").alias("component_id"))
    named = by_print.filter(F.col("fp") != F.col("root")).select("fp", "root").join(by_root, "root")
    alone = by_root.join(by_print.filter(F.col("fp") == F.col("root")).select("fp"), F.col("root") == F.col("fp")).select("fp", "root", "component_id")
    return prints.join(named.select("fp", "root", "component_id").unionByName(alone), "fp")


def near_duplicates(docs: DataFrame, text="text", doc_id="doc_id") -> DataFrame:
    """Rows (doc_id, fp, root, component_id) of all documents; see :func:`components`."""
    return components(checkpointed(fingerprints(docs, text, doc_id)))


def deduplicated(docs: DataFrame, text="text", doc_id="doc_id") -> DataFrame:
    """One document of each component: that with the smallest id, nulls last; all columns as they are.

    Ties of the id go to the smaller hash of the text, and of rows that are
    equal in both one stays.
    """
    hashed, named = F.xxhash64(F.col(text)), F.xxhash64(F.lit(31), F.col(doc_id))
    prints = checkpointed(fingerprints(docs, text, doc_id, keep=[hashed, named]))
    first = Window.partitionBy("root").orderBy("keep_0", "keep_1")
    known = components(prints).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).withColumn("n", F.row_number().over(first))
    # one row of each kept pair of hashes: equal rows meet in the tasks that read them, and both steps share one shuffle of the texts
    h, k, h_of, k_of = (free_name(docs, x) for x in ("text_hash", "id_hash", "kept_text_hash", "kept_id_hash"))
    known = known.filter("n = 1").select(F.col("keep_0").alias(h_of), F.col("keep_1").alias(k_of))
    rows = docs.withColumns({h: hashed, k: named}).dropDuplicates([h, k])
    return rows.join(known.hint("shuffle_merge"), (F.col(h) == F.col(h_of)) & (F.col(k) == F.col(k_of)), "left_semi").select(*docs.columns)


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; null texts and texts without words have fingerprint 0."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
