"""Benchmark decontamination by greedy string tiling.

Documents are streamed past the benchmark.  Word 5-grams that a document
shares with an item are the seeds of a join; a seed's words are the only ones
that a tile can hold, so an item whose seeded words stay under the threshold
is out.  For the others Karp-Rabin windows of falling lengths find the matches
between what is not tiled yet, which are marked as tiles, longest first, until
none of five words is left.  Tiles may lie in any order, so reordered passages count.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.common import PUNCT, byte_rows, hashed_words, release_memory, slices

MIN_TILE = 5
COVERAGE = 0.8
#: Benchmark text that is broadcast at once; a larger benchmark takes several passes over the documents.
BLOCK_BYTES = 16 << 20
_RADIX = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_RADIX), -1, 1 << 64))
_FILTER_BITS = 22
#: Places of seeds that are joined with texts at once.
JOINED = 1 << 20

SPANS = "array<struct<doc_start:int,item_start:int,words:int>>"


def _windows(words: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of n words."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = words[:count].copy()
    for i in range(1, n):
        out = out * _RADIX + words[i : i + count]
    return out


def _rolling(words: np.ndarray, n: int) -> np.ndarray:
    """The same for long windows, off prefix sums."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    up, down = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(len(words) - 1, r)])) for r in (_RADIX, _INVERSE))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up)])
    return (sums[n:] - sums[: len(words) - n + 1]) * down[: len(words) - n + 1]


def tiles(doc: np.ndarray, item: np.ndarray, open_doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two word sequences: (doc start, item start, words), in order of marking.

    Only words with ``open_doc`` set can be tiled.  The longest match of words
    that are free on both sides is marked first; of equally long ones the first
    in the document, then in the item.  A match that earlier tiles have cut into
    goes back in line with what is left of it.
    """
    free_d, free_t = open_doc.copy(), np.ones(len(item), bool)
    code = np.unique(np.concatenate([doc, item]), return_inverse=True)[1].astype(np.int64)
    codes, found, length = (code[: len(doc)], code[len(doc) :]), [], min(len(item), len(doc))
    while length >= least:
        line = _matches(doc, item, codes, free_d, free_t, length)
        while line:
            k, i, j = heapq.heappop(line)
            k = -k
            free = free_d[i : i + k] & free_t[j : j + k]
            if free.all():
                free_d[i : i + k] = free_t[j : j + k] = False
                found.append((i, j, k))
                if _free_runs(free_t).max(initial=0) < length:
                    break
                continue
            edges = np.flatnonzero(np.diff(free.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
                if b - a >= length:
                    heapq.heappush(line, (a - b, i + a, j + a))
        if length == least:
            break
        length = max(least, length // 2)
    return found


def _matches(doc, item, codes, free_d, free_t, length: int) -> list[tuple[int, int, int]]:
    """The heap of (-words, doc start, item start) of all matches of free words that have ``length`` words and cannot be made longer.

    Windows of equal hash pair off only where the words before them differ, so
    that a long match is found once, by its start, however often a text repeats itself.
    """
    run_d, run_t = _free_runs(free_d), _free_runs(free_t)
    at_t = np.flatnonzero(run_t[: max(len(item) - length + 1, 0)] >= length)
    at_d = np.flatnonzero(run_d[: max(len(doc) - length + 1, 0)] >= length)
    if not len(at_t) or not len(at_d):
        return []
    hash_t, hash_d = _rolling(item, length)[at_t], _rolling(doc, length)[at_d]
    kinds = np.unique(hash_t)
    kind = np.minimum(np.searchsorted(kinds, hash_d), len(kinds) - 1)
    known = kinds[kind] == hash_d
    at_d, kind = at_d[known], kind[known]
    if not len(at_d):
        return []
    # the word before, told apart on the two sides where there is none that is free
    before_d = np.where((at_d > 0) & free_d[at_d - 1], codes[0][at_d - 1], -1) + 2
    before_t = np.where((at_t > 0) & free_t[at_t - 1], codes[1][at_t - 1], -2) + 2
    wide = max(int(codes[0].max()), int(codes[1].max())) + 3
    key = kind * wide + before_d
    order = np.argsort(key, kind="stable")
    key, at_d = key[order], at_d[order]
    own = np.searchsorted(kinds, hash_t) * wide
    begin, stop = np.searchsorted(key, own), np.searchsorted(key, own + wide)
    same, after = np.searchsorted(key, own + before_t), np.searchsorted(key, own + before_t, "right")
    sizes = np.concatenate([same - begin, stop - after])
    firsts = np.concatenate([begin, after])
    j = np.repeat(np.concatenate([at_t, at_t]), sizes)
    i = at_d[np.repeat(firsts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
    most = np.minimum(run_d[i], run_t[j])
    k, going = np.zeros(len(i), np.int64), np.arange(len(i))
    while len(going):
        going = going[k[going] < most[going]]
        going = going[codes[0][i[going] + k[going]] == codes[1][j[going] + k[going]]]
        k[going] += 1
    keep = k >= length
    line = list(zip((-k[keep]).tolist(), i[keep].tolist(), j[keep].tolist()))
    heapq.heapify(line)
    return line


def _free_runs(free: np.ndarray) -> np.ndarray:
    """How many free words follow one another from each place on."""
    n = len(free)
    stops = np.where(free, n, np.arange(n))
    return np.minimum.accumulate(stops[::-1])[::-1] - np.arange(n)


class _Seeds:
    """Windows of n words of the items that have their seeds of that length, with the items and places where each stands."""

    def __init__(self, items: list[np.ndarray], own: list[int], n: int):
        windows = [_windows(items[i], n) for i in own]
        self.n = n
        self.seeds, seed = np.unique(np.concatenate(windows), return_inverse=True)
        item, place = np.repeat(own, [len(w) for w in windows]), np.concatenate([np.arange(len(w)) for w in windows])
        order = np.lexsort((place, item, seed))
        self.item, self.place = item[order], place[order]
        self.starts = np.searchsorted(seed[order], np.arange(len(self.seeds) + 1))
        by_item = np.lexsort((seed, item))
        cuts = np.searchsorted(item[by_item], np.append(own, own[-1] + 1)) if own else []
        self.of_item = {i: np.unique(seed[by_item[a:b]]) for i, a, b in zip(own, cuts[:-1], cuts[1:])}
        self.hit = np.zeros(1 << _FILTER_BITS, bool)
        self.hit[(self.seeds >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def found(self, words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, seed, place) of all windows of the texts that are seeds, in order of place."""
        grams = _windows(words, self.n)
        near = np.flatnonzero(self.hit[(grams >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        seed = np.minimum(np.searchsorted(self.seeds, grams[near]), len(self.seeds) - 1)
        real = self.seeds[seed] == grams[near]
        near, seed = near[real], seed[real]
        row = np.searchsorted(ends, near, "right")
        inside = near + self.n <= ends[np.minimum(row, len(ends) - 1)]
        return row[inside], seed[inside], near[inside]

    def candidates(self, row: np.ndarray, seed: np.ndarray, sizes: np.ndarray, coverage: float) -> list[tuple[int, int]]:
        """The (row, item) whose shared seeds cover enough of the item: the join of a text's distinct seeds with their places."""
        out = []
        key = np.unique(row * len(self.seeds) + seed)
        row, seed = key // len(self.seeds), key % len(self.seeds)
        counts = self.starts[seed + 1] - self.starts[seed]
        bounds = np.flatnonzero(np.diff(row, append=-1)) + 1
        begin = 0
        total = np.concatenate([[0], np.cumsum(counts)])
        while begin < len(row):
            # whole rows, about JOINED places at a time
            stop = int(bounds[min(np.searchsorted(total[bounds], total[begin] + JOINED), len(bounds) - 1)])
            n = counts[begin:stop]
            at = np.repeat(self.starts[seed[begin:stop]] - np.cumsum(n) + n, n) + np.arange(n.sum())
            own, item, place = np.repeat(row[begin:stop], n), self.item[at], self.place[at]
            order = np.lexsort((place, item, own))
            own, item, place = own[order], item[order], place[order]
            last = (np.diff(own, append=-1) != 0) | (np.diff(item, append=-1) != 0)
            words = np.where(last, self.n, np.minimum(np.diff(place, append=0), self.n))
            firsts = np.flatnonzero(np.concatenate([[True], last[:-1]]))
            covered = np.add.reduceat(words, firsts)
            enough = covered >= coverage * sizes[item[firsts]]
            out += zip(own[firsts][enough].tolist(), item[firsts][enough].tolist())
            begin = stop
        return out


class Benchmark:
    """Items of one block, as hashed words with seeds: what a worker needs to test documents."""

    def __init__(self, ids: list, texts: list[bytes], min_tile: int = MIN_TILE):
        words, counts = hashed_words(texts, PUNCT)
        ends = np.cumsum(counts)
        self.ids = ids
        self.items = [words[e - c : e] for e, c in zip(ends, counts)]
        self.sizes = np.array([len(x) for x in self.items], np.int64)
        lengths = sorted({min(min_tile, len(x)) for x in self.items if len(x)})
        self.tables = [_Seeds(self.items, [i for i, x in enumerate(self.items) if min(min_tile, len(x)) == n], n) for n in lengths]

    def matches(self, rows: list[bytes], coverage: float = COVERAGE):
        """(row, item index, tiles) of every pair whose tiles cover enough of the item."""
        words, counts = hashed_words(rows, PUNCT)
        ends = np.cumsum(counts)
        out = []
        for table in self.tables:
            row, seed, near = table.found(words, ends)
            if not len(row):
                continue
            for r, i in table.candidates(row, seed, self.sizes, coverage):
                target, first = self.items[i], int(ends[r] - counts[r])
                a, b = np.searchsorted(row, r), np.searchsorted(row, r, "right")
                spots = near[a:b][np.isin(seed[a:b], table.of_item[i])] - first
                open_doc = _covered(spots, table.n, int(counts[r]))
                keep = np.flatnonzero(open_doc)
                # seeded stretches side by side, one closed word between them
                gaps = np.flatnonzero(np.diff(keep) > 1) + 1
                short = np.insert(keep, gaps, -1)
                doc = words[first : first + counts[r]][short]
                found = tiles(doc, target, short >= 0, table.n)
                if sum(k for _, _, k in found) >= coverage * len(target):
                    out.append((r, i, [(int(short[a]), b, k) for a, b, k in found]))
        return sorted(out, key=lambda x: x[:2])


def _covered(starts, n: int, size: int) -> np.ndarray:
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, np.asarray(starts), 1)
    np.add.at(steps, np.asarray(starts) + n, -1)
    return np.cumsum(steps)[:size] > 0


def benchmark_blocks(benchmark: DataFrame, text="text", item_id="item_id", min_tile: int = MIN_TILE, block_bytes: int = BLOCK_BYTES):
    """The benchmark in blocks of about ``block_bytes`` of text, each broadcast when it is its turn."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(text).cast("binary").alias("text")).filter("text IS NOT NULL")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    for b in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        yield spark.sparkContext.broadcast(Benchmark([r[0] for r in rows], [bytes(r[1]) for r in rows], min_tile))


def _matched(batches, shared, coverage, item_type):
    for batch in batches:
        for rows in slices(batch, "text"):
            own = shared.value
            found = own.matches(byte_rows(rows.column("text")), coverage)
            at = pa.array([r for r, _, _ in found], pa.int32())
            count = [sum(k for _, _, k in spans) for _, _, spans in found]
            size = [len(own.items[i]) for _, i, _ in found]
            spans = [[dict(zip(("doc_start", "item_start", "words"), s)) for s in spans] for _, _, spans in found]
            kind = pa.list_(pa.struct([("doc_start", pa.int32()), ("item_start", pa.int32()), ("words", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id").take(at), pa.array([own.ids[i] for _, i, _ in found], item_type), pa.array(size, pa.int32()), pa.array(count, pa.int32()),
                 pa.array([c / s for c, s in zip(count, size)], pa.float64()), pa.array(spans, kind)],
                ["doc_id", "item_id", "item_words", "matched_words", "coverage", "tiles"],
            )


def leaks(docs: DataFrame, benchmark: DataFrame, text="text", doc_id="doc_id", item_text="text", item_id="item_id", coverage=COVERAGE, min_tile=MIN_TILE, block_bytes=BLOCK_BYTES) -> DataFrame:
    """One row (doc_id, item_id, item_words, matched_words, coverage, tiles) for each leaked pair.

    Words are runs of ASCII letters and digits and of all other non-ASCII
    characters, lower-cased over A-Z.  Items of fewer words than a tile must
    stand whole.  Null and wordless texts on either side match nothing, repeated
    rows are each reported, null ids are kept, and an empty table on either side
    gives no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = benchmark.schema[item_id].dataType
    schema = T.StructType([chosen.schema["doc_id"], T.StructField("item_id", kind)]).add("item_words", "integer").add("matched_words", "integer").add("coverage", "double")
    schema = schema.add("tiles", T.ArrayType(T.StructType().add("doc_start", "integer").add("item_start", "integer").add("words", "integer")))
    out = None
    for shared in benchmark_blocks(benchmark, item_text, item_id, min_tile, block_bytes):
        part = chosen.mapInArrow(lambda batches, s=shared: _matched(batches, s, coverage, to_arrow_type(kind)), schema)
        out = part if out is None else out.unionByName(part)
    return out


def _clean(batches, shared, coverage, column):
    for batch in batches:
        for rows in slices(batch, column):
            bad = {r for r, _, _ in shared.value.matches(byte_rows(rows.column(column)), coverage)}
            yield rows.filter(pa.array([i not in bad for i in range(rows.num_rows)]))
    release_memory()


def decontaminated(docs: DataFrame, benchmark: DataFrame, text="text", item_text="text", item_id="item_id", coverage=COVERAGE, min_tile=MIN_TILE, block_bytes=BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that leak no item; nothing is shuffled."""
    for shared in benchmark_blocks(benchmark, item_text, item_id, min_tile, block_bytes):
        docs = docs.mapInArrow(lambda batches, s=shared: _clean(batches, s, coverage, text), docs.schema)
    return docs


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold four fifths or more of a benchmark item, with the item; null texts hold none."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", "item_words", "matched_words", "coverage", F.size("tiles").alias("n_tiles"))
