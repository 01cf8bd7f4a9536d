"""Alignment of two tokenizers over the same bytes, in Arrow tables.

A slice of documents is tokenised both ways.  The ids are list columns: they
are flattened, their byte lengths looked up and summed along the slice, which
gives each token the place at which it ends.  As both tokenizers spell the
same bytes, the place is a key of (document, end): a full outer Acero join of
the two sides on it gives the slice's cuts in order.  Each stretch between two
cuts is one link, of the A token and the B token that go on at it; a cut that
both sides have ends a group.

Links are counted in blocks of documents by ``Table.group_by``.  Spark adds the
blocks' partial counts, finds each B id's highest, and joins the sums back to
the blocks' lists of id pairs.  Documents meet their block's sums in a cogroup
of bounded size and never travel link by link.
"""

from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.common import arrow_rows, release_memory, scratch_path, slices
from folioscope.llm.token_ids import Encoder

BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text that are tokenised at once, and that make a block; a longer text is a block of its own.
SLICE_BYTES = 1 << 20
BLOCK_BYTES = 8 << 20
#: Rows of an Arrow batch.
BATCH_ROWS = 2_000
#: Words whose B ids a worker remembers, and words that are encoded in one call.
MEMORY = 300_000
CALL = 5_000
#: A pair of ids is held as a << PAIR_BITS | b.
PAIR_BITS = 24


def byte_level_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible ones for themselves, the others from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


def byte_level_bytes(encoder: Encoder) -> list[bytes]:
    """Bytes of each id of a byte-level tokenizer."""
    alphabet = byte_level_alphabet()
    names = (encoder.tokenizer.id_to_token(i) or "" for i in range(encoder.tokenizer.get_vocab_size()))
    return [b"".join(bytes([alphabet[c]]) if c in alphabet else c.encode() for c in name) for name in names]


class PieceEncoder:
    """Ids of a SentencePiece model, equal to the library's own.

    Where no piece has a space mark after another character, nothing merges
    across a space that follows a word, so words are encoded apart and
    remembered.  Texts with a space at either end or two in a row, texts that
    hold the mark itself, and models of another kind go to the library whole.
    """

    SPACE = "▁"

    def __init__(self, path: str, memory: int = MEMORY):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.apart = not any(self.SPACE in name.lstrip(self.SPACE) for name in self.names) and self.model.encode("a b") == [*self.model.encode("a"), *self.model.encode("b")]
        self.begins = np.array([name.startswith(self.SPACE) for name in self.names])
        self.memory = memory
        self.known = pa.array([], pa.string())
        self.flat, self.sizes, self.starts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def bytes(self) -> list[bytes]:
        """Bytes of each id."""
        return [bytes([int(n[3:-1], 16)]) if self.model.is_byte(i) else n.replace(self.SPACE, " ").encode() for i, n in enumerate(self.names)]

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.int32) for x in self.model.encode(texts, num_threads=1)]

    def _words(self, words: list[str]):
        """Ids of words, in one array, and how many each has; a word's ids begin with the one that holds its space."""
        for i in range(0, len(words), CALL):
            ids = self._library([" ".join(words[i : i + CALL])])[0]
            yield ids, np.diff(np.append(np.flatnonzero(self.begins[ids]), len(ids)))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (none null) one after another, and how many each has."""
        doubtful = pc.match_substring_regex(texts, "^ |  | $|^$|" + self.SPACE) if self.apart else pa.array(np.ones(len(texts), bool))
        doubtful = doubtful.to_numpy(zero_copy_only=False)
        plain = texts.filter(pa.array(~doubtful))
        cut = pc.split_pattern(plain, " ")
        coded = cut.flatten().dictionary_encode()
        place = pc.fill_null(pc.index_in(coded.dictionary, value_set=self.known), -1).to_numpy().copy()
        new = np.flatnonzero(place < 0)
        fresh = coded.dictionary.take(pa.array(new))
        ids, sizes = (np.concatenate([np.zeros(0, t), *x]) for t, x in zip((np.int32, np.int64), [*zip(*self._words(fresh.to_pylist()))] or [(), ()]))
        place[new] = len(self.known) + np.arange(len(new))
        flat, size, start = np.append(self.flat, ids), np.append(self.sizes, sizes), np.append(self.starts, len(self.flat) + np.cumsum(sizes) - sizes)
        if len(self.known) < self.memory:
            self.known, self.flat, self.sizes, self.starts = pa.concat_arrays([self.known, fresh]), flat, size, start
        at = place[coded.indices.to_numpy()]
        n = size[at]
        before = np.cumsum(n) - n
        out = flat[np.repeat(start[at] - before, n) + np.arange(n.sum())]
        bounds = cut.offsets.to_numpy().astype(np.int64)
        ends = np.append(0, np.cumsum(n))
        counts = np.zeros(len(texts), np.int64)
        counts[~doubtful] = np.diff(ends[bounds - bounds[0]])
        if doubtful.any():
            whole = self._library(texts.filter(pa.array(doubtful)).to_pylist())
            parts = np.empty(len(texts), object)
            parts[:] = [None] * len(texts)
            parts[np.flatnonzero(~doubtful)] = _pieces(out, counts[~doubtful])
            parts[np.flatnonzero(doubtful)] = _pieces(np.concatenate(whole), [len(x) for x in whole])
            counts[doubtful] = [len(x) for x in whole]
            out = np.concatenate(parts)
        return out.astype(np.int32), counts


def _pieces(flat: np.ndarray, sizes) -> np.ndarray:
    out = np.empty(len(sizes), object)
    out[:] = np.split(flat, np.cumsum(sizes)[:-1]) if len(sizes) else []
    return out


class Tokenizers:
    """Both tokenizers with the bytes of their ids."""

    def __init__(self, byte_level: str, pieces: str):
        self.a, self.b = Encoder(byte_level, plain_specials=True), PieceEncoder(pieces)
        spelled = byte_level_bytes(self.a), self.b.bytes()
        self.a_bytes, self.b_bytes = (pa.array(x, pa.binary()) for x in spelled)
        self.a_sizes, self.b_sizes = (np.fromiter(map(len, x), np.int64, len(x)) for x in spelled)


_loaded: dict[tuple, Tokenizers] = {}


def tokenizers_of(byte_level: str, pieces: str) -> Tokenizers:
    """The tokenizers of two files, loaded once a worker."""
    key = (byte_level, pieces)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Tokenizers(*key)
    return _loaded[key]


def _lists(values, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), values if isinstance(values, pa.Array) else pa.array(values))


def _chosen(ids: np.ndarray, counts: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return ids[np.repeat(keep, counts)], counts[keep]


def aligned(texts: pa.Array, t: Tokenizers) -> tuple[np.ndarray, dict[str, np.ndarray], np.ndarray, np.ndarray, list[str]]:
    """Which texts have tokens; of those n_a, n_b, n_groups and n_links; the id pair of every link and its text's number among them; the groups' hashes.

    A text has none where it is null or empty, or where either tokenizer's
    bytes are not those of the text with a space before it.
    """
    live = pc.fill_null(pc.greater(pc.binary_length(texts), 0), False).to_numpy(zero_copy_only=False).copy()
    some = texts.filter(pa.array(live))
    (a, n_a), (b, n_b) = t.a.encode(some, spaced=True), t.b.encode(some)
    a = a.astype(np.int32)
    spelled = pc.binary_join_element_wise("", some, " ").cast(pa.binary())
    same = np.ones(len(some), bool)
    for ids, sizes, table in ((a, n_a, t.a_bytes), (b, n_b, t.b_bytes)):
        same &= pc.equal(pc.binary_join(_lists(table.take(pa.array(ids)), sizes), b""), spelled).to_numpy(zero_copy_only=False)
    live[live] = same
    (a, n_a), (b, n_b) = _chosen(a, n_a, same), _chosen(b, n_b, same)
    docs = len(n_a)
    if not docs:
        return live, {k: np.zeros(0, np.int64) for k in ("n_a", "n_b", "n_groups", "n_links")}, np.zeros(0, np.int64), np.zeros(0, np.int64), []
    # ends along the slice: equal bytes on both sides make them keys of (document, end)
    a_ends, b_ends = np.cumsum(t.a_sizes[a]), np.cumsum(t.b_sizes[b])
    left = pa.table({"end": a_ends, "a": a, "a_no": np.arange(len(a))})
    right = pa.table({"end": b_ends, "b": b, "b_no": np.arange(len(b))})
    cuts = left.join(right, keys="end", join_type="full outer", use_threads=False).sort_by("end")
    shared = pc.and_(pc.is_valid(cuts["a"]), pc.is_valid(cuts["b"])).to_numpy(zero_copy_only=False)
    on_a, on_b = (pc.fill_null_backward(cuts[x]).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64) for x in ("a", "b"))
    doc_ends = a_ends[np.cumsum(n_a) - 1]
    doc = np.searchsorted(doc_ends, cuts["end"].to_numpy())
    counts = {"n_a": n_a, "n_b": n_b, "n_groups": np.bincount(doc[shared], minlength=docs), "n_links": np.bincount(doc, minlength=docs)}
    # a group holds what lies between two shared cuts
    groups = []
    for ids, column in ((a, "a_no"), (b, "b_no")):
        last = cuts[column].to_numpy(zero_copy_only=False)[shared].astype(np.int64)
        groups.append(pc.binary_join(_lists(pa.array(ids).cast(pa.string()), np.diff(last, prepend=-1)), ","))
    lines = pc.binary_join(_lists(pc.binary_join_element_wise(*groups, "|"), counts["n_groups"]), ";")
    digests = [hashlib.sha256(x).hexdigest() for x in lines.cast(pa.binary()).to_pylist()]
    return live, counts, on_a << PAIR_BITS | on_b, doc, digests


_FIGURES = ("n_a", "n_b", "n_groups", "n_links")


def _block(number: int, parts: list, doc_type: pa.DataType) -> pa.RecordBatch:
    """Rows of a block's documents, and one row with its id pairs and their partial counts."""
    ids = pa.concat_arrays([p[0] for p in parts])
    live = np.concatenate([p[1] for p in parts])
    figures = {k: np.zeros(len(ids) + 1, np.int64) for k in _FIGURES}
    for k in _FIGURES:
        figures[k][:-1][live] = np.concatenate([p[2][k] for p in parts])
    digests = np.full(len(ids) + 1, "", object)
    digests[:-1][live] = [x for p in parts for x in p[5]]
    pairs = pa.concat_arrays([pa.array(p[3]) for p in parts]).dictionary_encode()
    shift = np.cumsum([0, *(int(p[1].sum()) for p in parts)])
    doc = np.concatenate([p[4] + s for p, s in zip(parts, shift)])
    links = pa.table({"doc": doc, "code": pairs.indices})
    by_doc = links.group_by(["doc", "code"], use_threads=False).aggregate([([], "count_all")]).sort_by("doc")
    total = links.group_by("code", use_threads=False).aggregate([([], "count_all")]).sort_by("code")
    sizes = np.zeros(len(ids) + 1, np.int64)
    sizes[:-1][live] = np.bincount(by_doc["doc"].to_numpy(), minlength=int(live.sum()))
    n = len(ids)
    last = np.append(np.zeros(n, np.int64), len(pairs.dictionary))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(n + 1, number)), pa.array(np.arange(n + 1) < n), pa.concat_arrays([ids, pa.nulls(1, doc_type)]), *(pa.array(figures[k]) for k in _FIGURES), pa.array(digests.tolist(), pa.string()),
            _lists(by_doc["code"].combine_chunks().cast(pa.int32()), sizes), _lists(by_doc["count_all"].combine_chunks().cast(pa.int32()), sizes),
            _lists(pairs.dictionary, last), _lists(total["count_all"].combine_chunks().cast(pa.int64()), last),
        ],
        ["block", "is_doc", "doc_id", *_FIGURES, "groups_sha256", "codes", "times", "pairs", "counts"],
    )


def _blocks(batches, byte_level: str, pieces: str):
    t = tokenizers_of(byte_level, pieces)
    number, parts, held = TaskContext.get().partitionId() << 32, [], 0
    kind = None
    for batch in batches:
        kind = batch.column("doc_id").type
        for rows in slices(batch, "text", SLICE_BYTES):
            parts.append((rows.column("doc_id"), *aligned(rows.column("text"), t)))
            held += rows.column("text").nbytes
            if held >= BLOCK_BYTES:
                yield _block(number, parts, kind)
                number, parts, held = number + 1, [], 0
                release_memory()
    if parts:
        yield _block(number, parts, kind)
    release_memory()


def _summed(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """Documents of a block with the sums over their links; ``pairs`` has the corpus's count of each of the block's id pairs."""
    size = len(pairs)
    count, best = np.zeros(size, np.int64), np.zeros(size, bool)
    code = pairs["code"].to_numpy()
    count[code], best[code] = pairs["total"].to_numpy(), pairs["is_best"].to_numpy(zero_copy_only=False)
    lists, times = docs["codes"].combine_chunks(), docs["times"].combine_chunks()
    code, times = lists.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
    ends = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))
    sums = {}
    for name, weight in (("n_best", best[code].astype(np.int64)), ("count_sum", count[code])):
        running = np.append(0, np.cumsum(weight * times))
        sums[name] = running[ends[1:]] - running[ends[:-1]]
    return pa.table({"doc_id": docs["doc_id"], **{k: docs[k] for k in _FIGURES}, **sums, "groups_sha256": docs["groups_sha256"]})


def align(docs: DataFrame, text="text", doc_id="doc_id", byte_level: str | None = None, pieces: str | None = None) -> DataFrame:
    """One row a document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A (``byte_level``) encodes the text with a space before it, B (``pieces``)
    adds that space itself; strings of special tokens are plain text.  A link
    is a pair of tokens whose bytes overlap; the count of a pair of ids is the
    number of such links in all documents; ``n_best`` counts the links whose
    count is the highest of their B id, ties included.  A null or empty text,
    and one that a tokenizer does not spell byte for byte, has zeros and an
    empty hash.  Null ids, repeated ids and repeated rows are documents like
    others, each counted.  Other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    files = (byte_level or public_tokenizers.path(BYTE_LEVEL), pieces or public_tokenizers.path(PIECES))
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    figures = ", ".join(f"{k} long" for k in _FIGURES)
    schema = f"block long, is_doc boolean, doc_id {kind}, {figures}, groups_sha256 string, codes array<int>, times array<int>, pairs array<long>, counts array<long>"
    path = scratch_path(spark, "crosstoken")
    with arrow_rows(spark, BATCH_ROWS):
        chosen.mapInArrow(lambda batches: _blocks(batches, *files), schema).write.option("compression", "zstd").parquet(path)
    parts = spark.read.parquet(path).filter("NOT is_doc").select("block", F.posexplode(F.arrays_zip("pairs", "counts")).alias("code", "x")).select("block", "code", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))
    total = parts.groupBy("pair").agg(F.sum("n").alias("total")).withColumn("b", F.col("pair").bitwiseAND((1 << PAIR_BITS) - 1))
    best = total.groupBy("b").agg(F.max("total").alias("most"))
    total = total.join(best, "b").select("pair", "total", (F.col("total") == F.col("most")).alias("is_best"))
    known = parts.select("block", "code", "pair").join(total, "pair").select("block", "code", "total", "is_best")
    rows = spark.read.parquet(path).filter("is_doc").select("block", "doc_id", *_FIGURES, "groups_sha256", "codes", "times")
    out = T.StructType([T.StructField("doc_id", chosen.schema["doc_id"].dataType), *(T.StructField(k, T.LongType()) for k in (*_FIGURES, "n_best", "count_sum")), T.StructField("groups_sha256", T.StringType())])
    return rows.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_summed, out)


def op13_crosstoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of every document's tokens; see :func:`align`."""
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
