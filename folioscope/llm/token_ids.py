"""Token ids in Parquet: list columns, delta or dictionary encoded, in order of document.

Texts are dealt out by ranges of the id, so that each file holds a run of
documents and the files follow one another.  A file's ids are a list column in
version 2 pages (dictionary while that is small, then delta encoded), in row
groups of a stated size, with the page and offset indexes that let a reader
take some documents, or only the metadata columns, without the ids.
"""

from __future__ import annotations

import os
import sys
import zlib
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from folioscope.llm.common import arrow_rows, release_memory, scratch_path, slices, source_bytes

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
#: Input bytes that go to one file, and files at most: of a larger corpus the files are longer.
FILE_BYTES = 16 << 20
MOST_FILES = 20_000
#: Bytes of a row group and of a page.
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 1 << 20
#: Pieces whose ids a worker remembers.
MEMORY = 400_000
#: Pieces that are encoded in one call.
CALL = 5_000
#: Bytes of text that are encoded at once.
SLICE_BYTES = 3 << 20
#: Rows of an Arrow batch while ids are written.
BATCH_ROWS = 2_000


def _little_endian(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


class Encoder:
    """Token ids of texts, equal to the tokenizer's own.

    A byte-level BPE cuts before a single space that stands before a visible
    character, around a line feed between such, and between a letter or digit
    and one full stop or comma that a blank follows, whatever else the text
    holds.  Between those cuts pieces are encoded apart and their ids
    remembered.  Texts in which a cut might not hold, and tokenizers of any
    other kind, go to the library whole.
    """

    #: Marks a piece that no space stands before.
    MARK = "\x00"
    #: What surely counts as a letter or digit before a full stop or comma.
    ENDS = r"[A-Za-z0-9\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}\x{400}-\x{481}\x{48A}-\x{52F}\x{4E00}-\x{9FA5}\x{3041}-\x{3096}]$"

    def __init__(self, path: str, memory: int = MEMORY, plain_specials: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallel unit
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        pre = self.tokenizer.pre_tokenizer
        plain = type(pre).__name__ == "ByteLevel" and not pre.add_prefix_space and pre.use_regex and self.tokenizer.normalizer is None
        #: Pieces, and where in ``flat`` their ids stand.
        self.known = pa.array([], pa.string()) if plain else None
        self.flat, self.sizes, self.starts = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.memory = memory
        #: By id, whether its bytes begin with a space, which a byte-level BPE writes as U+0120.
        self.begins = np.array([(self.tokenizer.id_to_token(i) or "").startswith("\u0120") for i in range(self.tokenizer.get_vocab_size())])

    def _library(self, texts: list[str]) -> list[bytes]:
        return [_little_endian(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _apart(self, pieces: list[str]):
        """Ids by piece.  Pieces with a space before them are encoded as one text and cut where an id begins with a space."""
        bare = [p for p in pieces if p[0] == self.MARK]
        yield from zip(bare, self._library([p[1:] for p in bare]))
        rest = [p for p in pieces if p[0] != self.MARK]
        for i in range(0, len(rest), CALL):
            some = rest[i : i + CALL]
            packed = self._library([" " + " ".join(some)])[0]
            at = np.flatnonzero(self.begins[np.frombuffer(packed, "<u4")]) * 4
            ends = [*at[1:].tolist(), len(packed)]
            yield from zip(some, map(packed.__getitem__, map(slice, at.tolist(), ends)), strict=True)

    def encode(self, texts: pa.Array, spaced: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has; a null text is empty.

        With ``spaced`` each text is encoded with one space before it.
        """
        texts = pc.fill_null(texts, "")
        lead = " " if spaced else ""
        if self.known is None or not len(texts):
            ids = self._library([lead + x for x in texts.to_pylist()])
            return np.frombuffer(b"".join(ids), "<u4"), np.array([len(x) // 4 for x in ids], np.int64)
        m = self.MARK
        cut = texts if spaced else pc.binary_join_element_wise(pa.scalar(m), texts, "")
        for old, new in ((". ", f" {m}. "), (", ", f" {m}, "), (".\n", f" {m}.\n"), ("\n", f" {m}\n {m}")):
            cut = pc.replace_substring(cut, old, new)
        cut = pc.split_pattern(cut, " ")
        bounds = cut.offsets.to_numpy().astype(np.int64)
        coded = cut.flatten().dictionary_encode()
        at, pieces = coded.indices.to_numpy(), coded.dictionary
        place = pc.fill_null(pc.index_in(pieces, value_set=self.known), -1).to_numpy()
        missing = np.flatnonzero(place < 0)
        names = pieces.take(pa.array(missing)).to_pylist()
        # a piece that is empty, or blank at either end where it is not a line feed alone, touches another blank
        apart = np.array([not p or p == m or p != m + "\n" and (p.strip(m)[:1].isspace() or p[-1].isspace()) for p in names], bool)
        new = missing[~apart]
        found = dict(self._apart([p for p, x in zip(names, apart.tolist()) if not x]))
        ids = [found[p] for p, x in zip(names, apart.tolist()) if not x]
        sizes, starts = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        seen = place >= 0
        sizes[seen], starts[seen] = self.sizes[place[seen]], self.starts[place[seen]]
        sizes[new] = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        starts[new] = len(self.flat) + np.cumsum(sizes[new]) - sizes[new]
        flat = np.concatenate([self.flat, np.frombuffer(b"".join(ids), "<u4")])
        if len(self.known) < self.memory:
            self.known = pa.concat_arrays([self.known, pieces.take(pa.array(new))])
            self.flat, self.sizes, self.starts = flat, np.append(self.sizes, sizes[new]), np.append(self.starts, starts[new])
        doubtful = np.zeros(len(pieces), bool)
        doubtful[missing[apart]] = True
        stop = pc.is_in(pieces, value_set=pa.array([m + ".", m + ","])).to_numpy(zero_copy_only=False)
        firm = pc.match_substring_regex(pieces, self.ENDS).to_numpy(zero_copy_only=False)
        bad = doubtful[at]
        bad[1:] |= stop[at[1:]] & ~firm[at[:-1]]
        whole = np.add.reduceat(bad, bounds[:-1]) > 0
        whole |= pc.match_substring(texts, m).to_numpy(zero_copy_only=False)

        size = sizes[at]
        before = np.cumsum(size) - size
        out = flat[np.repeat(starts[at] - before, size) + np.arange(size.sum())]
        counts = np.add.reduceat(size, bounds[:-1])
        if whole.any():
            chosen = np.flatnonzero(whole)
            parts = np.split(out, np.cumsum(counts)[:-1])
            for i, x in zip(chosen.tolist(), self._library([lead + x for x in texts.take(pa.array(chosen)).to_pylist()])):
                parts[i] = np.frombuffer(x, "<u4")
            out, counts = np.concatenate(parts), np.array([len(x) for x in parts])
        return out, counts


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _encoded(batches, path: str, end_id: int):
    """(doc_id, part, text) of one file to (doc_id, part, row, n_tokens, ids)."""
    done = 0
    for batch in batches:
        for rows in slices(batch, "text", SLICE_BYTES):
            ids, counts = _encoder(path).encode(rows.column("text"))
            ids = np.insert(ids, np.cumsum(counts), end_id)
            sizes = (counts + 1).astype(np.int32)
            offsets = np.zeros(len(sizes) + 1, np.int32)
            np.cumsum(sizes, out=offsets[1:])
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.view("<i4")))
            row = pa.array(np.arange(done, done + len(sizes)))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("part"), row, pa.array(sizes), lists], ["doc_id", "part", "row", "n_tokens", "ids"])
            done += len(sizes)
            del rows, ids, lists
        release_memory()
    release_memory()


def write_token_ids(docs: DataFrame, path: str, text="text", doc_id="doc_id", vocabulary: str | None = None, end_id: int = END_ID) -> None:
    """Writes (doc_id, part, row, n_tokens, ids) of all rows in ascending order of id, nulls first.

    ``part`` numbers the files and ``row`` the rows of a file from 0.  Rows that repeat an id stand side by side in
    order of their text's hash; a null text is empty and yields the end id alone.
    Other columns are not written.  Spark's writer commits files as tasks end,
    so a lost executor leaves no half-written file.
    """
    vocabulary = vocabulary or public_tokenizers.path(VOCABULARY)
    parts = max(1, min(MOST_FILES, -(-source_bytes(docs, text) // FILE_BYTES)))
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = chosen.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    ordered = ordered.select("doc_id", F.spark_partition_id().alias("part"), "text")
    schema = T.StructType([chosen.schema["doc_id"], T.StructField("part", T.IntegerType()), T.StructField("row", T.LongType()), T.StructField("n_tokens", T.IntegerType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])
    writer = ordered.mapInArrow(lambda batches: _encoded(batches, vocabulary, end_id), schema).write.option("compression", "zstd")
    writer = writer.option("parquet.writer.version", "v2").option("parquet.block.size", ROW_GROUP_BYTES).option("parquet.page.size", PAGE_BYTES)
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        writer.parquet(path)


def _summed(batches):
    """(doc_id, part, row, ids) to (doc_id, part, row, n_tokens, ids_crc32)."""
    for batch in batches:
        lists = batch.column("ids")
        offsets = lists.offsets.to_numpy().astype(np.int64) * 4
        data = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
        sums = [zlib.crc32(data[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("part"), batch.column("row"), pa.array(np.diff(offsets) // 4), pa.array(sums, pa.int64())], ["doc_id", "part", "row", "n_tokens", "ids_crc32"]
        )


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, part, row, n_tokens, ids) of the files; filters and columns are pushed into the reader."""
    return spark.read.parquet(path)


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the ids in the files.

    ``start`` counts the ids of all rows before in the files, so it is the
    place of a row's ids also where ids repeat.  It is a running sum in
    each file, plus the sum of the files before, of which there is one row a file.
    """
    files = read_token_ids(spark, path).select("doc_id", "part", "row", "ids")
    schema = T.StructType([files.schema["doc_id"], T.StructField("part", T.IntegerType()), T.StructField("row", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    rows = files.mapInArrow(_summed, schema)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = read_token_ids(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("total"))
    starts = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(starts, "part")
    return rows.select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def encode_documents(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Writes the documents' ids and reads them back as :func:`token_index`."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "token-ids")
    write_token_ids(docs, path, **options)
    return token_index(spark, path)


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions, lengths and checksums of all documents' ids, from the files."""
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
