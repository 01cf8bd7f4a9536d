"""What the corpus operators share: shared folders, sizes, byte-level words."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of text are taken from Arrow batches in slices of about so many bytes.
SLICE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset a temporary folder is made, in local mode only.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        base = tempfile.mkdtemp(prefix="folioscope-")
        spark.conf.set("spark.checkpoint.dir", base)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows with their lineage cut, kept in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def source_bytes(df: DataFrame, text: str) -> int:
    """Bytes of the input: the planner's figure of its files' sizes, or else summed text lengths."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    if size < 1 << 55:
        return size
    return df.select(F.sum(F.octet_length(F.col(text))).alias("n")).first()["n"] or 0


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that the frame does not have."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name = f"_{name}"
    return name


def crc_mod(doc_id: str, n: int = 5) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(n)).cast("int")


def release_memory() -> None:
    """Hands freed memory back to the system: workers live on, and the next task may need another kind of it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim:
        trim(0)


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Holds the session's Arrow batches to so many rows while a job runs, and puts its setting back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def byte_rows(array: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in array.cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES):
    """Cuts a batch into runs of rows of about ``limit`` bytes of text, one row at least."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


# -- words as 64-bit hashes -------------------------------------------------

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of `[\x20\x09-\x0D]`.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes outside `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` once A-Z are lower case.
PUNCT = np.zeros(256, bool)
PUNCT[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

_BASE = 0x9E3779B97F4A7C13  # odd, 3 modulo 8
_INVERSE = pow(_BASE, -1, 1 << 64)
_tables = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            out = np.full(n, base, np.uint64)
            out[0] = 1
            _tables[i] = np.multiply.accumulate(out)
    return _tables[0], _tables[1]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 over unsigned 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_bytes(word: bytes) -> int:
    """The hash that :func:`hashed_words` gives to one word (already lower case)."""
    return int(hashed_words([word], np.zeros(256, bool))[0][0])


def hashed_words(rows: list[bytes], breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the rows, lower-cased over A-Z, and the words of each row.

    ``breaks`` marks the bytes that are not part of a word.  A word's hash is
    a polynomial in its bytes, read off prefix sums and then mixed, so it
    depends on the word alone.  Rows are taken SLICE_BYTES at a time, as the
    sums need some 50 bytes for each.
    """
    parts, start, size = [], 0, 0
    for i, row in enumerate(rows):
        if size and size + len(row) > SLICE_BYTES:
            parts.append(_hashed(rows[start:i], breaks))
            start, size = i, 0
        size += len(row) + 1
    if start < len(rows):
        parts.append(_hashed(rows[start:], breaks))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts)) if len(parts) > 1 else parts[0]


def _hashed(rows: list[bytes], breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter((len(r) + 1 for r in rows), np.int64, len(rows))
    data = _LOWER[np.frombuffer(b"\n".join(rows) + b"\n", np.uint8)]
    inside = ~breaks[data]
    row_ends = np.cumsum(lengths)
    inside[row_ends - 1] = False
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    starts, ends = edges[::2], edges[1::2]
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    weighed = data.astype(np.uint64)
    weighed += np.uint64(1)
    weighed *= up[: len(data)]
    np.cumsum(weighed, out=sums[1:])
    hashes = mix64((sums[ends] - sums[starts]) * down[starts])
    return hashes, np.diff(np.searchsorted(starts, row_ends), prepend=0)
