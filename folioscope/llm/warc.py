"""WARC archives compressed by Zstandard, one frame a record, with a dictionary.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the
dictionary; every record is a frame of its own after it.  The writer trains a
dictionary on records of the archive.  The reader takes the dictionary from
the leading frame, walks from frame to frame by their block headers, decodes
each alone, and checks version, required headers, block length, record end,
HTTP length and payload digest.  Archives are rows (path, content), as
Spark's `binaryFile` reader gives them for .warc.zst files.
"""

from __future__ import annotations

import hashlib
import re
import struct

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.common import scratch_path, slices

#: Payload bytes under which equal payloads are not linked.
LEAST_LINKED = 100
#: Uncompressed bytes after which an archive is closed; bytes of its dictionary and of the records that train it.
ARCHIVE_BYTES = 4 << 20
DICTIONARY_BYTES = 32 << 10
TRAINING_BYTES = 1 << 20
LEVEL = 3
DATE = "2000-01-01T00:00:00Z"

# Magic numbers of the Zstandard and WARC-Zstandard formats, and the revisit profile.
DICTIONARY_FRAME = 0x184D2A5D
FRAME = 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("WARC-Record-ID", "Content-Length", "WARC-Date", "WARC-Type")

_CONTROL = re.compile(r"[\x00-\x20\x7f<>]")


class ArchiveError(ValueError):
    """What is wrong with an archive, and at which byte."""


# -- records -----------------------------------------------------------------


def record_bytes(record_id: str, uri: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One record: a response with its payload, or a revisit with its HTTP headers alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    uri = _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", uri or "about:blank")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers, HTTP head and payload of one record, checked."""
    head, found, rest = data.partition(b"\r\n\r\n")
    if not found:
        raise ArchiveError("headers do not end")
    version, *lines = head.decode().split("\r\n")
    if version not in ("WARC/1.0", "WARC/1.1"):
        raise ArchiveError(f"unknown version {version[:20]!r}")
    headers = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise ArchiveError(f"not a header: {line[:40]!r}")
        headers[name.strip()] = value.strip()
    if missing := [n for n in REQUIRED if n not in headers]:
        raise ArchiveError(f"no {missing[0]}")
    if not headers["Content-Length"].isdigit() or len(rest) != int(headers["Content-Length"]) + 4:
        raise ArchiveError(f"Content-Length {headers['Content-Length']} but {len(rest) - 4} bytes")
    if not rest.endswith(b"\r\n\r\n"):
        raise ArchiveError("the record does not end in two line breaks")
    http, found, payload = rest[:-4].partition(b"\r\n\r\n")
    if not found:
        raise ArchiveError("HTTP headers do not end")
    if headers["WARC-Type"] == "response":
        length = re.search(rb"(?im)^content-length: *(\d+)\r?$", http)
        if length and int(length[1]) != len(payload):
            raise ArchiveError(f"HTTP length {int(length[1])} but {len(payload)} bytes")
        if (digest := headers.get("WARC-Payload-Digest", "")).startswith("sha256:") and digest[7:] != hashlib.sha256(payload).hexdigest():
            raise ArchiveError("payload and digest differ")
    return headers, http, payload


# -- archives ----------------------------------------------------------------


def archive_bytes(records: list[bytes]) -> bytes:
    """An archive of the records, with a dictionary trained on evenly spaced ones where there are enough."""
    size = sum(map(len, records))
    step = max(1, -(-size // TRAINING_BYTES))
    try:
        dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, records[::step], level=LEVEL)
    except zstandard.ZstdError:  # too few or too short records; a raw dictionary serves as well
        dictionary = zstandard.ZstdCompressionDict(b"".join(r[:512] for r in records[:8]) or b"WARC/1.1", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    raw = dictionary.as_bytes()
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True)
    return b"".join([struct.pack("<II", DICTIONARY_FRAME, len(raw)), raw, *map(compressor.compress, records)])


def frame_end(data, at: int) -> int:
    """Where the frame that begins at ``at`` ends, by its header and its blocks' headers."""
    if len(data) < at + 5 or int.from_bytes(data[at : at + 4], "little") != FRAME:
        raise ArchiveError(f"no frame at byte {at}")
    flags = data[at + 4]
    single = flags >> 5 & 1
    size = (0, 2, 4, 8)[flags >> 6] or single
    at += 5 + (not single) + (0, 1, 2, 4)[flags & 3] + size
    last = False
    while not last:
        if at + 3 > len(data):
            raise ArchiveError("a frame is cut off")
        block = int.from_bytes(data[at : at + 3], "little")
        last = bool(block & 1)
        at += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
    at += 4 * (flags >> 2 & 1)
    if at > len(data):
        raise ArchiveError("a frame is cut off")
    return at


def read_archive(data: bytes):
    """(offset, headers, HTTP head, payload) of every record of an archive."""
    view = memoryview(data)
    if len(view) < 8 or struct.unpack_from("<I", view)[0] != DICTIONARY_FRAME:
        raise ArchiveError("no leading dictionary frame")
    at = 8 + struct.unpack_from("<I", view, 4)[0]
    if at > len(view):
        raise ArchiveError("the dictionary is cut off")
    raw = bytes(view[8:at])
    if raw[:4] == struct.pack("<I", FRAME):
        raw = zstandard.ZstdDecompressor().decompress(raw)
    decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    while at < len(view):
        end = frame_end(view, at)
        try:
            record = parse_record(decompressor.decompress(view[at:end]))
        except (ArchiveError, zstandard.ZstdError, UnicodeDecodeError) as error:
            raise ArchiveError(f"record at byte {at}: {error}") from error
        yield at, *record
        at = end


def _archived(batches):
    """(record_id, uri, payload, digest, refers_to) to archives (path, content)."""
    from pyspark import TaskContext

    def closed(records):
        nonlocal number
        number += 1
        return pa.RecordBatch.from_arrays([pa.array([f"part-{task:06d}-{number:05d}.warc.zst"]), pa.array([archive_bytes(records)], pa.binary())], ["path", "content"])

    task, number, records, size = TaskContext.get().partitionId(), 0, [], 0
    for batch in batches:
        for part in slices(batch, "payload"):
            for row in zip(*(part.column(c).to_pylist() for c in ("record_id", "uri", "payload", "digest", "refers_to"))):
                records.append(record_bytes(*row))
                size += len(records[-1])
                if size >= ARCHIVE_BYTES:
                    yield closed(records)
                    records, size = [], 0
    if records:
        yield closed(records)


def _records(batches, payloads: bool):
    """Archives (path, content) to their records."""
    names = ["path", "offset", "record_id", "record_type", "target_uri", "payload_bytes", "payload_digest", "refers_to", *(["payload"] if payloads else [])]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), *([pa.binary()] if payloads else [])]
    bare = lambda x: x[1:-1] if x and x[0] == "<" and x[-1] == ">" else x
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            rows = []
            try:
                for offset, headers, http, payload in read_archive(content.as_py()):
                    length = re.search(rb"(?im)^content-length: *(\d+)\r?$", http)
                    size = int(length[1]) if length else len(payload)
                    digest = headers.get("WARC-Payload-Digest", "").removeprefix("sha256:") or None
                    rows.append((path, offset, bare(headers["WARC-Record-ID"]), headers["WARC-Type"], headers.get("WARC-Target-URI"), size, digest, bare(headers.get("WARC-Refers-To")), *([payload] if payloads else [])))
            except ArchiveError as error:
                raise ArchiveError(f"{path}: {error}") from error
            columns = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def read_records(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of archives given as rows (path, content).

    A damaged archive ends the read with an error that names the archive and the byte.
    """
    schema = T.StructType().add("path", "string").add("offset", "long").add("record_id", "string").add("record_type", "string").add("target_uri", "string")
    schema = schema.add("payload_bytes", "long").add("payload_digest", "string").add("refers_to", "string")
    if payloads:
        schema = schema.add("payload", "binary")
    return archives.select("path", "content").mapInArrow(lambda batches: _records(batches, payloads), schema)


def write_archives(pages: DataFrame, path: str, page_id="page_id", url="url", html="html", least: int = LEAST_LINKED) -> None:
    """Writes the pages' archives as rows (path, content) in Parquet files, which Spark commits as tasks end.

    Of equal payloads of ``least`` bytes or more, the page with the smallest id
    is a response and the others revisit it; rows that repeat that id are all
    responses, and pages without an id revisit a page that has one.  A null
    html is an empty payload.  Payloads are compared by SHA-256, of which the
    table of repeated ones has a row each: a hot payload's rows can be split by
    the adaptive skew join.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("uri"), F.coalesce(F.col(html).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    long = rows.filter(F.length("payload") >= least)
    first = long.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND first IS NOT NULL")
    rows = rows.join(first.select("digest", "first"), "digest", "left")
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")))
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), name("first"))
    records = rows.select(name("page_id").alias("record_id"), "uri", "payload", "digest", refers.alias("refers_to"))
    archives = records.mapInArrow(_archived, "path string, content binary")
    archives.write.option("compression", "none").option("parquet.block.size", 16 << 20).parquet(path)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages as archives and reads them back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = scratch_path(spark, "warc")
    write_archives(pages, path)
    records = read_records(spark.read.parquet(path), payloads=False)
    kind = pages.schema["page_id"].dataType
    number = lambda c: F.nullif(F.substring(F.col(c), len("urn:page:") + 1, 100), F.lit("none")).cast(kind)
    return records.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
m AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM m
"""
