import hashlib
import struct

import pytest
import zstandard
from pyspark.errors import PythonException

from folioscope.llm import warc
from tests.llm.fixtures import prose


def archive(payloads):
    return warc.archive_bytes([warc.record_bytes(f"urn:page:{i}", "http://x/é", p, hashlib.sha256(p).hexdigest(), None) for i, p in enumerate(payloads)])


def test_one_frame_a_record_with_the_dictionary():
    payloads = [prose(i, i % 300).encode() for i in range(400)] + [b"", b"\r\n\r\n", bytes(range(256)) * 300]
    data = archive(payloads)
    assert struct.unpack_from("<I", data)[0] == 0x184D2A5D
    assert [p for *_, p in warc.read_archive(data)] == payloads
    at, frames = 8 + struct.unpack_from("<I", data, 4)[0], 0
    while at < len(data):
        at, frames = warc.frame_end(data, at), frames + 1
    assert frames == len(payloads)
    with pytest.raises(zstandard.ZstdError):  # the records need the dictionary
        first = 8 + struct.unpack_from("<I", data, 4)[0]
        zstandard.ZstdDecompressor().decompress(data[first : warc.frame_end(data, first)])


def test_compressed_dictionary_and_small_archives():
    data = archive([b"abc"])
    size = struct.unpack_from("<I", data, 4)[0]
    packed = zstandard.compress(data[8 : 8 + size])
    again = struct.pack("<II", 0x184D2A5D, len(packed)) + packed + data[8 + size :]
    assert [p for *_, p in warc.read_archive(again)] == [b"abc"]
    assert list(warc.read_archive(warc.archive_bytes([]))) == []


def test_damage_is_found():
    data = archive([prose(i, 100).encode() for i in range(20)])
    for bad in (data[4:], data[:-3], b"", data[: 8 + 5]):
        with pytest.raises(warc.ArchiveError):
            list(warc.read_archive(bad))
    record = warc.record_bytes("urn:page:1", None, b"payload", hashlib.sha256(b"payload").hexdigest(), None)
    for old, new in ((b"WARC/1.1", b"WARC/9.9"), (b"WARC-Date", b"X-Date"), (b"payload\r\n", b"payl0ad\r\n"), (b"\r\n\r\n", b"\r\n"), (b"Content-Length: 7", b"Content-Length: 8")):
        with pytest.raises(warc.ArchiveError):
            warc.parse_record(record.replace(old, new, 1))


def test_revisits_files_and_awkward_rows(spark, tmp_path):
    long, short = prose(1, 60), "short"
    rows = [
        (5, "http://a", long), (2, "http://b", long), (9, None, long), (2, "http://b", long), (None, "u\r\nWARC-Type: x", long), (7, "u", short), (8, "u", short),
        (1, "u", None), (3, "u", ""), (4, "u", "é" * 60), (6, "u", "é" * 60), (10, "u", "é" * 49), (11, "u", "é" * 49),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "html AS content", "url AS path", "page_id AS digest", "page_id AS first")
    path = str(tmp_path / "archives")
    warc.write_archives(pages, path)
    archives = spark.read.parquet(path)
    got = sorted((r["record_id"], r["record_type"], r["payload_bytes"], r["refers_to"] or "") for r in warc.read_records(archives).collect())

    def want(page, html):
        raw = (html or "").encode()
        same = [p for p, _, h in rows if p is not None and (h or "").encode() == raw]
        first = min(same) if same and len(raw) >= 100 else page
        return (f"urn:page:{page if page is not None else 'none'}", "response" if page == first else "revisit", len(raw), "" if page == first else f"urn:page:{first}")

    assert got == sorted(want(p, h) for p, _, h in rows)
    folder = tmp_path / "files"  # the same bytes as files, by Spark's reader of binary files
    folder.mkdir()
    for r in archives.collect():
        (folder / r["path"]).write_bytes(r["content"])
    files = spark.read.format("binaryFile").load(str(folder / "*.warc.zst"))
    assert sorted(bytes(r["payload"]) for r in warc.read_records(files).collect()) == sorted(bytes(r["payload"]) for r in warc.read_records(archives).collect())
    with pytest.raises(PythonException, match="part-broken"):
        spark.createDataFrame([("part-broken", b"nothing")], "path string, content binary").transform(warc.read_records).collect()
    none = str(tmp_path / "none")
    warc.write_archives(pages.limit(0), none)
    assert warc.read_records(spark.read.parquet(none)).count() == 0
