import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from folioscope.llm import token_ids
from tests.llm.fixtures import awkward, empty, prose

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_encoder_is_exact(tokenizer):
    rng = random.Random(5)
    parts = ["a", "B", "é", "7", " ", "  ", "\n", ". ", ", ", ".\n", "!", "'s", "...", "\t", "\x00", "word", "中", " ", "<|endoftext|>", "　", "\r\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(2000)] + [prose(1, 300), None, ""]
    encoder = token_ids.Encoder(PATH, memory=50)
    for _ in range(2):
        ids, counts = encoder.encode(pa.array(texts))
        got = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
        assert got == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_other_tokenizers_go_whole():
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder = token_ids.Encoder(path)
    assert encoder.known is None
    ids, counts = encoder.encode(pa.array(["Some words.", None]))
    assert ids.tolist() == Tokenizer.from_file(path).encode("Some words.", add_special_tokens=False).ids and counts[1] == 0


def wanted(rows, tokenizer):
    out, start = [], 0
    for doc, text in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_round_trip_over_many_files(spark, tokenizer, tmp_path, monkeypatch):
    monkeypatch.setattr(token_ids, "FILE_BYTES", 20_000)
    rows = [(i * 7 % 500, prose(i, i % 90)) for i in range(500)]
    src = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(src)
    path = str(tmp_path / "ids")
    got = token_ids.encode_documents(spark.read.parquet(src), path).collect()
    assert sorted(map(tuple, got)) == wanted(sorted(rows), tokenizer)
    files = sorted((tmp_path / "ids").glob("*.parquet"))
    assert len(files) > 1
    last = -1
    for f in files:  # files and rows in ascending order of id, with page indexes and version 2 encodings
        meta = pq.ParquetFile(f).metadata
        column = meta.row_group(0).column(4)
        assert column.path_in_schema.startswith("ids") and column.has_offset_index and column.has_column_index
        assert any("DICTIONARY" in e or "DELTA" in e for e in column.encodings)
        ids = pq.read_table(f, columns=["doc_id"])["doc_id"].to_pylist()
        assert ids == sorted(ids) and ids[0] > last
        last = ids[-1]
    plan = token_ids.read_token_ids(spark, path).filter("doc_id = 3").select("n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "ids" not in plan.split("ReadSchema")[1]


def test_awkward_and_empty(spark, tokenizer):
    docs = awkward(spark)
    got = [tuple(r) for r in token_ids.encode_documents(docs).orderBy("start").collect()]
    assert len(got) == docs.count() and got[0][0] is None and [g[0] for g in got[2:]] == sorted(g[0] for g in got[2:])
    assert [g[1] for g in got] == np.cumsum([0] + [g[2] for g in got])[:-1].tolist()
    assert sorted((str(g[0]), g[2], g[3]) for g in got) == sorted((str(w[0]), w[2], w[3]) for w in wanted([(r[0], r[1]) for r in docs.collect()], tokenizer))
    assert token_ids.encode_documents(empty(spark)).count() == 0


def test_start_is_the_place_in_the_files_where_ids_repeat(spark, tmp_path, monkeypatch):
    """Rows that repeat an id, over several files: the ids from ``start`` on are the row's own."""
    monkeypatch.setattr(token_ids, "FILE_BYTES", 2_000)
    rows = [(i // 6 if i % 11 else None, prose(i, i % 17)) for i in range(120)] + [(3, "the same"), (3, "the same"), (3, None)]
    src, path = str(tmp_path / "docs"), str(tmp_path / "ids")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(src)
    index = token_ids.encode_documents(spark.read.parquet(src), path).collect()
    flat = []
    for file in sorted((tmp_path / "ids").glob("*.parquet")):
        flat += [x for ids in pq.read_table(file)["ids"].to_pylist() for x in ids]
    assert len(index) == len(rows) and sum(r.n_tokens for r in index) == len(flat)
    for r in index:
        assert zlib.crc32(np.array(flat[r.start : r.start + r.n_tokens], "<u4").tobytes()) == r.ids_crc32
