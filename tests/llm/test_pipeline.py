"""The pipeline against a brute-force version, stage by stage, and the registered queries on small tables."""

import hashlib
import math

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from folioscope.llm import decontam, langid, mixing, registry
from folioscope.llm.common import crc_mod
from tests.llm.fixtures import awkward, prose
from tests.llm.test_decontam import plain_tiles
from tests.llm.test_mixing import plain_targets
from tests.llm.test_simhash import plain_components, plain_fingerprint
from tests.llm.test_token_ids import wanted


def plain_mix(rows):
    """rows: (doc_id, text, source); how often each is taken."""
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(text.split())
    targets, taken = plain_targets(sizes), {}
    for source in sizes:
        key = f"s{source}"
        order = sorted((len(bin(len(t.split()))[2:]), hashlib.md5(str(d).encode()).hexdigest()[:2], len(t.split()), d) for d, t, s in rows if s == source)
        offset = int(hashlib.md5((mixing.SEED + key).encode()).hexdigest()[:3], 16) / 4096
        ratio = targets[source] / sizes[source]
        for at, (*_, doc) in enumerate(order, 1):
            taken[doc] = math.floor(offset + at * ratio) - math.floor(offset + (at - 1) * ratio)
    return taken


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    items = [prose(9000 + i, 25) for i in range(4)]
    rows = []
    for i in range(160):
        text = prose(i, 40 + i % 60)
        if i % 20 == 3:
            text = rows[i - 2][1]  # an exact copy
        if i % 20 == 7:
            text = rows[i - 3][1] + " end"  # a near copy
        if i % 16 == 5:
            text += " " + items[i % 4]
        if i % 40 == 9:
            text = "12 345 !!! 99"
        rows.append((i, text, ["en", "fr"][i % 2], ["a", "b", "a", "c"][i % 4], len(text)))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, items


def test_against_brute_force(spark, folder):
    path, rows, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    model = langid.fit(docs.filter(crc_mod("doc_id") != 0))
    _, _, rejected = model.predict([r[1] for r in rows])
    rows = [r for r, x in zip(rows, rejected) if not x]
    assert all(any(c.isalpha() for c in r[1]) for r in rows)
    groups = plain_components([(r[0], plain_fingerprint(r[1])) for r in rows])
    rows = [r for r, g in zip(rows, groups) if r[0] == g]
    rows = [r for r in rows if not any(sum(k for *_, k in plain_tiles(r[1].split(), t.split(), 5)) >= decontam.COVERAGE * len(t.split()) for t in items)]
    taken = plain_mix([(r[0], r[1], r[3]) for r in rows])
    mixed = sorted((r[0], r[1]) for r in rows for _ in range(taken[r[0]]))
    want = wanted(mixed, Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
    assert sorted(map(tuple, corpus_pipeline.run(spark, path).collect())) == sorted(want)


def test_stages_keep_the_columns(spark, folder):
    path, *_ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).schema == docs.schema, name


def test_empty_documents_pass_through(spark, tmp_path):
    path = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, path).count() == 0


def test_nulls_ties_and_repeated_rows(spark, tmp_path):
    path, docs = str(tmp_path), awkward(spark)
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, None), (None, ""), (3, prose(77, 9))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    for name in list(stages)[:-1]:
        rows = stages[name](spark, docs, path)
        assert rows.columns == docs.columns and set(map(repr, rows.collect())) <= set(map(repr, docs.collect())), name
    known = stages["language"](spark, docs, path)
    assert all(any(c.isalpha() for c in r.text or "") for r in known.collect())
    kept = stages["near_duplicates"](spark, known, path).collect()
    assert len({(r.doc_id, r.text) for r in kept}) == len(kept)
    assert stages["decontamination"](spark, docs, path).count() == docs.count()
    assert stages["tokens"](spark, docs, path).count() == docs.count()
    index = sorted((r.start, r.n_tokens) for r in corpus_pipeline.run(spark, path).collect())
    assert index and all(a + n == b for (a, n), (b, _) in zip(index, index[1:]))


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 14))
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_with_sql(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = registry.queries()[name](spark, sf)
    cursor = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(map(repr, (tuple(r[n] for n in names) for r in df.collect()))) == sorted(map(repr, map(tuple, cursor.fetchall())))


@pytest.mark.parametrize("name", ["op1_decontamination", "op2_language_id", "op3_license_scan", "op4_lm_scoring", "op5_simhash_near_dedup", "op6_token_ids", "op8_syncmer_fingerprints", "op9_toxicity"])
def test_queries_return_all_documents(spark, name):
    sf = "/root/testdata/sf0.001"
    df = registry.queries()[name](spark, sf)
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert df.count() == n if name != "op1_decontamination" else df.count() <= n * 40
