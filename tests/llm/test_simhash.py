import numpy as np
import pytest
import xxhash

from folioscope.llm import simhash
from folioscope.llm.components import component_roots, local_stars
from tests.llm.fixtures import awkward, empty, prose


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """prints: (id, fingerprint); the smallest id reachable, by all pairs."""
    n = len(prints)
    label = list(range(n))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(n):
        for j in range(i):
            if bin(prints[i][1] ^ prints[j][1]).count("1") <= 4:
                label[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(prints):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [least.get(find(i)) for i in range(n)]


def test_fingerprint_bits():
    for text in ["", "one", "one two three", "A b\tc d\x0be", prose(1, 500), "É é ü x y z"]:
        assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def test_four_flipped_bits_always_share_keys():
    rng = np.random.default_rng(3)
    for _ in range(300):
        x = int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(2))
        y = x
        for bit in rng.choice(64, 4, replace=False):
            y ^= 1 << int(bit)
        both = np.array([x, y], np.uint64)
        keys = [[set(k[r == i].tolist()) for i in (0, 1)] for k, r in (simhash.segment_keys(both, s) for s in range(3))]
        assert any(keys[a][0] & keys[a][1] and keys[b][0] & keys[b][1] for a, b in simhash.PAIRS)


def test_large_groups_are_absorbed():
    rng = np.random.default_rng(5)
    base = int(rng.integers(0, 1 << 62))
    prints = np.unique(np.array([base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 20, (400, 2))] + [base], np.uint64))
    bucket_rows = []
    for p, (first, _) in enumerate(simhash.PAIRS):
        keys, row = simhash.segment_keys(prints, first)
        bucket_rows += list(zip((keys + (p << 12)).tolist(), prints[row].tolist()))
    bucket_rows.sort()
    u, v = simhash._verified(np.array([b for b, _ in bucket_rows]), np.array([f for _, f in bucket_rows], np.uint64))
    nodes, _ = local_stars(u, v)
    assert len(nodes) == len(prints) - 1


def test_components_match_brute_force(spark):
    rng = np.random.default_rng(8)
    prints, nxt = [], 0
    for _ in range(25):
        x = int(rng.integers(0, 1 << 62))
        for _ in range(int(rng.integers(1, 9))):
            prints.append((nxt, x))
            nxt += 1
            for bit in rng.choice(64, int(rng.integers(0, 6)), replace=False):
                x ^= 1 << int(bit)
    order = rng.permutation(len(prints))
    prints = [(int(order[i]), f) for i, (_, f) in enumerate(prints)] + [(None, prints[0][1]), (None, 5)]
    df = spark.createDataFrame([(d, f - (1 << 64) if f >> 63 else f) for d, f in prints], "doc_id long, fp long")
    got = {(r["doc_id"], r["fp"] % (1 << 64)): r["component_id"] for r in simhash.components(df).collect()}
    for (d, f), want in zip(prints, plain_components(prints)):
        assert got[d, f] == want


@pytest.mark.parametrize("n", [1, 2, 7, 40])
def test_paths_become_stars(spark, n):
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (5, 5)], "u long, v long")
    assert {tuple(r) for r in component_roots(edges).collect()} == {(i, 0) for i in range(1, n + 1)} | {(101, 100)}


def test_awkward_and_empty(spark):
    docs = awkward(spark)
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    texts = [(r["doc_id"], plain_fingerprint(r["text"])) for r in docs.collect()]
    want = {(d, f): c for (d, f), c in zip(texts, plain_components(texts))}
    assert {(r["doc_id"], r["fp"] % (1 << 64)): r["component_id"] for r in rows} == want
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({r["root"] for r in rows})
    assert simhash.near_duplicates(empty(spark)).count() == simhash.deduplicated(empty(spark)).count() == 0


def test_dedup_with_clashing_columns_and_equal_rows(spark):
    docs = spark.range(300).selectExpr("IF(id < 200, 1, id) AS doc_id", "IF(id < 200, 'one text that stands often', concat('text ', id, ' of its own ', id * 7)) AS text", "id % 2 AS keep_0", "'x' AS keep_1", "1 AS text_hash", "2 AS kept_id_hash", "3 AS fp", "4 AS root")
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(1) == 1 and len(ids) == len(set(ids))
