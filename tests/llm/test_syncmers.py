import datetime
import decimal
import hashlib

import numpy as np

from folioscope.llm import syncmers
from tests.llm.fixtures import awkward, empty, prose


def plain_syncmers(text, k, s):
    def small(x):
        h = 0
        for b in x:
            h = (h * int(syncmers._RADIX) + b + 1) % (1 << 64)
        return int(syncmers.mix64(np.array([h], np.uint64))[0])

    found = []
    for i in range(len(text) - k + 1):
        inner = [small(text[i + j : i + j + s]) for j in range(k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            found.append(i)
    return found


def test_closed_syncmers_match_brute_force():
    for seed, (k, s) in enumerate([(24, 11), (6, 3), (9, 8), (5, 5)] * 3):
        text = prose(seed, 40).encode()
        place, hashes = syncmers._closed(np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1), k, s)
        assert place.tolist() == plain_syncmers(text, k, s)
        again = {text[p : p + k]: h for p, h in zip(place.tolist(), hashes.tolist())}
        assert all(again[text[p : p + k]] == h for p, h in zip(place.tolist(), hashes.tolist()))


def test_anchors_are_context_free():
    middle = prose(5, 200)
    a, b = (prose(1, 30) + " " + middle).encode(), (prose(2, 90) + " " + middle + " tail").encode()
    (pa, ha), (pb, hb) = syncmers.anchors(a), syncmers.anchors(b)
    shift = b.index(middle.encode()) - a.index(middle.encode())
    inside = lambda p, t: set(p[(p >= t.index(middle.encode())) & (p + syncmers.K <= t.index(middle.encode()) + len(middle))].tolist())
    assert {p + shift for p in inside(pa, a)} == inside(pb, b)
    assert syncmers.likeness((pa, ha), (pa, ha)) == 1.0
    assert syncmers.likeness((pa, ha), (pb, hb)) > 0.5 > 0.05 > syncmers.likeness((pa, ha), syncmers.anchors(prose(9, 300).encode()))


def test_contract_against_brute_force(spark, tmp_path):
    rows = [(i * 37 % 401, prose(i, i % 70) + ("é中" if i % 5 == 0 else "")) for i in range(400)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(path)
    docs = sorted(rows)
    for run in (1 << 30, 2_000):
        got = sorted(map(tuple, syncmers.compare_with_next(spark.read.parquet(path), run_bytes=run).collect()))
        assert len(got) == len(docs)
        for i, (doc, text) in enumerate(docs):
            following = docs[(i + 1) % len(docs)][1]
            half = len(text) // 2
            other = text[: len(text) - half] + following[:half]
            print1, print2, print3 = (syncmers.anchors(x.encode()) for x in (text, other, following))
            want = (doc, len(text), hashlib.sha256(other.encode()).hexdigest(), syncmers.fingerprint(print1), syncmers.fingerprint(print2))
            assert got[i][:5] == want
            assert got[i][5:7] == (syncmers.likeness(print1, print2), syncmers.likeness(print1, print3))
        assert np.mean([r[5] > r[6] for r in got]) > 0.95


def test_awkward_and_empty(spark):
    docs = awkward(spark)
    out = syncmers.compare_with_next(docs, run_bytes=1000).collect()
    assert sorted(r["n_chars"] for r in out) == sorted(len(r["text"] or "") for r in docs.collect())
    assert len({r["fingerprint"] for r in out if r["doc_id"] == 6}) == 2
    assert syncmers.compare_with_next(empty(spark)).count() == 0
    single = syncmers.compare_with_next(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).first()
    assert single["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and single["near_next"] == 1.0
    assert syncmers.syncmers(docs).count() >= docs.count()


def plain_rows(rows):
    """What is compared with what, by the contract: (n_chars, sha256 of the edited text) of every row, in order."""
    key = lambda r: (r[0] is not None, r[0] if r[0] is not None else 0)
    docs = sorted(rows, key=key)
    out = []
    for i, (doc, text) in enumerate(docs):
        following = docs[(i + 1) % len(docs)][1]
        out.append((doc, len(text), hashlib.sha256((text[: len(text) - len(text) // 2] + following[: len(text) // 2]).encode()).hexdigest()))
    return out


def test_no_document_is_lost_whatever_the_ids(spark, tmp_path):
    """Ids beyond 2^53, negative ones, texts, decimals, doubles, dates, and a null among them."""
    n = 400
    kinds = {
        "large": ("long", [(1 << 60) + 3 * i for i in range(n)]),
        "hashed": ("long", [int(x) for x in np.random.default_rng(1).integers(-(1 << 63), 1 << 63, n)]),
        "text": ("string", [f"doc-{i:05d}" for i in range(n)]),
        "decimal": ("decimal(30,2)", [decimal.Decimal(i) * 10**20 + decimal.Decimal("0.25") for i in range(n)]),
        "double": ("double", [i / 7 for i in range(n)]),
        "date": ("date", [datetime.date(2000, 1, 1) + datetime.timedelta(i) for i in range(n)]),
    }
    for name, (kind, ids) in kinds.items():
        rows = [(x, prose(i, 5 + i % 30)) for i, x in enumerate([None, *ids])]
        path = str(tmp_path / name)
        spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(3).write.parquet(path)
        got = syncmers.compare_with_next(spark.read.parquet(path), run_bytes=1500).collect()
        assert len({r["doc_id"] for r in got}) == n + 1
        assert sorted(map(repr, (tuple(r)[:3] for r in got))) == sorted(map(repr, plain_rows(rows))), name


def test_repeated_ids_are_cut_too(spark, tmp_path):
    """One id with a third of all rows, other ids twice, and rows that are the same in all."""
    rows = [(7 if i % 3 == 0 else i, prose(i % 350, 5 + i % 30)) for i in range(600)] * 2
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(path)
    one, many = ([tuple(r) for r in syncmers.compare_with_next(spark.read.parquet(path), run_bytes=b).collect()] for b in (1 << 30, 1500))
    assert len(one) == len(many) == len(rows) and sorted(one) == sorted(many)


def test_short_passage_and_its_copy_in_a_longer_text():
    passage, longer = prose(3, 30), prose(8, 200)
    whole = longer[:400] + passage + longer[400:]
    place, hashes = syncmers.anchors(passage.encode())
    other, theirs = syncmers.anchors(whole.encode())
    inner = {(p + 400, h) for p, h in zip(place.tolist(), hashes.tolist()) if p >= 0}
    assert len(inner) > 10 and inner <= set(zip(other.tolist(), theirs.tolist()))


def test_fingerprint_stands_for_all_anchors():
    text = prose(1, 3000)
    moved = text[:9000] + "x" + text[9001:]
    prints = [syncmers.fingerprint(syncmers.anchors(t.encode())) for t in (text, text.upper(), moved)]
    assert prints[0] == prints[1] != prints[2]
    place, hashes = syncmers.anchors(text.encode())
    shown = [x.split(".") for x in prints[0].split(" ")[2:]]
    assert len(shown) == syncmers.SHOWN and int(prints[0].split(" ")[0], 16) == len(place)
    least = sorted(zip((hashes >> np.uint64(32)).tolist(), place.tolist()))[: syncmers.SHOWN]
    assert sorted((int(h, 16), int(p, 16)) for p, h in shown) == least
