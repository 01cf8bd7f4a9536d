import random
import time

import numpy as np

from folioscope.llm import decontam
from tests.llm.fixtures import awkward, empty, prose


def plain_tiles(d, t, least):
    """Greedy string tiling as published: the longest unmarked matches first, by all pairs of places."""
    md, mt, out = [False] * len(d), [False] * len(t), []
    while True:
        best, found = least, []
        for i in range(len(d)):
            for j in range(len(t)):
                k = 0
                while i + k < len(d) and j + k < len(t) and d[i + k] == t[j + k] and not md[i + k] and not mt[j + k]:
                    k += 1
                if k > best:
                    best, found = k, [(i, j)]
                elif k == best:
                    found.append((i, j))
        marked = False
        for i, j in found:
            if not any(md[i : i + best]) and not any(mt[j : j + best]):
                md[i : i + best] = mt[j : j + best] = [True] * best
                out.append((i, j, best))
                marked = True
        if not marked:
            return out


def test_tiles_are_those_of_brute_force():
    rng = random.Random(4)
    for _ in range(150):
        d = np.array([rng.randrange(6) for _ in range(rng.randrange(1, 40))], np.uint64)
        t = np.array([rng.randrange(6) for _ in range(rng.randrange(3, 15))], np.uint64)
        got = decontam.tiles(d, t, np.ones(len(d), bool), 3)
        for i, j, k in got:
            assert k >= 3 and d[i : i + k].tolist() == t[j : j + k].tolist()
        assert len({x for i, _, k in got for x in range(i, i + k)}) == len({x for _, j, k in got for x in range(j, j + k)}) == sum(k for *_, k in got)
        assert got == plain_tiles(d.tolist(), t.tolist(), 3)


def test_exact_near_and_reordered_passages(spark):
    item = prose(100, 40)
    words = item.split()
    reordered = words[24:] + prose(7, 3).split() + words[:12] + ["zz"] + words[12:24]
    half = words[:20] + prose(8, 30).split()
    docs = [
        (1, prose(1, 300) + " " + item + " " + prose(2, 50)), (2, " ".join(reordered)), (3, " ".join(half)), (4, prose(9, 500)),
        (5, item.upper()), (6, " ".join(w for i, w in enumerate(words) if i != 17)), (7, "yes no"), (8, "no yes no maybe"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(10, item), (11, "no maybe"), (12, None), (13, ""), (14, prose(77, 25))], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontam.leaks(df, bench).collect()}
    assert set(got) == {(1, 10), (2, 10), (5, 10), (6, 10), (8, 11)}
    assert got[1, 10]["coverage"] == 1.0 and len(got[1, 10]["tiles"]) == 1 and got[1, 10]["tiles"][0]["doc_start"] == 300
    assert len(got[2, 10]["tiles"]) == 3 and got[6, 10]["matched_words"] == 39
    assert {r["doc_id"] for r in decontam.decontaminated(df, bench).collect()} == {3, 4, 7}
    blocks = decontam.leaks(df, bench, block_bytes=60).collect()
    assert {(r["doc_id"], r["item_id"]) for r in blocks} == set(got)


def test_against_brute_force(spark):
    rng = random.Random(2)
    items = [prose(1000 + i, rng.randrange(5, 30)).split() for i in range(12)]
    docs = []
    for i in range(80):
        words = prose(i, rng.randrange(0, 120)).split()
        if i % 3 == 0:
            own = rng.choice(items)
            cut = rng.randrange(len(own))
            at = rng.randrange(len(words) + 1)
            words[at:at] = own[cut:] + own[:cut]
        docs.append(words)
    got = decontam.leaks(
        spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string"),
        spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string"),
    ).collect()
    want = {(d, i) for d, w in enumerate(docs) for i, t in enumerate(items) if sum(k for *_, k in plain_tiles(w, t, 5)) >= 0.8 * len(t)}
    assert {(r["doc_id"], r["item_id"]) for r in got} == want


def test_awkward_and_empty(spark):
    docs = awkward(spark)
    bench = docs.selectExpr("doc_id AS item_id", "text", "lang")
    found = decontam.leaks(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} >= {(1, 1), (5, 5), (6, 6), (None, None), (7, 7), (8, 8)}
    clean = decontam.decontaminated(docs, bench)
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == {2, 3, 4}
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.leaks(docs, none).count() == 0 and decontam.decontaminated(docs, none).count() == docs.count()
    assert decontam.leaks(empty(spark), bench).count() == 0


def test_repetitive_texts_take_little_time():
    """One word, a short period, and an item whose words stand in every text, against 20,000 words."""
    common = prose(5, 40)
    items = ["na " * 500, "na " * 250 + prose(1, 250), "a b c d e f g " * 70, common, "na " * 499 + "x"] + [f"{common} {prose(50 + i, 3)}" for i in range(300)]
    bench = decontam.Benchmark(list(range(len(items))), [x.encode() for x in items])
    for text, want in (("na " * 20_000, {0, 4}), ("a b c d e f g " * 3000, {2}), ((common + " ") * 500, {3, *range(5, 305)})):
        began = time.perf_counter()
        assert {i for _, i, _ in bench.matches([text.encode()])} == want
        assert time.perf_counter() - began < (1 if len(want) < 9 else 10)
