import collections
import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from folioscope.llm import pitman_yor as hpy
from folioscope.llm.common import crc_mod
from tests.llm.fixtures import awkward, empty, prose


def some_pairs(rng, n, words=50, contexts=9):
    tokens = rng.integers(0, 1 << 63, words, dtype=np.uint64)[rng.integers(0, words, n)] * np.uint64(2)
    return hpy.Pairs.of(tokens, rng.integers(0, contexts, n).astype(np.uint32))


def test_pack_round_trip():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 1000):
        pairs, at = some_pairs(rng, n)
        counts = np.bincount(at)
        got, again = hpy.unpack(hpy.pack(pairs, counts))
        assert np.array_equal(got.words, pairs.words) and np.array_equal(got.word, pairs.word)
        assert np.array_equal(got.context, pairs.context) and np.array_equal(again, counts)


def test_blocks_join_to_the_whole():
    rng = np.random.default_rng(4)
    words = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    tokens, contexts = words[rng.integers(0, 40, 900)], rng.integers(0, 7, 900).astype(np.uint32)
    whole, at = hpy.Pairs.of(tokens, contexts)
    parts = [hpy.Pairs.of(tokens[i::3], contexts[i::3]) for i in range(3)]
    got, counts, places = hpy.joined([(p, np.bincount(x)) for p, x in parts])
    assert np.array_equal(got.words, whole.words) and np.array_equal(got.word, whole.word) and np.array_equal(got.context, whole.context)
    assert np.array_equal(counts, np.bincount(at))
    assert np.array_equal(got.words[got.word[places]], np.concatenate([p.words[p.word] for p, _ in parts]))


def test_stirling_numbers_count_seatings():
    """S(c, t) sums, over all seatings at t tables, the products of (1 - d)(2 - d)... of the tables' later customers."""
    d = 0.4

    def total(c, tables):
        if not c:
            return collections.Counter({len(tables): 1.0})
        out = collections.Counter()
        for i in range(len(tables)):
            for t, x in total(c - 1, tables[:i] + [tables[i] + 1] + tables[i + 1 :]).items():
                out[t] += x * (tables[i] - d)
        out.update(total(c - 1, [*tables, 1]))
        return out

    want = total(6, [])
    for t, x in want.items():
        assert math.isclose(math.exp(hpy.log_stirling(d)[6, t - 1]), x, rel_tol=1e-9)


def seeds(n, seed=3):
    return np.random.default_rng(seed).integers(0, 1 << 64, n, dtype=np.uint64)


def test_draws_follow_their_distribution():
    n = 40_000
    for c, weight in ((2, 0.3), (5, 2.0), (40, 1.0)):
        drawn = np.bincount(hpy.draw_tables(np.full(n, c), 0.5, lambda own, k: weight + 0 * own * k, seeds(n)), minlength=c + 1)[1:] / n
        p = np.exp(hpy.log_stirling(0.5)[c, :c]) * weight ** np.arange(c)
        assert np.abs(drawn - p / p.sum()).max() < 0.02


def plain_mean(c, d, weight):
    """The mean number of tables of c customers, by the recursion of the Stirling numbers, scaled as it goes."""
    row = np.zeros(c + 2)
    row[1] = 1.0
    for i in range(1, c):
        new = row * np.maximum(i - d * np.arange(c + 2), 0)
        new[1:] += row[:-1] * weight
        row = new / new.sum()
    return (row * np.arange(c + 2)).sum()


def test_the_limit_for_many_customers_agrees_with_the_exact_numbers():
    n = 4000
    for c in (hpy.TABLED + 1, 400):
        for d in (0.5, 0.8):
            for weight in (0.01, 0.3, 2.0, 10.0, 40.0):
                drawn = hpy.draw_tables(np.full(n, c), d, lambda own, k: weight + 0 * own * k, seeds(n)).mean()
                want = plain_mean(c, d, weight)
                assert abs(drawn - want) < 0.03 * want + 0.05, (c, d, weight, drawn, want)


def plain_base(rows):
    tokens = {k: [*(t or "").lower().split(), None] for k, t in rows}
    counts = collections.Counter(w for k, ws in tokens.items() if zlib.crc32(str(k).encode()) % 5 != 1 for w in ws)
    n, v = sum(counts.values()), len(counts)
    return {k: (len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for k, ws in tokens.items()}


def test_base_and_model(spark):
    rows = [(i, prose(i % 150, 20 + i % 50)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_base(rows)
    scores = []
    for block in (10_000, 1_000_000):
        out = hpy.score_documents(df, crc_mod("doc_id") != 1, block_bytes=block).collect()
        assert len(out) == len(rows)
        scores.append({r["doc_id"]: r["score"] for r in out})
        for r in out:
            n, known, total, base = want[r["doc_id"]]
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total) and math.isclose(r["base_score"], base, rel_tol=1e-9)
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1)
        held = [r for r in out if r["held_out"]]
        assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)  # repeated texts are foreseen
    assert scores[0] == scores[1]  # however the table is dealt out


def swept(pairs, counts, sweeps, contexts, d=0.6, d0=0.5, strength=2.0, root_strength=5.0):
    """The totals before and after each sweep of one reducer that has all words, with strengths held."""
    seating = hpy.Seating(pairs, counts)
    context, words = seating.pairs.context, len(seating.pairs.words)
    customers = np.bincount(context, seating.counts, contexts).astype(np.int64)
    totals = lambda t, r: hpy.Totals(words, int(counts.sum()), customers, np.bincount(context, t, contexts).astype(np.int64), int(r.sum()), d, d0, strength, root_strength)
    tables, root = np.ones(len(context), np.int64), np.ones(words, np.int64)
    history = [totals(tables, root)]
    for s in range(sweeps):
        tables, root = seating._sweep(tables, root, history[-1], np.uint64(s + 1))
        history.append(totals(tables, root))
    return seating, history


def all_pairs(words, contexts):
    return hpy.Pairs(words, np.repeat(np.arange(len(words)), contexts), np.tile(np.arange(contexts, dtype=np.uint32), len(words)))


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(2)
    pairs, at = some_pairs(rng, 600, 30, 4)
    seating, history = swept(pairs, np.bincount(at), 4, 5)
    asked = all_pairs(np.append(pairs.words, np.uint64((1 << 64) - 1)), 5)  # and one unknown word
    logs, _ = hpy.predictive(seating, history, asked)
    assert np.allclose(np.bincount(asked.context, 10**logs), 1.0, rtol=1e-9)


def plain_restaurants(tokens, sweeps, burn, contexts, words, d, d0, strength, root_strength, seed=5):
    """Mean predictive probabilities of a sampler that seats one customer after another, in both restaurants."""
    rng = np.random.default_rng(seed)
    leaf, root, at = collections.defaultdict(list), collections.defaultdict(list), [None] * len(tokens)
    customers = collections.Counter()

    def tables(u):
        return sum(len(t) for (c, _), t in leaf.items() if c == u)

    def root_probability(w):
        n, t = sum(map(sum, root.values())), sum(map(len, root.values()))
        return (sum(root[w]) - d0 * len(root[w]) + (root_strength + d0 * t) / (words + 1)) / (root_strength + n)

    def sit(sizes, new, discount):
        p = np.array([*(x - discount for x in sizes), new])
        k = int(rng.choice(len(p), p=p / p.sum()))
        if k == len(sizes):
            sizes.append(1)
            return True
        sizes[k] += 1
        return False

    def leave(sizes):
        k = int(rng.choice(len(sizes), p=np.array(sizes) / sum(sizes)))
        sizes[k] -= 1
        if not sizes[k]:
            sizes.pop(k)
            return True
        return False

    total = np.zeros((contexts, words + 1))
    for sweep in range(sweeps):
        for i in rng.permutation(len(tokens)):
            u, w = tokens[i]
            if at[i]:
                customers[u] -= 1
                if leave(leaf[u, w]):
                    leave(root[w])
            at[i] = True
            if sit(leaf[u, w], (strength + d * tables(u)) * root_probability(w), d):
                top = (root_strength + d0 * sum(map(len, root.values()))) / (words + 1)
                sit(root[w], top, d0)
            customers[u] += 1
        if sweep >= burn:
            for u in range(contexts):
                for w in range(words + 1):
                    sizes = leaf[u, w]
                    total[u, w] += (sum(sizes) - d * len(sizes) + (strength + d * tables(u)) * root_probability(w)) / (strength + customers[u])
    return total / (sweeps - burn)


def test_against_customers_seated_one_by_one():
    rng = np.random.default_rng(8)
    contexts, n_words = 3, 12
    p = 1 / np.arange(1, n_words + 1)
    tokens = [(int(rng.integers(contexts)), int(w)) for w in rng.choice(n_words, 120, p=p / p.sum())]
    names = np.sort(rng.integers(0, 1 << 63, n_words, dtype=np.uint64) * np.uint64(2))
    pairs, at = hpy.Pairs.of(names[[w for _, w in tokens]], np.array([u for u, _ in tokens], np.uint32))
    seating, history = swept(pairs, np.bincount(at), 1500, contexts)
    known = len(pairs.words)
    asked = all_pairs(np.append(pairs.words, np.uint64((1 << 64) - 1)), contexts)
    got = np.zeros((contexts, known + 1))
    got[asked.context, asked.word] = 10 ** hpy.predictive(seating, history, asked)[0]
    renumber = {int(w): i for i, w in enumerate(pairs.words)}
    plain = plain_restaurants([(u, renumber[int(names[w])]) for u, w in tokens], 350, 50, contexts, known, 0.6, 0.5, 2.0, 5.0)
    assert np.allclose(plain.sum(axis=1), 1.0)
    error = np.abs(np.log10(got) - np.log10(plain))
    assert error.mean() < 0.02 and error.max() < 0.08, (error.mean(), error.max())


def test_awkward_and_empty(spark):
    docs = awkward(spark)
    out = hpy.score_documents(docs, crc_mod("doc_id") != 1).collect()
    assert len(out) == docs.count() and all(r["score"] < 0 and r["n_tokens"] >= 1 for r in out)
    assert hpy.score_documents(empty(spark), crc_mod("doc_id") != 1).count() == 0
    untrained = hpy.score_documents(docs, F.lit(None).cast("boolean")).collect()
    assert all((r["n_known"], r["train_tokens"], r["base_score"], r["score"]) == (0, 0, 0.0, 0.0) and r["held_out"] for r in untrained)


def test_totals_come_to_the_driver_in_few_batches(spark, monkeypatch):
    rows = [(i, " ".join(f"w{i * 7 + j}" for j in range(7))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sent, whole = [], type(docs).toArrow

    def counted(df):
        table = whole(df)
        sent.append((table.num_rows, sum(len(c.chunks) for c in table.columns[:1])))
        return table

    monkeypatch.setattr(type(docs), "toArrow", counted)
    hpy.score_documents(docs, F.lit(True))
    assert len(sent) == 1 + hpy.BURN_IN + hpy.SAMPLES
    assert all(n > 1000 and chunks <= 100 for n, chunks in sent)
