"""Alignment under drifting ids against brute force."""

import random
from itertools import combinations

import pytest

from folioscope.operators import drift


def longest(values):
    for n in range(len(values), 0, -1):
        if any(all(a < b for a, b in zip(c, c[1:])) for c in combinations(values, n)):
            return n
    return 0


def test_longest_rise():
    rng = random.Random(1)
    for _ in range(200):
        values = [rng.randrange(8) for _ in range(rng.randrange(10))]
        places = drift.longest_rise(values)
        found = [values[i] for i in places]
        assert places == sorted(places) and all(a < b for a, b in zip(found, found[1:])) and len(found) == longest(values)


def plain(a, b):
    """The same alignment by loops over one document: (order, text) lists."""
    def rise(pairs):
        pairs = sorted(pairs, key=lambda p: (p[0], -p[1]))
        return [pairs[i] for i in drift.longest_rise([r for _, r in pairs])]

    a, b = ([(o, t) for o, t in sorted(x) if t] for x in (a, b))
    once = [{t: o for o, t in x if sum(u == t for _, u in x) == 1} for x in (a, b)]
    anchors = rise([(once[0][t], once[1][t]) for t in once[0].keys() & once[1].keys()])
    loose = []
    for x, side in ((a, 0), (b, 1)):
        held, seen, out = {p[side] for p in anchors}, {}, {}
        for o, t in x:
            if o not in held:
                gap = sum(p[side] < o for p in anchors)
                seen[gap, t] = seen.get((gap, t), 0) + 1
                out[gap, t, seen[gap, t]] = o
        loose.append(out)
    return rise(anchors + [(loose[0][k], loose[1][k]) for k in loose[0].keys() & loose[1].keys()])


@pytest.fixture(scope="module")
def sides():
    rng, left, right = random.Random(7), [], []
    for doc in range(25):
        rows = [(i * 3, rng.choice(["a", "b", "c", f"u{i}", f"v{i}", "", None])) for i in range(rng.randrange(1, 25))]
        left += [(f"d{doc}", o, t) for o, t in rows]
        kept = [t for _, t in rows if rng.random() < 0.85]
        for _ in range(3):
            kept.insert(rng.randrange(len(kept) + 1), rng.choice(["a", "new", "u2"]))
        if len(kept) > 8 and rng.random() < 0.5:
            kept = kept[5:8] + kept[:5] + kept[8:]
        right += [(f"d{doc}", i, t) for i, t in enumerate(kept)]
    return left + [(None, 1, "a")], right + [(None, 1, "a")]


def test_against_loops(spark, sides):
    schema = "doc string, place int, text string"
    got = drift.aligned(*(spark.createDataFrame(x, schema).repartition(3) for x in sides), ["doc"], "place", "text").collect()
    want = {(d, l, r) for d in {x[0] for x in sides[0]} - {None} for l, r in plain(*([(o, t) for e, o, t in x if e == d] for x in sides))}
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 100


def test_audit(spark):
    schema = "doc string, order int, ref string, text string, action string"
    expected = [("d", 1, "r1", "title", "keep"), ("d", 2, "r2", "name", "fill"), ("d", 3, "r3", "note", "delete"), ("d", 4, "r4", "gone", "keep"), ("d", 5, None, "end", None), ("d", 6, "r6", None, "keep"), ("d", None, "r7", "x", "keep")]
    actual = [("d", 1, "r1", "title", "keep"), ("d", 2, "r2", "inserted", "keep"), ("d", 3, "r3", "name", "fill"), ("d", 4, "r4", "note", "keep"), ("d", 5, "r5", "end", None), ("d", 9, "r1", "again", "fill"), ("d", 10, "r6", None, "keep")]
    got = drift.expectation_audit(spark.createDataFrame(expected, schema), spark.createDataFrame(actual, schema), ["doc"]).collect()
    assert sorted(tuple(r)[1:] for r in got) == [
        (1, "r1", "r1", "ref", None, "PASS"), (2, "r2", "r3", "anchor", None, "PASS"), (3, "r3", "r4", "anchor", "action_mismatch", "FAIL"),
        (4, "r4", None, None, "expected_row_missing", "UNKNOWN"), (5, None, "r5", "anchor", None, "PASS"), (6, "r6", "r6", "ref", None, "PASS")]
    empty = spark.createDataFrame([], schema)
    assert drift.expectation_audit(empty, empty, ["doc"]).count() == 0
    assert {r.status for r in drift.expectation_audit(spark.createDataFrame(expected, schema), empty, ["doc"]).collect()} == {"UNKNOWN"}
