import math

import numpy as np
import pyarrow.dataset as ds
import pytest

from folioscope.llm import whitening

SF = "/root/testdata/sf0.01"


def brute(rows):
    """Rows by (vec_id, component): n, deviation, the absolute whitened value, explained."""
    x = np.array([[math.floor(1024 * float(c)) + 100_000 for c in v] for _, v in rows], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    deviation = ((n * x - sums) ** 2).sum(axis=1)
    z = ((n * x - sums).astype(np.float64)) / n
    v = z.T @ z / n
    e, u = np.linalg.eigh(v)
    order = np.argsort(-e, kind="stable")[:8]
    out = {}
    for (i, _), dev, row in zip(rows, deviation, z @ u[:, order]):
        for j, (k, w) in enumerate(zip(order, row)):
            out[i, j + 1] = (n, int(dev), abs(w) / math.sqrt(e[k]) if e[k] > 1e-9 else 0.0, e[k] / e.sum() if e[k] > 1e-9 else 0.0)
    return out


def check(got, want):
    assert len(got) == len(want)
    for r in got:
        n, dev, w, e = want[r.vec_id, r.component]
        assert (r.n, r.deviation, int(r.deviation_exact)) == (n, dev, dev)
        assert abs(r.whitened) == pytest.approx(w, abs=1e-8) and r.explained == pytest.approx(e, rel=1e-9, abs=1e-12)
        assert r.identity_error < 1e-9


def test_against_numpy(spark):
    table = ds.dataset(f"{SF}/embeddings.parquet").to_table()
    got = whitening.op12_whitening(spark, SF)
    assert dict(got.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double", "deviation_exact": "decimal(38,0)"}
    rows = got.collect()
    check(rows, brute(list(zip(table["vec_id"].to_pylist(), table["embedding"].to_pylist()))))
    signs = {}
    for r in rows:
        signs.setdefault(r.component, []).append(r.whitened)
    assert all(np.mean(np.square(w)) == pytest.approx(1) for w in signs.values())


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, n int, i string")


def test_many_blocks(spark, monkeypatch):
    """Blocks of a few rows and rows in several parts give the same."""
    monkeypatch.setattr(whitening, "LEAST_ROWS", 7)
    monkeypatch.setattr(whitening, "BLOCKS", 10)
    rng = np.random.default_rng(4)
    rows = [(i, (rng.standard_normal(12) * np.arange(1, 13)).tolist()) for i in range(100)]
    check(whitening.whiten(frame(spark, rows).repartition(6)).collect(), brute(rows))


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    sound = [(1, [0.5, 1.0, 3.0]), (2, [0.25, -1.0, 3.0]), (3, [2.0, 7.0, 3.0]), (4, [-1.0, 0.125, 3.0]), (None, [0.0, 0.0, 3.0])]
    bad = [(5, None), (6, []), (7, [nan, 1.0, 1.0]), (8, [1.0, -inf, 1.0]), (9, [None, 1.0, 1.0]), (10, [1.0]), (11, [1.0, 2.0])]
    got = whitening.whiten(frame(spark, sound + bad)).collect()
    check(got, brute(sound))  # the third entry has no variance
    assert {r.whitened for r in got if r.component == 3} == {0.0}
    twice = whitening.whiten(frame(spark, sound + sound)).collect()
    assert len(twice) == 30 and {r.n for r in twice} == {10}
    alone = whitening.whiten(frame(spark, sound[:1])).collect()
    assert [(r.whitened, r.explained, r.deviation, r.identity_error) for r in alone] == [(0.0, 0.0, 0, 0.0)] * 3
    assert whitening.whiten(frame(spark, [])).count() == 0 and whitening.whiten(frame(spark, bad[:5])).count() == 0
    huge = whitening.whiten(frame(spark, [(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [0.0, 5.0])])).collect()
    assert len(huge) == 6 and all(r.deviation is None for r in huge if r.vec_id == 1)
