import collections

from folioscope.llm import mixing
from tests.llm.fixtures import awkward, empty, prose


def plain_targets(sizes):
    """Shares excess again by weight, round after round, as the contract words it."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    want, target, capped = 1.5 * sum(sizes.values()), {}, set()
    while True:
        free = [s for s in order if s not in capped]
        left = want - sum(2 * sizes[s] for s in capped)
        target = {s: 2.0 * sizes[s] for s in capped} | {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if target[s] > 2 * sizes[s]}
        if not over:
            return target
        capped |= over


def test_targets_and_taken(spark):
    rows = [(i, prose(i, 5 + i % 60), None if i % 11 == 0 else ["hot", "hot", "b", "c", "ü", "Z"][i % 6]) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix_plan(df).collect()
    sizes = collections.Counter()
    for _, text, source in rows:
        sizes[source] += len(text.split())
    want, taken = plain_targets(sizes), collections.Counter()
    for r in out:
        assert r["size"] == len(r["text"].split()) and r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - want[r["source"]]) < 1e-6
        assert r["copies"] in (0, 1, 2)
        taken[r["source"]] += r["copies"] * r["size"]
    for s, t in want.items():
        assert abs(taken[s] - t) < max(60, 0.03 * t)
    again = mixing.mix_plan(df.repartition(7)).collect()
    assert sorted((r["doc_id"], r["copies"]) for r in out) == sorted((r["doc_id"], r["copies"]) for r in again)


def test_mix_repeats_rows(spark):
    df = spark.createDataFrame([(i, prose(i, 20), "a" if i % 3 else "b") for i in range(300)], "doc_id long, text string, source string")
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_plan(df).collect()}
    seen = collections.Counter(r["doc_id"] for r in mixing.mix(df).collect())
    assert seen == collections.Counter({k: v for k, v in copies.items() if v})


def test_awkward_and_empty(spark):
    docs = awkward(spark)
    out = mixing.mix_plan(docs)
    assert out.columns == [*docs.columns, "_size", "source_size", "target", "copies"]
    assert out.count() == docs.count()
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.mix_plan(empty(spark)).count() == mixing.mix(empty(spark)).count() == 0
    blank = spark.createDataFrame([(1, " ", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [(r["target"], r["copies"]) for r in mixing.mix_plan(blank).collect()] == [(0.0, 0)] * 2


def test_no_python_in_the_plan(spark):
    plan = mixing.mix(awkward(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan


def test_clashing_names(spark):
    docs = spark.range(60).selectExpr("id AS doc_id", "repeat('w ', CAST(id % 9 AS INT)) AS text", "concat('s', id % 3) AS source", "1 AS mix_key", "1 AS mix_key_of", "1 AS mix_key_", "1 AS mix_row_start", "1 AS mix_start", "1 AS mix_offset", "1 AS mix_salt_of", "1 AS size", "1 AS again")
    plain = mixing.mix(docs.select("doc_id", "text", "source"))
    got = mixing.mix(docs)
    assert got.columns == docs.columns and sorted(got.select("doc_id").collect()) == sorted(plain.select("doc_id").collect())
