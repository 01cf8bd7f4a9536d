"""Tree operators against plain walks, on random trees, long chains, stars and rings."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from folioscope.operators import hierarchy, slices
from folioscope.sources.shared import shared_dir

SCHEMA = "t string, node long, parent long, n long, ok boolean, v long, id string, up string"


def table(spark, edges, seed=0):
    rng = random.Random(seed)
    rows = [(t, n, p, rng.choice([None, 1, 2, 5]), rng.random() < 0.8, rng.choice([None, None, 3, 4]), "x", "y") for t, n, p in edges]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


def random_trees(seed):
    rng, edges = random.Random(seed), []
    for t in "ab":
        names = rng.sample(range(1000), 60)
        for i, n in enumerate(names):
            back = rng.choice([1, 1, 1, 2, 5, i or 1])
            edges.append((t, n, names[max(0, i - back)] if i > 2 else None))
    return edges


def below(rows):
    kids = {}
    for t, n, p, *_ in rows:
        kids.setdefault((t, p), []).append(n)

    def walk(t, n):
        stack, out = [n], []
        while stack:
            x = stack.pop()
            out.append(x)
            stack += kids.get((t, x), [])
        return out

    return kids, {(t, n): walk(t, n) for t, n, *_ in rows}


@pytest.mark.parametrize("seed", [1])
def test_against_plain_walks(spark, seed):
    rows, df = table(spark, random_trees(seed), seed)
    by_node = {(r[0], r[1]): r for r in rows}
    kids, under = below(rows)
    up = {(t, n): p for t, n, p, *_ in rows}
    got = {(r.t, r.node): r for r in hierarchy.roll_up(df, ["t"], ["n"], ["ok"], ["v"]).collect()}
    assert len(got) == len(rows)
    for (t, n), all_below in under.items():
        some = [by_node[t, x] for x in all_below]
        r = got[t, n]
        numbers, values = [x[3] for x in some if x[3] is not None], [x[5] for x in some if x[5] is not None]
        assert (r.n, r.ok, r.v, r.n_nodes) == (sum(numbers) if numbers else None, all(x[4] for x in some), min(values, default=None), len(some))
    sets = {(r.t, r.node): r for r in hierarchy.leaf_sets(df, ["t"]).collect()}
    leaves = {k: [x for x in v if (k[0], x) not in kids] for k, v in under.items()}
    assert {k: (r.n_leaves, r.first_leaf) for k, r in sets.items()} == {k: (len(v), min(v)) for k, v in leaves.items()}
    inherited = {(r.t, r.node): (r.v, r.depth) for r in hierarchy.resolve_inherited(df, ["t"], ["v"]).collect()}
    for (t, n), (v, depth) in inherited.items():
        path = [n]
        while up[t, path[-1]] is not None:
            path.append(up[t, path[-1]])
        assert depth == len(path) - 1 and v == next((by_node[t, x][5] for x in path if by_node[t, x][5] is not None), None)
    # depth first: roots and siblings by their value, nulls first, then by node
    order = {}

    def place(t, n, depth, at):
        first = at
        for c in sorted(kids.get((t, n), []), key=lambda c: (by_node[t, c][5] or 0, c)):
            at = place(t, c, depth + 1, at + 1)
        order[t, n] = (depth, first, at)
        return at

    for t in "ab":
        at = 0
        for root in sorted(kids[t, None], key=lambda c: (by_node[t, c][5] or 0, c)):
            at = place(t, root, 0, at + 1)
    assert {(r.t, r.node): (r.depth, r.first, r["last"]) for r in hierarchy.preorder(df, ["t"], "v").collect()} == order


def test_chain_star_and_rings(spark):
    n = 150
    edges = [("chain", i, i - 1 if i else None) for i in range(n)] + [("star", i, 0 if i else None) for i in range(n)]
    edges += [("ring", i, (i + 1) % 7) for i in range(7)] + [("ring", 100 + i, 99 + i if i else 3) for i in range(50)] + [("comb", i, None if not i else i - 1 if i % 2 else i - 2) for i in range(100)]
    _, df = table(spark, edges)
    total = {(r.t, r.node): r.n_nodes for r in hierarchy.roll_up(df, ["t"]).collect()}
    assert all(total["chain", i] == n - i for i in range(n)) and total["star", 0] == n and total["star", 5] == 1
    assert all(total["ring", i] is None for i in range(7)) and all(total["ring", 100 + i] == 50 - i for i in range(50))
    assert total["comb", 0] == 100 and total["comb", 98] == 2 and total["comb", 50] == 50
    depth = {(r.t, r.node): r.depth for r in hierarchy.resolve_inherited(df, ["t"], []).collect()}
    assert all(depth["chain", i] == i for i in range(n)) and depth["star", 9] == 1 and depth["ring", 149] is None
    found = {(r.t, r.node, r.error) for r in hierarchy.tree_errors(df, ["t"]).collect()}
    assert found == {("ring", i, "cycle") for i in range(7)} | {("ring", i, "unreachable") for i in [*range(7), *range(100, 150)]}
    pre = {(r.t, r.node): (r.first, r["last"]) for r in hierarchy.preorder(df, ["t"], "n").filter("t <> 'ring'").collect()}
    assert len(pre) == 2 * n + 100 and all(pre["chain", i] == (i + 1, n) for i in range(n))
    assert hierarchy.ancestors(df.filter("t = 'comb'"), ["t"]).filter("node = 99").count() == 51


@pytest.fixture
def small_slices(spark, monkeypatch):
    monkeypatch.setattr(slices, "ROWS", 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_sums_across_slices_and_rings(spark, small_slices):
    edges = random_trees(2) + [("ring", i, (i + 1) % 9) for i in range(9)] + [("ring", 100 + i, 99 + i if i else 3) for i in range(20)] + [("near", 1, 2), ("near", 2, 1), ("near", 3, 2), ("near", 4, 4)]
    rows, df = table(spark, edges, 2)
    by_node, (_, under) = {(r[0], r[1]): r for r in rows}, below([r for r in rows if r[0] in "ab"])
    got = {(r.t, r.node): r for r in hierarchy.roll_up(df, ["t"], ["n"], ["ok"], ["v"]).collect()}
    assert len(got) == len(rows)
    for (t, n), all_below in under.items():
        some, r = [by_node[t, x] for x in all_below], got[t, n]
        numbers, values = [x[3] for x in some if x[3] is not None], [x[5] for x in some if x[5] is not None]
        assert (r.n, r.ok, r.v, r.n_nodes) == (sum(numbers) if numbers else None, all(x[4] for x in some), min(values, default=None), len(some))
    assert [got["ring", i].n_nodes for i in [*range(9), *range(100, 120)]] == [None] * 9 + list(range(20, 0, -1))
    assert [got["near", i].n_nodes for i in (1, 2, 3, 4)] == [None, None, 1, None]


def test_climbs_across_slices_and_rings(spark, small_slices):
    edges = random_trees(3) + [("ring", i, (i + 1) % 9) for i in range(9)] + [("ring", 100 + i, 99 + i if i else 3) for i in range(20)]
    rows, df = table(spark, edges, 3)
    up, value = {(r[0], r[1]): r[2] for r in rows}, {(r[0], r[1]): r[5] for r in rows}
    for r in hierarchy.resolve_inherited(df, ["t"], ["v"]).collect():
        path = [r.node]
        while up[r.t, path[-1]] is not None and up[r.t, path[-1]] not in path:
            path.append(up[r.t, path[-1]])
        assert (r.v, r.depth) == (next((value[r.t, x] for x in path if value[r.t, x] is not None), None), None if r.t == "ring" else len(path) - 1)
    pairs = {(r.t, r.node, r.ancestor): r.distance for r in hierarchy.ancestors(df, ["t"]).collect()}
    for (t, n), _ in up.items():
        path = [n]
        while up[t, path[-1]] is not None and up[t, path[-1]] not in path:
            path.append(up[t, path[-1]])
        assert {a: d for (s, x, a), d in pairs.items() if (s, x) == (t, n)} == {a: d for d, a in enumerate(path)}


def test_preorder_of_one_slice_takes_no_rounds(spark):
    nodes = spark.range(3000).selectExpr("'t' AS t", "id AS node", "if(id > 0, id - 1, null) AS parent")
    tables = lambda: len(list(Path(shared_dir(spark).removeprefix("file:")).glob("rows-*")))
    before = tables()
    assert hierarchy.preorder(nodes, ["t"], "node").filter("depth <> node OR first <> node + 1 OR last <> 3000").count() == 0
    assert tables() - before <= 9


def test_ancestors_write_each_pair_once(spark):
    n, folder = 128, Path(shared_dir(spark).removeprefix("file:"))
    nodes = spark.range(n).selectExpr("'t' AS t", "id AS node", "if(id > 0, id - 1, null) AS parent")
    before = set(folder.glob("rows-*"))
    assert hierarchy.ancestors(nodes, ["t"]).filter("distance = node - ancestor").count() == n * (n + 1) // 2
    assert sum(spark.read.parquet(str(f)).count() for f in set(folder.glob("rows-*")) - before) == n * (n - 1) // 2


def test_paths_within_a_slice_take_no_rounds(spark):
    nodes = spark.range(3000).selectExpr("'t' AS t", "id AS node", "if(id > 0, id - 1 - id % 3 % least(2, id), null) AS parent", "id AS n")
    tables = lambda: len(list(Path(shared_dir(spark).removeprefix("file:")).glob("rows-*")))
    before = tables()
    tops = hierarchy.roll_up(nodes, ["t"], ["n"], leaves=True).filter("node = 0").select("n", "n_nodes", "n_leaves", "first_leaf").collect()
    leaves = set(range(3000)) - {i - 1 - i % 3 % min(2, i) for i in range(1, 3000)}
    assert tops == [(2999 * 1500, 3000, len(leaves), min(leaves))]
    assert tables() - before <= 3


def test_declared_leaves(spark):
    edges = [("t", i, (i - 1) // 2 if i else None) for i in range(31)] + [("c", i, i - 1 if i else None) for i in range(60)]
    rows, df = table(spark, edges)
    kids, under = below(rows)
    declared = [(t, n, x) for (t, n), v in under.items() for x in v if (t, x) not in kids]
    schema = "t string, node long, leaf long"
    faults = lambda rows: {(r.t, r.node, r.fault) for r in hierarchy.leaf_set_faults(df, spark.createDataFrame(rows, schema), ["t"]).collect()}
    assert faults(declared + declared[:5] + [("t", 999, 1), ("t", None, 1), ("t", 3, None)]) == set()
    wrong = [x for x in declared if x not in {("t", 4, 20), ("t", 30, 30)}] + [("c", 40, 7)]
    assert faults(wrong) == {
        ("t", 4, "not_the_union"), ("t", 4, "not_derived"), ("t", 1, "not_the_union"), ("t", 30, "no_identity"), ("t", 30, "not_derived"), ("t", 14, "not_the_union"),
        ("c", 40, "not_the_union"), ("c", 40, "not_derived"), ("c", 39, "not_the_union"),
    }
    assert hierarchy.leaf_set_faults(df, spark.createDataFrame([], schema), ["t"]).filter("fault = 'no_identity'").count() == 17


def test_nulls_and_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert hierarchy.roll_up(empty, ["t"], ["n"]).count() == hierarchy.preorder(empty, ["t"], "v").count() == hierarchy.tree_errors(empty, ["t"]).count() == 0
    rows = [("t", 1, None), ("t", 2, 1), ("t", 2, 1), ("t", None, 1), (None, 1, None), (None, 2, 1), ("t", 3, 77), ("t", 4, 3)]
    _, df = table(spark, rows)
    got = {(r.t, r.node): r.n_nodes for r in hierarchy.roll_up(df, ["t"]).collect()}
    assert got == {("t", 1): 2, ("t", 2): 1, (None, 1): 2, (None, 2): 1, ("t", 3): 2, ("t", 4): 1}
    assert {(r.node, r.error) for r in hierarchy.tree_errors(df, ["t"]).collect()} == {(2, "repeated"), (3, "unknown_parent"), (3, "unreachable"), (4, "unreachable")}


def walked(edges, told, max_depth, max_calls):
    """The walk of budgeted_walk, node by node."""
    kids, out = {}, {}
    for _, n, p in edges:
        kids.setdefault(p, []).append(n)
    calls = 0

    def settle(n, *row):
        stack = [n]
        while stack:
            x = stack.pop()
            if x in kids:
                stack += kids[x]
            else:
                assert x not in out
                out[x] = row

    def take(n, result, status):
        ok = status == "accepted"
        leaf = n not in kids
        settle(n, result if ok else "keep", "fallback" if not ok else "direct" if leaf else "inherited", status or "manual_review", None, n, n if ok and not leaf else None)

    def visit(n, depth):
        nonlocal calls
        if depth > max_depth or calls >= max_calls:
            reason = f"maximum traversal depth {max_depth} reached" if depth > max_depth else f"maximum decision call budget {max_calls} reached"
            return settle(n, "keep", "fallback", "fallback", reason, n, None)
        calls += 1
        result, status, error, inspect, inline = told.get(n, (None, None, None, [], []))
        if error:
            return settle(n, "keep", "fallback", "failed", error, n, None)
        if result != "split" or status != "accepted" or n not in kids:
            return take(n, result, "manual_review" if result == "split" else status)
        for c in sorted(kids[n]):
            here = next((x for x in inline if x[0] == c), None)
            if here:
                take(c, here[1], here[2])
            elif c in inspect:
                visit(c, depth + 1)
            else:
                settle(c, "keep", "inherited", "accepted", None, c, n)

    for root in sorted(kids.get(None, [])):
        visit(root, 0)
    return out


@pytest.mark.parametrize("max_depth,max_calls", [(7, 25), (2, 512)])
def test_budgeted_walk(spark, max_depth, max_calls):
    rng = random.Random(5)
    edges = [("t", i, None if i < 3 else rng.choice([(i - 1) // 2, i - 3])) for i in range(150)]
    kids = {}
    for _, n, p in edges:
        kids.setdefault(p, []).append(n)
    told = {}
    for _, n, _ in edges:
        own = kids.get(n, [])
        if rng.random() < 0.93:
            result = "split" if own and rng.random() < 0.85 or rng.random() < 0.03 else rng.choice(["keep", "fill", "delete"])
            inline = [(c, rng.choice(["keep", "fill"]), rng.choice(["accepted", "accepted", "manual_review"])) for c in own if rng.random() < 0.1] if result == "split" else []
            told[n] = (result, rng.choice(["accepted"] * 9 + ["manual_review"]), "TimeoutError" if rng.random() < 0.04 else None, [c for c in own if rng.random() < 0.9], inline)
    nodes = spark.createDataFrame(edges, "t string, node long, parent long")
    schema = "t string, node long, result string, status string, error string, inspect array<long>, inline array<struct<node:long,result:string,status:string>>"
    decisions = spark.createDataFrame([("t", n, *x) for n, x in told.items()], schema)
    got = hierarchy.budgeted_walk(nodes, decisions, ["t"], "node", max_depth, max_calls)
    assert got.columns == ["t", "leaf", "action", "resolution", "status", "reason", "settled_at", "inherited_from"]
    assert {r.leaf: tuple(r)[2:] for r in got.collect()} == walked(edges, told, max_depth, max_calls)


def test_deep_decisions(spark):
    nodes = spark.createDataFrame([("t", i, i - 1 if i else None) for i in range(80)], "t string, node long, parent long")
    decisions = nodes.select("t", "node", F.lit("fill").alias("result"), (F.col("node") < 50).alias("descend"))
    assert [tuple(r) for r in hierarchy.sparse_decisions(nodes, decisions, ["t"], most_depth=None).collect()] == [("t", 79, 50, "fill")]
    assert [tuple(r) for r in hierarchy.sparse_decisions(nodes, decisions, ["t"]).collect()] == [("t", 79, 8, "keep")]
