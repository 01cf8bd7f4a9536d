"""Nodes of small units, with every awkward case."""

import pytest
from pyspark.sql import functions as F

from folioscope.operators import document_tree

ROWS = "doc string, unit_id string, source_seq long, table_id string, row_no int, column_no int, cell_id string, paragraph_id string, text string, raw_run_ids array<string>, binding string"
RUNS = "doc string, source_seq long, position int, raw_run_id string, text string"


@pytest.fixture(scope="module")
def nodes(spark):
    rows = [
        ("d", "a", 1, None, None, None, None, "p1", "Name: ____", ["r1"], "bound"),
        ("d", "a", 2, "t", 1, 1, "c1", "p2", "x", ["r2", " ", None, "r3"], "bound"),
        ("d", "a", 3, "t", 1, 1, "c1", "p3", "y", ["r4"], "bound"),
        ("d", "a", 4, "t", 1, 2, "c2", "p4", "x again", ["r4", "r3", "r2", "r2"], "bound"),  # the set of c1: a merged cell
        ("d", "a", 5, "t", 2, 1, None, None, "", [], "unbound"),  # empty sets are nobody's alias
        ("d", "a", 6, "t", 2, 2, None, None, None, None, None),
        ("d", "a", 7, "t", None, None, None, None, "lost", ["r7"], "missing"),
        ("d", "a", 8, None, None, None, None, None, "two runs, one fact", ["r8", "r9"], "bound"),
        ("d", "b", 9, "t", 3, 1, "c9", "p9", "of the same table", ["r4", "r2", "r3"], "bound"),
        ("d", None, 10, None, None, None, None, "p10", "no unit", ["r10"], "bound"), ("d", "a", None, None, None, None, None, "p11", "no place", [], "bound"),
        (None, "a", 1, None, None, None, None, "p1", "a null document", ["r1"], "bound"),
    ]
    runs = [("d", 1, 0, "r1", "Name: ____"), ("d", 2, 0, "r3", "by id"), ("d", 2, 1, "zz", "by place"), ("d", 2, 5, "r3", "the last by id"), ("d", 3, 0, "r4", "y"), ("d", 7, 1, "r0", "elsewhere"), ("d", 8, 0, "r8", "two runs"), ("d", 9, 0, None, None)]
    made = document_tree.document_nodes(spark.createDataFrame(rows, ROWS), spark.createDataFrame(runs, RUNS), ["doc"])
    return document_tree.nested_sets(made, ["doc", "unit_id"]).collect()


def of(nodes, unit="a", doc="d"):
    return {n.node: n for n in nodes if n.doc == doc and n.unit_id == unit}


def test_order_and_parents(nodes):
    a = of(nodes)
    assert [n.node for n in sorted(a.values(), key=lambda n: n.first)] == [
        "unit:a", "unit:a/paragraph:p1", "run:r1", "span:r1@000000:000005", "span:r1@000005:000006", "span:r1@000006:000010",
        "table:t", "table:t/row:001", "table:t/row:001/cell:001", "table:t/row:001/cell:001/paragraph:p2", "run:r2", "span:r2@000000:000005", "run:r3", "span:r3@000000:000014",
        "table:t/row:001/cell:001/paragraph:p3", "run:r4", "span:r4@000000:000001", "table:t/row:001/cell:002",
        "table:t/row:002", "table:t/row:002/cell:001", "table:t/row:002/cell:001/paragraph:5", "table:t/row:002/cell:002", "table:t/row:002/cell:002/paragraph:6",
        "table:t/row:1000001", "table:t/row:1000001/cell:001", "table:t/row:1000001/cell:001/paragraph:7", "run:r7", "span:r7@000000:000000",
        "unit:a/paragraph:8", "run:r8", "span:r8@000000:000008", "run:r9", "span:r9@000000:000000",
    ]
    for n in a.values():
        under = [m for m in a.values() if n.first <= m.first <= n.last]
        assert {m.node for m in under} == {m.node for m in a.values() if m.key.startswith(n.key)}
        assert n.n_leaves == sum(m.first == m.last for m in under)
        assert n.parent is None or a[n.parent].first < n.first <= a[n.parent].last
    assert a["run:r2"].text == "by id"  # the fact at its position, whatever its id


def test_facts_and_aliases(nodes):
    a = of(nodes)
    assert a["run:r3"].text == "the last by id" and a["table:t/row:001/cell:001"].text == "x\ny" and a["table:t/row:001"].text == "x\ny | x again"
    alias = a["table:t/row:001/cell:002"]
    assert (alias.alias_of, alias.children_complete, alias.content_complete, alias.unbound, alias.n_leaves) == ("table:t/row:001/cell:001", False, False, 3, 1)
    assert a["table:t/row:002/cell:001"].alias_of is None and a["table:t/row:002/cell:002"].alias_of is None
    assert of(nodes, "b")["table:t/row:003/cell:001"].alias_of is None  # another unit's table


def test_completeness(nodes):
    a = of(nodes)
    state = {k: (n.children_complete, n.content_complete, n.unbound, n.omitted) for k, n in a.items()}
    assert state["run:r9"] == (True, False, 1, 0) and state["run:r8"] == (True, True, 0, 0) and state["unit:a/paragraph:8"] == (True, False, 0, 0)
    assert state["table:t/row:001"] == (True, False, 3, 0) and state["table:t/row:002"] == (True, True, 2, 0) and state["table:t/row:1000001"] == (True, True, 2, 0)
    assert state["table:t"] == (False, False, 8, 1) and state["unit:a"] == (True, False, 8, 1)
    assert of(nodes, "a", None) == {}


def test_empty(spark):
    rows, runs = spark.createDataFrame([], ROWS), spark.createDataFrame([], RUNS)
    made = document_tree.nested_sets(document_tree.document_nodes(rows, runs, ["doc"]), ["doc", "unit_id"])
    assert made.count() == 0 and document_tree.table_cells(rows, ["doc"]).filter(F.lit(True)).count() == 0


def test_nested_sets_of_odd_keys(spark):
    part = lambda *numbers: "".join(f"{n:012d}" for n in numbers)
    rows = [("a", "top", part()), ("a", "x", part(1)), ("a", "y", part(1, 1)), ("a", "twin 2", part(2)), ("a", "twin 1", part(2)), ("a", "z", part(2, 5, 1)), ("a", "lost 1", part(3)), ("a", "lost 2", part(3)),
            ("b", "y", part(1, 1)), ("b", "x", part(4)), (None, "n", part(1)), ("b", "no key", None)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")  # so that trees go on from batch to batch
    try:
        got = document_tree.nested_sets(spark.createDataFrame(rows, "doc string, node string, key string").repartition(3), ["doc"]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r.doc, r.node): (r.first, r.last, r.n_leaves) for r in got} == {
        ("a", "top"): (1, 8, 2), ("a", "x"): (2, 3, 1), ("a", "y"): (3, 3, 1), ("a", "twin 1"): (4, 6, 1), ("a", "twin 2"): (5, 7, 1), ("a", "z"): (6, 6, 1), ("b", "y"): (2, 2, 1), ("b", "x"): (3, 3, 1)}
