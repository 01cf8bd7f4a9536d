"""Work that grows with the rows, not with pairs of them: rows that the steps of a plan put out."""

import random
from pathlib import Path

import pytest

from folioscope.operators import document_tree, matching, sequence, unit_audit
from folioscope.plans import audits
from folioscope.sources.shared import shared_dir, written


def most_rows(spark, df):
    """The rows of ``df``, and the most that a step of its plan put out."""
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got, most, plans = df.collect(), 0, [df._jdf.queryExecution().executedPlan()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    while plans:
        plan = plans.pop()
        metric, children = plan.metrics().get("numOutputRows"), plan.children()
        most = max(most, metric.get().value() if metric.isDefined() else 0)
        plans += [children.apply(i) for i in range(children.size())]
    return got, most


def test_ranked_match_makes_no_row_for_each_equal_right_row(spark):
    left = spark.range(400).selectExpr("id", "if(id % 2 = 0, id, -1) AS num", "'s' AS style")
    right = spark.range(300).selectExpr("id AS num", "if(id < 290, 's', 't') AS style", "300 - id AS o")
    got, most = most_rows(spark, matching.ranked_match(left, ["id"], [(right, ["num"], ["num"]), (right, ["style"], ["style"])], ["o"]))
    assert {(r["id"], r["rank"], r["m_num"]) for r in got} == {(i, 1, i) if i % 2 == 0 and i < 300 else (i, 2, 289) for i in range(400)}
    assert most <= 1200


def test_prefix_match_makes_no_row_for_each_pair_with_one_beginning(spark):
    names = ["part", "part a", "part a/b", "part b"]
    left = spark.range(400).selectExpr("'g' AS g", "id AS key", f"element_at(array({', '.join(map(repr, [*names, 'part a/run']))}), cast(id % 5 + 1 as int)) AS ref")
    right = spark.range(400).selectExpr("'g' AS g", "400 - id AS other", f"element_at(array({', '.join(map(repr, names[1:]))}), cast(id % 3 + 1 as int)) AS name")
    got, most = most_rows(spark, matching.prefix_match(left, right, ["g"], "ref", "name", ["key"], ["other"], 4))
    firsts = {n: min(400 - i for i in range(400) if i % 3 == k) for k, n in enumerate(names[1:])}
    first = {0: (min(firsts.values()), False), 1: (firsts["part a"], True), 2: (firsts["part a/b"], True), 3: (firsts["part b"], True), 4: (firsts["part a"], False)}
    assert {(r["key"], r["other"], r["exact"]) for r in got} == {(i, *first[i % 5]) for i in range(400)}
    assert most <= 1200


@pytest.mark.parametrize("length", [0, 2])
def test_prefix_match_as_by_pairs(spark, length):
    draw = random.Random(length)
    text = lambda: draw.choice([None, "".join(draw.choice("aä") for _ in range(draw.randint(0, 5)))] + ["".join(draw.choice("ab😀") for _ in range(draw.randint(0, 4))) for _ in range(4)])
    left = [(draw.choice("xyz") if i % 9 else None, i, text()) for i in range(150)]
    right = [(draw.choice("xyz") if i % 7 else None, 1000 - i, text()) for i in range(60)]
    out = matching.prefix_match(spark.createDataFrame(left, "g string, key int, ref string"), spark.createDataFrame(right, "g string, other int, name string"), ["g"], "ref", "name", ["key"], ["other"], length)
    want = set()
    for g, key, ref in left:
        hits = [(ref != name, other, name) for h, other, name in right if None not in (g, h, ref, name) and g == h and (ref.startswith(name) or name.startswith(ref)) and ref[:length] == name[:length]]
        if hits:
            want.add((g, key, ref, min(hits)[1], min(hits)[2], not min(hits)[0]))
    assert {(r["g"], r["key"], r["ref"], r["other"], r["name"], r["exact"]) for r in out.collect()} == want


def test_tables_with_small_files_and_many_rows_are_not_sent_to_every_task(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    few, many = (written(spark.range(0, n, 1, 2).selectExpr("id % 50 AS a", "id % 3 AS b")) for n in (1000, 1_000_000))
    assert "BroadcastHashJoin" in plan(few.join(few.withColumnRenamed("b", "c"), "a")) and "SortMergeJoin" in plan(many.join(many.withColumnRenamed("b", "c"), "a"))


def test_nested_sets_keep_what_nodes_hold_once(spark):
    nodes = spark.range(0, 2000, 1, 2).selectExpr("id % 7 AS doc", "concat('n', id) AS node", "lpad(cast(id as string), 12, '0') AS key", "concat_ws('', transform(sequence(1, 40), i -> sha2(cast(id * 100 + i as string), 256))) AS text")
    folder = Path(shared_dir(spark).removeprefix("file:"))
    size = lambda: sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())
    before = size()
    got = document_tree.nested_sets(nodes, ["doc"]).select("doc", "node", "first", "last", "n_leaves", "text").collect()
    assert {(r["doc"], r["node"], r["first"], r["last"], r["n_leaves"]) for r in got} == {(i % 7, f"n{i}", i // 7 + 1, i // 7 + 1, 1) for i in range(2000)}
    assert size() - before < 2000 * 40 * 64


def test_integer_ranges_keep_no_group_of_all_ranges(spark):
    edge = (1 << 63) - 1
    rows = [("a", v) for v in (5, 6, 6, 7, 9, -1, -1, None, edge, edge - 1, -edge - 1)] + [(None, 1), (None, 2)]
    out = sequence.integer_ranges(spark.createDataFrame(rows, "g string, v long"), ["g"], "v")
    assert {tuple(r) for r in out.collect()} == {("a", -edge - 1, -edge - 1, 1), ("a", -1, -1, 1), ("a", 5, 7, 3), ("a", 9, 9, 1), ("a", edge - 1, edge, 2), (None, 1, 2, 2)}
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan[: plan.index("Window")].count("HashAggregate") == 0 and plan.count("Sort [") == 1


def test_binding_findings_make_sections_for_customers_not_for_orders(spark, tmp_path):
    spark.range(1, 401).selectExpr("id AS o_orderkey", "id % 2 AS o_custkey", "timestamp_ntz '1995-01-01 00:00:00' AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(1, 401).selectExpr("id AS l_orderkey", "id AS l_suppkey", "'N' AS l_returnflag", "timestamp_ntz '1995-01-02 00:00:00' AS l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    got, most = most_rows(spark, audits.binding_findings(spark, str(tmp_path)))
    unknown = {(r["o_custkey"], r["unit_id"]) for r in got if r["check"] == "section_ref_unknown"}
    unit = lambda k: "other" if k % 30 == 0 else "twin" if k % 11 == 0 else str(k)
    assert unknown == {(k % 2, unit(k)) for k in range(1, 401) if k % 50 > 44} and most <= 2000


def test_anchors_cut_texts_only_at_the_sizes_of_titles(spark):
    entries = spark.range(400).selectExpr("id % 2 AS doc", "id AS seq", "concat('some long title ', id) AS text")
    terms = spark.createDataFrame([(0, "a", 0, "some long title 7"), (0, "b", 0, "so"), (1, "a", 0, "some long title 8")], "doc long, unit_id string, tier int, term string")
    owners = spark.createDataFrame([(0, 70, "a")], "doc long, seq long, unit_id string")
    got, most = most_rows(spark, unit_audit.anchored(entries, terms, owners, ["doc"]))
    assert {(r["doc"], r["unit_id"], r["n_matched"], r["owned"]) for r in got} == {(0, "a", 3, True), (0, "b", 0, False), (1, "a", 3, False)} and most <= 800


def test_spread_tokens_unite_a_set_number_of_bitmaps_in_a_task(spark, monkeypatch):
    monkeypatch.setattr(matching, "TASK_BITMAPS", 4)
    items, places = spark.range(20).selectExpr("id % 10 AS item", "id AS token"), spark.range(40).selectExpr("'s' AS source", "id AS place", "id % 20 AS token")
    out = matching.tokens_spread(items, places, ["item"], ["source"], "token", "place", 2, close=True)
    plan = out._jdf.queryExecution().analyzed().toString()
    assert any("RepartitionByExpression" in line and line.rstrip().endswith("], 6") for line in plan.splitlines()), plan  # 21 bitmaps, as place 0 lies in a bucket of its own, 4 a task
    assert {tuple(r) for r in out.collect()} == {(i, "s", 2, 4, i) for i in range(10)}


def test_anchors_make_no_row_for_each_size_of_title(spark):
    entries = spark.range(400).selectExpr("id % 2 AS doc", "id AS seq", "concat('abcdefgh', id) AS text")
    terms = spark.range(3, 10).selectExpr("0L AS doc", "concat('u', id) AS unit_id", "0 AS tier", "left('abcdefghi', cast(id AS int)) AS term")
    owners = spark.createDataFrame([(0, 2, "u3")], "doc long, seq long, unit_id string")
    got, most = most_rows(spark, unit_audit.anchored(entries, terms, owners, ["doc"]))
    assert {(r["unit_id"], r["n_matched"], r["owned"]) for r in got} == {(f"u{n}", 0 if n == 9 else 3, n == 3) for n in range(3, 10)} and most <= 800


def test_document_nodes_keep_no_texts_of_paragraphs(spark):
    long = "concat_ws('', transform(sequence(1, 20), i -> sha2(cast(id * 100 + i as string), 256)))"
    rows = spark.range(600).selectExpr("id % 7 AS doc", "'u' AS unit_id", "id AS source_seq", "CAST(null AS string) AS table_id", "CAST(null AS int) AS row_no", "CAST(null AS int) AS column_no", "CAST(null AS string) AS cell_id",
                                       "concat('p', id) AS paragraph_id", f"{long} AS text", "array('r') AS raw_run_ids", "'bound' AS binding")
    runs = spark.range(600).selectExpr("id % 7 AS doc", "id AS source_seq", "0 AS position", "'r' AS raw_run_id", f"{long} AS text")
    folder = Path(shared_dir(spark).removeprefix("file:"))
    size = lambda: sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())
    before = size()
    got = document_tree.nested_sets(document_tree.document_nodes(rows, runs, ["doc"], spans=False), ["doc", "unit_id"]).collect()
    assert len(got) == 1207 and {(r["first"], r["last"], r["n_leaves"]) for r in got if r["kind"] == "unit"} == {(1, 2 * n + 1, n) for n in (85, 86)}
    assert size() - before < 600 * 64


def test_nested_sets_move_nodes_once(spark):
    nodes = spark.range(2000).selectExpr("id % 7 AS doc", "concat('n', id) AS node", "lpad(cast(id as string), 12, '0') AS key")
    out = document_tree.nested_sets(nodes, ["doc"])
    assert out.count() == 2000
    assert out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange") == 1
