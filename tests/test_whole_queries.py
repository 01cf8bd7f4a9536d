"""Queries over whole tables, on rows that the cut ones leave out."""

from folioscope.plans import registry


def run(spark, folder, name, **tables):
    for t, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
    df = registry.queries()[name](spark, str(folder))
    return {tuple(r) for r in df.collect()}


def test_anchors_beyond_the_beginning_and_in_any_language(spark, tmp_path):
    data = [(1, "ab " * 100 + "later", "en"), (2, "x 中文文字 y", "zh"), (3, "word", None), (4, None, "en")]
    assert run(spark, tmp_path, "anchors", documents=(data, "doc_id long, text string, lang string")) == {(1, "later"), (2, "中文文字"), (3, "word"), (4, "")}


def test_heading_scores_of_all_turns(spark, tmp_path):
    data = [(1, 0, "1. Aims"), (1, 1, "An aim"), (2, 0, "中文"), (2, 1, None)]
    out = run(spark, tmp_path, "heading_scores", conversations=(data, "conv_id long, turn int, text string"))
    assert out == {(1, 0, 93), (1, 1, 73), (2, 0, 0), (2, 1, 0)}


def test_gold_faults_in_whole_texts(spark, tmp_path):
    data = [("a", 1, "x" * 50), ("a", 7, "y" * 40), ("a", 10, "z" * 30), ("a", 14, "short"), ("a", 20, "abc"), ("a", 21, "ab"), ("a", 3, "")]
    out = run(spark, tmp_path, "gold_faults", documents=(data, "source string, doc_id long, text string"))
    assert out == {("a", "7", "spans_incomplete"), ("a", "10", "spans_not_contiguous"), ("a", "14", "spans_incomplete"), ("a", "20", "spans_not_contiguous")}


def test_spread_tokens_of_long_documents_and_later_words(spark, tmp_path):
    bench = [(1, "a b c d e sixth seventh"), (2, "a x")]
    docs = [("s", 1, "sixth " + "long " * 300), ("s", 2, "seventh"), ("s", 2, "seventh"), ("t", 3, "x y")]
    tables = {"benchmark": (bench, "item_id long, text string"), "documents": ([(*d, len(d[2])) for d in docs], "source string, doc_id long, text string, n_chars long")}
    assert run(spark, tmp_path, "spread_tokens", **tables) == {(1, "s", 2, 2, 1)}


def test_needles_are_whole_items(spark, tmp_path):
    docs = [(1, "x one two three four y"), (2, "one two three five")]
    assert run(spark, tmp_path, "needle_documents", benchmark=([(7, "one two three four")], "item_id long, text string"), documents=(docs, "doc_id long, text string")) == {(7, 1, 1)}


def test_all_customers_orders_and_suppliers(spark, tmp_path):
    tables = {
        "customer": ([(1, 4), (601, 5)], "c_custkey long, c_nationkey int"),
        "supplier": ([(601, 5), (2, 6)], "s_suppkey long, s_nationkey int"),
        "orders": ([(2, 601, "P", "1"), (7, 601, "P", "1"), (10, 1, "F", "1")], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string"),
        "lineitem": ([(2, 601), (7, 601), (7, 11), (2, 21)], "l_orderkey long, l_suppkey long"),
    }
    assert run(spark, tmp_path, "shared_parts", **tables) == {(601, 2, 7, 1)}
    assert run(spark, tmp_path, "nations_apart") == {(4, "missing"), (6, "unexpected")}
    assert run(spark, tmp_path, "bound_bundle") == {("1", "undeclared"), ("601", "bound")}
    assert run(spark, tmp_path, "customer_verdicts") == {(1, "PASS"), (601, "FAIL")}


def test_deep_nodes_of_trees(spark, tmp_path):
    part = [("b", i, 2, 1.0) for i in range(1, 401)]
    leaves = run(spark, tmp_path, "settled_leaves", part=(part, "p_brand string, p_partkey long, p_size int, p_retailprice double"))
    assert {leaf for _, leaf, _, _ in leaves} == set(range(201, 401)) and all(s is not None for _, _, s, _ in leaves)
    faults = run(spark, tmp_path, "tree_faults")
    assert {("b", 82, "cycle"), ("b", 325, "unknown_parent"), ("b", 247, "several_parents")} <= faults
