"""Operators on small tables, with ties, nulls and empty inputs."""

import random

import pytest
from pyspark.sql import functions as F

from folioscope.operators import comparators, hierarchy, intervals, ledger, lineage, matching, reviews, scoring, sequence, status


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_runs_fold_with_null_apart_from_false(spark):
    data = [(1, 1, "目", True, None), (1, 2, "录", True, None), (1, 3, "x", False, None), (1, 4, "y", None, None), (1, 5, None, None, None), (1, 6, "z", True, None)]
    df = spark.createDataFrame(data, "p int, at int, text string, bold boolean, size double")
    out = sequence.fold_runs(df, ["p"], ["at"], ["bold", "size"], "text", members="at")
    assert rows(out, "island", "text", "n_rows") == [(1, "目录", 2), (2, "x", 1), (3, "y", 2), (4, "z", 1)]
    assert [r["members"] for r in out.orderBy("island").collect()] == [[1, 2], [3], [4, 5], [6]]


def test_fills(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([None, 5, None, 5, None, 6, None])], "g int, at int, page int")
    both = sequence.neighbour_fill(df, ["g"], ["at"], "page", "filled")
    assert [r["filled"] for r in both.orderBy("at").collect()] == [None, 5, 5, 5, None, 6, None]
    one = sequence.neighbour_fill(df, ["g"], ["at"], "page", "filled", one_sided=True)
    assert [r["filled"] for r in one.orderBy("at").collect()] == [5, 5, 5, 5, None, 6, 6]
    assert sequence.neighbour_fill(df.limit(0), ["g"], ["at"], "page", "filled").count() == 0
    assert {r["filled"] for r in sequence.unanimous_fill(df.filter("page = 5 OR page IS NULL"), ["g"], "page", "filled").collect()} == {5}


def test_intervals_cover_against_brute_force(spark):
    rng = random.Random(1)
    ranges, targets = [], []
    for g in range(120):
        lo = rng.randrange(5)
        targets.append((g, lo, lo + rng.randrange(0, 12)))
        for _ in range(rng.randrange(0, 6)):
            a = rng.randrange(15)
            ranges.append((g, a, a + rng.randrange(0, 6)))
    r, t = spark.createDataFrame(ranges, "g int, start int, end int"), spark.createDataFrame(targets, "g int, target_start int, target_end int")
    got = {x["g"]: x["covered"] for x in intervals.covered(r, t, ["g"]).collect()}
    holes = {}
    for x in intervals.uncovered(r, t, ["g"]).collect():
        holes.setdefault(x["g"], set()).update(range(x["start"], x["end"]))
    for g, lo, hi in targets:
        points = {p for h, a, b in ranges if h == g for p in range(a, b)}
        want = set(range(lo, hi)) - points
        assert got[g] == (not want), (g, lo, hi)
        assert holes.get(g, set()) == want


def test_overlap_join_against_brute_force(spark):
    rng = random.Random(2)
    make = lambda n, w: [(rng.randrange(3), i, a, a + rng.randrange(0, w)) for i in range(n) for a in [rng.randrange(200)]]
    left, right = make(60, 40), make(60, 90)
    a, b = spark.createDataFrame(left, "g int, l_id int, l_start int, l_end int"), spark.createDataFrame(right, "g int, r_id int, r_start int, r_end int")
    want = sorted((x[1], y[1], min(x[3], y[3]) - max(x[2], y[2]) + 1) for x in left for y in right if x[0] == y[0] and x[2] <= y[3] and y[2] <= x[3])
    assert rows(intervals.overlap_join(a, b, ["g"], 16), "l_id", "r_id", "overlap") == want
    kept = intervals.overlap_join(a, b, ["g"], 16, how="left")
    assert {r["l_id"] for r in kept.collect()} == {x[1] for x in left} and kept.filter("r_id IS NOT NULL").count() == len(want)


def test_overlap_predicates(spark):
    df = spark.createDataFrame([(0, 5, 5, 9), (0, 5, 4, 9), (3, 3, 0, 3), (4, 4, 0, 3), (None, 5, 1, 2)], "a int, b int, c int, d int")
    out = df.select(intervals.overlaps_half_open("a", "b", "c", "d").alias("h"), intervals.overlaps_closed("a", "b", "c", "d", unknown=False).alias("k")).collect()
    assert [r["h"] for r in out[:4]] == [False, True, True, False] and [r["k"] for r in out] == [True, True, True, False, False]


def test_range_contract_and_slack(spark):
    df = spark.createDataFrame([("ok", 1, 3, 5), ("ok", 4, 5, 5), ("gap", 1, 2, 5), ("gap", 4, 5, 5), ("lap", 1, 4, 5), ("lap", 4, 4, 5)], "g string, start int, end int, total int")
    assert rows(intervals.range_contract(df, ["g"], "total"), "g", "n_gaps", "n_overlaps", "wrong_end") == [("gap", 1, 0, False), ("lap", 0, 1, True), ("ok", 0, 0, False)]
    slack = intervals.with_slack(df.limit(1), "start", "end", 2, 8, 120).first()
    assert (slack["slack_start"], slack["slack_end"]) == (-1, 121)


def test_last_and_first_wins(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    right = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (3, 1, "c")], "k int, pos int, v string")
    assert [r["v"] for r in matching.lookup(left, right, ["k"], ["pos"]).orderBy("k").collect()] == [None, None, None]
    assert [r["v"] for r in matching.lookup(left, right, ["k"], ["pos"], last=False).orderBy("k").collect()] == [None, "a", None]
    assert matching.lookup(left, right.limit(0), ["k"], ["pos"]).count() == 3


def test_ranked_match_keeps_unmatched(spark):
    left = spark.createDataFrame([(1, "n1", "s1"), (2, "n9", "s1"), (3, None, None)], "id int, num string, style string")
    right = spark.createDataFrame([("n1", "s2", 5), ("n2", "s1", 7), ("n3", "s1", 3)], "num string, style string, o int")
    out = matching.ranked_match(left, ["id"], [(right, ["num"], ["num"]), (right, ["style"], ["style"])], ["o"])
    assert [(r["id"], r["rank"], r["m_num"]) for r in out.orderBy("id").collect()] == [(1, 1, "n1"), (2, 2, "n3"), (3, None, None)]


def test_asof(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5), ("a", 9), ("b", 5)], "g string, at int")
    right = spark.createDataFrame([("a", 1, 10), ("a", 5, 50), ("a", 6, 60)], "g string, at int, v int")
    assert rows(matching.asof_backward(left, right, ["g"], "at", "v").na.fill(-1), "g", "at", "asof_v") == [("a", 1, 10), ("a", 5, 50), ("a", 9, 60), ("b", 5, -1)]
    assert rows(matching.asof_forward(left, right, ["g"], "at", "v", or_last=True).na.fill(-1), "g", "at", "next_v") == [("a", 1, 10), ("a", 5, 50), ("a", 9, 60), ("b", 5, -1)]


def test_contains_match_few_and_many(spark):
    texts = spark.createDataFrame([(1, "one two three"), (2, "two three four"), (3, None)], "id int, text string")
    needles = spark.createDataFrame([("n1", "wo thre"), ("n2", "four"), ("n3", "zz"), ("n4", ""), ("n5", None)], "n string, needle string")
    want = [("n1", 1), ("n1", 2), ("n2", 2)]
    assert rows(matching.contains_match(texts, needles, "text", "needle", ["n"], ["id"], 3), "n", "id") == want
    assert rows(matching.contains_match(texts, needles, "text", "needle", ["n"], ["id"], 3, needle_bytes=4), "n", "id") == want


def test_ledger(spark):
    leaves = spark.createDataFrame([("g", 1), ("g", 2), ("g", 3)], "g string, leaf int")
    claimed = spark.createDataFrame([("g", 1), ("g", 2), ("g", 2), ("g", 9)], "g string, leaf int")
    states = ledger.claims(leaves, claimed, ["g"], "leaf")
    assert rows(states, "leaf", "state") == [(1, "owned"), (2, "contested"), (3, "unclaimed"), (9, "unexpected")]
    total = ledger.coverage(states, ["g"]).first()
    assert (total["owned"], total["unknown"], total["unexpected"], total["total"], total["complete"]) == (1, 2, 1, 3, False)
    declared = spark.createDataFrame([("g", "a.b.c"), ("g", "ab"), ("g", "x")], "g string, path string")
    used = spark.createDataFrame([("g", "a.b"), ("g", "a"), ("g", "x")], "g string, path string")
    assert rows(ledger.path_ledger(declared, used, ["g"]), "path", "consumed") == [("a.b.c", True), ("ab", False), ("x", True)]
    blank = spark.createDataFrame([(1, "r"), (2, "r"), (3, ""), (4, None), (5, "")], "id int, ref string")
    assert rows(ledger.dedupe_known(blank, "ref", ["id"]), "id") == [(1,), (3,), (4,), (5,)]
    acts = spark.createDataFrame([("d", "r1", "section", "a1"), ("d", "r1", "page", "a2"), ("d", "r2", "page", "a3")], "d string, ref string, kind string, id string")
    assert rows(ledger.absorbed(acts, ["d"], "ref", "kind", "section", "page", "id").na.fill("-"), "id", "absorbed_by") == [("a1", "-"), ("a2", "a1"), ("a3", "-")]
    a, b = spark.createDataFrame([("x", 1)], "ref string, n int"), spark.createDataFrame([("x", 2), ("y", 3), ("y", 4)], "ref string, n int")
    assert rows(ledger.union_without_repeats(a, b, ["ref"], ["n"]), "ref", "n") == [("x", 1), ("y", 3)]


@pytest.mark.parametrize("given,want", [([], "UNKNOWN"), (["PASS"], "PASS"), (["PASS", "UNKNOWN"], "UNKNOWN"), (["UNKNOWN", "FAIL", "PASS"], "FAIL")])
def test_three_states(spark, given, want):
    df = spark.createDataFrame([(s,) for s in given], "status string")
    assert df.agg(status.merged("status")).first()[0] == want
    assert df.agg(status.merged("status", "PASS")).first()[0] == (want if given else "PASS")
    n = lambda s: F.lit(given.count(s))
    assert df.agg(F.lit(1)).select(status.verdict(n("PASS"), n("FAIL"), n("UNKNOWN"))).first()[0] == want


def test_scores_with_empty_sides(spark):
    e, a = spark.createDataFrame([("g", 1), ("g", 2)], "g string, k int"), spark.createDataFrame([("g", 2), ("g", 2), ("h", 1)], "g string, k int")
    assert rows(scoring.set_scores(e, a, ["g"], ["k"]), "g", "precision", "recall", "f1") == [("g", 1.0, 0.5, 0.6667), ("h", 0.0, 0.0, 0.0)]
    assert scoring.set_scores(e.limit(0), a.limit(0), ["g"], ["k"]).count() == 0


def tree(spark):
    edges = [("a", None, 1, True), ("b", "a", 2, True), ("c", "a", 3, False), ("d", "b", 4, True), ("e", "d", 5, True)]
    return spark.createDataFrame([("t", *e) for e in edges], "t string, node string, parent string, n int, ok boolean")


def test_trees(spark):
    t = tree(spark)
    assert rows(hierarchy.roll_up(t, ["t"], ["n"], ["ok"]), "node", "n", "ok") == [("a", 15, False), ("b", 11, True), ("c", 3, False), ("d", 9, True), ("e", 5, True)]
    assert rows(hierarchy.leaf_members(t, ["t"]).filter("node = 'a'"), "leaf") == [("c",), ("e",)]
    assert hierarchy.tree_errors(t, ["t"]).count() == 0
    values = t.withColumn("v", F.when(F.col("node").isin("a", "d"), F.col("n")))
    assert rows(hierarchy.resolve_inherited(values, ["t"], ["v"]), "node", "v") == [("a", 1), ("b", 1), ("c", 1), ("d", 4), ("e", 4)]
    d = spark.createDataFrame([("t", "a", "keep", True), ("t", "b", "fill", False), ("t", "d", "delete", False)], "t string, node string, result string, descend boolean")
    assert rows(hierarchy.sparse_decisions(t, d, ["t"]), "leaf", "settled_at", "result") == [("c", "c", "keep"), ("e", "b", "fill")]


def test_tree_faults(spark):
    edges = [("r", None), ("x", "y"), ("y", "x"), ("z", "gone"), ("m", "r"), ("m", "x"), ("q", "r"), ("q", "r")]
    bad = spark.createDataFrame([("t", *e) for e in edges], "t string, node string, parent string")
    found = rows(hierarchy.tree_errors(bad, ["t"]), "node", "error")
    assert {("z", "unknown_parent"), ("m", "several_parents"), ("q", "repeated"), ("x", "cycle"), ("y", "cycle"), ("x", "unreachable"), ("y", "unreachable"), ("z", "unreachable")} == set(found)


@pytest.mark.parametrize(
    "mode,expected,actual,options,finding",
    [
        ("exact", "1", "1.0", {}, None), ("exact", "true", "1", {}, None), ("exact", '"1"', "1", {}, "exact_mismatch"), ("exact", "null", "null", {}, None), ("exact", None, "1", {}, "dimension_unreadable"),
        ("normalized_text", '" a\\n b"', '"a b "', {}, None), ("ordered_sequence", "[1,2]", "[2,1]", {}, "ordered_sequence_mismatch"), ("set", "[1,2,2]", "[2,1]", {}, None),
        ("subset", "[1]", "[1,2]", {}, None), ("subset", "[3]", "[1,2]", {}, "subset_missing"), ("set", "[1]", "5", {}, "not_comparable"),
        ("numeric_tolerance", "10", "10.5", {"tolerance": 0.5}, None), ("numeric_tolerance", "10", "10.6", {"tolerance_abs": 0.5}, "numeric_tolerance_mismatch"),
        ("numeric_tolerance", "100", "104", {"tolerance_percent": 5.0}, None), ("numeric_tolerance", "0", "0", {"tolerance_percent": 5.0}, "not_comparable"),
        ("style_profile", '{"a":1}', '{"a":1,"b":2}', {}, None), ("style_profile", '{"a":1}', '{"a":2}', {}, "style_profile_mismatch"),
        ("oracle_required", "true", '"PASS"', {}, None), ("oracle_required", "true", '"FAIL"', {}, "oracle_failed"), ("oracle_required", "true", '"?"', {}, "not_comparable"), ("odd", "1", "1", {}, "unsupported_comparator_mode"),
    ],
)
def test_comparators(spark, mode, expected, actual, options, finding):
    row = (mode, expected, actual, None, options.get("tolerance"), options.get("tolerance_abs"), options.get("tolerance_percent"))
    df = spark.createDataFrame([row], "comparator_mode string, expected string, actual string, required boolean, tolerance double, tolerance_abs double, tolerance_percent double")
    assert comparators.compared(df).first()["finding"] == finding
    assert comparators.compared(df.withColumn("required", F.lit(False))).count() == 0


def test_paths_tell_missing_from_null(spark):
    df = spark.createDataFrame([('{"a":{"b":[1,null]},"n":null}',)], "doc string")
    got = df.select(*[comparators.at_path(F.col("doc"), p).alias(str(i)) for i, p in enumerate(["a.b[0]", "a.b[1]", "n", "x.y"])]).first()
    assert list(got) == ["1", "null", "null", None]


def test_schema_walks(spark):
    df = spark.createDataFrame([], "id int, a struct<secret:string, list:array<struct<secret:int, ok:int>>>, notes struct<x:int>")
    assert lineage.forbidden_fields(df, {"secret"}) == ["a.list.secret", "a.secret"]
    assert lineage.leaf_paths(df) == ["a.list.ok", "a.list.secret", "a.secret", "id"]


def test_reviews(spark):
    text = "intro\n# one\n名称：甲\n类型：乙\n# two\n"
    df = spark.createDataFrame([(1, text)], "id int, text string")
    out = reviews.sections(df, "id", "text", F.col("line").startswith("#"))
    assert rows(out.na.fill("-"), "section", "header", "n_lines") == [(0, "-", 1), (1, "# one", 2), (2, "# two", 1)]
    named = reviews.labelled_values(out, "body", ["名称", "无"]).filter("section = 1").first()
    assert (named["field_0"], named["field_1"]) == ("甲", "")
    a = spark.createDataFrame([(3,), (1,)], "k int")
    assert [r["action_id"] for r in reviews.numbered_union([a, a.limit(1)], ["k"], "a_{:03d}").orderBy("phase", "k").collect()] == ["a_001", "a_002", "a_003"]


def test_cover_of_empty_targets(spark):
    """An empty place is covered as such, or only where a range touches it."""
    r = spark.createDataFrame([("touched", 3, 5), ("ended", 1, 4), ("apart", 6, 9)], "g string, start int, end int")
    t = spark.createDataFrame([(g, 4, 4) for g in ("touched", "ended", "apart", "bare")], "g string, target_start int, target_end int")
    assert all(x["covered"] for x in intervals.covered(r, t, ["g"]).collect())
    got = {x["g"]: x["covered"] for x in intervals.covered(r, t, ["g"], empty_needs_touch=True).collect()}
    assert got == {"touched": True, "ended": True, "apart": False, "bare": False}
    whole = spark.createDataFrame([("touched", 3, 5), ("apart", 3, 7)], "g string, target_start int, target_end int")
    assert {x["g"]: x["covered"] for x in intervals.covered(r, whole, ["g"], empty_needs_touch=True).collect()} == {"touched": True, "apart": False}


def test_clusters_show_a_sample_beside_exact_counts(spark):
    from folioscope.operators import status

    f = spark.range(1000).selectExpr("'a' AS run", "'FAIL' AS status", "id AS finding_id", "concat('m', id) AS message", "array(id % 700, -1) AS affected")
    got = status.clusters(f, ["run"], ["status"], "finding_id", "message", "affected", sample=3).first()
    assert (got["n_findings"], got["title"], got["n_affected"], got["affected"]) == (1000, "m0", 701, [-1, 0, 1])
    assert status.cluster_members(f, ["run"], ["status"], "affected").count() == 701


@pytest.mark.parametrize("close", [True, False])
def test_spread_tokens_against_plain_sets(spark, close):
    import random

    rng = random.Random(4)
    words = [f"w{i}" for i in range(12)]
    items = [(i, rng.choice([*words, "nowhere", None])) for i in range(9) for _ in range(5)]
    places = [(rng.choice(["a", "b", None]), rng.choice([None, *range(70_000)]) if rng.random() < 0.9 else 5, rng.choice([*words[:8], None, "other"])) for _ in range(600)]
    i, p = spark.createDataFrame(items, "item int, token string"), spark.createDataFrame(places, "source string, place long, token string")
    want = set()
    for item in range(9):
        own = {t for k, t in items if k == item and t}
        for source in ("a", "b", None):
            hits = [(x, t) for s, x, t in places if s == source and x is not None and t in own]
            if len({t for _, t in hits}) >= 2:
                want.add((item, source, len({t for _, t in hits}), len({x for x, _ in hits}), min(x for x, _ in hits)))
    got = matching.tokens_spread(i, p, ["item"], ["source"], "token", "place", 2, close=close)
    assert {tuple(r) for r in got.collect()} == want
    assert matching.tokens_spread(i.limit(0), p, ["item"], ["source"], "token", "place", 2, close=close).count() == 0
