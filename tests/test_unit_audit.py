"""The audit of units: each finding alone, ties, nulls, empty sides."""

import random

from pyspark.sql import functions as F

from folioscope.operators import unit_audit

EXPECTED = "doc int, unit_id string, place int, seq_start long, seq_end long, page_start string, page_scope string"
ACTUAL = "doc int, unit_id string, place int, page_start string, page_scope string"
PAGE = ("new_page", "page_range_exclusive")


def run(spark, expected, actual, places, entries=(), terms=(), catalog=()):
    make = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    out = unit_audit.audit(
        make(expected, EXPECTED), make(actual, ACTUAL), make(places, "doc int, unit_id string, seq long"), ["doc"],
        make(entries, "doc int, seq long, text string"), make(terms, "doc int, unit_id string, tier int, term string"), catalog,
    )
    return sorted((r["doc"], r["finding"], r["status"], r["affected_id"] or "") for r in out.collect())


def test_a_sound_document_has_no_findings(spark):
    expected = [(1, "a", 1, 1, 2, *PAGE), (1, "b", 2, 3, 3, None, None)]
    actual = [(1, "a", 5, *PAGE), (1, "b", 9, "document_start", None), (1, None, 3, None, None)]
    assert run(spark, expected, actual, [(1, "a", 1), (1, "a", 2), (1, "b", 3), (1, "b", None)], [(1, 1, "摘 要"), (1, 3, "Abstract of it"), (1, 2, None), (1, 4, "")], [(1, "a", 0, "摘要"), (1, "b", 0, "abstract"), (1, "b", 0, None), (1, "zz", 0, "none")]) == []


def test_every_finding(spark):
    expected = [(1, "a", 1, 1, 2, *PAGE), (1, "b", 2, 3, 4, *PAGE), (1, "c", 3, 5, 6, *PAGE), (2, "a", 1, None, None, "middle", None), (3, None, 1, None, None, None, None), (5, "a", 1, None, None, None, None)]
    actual = [(1, "b", 1, *PAGE), (1, "a", 2, "document_start", PAGE[1]), (1, "custom:x", 3, *PAGE), (1, "y", 4, *PAGE), (2, "z", 1, None, None), (4, "a", 1, None, None), (5, "a", 1, None, None), (5, "a", 2, None, None)]
    got = run(spark, expected, actual, [(1, "a", 1), (1, "a", 2), (1, "a", 2), (1, "b", 3)])
    assert got == sorted([
        (1, "unit_order_mismatch", "FAIL", ""), (1, "unit_missing", "FAIL", "c"), (1, "unit_unexpected", "FAIL", "y"), (1, "custom_unit", "FAIL", "custom:x"),
        (1, "source_range_mismatch", "FAIL", "a.boundary"), (1, "source_range_mismatch", "FAIL", "b.boundary"), (1, "source_range_mismatch", "FAIL", "c.boundary"),
        (1, "page_policy_mismatch", "FAIL", "a.page_policy"), (1, "page_policy_mismatch", "FAIL", "c.page_policy"),
        (2, "standard_invalid", "UNKNOWN", ""), (3, "standard_invalid", "UNKNOWN", ""), (4, "standard_invalid", "UNKNOWN", ""), (5, "unit_order_mismatch", "FAIL", ""),
    ])


def test_anchors(spark):
    """Tiers, short titles, contents lines, and the first three places alone."""
    expected, actual = [(d, "a", 1, None, None, None, None) for d in range(1, 9)], [(d, "a", 1, None, None) for d in range(1, 9)]
    places = [(d, "a", 9) for d in range(1, 9)]
    texts = {
        1: [(1, "Title one"), (2, "Title two"), (9, "Title"), (10, "Title")], 2: [(1, "Title"), (2, "Title"), (3, "Title"), (9, "Title")], 3: [(9, "Title\t4")], 4: [(9, "ab and more")],
        5: [(9, "附录 A")], 6: [(1, "Title"), (9, "Other")], 7: [(9, "Other")], 8: [(9, "titl")],
    }
    terms = [(1, "a", 0, "title"), (2, "a", 0, "title"), (3, "a", 0, "title"), (4, "a", 0, "ab"), (5, "a", 0, "附录"), (6, "a", 0, "title"), (6, "a", 1, "other"), (7, "a", 0, "title"), (7, "a", 1, "other"), (8, "a", 0, "title")]
    entries = [(d, s, t) for d, rows in texts.items() for s, t in rows]
    bad = lambda **more: [d for d, f, *_ in run(spark, expected, actual, places, entries, terms, **more) if f == "anchor_owner_mismatch"]
    assert bad() == [2, 3, 4, 6, 8]
    assert bad(catalog=["a"]) == [2, 4, 6, 8]


def test_empty_and_clashing_columns(spark):
    assert run(spark, [], [], []) == []
    expected = spark.createDataFrame([(1, "a", 1, None, None, None, None)], EXPECTED).withColumns({"nth": F.lit(1), "want": F.lit(2), "low": F.lit(3)})
    actual = spark.createDataFrame([(1, "a", 1, None, None)], ACTUAL).withColumns({"got": F.lit(1), "finding": F.lit(2)})
    assert unit_audit.audit(expected, actual, spark.createDataFrame([], "doc int, unit_id string, seq long"), ["doc"]).count() == 0


def test_anchors_against_plain_loops(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("aé附") for _ in range(rng.randint(0, 5)))
    docs, units, cuts = [1, 2, None], ["a", "b", None], spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    entries = [(rng.choice(docs), rng.choice([None, *range(30)]), rng.choice([None, word(), word() + "\t4", "附录 " + word()])) for _ in range(300)]
    terms = [(rng.choice(docs), rng.choice(units), rng.randrange(3), rng.choice([None, "附录", word(), word()])) for _ in range(60)]
    owners = [(d, s, rng.choice(units)) for d in docs for s in range(30) if rng.random() < 0.8]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = unit_audit.anchored(*(spark.createDataFrame(x, f"doc int, {c}") for x, c in ((entries, "seq int, text string"), (terms, "unit_id string, tier int, term string"), (owners, "seq int, unit_id string"))), ["doc"], ["b"]).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", cuts)
    want = set()
    bare = lambda text: "".join((text or "").split())
    for d, u in {(d, u) for d, u, _, term in terms if d is not None and bare(term)}:
        n, own = 0, False
        for tier in range(3):
            keys = {bare(t) for d2, u2, t2, t in terms if (d2, u2, t2) == (d, u, tier) and bare(t)}
            hit = {s for d2, s, text in entries if d2 == d and any(bare(text) == k or (len(k) >= 3 or k == "附录") and bare(text).startswith(k) for k in keys) and (u == "b" or "\t" not in (text or ""))}
            first = sorted(hit, key=lambda s: (s is not None, s))[:3]
            if first and not n:
                n, own = len(first), any(u is not None and (d, s, u) in owners for s in first if s is not None)
        want.add((d, u, n, own))
    assert {(r["doc"], r["unit_id"], r["n_matched"], r["owned"]) for r in got} == want and len(want) == 6
