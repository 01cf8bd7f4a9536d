"""Alignment and template rules on small documents."""

from pyspark.sql import functions as F

from folioscope.operators import alignment, documents
from folioscope.sources import layout


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_word_boxes(spark):
    html = '<page width="100" height="200"><word xMin="1" yMin="20" xMax="5" yMax="25">He llo</word>\n<word xMin="6" yMin="21" xMax="9" yMax="30">&lt;b&amp;</word></page><page width="1" height="0"><word xMin="0" yMin="0" xMax="1" yMax="1">x</word></page>'
    w = layout.words(spark.createDataFrame([("d", html)], "path string, html string"))
    assert rows(w, "page_no", "text", "start", "end") == [(1, "<b&", 5, 8), (1, "Hello", 0, 5), (2, "x", 0, 1)]
    assert rows(layout.page_texts(w), "page_no", "text") == [(1, "Hello<b&"), (2, "x")]
    r = spark.createDataFrame([("d", 1, 4, 6, "a"), ("d", 1, 0, 2, "b"), ("d", 2, 0, 1, "c")], "path string, page_no int, start int, end int, key string")
    assert rows(layout.boxes_of_ranges(r, w, ["key"]), "key", "x_max", "top_ratio") == [("a", 9.0, 0.1), ("b", 5.0, 0.1), ("c", 1.0, None)]


def test_monotone_pages(spark):
    pages = spark.createDataFrame([("d", 1, "titleabc"), ("d", 2, "headingbody" + "x" * 30), ("d", 3, "headingabc")], "doc_id string, page_no int, text string")
    data = [("d", 1, "ti tle", False), ("d", 2, "heading", True), ("d", 3, "body", False), ("d", 4, "abc", False), ("d", 5, " ", False), ("d", 6, "nowhere", False), ("d", 7, "heading", False), ("e", 1, "q", False)]
    out = alignment.monotone_pages(spark.createDataFrame(data, "doc_id string, source_seq int, text string, keep_next boolean"), pages)
    assert [(r["doc_id"], r["source_seq"], r["page_no"], r["status"]) for r in out.orderBy("doc_id", "source_seq").collect()] == [
        ("d", 1, 1, "exact"), ("d", 2, None, "ambiguous"), ("d", 3, 2, "exact"), ("d", 4, 3, "exact"), ("d", 5, None, "empty_text"), ("d", 6, None, "ambiguous"), ("d", 7, 3, "exact"), ("e", 1, None, "ambiguous"),
    ]


def test_fills_at_boundaries(spark):
    data = [("d", 1, 1, 1, False), ("d", 2, 2, None, False), ("d", 3, 3, None, True), ("d", 4, 4, 2, False), ("d", 5, 5, None, False), ("d", 6, 6, 3, False)]
    df = spark.createDataFrame(data, "d string, seq int, par int, page int, keep boolean")
    edges = spark.createDataFrame([("d", 2), ("d", 4), ("d", 5)], "d string, par int")
    assert [r["filled"] for r in alignment.boundary_side_fill(df, edges, ["d"], "seq", "par", "page").orderBy("seq").collect()] == [1, 1, 2, 2, None, 3]
    assert [r["filled"] for r in alignment.keep_next_fill(df, edges, ["d"], "seq", "par", "page", "keep").orderBy("seq").collect()] == [1, None, 2, 2, None, 3]


def test_anchored_pages(spark):
    df = spark.createDataFrame([("d", 1, 1, []), ("d", 2, None, ["abcde"]), ("d", 3, None, ["wxyz", "stuv"]), ("d", 4, None, ["wxyz"]), ("d", 5, 3, [])], "d string, seq int, page_no int, a array<string>")
    pages = spark.createDataFrame([("d", 2, "..abcde..wxyz"), ("d", 3, "wxyzstuv"), ("d", 4, "abcdewxyzstuv")], "d string, page_no int, text string")
    assert rows(alignment.anchored_pages(df, pages, ["d"], "seq", "a"), "seq", "page_no") == [(2, 2), (3, 3)]


def test_greedy_locations(spark):
    units = spark.createDataFrame([("d", "a", 1, False), ("d", "b", 2, False), ("d", "c", 3, False), ("d", "t", 4, True), ("d", "z", 5, False)], "doc_id string, unit_id string, place int, out_of_order boolean")
    cand = spark.createDataFrame([("d", "a", 5, 50), ("d", "b", 3, 90), ("d", "b", 9, 40), ("d", "b", 7, 40), ("d", "c", 5, 99), ("d", "t", 2, 10), ("d", "z", 20, 0)], "doc_id string, unit_id string, order int, score int")
    assert rows(alignment.greedy_locations(cand, units), "unit_id", "anchor_order", "end_order") == [("a", 5, 6), ("b", 7, None), ("c", None, None), ("t", 2, 4), ("z", None, None)]
    assert rows(alignment.greedy_locations(cand.limit(0), units), "anchor_order") == [(None,)] * 5


def test_rules(spark):
    one = spark.createDataFrame([("fill", "student_field_candidate", "姓名：____", "x")], "p string, h string, c string, n string")
    pick = lambda c: one.select(c).first()[0]
    assert pick(documents.executed_policy(F.lit("remove_instruction"))) == "instruction_remove" and pick(documents.executed_policy(F.lit(None))) == "fixed"
    assert pick(documents.role_of(F.lit(None), F.lit("fill"))) == "student_content" and pick(documents.role_of("h", F.lit("fixed"))) == "student_content"
    conf = lambda p, c, h: pick(documents.confidence_of(F.lit(p), F.lit(c), F.lit(h), ["____"], ["姓名"]))
    assert [conf("fixed", "a", "student_field_candidate"), conf("fill", "姓名：____", None), conf("fill", "姓名", None), conf("fixed", " ", None), conf("fixed", "a", None), conf("generated", "", None)] == ["medium", "high", "medium", "low", "high", "high"]
    assert pick(documents.confidence_rank(F.lit("HIGH"))) == 3 and pick(documents.confidence_rank(F.lit(None))) == 0
    assert pick(documents.slot_kind(F.lit("u"), F.lit("数据表"))) == "table" and pick(documents.accepted_kinds(F.lit("heading"))) == ["heading", "paragraph"]
    assert tuple(pick(documents.page_policy(F.lit("odd"), F.lit("page_range_exclusive"), F.lit(True)))) == ("document_start", "page_range_exclusive")
    ids = pick(documents.stable_ids(F.lit("word/document.xml:tbl[2]/tr[3]/tc[4]/p[12]")))
    assert tuple(ids) == ("p_0012", "tbl_0002", "tbl_0002.r_003.c_004") and tuple(pick(documents.stable_ids(F.lit("x")))) == (None, None, None)
    assert pick(documents.json_object_in(F.lit('say {"a": 1} now'))) == '{"a":1}' and pick(documents.json_object_in(F.lit("none"))) is None
    assert pick(documents.element_needles(F.lit("a" * 81), F.lit("题名标签"))) == ["a" * 81, "a" * 80, "题名"]


def test_pagination_plan(spark):
    data = [("d", 1, "cover", "p1", None), ("d", 2, "a", "p2", 2), ("d", 3, "b", None, None), ("d", 4, "c", "p4", 1), ("d", 5, "e", "p4", None), ("d", 6, "f", "p6", None)]
    df = spark.createDataFrame(data, "doc_id string, place int, unit_id string, source_ref string, start_page int").withColumns({"start": F.lit("new_page"), "scope": F.lit("page_range_exclusive")})
    out = documents.pagination_plan(df).orderBy("place").collect()
    assert [(r["unit_id"], r["status"], r["action_id"]) for r in out] == [("cover", "no_action_required", None), ("a", "already_satisfied", None), ("b", "manual_review", None), ("c", "action_planned", "a_001"), ("e", "no_action_required", None), ("f", "action_planned", "a_002")]


def test_missing_titles(spark):
    data = [("d", 1, "x", False, None, 3), ("d", 2, "toc", True, "目录", 1), ("d", 3, "y", False, None, 9), ("e", 1, "x", False, None, 3), ("e", 2, "toc", True, "目录", 5), ("e", 3, "y", False, None, 9)]
    df = spark.createDataFrame(data, "doc_id string, place int, unit_id string, is_contents boolean, title string, paragraph int")
    assert rows(documents.missing_titles(df), "doc_id", "insert_before") == [("d", 9)]


def test_span_ledger(spark):
    runs = spark.createDataFrame([("d", k, "abcd") for k in ("ok1", "ok2", "gap", "short", "mix", "one", "wrong", "none")], "doc_id string, raw_run_id string, run_text string")
    items = [("ok1", "run", None, None, "abcd"), ("ok2", "span", 0, 2, "ab"), ("ok2", "span", 2, 4, "cd"), ("gap", "span", 0, 1, "a"), ("gap", "span", 2, 4, "cd"), ("short", "span", 0, 1, "a"), ("short", "span", 1, 3, "bc"), ("mix", "run", None, None, "abcd"), ("mix", "span", 0, 4, "abcd"), ("one", "span", 0, 4, "abcd"), ("wrong", "run", None, None, "abc"), ("lost", "run", None, None, "x")]
    df = spark.createDataFrame([("d", *i) for i in items], "doc_id string, raw_run_id string, target_kind string, start int, end int, text string")
    assert dict(rows(documents.span_ledger_faults(df, runs), "raw_run_id", "fault")) == {"gap": "spans_not_contiguous", "short": "spans_incomplete", "mix": "mixed_shapes", "one": "single_span", "wrong": "run_not_exact", "none": "not_covered", "lost": "unknown_run"}
