"""Audits, requirements and spans: what no query has SQL for, against plain Python, and odd rows."""

import random
import re

from pyspark.sql import functions as F

from folioscope.operators import audits, rules, spans
from folioscope.plans import audits as plans

MARKS = ["号", "宋体", "居中", "times", "字空"]


def plain_spans(runs, fill):
    """Spans of an element's runs, character by character: (kind, text, places in runs)."""
    text = "".join(runs)
    owner = [(i, j) for i, r in enumerate(runs) for j in range(len(r))]
    notes, i = [], 0
    while i < len(text):
        if text[i] in "（(":
            j = i + 1
            while j < len(text) and text[j] not in "（）()":
                j += 1
            if j < len(text) and text[j] in "）)" and 1 <= j - i - 1 <= 80:
                group = re.sub(r"\s", "", text[i : j + 1]).lower()
                if any(m in group for m in MARKS) and not ("或" in group and ("×" in group or "□" in group)):
                    notes.append((i, j + 1))
                i = j + 1
                continue
        i += 1

    def strip(a, b, skip=""):
        while a < b and (text[a].isspace() or text[a] in skip):
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        return a, b

    def before_note(a, b):
        later = [n[0] for n in notes if n[0] >= a]
        return a, min([b] + later[:1])

    def sample():
        colons = [k for k, c in enumerate(text) if c in "：:"]
        if colons:
            a, b = strip(*before_note(colons[0] + 1, len(text)))
            if "□" in text[a:b] or "×" in text[a:b] or "……" in text[a:b]:
                return a, b
        a, b = strip(*before_note(*strip(0, len(text))))
        c, _ = strip(a, b, "□")
        tail = b
        while tail > c and text[tail - 1] == "…":
            tail -= 1
        if b - tail >= 2 and (tail == c or re.search(r"[一二三四五六七八九十\d]+[\.、)]?[^…]{0,12}$", text[c:tail])):
            return tail, b
        if a < b and ("×" in text[a:b] or text[a:b] == "..." or set(text[a:b]) == {"…"}):
            return a, b
        if fill and c < b:
            inner = [k for k in colons if c <= k < b]
            a, b = strip(inner[0] + 1, b) if inner else (c, b)
            return (a, b) if a < b else None
        return None

    out = [("inline_instruction", a, b) for a, b in notes]
    got = sample()
    if got:
        out.append(("sample_value", *got))
    taken = {k for _, a, b in out for k in range(a, b)}
    spacers, at = [], 0
    for r in runs:
        for m in re.finditer("□+", r):
            if not taken & set(range(at + m.start(), at + m.end())):
                spacers.append(("layout_spacer", at + m.start(), at + m.end()))
        at += len(r)
    taken |= {k for _, a, b in spacers for k in range(a, b)}
    labels, at = [], 0
    for r in runs:
        start = None
        for k in range(at, at + len(r) + 1):
            free = k < at + len(r) and k not in taken
            if free and start is None:
                start = k
            if not free and start is not None:
                labels.append(("label", start, k))
                start = None
        at += len(r)
    out += spacers + [x for x in labels if text[x[1] : x[2]].strip()]
    places = lambda a, b: [(i, min(p for o, p in owner[a:b] if o == i), max(p for o, p in owner[a:b] if o == i) + 1) for i in sorted({o for o, _ in owner[a:b]})]
    return [(n, kind, text[a:b], places(a, b)) for n, (kind, a, b) in enumerate(out, 1)]


def test_spans_against_a_plain_walk(spark):
    rng, rows, want = random.Random(5), [], {}
    bits = ["姓名", "：", ":", "××", "……", "…", "（小四号）", "(", ")", "（××或□）", "□", "□□", " ", "1.", "二、", "标题", "（居中 宋体）", "...", "（", "）", "abc"]
    for e in range(600):
        runs = ["".join(rng.choice(bits) for _ in range(rng.randrange(4))) for _ in range(rng.randrange(1, 5))]
        fill = rng.random() < 0.4
        rows += [(e, i, t if t or rng.random() < 0.5 else None, "fill" if fill else "fixed") for i, t in enumerate(runs)]
        want[e] = plain_spans(runs, fill)
    df = spark.createDataFrame(rows, "e int, raw_run_id int, text string, policy string").repartition(7)
    got = {e: [] for e in want}
    for r in spans.element_spans(df, ["e"], "raw_run_id").orderBy("e", "span_no").collect():
        got[r["e"]].append((r["span_no"], r["kind"], r["text"], [(int(c["run"]), c["start"], c["end"]) for c in r["char_ranges"]]))
    assert got == want


def test_span_query_covers_every_part(spark):
    from folioscope.sources.tables import table

    sf = "/root/testdata/sf0.001"
    got = plans.element_spans(spark, sf)
    assert got.select("p_partkey").distinct().count() == table(spark, sf, "part").count()
    assert got.filter("kind IS NULL OR policy IS NULL OR text = ''").count() == 0
    empty = spark.createDataFrame([], "e int, raw_run_id int, text string, policy string")
    assert spans.element_spans(empty, ["e"], "raw_run_id").count() == 0
    nulls = spark.createDataFrame([(None, None, None, None), (1, None, "x：××", None)], "e int, raw_run_id int, text string, policy string")
    assert [(r["kind"], r["text"]) for r in spans.element_spans(nulls, ["e"], "raw_run_id").orderBy("span_no").collect()] == [("sample_value", "××"), ("label", "x：")]


def test_facts_of_sections_with_null_keys_and_repeats(spark):
    profiles = spark.createDataFrame([(1, "a", ["p", "q", None, ""], 0), (1, "a", None, 1), (None, None, ["p"], 2), (1, None, ["z"], 3)], "doc int, section_profile_id string, part_refs array<string>, extra int")
    parts = spark.createDataFrame([(1, "p"), (1, "p"), (2, "q")], "doc int, part_name string")
    got = {r["extra"]: (r["n_same"], r["n_lost_parts"]) for r in audits.section_facts(profiles, parts, ["doc"]).collect()}
    assert got == {0: (2, 1), 1: (2, 1), 2: (1, 1), 3: (1, 1)}


def test_judging_fields_and_missing_ones(spark):
    df = spark.createDataFrame([(["text", "is_title", "policy", "is_title", "island"],), ([],), (None,)], "names array<string>")
    assert [r[0] for r in df.select(audits.judging_fields("names")).collect()] == [["is_title", "policy"], [], None]
    run = spark.createDataFrame([("r", "", ["a"], "text", None, "x"), ("r", "l", [], "text", "s", "x")], "raw_run_id string, logical_run_id string, merged_from array<string>, kind string, effective_style string, style_provenance string")
    assert [r[0] for r in run.select(audits.missing_fields()).collect()] == [["logical_run_id", "effective_style"], ["merged_from"]]


def test_rule_sets_take_rows_of_nulls(spark):
    """A row of nulls is judged, by every rule set, without a failure of the plan."""
    traces = "n_same int, kind string, visible boolean, text string, paragraph_id string, raw_run_ids array<string>, cell_refs array<string>, part_refs array<string>, field_names array<string>, source_text string"
    sections = "section_profile_id string, n_same int, n_lost_parts int, boundary string, source_ref string, numbering string, n_page_fields int, n_checked int"
    results = "reported boolean, result string, open_policy boolean, n_named int, n_executed int"
    standards = "registered_path string, has_standard boolean, stage_id string, due_stage_id string, artifact string, due_artifact string, verifier_state string, has_gate boolean, has_expected boolean, source_hash string, due_source_hash string"
    routes = "available boolean, render_status string, n_unbound int, n_invalid_stages int"
    want = {
        traces: (audits.trace_checks(), set()), sections: (audits.section_checks(), {"boundary_missing", "source_ref_missing", "numbering_status_missing"}), results: (audits.policy_result_checks(), set()),
        standards: (audits.standard_checks(), {"not_registered", "standard_missing"}), routes: (audits.route_checks(), {"not_available"}),
    }
    for schema, (checks, names) in want.items():
        row = spark.createDataFrame([(None,) * len(schema.split(", "))], schema)
        assert {r["check"] for r in rules.findings(row, [], checks).collect()} == names, schema
        assert rules.findings(row.limit(0), [], checks).count() == 0


def test_order_conflicts_by_place(spark):
    rows = [("d", s, i, u) for s, units in {"t2": "abc", "t3": "abc", "t4": "acb", "t5": "abcc"}.items() for i, u in enumerate(units)] + [("e", "t2", 0, "a")]
    got = audits.order_conflicts(spark.createDataFrame(rows, "doc string, stage string, place int, unit_id string"), ["doc"]).collect()
    assert sorted((r["doc"], r["stage"], r["n_places"]) for r in got) == [("d", "t4", 2), ("d", "t5", 1)]


def test_formats_and_residues(spark):
    texts = ["格式=第%1章+半角空格；格式=％1.％2。", "格式=", None, "格式=a；格式=a"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in df.select(audits.numbering_formats("text")).collect()] == [["第%1章 ", "%1.%2"], [], [], ["a"]]
    kept = spark.createDataFrame([("a", "x （小四号）", "fixed"), ("a", "___", "fill"), ("a", "××", "instruction_remove"), ("b", None, None), ("b", "×", "fill")], "doc string, text string, policy string")
    got = {r["doc"]: (r["notes"], r["placeholders"], r["status"]) for r in audits.residues(kept, ["doc"], "text", "policy").collect()}
    assert got == {"a": (1, 0, "FAIL"), "b": (0, 0, "PASS")}
    assert kept.select(F.count_if(audits.asks_for_numbering("text"))).first()[0] == 0
