"""Queries of audits, requirements, decisions and spans over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators import audits, rules, spans
from folioscope.plans.gaps import _of, _pick
from folioscope.sources.tables import table


def trace_findings(spark, sf_dir):
    """Lines of orders as facts of a document: which do not lead back to where they were read."""
    x = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_size"), "l_partkey")
    k, none = F.col("l_linenumber"), F.array().cast("array<string>")
    facts = x.select(
        "l_orderkey", "l_linenumber", (F.col("l_suppkey") % 3).alias("id"), _pick("l_linenumber", ["paragraph", "table_cell", "header", "footer", "paragraph"]).alias("kind"), F.when(F.col("p_size") % 9 != 0, F.col("p_size") % 7 != 0).alias("visible"),
        F.when(F.col("p_size") % 5 != 0, F.concat(F.lit(" "), "p_name")).alias("text"), F.concat(F.lit("p"), F.col("p_size")).alias("paragraph_id"), F.when(k % 2 == 0, F.array(F.concat(F.lit("p"), F.col("p_size") % 25, F.lit(".r1")))).otherwise(none).alias("raw_run_ids"),
        F.when(F.col("l_suppkey") % 2 == 0, F.array(F.lit("c"))).alias("cell_refs"), F.when(F.col("l_suppkey") % 5 == 0, F.array(F.lit("f"))).alias("part_refs"),
        F.when(F.col("l_returnflag") == "R", F.array(F.lit("text"), F.lit("is_title"))).otherwise(F.array(F.lit("text"))).alias("field_names"), F.when(k > 4, F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise("else")).alias("source_text"),
    )
    return rules.findings(audits.counted(facts, ["l_orderkey"], "id"), ["l_orderkey", "l_linenumber"], audits.trace_checks()).select("l_orderkey", "l_linenumber", "check", "status")


def section_findings(spark, sf_dir):
    """Orders as section profiles of customers, and suppliers of the nation as the parts that they may point to."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("doc"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set(F.concat(F.lit("part_"), F.col("l_suppkey").cast("string"))).alias("part_refs"), F.count_if(F.col("l_returnflag") == "R").alias("n_page_fields"))
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").join(c, "o_custkey").join(lines, "o_orderkey", "left").select(
        "doc", "o_orderkey", F.concat(F.lit("s_"), F.when(k % 40 == 0, 0).otherwise(k).cast("string")).alias("section_profile_id"), F.when(k % 3 != 0, F.when(k % 5 == 0, "UNKNOWN").otherwise("PASS")).alias("boundary"),
        F.when(k % 7 != 0, "word/document").alias("source_ref"), _pick("o_custkey", ["detected", "no_page_field", "", "hidden"]).alias("numbering"), "n_page_fields", (k % 2).alias("n_checked"), "part_refs",
    )
    parts = table(spark, sf_dir, "supplier").select(F.explode(F.array(F.col("s_nationkey"), (F.col("s_nationkey") + 1) % 25)).alias("doc"), F.concat(F.lit("part_"), F.col("s_suppkey").cast("string")).alias("part_name"))
    return rules.findings(audits.section_facts(o, parts, ["doc"]), ["doc", "o_orderkey"], audits.section_checks()).select("doc", "o_orderkey", "check", "status")


def binding_findings(spark, sf_dir):
    """Orders as units of customers, bound to suppliers as sections by their lines."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    unit = F.when(k % 30 == 0, "other").when(k % 11 == 0, "twin").otherwise(k.cast("string"))
    start = F.when(k % 13 != 0, F.datediff("o_orderdate", F.lit("1990-01-01").cast("date")))
    units = o.select("o_custkey", unit.alias("unit_id"), start.alias("start"), (start + 60).alias("end"), F.when(k % 17 == 0, 1).otherwise(0).alias("policy_errors"))
    day = F.datediff("l_shipdate", F.lit("1990-01-01").cast("date"))
    lines = table(spark, sf_dir, "lineitem").filter("l_returnflag <> 'A'").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_suppkey") % 50).alias("section_profile_id"), day.alias("s"), (day + 3).alias("e"))
    refs = lines.join(o, "o_orderkey").select("o_custkey", unit.alias("unit_id"), "section_profile_id", F.col("s").alias("start"), F.col("e").alias("end"))
    profiles = o.select("o_custkey").distinct().select("o_custkey", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(44).cast("long"))).alias("section_profile_id"))
    return audits.binding_findings(units, refs, profiles, ["o_custkey"])


def policy_results(spark, sf_dir):
    """Orders as units with page policies, lines as reports of them, of which lines that were not returned were executed."""
    o, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    line_id = F.concat_ws("-", "l_orderkey", "l_linenumber")
    results = lines.filter("l_linenumber > 1").select(
        F.col("l_orderkey").alias("unit_id"), _pick("l_suppkey", ["executed", "manual_review", "already_satisfied", "pending", "executed"]).alias("status"),
        F.when(F.col("l_linenumber") % 4 != 0, F.array(line_id)).otherwise(F.array().cast("array<string>")).alias("action_ids"), "l_linenumber", "l_suppkey",
    )
    executed = lines.filter("l_returnflag <> 'R'").select(F.col("l_orderkey").alias("doc"), line_id.alias("action_id"))
    units = o.select(F.col("o_orderkey").alias("doc"), F.col("o_orderkey").alias("unit_id"), (F.col("o_orderstatus") == "O").alias("open_policy"))
    facts = audits.policy_result_facts(units, results.withColumn("doc", F.col("unit_id")), executed, ["doc"], ["l_linenumber", "l_suppkey"])
    return rules.findings(facts, ["unit_id"], audits.policy_result_checks()).select("unit_id", "check", "status")


def effect_gaps(spark, sf_dir):
    """Lines as actions on orders, of which less is seen than was done."""
    kind = _pick("l_suppkey", ["insert_page_break_before_unit", "insert_section_break_before_unit", "set_keep_together_unit", "other"])
    actions = table(spark, sf_dir, "lineitem").select("l_orderkey", kind.alias("action_type"))
    seen = table(spark, sf_dir, "orders").filter("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderkey") % 3).alias("page_breaks"), (F.col("o_custkey") % 2).alias("section_breaks"), F.lit(1).alias("kept"))
    return audits.effect_gaps(actions, seen, ["l_orderkey"])


def standard_findings(spark, sf_dir):
    """Orders as standards of stages, and what they lack."""
    o, k, c = table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    rows = o.select(
        "o_orderkey", F.when(k % 9 != 0, F.when(k % 4 == 0, "old/t.yaml").otherwise("template_generation/t.yaml")).alias("registered_path"), (k % 8 != 0).alias("has_standard"), "o_orderstatus", F.col("o_orderstatus").alias("stage_id"), F.when(c % 3 == 0, "F").otherwise(F.col("o_orderstatus")).alias("due_stage_id"),
        F.when(c % 5 != 0, "spec").alias("artifact"), F.lit("spec").alias("due_artifact"), F.when(k % 6 != 0, "configured").alias("verifier_state"), (c % 7 != 0).alias("has_gate"), F.when(c % 4 != 0, True).alias("has_expected"),
        F.when(k % 5 != 0, (c % 2).cast("string")).alias("source_hash"), F.when(k % 7 != 0, "1").alias("due_source_hash"),
    )
    return rules.findings(rows, ["o_orderkey"], audits.standard_checks()).select("o_orderkey", "check", "status")


def order_conflicts(spark, sf_dir):
    """Customers' orders as lists of stages: the second leaves some out, the third changes some."""
    place = F.expr("row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)")
    base = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").cast("string").alias("unit_id"), place.alias("place"), "o_orderkey")
    second = base.filter("o_orderkey % 19 <> 0").withColumn("stage", F.lit("t3"))
    third = base.withColumn("unit_id", F.when(F.col("o_orderkey") % 23 == 0, "x").otherwise(F.col("unit_id"))).withColumn("stage", F.lit("t4"))
    return audits.order_conflicts(base.withColumn("stage", F.lit("t2")).unionByName(second).unionByName(third).drop("o_orderkey"), ["o_custkey"])


def signoff_blockers(spark, sf_dir):
    """Customers as reports with orders as their stages: what blocks them."""
    k = F.col("c_custkey")
    reports = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.when(k % 4 != 0, "PASS").alias("acceptance"), F.when(k % 5 == 0, "FAIL").otherwise("PASS").alias("quality"), F.when(k % 3 == 0, "UNKNOWN").otherwise("PASS").alias("bundle"), (k % 2).alias("n_failed_diffs"))
    stages = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderpriority").alias("stage"), F.when(F.col("o_orderstatus") == "P", "draft").otherwise("configured").alias("verifier_state"), F.when(F.col("o_orderkey") % 10 != 0, True).alias("gate_enabled"))
    return audits.signoff_blockers(reports, stages, ["o_custkey"])


def route_findings(spark, sf_dir):
    """Orders as routes of an input contract: what is wrong with them."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    rows = o.select("o_orderkey", F.when(k % 6 != 0, k % 5 != 0).alias("available"), F.when(k % 7 != 0, _pick("o_custkey", ["rendered", "not_available", "projection_fallback", ""])).alias("render_status"), (k % 3).alias("n_unbound"), F.when(k % 2 == 0, k % 4).alias("n_invalid_stages"))
    return rules.findings(rows, ["o_orderkey"], audits.route_checks()).select("o_orderkey", "check_no", "check", "status")


def residues(spark, sf_dir):
    """Placeholders and notes on format that are left in whole texts, by source and language."""
    return audits.residues(table(spark, sf_dir, "documents"), ["source", "lang"], "text")


def residual_elements(spark, sf_dir):
    """The same for parts as elements, by brand; those that are instructions are not asked."""
    e = table(spark, sf_dir, "part").select("p_brand", F.concat("p_name", _pick("p_size", ["", "（小四号 宋体）", "____", "××", "(bold)", "…", "(Arial)"])).alias("content"), _pick("p_partkey", ["fixed", "instruction_remove", "remove_instruction", "fill"]).alias("policy"))
    return audits.residues(e, ["p_brand"], "content", "policy")


def first_blockers(spark, sf_dir):
    """The first three stages of each customer that did not pass, orders being stages: a report of so many."""
    status = F.when(F.col("o_orderstatus") == "F", "PASS").when(F.col("o_orderstatus") == "O", "UNKNOWN")
    cards = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", status.alias("status"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).otherwise(F.when(F.col("o_orderkey") % 3 == 1, "")).alias("reason"))
    return audits.first_blockers(cards, ["o_custkey"], "o_orderkey", 3).select("o_custkey", "o_orderkey", "rank", "reason")


def call_summary(spark, sf_dir):
    """Lines as requests for suppliers: how many were answered from where."""
    k = F.col("l_orderkey")
    calls = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", (F.col("l_returnflag") == "R").alias("from_cache"), F.when(F.col("l_returnflag") != "R", k % 9 == 0).alias("skipped"), F.when(k % 5 == 0, "timeout").when(k % 5 == 1, "").alias("error"), F.when(k % 31 == 0, "first").alias("fallback_from")
    )
    return audits.call_summary(calls, ["l_suppkey"])


def style_inventory(spark, sf_dir):
    """How often each type of part stands in a brand."""
    return audits.histogram(table(spark, sf_dir, "part"), ["p_brand"], "p_type")


def mean_of_known(spark, sf_dir):
    """Mean size of the parts of a brand that have one."""
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(audits.mean_of_known(F.when(F.col("p_size") > 25, F.col("p_size"))).alias("mean_size"))


# Texts that ask for fields and numbers, for the queries below.
ASKING = ["生成图编号", "表题 使用域代码 可用", "公式序号 SEQ 域", "图名 目录", "TOC 字段 到3级", "目录生成机制 生成结果", "页码字段", "NUMPAGES of it", "plain text", "编号由模板生成 格式=第%1章+半角空格；格式=％1.％2。", "脚注 自动编号", "章 编号生成 格式＝(%1)；格式=(%1)", "等价 页码字段"]


def field_requirements(spark, sf_dir):
    """Fields that parts, as elements of their brand and type, ask for, and types where no part does."""
    part = table(spark, sf_dir, "part")
    elements = part.select("p_brand", F.col("p_type").alias("unit_id"), F.col("p_partkey").alias("element_id"), F.when(F.col("p_size") % 3 == 0, _pick("p_partkey", ASKING)).otherwise("none").alias("text"), _pick("p_size", ["generated", "fixed"]).alias("policy"))
    units = part.groupBy("p_brand", F.col("p_type").alias("unit_id")).agg(F.min("p_partkey").alias("k")).select("p_brand", "unit_id", _pick("k", ["Word 图目录", "TOC 自动目录 可使用", "two PAGES", "plain"]).alias("text"))
    return audits.field_requirements(elements, units, ["p_brand"])


def numbering_requirements(spark, sf_dir):
    """Parts that ask for Word's numbering, with the formats that they state."""
    part = table(spark, sf_dir, "part").select("p_partkey", _pick("p_partkey", ASKING).alias("text"))
    return part.filter(audits.asks_for_numbering("text")).select("p_partkey", F.array_join(audits.numbering_formats("text"), "|").alias("formats"))


def gap_findings(spark, sf_dir):
    """Checks of parts that did not pass as findings of their brand, with what they are about."""
    part, s = table(spark, sf_dir, "part"), F.col("p_size").cast("string")
    lists = lambda *x: F.array(*[F.lit(v) if isinstance(v, str) else v for v in x])
    units = lambda *x: lists("units", F.col("p_type"), *x)
    k = F.col("p_partkey") % 7
    path = F.when(k == 0, lists("unmodeled_objects", s)).when(k == 1, lists("global", "unit_order")).when(k == 2, units("presence")).when(k == 3, units("elements", s, "presence")).when(k == 4, units("elements", s, "style")).when(k == 5, units("dimensions", "page", s)).otherwise(lists("other"))
    checks = part.select("p_brand", "p_partkey", _pick("p_size", ["PASS", "FAIL", "UNKNOWN"]).alias("status"), path.alias("path"))
    return audits.as_findings(checks, ["p_brand"], "p_partkey").select("p_brand", "p_partkey", "finding_no", "affected")


def planned_decisions(spark, sf_dir):
    """Orders as elements and lines as their spans: what is to be done with them."""
    k = F.col("o_orderkey")
    elements = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("element_id"), _pick("o_custkey", ["fixed", "fill", "generated", "remove_instruction", "instruction_remove", "template_default"]).alias("policy"), F.when(k % 2 == 0, "p1").alias("source_ref"), (k % 3 == 0).alias("synthesized"))
    parts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("element_id"), F.col("l_linenumber").alias("span_id"), _pick("l_suppkey", ["sample_value", "layout_spacer", "inline_instruction", "label"]).alias("span_type"))
    return audits.decisions(elements, parts, [])


def new_slots(spark, sf_dir):
    """Slots of parts, as elements of brands, that are not there yet."""
    part = table(spark, sf_dir, "part")
    elements = part.select("p_type", F.col("p_brand").alias("unit_id"), F.col("p_size").alias("element_id"), _pick("p_size", ["fill", "fixed", "generated", "template_default_optional"]).alias("policy"))
    known = part.filter("p_partkey % 5 = 0").select("p_type", F.concat_ws(".", "p_brand", "p_size").alias("slot_id"))
    return audits.slots(elements, known, ["p_type"]).select("p_type", "slot_id", "writable")


def stamped_paragraphs(spark, sf_dir):
    """Orders with what the last of their lines that is an instruction says."""
    lines = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linestatus").alias("policy"), F.col("l_suppkey").alias("disposition"), F.col("l_partkey").alias("reason"), "l_linenumber")
    return audits.stamped(table(spark, sf_dir, "orders").select("o_orderkey"), lines, [], "o_orderkey", ["l_linenumber", "disposition", "reason", "policy"])


def element_spans(spark, sf_dir):
    """Spans of parts as elements of four runs: labels, notes, samples and spacers."""
    part = table(spark, sf_dir, "part")
    texts = F.array("p_name", _pick("p_partkey", ["：", " ", "□□", "1. "]), _pick("p_size", ["××", "……", "（小四", "", "姓名", "□ ××（或□）"]), _pick("p_partkey", ["号 宋体）", "(bold)", "□", "…", "（居中）尾", "end", ""]))
    runs = part.select("p_partkey", _pick("p_size", ["fixed", "fill"]).alias("policy"), F.posexplode(texts).alias("raw_run_id", "text"))
    out = spans.element_spans(runs, ["p_partkey"], "raw_run_id")
    return out.withColumn("char_ranges", F.to_json("char_ranges"))


QUERIES = {f.__name__: f for f in (
    trace_findings, section_findings, binding_findings, policy_results, effect_gaps, standard_findings, order_conflicts, signoff_blockers, route_findings, residues, residual_elements, first_blockers, call_summary,
    style_inventory, mean_of_known, field_requirements, numbering_requirements, gap_findings, planned_decisions, new_slots, stamped_paragraphs, element_spans,
)}


def _union(key, source, checks):
    """SQL of one row for each check (name, status, condition) that a row of the source breaks."""
    return " UNION ALL ".join(f"""SELECT {key}, '{name}' AS "check", '{status}' AS status FROM {source} WHERE {when}""" for name, status, when in checks)


_ASK = _of("p_partkey", ASKING)
_NOTE = "[（(][^（）()]{0,80}(?:号|宋体|黑体|楷体|仿宋|华文|Times|Arial|加粗|居中|空[一二三四五六七八九十0-9]*行|小四|小三|三号|四号|一号|二号|行距|磅)[^（）()]{0,80}[）)]"
_HOLD = "□+|×{2,}|20×+|…{2,}|\\.{6,}|_{4,}"

SQL = {
    "trace_findings": f"""
        WITH x AS (SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey, l_suppkey % 3) AS n, {_of('l_linenumber', ['paragraph', 'table_cell', 'header', 'footer', 'paragraph'])} AS kind, p_size % 9 = 0 OR p_size % 7 <> 0 AS vis,
                          CASE WHEN p_size % 5 <> 0 THEN p_name ELSE '' END AS t, l_linenumber % 2 = 0 AS runs, p_size <> p_size % 25 AS apart, l_suppkey % 2 = 0 AS cells, l_suppkey % 5 = 0 AS parts, l_returnflag = 'R' AS judging,
                          CASE WHEN l_linenumber > 4 THEN CASE WHEN p_size % 2 = 0 THEN p_name ELSE 'else' END END AS src FROM lineitem JOIN part ON p_partkey = l_partkey)
        {_union('l_orderkey, l_linenumber', 'x', [
            ('id_duplicate', 'FAIL', 'n > 1'), ('paragraph_trace_mismatch', 'UNKNOWN', "kind = 'paragraph' AND runs AND apart"), ('paragraph_trace_missing', 'UNKNOWN', "vis AND t <> '' AND kind = 'paragraph' AND NOT runs"),
            ('cell_trace_missing', 'UNKNOWN', "vis AND t <> '' AND kind = 'table_cell' AND NOT runs AND NOT cells"), ('part_trace_missing', 'UNKNOWN', "vis AND t <> '' AND kind IN ('header', 'footer') AND NOT runs AND NOT parts"),
            ('judging_field', 'FAIL', 'judging'), ('source_text_mismatch', 'UNKNOWN', "src IS NOT NULL AND t <> '' AND src <> t")])}""",
    "section_findings": f"""
        WITH l AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS f FROM lineitem GROUP BY l_orderkey),
        o AS (SELECT c_nationkey AS doc, o_orderkey, o_orderkey AS k, o_custkey % 4 AS nb, coalesce(f, 0) AS f, CASE WHEN o_orderkey % 40 = 0 THEN 0 ELSE o_orderkey END AS s FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN l ON l_orderkey = o_orderkey),
        lost AS (SELECT DISTINCT doc, s FROM o JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN supplier ON s_suppkey = l_suppkey AND (s_nationkey = doc OR (s_nationkey + 1) % 25 = doc) WHERE s_suppkey IS NULL),
        x AS (SELECT o.*, count(*) OVER (PARTITION BY o.doc, o.s) AS n, lost.doc IS NOT NULL AS lost FROM o LEFT JOIN lost ON lost.doc = o.doc AND lost.s = o.s)
        {_union('doc, o_orderkey', 'x', [
            ('section_id_duplicate', 'FAIL', 'n > 1'), ('boundary_missing', 'UNKNOWN', 'k % 3 = 0'), ('boundary_unknown', 'UNKNOWN', 'k % 3 <> 0 AND k % 5 = 0'), ('source_ref_missing', 'UNKNOWN', 'k % 7 = 0'),
            ('numbering_status_missing', 'UNKNOWN', 'nb = 2'), ('numbering_without_field', 'FAIL', 'nb = 0 AND f = 0'), ('no_field_unsearched', 'UNKNOWN', 'nb = 1 AND k % 2 = 0'), ('part_missing', 'UNKNOWN', 'lost')])}""",
    "binding_findings": f"""
        WITH u AS (SELECT o_custkey, o_orderkey AS k, CASE WHEN o_orderkey % 30 = 0 THEN 'other' WHEN o_orderkey % 11 = 0 THEN 'twin' ELSE CAST(o_orderkey AS VARCHAR) END AS unit_id, CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_orderdate AS DATE) END AS s FROM orders),
        c AS (SELECT *, count(*) OVER (PARTITION BY o_custkey, unit_id) AS n FROM u), f AS (SELECT o_custkey, unit_id, min(s) AS s0 FROM u GROUP BY ALL),
        r AS (SELECT u.o_custkey, u.unit_id, l_suppkey % 50 AS p, CAST(l_shipdate AS DATE) AS d, s0 FROM lineitem JOIN u ON k = l_orderkey JOIN f ON f.o_custkey = u.o_custkey AND f.unit_id = u.unit_id WHERE l_returnflag <> 'A'),
        x AS (SELECT c.*, h.unit_id IS NULL AS bare FROM c LEFT JOIN (SELECT DISTINCT o_custkey, unit_id FROM r) h ON h.o_custkey = c.o_custkey AND h.unit_id = c.unit_id)
        {_union('o_custkey, unit_id', 'x', [('unit_id_duplicate', 'FAIL', "n > 1 AND unit_id <> 'other'"), ('other_unit_duplicate', 'UNKNOWN', "n > 1 AND unit_id = 'other'"), ('page_policy_invalid', 'FAIL', 'k % 17 = 0'), ('section_refs_missing', 'UNKNOWN', 'bare')])}
        UNION ALL {_union('o_custkey, unit_id', 'r', [('section_ref_unknown', 'FAIL', 'p > 44'), ('section_range_mismatch', 'FAIL', 'p <= 44 AND s0 IS NOT NULL AND NOT (s0 <= d + 3 AND d <= s0 + 60)')])}""",
    "policy_results": f"""
        WITH r AS (SELECT l_orderkey, l_suppkey % 5 AS s, l_linenumber % 4 <> 0 AS named, bool_or(l_returnflag <> 'R') OVER (PARTITION BY l_orderkey, l_linenumber) AS done, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_suppkey DESC) AS i FROM lineitem WHERE l_linenumber > 1),
        x AS (SELECT o_orderkey AS unit_id, o_orderstatus = 'O' AS open, s, named, done FROM orders LEFT JOIN r ON l_orderkey = o_orderkey AND i = 1)
        {_union('unit_id', 'x', [('result_missing', 'FAIL', 's IS NULL'), ('needs_review', 'FAIL', 's = 1 AND NOT open'), ('needs_review', 'UNKNOWN', 's = 1 AND open'), ('result_not_final', 'UNKNOWN', 's = 3'), ('evidence_missing', 'FAIL', 's IN (0, 4) AND NOT (named AND done)')])}""",
    "effect_gaps": f"""
        WITH a AS (SELECT l_orderkey, {_of('l_suppkey', ['insert_page_break_before_unit', 'insert_section_break_before_unit', 'set_keep_together_unit', 'other'])} AS action_type, count(*) AS expected FROM lineitem GROUP BY ALL),
        x AS (SELECT a.*, CASE action_type WHEN 'insert_page_break_before_unit' THEN l_orderkey % 3 WHEN 'insert_section_break_before_unit' THEN o_custkey % 2 ELSE 1 END AS observed FROM a JOIN orders ON o_orderkey = l_orderkey WHERE action_type <> 'other')
        SELECT l_orderkey, action_type, expected, CAST(observed AS BIGINT) AS observed FROM x WHERE l_orderkey % 7 <> 0 AND observed < expected
        UNION ALL SELECT l_orderkey, 'all', CAST(sum(expected) AS BIGINT), 0 FROM x WHERE l_orderkey % 7 = 0 GROUP BY l_orderkey""",
    "standard_findings": f"""
        WITH x AS (SELECT o_orderkey, o_orderkey AS k, o_custkey AS c, o_orderstatus AS s, o_orderkey % 8 <> 0 AS st FROM orders)
        {_union('o_orderkey', 'x', [
            ('not_registered', 'UNKNOWN', 'k % 9 = 0'), ('registered_elsewhere', 'UNKNOWN', 'k % 9 <> 0 AND k % 4 = 0'), ('standard_missing', 'UNKNOWN', 'NOT st'), ('stage_id_mismatch', 'UNKNOWN', "st AND c % 3 = 0 AND s <> 'F'"), ('artifact_mismatch', 'UNKNOWN', 'st AND c % 5 = 0'),
            ('verifier_state_missing', 'UNKNOWN', 'st AND k % 6 = 0'), ('gate_missing', 'UNKNOWN', 'st AND c % 7 = 0'), ('expected_missing', 'UNKNOWN', 'st AND c % 4 = 0'), ('source_hash_mismatch', 'UNKNOWN', 'st AND k % 7 <> 0 AND k % 5 <> 0 AND c % 2 = 0'), ('source_hash_missing', 'UNKNOWN', 'st AND k % 7 <> 0 AND k % 5 = 0')])}""",
    "order_conflicts": """
        WITH b AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders)
        SELECT o_custkey, 't3' AS stage, 't2' AS reference, count(*) AS n_places FROM b WHERE o_orderkey % 19 = 0 AND o_custkey IN (SELECT o_custkey FROM b WHERE o_orderkey % 19 <> 0) GROUP BY o_custkey
        UNION ALL SELECT o_custkey, 't4', 't2', count(*) FROM b WHERE o_orderkey % 23 = 0 GROUP BY o_custkey""",
    "signoff_blockers": """
        SELECT c_custkey AS o_custkey, 'standard_acceptance_status=UNKNOWN' AS blocker FROM customer WHERE c_custkey % 4 = 0 UNION SELECT c_custkey, 'standard_quality=FAIL' FROM customer WHERE c_custkey % 5 = 0
        UNION SELECT c_custkey, 'run_bundle=UNKNOWN' FROM customer WHERE c_custkey % 3 = 0 UNION SELECT c_custkey, 'stage_standard_diffs contain FAIL' FROM customer WHERE c_custkey % 2 = 1
        UNION SELECT o_custkey, o_orderpriority || '.verifier_state=draft' FROM orders WHERE o_orderstatus = 'P' UNION SELECT o_custkey, o_orderpriority || '.gate_enabled=false' FROM orders WHERE o_orderkey % 10 = 0""",
    "route_findings": """
        WITH x AS (SELECT o_orderkey, o_orderkey AS k, o_orderkey % 6 <> 0 AND o_orderkey % 5 <> 0 AS a, o_custkey % 4 AS c FROM orders),
        f AS (SELECT *, unnest([1, 2, 3, 4]) AS check_no FROM x)
        SELECT o_orderkey, check_no, ['not_available', 'render_not_real', 'objects_unbound', 'bundle_invalid'][check_no] AS "check", 'FAIL' AS status FROM f
        WHERE [NOT a, a AND (k % 7 = 0 OR c <> 0), a AND k % 3 > 0, a AND k % 4 = 2][check_no]""",
    "residues": f"""
        WITH g AS (SELECT source, lang, count(*) FILTER (regexp_matches(coalesce(text, ''), '{_NOTE}')) AS notes, count(*) FILTER (regexp_matches(coalesce(text, ''), '{_HOLD}')) AS placeholders FROM documents GROUP BY source, lang)
        SELECT *, CASE WHEN notes + placeholders > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM g""",
    "residual_elements": """
        WITH g AS (SELECT p_brand, count(*) FILTER (ask AND p_size % 7 IN (1, 6)) AS notes, count(*) FILTER (ask AND p_size % 7 IN (2, 3)) AS placeholders FROM (SELECT *, p_partkey % 4 IN (0, 3) AS ask FROM part) GROUP BY p_brand)
        SELECT *, CASE WHEN notes + placeholders > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM g""",
    "first_blockers": """
        SELECT o_custkey, o_orderkey, CAST(i AS INTEGER) AS rank, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE 'stage quality check is not PASS' END AS reason
        FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders WHERE o_orderstatus <> 'F') WHERE i <= 3""",
    "call_summary": """
        WITH g AS (SELECT l_suppkey, count(*) AS requests, count(*) FILTER (l_returnflag = 'R') AS cache_hits, count(*) FILTER (l_returnflag <> 'R' AND l_orderkey % 9 = 0) AS skipped, count(*) FILTER (l_orderkey % 5 = 0) AS failures, bool_or(l_orderkey % 31 = 0) AS fallback_used FROM lineitem GROUP BY l_suppkey)
        SELECT *, requests - cache_hits - skipped AS api_calls FROM g""",
    "style_inventory": "SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY p_brand, p_type",
    "mean_of_known": "SELECT p_brand, round(avg(p_size) FILTER (p_size > 25), 4) AS mean_size FROM part GROUP BY p_brand",
    "field_requirements": """
        WITH k(i, kind, label, eq, any_policy) AS (VALUES (0, 'SEQ', '图', true, true), (1, 'SEQ', '表', true, true), (2, 'SEQ', '公式', false, true), (4, 'TOC', NULL, false, false), (6, 'PAGE', NULL, false, false), (7, 'PAGE', NULL, false, false), (12, 'PAGE', NULL, true, false)),
        own AS (SELECT p_brand, p_type AS unit_id, p_type || '.' || p_partkey || '.field' AS affected, kind, label, eq AS equivalent FROM part JOIN k ON i = p_partkey % 13 WHERE p_size % 3 = 0 AND (any_policy OR p_size % 2 = 0)),
        u AS (SELECT p_brand, p_type AS unit_id, min(p_partkey) % 4 AS m FROM part GROUP BY ALL)
        SELECT * FROM own UNION ALL SELECT p_brand, unit_id, unit_id || '.field', CASE WHEN m < 2 THEN 'TOC' ELSE 'PAGE' END, NULL, m = 1 FROM u WHERE m < 3 AND (p_brand, unit_id) NOT IN (SELECT (p_brand, unit_id) FROM own)""",
    "numbering_requirements": "SELECT p_partkey, CASE p_partkey % 13 WHEN 9 THEN '第%1章 |%1.%2' ELSE '(%1)' END AS formats FROM part WHERE p_partkey % 13 IN (9, 11)",
    "gap_findings": """
        WITH x AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i FROM part WHERE p_size % 3 <> 0)
        SELECT p_brand, p_partkey, CAST(i AS INTEGER) AS finding_no, CASE p_partkey % 7 WHEN 0 THEN p_size || '' WHEN 1 THEN 'unit_order' WHEN 2 THEN p_type WHEN 3 THEN p_type || '.' || p_size WHEN 4 THEN p_type || '.' || p_size || '.style' WHEN 5 THEN p_type || '.page.' || p_size END AS affected FROM x""",
    "planned_decisions": """
        WITH e AS (SELECT o_orderkey AS element_id, CAST(NULL AS VARCHAR) AS span_id, CASE o_custkey % 6 WHEN 1 THEN 'create_fillable_slot' WHEN 2 THEN 'create_generated_field_placeholder' WHEN 3 THEN 'remove_instruction_text' WHEN 4 THEN 'remove_instruction_text' WHEN 0 THEN CASE WHEN o_orderkey % 2 = 1 AND o_orderkey % 3 = 0 THEN 'insert_fixed_text' END END AS decision FROM orders
        UNION ALL SELECT l_orderkey, CAST(l_linenumber AS VARCHAR), CASE l_suppkey % 4 WHEN 0 THEN 'replace_span_with_slot' WHEN 3 THEN NULL ELSE 'remove_instruction_text' END FROM lineitem)
        SELECT * FROM e WHERE decision IS NOT NULL""",
    "new_slots": """
        SELECT DISTINCT p_type, p_brand || '.' || p_size AS slot_id, p_size % 4 <> 2 AS writable FROM part WHERE p_size % 4 <> 1 AND (p_type, p_brand, p_size) NOT IN (SELECT (p_type, p_brand, p_size) FROM part WHERE p_partkey % 5 = 0)""",
    "stamped_paragraphs": """
        SELECT o_orderkey, l_linestatus AS policy, l_suppkey AS disposition, l_partkey AS reason FROM orders LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_suppkey DESC, l_partkey DESC, l_linestatus DESC) AS i FROM lineitem WHERE l_returnflag = 'R') ON l_orderkey = o_orderkey AND i = 1""",
}
