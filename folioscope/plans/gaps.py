"""Queries of gap ladders, rule sets and judgements over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators import gaps, rules
from folioscope.sources.tables import table


def _pick(key, values):
    """One of the values, in turn by a key."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(key) % len(values) + 1).cast("int"))


def _elements(spark, sf_dir):
    """Parts as elements, with what the lines that hold them tell."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n_lines"), F.countDistinct("l_suppkey").alias("n_suppliers"))
    return table(spark, sf_dir, "part").join(lines, "p_partkey", "left").fillna(0, ["n_lines", "n_suppliers"])


def element_presence(spark, sf_dir):
    """Whether parts are there, as elements that lines hold."""
    e = _elements(spark, sf_dir)
    k, policy = F.col("p_partkey"), _pick("p_partkey", ["fixed", "generated", "fill"])
    said = gaps.element_presence(k % 11 == 0, F.when(k % 13 < 3, _pick("p_partkey", ["PASS", "FAIL", "UNKNOWN"])), k % 7 != 0, F.col("n_lines") % 3 == 0, F.col("n_suppliers") % 4 == 0, policy, F.col("p_size") > 10)
    return e.select("p_partkey", said.alias("x")).select("p_partkey", "x.*")


def style_ladder(spark, sf_dir):
    """Whether parts have the style that is asked of them."""
    e = _elements(spark, sf_dir)
    said = gaps.style_ladder(F.when(F.col("p_size") > 5, F.col("p_brand")), F.col("p_type").contains("STEEL"), F.col("n_lines") % 3, F.col("n_suppliers") % 2, F.col("p_size") % 2)
    return e.select("p_partkey", said.alias("x")).select("p_partkey", "x.*")


def field_ladder(spark, sf_dir):
    """Whether orders have returned lines as fields, those shipped within 60 days being in their range."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
    lines = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate", "l_quantity")
    near = F.datediff("l_shipdate", "o_orderdate") <= 60
    facts = o.join(lines, "o_orderkey", "left").groupBy("o_orderkey", "o_orderstatus", "o_orderpriority").agg(
        F.count("l_shipdate").alias("n"), F.count_if(near).alias("n_near"), F.coalesce(F.bool_and(F.when(near, F.col("l_quantity") > 20)), F.lit(False)).alias("wrong")
    )
    said = gaps.field_ladder(F.col("o_orderstatus") != "P", "n_near", "n", "wrong", F.col("o_orderpriority") < "3")
    return facts.select("o_orderkey", said.alias("x")).select("o_orderkey", "x.*")


def header_and_number_rules(spark, sf_dir):
    """What parts' headers and page numbers are found to be."""
    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    header = gaps.header_ladder(k % 6 != 0, _pick("p_partkey", ["无", "默认无页眉", "STEEL", "COPPER"]), F.when(k % 5 != 0, F.col("p_type")))
    number = gaps.page_number_ladder(k % 6 != 0, _pick("p_partkey", ["无", "不显示页码", "前置页页码规则", "阿拉伯数字页码规则", "无页码字段", "其他"]), F.col("p_size") % 2 == 0, F.when(k % 4 != 0, _pick("p_size", ["lowerRoman", "decimal", "upperLetter"])))
    return part.select("p_partkey", header.alias("h"), number.alias("n")).select("p_partkey", F.col("h.status").alias("header"), F.col("n.status").alias("number"), F.col("n.outcome").alias("number_outcome"))


def page_rules(spark, sf_dir):
    """What page rules of orders are found to be, with their lines as breaks, sections and kept rows."""
    o = table(spark, sf_dir, "orders")
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count_if(F.col("l_returnflag") == "R").alias("breaks"), F.count_if(F.col("l_returnflag") == "A").alias("sections"), F.count_if(F.col("l_linestatus") == "F").alias("kept"), F.count(F.lit(1)).alias("n")
    )
    rows = o.join(lines, "o_orderkey", "left")
    rule = _pick("o_orderkey", ["文档首页", "是", "是；另起", "否", "否/未要求", "不要求", "随便"])
    said = gaps.page_ladder(F.col("o_orderstatus") != "P", _pick("o_custkey", ["page_break", "section_isolation", "keep_together", "other"]), rule, F.col("n") + 2, F.col("n") == 1, "breaks", "sections", "kept", "n")
    return rows.select("o_orderkey", said.alias("x")).select("o_orderkey", "x.*")


def page_setup(spark, sf_dir):
    """Margins of each brand's first upright part against what is asked of the brand."""
    s = table(spark, sf_dir, "part").select("p_brand", "p_partkey", (F.col("p_size") % 3 != 0).alias("landscape"), (F.col("p_size") * 2.0).alias("top"), F.when(F.col("p_size") > 9, F.col("p_size") * 1.5).alias("gutter"))
    first = gaps.first_portrait(s, ["p_brand"], "p_partkey", "landscape", ["top", "gutter"])
    want = F.round(F.col("top") * F.lit(25.4 / 72), 1) + F.when(F.substring("p_brand", -1, 1) == "3", 1.0).otherwise(0.0)
    said = gaps.distances({"top": F.col("top"), "gutter": F.col("gutter")}, {"top": want, "gutter": F.when(F.substring("p_brand", -1, 1) == "4", 0.0)}, ["gutter"])
    return first.select("p_brand", "top", "gutter", said["status"].alias("status"))


def unit_results(spark, sf_dir):
    """Lines of orders as checks of their dimensions: counts and verdicts of orders."""
    lines = table(spark, sf_dir, "lineitem")
    dimension = _pick("l_linenumber", ["presence", "element", "style", "page", "header_footer", "fields", "numbering"])
    status = F.when(F.col("l_returnflag") == "R", "FAIL").when(F.col("l_returnflag") == "A", "UNKNOWN").otherwise("PASS")
    out = gaps.unit_results(lines.select("l_orderkey", dimension.alias("dimension"), status.alias("status")), ["l_orderkey"], "dimension", "status")
    return out.select("l_orderkey", F.col("presence.failed").alias("presence_failed"), F.col("fields.unknown").alias("fields_unknown"), F.col("counts.passed").alias("passed"), F.col("counts.failed").alias("failed"), F.col("counts.unknown").alias("unknown"), "verdict")


def check_paths(spark, sf_dir):
    """Where checks about parts belong."""
    part = table(spark, sf_dir, "part")
    category = _pick("p_partkey", ["actual_tree", "unit", "element", "style", "page_rule", "header_footer", "field", "numbering", "other"])
    about = F.when(F.col("p_partkey") % 7 == 0, None).when(F.col("p_partkey") % 5 == 0, F.col("p_brand")).otherwise(F.concat_ws(".", "p_brand", F.col("p_size").cast("string"), "p_type"))
    kind = F.when(F.col("p_size") % 2 == 0, "unit_order_mismatch").otherwise("unit_missing")
    return part.select("p_partkey", F.array_join(gaps.check_path(category, about, kind), "/").alias("path"))


def unit_map_findings(spark, sf_dir):
    """Faults of customers' orders as units over pages: an order of n lines should take n pages."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    o = table(spark, sf_dir, "orders").join(lines, "o_orderkey").select("o_custkey", "o_orderkey", "n")
    laid = o.withColumn("end_page", F.expr("sum(n) OVER (PARTITION BY o_custkey ORDER BY o_orderkey)"))
    laid = laid.withColumn("start_page", F.col("end_page") - F.col("n") + 1 + F.when(F.col("o_orderkey") % 23 == 0, 1).otherwise(0)).withColumn("page_count", F.expr("sum(n) OVER (PARTITION BY o_custkey)"))
    units = laid.select("o_custkey", F.col("o_orderkey").alias("place"), (F.col("o_orderkey") - F.when(F.col("o_orderkey") % 50 == 1, 1).otherwise(0)).alias("unit_id"), "start_page", "end_page", "page_count", F.when(F.col("n") == 7, 1).otherwise(0).alias("policy_errors"))
    return rules.findings(rules.unit_facts(units, ["o_custkey"]), ["o_custkey", "place"], rules.unit_checks()).select("o_custkey", "place", "check", "status")


def _policies(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    policy = _pick("p_partkey", ["fixed", "fill", "generated", "template_default", "instruction_remove", "guess", "fill"])
    return part.select("p_partkey", "p_brand", policy.alias("policy"), F.when(F.col("p_size") % 3 != 0, F.col("p_name")).alias("fill_source"), F.when(F.col("p_size") % 4 != 0, "").otherwise("TOC").alias("field_type"))


def element_spec_findings(spark, sf_dir):
    """Faults of parts as elements with policies."""
    return rules.findings(_policies(spark, sf_dir), ["p_partkey"], rules.element_checks()).select("p_partkey", "check", "status")


def policy_conflicts(spark, sf_dir):
    """Parts whose policy their brand's group does not allow."""
    groups = table(spark, sf_dir, "part").select(F.col("p_brand").alias("unit_id")).distinct()
    last = F.substring("unit_id", -1, 1)
    kinds = F.array_compact(F.array(F.when(last.isin("1", "2"), "generated"), F.when(last.isin("2", "3", "4"), "fixed"), F.when(last == "4", "fixed_allows_fill")))
    out = rules.policy_conflicts(_policies(spark, sf_dir), groups.select("unit_id", F.explode(kinds).alias("unit_group")), unit="p_brand")
    return out.select("p_partkey", "policy", "expected")


def required_gaps(spark, sf_dir):
    """Parts that lack what their policy requires."""
    out = rules.required_gaps(_policies(spark, sf_dir), {"fill": ["fill_source", "p_brand"], "generated": ["field_type", "fill_source"]})
    return out.select("p_partkey", "policy", F.array_join("missing", ",").alias("missing"))


def reviewed_decisions(spark, sf_dir):
    """Decisions on parts as nodes, those that break a rule kept for review."""
    part = table(spark, sf_dir, "part")
    k, size = F.col("p_partkey"), F.col("p_size")
    children = F.when(k % 3 == 0, F.array(F.concat(k, F.lit("a")), F.concat(k, F.lit("b"))))
    d = part.select(
        k.cast("string").alias("node"), _pick("p_partkey", ["run", "cell", "table", "span", "gap"]).alias("source_kind"), children.alias("child_refs"), (size % 5 != 0).alias("children_complete"), (size % 7 != 0).alias("content_complete"),
        (size == 50).alias("truncated"), F.when(k % 17 != 0, k.cast("string")).alias("target_ref"), _pick("p_size", ["keep", "Fill", "delete", "split", "drop"]).alias("result"), _pick("p_size", ["high", "low", "sure"]).alias("confidence"),
        F.when(k % 2 == 0, F.array(F.concat(k, F.lit("a")))).alias("inspect_child_refs"), F.when(k % 12 == 0, F.array(F.concat(k, F.lit("b")))).alias("child_refs_decided"), F.lit(0).alias("child_splits"),
        F.lit(None).cast("string").alias("default_child_result"), F.when(size % 2 == 0, F.col("p_name")).alias("fill_source"), F.when(size % 3 == 0, "old").alias("delete_reason"),
    )
    return rules.settled_decisions(d, ["node"]).select("node", "result", "confidence", "decision_status", F.array_join("errors", ",").alias("errors"))


def stage_judgements(spark, sf_dir):
    """Verdicts of orders as stages with what evidence there is of them."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    audit = F.when(F.col("o_orderstatus") == "F", "PASS").when(F.col("o_orderstatus") == "O", "UNKNOWN").otherwise("FAIL")
    s = o.select("o_orderkey", (k % 10 != 0).alias("has_standard"), F.when(k % 4 == 0, "UNKNOWN").otherwise("PASS").alias("quality"), (k % 6 != 0).alias("has_artifact"), F.when(k % 9 == 0, "FAIL").otherwise("PASS").alias("bundle"), (k % 5 != 0).alias("has_ledger"), audit.alias("audit"))
    return rules.stage_judgement(s).select("o_orderkey", F.array_join("buckets", ",").alias("buckets"), "verdict")


def top_causes(spark, sf_dir):
    """The first five causes of each customer, orders being causes: a report of so many."""
    status = F.when(F.col("o_orderstatus") == "P", "FAIL").when(F.col("o_orderstatus") == "O", "UNKNOWN").otherwise("PASS")
    c = table(spark, sf_dir, "orders").select("o_custkey", status.alias("status"), F.col("o_orderpriority").alias("stage"), F.col("o_orderstatus").alias("type"), F.col("o_orderkey").alias("id"))
    return rules.top_causes(c, ["o_custkey"], 5).select("o_custkey", "id", "rank")


def diagnosed_mismatches(spark, sf_dir):
    """Open orders with the category of their first line, its owner, and the fix for category and stage."""
    o = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("mismatch_id"), F.col("o_orderpriority").alias("stage"))
    causes = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("mismatch_id")).agg(F.min("l_returnflag").alias("category"))
    owners = spark.createDataFrame([("A", "code"), ("N", "verifier")], "category string, owner string")
    fixes = spark.createDataFrame([("A", "1-URGENT", "mend"), ("A", "2-HIGH", "review"), ("N", "5-LOW", "wait"), ("R", "1-URGENT", "refund")], "category string, stage string, fix string")
    return rules.with_layers(o, causes, owners, fixes).select("mismatch_id", "category", "owner", "fix")


def narrowed_lines(spark, sf_dir):
    """Returned lines of orders, or all their lines where none is returned."""
    return gaps.narrowed(table(spark, sf_dir, "lineitem"), ["l_orderkey"], F.col("l_returnflag") == "R").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_partkey").alias("parts"))


QUERIES = {f.__name__: f for f in (
    element_presence, style_ladder, field_ladder, header_and_number_rules, page_rules, page_setup, unit_results, check_paths, unit_map_findings, element_spec_findings, policy_conflicts, required_gaps,
    reviewed_decisions, stage_judgements, top_causes, diagnosed_mismatches, narrowed_lines,
)}


def _of(key, values):
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][CAST({key} % {len(values)} AS INTEGER) + 1]"


_ELEMENTS = "e AS (SELECT p.*, coalesce(n, 0) AS n_lines, coalesce(m, 0) AS n_suppliers FROM part p LEFT JOIN (SELECT l_partkey, count(*) AS n, count(DISTINCT l_suppkey) AS m FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey)"
_POLICIES = f"""p AS (SELECT p_partkey, p_brand, {_of('p_partkey', ['fixed', 'fill', 'generated', 'template_default', 'instruction_remove', 'guess', 'fill'])} AS policy,
        CASE WHEN p_size % 3 <> 0 THEN p_name END AS fill_source, CASE WHEN p_size % 4 <> 0 THEN '' ELSE 'TOC' END AS field_type FROM part)"""

SQL = {
    "element_presence": f"""
        WITH {_ELEMENTS}, f AS (SELECT *, {_of('p_partkey', ['fixed', 'generated', 'fill'])} AS policy, CASE WHEN p_partkey % 13 < 3 THEN {_of('p_partkey', ['PASS', 'FAIL', 'UNKNOWN'])} END AS s FROM e),
        o AS (SELECT *, CASE WHEN p_partkey % 11 = 0 THEN 'marked' WHEN s IS NOT NULL THEN 'structured' WHEN p_partkey % 7 = 0 THEN 'unit_unlocated' WHEN n_lines % 3 = 0 THEN 'found' WHEN n_suppliers % 4 = 0 THEN 'found_across_sources'
                     WHEN policy = 'fixed' AND p_size <= 10 THEN 'uncheckable' WHEN policy = 'fixed' THEN 'missing' WHEN policy = 'generated' THEN 'generated_source_unknown' ELSE 'source_unknown' END AS outcome FROM f)
        SELECT p_partkey, outcome, CASE WHEN outcome = 'structured' THEN s WHEN outcome IN ('marked', 'found', 'found_across_sources') THEN 'PASS' WHEN outcome = 'missing' THEN 'FAIL' ELSE 'UNKNOWN' END AS status FROM o""",
    "style_ladder": f"""
        WITH {_ELEMENTS}, o AS (SELECT p_partkey, CASE WHEN p_size <= 5 THEN 'not_required' WHEN contains(p_type, 'STEEL') THEN 'match' WHEN n_lines % 3 > 0 THEN 'mismatch' WHEN n_suppliers % 2 > 0 AND p_size % 2 = 0 THEN 'match' ELSE 'unverified' END AS outcome FROM e)
        SELECT *, CASE outcome WHEN 'mismatch' THEN 'FAIL' WHEN 'unverified' THEN 'UNKNOWN' ELSE 'PASS' END AS status FROM o""",
    "field_ladder": """
        WITH l AS (SELECT o_orderkey, o_orderstatus <> 'P' AS bound, o_orderpriority < '3' AS other, l_orderkey IS NOT NULL AS hit, l_orderkey IS NOT NULL AND datediff('day', o_orderdate, l_shipdate) <= 60 AS near, l_quantity > 20 AS big
                   FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_returnflag = 'R') ON l_orderkey = o_orderkey),
        f AS (SELECT o_orderkey, bound, other, count(*) FILTER (hit) AS n, count(*) FILTER (near) AS n_near, coalesce(bool_and(big) FILTER (near), false) AS wrong FROM l GROUP BY ALL),
        o AS (SELECT o_orderkey, other, CASE WHEN NOT bound THEN 'unverified' WHEN n_near > 0 AND wrong THEN CASE WHEN other THEN 'unverified' ELSE 'mismatch' END WHEN n_near > 0 THEN 'match' WHEN n > 0 THEN 'out_of_unit' WHEN other THEN 'unverified' ELSE 'missing' END AS outcome FROM f)
        SELECT o_orderkey, outcome, CASE outcome WHEN 'match' THEN 'PASS' WHEN 'unverified' THEN 'UNKNOWN' ELSE 'FAIL' END AS status FROM o""",
    "header_and_number_rules": f"""
        WITH r AS (SELECT p_partkey AS k, {_of('p_partkey', ['无', '默认无页眉', 'STEEL', 'COPPER'])} AS hr, CASE WHEN p_partkey % 5 <> 0 THEN p_type ELSE '' END AS ht, {_of('p_partkey', ['无', '不显示页码', '前置页页码规则', '阿拉伯数字页码规则', '无页码字段', '其他'])} AS nr,
                          p_size % 2 = 0 AS there, coalesce(CASE WHEN p_partkey % 4 <> 0 THEN {_of('p_size', ['lowerRoman', 'decimal', 'upperLetter'])} END, '') AS fmt FROM part),
        n AS (SELECT *, CASE WHEN k % 6 = 0 THEN 'unverified' WHEN nr IN ('无', '不显示页码') THEN CASE WHEN there THEN 'mismatch' ELSE 'match' END WHEN nr = '前置页页码规则' THEN CASE WHEN there AND ends_with(lower(fmt), 'roman') THEN 'match' ELSE 'mismatch' END
                     WHEN nr = '阿拉伯数字页码规则' THEN CASE WHEN there AND fmt IN ('', 'decimal') THEN 'match' ELSE 'mismatch' END WHEN nr = '无页码字段' AND NOT there THEN 'match' ELSE 'unverified' END AS number_outcome FROM r)
        SELECT k AS p_partkey, CASE WHEN k % 6 = 0 THEN 'UNKNOWN' WHEN CASE WHEN contains(hr, '无') THEN ht = '' ELSE contains(ht, hr) END THEN 'PASS' ELSE 'FAIL' END AS header,
               CASE number_outcome WHEN 'match' THEN 'PASS' WHEN 'mismatch' THEN 'FAIL' ELSE 'UNKNOWN' END AS number, number_outcome FROM n""",
    "page_rules": f"""
        WITH l AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS b, count(*) FILTER (l_returnflag = 'A') AS s, count(*) FILTER (l_linestatus = 'F') AS kept, count(*) AS n FROM lineitem GROUP BY l_orderkey),
        r AS (SELECT o_orderkey, o_orderstatus = 'P' AS lost, {_of('o_custkey', ['page_break', 'section_isolation', 'keep_together', 'other'])} AS f, CAST(o_orderkey % 7 AS INTEGER) AS r, coalesce(b, 0) AS b, coalesce(s, 0) AS s, coalesce(kept, 0) AS kept, n FROM orders LEFT JOIN l ON l_orderkey = o_orderkey),
        o AS (SELECT o_orderkey, CASE WHEN lost THEN 'unverified' WHEN f = 'page_break' AND r = 0 THEN CASE WHEN n + 2 <= 5 THEN 'match' ELSE 'mismatch' END WHEN f = 'page_break' AND r IN (1, 2) THEN CASE WHEN coalesce(n = 1, false) OR b > 0 OR s > 0 THEN 'match' ELSE 'mismatch' END
                     WHEN f = 'page_break' AND r IN (3, 4, 5) THEN CASE WHEN b > 0 THEN 'mismatch' ELSE 'match' END WHEN f = 'section_isolation' AND r IN (1, 2) THEN CASE WHEN s > 0 THEN 'match' ELSE 'mismatch' END
                     WHEN f = 'keep_together' AND kept > 0 THEN 'match' ELSE 'unverified' END AS outcome FROM r)
        SELECT *, CASE outcome WHEN 'match' THEN 'PASS' WHEN 'mismatch' THEN 'FAIL' ELSE 'UNKNOWN' END AS status FROM o""",
    "page_setup": """
        WITH x AS (SELECT p_brand, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_size % 3 <> 0, p_partkey) AS i FROM part),
        f AS (SELECT p_brand, p_size * 2.0::DOUBLE AS top, CASE WHEN p_size > 9 THEN p_size * 1.5::DOUBLE END AS gutter, right(p_brand, 1) AS b FROM x WHERE i = 1)
        SELECT p_brand, top, gutter, CASE WHEN b = '3' OR (b = '4' AND round(coalesce(gutter, 0) * (25.4::DOUBLE / 72), 2) > 0.35) THEN 'FAIL' ELSE 'PASS' END AS status FROM f""",
    "unit_results": """
        WITH c AS (SELECT l_orderkey, l_linenumber % 7 AS d, CASE l_returnflag WHEN 'R' THEN 'FAIL' WHEN 'A' THEN 'UNKNOWN' ELSE 'PASS' END AS s FROM lineitem),
        g AS (SELECT l_orderkey, count(*) FILTER (d = 0 AND s = 'FAIL') AS presence_failed, count(*) FILTER (d = 5 AND s = 'UNKNOWN') AS fields_unknown, count(*) FILTER (s = 'PASS') AS passed, count(*) FILTER (s = 'FAIL') AS failed, count(*) FILTER (s = 'UNKNOWN') AS unknown FROM c GROUP BY l_orderkey)
        SELECT *, CASE WHEN failed > 0 THEN 'FAIL' WHEN unknown > 0 THEN 'UNKNOWN' ELSE 'PASS' END AS verdict FROM g""",
    "check_paths": f"""
        WITH x AS (SELECT p_partkey, {_of('p_partkey', ['actual_tree', 'unit', 'element', 'style', 'page_rule', 'header_footer', 'field', 'numbering', 'other'])} AS c, CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 5 = 0 THEN p_brand ELSE p_brand || '.' || p_size || '.' || p_type END AS a,
                          CASE WHEN p_size % 2 = 0 THEN 'unit_order_mismatch' ELSE 'unit_missing' END AS k, p_partkey % 5 = 0 AS short, p_brand AS u, p_size || '' AS m, p_type AS e FROM part)
        SELECT p_partkey, CASE WHEN c = 'actual_tree' THEN 'unmodeled_objects/' || coalesce(a, k) WHEN a IS NULL THEN 'global/' || c || '/' || k WHEN c = 'unit' AND contains(k, 'order') THEN 'global/unit_order' WHEN c = 'unit' THEN 'units/' || u || '/presence'
               WHEN c = 'element' AND NOT short THEN 'units/' || u || '/elements/' || m || '/presence' WHEN c = 'style' AND NOT short THEN 'units/' || u || '/elements/' || m || '/style'
               WHEN c = 'page_rule' THEN 'units/' || u || '/dimensions/page/' || CASE WHEN short THEN u ELSE e END WHEN c = 'header_footer' THEN 'units/' || u || '/dimensions/header_footer/' || CASE WHEN short THEN u ELSE e END
               WHEN c = 'field' THEN 'units/' || u || '/dimensions/fields/' || CASE WHEN short THEN 'field' ELSE m || '.' || e END WHEN c = 'numbering' THEN 'units/' || u || '/dimensions/numbering/' || CASE WHEN short THEN 'numbering' ELSE m || '.' || e END
               ELSE 'global/' || c || '/' || a END AS path FROM x""",
    "element_spec_findings": f"""
        WITH {_POLICIES} SELECT p_partkey, 'policy_invalid' AS "check", 'FAIL' AS status FROM p WHERE policy = 'guess' UNION ALL SELECT p_partkey, 'fill_source_missing', 'FAIL' FROM p WHERE policy = 'fill' AND coalesce(fill_source, '') = ''
        UNION ALL SELECT p_partkey, 'generated_field_type_missing', 'FAIL' FROM p WHERE policy = 'generated' AND field_type = ''""",
    "policy_conflicts": f"""
        WITH {_POLICIES}, x AS (SELECT p_partkey, policy, CASE WHEN right(p_brand, 1) IN ('1', '2') AND policy NOT IN ('generated', 'fixed', 'instruction_remove') THEN 'generated' WHEN right(p_brand, 1) IN ('2', '3') AND policy = 'fill' THEN 'fixed' END AS expected FROM p)
        SELECT * FROM x WHERE expected IS NOT NULL""",
    "required_gaps": f"""
        WITH {_POLICIES}, x AS (SELECT p_partkey, policy, concat_ws(',', CASE WHEN policy = 'generated' AND field_type = '' THEN 'field_type' END, CASE WHEN policy IN ('fill', 'generated') AND coalesce(fill_source, '') = '' THEN 'fill_source' END) AS missing FROM p)
        SELECT * FROM x WHERE missing <> ''""",
    "stage_judgements": """
        WITH x AS (SELECT o_orderkey AS k, o_orderkey % 10 <> 0 AS st, o_orderkey % 10 <> 0 AND o_orderkey % 6 <> 0 AS b, CASE o_orderstatus WHEN 'F' THEN 'PASS' WHEN 'O' THEN 'UNKNOWN' ELSE 'FAIL' END AS audit FROM orders),
        y AS (SELECT *, concat_ws(',', CASE WHEN NOT st THEN 'standard_missing' END, CASE WHEN st AND k % 4 = 0 THEN 'standard_invalid' END, CASE WHEN st AND k % 6 = 0 THEN 'run_bundle_missing' END, CASE WHEN b AND k % 9 = 0 THEN 'run_bundle_invalid' END, CASE WHEN b AND k % 5 = 0 THEN 'check_ledger_missing' END) AS buckets FROM x)
        SELECT k AS o_orderkey, buckets, CASE WHEN b AND audit = 'FAIL' THEN 'FAIL' WHEN buckets <> '' OR audit = 'UNKNOWN' THEN 'UNKNOWN' ELSE 'PASS' END AS verdict FROM y""",
    "top_causes": """
        SELECT o_custkey, id, CAST(rank AS INTEGER) AS rank FROM (SELECT o_custkey, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderpriority, o_orderstatus, o_orderkey) AS rank FROM orders) WHERE rank <= 5""",
    "diagnosed_mismatches": """
        WITH c AS (SELECT l_orderkey, min(l_returnflag) AS category FROM lineitem GROUP BY l_orderkey)
        SELECT o_orderkey AS mismatch_id, category, CASE category WHEN 'A' THEN 'code' WHEN 'N' THEN 'verifier' END AS owner,
               CASE category || o_orderpriority WHEN 'A1-URGENT' THEN 'mend' WHEN 'A2-HIGH' THEN 'review' WHEN 'N5-LOW' THEN 'wait' WHEN 'R1-URGENT' THEN 'refund' END AS fix
        FROM orders LEFT JOIN c ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'F'""",
    "narrowed_lines": """
        WITH x AS (SELECT *, bool_or(l_returnflag = 'R') OVER (PARTITION BY l_orderkey) AS a FROM lineitem) SELECT l_orderkey, count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS parts FROM x WHERE NOT a OR l_returnflag = 'R' GROUP BY l_orderkey""",
}
