"""Queries of text, value and document functions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import text as tx
from folioscope.functions import values as vx
from folioscope.operators import lineage, reviews, sequence
from folioscope.sources.tables import table


def text_facts(spark, sf_dir):
    """Facts of conversation turns."""
    facts = table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.text_facts("text").alias("f"))
    return facts.select("conv_id", "turn", F.col("f.char_count").cast("long").alias("char_count"), "f.has_tab", "f.has_line_break", "f.trailing_token", F.md5("f.normalized").alias("normalized"))


def match_forms(spark, sf_dir):
    """Matching forms of part names with notes, placeholders and leaders."""
    part = table(spark, sf_dir, "part")
    raw = F.concat(F.col("p_name"), F.lit("（黑体 小三）(see note)"), F.col("p_brand"), F.lit("……  "), F.lit("□□："), F.col("p_type"))
    return part.select("p_partkey", tx.match_key(raw).alias("key"), tx.squeezed(F.concat(raw, F.lit("\t \n x "))).alias("squeezed"), tx.folded(raw).alias("folded"))


def match_token_lists(spark, sf_dir):
    """Matching tokens of the same."""
    part = table(spark, sf_dir, "part")
    raw = F.concat(F.col("p_name"), F.lit("：标题；"), F.col("p_brand"), F.lit("，"), F.col("p_type"), F.lit("/a/（字号 3）"))
    return part.select("p_partkey", F.array_join(tx.match_tokens(raw), "|").alias("tokens"))


def identifiers(spark, sf_dir):
    """Safe identifiers and previews of addresses."""
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", tx.safe_identifier("url").alias("ident"), tx.preview("html", 60).alias("preview"))


def anchors(spark, sf_dir):
    """Distinct long letter runs of whole documents in any language."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.coalesce(F.array_join(tx.stable_anchors("text"), " "), F.lit("")).alias("anchors"))


def policies(spark, sf_dir):
    """Policies by the words of part types and brands."""
    part = table(spark, sf_dir, "part")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("填充项", "生成项", "手工", "plain", "optional part")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    fill = F.element_at(F.array(*[F.lit(x) for x in ("是", "否", "")]), (F.col("p_partkey") % 3 + 1).cast("int"))
    return part.select("p_partkey", tx.policy_of(F.lit("draft"), kind, fill).alias("policy"))


def heading_scores(spark, sf_dir):
    """Scores of all turns as headings of a needle, the letters of the whole turn."""
    turns = table(spark, sf_dir, "conversations").withColumn("style", F.when(F.col("turn") == 0, "Heading 1").otherwise("Body"))
    needle = F.array(F.lower(F.regexp_replace("text", "[^A-Za-z]", "")))
    score = tx.anchor_score("text", "style", F.when(F.col("conv_id") % 2 == 0, "center"), F.col("turn") + 12, F.array(F.lit("")), needle, F.lit(1))
    return turns.select("conv_id", "turn", score.alias("score"))


def toc_lines(spark, sf_dir):
    """Lines of documents that look like entries of a table of contents or like instructions on format."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    line = F.when(F.col("line_no") % 3 == 0, F.concat(F.col("line"), F.lit(" ..... 12"))).when(F.col("line_no") % 3 == 1, F.concat(F.col("line"), F.lit("(12PT bold)"))).otherwise(F.col("line"))
    return lines.groupBy("doc_id").agg(F.count_if(tx.is_toc_entry(line)).alias("n_toc"), F.count_if(tx.is_format_instruction(line)).alias("n_format"))


def review_sections(spark, sf_dir):
    """Documents cut into sections at lines that end in a full stop and are short."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return reviews.sections(docs, "doc_id", "text", F.length("line") < 40).select("doc_id", "section", "header", "n_lines", F.md5("body").alias("body"))


def spacing_codes(spark, sf_dir):
    """Line spacing codes of part sizes and whether they match that of the size before."""
    part = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 24).alias("line"), F.element_at(F.array(F.lit("auto"), F.lit("exact"), F.lit("atLeast")), (F.col("p_partkey") % 3 + 1).cast("int")).alias("rule"))
    return part.select("p_partkey", vx.line_spacing("line", "rule").alias("code"), vx.line_spacing_matches(vx.line_spacing("line", "rule"), vx.line_spacing(F.col("line") + 10, "rule")).alias("near"))


def lenient_numbers(spark, sf_dir):
    """Whole numbers read from texts of several kinds."""
    part = table(spark, sf_dir, "part")
    raw = F.element_at(F.array(F.col("p_size").cast("string"), F.concat(F.lit(" "), F.col("p_retailprice").cast("decimal(12,2)").cast("string"), F.lit(" ")), F.lit("True"), F.lit("x1"), F.lit("-3.7")), (F.col("p_partkey") % 5 + 1).cast("int"))
    return part.select("p_partkey", vx.lenient_long(raw).alias("n"))


def content_hashes(spark, sf_dir):
    """Hashes of texts."""
    return table(spark, sf_dir, "documents").select("doc_id", vx.sha256_text("text").alias("sha256"))


def json_hashes(spark, sf_dir):
    """Hashes of the canonical form of event properties; keys sorted, blanks gone."""
    return table(spark, sf_dir, "events").select("event_id", vx.sha256_json("props").alias("sha256"))


def user_boxes(spark, sf_dir):
    """Boxes around each user's events by id and value, none where a value is missing."""
    ev = table(spark, sf_dir, "events").withColumn("x", F.when(F.col("event_id") % 500 != 0, F.col("value")))
    return ev.select("user_id", F.col("x").alias("x_min"), F.col("event_id").alias("y_min"), F.col("x").alias("x_max"), F.col("event_id").alias("y_max")).groupBy("user_id").agg(*vx.union_box("x_min", "y_min", "x_max", "y_max"))


def lineage_breaks(spark, sf_dir):
    """Lines whose recorded order status is not the order's."""
    o = table(spark, sf_dir, "orders").select(F.lit("run").alias("run_id"), F.col("o_orderkey").cast("string").alias("artifact"), F.col("o_orderstatus").alias("sha256"))
    refs = table(spark, sf_dir, "lineitem").select(F.lit("run").alias("run_id"), F.col("l_orderkey").cast("string").alias("artifact"), F.col("l_linestatus").alias("recorded"), F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("ref"))
    return lineage.broken_refs(o, refs.distinct()).select("ref", "artifact", "reason")


def bound_bundle(spark, sf_dir):
    """All expected customers bound to orders that are there and to suppliers that declare them."""
    expected = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("name"))
    actual = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("name")).agg(F.max("o_orderstatus").alias("sha256"))
    declared = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("name"), F.lit("P").alias("sha256"))
    return lineage.bound(expected, actual, declared).select("name", "binding")


def numbered_findings(spark, sf_dir):
    """Findings of several sources numbered in a fixed order of the sources, as ids."""
    o = table(spark, sf_dir, "orders")
    a = o.filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("key"))
    b = o.filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("key"))
    return reviews.numbered_union([a, b], ["key"], "a_{:03d}").select("phase", "key", "action_id")


def shipped_first(spark, sf_dir):
    """The first three lines of each order by date, for a report."""
    return sequence.first_rows(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_shipdate", "l_partkey", "l_suppkey", "l_linenumber"], 3).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.min("l_shipdate").alias("first"))


QUERIES = {f.__name__: f for f in (
    text_facts, match_forms, match_token_lists, identifiers, anchors, policies, heading_scores, toc_lines, review_sections, spacing_codes, lenient_numbers, content_hashes,
    json_hashes, user_boxes, lineage_breaks, bound_bundle, numbered_findings, shipped_first,
)}

SQL = {
    "text_facts": r"""
        SELECT conv_id, turn, length(text) AS char_count, contains(text, chr(9)) AS has_tab, contains(text, chr(10)) AS has_line_break, nullif(regexp_extract(text, '(\S+)\s*$', 1), '') AS trailing_token,
               md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS normalized FROM conversations""",
    "match_forms": r"""
        WITH r AS (SELECT p_partkey, p_name || '（黑体 小三）(see note)' || p_brand || '……  □□：' || p_type AS raw, p_name || '(see note)' || p_brand || '……  □□：' || p_type AS bare FROM part)
        SELECT p_partkey, lower(regexp_replace(regexp_replace(regexp_replace(bare, '[□×Xx_＿]+', '', 'g'), '[…·•.。．]{2,}', '', 'g'), '[\s:：;；,，.。!！?？、（）()《》<>“”"''‘’\[\]【】]', '', 'g')) AS key,
               trim(regexp_replace(raw || chr(9) || ' ' || chr(10) || ' x ', '\s+', ' ', 'g')) AS squeezed, lower(regexp_replace(raw, '\s+', '', 'g')) AS folded FROM r""",
    "match_token_lists": r"""
        WITH t AS (SELECT p_partkey, string_split_regex(p_name || '：标题；' || p_brand || '，' || p_type || '/a/', '[:：;；,，.。、\s/]+') AS ts FROM part),
        u AS (SELECT p_partkey, unnest(ts) AS t, unnest(range(1, len(ts) + 1)) AS i FROM t),
        k AS (SELECT p_partkey, i, lower(regexp_replace(regexp_replace(t, '[□×Xx_＿]+', '', 'g'), '[\s:：;；,，.。!！?？、（）()《》<>“”"''‘’\[\]【】]', '', 'g')) AS k FROM u),
        f AS (SELECT p_partkey, k, min(i) AS i FROM k WHERE length(k) >= 2 AND k NOT LIKE '%标题%' GROUP BY ALL)
        SELECT p.p_partkey, coalesce(string_agg(k, '|' ORDER BY i), '') AS tokens FROM part p LEFT JOIN f USING (p_partkey) GROUP BY p.p_partkey""",
    "identifiers": r"""
        WITH p AS (SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(trim(url), '[^0-9A-Za-z_-]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'unnamed') AS ident, trim(regexp_replace(html, '\s+', ' ', 'g')) AS s FROM pages)
        SELECT page_id, ident, CASE WHEN length(s) <= 60 THEN s ELSE substr(s, 1, 57) || '...' END AS preview FROM p""",
    "anchors": """
        WITH u AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z㐀-鿿]{4,}') AS a FROM documents),
        v AS (SELECT doc_id, unnest(a) AS w, unnest(range(1, len(a) + 1)) AS i FROM u), f AS (SELECT doc_id, w, min(i) AS i FROM v GROUP BY ALL)
        SELECT u.doc_id, coalesce(string_agg(w, ' ' ORDER BY i), '') AS anchors FROM u LEFT JOIN f USING (doc_id) GROUP BY u.doc_id""",
    "policies": """
        WITH x AS (SELECT p_partkey, ['填充项', '生成项', '手工', 'plain', 'optional part'][CAST(p_partkey % 5 AS INTEGER) + 1] AS k, ['是', '否', ''][CAST(p_partkey % 3 AS INTEGER) + 1] AS f FROM part)
        SELECT p_partkey, CASE WHEN k LIKE '%手工%' THEN 'fixed' WHEN k LIKE '%生成%' THEN 'generated' WHEN k LIKE '%填充%' OR (f <> '' AND f NOT LIKE '%否%') THEN 'fill' WHEN k LIKE '%optional%' THEN 'template_default_optional' ELSE 'fixed' END AS policy FROM x""",
    "heading_scores": r"""
        WITH t AS (SELECT *, trim(text) AS raw, lower(regexp_replace(regexp_replace(regexp_replace(text, '[□×Xx_＿]+', '', 'g'), '[…·•.。．]{2,}', '', 'g'), '[\s:：;；,，.。!！?？、（）()《》<>“”"''‘’\[\]【】]', '', 'g')) AS key,
                     lower(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n FROM conversations),
        s AS (SELECT *, CASE WHEN n <> '' AND (CASE WHEN length(n) <= 2 THEN starts_with(key, n) ELSE contains(key, n) END) THEN 43 ELSE 0 END AS base FROM t)
        SELECT conv_id, turn, CASE WHEN base > 0 THEN base + CASE WHEN length(raw) <= 24 THEN 30 ELSE 0 END + CASE WHEN conv_id % 2 = 0 THEN 20 ELSE 0 END + CASE WHEN turn + 12 >= 15 THEN 15 ELSE 0 END
               + CASE WHEN turn = 0 THEN 20 ELSE 0 END - CASE WHEN length(raw) > 80 THEN 35 ELSE 0 END - CASE WHEN length(raw) > 140 THEN 45 ELSE 0 END - CASE WHEN contains(raw, chr(9)) THEN 20 ELSE 0 END ELSE 0 END AS score FROM s""",
    "toc_lines": r"""
        WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents),
        m AS (SELECT doc_id, CASE i % 3 WHEN 0 THEN line || ' ..... 12' WHEN 1 THEN line || '(12PT bold)' ELSE line END AS line FROM l)
        SELECT doc_id, count(*) FILTER (contains(line, chr(9)) OR regexp_matches(line, '[….．·•]{2,}\s*(\d+|[ivxlcIVXLC]+)\s*$')) AS n_toc,
               count(*) FILTER (regexp_matches(line, '(?i)[（(].*(宋体|黑体|楷体|居中|行距|字号|号字|pt).*[）)]')) AS n_format FROM m GROUP BY doc_id""",
    "review_sections": """
        WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents),
        s AS (SELECT *, length(line) < 40 AS h, sum(CASE WHEN length(line) < 40 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS section FROM l)
        SELECT doc_id, CAST(section AS BIGINT) AS section, max(line) FILTER (h) AS header, count(*) FILTER (NOT h) AS n_lines, md5(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT h), '')) AS body FROM s GROUP BY doc_id, section""",
    "spacing_codes": """
        WITH p AS (SELECT p_partkey, p_size * 24 AS a, p_size * 24 + 10 AS b, ['auto', 'exact', 'atleast'][CAST(p_partkey % 3 AS INTEGER) + 1] AS r FROM part),
        v AS (SELECT *, a / 240.0::DOUBLE AS am, b / 240.0::DOUBLE AS bm, a / 20.0::DOUBLE AS ap, b / 20.0::DOUBLE AS bp FROM p)
        SELECT p_partkey, CASE WHEN r = 'auto' THEN CASE a WHEN 240 THEN 'single' WHEN 360 THEN '1.5' WHEN 480 THEN 'double' ELSE 'multiple:' || rtrim(rtrim(printf('%.6f', am), '0'), '.') END
               ELSE r || ':' || rtrim(rtrim(printf('%.6f', ap), '0'), '.') || 'pt' END AS code,
               CASE r WHEN 'auto' THEN abs(round(am, 6) - round(bm, 6)) <= 0.05 WHEN 'exact' THEN abs(ap - bp) <= 0.25 ELSE false END AS near FROM v""",
    "lenient_numbers": """
        SELECT p_partkey, CAST(CASE p_partkey % 5 WHEN 0 THEN p_size WHEN 1 THEN trunc(CAST(p_retailprice AS DECIMAL(12,2))::DOUBLE) WHEN 2 THEN 1 WHEN 3 THEN NULL ELSE -3 END AS BIGINT) AS n FROM part""",
    "content_hashes": "SELECT doc_id, 'sha256:' || sha256(text) AS sha256 FROM documents",
    "user_boxes": """
        WITH e AS (SELECT user_id, event_id, CASE WHEN event_id % 500 <> 0 THEN value END AS x FROM events)
        SELECT user_id, CASE WHEN count(x) = count(*) THEN min(x) END AS x_min, CASE WHEN count(x) = count(*) THEN min(event_id) END AS y_min, CASE WHEN count(x) = count(*) THEN max(x) END AS x_max, CASE WHEN count(x) = count(*) THEN max(event_id) END AS y_max FROM e GROUP BY user_id""",
    "lineage_breaks": """
        WITH r AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS artifact, l_linestatus AS recorded, l_orderkey || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey AS ref FROM lineitem)
        SELECT ref, r.artifact, CASE WHEN o_orderkey IS NULL THEN 'missing' ELSE 'different' END AS reason FROM r LEFT JOIN orders ON CAST(o_orderkey AS VARCHAR) = r.artifact WHERE o_orderkey IS NULL OR recorded IS DISTINCT FROM o_orderstatus""",
    "json_hashes": """SELECT event_id, 'sha256:' || sha256(replace(props, ': ', ':')) AS sha256 FROM events""",
    "bound_bundle": """
        WITH a AS (SELECT o_custkey, max(o_orderstatus) AS h FROM orders GROUP BY o_custkey)
        SELECT CAST(c_custkey AS VARCHAR) AS name, CASE WHEN o_custkey IS NULL THEN 'missing' WHEN s_suppkey IS NULL THEN 'undeclared' WHEN h <> 'P' THEN 'different' ELSE 'bound' END AS binding
        FROM customer LEFT JOIN a ON o_custkey = c_custkey LEFT JOIN supplier ON s_suppkey = c_custkey""",
    "numbered_findings": """
        WITH u AS (SELECT 1 AS phase, o_orderkey AS key FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 2, o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')
        SELECT phase, key, 'a_' || CASE WHEN row_number() OVER w < 1000 THEN lpad(CAST(row_number() OVER w AS VARCHAR), 3, '0') ELSE CAST(row_number() OVER w AS VARCHAR) END AS action_id FROM u WINDOW w AS (ORDER BY phase, key)""",
    "shipped_first": """
        WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_linenumber) AS n FROM lineitem)
        SELECT l_orderkey, count(*) AS n, min(l_shipdate) AS first FROM r WHERE n <= 3 GROUP BY l_orderkey""",
}
