"""Queries of alignment and template-rule operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import text as tx
from folioscope.operators import alignment, documents, ledger
from folioscope.sources import layout
from folioscope.sources.tables import table


def _turns(spark, sf_dir):
    """Turns as rows of a document with a page where it is known."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    return t.withColumn("page", F.when(F.col("turn") % 3 == 0, F.floor(F.col("turn") / 3) + 1)).withColumn("keep", F.col("n") % 2 == 0)


def boundary_sides(spark, sf_dir):
    """Pages of turns between two known pages with one boundary in between; long turns close a page."""
    t = _turns(spark, sf_dir)
    edges = t.filter("n > 400").select("conv_id", "turn")
    rows = t.select("conv_id", F.col("turn").alias("seq"), "turn", "page")
    return alignment.boundary_side_fill(rows, edges, ["conv_id"], "seq", "turn", "page").select("conv_id", "seq", "filled")


def kept_with_next(spark, sf_dir):
    """Pages of turns that keep with the next known turn, unless a long turn stands between."""
    t = _turns(spark, sf_dir)
    edges = t.filter("n > 400").select("conv_id", "turn")
    rows = t.select("conv_id", F.col("turn").alias("seq"), "turn", "page", "keep")
    return alignment.keep_next_fill(rows, edges, ["conv_id"], "seq", "turn", "page", "keep").select("conv_id", "seq", "filled")


def page_tiers(spark, sf_dir):
    """Places of turns on their pages."""
    t = _turns(spark, sf_dir).filter("page IS NOT NULL")
    return alignment.page_tiers(t, ["conv_id"], "page", ["turn"]).select("conv_id", "turn", "tier", "first_on_page")


def aligned_turns(spark, sf_dir):
    """Turns bound to pages of their conversation, pages being runs of two turns without blanks."""
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("source_seq"), "text", (F.col("turn") % 5 == 4).alias("keep_next"))
    packed = t.withColumn("page_no", F.floor(F.col("source_seq") / 2) + 1).groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list(F.struct("source_seq", "text"))).alias("x"))
    pages = packed.select("doc_id", "page_no", F.regexp_replace(F.array_join(F.transform("x", lambda r: r["text"]), ""), r"(?U)\s+", "").alias("text"))
    return alignment.monotone_pages(t, pages)


def located_units(spark, sf_dir):
    """Event types placed one after another among each user's events, by value."""
    ev = table(spark, sf_dir, "events")
    units = ev.select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("unit_id")).distinct().withColumn("place", F.ascii("unit_id")).withColumn("out_of_order", F.col("unit_id") == "view")
    cand = ev.select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("unit_id"), F.col("event_id").alias("order"), F.floor("value").alias("score"))
    return alignment.greedy_locations(cand, units)


def planned_breaks(spark, sf_dir):
    """Breaks that orders of a customer need, as units that begin pages."""
    o = table(spark, sf_dir, "orders")
    units = o.select(
        F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("place"), F.col("o_orderkey").alias("unit_id"), F.when(F.col("o_orderkey") % 9 != 0, F.concat(F.lit("p"), F.col("o_orderkey") % 6)).alias("source_ref"),
        F.when(F.col("o_orderstatus") == "F", 2).otherwise(1).alias("start_page"), F.when(F.col("o_orderpriority") > "2", "new_page").otherwise("odd").alias("start"), F.lit("page_range_exclusive").alias("scope"),
    )
    return documents.pagination_plan(units).select("doc_id", "place", "status", "action_id")


def untitled_contents(spark, sf_dir):
    """Urgent orders as contents pages whose price is not between their neighbours'."""
    o = table(spark, sf_dir, "orders")
    units = o.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("place"), (F.col("o_orderpriority") == "1-URGENT").alias("is_contents"), F.col("o_orderpriority").alias("title"), F.when(F.col("o_orderkey") % 4 != 0, F.floor("o_totalprice")).alias("paragraph"))
    return documents.missing_titles(units).select("doc_id", "place", "insert_before")


def reference_ids(spark, sf_dir):
    """Ids of references made of part keys and sizes."""
    part = table(spark, sf_dir, "part")
    ref = F.concat(F.lit("word/document.xml:tbl["), F.col("p_size"), F.lit("]/tr["), F.col("p_partkey") % 7, F.lit("]/tc[2]/p["), F.col("p_partkey"), F.lit("]"))
    return part.select("p_partkey", documents.stable_ids(F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("x:p["), F.col("p_partkey"), F.lit("]"))).otherwise(ref)).alias("i")).select("p_partkey", "i.*")


def slot_kinds(spark, sf_dir):
    """Kinds of slots by part names."""
    part = table(spark, sf_dir, "part")
    name = F.element_at(F.array(*[F.lit(x) for x in ("数据表", "Figure", "题名", "正文")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    kind = documents.slot_kind(F.lit("u"), name)
    return part.select("p_partkey", kind.alias("kind"), F.array_join(documents.accepted_kinds(kind), ",").alias("accepted"))


def graded_elements(spark, sf_dir):
    """Roles and confidence of parts as elements."""
    part = table(spark, sf_dir, "part")
    policy = F.element_at(F.array(*[F.lit(x) for x in ("fixed", "fill", "generated", "remove_instruction", "unknown")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    hint = F.when(F.col("p_size") % 4 == 0, "student_field_candidate")
    done = documents.executed_policy(policy)
    return part.select("p_partkey", documents.role_of(hint, done).alias("role"), documents.confidence_of(done, F.when(F.col("p_size") > 3, F.col("p_name")), hint, ["1"], ["2"]).alias("confidence"), documents.fill_source(done).alias("source"))


def gold_faults(spark, sf_dir):
    """Whole documents as gold spans of three thirds, some of them shifted or cut; those under three characters as one run."""
    docs = table(spark, sf_dir, "documents").withColumn("n", F.length("text"))
    key = [F.col("source").alias("doc_id"), F.col("doc_id").cast("string").alias("raw_run_id")]
    third, two = F.floor(F.col("n") / 3).cast("int"), F.floor(F.col("n") * 2 / 3).cast("int")
    cuts = F.array(*[F.struct(F.lit(i).alias("i"), a.alias("start"), b.alias("end")) for i, (a, b) in enumerate(((F.lit(0), third), (third, two), (two, F.col("n"))))])
    s = docs.filter("n >= 3").select("source", "doc_id", "text", F.explode(cuts).alias("c"))
    shifted = F.when(F.col("doc_id") % 10 == 0, F.col("c.start") + 1).otherwise(F.col("c.start"))
    spans = s.filter("NOT (doc_id % 7 = 0 AND c.i = 2)").select(*key, F.lit("span").alias("target_kind"), shifted.alias("start"), F.col("c.end").alias("end"), F.substring("text", shifted + 1, F.col("c.end") - shifted).alias("text"))
    none = F.lit(None).cast("int")
    runs = docs.filter("n < 3 OR n IS NULL").select(*key, F.lit("run").alias("target_kind"), none.alias("start"), none.alias("end"), "text")
    return documents.span_ledger_faults(spans.unionByName(runs), docs.select(*key, F.col("text").alias("run_text")))


def span_counts(spark, sf_dir):
    """Atomic spans of turns: how many there are, and that they cover the turn."""
    t = table(spark, sf_dir, "conversations")
    s = t.select("conv_id", "turn", "text", F.explode(tx.atomic_spans(F.concat("text", F.lit("（x）：___")))).alias("s"))
    return s.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n"), F.max("s.end").cast("long").alias("end"), F.sum(F.length("s.text")).alias("n_chars"))


def word_boxes(spark, sf_dir):
    """Links of pages as words of a layout, with their offsets."""
    pages = table(spark, sf_dir, "pages")
    html = F.concat(F.lit('<page width="10" height="20">'), F.array_join(F.transform(F.regexp_extract_all("html", F.lit('<a href="/([^"]*)"')), lambda a: F.concat(F.lit('<word xMin="1" yMin="2" xMax="3" yMax="4">'), a, F.lit("</word>"))), ""), F.lit("</page>"))
    words = layout.words(pages.select(F.col("page_id").cast("string").alias("path"), html.alias("html")))
    return words.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.max("end").alias("end"))


def boundary_dedupe(spark, sf_dir):
    """Views absorbed by a purchase of the same user on the same day."""
    ev = table(spark, sf_dir, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("ref"), "event_type", "event_id")
    return ledger.absorbed(ev, ["user_id"], "ref", "event_type", "purchase", "view", "event_id").filter("absorbed_by IS NOT NULL").select("event_id", "absorbed_by")


QUERIES = {f.__name__: f for f in (
    boundary_sides, kept_with_next, page_tiers, aligned_turns, located_units, planned_breaks, untitled_contents, reference_ids, slot_kinds, graded_elements, gold_faults, span_counts, word_boxes, boundary_dedupe,
)}

_TURNS = """t AS (SELECT conv_id, turn, length(text) AS n, CASE WHEN turn % 3 = 0 THEN turn // 3 + 1 END AS page, length(text) % 2 = 0 AS keep FROM conversations),
  e AS (SELECT conv_id, turn AS edge FROM t WHERE n > 400),
  k AS (SELECT *, last_value(CASE WHEN page IS NOT NULL THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bt,
               first_value(CASE WHEN page IS NOT NULL THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nt FROM t)"""

SQL = {
    "boundary_sides": f"""WITH {_TURNS}, c AS (SELECT k.conv_id, k.turn, count(edge) AS n, min(edge) AS edge FROM k LEFT JOIN e ON e.conv_id = k.conv_id AND edge >= bt AND edge < nt WHERE page IS NULL GROUP BY ALL)
        SELECT k.conv_id, k.turn AS seq, coalesce(page, CASE WHEN c.n = 1 AND nt // 3 > bt // 3 THEN CASE WHEN k.turn <= c.edge THEN bt // 3 + 1 ELSE nt // 3 + 1 END END) AS filled FROM k LEFT JOIN c ON c.conv_id = k.conv_id AND c.turn = k.turn""",
    "kept_with_next": f"""WITH {_TURNS}, c AS (SELECT k.conv_id, k.turn, count(edge) AS n FROM k LEFT JOIN e ON e.conv_id = k.conv_id AND edge >= k.turn AND edge < nt GROUP BY ALL)
        SELECT k.conv_id, k.turn AS seq, coalesce(page, CASE WHEN keep AND nt IS NOT NULL AND c.n = 0 THEN nt // 3 + 1 END) AS filled FROM k JOIN c ON c.conv_id = k.conv_id AND c.turn = k.turn""",
    "page_tiers": f"WITH {_TURNS} SELECT conv_id, turn, CAST(row_number() OVER w AS INTEGER) AS tier, row_number() OVER w = 1 AS first_on_page FROM t WHERE page IS NOT NULL WINDOW w AS (PARTITION BY conv_id, page ORDER BY turn)",
    "planned_breaks": """
        WITH u AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1 AS first, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderkey % 6 END AS ref, o_orderstatus = 'F' AS seen FROM orders),
        p AS (SELECT *, NOT (first AND o_orderpriority <= '2') AS fresh FROM u), w AS (SELECT *, fresh AND NOT seen AND ref IS NOT NULL AND NOT first AS wants FROM p),
        q AS (SELECT *, wants AND row_number() OVER (PARTITION BY o_custkey, ref, wants ORDER BY o_orderkey) = 1 AS plans FROM w), n AS (SELECT *, sum(CASE WHEN plans THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS num FROM q)
        SELECT o_custkey AS doc_id, o_orderkey AS place, CASE WHEN plans THEN 'action_planned' WHEN fresh AND seen THEN 'already_satisfied' WHEN fresh AND ref IS NULL THEN 'manual_review' ELSE 'no_action_required' END AS status,
               CASE WHEN plans THEN 'a_' || lpad(CAST(CAST(num AS BIGINT) AS VARCHAR), 3, '0') END AS action_id FROM n""",
    "untitled_contents": """
        WITH u AS (SELECT o_custkey, o_orderkey, o_orderpriority = '1-URGENT' AS c, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) END AS p FROM orders),
        x AS (SELECT *, last_value(p IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, first_value(p IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM u)
        SELECT o_custkey AS doc_id, o_orderkey AS place, a AS insert_before FROM x WHERE c AND a IS NOT NULL AND NOT coalesce((b IS NULL OR p > b) AND p < a, false)""",
    "reference_ids": """
        SELECT p_partkey, 'p_' || lpad(CAST(p_partkey AS VARCHAR), CAST(greatest(4, length(CAST(p_partkey AS VARCHAR))) AS INTEGER), '0') AS paragraph_id, CASE WHEN p_partkey % 3 <> 0 THEN 'tbl_' || lpad(CAST(p_size AS VARCHAR), 4, '0') END AS table_id,
               CASE WHEN p_partkey % 3 <> 0 THEN 'tbl_' || lpad(CAST(p_size AS VARCHAR), 4, '0') || '.r_' || lpad(CAST(p_partkey % 7 AS VARCHAR), 3, '0') || '.c_002' END AS cell_id FROM part""",
    "slot_kinds": "SELECT p_partkey, ['table', 'image', 'heading', 'body_content'][CAST(p_partkey % 4 AS INTEGER) + 1] AS kind, ['table', 'image', 'heading,paragraph', 'heading,paragraph,table,image'][CAST(p_partkey % 4 AS INTEGER) + 1] AS accepted FROM part",
    "graded_elements": """
        WITH x AS (SELECT p_partkey, ['fixed', 'fill', 'generated', 'instruction_remove', 'fixed'][CAST(p_partkey % 5 AS INTEGER) + 1] AS p, p_size % 4 = 0 AS h, CASE WHEN p_size > 3 THEN p_name ELSE '' END AS t FROM part)
        SELECT p_partkey, CASE WHEN h OR p = 'fill' THEN 'student_content' WHEN p = 'generated' THEN 'generated_field' WHEN p = 'fixed' THEN 'template_fixed' ELSE 'template_instruction' END AS role,
               CASE WHEN p = 'fixed' AND h THEN 'medium' WHEN p IN ('instruction_remove', 'generated') THEN 'high' WHEN p = 'fill' THEN CASE WHEN contains(t, '1') AND contains(t, '2') THEN 'high' ELSE 'medium' END WHEN trim(t) = '' THEN 'low' ELSE 'high' END AS confidence,
               CASE p WHEN 'fill' THEN 'student_content' WHEN 'generated' THEN 'generated_field' END AS source FROM x""",
    "gold_faults": """
        SELECT source AS doc_id, CAST(doc_id AS VARCHAR) AS raw_run_id, CASE WHEN doc_id % 10 = 0 THEN 'spans_not_contiguous' ELSE 'spans_incomplete' END AS fault FROM documents WHERE length(text) >= 3 AND (doc_id % 10 = 0 OR doc_id % 7 = 0)""",
    "word_boxes": """
        WITH w AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="/([^"]*)"', 1)) AS x FROM pages)
        SELECT CAST(page_id AS VARCHAR) AS path, count(*) AS n, CAST(sum(length(regexp_replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\\s+', '', 'g'))) AS BIGINT) AS "end" FROM w GROUP BY page_id""",
    "boundary_dedupe": """
        WITH p AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, min(event_id) AS by_id FROM events WHERE event_type = 'purchase' GROUP BY ALL)
        SELECT event_id, by_id AS absorbed_by FROM events e JOIN p ON p.user_id = e.user_id AND p.day = strftime(e.ts, '%Y-%m-%d') WHERE event_type = 'view'""",
}
