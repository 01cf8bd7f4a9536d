"""Queries of trees and nested documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioscope.operators import assembly, baselines, document_tree, drift, hierarchy
from folioscope.sources.tables import placed_table, table

BY = ["p_brand"]


def _parts(spark, sf_dir):
    """Parts of a brand numbered from 1."""
    n = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    return table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.col("p_size").cast("long").alias("own")).withColumn("node", n.cast("long"))


def _heap(spark, sf_dir):
    return _parts(spark, sf_dir).withColumn("parent", F.when(F.col("node") > 1, F.floor(F.col("node") / 2)))


def _deep(spark, sf_dir):
    """Each part under one of the three before it, so that paths grow with the table."""
    return _parts(spark, sf_dir).withColumn("parent", F.when(F.col("node") > 1, F.greatest(F.lit(1), F.col("node") - 1 - F.col("own") % 3)))


def tree_spans(spark, sf_dir):
    """Depth and span of every part in a walk depth first, siblings by size."""
    return hierarchy.preorder(_deep(spark, sf_dir), BY, "own")


def deep_sums(spark, sf_dir):
    """Sums, leaves and first leaves under every part of deep trees."""
    return hierarchy.roll_up(_deep(spark, sf_dir), BY, ["own"], leaves=True)


def leaf_faults(spark, sf_dir):
    """Declared leaves, some left out and some made up, against those of the children and of the tree."""
    t = _heap(spark, sf_dir)
    members = hierarchy.leaf_members(t, BY).filter((F.col("node") * 7 + F.col("leaf")) % 50 != 0)
    more = t.filter("own % 25 = 3").select("p_brand", "node", F.lit(1).cast("long").alias("leaf"))
    return hierarchy.leaf_set_faults(t, members.unionByName(more), BY)


def budgeted_walk(spark, sf_dir):
    """What a walk of 40 calls and 5 levels a brand settles each leaf with, by decisions drawn from the parts' sizes."""
    t, own, node = _heap(spark, sf_dir), F.col("own"), F.col("node")
    result = F.when(own % 4 != 0, "split").when(own % 3 == 0, "fill").otherwise("keep")
    inline = F.when(own % 6 == 1, F.array(F.struct((node * 2 + 1).alias("node"), F.lit("fill").alias("result"), F.when(own % 5 == 2, "manual_review").otherwise("accepted").alias("status"))))
    told = t.filter("node % 29 <> 0").select(
        "p_brand", "node", result.alias("result"), F.when(own % 13 == 0, "manual_review").otherwise("accepted").alias("status"), F.when(own % 17 == 0, "TimeoutError").alias("error"),
        F.when(own % 5 != 0, F.array(node * 2, node * 2 + 1)).otherwise(F.array(node * 2)).alias("inspect"), inline.alias("inline"),
    )
    return hierarchy.budgeted_walk(t, told, BY, "node", max_depth=5, max_calls=40)


QUERIES = {f.__name__: f for f in (tree_spans, deep_sums, leaf_faults, budgeted_walk)}

_NUMBERED = "x AS (SELECT p_brand, CAST(p_size AS BIGINT) AS own, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS node FROM part)"
_HEAP = f"{_NUMBERED}, t AS (SELECT *, CASE WHEN node > 1 THEN node // 2 END AS parent FROM x)"
_DEEP = f"{_NUMBERED}, t AS (SELECT *, CASE WHEN node > 1 THEN greatest(1, node - 1 - own % 3) END AS parent FROM x)"
_CLOSURE = """a AS (SELECT p_brand, node, node AS ancestor FROM t
    UNION ALL SELECT a.p_brand, a.node, t.parent FROM a JOIN t ON t.p_brand = a.p_brand AND t.node = a.ancestor WHERE t.parent IS NOT NULL)"""
_LEAVES = "f AS (SELECT p_brand, node FROM t WHERE (p_brand, node) NOT IN (SELECT (p_brand, parent) FROM t WHERE parent IS NOT NULL))"

SQL = {
    "tree_spans": f"""WITH RECURSIVE {_DEEP}, {_CLOSURE}, z AS (SELECT p_brand, ancestor AS node, count(*) AS size FROM a GROUP BY ALL),
        w AS (SELECT p_brand, node, 0 AS depth, [own * 1000000000 + node] AS path FROM t WHERE parent IS NULL
              UNION ALL SELECT t.p_brand, t.node, w.depth + 1, list_append(w.path, t.own * 1000000000 + t.node) FROM w JOIN t ON t.p_brand = w.p_brand AND t.parent = w.node),
        r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY path) AS first FROM w)
        SELECT p_brand, node, depth, first, first + size - 1 AS last FROM r JOIN z USING (p_brand, node)""",
    "deep_sums": f"""WITH RECURSIVE {_DEEP}, {_CLOSURE}, {_LEAVES}, s AS (SELECT p_brand, ancestor AS node, CAST(sum(own) AS BIGINT) AS own, count(*) AS n_nodes FROM a JOIN t USING (p_brand, node) GROUP BY ALL),
        l AS (SELECT p_brand, ancestor AS node, count(*) AS n_leaves, min(node) AS first_leaf FROM a JOIN f USING (p_brand, node) GROUP BY ALL)
        SELECT * FROM s JOIN l USING (p_brand, node)""",
    "leaf_faults": f"""WITH RECURSIVE {_HEAP}, {_CLOSURE}, {_LEAVES}, m AS (SELECT p_brand, ancestor AS node, node AS leaf FROM a JOIN f USING (p_brand, node)),
        d AS (SELECT * FROM m WHERE (node * 7 + leaf) % 50 <> 0 UNION SELECT p_brand, node, 1 FROM t WHERE own % 25 = 3),
        own AS (SELECT p_brand, node, list_sort(list(leaf)) AS own FROM d GROUP BY ALL), held AS (SELECT p_brand, node, list_sort(list(leaf)) AS derived FROM m GROUP BY ALL),
        kids AS (SELECT t.p_brand, t.parent AS node, list_sort(list(DISTINCT d.leaf)) AS kids FROM t JOIN d USING (p_brand, node) WHERE parent IS NOT NULL GROUP BY ALL),
        j AS (SELECT t.p_brand, t.node, own.own, derived, kids, f.node IS NOT NULL AS leaf FROM t LEFT JOIN own USING (p_brand, node) LEFT JOIN held USING (p_brand, node) LEFT JOIN kids USING (p_brand, node) LEFT JOIN f USING (p_brand, node))
        SELECT p_brand, node, 'not_the_union' AS fault FROM j WHERE NOT leaf AND own IS DISTINCT FROM kids UNION ALL SELECT p_brand, node, 'no_identity' FROM j WHERE leaf AND own IS NULL
        UNION ALL SELECT p_brand, node, 'not_derived' FROM j WHERE own IS DISTINCT FROM derived""",
    "budgeted_walk": f"""WITH RECURSIVE {_HEAP}, s AS (SELECT *, node * 2 > max(node) OVER (PARTITION BY p_brand) AS leaf, node % 29 <> 0 AS told, own % 17 = 0 AS failed, own % 13 <> 0 AS ok,
            CASE WHEN own % 4 <> 0 THEN 'split' WHEN own % 3 = 0 THEN 'fill' ELSE 'keep' END AS result FROM t),
        e AS (SELECT s.*, p.own AS above, coalesce(p.told AND NOT p.failed AND p.ok AND p.result = 'split', true) AS under,
            coalesce(p.told AND NOT p.failed AND p.ok AND p.result = 'split' AND p.own % 6 = 1 AND s.node % 2 = 1, false) AS inlined, coalesce(p.own % 5 = 2, false) AS bad_inline,
            p.own IS NULL OR p.own % 5 <> 0 OR s.node % 2 = 0 AS asked FROM s LEFT JOIN s p ON p.p_brand = s.p_brand AND p.node = s.parent),
        w AS (SELECT p_brand, node, 0 AS depth, [node] AS path FROM e WHERE parent IS NULL
              UNION ALL SELECT e.p_brand, e.node, depth + 1, list_append(path, e.node) FROM w JOIN e ON e.p_brand = w.p_brand AND e.parent = w.node WHERE e.under AND NOT e.inlined AND e.asked),
        called AS (SELECT p_brand, node FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY path) AS n FROM w WHERE depth <= 5) WHERE n <= 40),
        deep AS (SELECT p_brand, node, CAST(floor(log2(node)) AS INTEGER) AS depth FROM t),
        o AS (SELECT e.*, depth, c.node IS NOT NULL AS called, e.parent IS NULL OR u.node IS NOT NULL AS live FROM e JOIN deep USING (p_brand, node) LEFT JOIN called c USING (p_brand, node) LEFT JOIN called u ON u.p_brand = e.p_brand AND u.node = e.parent),
        k AS (SELECT *, CASE WHEN NOT live OR NOT under THEN NULL WHEN inlined THEN 'inline' WHEN NOT asked THEN 'passed' WHEN NOT called AND depth > 5 THEN 'deep' WHEN NOT called THEN 'spent' WHEN told AND failed THEN 'failed'
                  WHEN told AND ok AND result = 'split' AND NOT leaf THEN NULL WHEN told AND ok AND result <> 'split' THEN 'taken' ELSE 'review' END AS how FROM o),
        g AS (SELECT *, CASE how WHEN 'inline' THEN CASE WHEN bad_inline THEN 'keep' ELSE 'fill' END WHEN 'taken' THEN result WHEN NULL THEN NULL ELSE 'keep' END AS action,
            CASE WHEN how IN ('deep', 'spent', 'failed', 'review') OR (how = 'inline' AND bad_inline) THEN 'fallback' WHEN how = 'passed' THEN 'inherited' WHEN leaf THEN 'direct' ELSE 'inherited' END AS resolution,
            CASE WHEN how IN ('deep', 'spent') THEN 'fallback' WHEN how = 'failed' THEN 'failed' WHEN how = 'review' OR (how = 'inline' AND bad_inline) THEN 'manual_review' ELSE 'accepted' END AS status,
            CASE how WHEN 'deep' THEN 'maximum traversal depth 5 reached' WHEN 'spent' THEN 'maximum decision call budget 40 reached' WHEN 'failed' THEN 'TimeoutError' END AS reason FROM k),
        q AS (SELECT p_brand, node, leaf, how, action, resolution, status, reason, CASE WHEN how IS NOT NULL THEN node END AS settled_at,
                  CASE WHEN how = 'passed' THEN parent WHEN how IN ('inline', 'taken') AND resolution = 'inherited' THEN node END AS inherited_from FROM g WHERE parent IS NULL
              UNION ALL SELECT g.p_brand, g.node, g.leaf, coalesce(q.how, g.how), CASE WHEN q.how IS NULL THEN g.action ELSE q.action END, CASE WHEN q.how IS NULL THEN g.resolution ELSE q.resolution END,
                  CASE WHEN q.how IS NULL THEN g.status ELSE q.status END, CASE WHEN q.how IS NULL THEN g.reason ELSE q.reason END, CASE WHEN q.how IS NULL THEN CASE WHEN g.how IS NOT NULL THEN g.node END ELSE q.settled_at END,
                  CASE WHEN q.how IS NULL THEN CASE WHEN g.how = 'passed' THEN g.parent WHEN g.how IN ('inline', 'taken') AND g.resolution = 'inherited' THEN g.node END ELSE q.inherited_from END
              FROM q JOIN g ON g.p_brand = q.p_brand AND g.parent = q.node)
        SELECT p_brand, node AS leaf, action, resolution, status, reason, settled_at, inherited_from FROM q WHERE leaf""",
}


# -- document trees ----------------------------------------------------------------

#: Lines of a unit and of a table, and what a line's place in the document is multiplied by.
_UNIT, _TABLE, _STEP = 20, 6, 100_000


def _packet(spark, sf_dir):
    """Rows and run facts of documents: lines are paragraphs, and parts of lines with bars are cells.

    Some table rows lack a number, some cells share an id, and parts with the same text share their runs.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("l", "line"))
    part = docs.select("doc_id", "l", F.contains("line", F.lit("|")).alias("bars"), F.posexplode(F.when(F.contains("line", F.lit("|")), F.split("line", "[|]")).otherwise(F.array("line"))).alias("j", "raw"))
    part = part.withColumns({"text": F.trim("raw"), "source_seq": F.col("l").cast("long") * _STEP + F.col("j"), "unit_id": F.concat(F.lit("u"), F.floor(F.col("l") / _UNIT).cast("string"))}).filter(~F.col("bars") | (F.col("text") != ""))
    bars, l, j = F.col("bars"), F.col("l"), F.col("j")
    run = lambda x: F.substring(F.md5(F.concat("text", F.lit(x))), 1, 8)
    rows = part.select(
        "doc_id", "unit_id", "source_seq", F.when(bars, F.concat(F.lit("t"), F.floor(l / _TABLE).cast("string"))).alias("table_id"), F.when(bars & (l % 11 != 5), l + 1).alias("row_no"), F.when(bars, j + 1).alias("column_no"),
        F.when(bars & (j % 3 != 2), F.concat(F.lit("c"), l.cast("string"), F.lit("-"), F.floor(j / 2).cast("string"))).alias("cell_id"), F.concat(F.lit("p"), F.col("source_seq").cast("string")).alias("paragraph_id"), "text",
        F.when(F.col("text") != "", F.array(run(""), run("x"))).alias("raw_run_ids"), F.when(l % 13 == 0, "unbound").otherwise("bound").alias("binding"),
    )
    half = F.floor(F.length("text") / 2).cast("int")
    first = part.filter("text <> ''").select("doc_id", "source_seq", F.lit(0).alias("position"), run("").alias("raw_run_id"), F.substring(F.col("text"), F.lit(1), half).alias("text"))
    second = part.filter("text <> '' AND length(text) % 3 <> 0").select("doc_id", "source_seq", F.lit(1).alias("position"), F.lit("other").alias("raw_run_id"), F.substring(F.col("text"), half + 1, F.length("text")).alias("text"))
    return rows, first.unionByName(second)


def tree_nodes(spark, sf_dir):
    """Nodes of all documents down to runs, with spans in document order and what is complete below each."""
    rows, runs = _packet(spark, sf_dir)
    nodes = document_tree.document_nodes(rows, runs, ["doc_id"], spans=False)
    digest = F.unhex(F.md5(F.coalesce("text", F.lit("-"))))  # half as many bytes as its digits, to be moved
    nodes = document_tree.nested_sets(nodes.withColumn("text", digest), ["doc_id", "unit_id"])
    return nodes.select("doc_id", "unit_id", "node", "parent", "kind", F.lower(F.hex("text")).alias("text"), "alias_of", "children_complete", "content_complete", "unbound", "omitted", "first", "last", "n_leaves")


QUERIES["tree_nodes"] = tree_nodes

SQL["tree_nodes"] = f"""
    WITH d AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS l FROM documents),
    c AS (SELECT doc_id, l, contains(line, '|') AS bars, CASE WHEN contains(line, '|') THEN string_split(line, '|') ELSE [line] END AS parts FROM d),
    e AS (SELECT doc_id, l, bars, unnest(parts) AS raw, generate_subscripts(parts, 1) - 1 AS j FROM c),
    r AS (SELECT doc_id, l, bars, j, trim(raw, ' ') AS text, l * {_STEP} + j AS seq, 'u' || (l // {_UNIT}) AS unit_id, CASE WHEN bars THEN 't' || (l // {_TABLE}) END AS table_id,
            CASE WHEN bars AND l % 11 <> 5 THEN l + 1 END AS row_no, CASE WHEN bars THEN coalesce(CASE WHEN j % 3 <> 2 THEN 'c' || l || '-' || (j // 2) END, 'column:' || (j + 1)) END AS cell_key, l % 13 = 0 AS loose
          FROM e WHERE NOT bars OR trim(raw, ' ') <> ''),
    p AS (SELECT *, CASE WHEN bars THEN coalesce(row_no, {1_000_000} + row_number() OVER (PARTITION BY doc_id, unit_id, table_id, row_no IS NULL ORDER BY seq)) END AS row_at FROM r),
    g AS (SELECT doc_id, unit_id, table_id, row_at, cell_key, min(seq) AS first_seq, min_by(j + 1, seq) AS col, string_agg(text, chr(10) ORDER BY seq) AS text, count(*) FILTER (loose) AS unbound, list_sort(list(DISTINCT text)) AS sig
          FROM p WHERE bars GROUP BY ALL),
    h AS (SELECT *, row_number() OVER (PARTITION BY doc_id, unit_id, table_id, row_at ORDER BY first_seq) AS cell_at FROM g),
    n AS (SELECT *, 'table:' || table_id || '/row:' || CASE WHEN row_at < 100 THEN lpad(CAST(row_at AS VARCHAR), 3, '0') ELSE CAST(row_at AS VARCHAR) END AS row_ref, min(first_seq) OVER (PARTITION BY doc_id, unit_id, table_id) AS table_at, 2 * len(sig) AS n_runs FROM h),
    k AS (SELECT *, row_ref || '/cell:' || CASE WHEN col < 100 THEN lpad(CAST(col AS VARCHAR), 3, '0') ELSE CAST(col AS VARCHAR) END AS cell FROM n),
    a AS (SELECT *, first_value(cell) OVER w AS owner, row_number() OVER w AS nth FROM k WINDOW w AS (PARTITION BY doc_id, unit_id, table_id, sig ORDER BY row_at, cell_at)),
    cells AS (SELECT *, nth > 1 AS aliased, CASE WHEN nth > 1 THEN owner END AS alias_of, CASE WHEN nth > 1 THEN n_runs ELSE unbound END AS missing FROM a),
    whole AS (SELECT doc_id, table_id, count(*) AS whole FROM r WHERE bars GROUP BY ALL),
    rws AS (SELECT doc_id, unit_id, table_id, table_at, row_at, row_ref, bool_and(NOT aliased) AS ok, sum(unbound) + sum(missing) AS missing, string_agg(text, ' | ' ORDER BY cell_at) AS text FROM cells GROUP BY ALL),
    hold AS (SELECT doc_id, unit_id, table_id, count(*) AS held, count(*) FILTER (row_no IS NULL) AS lost FROM p WHERE bars GROUP BY ALL),
    tbl AS (SELECT w.doc_id, w.unit_id, w.table_id, w.table_at, bool_and(ok) AS ok, sum(missing) AS missing, any_value(whole) - any_value(held) AS omitted, any_value(lost) AS lost
            FROM rws w JOIN hold USING (doc_id, unit_id, table_id) JOIN whole USING (doc_id, table_id) GROUP BY ALL),
    par AS (SELECT p.doc_id, p.unit_id, p.seq, p.text, p.loose, 'unit:' || p.unit_id AS parent, [] AS above FROM p WHERE NOT bars
            UNION ALL SELECT p.doc_id, p.unit_id, p.seq, p.text, p.loose, c.cell, [table_at, c.row_at, c.cell_at] FROM p JOIN cells c USING (doc_id, unit_id, table_id, row_at, cell_key) WHERE NOT aliased),
    allp AS (SELECT *, parent || '/paragraph:p' || seq AS paragraph, list_append(above, seq) AS place, text = '' OR length(text) % 3 <> 0 AS ok FROM par),
    runs AS (SELECT doc_id, unit_id, paragraph, list_append(place, 0) AS place, substr(md5(text), 1, 8) AS id, substr(text, 1, length(text) // 2) AS text, true AS ok FROM allp WHERE text <> ''
             UNION ALL SELECT doc_id, unit_id, paragraph, list_append(place, 1), substr(md5(text || 'x'), 1, 8), CASE WHEN ok THEN substr(text, length(text) // 2 + 1) ELSE '' END, ok FROM allp WHERE text <> ''),
    nodes AS (
      SELECT doc_id, unit_id, cell AS node, row_ref AS parent, 'cell' AS kind, [table_at, row_at, cell_at] AS place, text, alias_of, NOT aliased AS children_complete, NOT aliased AS content_complete, missing AS unbound, 0 AS omitted FROM cells
      UNION ALL SELECT doc_id, unit_id, row_ref, 'table:' || table_id, 'row', [table_at, row_at], text, NULL, true, ok, missing, 0 FROM rws
      UNION ALL SELECT doc_id, unit_id, 'table:' || table_id, 'unit:' || unit_id, 'table', [table_at], NULL, NULL, omitted = 0 AND lost = 0, omitted = 0 AND ok, missing + lost, omitted FROM tbl
      UNION ALL SELECT doc_id, unit_id, paragraph, parent, 'paragraph', place, text, NULL, true, ok, CASE WHEN loose THEN 1 ELSE 0 END, 0 FROM allp
      UNION ALL SELECT doc_id, unit_id, 'run:' || id, paragraph, 'run', place, text, NULL, true, ok, CASE WHEN ok THEN 0 ELSE 1 END, 0 FROM runs),
    direct AS (SELECT doc_id, unit_id, bool_and(content_complete) AS ok, sum(unbound) AS unbound, sum(omitted) AS omitted FROM nodes WHERE len(place) = 1 GROUP BY ALL),
    every AS (SELECT * FROM nodes UNION ALL SELECT doc_id, unit_id, 'unit:' || unit_id, NULL, 'unit', [], NULL, NULL, true, ok, unbound, omitted FROM direct),
    placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id, unit_id ORDER BY place) AS first FROM every),
    up AS (SELECT doc_id, unit_id, first, unnest([place[:i] for i in range(0, len(place) + 1)]) AS place FROM placed),
    size AS (SELECT doc_id, unit_id, place, count(*) AS size FROM up GROUP BY ALL),
    lone AS (SELECT placed.doc_id, placed.unit_id, placed.first FROM placed JOIN size USING (doc_id, unit_id, place) WHERE size = 1),
    leaves AS (SELECT up.doc_id, up.unit_id, up.place, count(*) AS n_leaves FROM up JOIN lone USING (doc_id, unit_id, first) GROUP BY ALL)
    SELECT doc_id, unit_id, node, parent, kind, md5(coalesce(text, '-')) AS text, alias_of, children_complete, content_complete, CAST(unbound AS BIGINT) AS unbound, CAST(omitted AS BIGINT) AS omitted, first, first + size - 1 AS last, n_leaves
    FROM placed JOIN size USING (doc_id, unit_id, place) JOIN leaves USING (doc_id, unit_id, place)"""


# -- assembled documents -----------------------------------------------------------


def template_spec(spark, sf_dir):
    """A customer's orders as units and their lines as elements, put together, as a digest of the nested rows.

    Lines of an order that have one number stand as in the table.
    """
    orders, lines = table(spark, sf_dir, "orders"), placed_table(spark, sf_dir, "lineitem", "e_place")
    n = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long")
    key = F.col("o_orderkey")
    x = orders.join(n, "o_orderkey").withColumn("place", place)
    units = x.select(
        F.col("o_custkey").alias("doc"), "place", F.concat(F.lit("u"), key).alias("unit_id"), F.col("o_orderpriority").alias("section"), F.when(key % 3 == 0, "new_page").otherwise("odd").alias("start"), F.lit("page_range_exclusive").alias("scope"),
        F.when(key % 7 != 0, F.col("place") * 5).alias("u_start"), F.when(key % 7 != 0, F.col("place") * 5 + F.col("n") - 1).alias("u_end"), (F.col("place") * 2).alias("p_start"), (F.col("place") * 2 + 1).alias("p_end"),
    )
    sections = units.filter("place % 3 = 1").select("doc", F.concat(F.lit("s"), "place").alias("section_id"), F.col("place").alias("s_order"), (F.col("place") * 5 - 2).alias("s_start"), (F.col("place") * 5 + 12).alias("s_end"), (F.col("place") * 2).alias("sp_start"), (F.col("place") * 2 + 2).alias("sp_end"))
    number = F.col("l_linenumber")
    word = lambda words, n: F.element_at(F.array(*map(F.lit, words)), n + 1)
    raw = lines.select("l_orderkey", number.alias("number"), (F.col("l_partkey") % 5).cast("int").alias("mode"), (F.col("l_suppkey") % 4).cast("int").alias("instruct"), F.col("l_returnflag").alias("flag"), "e_place")
    raw = raw.join(orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("doc")), "l_orderkey")
    elements = raw.select("doc", F.concat(F.lit("u"), "l_orderkey").alias("unit_id"), "number", "mode", "instruct", "flag", F.when(F.col("number") != 3, F.col("number")).alias("e_order"), "e_place")

    def made(x):
        """Elements with what the digest asks of them, made of lines."""
        x = x.withColumns({"mode": word(("AIR", "MAIL", "TRUCK", "RAIL", "SHIP"), F.col("mode")), "instruct": word(("NONE", "COD", "page", "seq"), F.col("instruct"))}).withColumns({
            "element_id": F.concat(F.lit("e"), "number"), "policy": F.when(F.col("flag") == "N", "fill").when(F.col("flag") == "R", "generated"), "content": F.concat_ws(" ", "mode", "instruct"),
            "role_hint": F.when(F.col("mode") == "AIR", "student_field_candidate").when(F.col("mode") != "MAIL", "fixed_text_candidate"),
        })
        return assembly.element_spec(x, ["TRUCK", "RAIL"], ["NONE", "COD"]).drop("number", "mode", "instruct", "flag", "element_id", "policy", "content", "role_hint", "e_order")

    spec = assembly.template_spec(units, elements, sections, ["doc"], made)
    element = lambda e: F.concat_ws("^", e["stable_id"], e["executed"], e["role"], F.coalesce(e["fill_source"], F.lit("-")), F.coalesce(e["field_type"], F.lit("-")), e["confidence"], F.array_join(e["flags"], "+"))
    text = lambda u: F.concat_ws("~", u["unit_id"], u["page_policy"]["start"], u["section_profile"], F.array_join(F.transform(u["section_refs"], lambda r: F.concat(r["section_id"], F.lit(":"), r["from"], F.lit("-"), r["to"])), ","),
                                 F.array_join(u["flags"], ","), F.array_join(F.transform(u["elements"], element), ";"))
    return spec.select("doc", F.size("units").alias("n_units"), F.md5(F.array_join(F.transform("units", text), "|")).alias("digest"))


QUERIES["template_spec"] = template_spec

SQL["template_spec"] = """
    WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1),
    u AS (SELECT o_custkey AS doc, o_orderkey AS k, o_orderpriority AS section, n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders JOIN n ON l_orderkey = o_orderkey),
    s AS (SELECT doc, 's' || place AS id, place AS o, place * 5 - 2 AS a, place * 5 + 12 AS b, place * 2 AS pa, place * 2 + 2 AS pb FROM u WHERE place % 3 = 1),
    d AS (SELECT u.doc, u.place, s.id, s.o, greatest(u.place * 5, a) AS f, least(u.place * 5 + n - 1, b) AS t FROM u JOIN s ON s.doc = u.doc AND u.place * 5 <= b AND u.place * 5 + n - 1 >= a WHERE k % 7 <> 0),
    p AS (SELECT u.doc, u.place, s.id, s.o, greatest(u.place * 2, pa) AS f, least(u.place * 2 + 1, pb) AS t FROM u JOIN s ON s.doc = u.doc AND u.place * 2 <= pb AND u.place * 2 + 1 >= pa WHERE (u.doc, u.place) NOT IN (SELECT (doc, place) FROM d)),
    r AS (SELECT * FROM d UNION ALL SELECT * FROM p),
    b AS (SELECT doc, place, string_agg(id || ':' || f || '-' || t, ',' ORDER BY o) AS refs, count(*) AS c, arg_max(id, (t - f) * 100000 - o) AS best FROM r GROUP BY ALL),
    w AS (SELECT *, ['AIR', 'MAIL', 'TRUCK', 'RAIL', 'SHIP'][l_partkey % 5 + 1] AS l_shipmode, ['NONE', 'COD', 'page', 'seq'][l_suppkey % 4 + 1] AS l_shipinstruct FROM lineitem),
    e AS (SELECT o_custkey AS doc, l_orderkey AS k, l_linenumber AS l, l_shipmode || ' ' || l_shipinstruct AS content, CASE l_returnflag WHEN 'N' THEN 'fill' WHEN 'R' THEN 'generated' ELSE 'fixed' END AS policy,
            CASE WHEN l_shipmode = 'AIR' THEN 'student_field_candidate' WHEN l_shipmode <> 'MAIL' THEN 'fixed_text_candidate' END AS hint FROM w JOIN orders ON o_orderkey = l_orderkey),
    g AS (SELECT *, CASE WHEN policy = 'generated' THEN 'high' WHEN policy = 'fixed' AND hint IS NOT DISTINCT FROM 'student_field_candidate' THEN 'medium' WHEN policy = 'fixed' THEN 'high'
                    WHEN (contains(content, 'TRUCK') OR contains(content, 'RAIL')) AND (contains(content, 'NONE') OR contains(content, 'COD')) THEN 'high' ELSE 'medium' END AS confidence FROM e),
    x AS (SELECT doc, k, string_agg(concat_ws('^', 'u' || k || '.e' || l, policy, CASE WHEN hint = 'student_field_candidate' THEN 'student_content' WHEN hint IS NOT NULL THEN 'template_fixed' WHEN policy = 'fill' THEN 'student_content' WHEN policy = 'generated' THEN 'generated_field' ELSE 'template_fixed' END,
            CASE policy WHEN 'fill' THEN 'student_content' WHEN 'generated' THEN 'generated_field' ELSE '-' END, CASE WHEN policy <> 'generated' THEN '-' WHEN contains(content, 'seq') THEN 'SEQ' WHEN contains(content, 'page') THEN 'PAGE' ELSE 'FIELD_PLACEHOLDER' END, confidence, CASE WHEN confidence <> 'high' THEN 'element_confidence_needs_review' ELSE '' END), ';' ORDER BY CASE WHEN l = 3 THEN 0 ELSE l END) AS elements
          FROM g GROUP BY ALL)
    SELECT doc, count(*) AS n_units, md5(string_agg(concat_ws('~', 'u' || k, CASE WHEN k % 3 <> 0 AND place = 1 THEN 'document_start' ELSE 'new_page' END, coalesce(best, section), coalesce(refs, ''),
        CASE WHEN c IS NULL THEN 'unit_section_profile_unmapped' WHEN c > 1 THEN 'unit_crosses_section_profiles' ELSE '' END, elements), '|' ORDER BY place)) AS digest
    FROM u LEFT JOIN b USING (doc, place) LEFT JOIN x USING (doc, k) GROUP BY doc"""


# -- rows under other ids ------------------------------------------------------------


def drifted_lines(spark, sf_dir):
    """Lines of documents, numbered, against their edited documents, in which some lines are dropped, some added and all numbered anew.

    No SQL: the longest rising run is a fold; tests hold the operator against loops.
    """
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("order", "text")).withColumn("action", F.when(F.length("text") % 2 == 0, "keep").otherwise("fill"))
    expected = lines.withColumn("ref", F.concat(F.lit("r"), F.col("order").cast("string")))
    kept = lines.filter("order % 7 <> 3").withColumn("twice", F.explode(F.when(F.col("order") % 5 == 4, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    kept = kept.withColumn("text", F.when(F.col("twice") == 1, F.concat(F.lit("added "), F.col("order").cast("string"))).otherwise(F.col("text")))
    numbered = kept.withColumn("order", (F.row_number().over(Window.partitionBy("doc_id").orderBy("order", "twice")) - 1)).withColumn("ref", F.concat(F.lit("r"), F.col("order").cast("string")))
    actual = numbered.withColumn("action", F.when(F.col("order") % 9 == 0, "delete").otherwise(F.col("action"))).drop("twice")
    return drift.expectation_audit(expected, actual, ["doc_id"])


QUERIES["drifted_lines"] = drifted_lines


# -- nested dimensions ---------------------------------------------------------------


def nested_dimensions(spark, sf_dir):
    """Dimensions of orders as baselines, laid flat: the order, its lines below, and below a line its quantity; lines stand twice where the order is even."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    quantity = lambda x: F.array(F.struct(F.concat(F.lit("q"), x["l_quantity"].cast("int").cast("string")).alias("id"), F.lit("exact").alias("comparator_mode")))
    line = lambda x: F.struct(F.concat(F.lit("l"), x["l_linenumber"].cast("string")).alias("dimension_id"), F.lit("subset").alias("comparator_mode"), quantity(x).alias("children"))
    kept = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))).alias("x")).select("l_orderkey", F.transform("x", line).alias("lines"))
    top = F.array(F.struct(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("id"), F.lit("exact").alias("comparator_mode"), F.col("lines").alias("dimensions")))
    document = F.to_json(F.struct(top.alias("dimensions"), F.when(F.col("l_orderkey") % 2 == 0, F.col("lines")).alias("required_dimensions")))
    return baselines.flat_dimensions(kept.select("l_orderkey", document.alias("document")), ["l_orderkey"], "document", ["dimension_id", "comparator_mode"])


QUERIES["nested_dimensions"] = nested_dimensions

SQL["nested_dimensions"] = """
    WITH l AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n FROM lineitem),
    d AS (SELECT DISTINCT l_orderkey, [0, 0] AS place, 1 AS depth, 'o' || l_orderkey AS dimension_id, 'exact' AS comparator_mode FROM l
          UNION ALL SELECT l_orderkey, [0, 0, n], 2, 'l' || l_linenumber, 'subset' FROM l UNION ALL SELECT l_orderkey, [0, 0, n, 0], 3, 'q' || q, 'exact' FROM l
          UNION ALL SELECT l_orderkey, [1, n], 1, 'l' || l_linenumber, 'subset' FROM l WHERE l_orderkey % 2 = 0 UNION ALL SELECT l_orderkey, [1, n, 0], 2, 'q' || q, 'exact' FROM l WHERE l_orderkey % 2 = 0)
    SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY place) AS position, depth, dimension_id, comparator_mode FROM d"""
