"""The audit of units over the driver's tables: customers as documents, their orders as units, the lines of these as places."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioscope.operators import unit_audit
from folioscope.sources.shared import written
from folioscope.sources.tables import table


def unit_findings(spark, sf_dir):
    """What differs between a customer's orders as a standard and a copy with orders left out, renamed and moved, and lines lost and doubled."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").join(o.select("o_orderkey", "o_custkey"), "o_orderkey")
    # a line is ranked where its order's lines meet, so that of what ranks it the rank alone goes on
    in_order = Window.partitionBy("o_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    times = F.when(F.col("l_suppkey") % 29 == 0, 0).when(F.col("l_suppkey") % 31 == 0, 2).otherwise(1)
    lines = lines.select("o_custkey", "o_orderkey", "l_partkey", times.alias("times"), F.row_number().over(in_order).alias("nth"))
    lines = lines.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("text")), "l_partkey")
    seq = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey", "nth")).cast("long")
    lines = written(lines.select("o_custkey", "o_orderkey", seq.alias("seq"), "times", "text"))
    spans = lines.groupBy("o_orderkey").agg(F.min("seq").alias("low"), F.max("seq").alias("high"), F.min_by("text", "seq").alias("title"), F.max_by("text", "seq").alias("alias"))
    named = F.concat(F.lit("u"), k.cast("string"))
    start = F.when(F.col("o_orderstatus") == "F", "document_start").when(F.col("o_orderstatus") == "O", "new_page")
    scope = F.when(start.isNotNull(), F.when(F.col("o_custkey") % 31 == 0, "other").otherwise("page_range_exclusive"))
    asked = k % 6 != 0
    units = o.join(spans, "o_orderkey", "left")
    expected = units.select("o_custkey", named.alias("unit_id"), k.alias("place"), F.when(asked, F.col("low")).alias("seq_start"), F.when(asked, F.col("high")).alias("seq_end"), start.alias("page_start"), scope.alias("page_scope"))
    renamed = F.when(k % 23 == 0, F.concat(F.lit("custom:"), k.cast("string"))).otherwise(named)
    kept = k % 19 != 0
    actual = o.filter(kept).select("o_custkey", renamed.alias("unit_id"), F.when(k % 17 == 0, -k).otherwise(k).alias("place"), F.when(k % 13 == 0, "new_page").otherwise(start).alias("page_start"), scope.alias("page_scope"))
    places = lines.select("o_custkey", renamed.alias("unit_id"), "seq", F.explode(F.array_repeat(F.lit(1), F.col("times")))).drop("col")
    terms = units.select("o_custkey", named.alias("unit_id"), F.posexplode(F.array(F.when(k % 5 != 0, F.col("title")), F.left("alias", F.lit(5)))).alias("tier", "term"))
    return unit_audit.audit(expected, actual, places, ["o_custkey"], lines.select("o_custkey", "seq", "text"), terms)


QUERIES = {f.__name__: f for f in (unit_findings,)}

SQL = {
    "unit_findings": """
        WITH l AS (SELECT o_custkey, o_orderkey, l_suppkey, p_name AS text, lower(replace(p_name, ' ', '')) AS norm,
            row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq
          FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey),
        s AS (SELECT o_orderkey, min(seq) AS low, max(seq) AS high, arg_min(norm, seq) AS title, lower(replace(left(arg_max(text, seq), 5), ' ', '')) AS alias FROM l GROUP BY ALL),
        e AS (SELECT o.o_custkey, o.o_orderkey AS k, 'u' || o.o_orderkey AS unit_id, CASE o_orderstatus WHEN 'F' THEN 'document_start' WHEN 'O' THEN 'new_page' END AS start, low, high, title, alias FROM orders o LEFT JOIN s ON s.o_orderkey = o.o_orderkey),
        bad AS (SELECT DISTINCT o_custkey FROM e WHERE o_custkey % 31 = 0 AND start IS NOT NULL),
        w AS (SELECT * FROM e WHERE o_custkey NOT IN (SELECT o_custkey FROM bad)),
        a AS (SELECT o_custkey, k, CASE WHEN k % 23 = 0 THEN 'custom:' || k ELSE unit_id END AS unit_id, CASE WHEN k % 17 = 0 THEN -k ELSE k END AS place, CASE WHEN k % 13 = 0 THEN 'new_page' ELSE start END AS start FROM w WHERE k % 19 <> 0),
        lists AS (SELECT o_custkey, (SELECT list(unit_id ORDER BY k) FROM w x WHERE x.o_custkey = d.o_custkey) AS want, (SELECT list(unit_id ORDER BY place, unit_id) FROM a x WHERE x.o_custkey = d.o_custkey) AS got FROM (SELECT DISTINCT o_custkey FROM w) d),
        gone AS (SELECT * FROM w WHERE k % 19 = 0 OR k % 23 = 0),
        owned AS (SELECT o_custkey, seq, o_orderkey AS k, CASE WHEN l_suppkey % 29 = 0 THEN 0 WHEN l_suppkey % 31 = 0 THEN 2 ELSE 1 END AS times FROM l),
        whole AS (SELECT k, bool_and(times = 1) AS ok FROM owned GROUP BY ALL),
        t AS (SELECT o_custkey, k, unit_id, 0 AS tier, title AS term FROM w WHERE k % 5 <> 0 AND title <> '' UNION ALL SELECT o_custkey, k, unit_id, 1, alias FROM w WHERE alias <> ''),
        hits AS (SELECT t.*, l.seq, row_number() OVER (PARTITION BY t.k, tier ORDER BY l.seq) AS n,
            l.o_orderkey = t.k AND t.k % 19 <> 0 AND t.k % 23 <> 0 AND l.l_suppkey % 29 <> 0 AS own
          FROM t JOIN l ON l.o_custkey = t.o_custkey AND (norm = term OR length(term) >= 3 AND starts_with(norm, term))),
        tiers AS (SELECT k, tier, bool_or(own) AS own FROM hits WHERE n <= 3 GROUP BY ALL),
        best AS (SELECT k, arg_min(own, tier) AS own FROM tiers GROUP BY ALL)
        SELECT o_custkey, 'standard_invalid' AS finding, 'UNKNOWN' AS status, NULL AS affected_id FROM bad
        UNION ALL SELECT o_custkey, 'unit_order_mismatch', 'FAIL', NULL FROM lists WHERE want IS DISTINCT FROM got
        UNION ALL SELECT o_custkey, 'unit_missing', 'FAIL', unit_id FROM gone
        UNION ALL SELECT o_custkey, 'custom_unit', 'FAIL', unit_id FROM a WHERE k % 23 = 0
        UNION ALL SELECT o_custkey, 'source_range_mismatch', 'FAIL', unit_id || '.boundary' FROM w WHERE k % 6 <> 0 AND low IS NOT NULL AND (k % 19 = 0 OR k % 23 = 0 OR NOT (SELECT ok FROM whole WHERE whole.k = w.k))
        UNION ALL SELECT o_custkey, 'page_policy_mismatch', 'FAIL', unit_id || '.page_policy' FROM w WHERE start IS NOT NULL AND (k % 19 = 0 OR k % 23 = 0 OR k % 13 = 0 AND start <> 'new_page')
        UNION ALL SELECT o_custkey, 'anchor_owner_mismatch', 'FAIL', unit_id FROM (SELECT DISTINCT o_custkey, k, unit_id FROM t) q LEFT JOIN best USING (k) WHERE NOT coalesce(own, FALSE)""",
}
