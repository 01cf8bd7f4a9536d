"""Queries of gold reports over the driver's tables: order lines as expected ranges of their order, in one sequence and in another."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioscope.operators import gold
from folioscope.sources.tables import table

ALLOWED = ["keep", "fill", "delete"]


def _placed(lines, order):
    """Lines side by side within their order, a place for each piece."""
    w = Window.partitionBy("l_orderkey").orderBy(*order)
    n, end = F.row_number().over(w), F.sum("pieces").over(w)
    return lines.select("*", n.alias("no"), (end - F.col("pieces")).alias("start"), end.alias("end"))


def _projected(spark, sf_dir):
    action = F.when(F.col("l_returnflag") == "R", "delete").when(F.col("l_returnflag") == "A", "fill").otherwise("keep")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_linestatus", F.col("l_quantity").cast("long").alias("pieces"), action.alias("action"))
    lines = lines.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority"), "l_orderkey")
    ties = ["l_partkey", "l_suppkey", "l_extendedprice", "pieces", "action", "l_linestatus"]
    expected = _placed(lines, ["l_linenumber", *ties]).select("l_orderkey", "no", "start", "end", "o_orderpriority", "l_linestatus", F.when(F.col("l_linenumber") == 7, "unknown").otherwise(F.col("action")).alias("expected"))
    # what is claimed: the lines by part; those of part 0 of 9 are left open, those of 1 of 9 say nothing, and status O of line 1 speaks for its whole order
    by_part = _placed(lines, ["l_partkey", "l_linenumber", *ties[1:]])
    spans = by_part.filter("l_partkey % 9 <> 0").select("l_orderkey", (F.col("l_suppkey") % 3).alias("item"), "start", "end", F.when(F.col("l_partkey") % 9 != 1, F.col("action")).alias("action"))
    none = F.lit(None).cast("long")
    wholes = by_part.filter("l_linenumber = 1 AND l_linestatus = 'O'").select("l_orderkey", (F.col("l_suppkey") % 3).alias("item"), none.alias("start"), none.alias("end"), "action")
    return gold.projected(expected, spans.unionByName(wholes), ["l_orderkey"], ["no"])


def gold_projection(spark, sf_dir):
    """What the claims say of every line's places."""
    rows = gold.outcomes(_projected(spark, sf_dir), ALLOWED)
    return rows.select("l_orderkey", "no", F.array_join("actions", ",").alias("actions"), "complete", "known", "predicted", "correct", "false_delete")


def gold_report(spark, sf_dir):
    """Scores by action, by line status and over all, of every order priority."""
    return gold.report(gold.outcomes(_projected(spark, sf_dir), ALLOWED), ["o_orderpriority"], "l_linestatus", ALLOWED)


QUERIES = {f.__name__: f for f in (gold_projection, gold_report)}

# every place of a line is asked by itself: whose ranges hold it, and what do they say
_ASKED = """x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_linestatus, CAST(l_quantity AS BIGINT) AS pieces, o_orderpriority,
    CASE l_returnflag WHEN 'R' THEN 'delete' WHEN 'A' THEN 'fill' ELSE 'keep' END AS action FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
  g AS (SELECT *, row_number() OVER w AS no, sum(pieces) OVER w - pieces AS s, sum(pieces) OVER w AS e, CASE WHEN l_linenumber = 7 THEN 'unknown' ELSE action END AS expected FROM x
    WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, pieces, action, l_linestatus ROWS UNBOUNDED PRECEDING)),
  p AS (SELECT *, l_suppkey % 3 AS item, sum(pieces) OVER w - pieces AS cs, sum(pieces) OVER w AS ce FROM x
    WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber, l_suppkey, l_extendedprice, pieces, action, l_linestatus ROWS UNBOUNDED PRECEDING)),
  cl AS (SELECT l_orderkey, item, cs, ce, CASE WHEN l_partkey % 9 <> 1 THEN action END AS a FROM p WHERE l_partkey % 9 <> 0),
  wh AS (SELECT DISTINCT l_orderkey, item, action AS a FROM p WHERE l_linenumber = 1 AND l_linestatus = 'O'),
  cell AS (SELECT l_orderkey, no, unnest(range(CAST(s AS BIGINT), CAST(e AS BIGINT))) AS k FROM g),
  hit AS (SELECT cell.l_orderkey, no, k, item, a FROM cell JOIN cl ON cl.l_orderkey = cell.l_orderkey AND k >= cs AND k < ce),
  own AS (SELECT l_orderkey, no, item, count(DISTINCT k) AS n FROM hit GROUP BY ALL),
  wa AS (SELECT g.l_orderkey, g.no, wh.a FROM g JOIN wh USING (l_orderkey) LEFT JOIN own ON own.l_orderkey = g.l_orderkey AND own.no = g.no AND own.item = wh.item WHERE coalesce(n, 0) < g.e - g.s),
  an AS (SELECT DISTINCT l_orderkey FROM wh),
  say AS (SELECT l_orderkey, no, a FROM hit WHERE a IS NOT NULL UNION SELECT * FROM wa),
  acts AS (SELECT l_orderkey, no, string_agg(a, ',' ORDER BY a) AS actions, count(*) AS n_actions, min(a) AS one, bool_or(a = 'delete') AS deletes FROM say GROUP BY ALL),
  reach AS (SELECT l_orderkey, no, count(DISTINCT k) AS n_known, count(DISTINCT CASE WHEN a IS NOT NULL THEN k END) AS n_said FROM hit GROUP BY ALL),
  j AS (SELECT g.*, coalesce(actions, '') AS actions, coalesce(n_actions, 0) AS n_actions, one, coalesce(deletes, FALSE) AS deletes,
      coalesce(n_said, 0) = e - s OR EXISTS (SELECT 1 FROM wa WHERE wa.l_orderkey = g.l_orderkey AND wa.no = g.no) AS complete,
      coalesce(n_known, 0) = e - s OR g.l_orderkey IN (SELECT l_orderkey FROM an) AS known
    FROM g LEFT JOIN acts ON acts.l_orderkey = g.l_orderkey AND acts.no = g.no LEFT JOIN reach ON reach.l_orderkey = g.l_orderkey AND reach.no = g.no),
  o AS (SELECT *, expected <> 'unknown' AS scored, CASE WHEN expected <> 'unknown' AND complete AND n_actions = 1 THEN one END AS predicted FROM j),
  r AS (SELECT *, coalesce(scored AND predicted = expected, FALSE) AS correct, deletes AND expected <> 'delete' AS false_delete, deletes AND expected = 'delete' AS true_delete FROM o)"""

_COUNTS = """sum(CAST(scored AS INT)) AS n_expected, count(predicted) AS n_predicted, sum(CAST(correct AS INT)) AS n_correct, sum(CAST(scored AND known AS INT)) AS n_covered,
    sum(CAST(scored AND n_actions > 1 AS INT)) AS n_conflicted, sum(CAST(NOT scored AS INT)) AS n_unscored, sum(CAST(true_delete AS INT)) AS n_true_delete, sum(CAST(false_delete AS INT)) AS n_false_delete,
    sum(CAST(expected = 'delete' AS INT)) AS n_wanted"""

SQL = {
    "gold_projection": f"WITH {_ASKED} SELECT l_orderkey, CAST(no AS INTEGER) AS no, actions, complete, known, predicted, correct, false_delete FROM r",
    "gold_report": f"""WITH {_ASKED},
        al AS (SELECT o_orderpriority, expected AS name, {_COUNTS} FROM r WHERE scored GROUP BY ALL),
        pr AS (SELECT o_orderpriority, predicted AS name, count(*) AS n_p FROM r WHERE predicted IS NOT NULL GROUP BY ALL),
        act AS (SELECT al.* REPLACE (coalesce(n_p, 0) AS n_predicted) FROM al LEFT JOIN pr USING (o_orderpriority, name)),
        u AS (SELECT 'action' AS level, * FROM act
          UNION ALL SELECT 'unit', o_orderpriority, l_linestatus, {_COUNTS} FROM r GROUP BY ALL
          UNION ALL SELECT 'all', o_orderpriority, NULL, {_COUNTS} FROM r GROUP BY ALL),
        f AS (SELECT *, CASE WHEN n_correct = 0 THEN 0.0::DOUBLE ELSE 2 * (n_correct::DOUBLE / n_predicted) * (n_correct::DOUBLE / n_expected) / (n_correct::DOUBLE / n_predicted + n_correct::DOUBLE / n_expected) END AS f FROM u),
        m AS (SELECT o_orderpriority, round(sum(f) / 3, 4) AS m FROM f WHERE level = 'action' GROUP BY ALL)
        SELECT o_orderpriority, level, name, CAST(n_expected AS BIGINT) AS n_expected, CAST(n_predicted AS BIGINT) AS n_predicted, CAST(n_correct AS BIGINT) AS n_correct, CAST(n_covered AS BIGINT) AS n_covered,
          CAST(n_conflicted AS BIGINT) AS n_conflicted, CASE WHEN n_predicted = 0 THEN 0.0::DOUBLE ELSE round(n_correct::DOUBLE / n_predicted, 4) END AS precision,
          CASE WHEN n_expected = 0 THEN 0.0::DOUBLE ELSE round(n_correct::DOUBLE / n_expected, 4) END AS recall, round(f, 4) AS f1, CASE WHEN n_expected = 0 THEN 0.0::DOUBLE ELSE round(n_correct::DOUBLE / n_expected, 4) END AS accuracy,
          CASE WHEN level = 'all' THEN m END AS macro_f1, CAST(n_unscored AS BIGINT) AS n_unscored, CAST(n_true_delete AS BIGINT) AS n_true_delete, CAST(n_false_delete AS BIGINT) AS n_false_delete,
          CAST(n_wanted - n_true_delete AS BIGINT) AS n_missed_delete, CASE WHEN n_false_delete = 0 THEN 'PASS' ELSE 'FAIL' END AS gate
        FROM f JOIN m USING (o_orderpriority)""",
}
