"""Queries of matching, ledger, verdict, scoring and tree operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioscope.operators import comparators, hierarchy, ledger, matching, scoring, status
from folioscope.sources.tables import table


def last_order_lookup(spark, sf_dir):
    """Customers with their last order: the last row of a key wins."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderdate", "o_orderkey", "o_orderstatus")
    return matching.lookup(table(spark, sf_dir, "customer").select("c_custkey"), orders, ["c_custkey"], ["o_orderdate", "o_orderkey"]).select("c_custkey", "o_orderkey", "o_orderstatus")


def first_order_lookup(spark, sf_dir):
    """Customers with their first order: the first row of a key wins."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderdate", "o_orderkey", "o_orderstatus")
    return matching.lookup(table(spark, sf_dir, "customer").select("c_custkey"), orders, ["c_custkey"], ["o_orderdate", "o_orderkey"], last=False).select("c_custkey", "o_orderkey", "o_orderstatus")


def ranked_supplier(spark, sf_dir):
    """Lines' suppliers tried by key, then by nation number, the lowest key first."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min((F.col("l_suppkey") * 3)).alias("k"), F.min((F.col("l_partkey") % 40).cast("int")).alias("n"))
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    out = matching.ranked_match(lines, ["l_orderkey"], [(sup, ["k"], ["s_suppkey"]), (sup, ["n"], ["s_nationkey"])], ["s_suppkey"])
    return out.select("l_orderkey", "rank", "m_s_suppkey")


def prefix_binding(spark, sf_dir):
    """Parts' names bound to the part of one brand whose name equals, begins or continues them, the lowest key first."""
    part = table(spark, sf_dir, "part")
    left = part.select("p_brand", F.col("p_partkey").alias("key"), F.concat(F.col("p_name"), F.when(F.col("p_partkey") % 2 == 0, "/run").otherwise("")).alias("ref"))
    right = part.select("p_brand", F.col("p_partkey").alias("other"), F.col("p_name").alias("name"))
    return matching.prefix_match(left, right, ["p_brand"], "ref", "name", ["key"], ["other"], 4).select("key", "other", "exact")


def needle_documents(spark, sf_dir):
    """The first three documents that hold the whole of each benchmark item."""
    needles = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("needle"))
    return matching.contains_match(table(spark, sf_dir, "documents").select("doc_id", "text"), needles, "text", "needle", ["item_id"], ["doc_id"], 3).select("item_id", "doc_id", "match_no")


def spread_tokens(spark, sf_dir):
    """Items of which two or more of all words stand in the documents of a source, over which places."""
    words = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(F.split("text", " "))).alias("token"))
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.explode(F.array_distinct(F.split("text", " "))).alias("token"))
    return matching.tokens_spread(words, docs, ["item_id"], ["source"], "token", "doc_id", 2, close=True)


def best_event(spark, sf_dir):
    """The best-scored event of each user, the earliest among equals."""
    score = F.when(F.col("event_type") == "purchase", 70).when(F.col("event_type") == "signup", 120).otherwise(0) + F.when(F.col("value") > 50, 20).otherwise(0)
    return matching.best_scored(table(spark, sf_dir, "events"), ["user_id"], score, ["ts", "event_id"]).select("user_id", "event_id", "score")


def shared_parts(spark, sf_dir):
    """All pairs of orders of a customer that share suppliers."""
    sup = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("s"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(sup, F.col("o_orderkey") == F.col("l_orderkey"))
    a, b = (orders.select("o_custkey", F.col("o_orderkey").alias(k), F.col("s").alias("s" + k)) for k in "ab")
    return matching.array_overlap_match(a, b, ["o_custkey"], "sa", "sb", ["a", "b"]).filter("a < b")


def label_ledger(spark, sf_dir):
    """Documents as leaves claimed by labels of one, two or no rows."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id")
    lab = table(spark, sf_dir, "labels").join(docs, "doc_id").select("source", "doc_id", "quality")
    twice = lab.unionByName(lab.filter("doc_id % 7 = 0")).unionByName(lab.filter("doc_id % 50 = 0").withColumn("doc_id", -F.col("doc_id") - 1))
    return ledger.claims(docs, twice, ["source"], "doc_id")


def label_coverage(spark, sf_dir):
    """Counts of the same ledger by source."""
    return ledger.coverage(label_ledger(spark, sf_dir), ["source"])


def part_paths(spark, sf_dir):
    """Part types as dotted paths, consumed by the first words of some."""
    part = table(spark, sf_dir, "part").select("p_brand", F.regexp_replace("p_type", " ", ".").alias("path"))
    used = table(spark, sf_dir, "part").filter("p_partkey % 5 = 0").select("p_brand", F.regexp_extract("p_type", "^(\\S+)", 1).alias("path"))
    return ledger.path_ledger(part, used, ["p_brand"])


def nations_apart(spark, sf_dir):
    """Nations with customers or suppliers alone."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n"))
    return ledger.symmetric_difference(c, table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n")), ["n"])


def repeated_lines(spark, sf_dir):
    """Line keys that stand more than once."""
    return ledger.duplicate_ids(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


def repeats_in_order(spark, sf_dir):
    """Suppliers that an order repeats, ranked by their first repeat."""
    lines = table(spark, sf_dir, "lineitem").withColumn("s", F.col("l_suppkey") % 5)
    return ledger.duplicates_in_order(lines, ["l_orderkey"], "s", ["l_linenumber", "l_partkey", "l_suppkey"])


def ownership_difference(spark, sf_dir):
    """What line numbers 1..n an order lacks, has besides or repeats."""
    per = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("actual"))
    per = per.withColumn("expected", F.sequence(F.lit(1), F.size("actual")))
    out = ledger.array_difference(per, "expected", "actual")
    return out.select("l_orderkey", *[F.array_join(c, ",").alias(c) for c in ("missing", "unexpected", "repeated")])


def contested_places(spark, sf_dir):
    """The type that owns each minute of a user, by the highest value; equal values contest it."""
    ev = table(spark, sf_dir, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type", F.floor(F.col("value") / 20).alias("rank"))
    return ledger.resolve_overlaps(ev, ["user_id"], "day", "event_type", "rank")


def agreed_claims(spark, sf_dir):
    """The status on which all orders of a customer and priority agree."""
    return ledger.consistent_claims(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority"], "o_orderstatus")


def _checks(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    verdict = F.when(F.col("o_orderstatus") == "F", "PASS").when(F.col("o_orderstatus") == "O", "UNKNOWN").otherwise("FAIL")
    return o.select("o_custkey", "o_orderkey", "o_orderpriority", verdict.alias("status"), (F.col("o_orderpriority") < "3").alias("blocking"))


def customer_verdicts(spark, sf_dir):
    """Verdicts of customers over all their orders."""
    both = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey")).join(_checks(spark, sf_dir), "o_custkey", "left")
    return both.groupBy("o_custkey").agg(status.merged("status", where=F.col("status").isNotNull()).alias("verdict"))


def check_summary(spark, sf_dir):
    """Counts of checks by customer with display, known and gate verdicts."""
    return status.check_summary(_checks(spark, sf_dir), ["o_custkey"])


def finding_clusters(spark, sf_dir):
    """Orders of a customer that did not pass, together by status and priority."""
    bad = _checks(spark, sf_dir).filter("status <> 'PASS'").withColumn("ids", F.array((F.col("o_orderkey") % 100).cast("string")))
    out = status.clusters(bad, ["o_custkey"], ["status", "o_orderpriority"], "o_orderkey", F.concat(F.lit("order "), F.col("o_orderkey")), "ids")
    return out.withColumn("affected", F.array_join("affected", ","))


def report_counters(spark, sf_dir):
    """Blocking and unknown orders of a customer and the first blocking priority."""
    x = _checks(spark, sf_dir).withColumn("severity", F.when(F.col("blocking") & (F.col("status") != "PASS"), "blocking").otherwise("minor"))
    return status.report_counters(x, ["o_custkey"], "severity", "status", "o_orderpriority", "o_orderkey")


def stage_cascade(spark, sf_dir):
    """The first priority of each customer whose orders did not all pass."""
    stages = _checks(spark, sf_dir).groupBy("o_custkey", "o_orderpriority").agg(status.merged("status").alias("status"))
    return status.first_bad_stage(stages, ["o_custkey"], "o_orderpriority", "o_orderpriority")


def availability(spark, sf_dir):
    """Whether all orders of a customer are finished, and which are not."""
    o = _checks(spark, sf_dir).withColumn("ok", F.col("status") == "PASS").withColumn("why", F.concat_ws("=", F.col("o_orderkey").cast("string"), "status"))
    return status.conservative(o, ["o_custkey"], "ok", "why", "o_orderkey")


def owner_histogram(spark, sf_dir):
    """Events by owner of their type, zero for owners without any."""
    ev = status.routed(table(spark, sf_dir, "events"), "event_type", [("click", "web"), ("view", "web"), ("purchase", "shop"), ("refund", "shop")], "other")
    owners = spark.createDataFrame([("web",), ("shop",), ("other",), ("nobody",)], "owner string")
    return status.zero_filled(ev.groupBy("owner").agg(F.count(F.lit(1)).alias("n")), owners, ["owner"])


def _predicted(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    guess = F.when(F.contains("text", F.lit(" the ")), "en").when(F.contains("text", F.lit(" der ")), "de").when(F.contains("text", F.lit(" la ")), "fr")
    return docs.select("doc_id", "source", "lang", guess.alias("guess"))


def set_scores(spark, sf_dir):
    """Precision, recall and F1 by source of the set of documents guessed English."""
    x = _predicted(spark, sf_dir)
    return scoring.set_scores(x.filter("lang = 'en'"), x.filter("guess = 'en'"), ["source"], ["doc_id"])


def language_scores(spark, sf_dir):
    """Scores of every guessed language."""
    return scoring.label_scores(_predicted(spark, sf_dir), ["source"], "lang", "guess")


def macro_scores(spark, sf_dir):
    """Mean F1 and accuracy by source."""
    return scoring.macro(language_scores(spark, sf_dir), ["source"])


def exact_orders(spark, sf_dir):
    """Share of orders whose status and line count are as on the list of finished ones."""
    o = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_orderstatus", F.lit(4).cast("long").alias("n"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    actual = o.drop("n").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 6 == 0, "F").otherwise(F.col("o_orderstatus"))).join(lines, "o_orderkey")
    return scoring.exact_accuracy(o, actual, ["o_orderpriority"], ["o_orderkey"], ["o_orderstatus", "n"])


def dominant_type(spark, sf_dir):
    """The most frequent event type of each user, the first met among equals."""
    return scoring.dominant(table(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id")


def action_outcomes(spark, sf_dir):
    """Outcomes of documents' expected languages against the guesses of their parts."""
    x = _predicted(spark, sf_dir)
    parts = x.unionByName(x.filter("doc_id % 5 = 0").withColumn("guess", F.lit("es")))
    return scoring.action_outcomes(parts, ["source"], ["doc_id"], "lang", "guess")


def _tree(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size", "p_retailprice")
    n = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    x = part.withColumn("node", n.cast("long"))
    return x.select("p_brand", "node", F.when(F.col("node") > 1, F.floor(F.col("node") / 2)).alias("parent"), F.when(F.col("p_size") % 3 == 0, F.col("p_size")).alias("size"), F.col("p_size").cast("long").alias("own"), (F.col("p_size") > 2).alias("whole"))


def inherited_size(spark, sf_dir):
    """Sizes of parts in a binary tree by brand, those missing taken from the nearest ancestor."""
    return hierarchy.resolve_inherited(_tree(spark, sf_dir), ["p_brand"], ["size"])


def rolled_up(spark, sf_dir):
    """Sums and completeness of the same tree over descendants."""
    return hierarchy.roll_up(_tree(spark, sf_dir), ["p_brand"], ["own"], ["whole"])


def leaf_counts(spark, sf_dir):
    """Leaves under every node of the same tree."""
    return hierarchy.leaf_sets(_tree(spark, sf_dir), ["p_brand"]).select("p_brand", "node", "n_leaves", "first_leaf")


def settled_leaves(spark, sf_dir):
    """Results of a walk down the whole tree, however deep, by decisions at some nodes."""
    t = _tree(spark, sf_dir)
    d = t.filter("node % 5 <> 0").select("p_brand", "node", F.when(F.col("own") % 2 == 0, "fill").otherwise("delete").alias("result"), (F.col("own") % 7 != 0).alias("descend"))
    return hierarchy.sparse_decisions(t, d, ["p_brand"], most_depth=None)


def tree_faults(spark, sf_dir):
    """Faults of the whole tree after some edges at any depth are bent into a ring, cut or doubled."""
    t = _tree(spark, sf_dir).select("p_brand", "node", "parent")
    bent = F.when(F.col("node") % 40 == 2, F.col("node") * 4 + 1).when(F.col("node") % 40 == 5, F.lit(-1)).otherwise(F.col("parent"))
    return hierarchy.tree_errors(t.withColumn("parent", bent).unionByName(t.filter("node % 40 = 7").withColumn("parent", F.lit(1).cast("long"))), ["p_brand"])


def compared_contracts(spark, sf_dir):
    """Orders' figures compared with what their lines say, by mode."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("total"), F.count(F.lit(1)).alias("n"))
    o = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    mode = F.element_at(F.array(*[F.lit(m) for m in ("exact", "numeric_tolerance", "normalized_text", "oracle_required", "other")]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    text = F.concat(F.lit('"'), F.col("o_orderstatus"), F.lit('  x "'))
    expected = F.when(mode == "exact", F.lit("4")).when(mode == "numeric_tolerance", F.col("o_totalprice").cast("string")).when(mode == "normalized_text", text).otherwise("true")
    actual = F.when(mode == "exact", F.col("n").cast("string")).when(mode == "numeric_tolerance", F.col("total").cast("string")).when(mode == "normalized_text", F.lit('"F x"'))
    actual = actual.otherwise(F.when(F.col("n") > 3, "true").when(F.col("n") > 1, "false").otherwise('"maybe"'))
    dims = o.select("o_orderkey", mode.alias("comparator_mode"), expected.alias("expected"), actual.alias("actual"), (F.col("o_orderkey") % 11 != 0).alias("required"),
                    F.lit(None).cast("double").alias("tolerance"), F.lit(None).cast("double").alias("tolerance_abs"), F.lit(30.0).alias("tolerance_percent"))
    return comparators.compared(dims).select("o_orderkey", "comparator_mode", "finding", "status")


QUERIES = {f.__name__: f for f in (
    last_order_lookup, first_order_lookup, ranked_supplier, prefix_binding, needle_documents, spread_tokens, best_event, shared_parts, label_ledger, label_coverage, part_paths,
    nations_apart, repeated_lines, repeats_in_order, ownership_difference, contested_places, agreed_claims, customer_verdicts, check_summary, finding_clusters, report_counters,
    stage_cascade, availability, owner_histogram, set_scores, language_scores, macro_scores, exact_orders, dominant_type, action_outcomes, inherited_size, rolled_up, leaf_counts,
    settled_leaves, tree_faults, compared_contracts,
)}

_CHECKS = """c AS (SELECT o_custkey, o_orderkey, o_orderpriority, o_orderpriority < '3' AS blocking,
    CASE o_orderstatus WHEN 'F' THEN 'PASS' WHEN 'O' THEN 'UNKNOWN' ELSE 'FAIL' END AS status FROM orders)"""
_MERGED = "CASE WHEN count(*) FILTER ({w}) = 0 THEN '{e}' WHEN count(*) FILTER (({w}) AND status = 'FAIL') > 0 THEN 'FAIL' WHEN count(*) FILTER (({w}) AND status = 'UNKNOWN') > 0 THEN 'UNKNOWN' ELSE 'PASS' END"
_CLAIMS = """l AS (SELECT d.source, d.doc_id FROM labels JOIN documents d USING (doc_id)),
  x AS (SELECT * FROM l UNION ALL SELECT * FROM l WHERE doc_id % 7 = 0 UNION ALL SELECT source, -doc_id - 1 FROM l WHERE doc_id % 50 = 0),
  n AS (SELECT source, doc_id, count(*) AS n_claims FROM x GROUP BY ALL),
  cl AS (SELECT coalesce(d.source, n.source) AS source, coalesce(d.doc_id, n.doc_id) AS doc_id, coalesce(n_claims, 0) AS n_claims,
           CASE WHEN d.doc_id IS NULL THEN 'unexpected' WHEN n_claims IS NULL THEN 'unclaimed' WHEN n_claims = 1 THEN 'owned' ELSE 'contested' END AS state
    FROM documents d FULL JOIN n ON d.source = n.source AND d.doc_id = n.doc_id)"""
_GUESS = """g AS (SELECT doc_id, source, lang, CASE WHEN contains(text, ' the ') THEN 'en' WHEN contains(text, ' der ') THEN 'de' WHEN contains(text, ' la ') THEN 'fr' END AS guess FROM documents)"""
_LABELS = f"""{_GUESS},
  u AS (SELECT source, lang AS label, 1 AS e, 0 AS a, CASE WHEN lang = guess THEN 1 ELSE 0 END AS hit FROM g UNION ALL SELECT source, guess, 0, 1, 0 FROM g),
  s AS (SELECT source, label, CAST(sum(e) AS BIGINT) AS n_expected, CAST(sum(a) AS BIGINT) AS n_actual, CAST(sum(hit) AS BIGINT) AS n_hit FROM u WHERE label IS NOT NULL GROUP BY ALL),
  pr AS (SELECT *, CASE WHEN n_actual = 0 THEN 0.0::DOUBLE ELSE n_hit::DOUBLE / n_actual END AS p, CASE WHEN n_expected = 0 THEN 0.0::DOUBLE ELSE n_hit::DOUBLE / n_expected END AS r FROM s),
  sc AS (SELECT source, label, n_expected, n_actual, n_hit, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r = 0 THEN 0.0::DOUBLE ELSE 2 * p * r / (p + r) END, 4) AS f1 FROM pr)"""
_TREE = """x AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS node FROM part),
  t AS (SELECT p_brand, node, CASE WHEN node > 1 THEN node // 2 END AS parent, CASE WHEN p_size % 3 = 0 THEN p_size END AS size, CAST(p_size AS BIGINT) AS own, p_size > 2 AS whole FROM x),
  a AS (SELECT p_brand, node, node AS ancestor, 0 AS distance FROM t
        UNION ALL SELECT a.p_brand, a.node, t.parent, a.distance + 1 FROM a JOIN t ON t.p_brand = a.p_brand AND t.node = a.ancestor WHERE t.parent IS NOT NULL)"""

SQL = {
    "last_order_lookup": "SELECT c_custkey, o_orderkey, o_orderstatus FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) o ON o_custkey = c_custkey AND n = 1",
    "first_order_lookup": "SELECT c_custkey, o_orderkey, o_orderstatus FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) o ON o_custkey = c_custkey AND n = 1",
    "ranked_supplier": """
        WITH l AS (SELECT l_orderkey, min(l_suppkey * 3) AS k, min(l_partkey % 40) AS n FROM lineitem GROUP BY l_orderkey),
        m AS (SELECT l_orderkey, 1 AS rank, s_suppkey FROM l JOIN supplier ON s_suppkey = k UNION ALL SELECT l_orderkey, 2, s_suppkey FROM l JOIN supplier ON s_nationkey = n),
        b AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY rank, s_suppkey) AS w FROM m)
        SELECT l.l_orderkey, rank, s_suppkey AS m_s_suppkey FROM l LEFT JOIN b ON b.l_orderkey = l.l_orderkey AND w = 1""",
    "prefix_binding": """
        WITH l AS (SELECT p_brand, p_partkey AS key, p_name || CASE WHEN p_partkey % 2 = 0 THEN '/run' ELSE '' END AS ref FROM part),
        p AS (SELECT key, r.p_partkey AS other, ref = p_name AS exact FROM l JOIN part r ON l.p_brand = r.p_brand AND (starts_with(ref, p_name) OR starts_with(p_name, ref)))
        SELECT key, other, exact FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY exact DESC, other) AS w FROM p) WHERE w = 1""",
    "needle_documents": """
        WITH n AS (SELECT item_id, text AS needle FROM benchmark WHERE length(text) > 0)
        SELECT item_id, doc_id, CAST(w AS INTEGER) AS match_no FROM (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS w FROM n JOIN documents d ON contains(d.text, needle)) WHERE w <= 3""",
    "spread_tokens": """
        WITH n AS (SELECT DISTINCT item_id, unnest(string_split(text, ' ')) AS token FROM benchmark), d AS (SELECT DISTINCT source, doc_id, unnest(string_split(text, ' ')) AS token FROM documents)
        SELECT item_id, source, count(DISTINCT token) AS n_tokens, count(DISTINCT doc_id) AS n_places, min(doc_id) AS first_place FROM n JOIN d USING (token) GROUP BY item_id, source HAVING count(DISTINCT token) >= 2""",
    "best_event": """
        WITH s AS (SELECT *, CASE event_type WHEN 'purchase' THEN 70 WHEN 'signup' THEN 120 ELSE 0 END + CASE WHEN value > 50 THEN 20 ELSE 0 END AS score FROM events)
        SELECT user_id, event_id, score FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, ts, event_id) AS w FROM s WHERE score > 0) WHERE w = 1""",
    "shared_parts": """
        WITH s AS (SELECT DISTINCT l_orderkey, l_suppkey AS v FROM lineitem), o AS (SELECT o_orderkey, o_custkey, v FROM orders JOIN s ON l_orderkey = o_orderkey)
        SELECT a.o_custkey, a.o_orderkey AS a, b.o_orderkey AS b, count(*) AS n_shared FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND a.v = b.v AND a.o_orderkey < b.o_orderkey GROUP BY ALL""",
    "label_ledger": f"WITH {_CLAIMS} SELECT * FROM cl",
    "label_coverage": f"""WITH {_CLAIMS}, k AS (SELECT source, count(*) FILTER (state = 'owned') AS owned, count(*) FILTER (state IN ('unclaimed', 'contested')) AS unknown, count(*) FILTER (state = 'unexpected') AS unexpected, count(*) FILTER (state <> 'unexpected') AS total FROM cl GROUP BY source)
        SELECT *, owned = total AND unexpected = 0 AS complete FROM k""",
    "part_paths": """
        WITH u AS (SELECT DISTINCT p_brand, string_split(p_type, ' ')[1] AS used FROM part WHERE p_partkey % 5 = 0), d AS (SELECT DISTINCT p_brand, replace(p_type, ' ', '.') AS path FROM part)
        SELECT d.p_brand, path, count(used) > 0 AS consumed FROM d LEFT JOIN u ON d.p_brand = u.p_brand AND (path = used OR starts_with(path, used || '.')) GROUP BY d.p_brand, path""",
    "nations_apart": """
        WITH c AS (SELECT DISTINCT c_nationkey AS n FROM customer), s AS (SELECT DISTINCT s_nationkey AS n FROM supplier)
        SELECT n, 'missing' AS side FROM c WHERE n NOT IN (SELECT n FROM s) UNION ALL SELECT n, 'unexpected' FROM s WHERE n NOT IN (SELECT n FROM c)""",
    "repeated_lines": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "repeats_in_order": """
        WITH r AS (SELECT *, l_suppkey % 5 AS s, row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 5 ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem)
        SELECT l_orderkey, s, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INTEGER) AS rank FROM r WHERE n = 2""",
    "ownership_difference": """
        WITH a AS (SELECT l_orderkey, l_linenumber AS x, count(*) AS n FROM lineitem GROUP BY ALL), t AS (SELECT l_orderkey, CAST(sum(n) AS BIGINT) AS n FROM a GROUP BY ALL),
        e AS (SELECT l_orderkey, unnest(range(1, n + 1)) AS x FROM t),
        b AS (SELECT coalesce(e.l_orderkey, a.l_orderkey) AS l_orderkey, coalesce(e.x, a.x) AS x, e.x IS NULL AS extra, a.x IS NULL AS lacks, coalesce(a.n, 0) > 1 AS twice
              FROM e FULL JOIN (SELECT * FROM a WHERE l_orderkey IN (SELECT l_orderkey FROM t)) a ON a.l_orderkey = e.l_orderkey AND a.x = e.x)
        SELECT l_orderkey, coalesce(string_agg(CAST(x AS VARCHAR), ',' ORDER BY x) FILTER (lacks), '') AS missing, coalesce(string_agg(CAST(x AS VARCHAR), ',' ORDER BY x) FILTER (extra), '') AS unexpected,
               coalesce(string_agg(CAST(x AS VARCHAR), ',' ORDER BY x) FILTER (twice), '') AS repeated FROM b GROUP BY l_orderkey""",
    "contested_places": """
        WITH x AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_type, floor(value / 20) AS rank FROM events), m AS (SELECT *, max(rank) OVER (PARTITION BY user_id, day) AS top FROM x)
        SELECT user_id, day, CASE WHEN count(DISTINCT event_type) = 1 THEN min(event_type) END AS owner, count(DISTINCT event_type) > 1 AS contested FROM m WHERE rank = top GROUP BY user_id, day""",
    "agreed_claims": "SELECT o_custkey, o_orderpriority, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN min(o_orderstatus) END AS signature, count(DISTINCT o_orderstatus) > 1 AS conflict FROM orders GROUP BY ALL",
    "customer_verdicts": f"WITH {_CHECKS} SELECT c_custkey AS o_custkey, {_MERGED.format(w='status IS NOT NULL', e='UNKNOWN')} AS verdict FROM customer LEFT JOIN c ON o_custkey = c_custkey GROUP BY c_custkey",
    "check_summary": f"""WITH {_CHECKS} SELECT o_custkey, count(*) FILTER (status = 'PASS') AS n_pass, count(*) FILTER (status = 'FAIL') AS n_fail, count(*) FILTER (status = 'UNKNOWN') AS n_unknown,
        {_MERGED.format(w='true', e='UNKNOWN')} AS display, {_MERGED.format(w="status <> 'UNKNOWN'", e='UNKNOWN')} AS known, {_MERGED.format(w='blocking', e='PASS')} AS gate FROM c GROUP BY o_custkey""",
    "settled_leaves": """
        WITH RECURSIVE p AS (SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS node, p_size AS own FROM part),
        t AS (SELECT *, node % 5 <> 0 AS told, CASE WHEN node % 5 = 0 THEN 'keep' WHEN own % 2 = 0 THEN 'fill' ELSE 'delete' END AS result, node % 5 <> 0 AND own % 7 <> 0 AS descend,
                     node * 2 > max(node) OVER (PARTITION BY p_brand) AS leaf FROM p),
        w AS (SELECT p_brand, node, leaf, descend, CASE WHEN NOT descend OR leaf THEN node END AS spot, CASE WHEN NOT descend OR leaf THEN result END AS result FROM t WHERE node = 1
              UNION ALL SELECT t.p_brand, t.node, t.leaf, t.descend, coalesce(w.spot, CASE WHEN NOT t.descend OR t.leaf THEN t.node END), coalesce(w.result, CASE WHEN NOT t.descend OR t.leaf THEN t.result END)
              FROM w JOIN t ON t.p_brand = w.p_brand AND t.node // 2 = w.node AND t.node > 1)
        SELECT p_brand, node AS leaf, spot AS settled_at, result FROM w WHERE leaf""",
    "finding_clusters": f"""WITH {_CHECKS}, k AS (SELECT o_custkey, status, o_orderpriority, count(*) AS n_findings, min(o_orderkey) AS first_at, 'order ' || min(o_orderkey) AS title,
        (SELECT string_agg(i, ',' ORDER BY i) FROM (SELECT DISTINCT unnest(list(CAST(o_orderkey % 100 AS VARCHAR))) AS i)) AS affected, count(DISTINCT o_orderkey % 100) AS n_affected FROM c WHERE status <> 'PASS' GROUP BY ALL)
        SELECT *, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY first_at) AS INTEGER) AS cluster_no FROM k""",
    "report_counters": f"""WITH {_CHECKS}, x AS (SELECT *, blocking AND status <> 'PASS' AS hard FROM c)
        SELECT o_custkey, count(*) FILTER (hard) AS n_blocking, count(*) FILTER (status = 'UNKNOWN') AS n_unknown, min_by(o_orderpriority, o_orderkey) FILTER (hard) AS first_bucket, {_MERGED.format(w='hard', e='PASS')} AS status FROM x GROUP BY o_custkey""",
    "stage_cascade": f"""WITH {_CHECKS}, s AS (SELECT o_custkey, o_orderpriority, {_MERGED.format(w='true', e='UNKNOWN')} AS status FROM c GROUP BY ALL)
        SELECT o_custkey, min(o_orderpriority) FILTER (status <> 'PASS') AS first_bad, {_MERGED.format(w='true', e='UNKNOWN')} AS status FROM s GROUP BY o_custkey""",
    "availability": f"""WITH {_CHECKS} SELECT o_custkey, bool_and(status = 'PASS') AS available, coalesce(string_agg(o_orderkey || '=' || status, '; ' ORDER BY o_orderkey) FILTER (status <> 'PASS'), '') AS reasons FROM c GROUP BY o_custkey""",
    "owner_histogram": """
        WITH o AS (SELECT CASE WHEN event_type IN ('click', 'view') THEN 'web' WHEN event_type IN ('purchase', 'refund') THEN 'shop' ELSE 'other' END AS owner FROM events)
        SELECT b.owner, count(o.owner) AS n FROM (VALUES ('web'), ('shop'), ('other'), ('nobody')) b(owner) LEFT JOIN o ON o.owner = b.owner GROUP BY b.owner""",
    "set_scores": f"""WITH {_GUESS}, s AS (SELECT source, count(*) FILTER (lang = 'en') AS n_expected, count(*) FILTER (guess = 'en') AS n_actual, count(*) FILTER (lang = 'en' AND guess = 'en') AS n_hit FROM g WHERE lang = 'en' OR guess = 'en' GROUP BY source),
        pr AS (SELECT *, CASE WHEN n_actual = 0 THEN 0.0::DOUBLE ELSE n_hit::DOUBLE / n_actual END AS p, CASE WHEN n_expected = 0 THEN 0.0::DOUBLE ELSE n_hit::DOUBLE / n_expected END AS r FROM s)
        SELECT source, n_expected, n_actual, n_hit, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r = 0 THEN 0.0::DOUBLE ELSE 2 * p * r / (p + r) END, 4) AS f1 FROM pr""",
    "language_scores": f"WITH {_LABELS} SELECT * FROM sc",
    "macro_scores": f"WITH {_LABELS} SELECT source, floor(sum(CAST(round(f1 * 10000) AS BIGINT))::DOUBLE / count(f1)::DOUBLE + 0.5) / 10000 AS macro_f1, round(CASE WHEN sum(n_expected) = 0 THEN 0.0::DOUBLE ELSE sum(n_hit)::DOUBLE / sum(n_expected)::DOUBLE END, 4) AS accuracy FROM sc GROUP BY source",
    "exact_orders": """
        WITH l AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey),
        j AS (SELECT o_orderpriority, l.n, o_orderstatus, CASE WHEN o_orderkey % 6 = 0 THEN 'F' ELSE o_orderstatus END AS theirs FROM orders LEFT JOIN l ON l_orderkey = o_orderkey),
        k AS (SELECT o_orderpriority, count(*) AS n_expected, count(n) AS n_found, count(*) FILTER (n = 4 AND theirs = o_orderstatus) AS n_exact FROM j GROUP BY o_orderpriority)
        SELECT *, round(n_exact::DOUBLE / n_expected, 4) AS accuracy FROM k""",
    "dominant_type": """
        WITH k AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY ALL)
        SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS w FROM k) WHERE w = 1""",
    "action_outcomes": f"""WITH {_GUESS}, p AS (SELECT * FROM g UNION ALL SELECT doc_id, source, lang, 'es' FROM g WHERE doc_id % 5 = 0),
        k AS (SELECT source, doc_id, lang, CASE WHEN count(guess) = 0 THEN 'missing' WHEN count(DISTINCT guess) > 1 THEN 'mixed' WHEN min(guess) = lang THEN 'match' ELSE 'mismatch' END AS state FROM p GROUP BY source, doc_id, lang),
        c AS (SELECT source, count(*) FILTER (state = 'match') AS n_match, count(*) FILTER (state = 'mismatch') AS n_mismatch, count(*) FILTER (state = 'mixed') AS n_mixed, count(*) FILTER (state = 'missing') AS n_missing, count(*) AS n_items FROM k GROUP BY source)
        SELECT *, round((n_items - n_missing)::DOUBLE / n_items, 4) AS coverage, round(n_match::DOUBLE / n_items, 4) AS accuracy FROM c""",
    "inherited_size": f"""WITH RECURSIVE {_TREE} SELECT a.p_brand, a.node, min_by(size, distance) FILTER (size IS NOT NULL) AS size, max(distance) AS depth FROM a JOIN t ON t.p_brand = a.p_brand AND t.node = a.ancestor GROUP BY a.p_brand, a.node""",
    "rolled_up": f"""WITH RECURSIVE {_TREE} SELECT a.p_brand, a.ancestor AS node, CAST(sum(own) AS BIGINT) AS own, bool_and(whole) AS whole, count(*) AS n_nodes FROM a JOIN t ON t.p_brand = a.p_brand AND t.node = a.node GROUP BY a.p_brand, a.ancestor""",
    "leaf_counts": f"""WITH RECURSIVE {_TREE}, f AS (SELECT p_brand, node FROM t WHERE (p_brand, node) NOT IN (SELECT (p_brand, parent) FROM t WHERE parent IS NOT NULL))
        SELECT a.p_brand, a.ancestor AS node, count(*) AS n_leaves, min(a.node) AS first_leaf FROM a JOIN f ON f.p_brand = a.p_brand AND f.node = a.node GROUP BY a.p_brand, a.ancestor""",
    "tree_faults": f"""WITH RECURSIVE {_TREE.split("a AS (")[0].rstrip().rstrip(",")},
        r AS (SELECT p_brand, node, CASE WHEN node % 40 = 2 THEN node * 4 + 1 WHEN node % 40 = 5 THEN -1 ELSE parent END AS parent FROM t UNION ALL SELECT p_brand, node, 1 FROM t WHERE node % 40 = 7),
        c AS (SELECT p_brand, node, CASE WHEN count(*) = count(parent) THEN min(parent) END AS parent FROM r GROUP BY ALL),
        u AS (SELECT p_brand, node, parent AS spot FROM c WHERE parent IS NOT NULL UNION SELECT u.p_brand, u.node, c.parent FROM u JOIN c ON c.p_brand = u.p_brand AND c.node = u.spot WHERE c.parent IS NOT NULL),
        top AS (SELECT p_brand, node FROM c WHERE parent IS NULL UNION SELECT u.p_brand, u.node FROM u JOIN c ON c.p_brand = u.p_brand AND c.node = u.spot AND c.parent IS NULL)
        SELECT p_brand, node, CASE WHEN count(DISTINCT parent) + CASE WHEN count(*) > count(parent) THEN 1 ELSE 0 END > 1 THEN 'several_parents' ELSE 'repeated' END AS error FROM r GROUP BY p_brand, node HAVING count(*) > 1
        UNION SELECT p_brand, node, 'unknown_parent' FROM r WHERE parent IS NOT NULL AND (p_brand, parent) NOT IN (SELECT (p_brand, node) FROM r)
        UNION SELECT p_brand, node, 'cycle' FROM u WHERE node = spot UNION SELECT p_brand, node, 'unreachable' FROM c WHERE (p_brand, node) NOT IN (SELECT (p_brand, node) FROM top)""",
    "compared_contracts": """
        WITH l AS (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS total, count(*) AS n FROM lineitem GROUP BY l_orderkey),
        j AS (SELECT *, o_orderkey % 5 AS m FROM orders LEFT JOIN l ON l_orderkey = o_orderkey WHERE o_orderkey % 11 <> 0),
        f AS (SELECT o_orderkey, ['exact', 'numeric_tolerance', 'normalized_text', 'oracle_required', 'other'][CAST(m AS INTEGER) + 1] AS comparator_mode,
          CASE WHEN m = 4 THEN 'unsupported_comparator_mode' WHEN (m = 0 AND n IS NULL) OR (m = 1 AND total IS NULL) THEN 'dimension_unreadable'
               WHEN m = 0 AND n <> 4 THEN 'exact_mismatch' WHEN m = 1 AND o_totalprice = 0 THEN 'not_comparable' WHEN m = 1 AND abs(o_totalprice - total) > abs(o_totalprice) * 30 / 100 THEN 'numeric_tolerance_mismatch'
               WHEN m = 2 AND o_orderstatus <> 'F' THEN 'normalized_text_mismatch' WHEN m = 3 AND n > 3 THEN NULL WHEN m = 3 AND n > 1 THEN 'oracle_failed' WHEN m = 3 THEN 'not_comparable' END AS finding FROM j)
        SELECT *, CASE WHEN finding IS NULL THEN 'PASS' WHEN finding IN ('exact_mismatch', 'numeric_tolerance_mismatch', 'normalized_text_mismatch', 'oracle_failed') THEN 'FAIL' ELSE 'UNKNOWN' END AS status FROM f""",
}
