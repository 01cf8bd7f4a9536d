"""Queries of the ordered and interval operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators import intervals, matching, sequence
from folioscope.sources.tables import table


def source_sequence(spark, sf_dir):
    """Documents numbered within their source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return sequence.ranged_sequence(docs, ["source"], ["doc_id"])


def folded_turns(spark, sf_dir):
    """Conversations with neighbouring turns of one role folded together."""
    turns = table(spark, sf_dir, "conversations")
    out = sequence.fold_runs(turns, ["conv_id"], ["turn", "role", "text"], ["role"], "text")
    return out.select("conv_id", "island", "role", "first_at", "n_rows", F.length("text").cast("long").alias("n_chars"))


def line_ranges(spark, sf_dir):
    """Consecutive suppliers of each part as ranges."""
    return sequence.integer_ranges(table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_suppkey")


def last_purchase(spark, sf_dir):
    """Each event with the value of its user's last purchase so far, and of the next."""
    ev = table(spark, sf_dir, "events").withColumn("paid", F.when(F.col("event_type") == "purchase", F.col("value")))
    before = sequence.last_known("paid", ["user_id"], ["ts", "event_id"])
    after = sequence.next_known("paid", ["user_id"], ["ts", "event_id"], current=False)
    return ev.select("event_id", "user_id", before.alias("last_paid"), after.alias("next_paid"))


def neighbour_types(spark, sf_dir):
    """Unknown event types filled where the neighbours on both sides agree."""
    ev = table(spark, sf_dir, "events").withColumn("known", F.when(F.col("event_id") % 3 != 0, F.col("event_type")))
    return sequence.neighbour_fill(ev, ["user_id"], ["ts", "event_id"], "known", "filled", one_sided=True).select("event_id", "known", "filled")


def unanimous_source(spark, sf_dir):
    """Unknown languages filled where all known documents of a source and length class agree."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.floor(F.col("n_chars") / 500).alias("size"), F.when(F.col("doc_id") % 4 != 0, F.col("lang")).alias("known"))
    return sequence.unanimous_fill(docs, ["source", "size"], "known", "filled").select("doc_id", "filled")


def sessions(spark, sf_dir):
    """Events of each user in segments that begin at signups, with their sizes."""
    ev = table(spark, sf_dir, "events").withColumn("signup", F.col("event_type") == "signup")
    seg = sequence.segments(ev, ["user_id"], ["ts", "event_id"], "signup")
    return seg.groupBy("user_id", "segment").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("least_event"))


def order_spans(spark, sf_dir):
    """Orders of each customer as ranges that end before the next order."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.datediff("o_orderdate", F.lit("1970-01-01")).alias("day"))
    return sequence.ends_before_next(orders, ["o_custkey"], "day", ["o_orderkey"])


def text_offsets(spark, sf_dir):
    """Offsets of turns in the joined text of their conversation."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("len"))
    return sequence.running_offsets(turns, ["conv_id"], ["turn"], "len")


def status_in_force(spark, sf_dir):
    """The last urgent order's price that is in force for each customer and status."""
    orders = table(spark, sf_dir, "orders").withColumn("set", F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice")))
    return sequence.inherited(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderstatus"], "set").select("o_orderkey", "effective")


def first_failed(spark, sf_dir):
    """The first order of each customer that is not finished."""
    return sequence.first_bad(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], F.col("o_orderstatus") != "F", ["o_orderkey", "o_orderstatus"])


def _spans(spark, sf_dir, days):
    o = table(spark, sf_dir, "orders").select("o_custkey", F.datediff("o_orderdate", F.lit("1970-01-01")).alias("start"))
    return o.withColumn("end", F.col("start") + days)


def cover_of_customers(spark, sf_dir):
    """Whether the 120 days from each order cover the time from a customer's first to its last order."""
    spans = _spans(spark, sf_dir, 120)
    targets = spans.groupBy("o_custkey").agg(F.min("start").alias("target_start"), F.max("start").alias("target_end"))
    return intervals.covered(spans, targets, ["o_custkey"])


def gaps_of_customers(spark, sf_dir):
    """What is not covered of the same."""
    spans = _spans(spark, sf_dir, 120)
    targets = spans.groupBy("o_custkey").agg(F.min("start").alias("target_start"), F.max("start").alias("target_end"))
    return intervals.uncovered(spans, targets, ["o_custkey"])


def _user_ranges(spark, sf_dir, kind, l):
    ev = table(spark, sf_dir, "events").filter(F.col("event_type") == kind).select("user_id", "event_id")
    return ev.select("user_id", F.col("event_id").alias(f"{l}_id"), F.col("event_id").alias(f"{l}_start"), (F.col("event_id") + 40).alias(f"{l}_end"))


def overlapping_ranges(spark, sf_dir):
    """Ranges of 40 event ids after clicks and after purchases of one user that overlap."""
    a, b = _user_ranges(spark, sf_dir, "click", "l"), _user_ranges(spark, sf_dir, "purchase", "r")
    return intervals.overlap_join(a, b, ["user_id"], 64).select("l_id", "r_id", "overlap")


def primary_overlap(spark, sf_dir):
    """For each click range the purchase range that overlaps it longest."""
    a, b = _user_ranges(spark, sf_dir, "click", "l"), _user_ranges(spark, sf_dir, "purchase", "r")
    return intervals.longest_overlap(intervals.overlap_join(a, b, ["user_id"], 64), ["l_id"], ["r_id"], ["r_id"])


def point_owners(spark, sf_dir):
    """Owners of error events among the ranges of one user's purchases, with conflicts."""
    points = table(spark, sf_dir, "events").filter("event_type = 'error'").select("user_id", "event_id")
    ranges = _user_ranges(spark, sf_dir, "purchase", "r").select("user_id", F.col("r_start").alias("start"), F.col("r_end").alias("end"), F.col("r_id").alias("owner"))
    return intervals.owners_of_points(points, ranges, ["user_id"], "event_id", 64)


def range_faults(spark, sf_dir):
    """How part sizes break the contract of covering 1..50 once by brand, each from its size to its size + 1."""
    part = table(spark, sf_dir, "part").select("p_brand", F.col("p_size").alias("start"), (F.col("p_size") + 1).alias("end"), F.col("p_partkey").alias("id"), F.lit(50).alias("total"))
    return intervals.range_contract(part, ["p_brand"], "total", order=["id"])


def errors_between(spark, sf_dir):
    """Errors of a user between each event and the 50 ids after."""
    ev = table(spark, sf_dir, "events").filter("event_type = 'signup'").select("user_id", F.col("event_id").alias("low"), (F.col("event_id") + 50).alias("high"))
    err = table(spark, sf_dir, "events").filter("event_type = 'error'").select("user_id", "event_id")
    return intervals.boundaries_between(ev, err, ["user_id"], "low", "high", "event_id").select("low", "n_between")


def asof_order(spark, sf_dir):
    """Each purchase with the customer's last order before it, the customer being the user modulo their number."""
    ev = table(spark, sf_dir, "events").filter("event_type = 'purchase'").select("event_id", F.col("user_id").alias("k"), F.to_date("ts").alias("day"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.to_date("o_orderdate").alias("day"), F.col("o_orderkey"))
    return matching.asof_backward(ev, orders, ["k"], "day", "o_orderkey", ["o_orderkey"]).select("event_id", "asof_o_orderkey")


def next_order(spark, sf_dir):
    """Each purchase with the customer's first order on or after it, or else its last."""
    ev = table(spark, sf_dir, "events").filter("event_type = 'purchase'").select("event_id", F.col("user_id").alias("k"), F.to_date("ts").alias("day"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.to_date("o_orderdate").alias("day"), F.col("o_orderkey"))
    return matching.asof_forward(ev, orders, ["k"], "day", "o_orderkey", ["o_orderkey"], or_last=True).select("event_id", "next_o_orderkey")


QUERIES = {f.__name__: f for f in (
    source_sequence, folded_turns, line_ranges, last_purchase, neighbour_types, unanimous_source, sessions, order_spans, text_offsets, status_in_force,
    first_failed, cover_of_customers, gaps_of_customers, overlapping_ranges, primary_overlap, point_owners, range_faults, errors_between, asof_order, next_order,
)}

_DAY = "date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE))"
_TARGETS = f"""
  s AS (SELECT o_custkey, {_DAY} AS s, {_DAY} + 120 AS e FROM orders),
  t AS (SELECT o_custkey, min(s) AS target_start, max(s) AS target_end FROM s GROUP BY o_custkey),
  r AS (SELECT s.*, target_start, target_end, greatest(coalesce(max(e) OVER (PARTITION BY s.o_custkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), target_start), target_start) AS reach
        FROM s JOIN t USING (o_custkey))"""
_RANGES = """
  a AS (SELECT user_id, event_id AS l_id, event_id AS l_start, event_id + 40 AS l_end FROM events WHERE event_type = 'click'),
  b AS (SELECT user_id, event_id AS r_id, event_id AS r_start, event_id + 40 AS r_end FROM events WHERE event_type = 'purchase'),
  p AS (SELECT l_id, r_id, least(l_end, r_end) - greatest(l_start, r_start) + 1 AS overlap FROM a JOIN b USING (user_id) WHERE l_start <= r_end AND r_start <= l_end)"""

SQL = {
    "source_sequence": "SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS seq FROM documents",
    "folded_turns": """
        WITH n AS (SELECT *, row_number() OVER w AS place, CASE WHEN lag(role) OVER w IS NOT DISTINCT FROM role AND lag(1) OVER w = 1 THEN 0 ELSE 1 END AS st
                   FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
        i AS (SELECT *, sum(st) OVER (PARTITION BY conv_id ORDER BY place) AS island FROM n)
        SELECT conv_id, CAST(island AS BIGINT) AS island, role, CAST(min(place) AS INTEGER) AS first_at, count(*) AS n_rows, CAST(sum(length(text)) AS BIGINT) AS n_chars
        FROM i GROUP BY conv_id, island, role""",
    "line_ranges": """
        WITH d AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem),
        g AS (SELECT *, l_suppkey - row_number() OVER (PARTITION BY l_partkey ORDER BY l_suppkey) AS run FROM d)
        SELECT l_partkey, min(l_suppkey) AS start, max(l_suppkey) AS "end", count(*) AS n FROM g GROUP BY l_partkey, run""",
    "last_purchase": """
        SELECT event_id, user_id,
               last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_paid,
               first_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_paid
        FROM events""",
    "neighbour_types": """
        WITH k AS (SELECT *, CASE WHEN event_id % 3 <> 0 THEN event_type END AS known FROM events),
        n AS (SELECT *, last_value(known IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b,
                     first_value(known IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM k)
        SELECT event_id, known, CASE WHEN known IS NOT NULL THEN known WHEN b = a THEN b WHEN b IS NULL THEN a WHEN a IS NULL THEN b END AS filled FROM n""",
    "unanimous_source": """
        WITH k AS (SELECT doc_id, source, n_chars // 500 AS size, CASE WHEN doc_id % 4 <> 0 THEN lang END AS known FROM documents)
        SELECT doc_id, coalesce(known, CASE WHEN min(known) OVER w = max(known) OVER w THEN min(known) OVER w END) AS filled FROM k WINDOW w AS (PARTITION BY source, size)""",
    "sessions": """
        WITH s AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS segment FROM events)
        SELECT user_id, CAST(segment AS BIGINT) AS segment, count(*) AS n, min(event_id) AS least_event FROM s GROUP BY user_id, segment""",
    "order_spans": f"""
        WITH d AS (SELECT o_orderkey, o_custkey, {_DAY} AS day FROM orders)
        SELECT o_orderkey, o_custkey, CAST(day AS INTEGER) AS day, CAST(lead(day) OVER (PARTITION BY o_custkey ORDER BY day, o_orderkey) - 1 AS INTEGER) AS "end" FROM d""",
    "text_offsets": """
        SELECT conv_id, turn, CAST(length(text) AS BIGINT) AS len, CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
        FROM conversations""",
    "status_in_force": """
        SELECT o_orderkey, last_value(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice END IGNORE NULLS)
               OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS effective FROM orders""",
    "first_failed": """
        WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus <> 'F' THEN 0 ELSE 1 END, o_orderdate, o_orderkey) AS n FROM orders)
        SELECT o_custkey, CASE WHEN o_orderstatus <> 'F' THEN o_orderkey END AS first_bad_o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus END AS first_bad_o_orderstatus FROM r WHERE n = 1""",
    "cover_of_customers": f"""
        WITH {_TARGETS}
        SELECT o_custkey, CAST(target_start AS INTEGER) AS target_start, CAST(target_end AS INTEGER) AS target_end,
               (target_end <= target_start) OR (max(CASE WHEN s > reach AND reach < target_end THEN 1 ELSE 0 END) = 0 AND max(e) >= target_end) AS covered
        FROM r GROUP BY o_custkey, target_start, target_end""",
    "gaps_of_customers": f"""
        WITH {_TARGETS}
        SELECT o_custkey, CAST(reach AS INTEGER) AS start, CAST(s AS INTEGER) AS "end" FROM r WHERE s > reach""",
    "overlapping_ranges": f"WITH {_RANGES} SELECT l_id, r_id, overlap FROM p",
    "primary_overlap": f"WITH {_RANGES} SELECT l_id, r_id, overlap FROM (SELECT *, row_number() OVER (PARTITION BY l_id ORDER BY overlap DESC, r_id) AS n FROM p) WHERE n = 1",
    "point_owners": """
        WITH b AS (SELECT user_id, event_id AS owner FROM events WHERE event_type = 'purchase'),
        h AS (SELECT e.user_id, e.event_id, b.owner FROM events e LEFT JOIN b ON b.user_id = e.user_id AND e.event_id BETWEEN b.owner AND b.owner + 40 WHERE e.event_type = 'error')
        SELECT user_id, event_id, count(DISTINCT owner) AS n_owners, CASE WHEN count(DISTINCT owner) = 1 THEN min(owner) END AS owner, count(DISTINCT owner) > 1 AS conflict FROM h GROUP BY user_id, event_id""",
    "range_faults": """
        WITH x AS (SELECT p_brand, p_size AS s, p_size + 1 AS e, coalesce(max(p_size + 1) OVER (PARTITION BY p_brand ORDER BY p_size, p_size + 1, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS last FROM part)
        SELECT p_brand, CAST(count(*) FILTER (s > last + 1) AS BIGINT) AS n_gaps, CAST(count(*) FILTER (s <= last) AS BIGINT) AS n_overlaps, CAST(count(*) FILTER (e < s) AS BIGINT) AS n_inverted, max(e) <> 50 AS wrong_end
        FROM x GROUP BY p_brand""",
    "errors_between": """
        SELECT s.event_id AS low, count(e.event_id) AS n_between FROM events s
        LEFT JOIN events e ON e.user_id = s.user_id AND e.event_type = 'error' AND e.event_id > s.event_id AND e.event_id <= s.event_id + 50
        WHERE s.event_type = 'signup' GROUP BY s.event_id""",
    "asof_order": """
        SELECT event_id, (SELECT max_by(o_orderkey, row(CAST(o_orderdate AS DATE), o_orderkey)) FROM orders WHERE o_custkey = user_id AND CAST(o_orderdate AS DATE) <= CAST(ts AS DATE)) AS asof_o_orderkey
        FROM events WHERE event_type = 'purchase'""",
    "next_order": """
        SELECT event_id, coalesce((SELECT min_by(o_orderkey, row(CAST(o_orderdate AS DATE), o_orderkey)) FROM orders WHERE o_custkey = user_id AND CAST(o_orderdate AS DATE) >= CAST(ts AS DATE)),
                                  (SELECT max_by(o_orderkey, row(CAST(o_orderdate AS DATE), o_orderkey)) FROM orders WHERE o_custkey = user_id AND CAST(o_orderdate AS DATE) < CAST(ts AS DATE))) AS next_o_orderkey
        FROM events WHERE event_type = 'purchase'""",
}
