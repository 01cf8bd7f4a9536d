"""Gold reports: what claims say of expected ranges, and the scores of that by action, by unit and over all."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators.intervals import overlap_join, overlaps_half_open
from folioscope.operators.scoring import ratio

#: The action that must never be claimed where it is not expected.
DELETE = "delete"


def _doubled(start: str, end: str, low: str, high: str) -> dict[str, Column]:
    """Half-open ranges as closed ones of doubled places: ranges that meet in an inner place overlap, an empty one is its place with both sides."""
    s, e = F.col(start).cast("long") * 2, F.col(end).cast("long") * 2
    return {low: F.when(F.col(start) == F.col(end), s - 1).otherwise(s + 1), high: F.when(F.col(start) == F.col(end), e + 1).otherwise(e - 1)}


def _first_gap(by: list[str], name: str, where: Column) -> Column:
    """Aggregate input: 1 where a range of ``where`` begins beyond all that end before it, within its target."""
    w = Window.partitionBy(*by).orderBy("g_from", "g_to").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.greatest(F.coalesce(F.max(F.when(where, F.col("g_to"))).over(w), F.col("g_start")), F.col("g_start"))
    return F.when(where & (F.col("g_from") > reach), 1).otherwise(0).alias(name)


def _covers(gap: str, where: Column) -> Column:
    """Aggregate: whether the ranges of ``where`` cover their target; an empty target needs one that touches it."""
    return F.coalesce((F.max(gap) == 0) & (F.max(F.when(where, F.col("g_to"))) >= F.max("g_end")), F.lit(False))


def projected(gold: DataFrame, claims: DataFrame, run: list[str], key: list[str], width: int = 256) -> DataFrame:
    """What the claims say of each gold range.

    ``gold`` holds (run, key, start, end) with half-open ranges, ``run`` and
    ``key`` together naming a row; ``claims`` holds (run, item, start, end,
    action).  A claim without start and end is its item's word on all of the
    run: it makes the range known, and its action counts where the item's own
    ranges do not cover the range.  A null action makes known, but says nothing.

    Adds ``actions`` (distinct, sorted), ``complete`` (ranges with an action
    cover the range) and ``known`` (ranges of any kind do).  Ranges that are
    null, negative or inverted are never known.  Gold rows without a claim stay.
    Equal claims count once, since all three are sets.  Claims meet gold rows in
    buckets of ``width`` places, so a long run is many groups.
    """
    names = {c: f"c_{c}" for c in ("item", "start", "end", "action")}
    keyed = claims.select(*run, *[F.col(c).alias(n) for c, n in names.items()]).distinct()
    sound = F.coalesce((F.col("start") >= 0) & (F.col("start") <= F.col("end")), F.lit(False))
    asked = gold.filter(sound).select(*run, *key, F.col("start").cast("long").alias("g_start"), F.col("end").cast("long").alias("g_end"))
    whole = F.col("c_start").isNull() | F.col("c_end").isNull()
    spans = keyed.filter(~whole & (F.col("c_start") <= F.col("c_end")))
    sides = asked.withColumns(_doubled("g_start", "g_end", "l_start", "l_end")), spans.withColumns(_doubled("c_start", "c_end", "r_start", "r_end"))
    met = overlap_join(*sides, run, 2 * width).filter(overlaps_half_open("g_start", "g_end", "c_start", "c_end"))
    row = [*run, *key]
    said = met.select(*row, "g_start", "g_end", "c_item", "c_action", F.greatest("g_start", "c_start").alias("g_from"), F.least("g_end", "c_end").alias("g_to"), F.lit(False).alias("whole"))
    alls = asked.join(keyed.filter(whole).select(*run, "c_item", "c_action").distinct(), run)
    said = said.unionByName(alls.select("*", F.col("g_start").alias("g_from"), F.col("g_end").alias("g_to"), F.lit(True).alias("whole")))
    # an item's word on the whole run steps back where its own ranges cover the row
    own = [*row, "c_item"]
    span, acts = ~F.col("whole"), F.col("c_action").isNotNull()
    said = said.withColumn("gap", _first_gap(own, "gap", span))
    per_item = Window.partitionBy(*own)
    said = said.withColumn("held", F.coalesce((F.max("gap").over(per_item) == 0) & (F.max(F.when(span, F.col("g_to"))).over(per_item) >= F.col("g_end")), F.lit(False)))
    speaks = acts & (span | ~F.col("held"))
    said = said.withColumn("speaks", speaks)
    said = said.select("*", _first_gap(row, "gap_known", F.lit(True)), _first_gap(row, "gap_said", F.col("speaks")))
    out = said.groupBy(*row).agg(
        F.array_sort(F.collect_set(F.when(F.col("speaks"), F.col("c_action")))).alias("actions"),
        _covers("gap_said", F.col("speaks")).alias("complete"),
        _covers("gap_known", F.lit(True)).alias("known"),
    )
    left = gold.join(out, row, "left")
    fill = {"actions": F.coalesce("actions", F.array().cast("array<string>")), "complete": F.coalesce("complete", F.lit(False)), "known": F.coalesce("known", F.lit(False))}
    return left.withColumns(fill)


def outcomes(rows: DataFrame, allowed: list[str], expected: str = "expected") -> DataFrame:
    """Adds what a projected row counts as: scored, predicted, covered, conflicted, correct, true_delete, false_delete.

    Rows whose expected action is not among ``allowed`` (unknown, null) are not
    scored, but a claim to delete them is false.  A row is predicted where its
    whole range has one action alone.
    """
    scored = F.coalesce(F.col(expected).isin(*allowed), F.lit(False))
    one = F.when(F.col("complete") & (F.size("actions") == 1), F.element_at("actions", 1))
    predicted = F.when(one.isin(*allowed), one)
    deletes = F.array_contains("actions", DELETE)
    wanted = F.coalesce(F.col(expected) == DELETE, F.lit(False))
    return rows.withColumns({
        "scored": scored, "predicted": F.when(scored, predicted), "covered": F.col("known"), "conflicted": F.size("actions") > 1,
        "correct": scored & F.coalesce(predicted == F.col(expected), F.lit(False)), "true_delete": scored & wanted & deletes, "false_delete": deletes & ~wanted,
    })


def report(rows: DataFrame, by: list[str], unit: str, allowed: list[str], expected: str = "expected") -> DataFrame:
    """Scores of :func:`outcomes` by action, by unit and over all, in one pass of GROUPING SETS.

    (by, level, name, n_expected, n_predicted, n_correct, n_covered,
    n_conflicted, precision, recall, f1, accuracy, macro_f1, n_unscored,
    n_true_delete, n_false_delete, n_missed_delete, gate).  Levels are action,
    unit and all; an allowed action that is neither expected nor predicted in
    a group has no row there, and counts as 0 in ``macro_f1``.  ``gate`` is PASS where nothing is deleted falsely, unscored rows
    included.  A null unit is a unit of its own.  ``macro_f1`` is over the
    allowed actions and given for all alone.
    """
    flag = lambda c: F.col(c).cast("int")
    side = lambda label, e, p: F.struct(label.alias("label"), F.lit(e).alias("e"), p.alias("p"))
    # a row counts under the action expected of it and under the one predicted
    sides = F.array(side(F.col(expected), 1, F.lit(0)), side(F.col("predicted"), 0, flag("scored")))
    narrow = rows.select(*by, F.col(unit).alias("unit"), F.col(expected).alias("x"), "predicted", "scored", "covered", "conflicted", "correct", "true_delete", "false_delete", F.posexplode(sides).alias("side", "s"))
    narrow = narrow.filter((F.col("side") == 0) | F.col("predicted").isNotNull())
    first = F.col("s.e") == 1
    mine = first & F.col("scored")
    count = lambda c: F.count_if(c)
    sums = {
        "n_expected": count(mine), "n_predicted": count((F.col("s.p") == 1)), "n_correct": count(mine & F.col("correct")),
        "n_covered": count(mine & F.col("covered")), "n_conflicted": count(mine & F.col("conflicted")), "n_unscored": count(first & ~F.col("scored")),
        "n_true_delete": count(mine & F.col("true_delete")), "n_false_delete": count(first & F.col("false_delete")), "n_expected_delete": count(mine & (F.col("x") == DELETE)),
    }
    for i, a in enumerate(allowed):
        sums |= {f"e{i}": count(mine & (F.col("x") == a)), f"p{i}": count((F.col("s.p") == 1) & (F.col("predicted") == a)), f"c{i}": count(mine & F.col("correct") & (F.col("x") == a))}
    label = F.when(F.coalesce(F.col("s.label").isin(*allowed), F.lit(False)), F.col("s.label"))
    narrow = narrow.withColumn("label", label)
    sets = [[*map(F.col, by), F.col("label")], [*map(F.col, by), F.col("unit")], [*map(F.col, by)]]
    keys = [*map(F.col, by), F.col("label"), F.col("unit")]
    grouped = narrow.groupingSets(sets, *keys).agg(F.grouping("label").alias("no_label"), F.grouping("unit").alias("no_unit"), *[c.alias(n) for n, c in sums.items()])
    level = F.when(F.col("no_label") == 0, "action").when(F.col("no_unit") == 0, "unit").otherwise("all")
    leveled = grouped.withColumn("level", level)
    f1 = lambda c, p, e: F.when(c == 0, F.lit(0.0)).otherwise(2 * (c / p) * (c / e) / (c / p + c / e))
    macro = reduce(lambda x, y: x + y, [f1(F.col(f"c{i}"), F.col(f"p{i}"), F.col(f"e{i}")) for i in range(len(allowed))]) / len(allowed)
    kept = leveled.filter((F.col("level") != "action") | F.col("label").isNotNull())
    whole = F.col("level") == "all"
    named = kept.withColumn("name", F.when(F.col("level") == "action", F.col("label")).when(F.col("level") == "unit", F.col("unit").cast("string")))
    missed = F.col("n_expected_delete") - F.col("n_true_delete")
    return named.select(
        *by, "level", "name", "n_expected", "n_predicted", "n_correct", "n_covered", "n_conflicted",
        ratio("n_correct", "n_predicted").alias("precision"), ratio("n_correct", "n_expected").alias("recall"), F.round(f1(F.col("n_correct"), F.col("n_predicted"), F.col("n_expected")), 4).alias("f1"),
        ratio("n_correct", "n_expected").alias("accuracy"), F.when(whole, F.round(macro, 4)).alias("macro_f1"), "n_unscored",
        "n_true_delete", "n_false_delete", missed.alias("n_missed_delete"), F.when(F.col("n_false_delete") == 0, "PASS").otherwise("FAIL").alias("gate"),
    )
