"""Scores of actual against expected rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(n, d, digits: int | None = 4) -> Column:
    """n / d, 0 where d is 0, rounded half up."""
    n, d = (F.col(x) if isinstance(x, str) else x for x in (n, d))
    out = F.when(d == 0, F.lit(0.0)).otherwise(n.cast("double") / d)
    return F.round(out, digits) if digits is not None else out


def set_scores(expected: DataFrame, actual: DataFrame, by, key) -> DataFrame:
    """Precision, recall and F1 of distinct keys by group; groups of either side appear."""
    e = expected.select(*by, *key).distinct().withColumn("_e", F.lit(1))
    a = actual.select(*by, *key).distinct().withColumn("_a", F.lit(1))
    both = e.join(a, [*by, *key], "full_outer").groupBy(*by).agg(F.count("_e").alias("n_expected"), F.count("_a").alias("n_actual"), F.count_if(F.col("_e").isNotNull() & F.col("_a").isNotNull()).alias("n_hit"))
    p, r = ratio("n_hit", "n_actual", None), ratio("n_hit", "n_expected", None)
    f1 = F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))
    return both.withColumns({"precision": F.round(p, 4), "recall": F.round(r, 4), "f1": F.round(f1, 4)})


def label_scores(rows: DataFrame, by, expected, actual) -> DataFrame:
    """Precision, recall and F1 of every label by group, from one row for each item; a null actual is a miss."""
    spread = rows.select(*by, F.explode(F.array(F.struct(F.col(expected).alias("label"), F.lit(1).alias("e"), F.lit(0).alias("a"), (F.col(expected).eqNullSafe(F.col(actual))).cast("int").alias("hit")), F.struct(F.col(actual).alias("label"), F.lit(0).alias("e"), F.lit(1).alias("a"), F.lit(0).alias("hit")))).alias("x"))
    sums = spread.filter("x.label IS NOT NULL").groupBy(*by, F.col("x.label").alias("label")).agg(F.sum("x.e").alias("n_expected"), F.sum("x.a").alias("n_actual"), F.sum("x.hit").alias("n_hit"))
    p, r = ratio("n_hit", "n_actual", None), ratio("n_hit", "n_expected", None)
    return sums.withColumns({"precision": F.round(p, 4), "recall": F.round(r, 4), "f1": F.round(F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r)), 4)})


def macro(labels: DataFrame, by) -> DataFrame:
    """Mean of the labels' F1 by group, to four places in whole numbers, and accuracy over all items."""
    return labels.groupBy(*by).agg((F.floor(F.sum(F.round(F.col("f1") * 10000).cast("long")) / F.count("f1") + 0.5) / 10000).alias("macro_f1"), ratio(F.sum("n_hit"), F.sum("n_expected")).alias("accuracy"))


def exact_accuracy(expected: DataFrame, actual: DataFrame, by, key, columns) -> DataFrame:
    """Share of expected keys whose columns are all equal; keys that are missing count as wrong."""
    theirs = actual.select(*by, *key, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(1).alias("_hit"))
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    both = expected.join(theirs, [*by, *key], "left")
    out = both.groupBy(*by).agg(F.count(F.lit(1)).alias("n_expected"), F.count("_hit").alias("n_found"), F.count_if(F.col("_hit").isNotNull() & same).alias("n_exact"))
    return out.withColumn("accuracy", ratio("n_exact", "n_expected"))


def dominant(rows: DataFrame, by, value, order) -> DataFrame:
    """The most frequent value of each group, of equally frequent ones that met first."""
    counts = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_at"))
    w = Window.partitionBy(*by).orderBy(F.col("n").desc(), "first_at")
    return counts.withColumn("_row", F.row_number().over(w)).filter("_row = 1").select(*by, value, "n")


def action_outcomes(rows: DataFrame, by, key, expected, actual) -> DataFrame:
    """Items by outcome: match, mismatch, mixed (several actual actions) or missing, and the share that is covered."""
    per = rows.groupBy(*by, *key, expected).agg(F.collect_set(actual).alias("_set"))
    state = F.when(F.size("_set") == 0, "missing").when(F.size("_set") > 1, "mixed").when(F.element_at("_set", 1) == F.col(expected), "match").otherwise("mismatch")
    per = per.withColumn("state", state)
    count = lambda s: F.count_if(F.col("state") == s)
    out = per.groupBy(*by).agg(*[count(s).alias(f"n_{s}") for s in ("match", "mismatch", "mixed", "missing")], F.count(F.lit(1)).alias("n_items"))
    return out.withColumn("coverage", ratio(F.col("n_items") - F.col("n_missing"), "n_items")).withColumn("accuracy", ratio("n_match", "n_items"))
