"""Verdicts: PASS, FAIL and UNKNOWN over findings and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PASS, FAIL, UNKNOWN = "PASS", "FAIL", "UNKNOWN"


def merged(status: Column | str, empty: str = UNKNOWN, where: Column | None = None) -> Column:
    """Aggregate: FAIL before UNKNOWN before PASS; ``empty`` where no row counts.

    ``where`` chooses the rows that count; statuses other than the three are as good as PASS.
    """
    s = F.col(status) if isinstance(status, str) else status
    counted = where if where is not None else F.lit(True)
    n = F.count_if(counted)
    return F.when(n == 0, empty).when(F.count_if(counted & (s == FAIL)) > 0, FAIL).when(F.count_if(counted & (s == UNKNOWN)) > 0, UNKNOWN).otherwise(PASS)


def verdict(n_pass: Column, n_fail: Column, n_unknown: Column) -> Column:
    """The same from counts; UNKNOWN if all are zero."""
    return F.when(n_fail > 0, FAIL).when(n_unknown > 0, UNKNOWN).when(n_pass > 0, PASS).otherwise(UNKNOWN)


def check_summary(checks: DataFrame, by, status="status", blocking="blocking") -> DataFrame:
    """Counts of checks by group, with the verdict of all, that of the known ones, and that of the blocking ones (none: PASS)."""
    count = lambda s: F.count_if(F.col(status) == s)
    return checks.groupBy(*by).agg(
        count(PASS).alias("n_pass"), count(FAIL).alias("n_fail"), count(UNKNOWN).alias("n_unknown"),
        merged(status).alias("display"), merged(status, UNKNOWN, F.col(status) != UNKNOWN).alias("known"), merged(status, PASS, F.col(blocking)).alias("gate"),
    )


def clusters(findings: DataFrame, by, key, order, message, affected, sample: int = 100) -> DataFrame:
    """Findings with one key together: the first's message, numbered by first appearance, with what they affect.

    ``affected`` is an array column; ``n_affected`` counts its distinct values over
    all findings of a cluster, and ``affected`` lists the first ``sample`` of them in order, so
    that no row grows with a cluster.  :func:`cluster_members` gives them all, as rows.
    """
    from pyspark.sql import Window

    out = findings.groupBy(*by, *key).agg(F.count(F.lit(1)).alias("n_findings"), F.min(order).alias("first_at"), F.min_by(message, order).alias("title"))
    members = cluster_members(findings, by, key, affected)
    first = Window.partitionBy(*by, *key).orderBy("member")
    shown = members.withColumn("_row", F.row_number().over(first)).groupBy(*by, *key).agg(
        F.count(F.lit(1)).alias("n_affected"), F.array_sort(F.collect_list(F.when(F.col("_row") <= sample, F.col("member")))).alias("affected")
    )
    out = out.join(shown, [*by, *key], "left").withColumn("n_affected", F.coalesce("n_affected", F.lit(0)))
    return out.withColumn("cluster_no", F.row_number().over(Window.partitionBy(*by).orderBy("first_at")))


def cluster_members(findings: DataFrame, by, key, affected) -> DataFrame:
    """(by, key, member): every distinct value that a cluster's findings affect."""
    return findings.select(*by, *key, F.explode(affected).alias("member")).distinct()


def report_counters(findings: DataFrame, by, severity, status, bucket, order) -> DataFrame:
    """Blocking and unknown findings by group, and the bucket of the first blocking one."""
    blocking = F.col(severity) == "blocking"
    return findings.groupBy(*by).agg(
        F.count_if(blocking).alias("n_blocking"), F.count_if(F.col(status) == UNKNOWN).alias("n_unknown"),
        F.min_by(bucket, F.when(blocking, F.col(order))).alias("first_bucket"), merged(status, PASS, blocking).alias("status"),
    )


def first_bad_stage(stages: DataFrame, by, stage, order, status="status") -> DataFrame:
    """The first stage in order that did not pass, null if all did."""
    return stages.groupBy(*by).agg(F.min_by(stage, F.when(F.col(status) != PASS, F.col(order))).alias("first_bad"), merged(status).alias("status"))


def conservative(df: DataFrame, by, available, reason, order) -> DataFrame:
    """Available only if every part is; reasons of the others joined in order."""
    lacking = F.collect_list(F.when(~F.col(available), F.struct(order, reason)))
    return df.groupBy(*by).agg(F.bool_and(available).alias("available"), F.array_join(F.transform(F.array_sort(lacking), lambda x: x[reason]), "; ").alias("reasons"))


def capped_sample(value, order, n: int) -> Column:
    """Aggregate: the first ``n`` values in order."""
    return F.transform(F.slice(F.array_sort(F.collect_list(F.struct(order, value))), 1, n), lambda x: x[value])


def routed(df: DataFrame, column, rules: list[tuple[str, str]], default: str, name="owner", contains: bool = False) -> DataFrame:
    """The target of the first rule whose text equals (or, with ``contains``, stands in) the column."""
    out = F.lit(default)
    for text, target in reversed(rules):
        test = F.col(column).contains(text) if contains else F.col(column) == text
        out = F.when(F.coalesce(test, F.lit(False)), target).otherwise(out)
    return df.withColumn(name, out)


def zero_filled(counts: DataFrame, buckets: DataFrame, key, count="n") -> DataFrame:
    """Counts for every bucket, 0 where there are none."""
    return buckets.join(counts, key, "left").withColumn(count, F.coalesce(count, F.lit(0)))
