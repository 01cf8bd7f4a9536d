"""Review texts to records, and unions of findings with global numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.sources.shared import cut


def lines_of(df: DataFrame, key, text) -> DataFrame:
    """(key, line_no, line) of every text, from 0."""
    return df.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def sections(df: DataFrame, key, text, header: Column) -> DataFrame:
    """Texts cut at header lines: (key, section, header, n_lines, body); what stands before the first header is section 0."""
    lines = lines_of(df, key, text).withColumn("_header", header)
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("section", F.sum(F.col("_header").cast("int")).over(w))
    body = F.array_sort(F.collect_list(F.when(~F.col("_header"), F.struct("line_no", "line"))))
    out = lines.groupBy(key, "section").agg(F.max(F.when(F.col("_header"), F.col("line"))).alias("header"), body.alias("_body"))
    return out.withColumn("n_lines", F.size("_body").cast("long")).withColumn("body", F.array_join(F.transform("_body", lambda x: x["line"]), "\n")).drop("_body")


def labelled_values(df: DataFrame, body, fields) -> DataFrame:
    """Values of `field：value` lines as columns, empty where a field is not there; the first line of a field counts."""
    value = lambda f: F.trim(F.regexp_extract(body, f"(?m)^\\s*\\Q{f}\\E：(.*)$", 1))
    return df.withColumns({f"field_{i}": value(f) for i, f in enumerate(fields)})


def numbered_union(parts: list[DataFrame], order, pattern: str, name="action_id") -> DataFrame:
    """Rows of several parts one after another, in order within each, with one running number as an id.

    Numbers need the rows before: they are counted by range partition, and the
    counts, one for each partition, are summed; no task holds all rows.
    """
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p.withColumn("phase", F.lit(i)) for i, p in enumerate(parts, 1)])
    ranged = cut(union.repartitionByRange("phase", *order).sortWithinPartitions("phase", *order).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part").orderBy("phase", *order)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rows = ranged.withColumn("_at", F.row_number().over(inside)).join(starts, "_part")
    number = (F.col("_before") + F.col("_at")).cast("long")
    head, _, tail = pattern.partition("{:03d}")
    return rows.withColumn(name, F.concat(F.lit(head), F.format_string("%03d", number), F.lit(tail))).drop("_part", "_at", "_before")


def local_numbers(df: DataFrame, by, order, prefix: Column, name="id") -> DataFrame:
    """Ids such as `T2-MISMATCH-001`, numbered within each group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.concat(prefix, F.format_string("%03d", F.row_number().over(w))))
