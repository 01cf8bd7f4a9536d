"""Plain relational queries over the star tables: the engine's smoke checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.sources.tables import table


def pricing_summary(spark, sf_dir):
    """Sums by return flag and line status of lines shipped by 1998-09-02."""
    lines = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return lines.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("sum_qty"),
        F.count(F.lit(1)).alias("n_lines"),
    )


QUERIES = {"pricing_summary": pricing_summary}

SQL = {
    "pricing_summary": """
        SELECT l_returnflag, l_linestatus,
               CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty,
               count(*) AS n_lines
        FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02'
        GROUP BY l_returnflag, l_linestatus""",
}
