"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

A document's expected copies are its source's target over its source's size.
They are prefix-summed over the documents of the source, one random offset is
added, and a document is emitted once for every integer that the running sum
crosses.  The running sum is a row number times a constant, so a source is cut
into (size class, salt) buckets: rows are numbered inside a bucket and the
bucket's start comes from a prefix over bucket counts.  Salts go by id and text,
so that rows without an id are spread like others.  No task holds more of
a source than one bucket, however hot the source is.  Since buckets go by
size, the sample is also spread evenly over short and long documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm.common import free_name

#: Words are runs of anything but ASCII white space.
WORDS = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in order of code point, null last; repeated.
WEIGHTS = (3, 1, 2)
#: The mix takes so many times all words, and at most CAP times a source's.
SHARE = 1.5
CAP = 2.0
SEED = "mix-1"


def _word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Targets of the sources, from rows (skey, source, source_size).

    Every source gets its weight's share of ``share`` times all sizes.  What
    exceeds ``cap`` times a source's size is shared again by weight.  That ends
    where every target is min(cap * size, level * weight); the level is found by
    going through the sources in order of cap * size / weight.  One row per
    source: the windows without a partition see sources, never documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    x = sizes.withColumn("rank", F.row_number().over(by_name)).withColumn("weight", pick)
    x = x.withColumn("most", F.col("source_size") * F.lit(cap)).withColumn("ratio", F.col("most") / F.col("weight"))
    up = Window.orderBy("ratio", "rank")
    before, after = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = x.withColumn("want", F.sum("source_size").over(everything) * F.lit(share))
    x = x.withColumn("level", (F.col("want") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(everything)
    x = x.withColumn("level", level["level"])
    target = F.coalesce(F.least(F.col("most"), F.col("level") * F.col("weight")), F.col("most"))
    return x.select("skey", "source_size", target.alias("target"))


def mix_plan(docs: DataFrame, text="text", doc_id="doc_id", source="source", weights=WEIGHTS, share=SHARE, cap=CAP, seed=SEED) -> DataFrame:
    """The rows of ``docs`` with size, source_size, target and copies.

    The four columns get leading underscores where ``docs`` has such names.
    Null texts and texts of white space have size 0; null sources are a source
    of their own, last in order; null ids are as good as any other.  Rows that
    repeat an id are documents of their own; ties are broken by size, id and
    text.  Where all sizes are 0, or the table is empty, nothing is taken.
    """
    names = {k: free_name(docs, k) for k in ("size", "source_size", "target", "copies")}
    k, c, s, h, n = (free_name(docs, f"mix_{x}") for x in ("key", "class", "salt", "hash", "row"))
    k_of, c_of, s_of, start, shift = (free_name(docs, f"mix_{x}") for x in ("key_of", "class_of", "salt_of", "start", "offset"))
    key = F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))
    id_text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    rows = docs.withColumn(names["size"], _word_count(F.col(text)))
    rows = rows.withColumns({k: key, c: F.length(F.bin(F.col(names["size"]))), s: F.substring(F.md5(F.concat(id_text, F.lit(" "), F.coalesce(F.col(text), F.lit("")))), 1, 2), h: F.xxhash64(F.col(text))})
    counts = rows.groupBy(F.col(k).alias("skey"), F.col(c).alias("class"), F.col(s).alias("salt")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(names["size"]).alias("words"), F.first(F.col(source)).alias("source")
    )
    sizes = counts.groupBy("skey").agg(F.sum("words").alias("source_size"), F.first("source").alias("source"))
    targets = source_targets(sizes, weights, share, cap)
    earlier = Window.partitionBy("skey").orderBy("class", "salt").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col("skey"))), 1, 3), 16, 10).cast("double") / F.lit(4096.0)
    starts = (
        counts.withColumn("start", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .join(targets, "skey")
        .select(
            F.col("skey").alias(k_of), F.col("class").alias(c_of), F.col("salt").alias(s_of), F.col("start").alias(start),
            offset.alias(shift), F.col("source_size").alias(names["source_size"]), F.col("target").alias(names["target"]),
        )
    )
    order = Window.partitionBy(k, c, s).orderBy(F.col(names["size"]), F.col(doc_id), F.col(h))
    rows = rows.withColumn(n, F.row_number().over(order))
    joined = rows.join(starts, (F.col(k) == F.col(k_of)) & (F.col(c) == F.col(c_of)) & (F.col(s) == F.col(s_of)))
    ratio = F.when(F.col(names["source_size"]) > 0, F.col(names["target"]) / F.col(names["source_size"])).otherwise(F.lit(0.0))
    at = F.col(start) + F.col(n)
    crossed = F.floor(F.col(shift) + at * ratio) - F.floor(F.col(shift) + (at - 1) * ratio)
    return joined.withColumn(names["copies"], crossed).select(*docs.columns, *names.values())


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the columns of ``docs``, each row as often as it is taken."""
    planned = mix_plan(docs, **options)
    copies = planned.columns[-1]
    again = free_name(planned, "again")
    return planned.filter(F.col(copies) > 0).withColumn(again, F.explode(F.array_repeat(F.lit(0), F.col(copies).cast("int")))).select(*docs.columns)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, targets and taken words of all documents; null texts have size 0, null sources are one source."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    plan = mix_plan(docs)
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL = """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
         coalesce('s' || source, 'n') AS skey, substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ' ' || coalesce(text, '')), 1, 2) AS salt
  FROM documents),
c AS (SELECT *, length(bin(size)) AS class FROM d),
src AS (SELECT skey, any_value(source) AS source, sum(size) AS source_size FROM d GROUP BY skey),
r AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM src),
w AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
             source_size::DOUBLE * 2.0::DOUBLE AS most FROM r),
x AS (SELECT *, most / weight AS ratio, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS want FROM w),
l AS (SELECT *, (want - coalesce(sum(most) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY ratio, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS step FROM x),
lev AS (SELECT step AS level FROM l WHERE step <= ratio ORDER BY ratio, rank LIMIT 1),
t AS (SELECT skey, source_size, coalesce(least(most, (SELECT level FROM lev) * weight), most) AS target,
             ('0x' || substr(md5('mix-1' || skey), 1, 3))::INTEGER / 4096.0::DOUBLE AS u FROM l),
n AS (SELECT c.*, row_number() OVER (PARTITION BY skey ORDER BY class, salt, size, doc_id) AS pos FROM c),
e AS (SELECT n.doc_id, n.size, t.source_size, t.target, n.pos, t.u,
             CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS ratio FROM n JOIN t USING (skey))
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(size * (floor(u + pos * ratio) - floor(u + (pos - 1) * ratio)) AS BIGINT) AS taken
FROM e
"""
