"""Coverage ledgers: what is missing, unexpected, repeated or contested."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def missing(expected: DataFrame, actual: DataFrame, key) -> DataFrame:
    """Expected rows that have no counterpart."""
    return expected.join(actual.select(*key).distinct(), key, "left_anti")


def symmetric_difference(expected: DataFrame, actual: DataFrame, key) -> DataFrame:
    """Keys of one side only, with the side: `missing` or `unexpected`."""
    a, b = expected.select(*key).distinct(), actual.select(*key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("unexpected")))


def claims(leaves: DataFrame, claimed: DataFrame, by, leaf) -> DataFrame:
    """Each leaf with its number of claims and its state: `unclaimed`, `owned`, `contested`, or `unexpected` if it is no leaf."""
    counts = claimed.groupBy(*by, leaf).agg(F.count(F.lit(1)).alias("n_claims"))
    known = leaves.select(*by, leaf).distinct().withColumn("_leaf", F.lit(True))
    both = known.join(counts, [*by, leaf], "full_outer")
    n = F.coalesce("n_claims", F.lit(0))
    state = F.when(F.col("_leaf").isNull(), "unexpected").when(n == 0, "unclaimed").when(n == 1, "owned").otherwise("contested")
    return both.select(*by, leaf, n.alias("n_claims"), state.alias("state"))


def coverage(claimed: DataFrame, by) -> DataFrame:
    """Counts of a claim ledger by group: owned, unknown, total, and whether they add up."""
    count = lambda s: F.count_if(F.col("state") == s)
    out = claimed.groupBy(*by).agg(count("owned").alias("owned"), (count("unclaimed") + count("contested")).alias("unknown"), count("unexpected").alias("unexpected"), F.count_if(F.col("state") != "unexpected").alias("total"))
    return out.withColumn("complete", (F.col("owned") == F.col("total")) & (F.col("unexpected") == 0))


def path_ledger(declared: DataFrame, consumed: DataFrame, by, path="path") -> DataFrame:
    """Declared paths with whether some consumed path is the same or stands above it (by dotted parts).

    A path is joined on every one of its own prefixes, so the join is on equality.
    """
    parts = F.split(F.col(path), r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    spread = declared.select(*by, path).distinct().withColumn("_prefix", F.explode(prefixes))
    hit = consumed.select(*by, F.col(path).alias("_prefix")).distinct().withColumn("_hit", F.lit(1))
    out = spread.join(hit, [*by, "_prefix"], "left").groupBy(*by, path).agg(F.max("_hit").alias("_hit"))
    return out.select(*by, path, F.col("_hit").isNotNull().alias("consumed"))


def duplicate_ids(df: DataFrame, key) -> DataFrame:
    """Keys that stand more than once, with how often."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def duplicates_in_order(df: DataFrame, by, value, order) -> DataFrame:
    """Values repeated within a group, ranked by where they are repeated first."""
    w = Window.partitionBy(*by, value).orderBy(*order)
    second = df.withColumn("_n", F.row_number().over(w)).filter("_n = 2")
    return second.select(*by, value, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).alias("rank"))


def array_difference(df: DataFrame, expected, actual) -> DataFrame:
    """Adds what of the expected array is missing, what is unexpected, and what the actual one repeats, each sorted."""
    e, a = F.col(expected), F.col(actual)
    repeated = F.filter(F.array_distinct(a), lambda x: F.size(F.filter(a, lambda y: y == x)) > 1)
    return df.withColumns({"missing": F.array_sort(F.array_except(e, a)), "unexpected": F.array_sort(F.array_except(a, e)), "repeated": F.array_sort(repeated)})


def union_without_repeats(first: DataFrame, second: DataFrame, key, order) -> DataFrame:
    """All of ``first``, and of ``second`` the first row of each key that ``first`` has not."""
    fresh = second.join(first.select(*key).distinct(), key, "left_anti")
    w = Window.partitionBy(*key).orderBy(*order)
    return first.unionByName(fresh.withColumn("_row", F.row_number().over(w)).filter("_row = 1").drop("_row"), allowMissingColumns=True)


def dedupe_known(df: DataFrame, key, order) -> DataFrame:
    """First row of each key; rows whose key is null or blank are all kept."""
    blank = F.coalesce(F.trim(F.col(key)) == "", F.lit(True))
    w = Window.partitionBy(key, F.when(blank, F.monotonically_increasing_id())).orderBy(*order)
    return df.withColumn("_row", F.row_number().over(w)).filter("_row = 1").drop("_row")


def distinct_in_order(values: Column) -> Column:
    """An array's distinct values that are not empty, in order."""
    return F.array_distinct(F.filter(values, lambda x: x.isNotNull() & (x != "")))


def absorbed(actions: DataFrame, by, ref, kind, keep: str, drop: str, action_id) -> DataFrame:
    """Drops actions of one kind where the group has one of the other kind at the same reference; says which id took over."""
    stays = actions.filter(F.col(kind) == keep).groupBy(*by, ref).agg(F.min(action_id).alias("_by"))
    joined = actions.join(stays, [*by, ref], "left")
    return joined.withColumn("absorbed_by", F.when(F.col(kind) == drop, F.col("_by"))).drop("_by")


def resolve_overlaps(claimed: DataFrame, by, place, owner, rank) -> DataFrame:
    """The owner of each place: the one claim of the highest rank; ties leave the place contested."""
    w = Window.partitionBy(*by, place)
    top = claimed.withColumn("_top", F.max(rank).over(w)).filter(F.col(rank) == F.col("_top"))
    out = top.groupBy(*by, place).agg(F.countDistinct(owner).alias("n_top"), F.min(owner).alias("_one"))
    return out.select(*by, place, F.when(F.col("n_top") == 1, F.col("_one")).alias("owner"), (F.col("n_top") > 1).alias("contested"))


def consistent_claims(claimed: DataFrame, by, signature) -> DataFrame:
    """The signature on which all claims of a key agree; keys with several have none and are in conflict."""
    out = claimed.groupBy(*by).agg(F.countDistinct(signature).alias("n_signatures"), F.min(signature).alias("_one"))
    return out.select(*by, F.when(F.col("n_signatures") == 1, F.col("_one")).alias("signature"), (F.col("n_signatures") > 1).alias("conflict"))
