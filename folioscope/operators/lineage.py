"""Artifacts, what refers to them, and whether the references still hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def broken_refs(artifacts: DataFrame, refs: DataFrame) -> DataFrame:
    """References (run_id, artifact, recorded) whose artifact (run_id, artifact, sha256) is missing or different."""
    theirs = artifacts.select("run_id", "artifact", "sha256", F.lit(True).alias("_there"))
    out = refs.join(theirs, ["run_id", "artifact"], "left")
    reason = F.when(F.col("_there").isNull(), "missing").when(~F.col("recorded").eqNullSafe(F.col("sha256")), "different")
    return out.withColumn("reason", reason).filter("reason IS NOT NULL").drop("_there")


def bound(expected: DataFrame, actual: DataFrame, declared: DataFrame) -> DataFrame:
    """Expected names with their files (name, sha256) and declared hashes: bound, different, undeclared or missing."""
    a = actual.select("name", F.col("sha256").alias("actual_sha256"), F.lit(True).alias("_a"))
    d = declared.select("name", F.col("sha256").alias("declared_sha256"), F.lit(True).alias("_d"))
    out = expected.join(a, "name", "left").join(d, "name", "left")
    state = F.when(F.col("_a").isNull(), "missing").when(F.col("_d").isNull(), "undeclared").when(F.col("actual_sha256") != F.col("declared_sha256"), "different").otherwise("bound")
    return out.withColumn("binding", state).drop("_a", "_d")


def require_final(stages: DataFrame, role="role", expected_hash=None) -> DataFrame:
    """Stage results that a consumer must refuse: not final, or sealed over another input."""
    bad = ~F.col(role).eqNullSafe(F.lit("final"))
    if expected_hash is not None:
        bad = bad | ~F.col("input_sha256").eqNullSafe(F.lit(expected_hash))
    return stages.filter(bad)


def forbidden_fields(df: DataFrame, names) -> list[str]:
    """Paths in the schema, nested ones too, whose name is on a list that must not leave; no data is read."""
    found = []

    def walk(kind, path):
        if hasattr(kind, "elementType"):
            walk(kind.elementType, path)
        elif hasattr(kind, "valueType"):
            walk(kind.valueType, path)
        for field in getattr(kind, "fields", []):
            here = f"{path}.{field.name}" if path else field.name
            if field.name in names:
                found.append(here)
            walk(field.dataType, here)

    walk(df.schema, "")
    return sorted(found)


def leaf_paths(df: DataFrame, skip=("notes",)) -> list[str]:
    """Dotted paths of all leaves of a schema."""
    found = []

    def walk(kind, path):
        kind = getattr(kind, "elementType", kind)
        for field in getattr(kind, "fields", []):
            if field.name not in skip:
                walk(field.dataType, f"{path}.{field.name}" if path else field.name)
        if not getattr(kind, "fields", None) and path:
            found.append(path)

    walk(df.schema, "")
    return sorted(found)
