"""Writers: ordered tables with a manifest, report bundles, an append-only audit log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import status as st


def write_outputs(tables: dict[str, DataFrame], out_dir: str) -> DataFrame:
    """Writes each table under its place in the order and its name, and a manifest (place, name, path, n_rows, content_hash)."""
    rows = []
    spark = next(iter(tables.values())).sparkSession
    for place, (name, df) in enumerate(tables.items(), 1):
        path = f"{out_dir}/{place:02d}_{name}"
        df.write.mode("overwrite").parquet(path)
        back = spark.read.parquet(path)
        # a sum of row hashes is the same in any order of rows
        n, total = back.agg(F.count(F.lit(1)), F.sum(F.xxhash64(F.to_json(F.struct("*"))).cast("decimal(38,0)"))).first()
        rows.append((place, name, path, n, str(total or 0)))
    manifest = spark.createDataFrame(rows, "place int, name string, path string, n_rows long, content_hash string")
    manifest.coalesce(1).write.mode("overwrite").json(f"{out_dir}/manifest")
    return manifest


def write_report(findings: DataFrame, out_dir: str) -> DataFrame:
    """Writes findings, their clusters and a summary; returns the summary.

    ``findings`` holds (finding_id, status, severity, bucket, message, affected array).
    """
    keyed = findings.withColumn("_all", F.lit(0))
    summary = st.report_counters(keyed, ["_all"], "severity", "status", "bucket", "finding_id").drop("_all")
    groups = st.clusters(keyed, ["_all"], ["status", "bucket"], "finding_id", "message", "affected").drop("_all")
    findings.write.mode("overwrite").json(f"{out_dir}/findings")
    groups.write.mode("overwrite").json(f"{out_dir}/clusters")
    summary.coalesce(1).write.mode("overwrite").json(f"{out_dir}/summary")
    return summary


def append_audit(spark: SparkSession, path: str, event_type: str, allowed: bool, reason: str, files: list[str], actor: str) -> None:
    """Appends one event; its id is unique however many writers there are."""
    row = spark.createDataFrame([(event_type, allowed, reason, files, actor)], "event_type string, allowed boolean, reason string, files array<string>, actor string")
    row.select(F.uuid().alias("audit_id"), F.current_timestamp().alias("at"), "*").write.mode("append").json(path)


def read_json(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """JSON documents that may span lines."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def read_yaml(spark: SparkSession, path: str, schema) -> DataFrame:
    """YAML documents as rows of a schema, one document a file; files are read by Spark and parsed in the executors."""
    import json

    def parse(frames):
        import pandas as pd
        import yaml  # of the cluster's Python; a clear error where it is not installed

        for frame in frames:
            yield pd.DataFrame({"json": [json.dumps(yaml.safe_load(bytes(c)), ensure_ascii=False, default=str) for c in frame["content"]]})

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(parse, "json string").select(F.from_json("json", schema).alias("x")).select("x.*")
