"""Queries that write the tables' rows as files in the shared folder and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from folioscope.plans.word_files import packed
from folioscope.sources import files, packages
from folioscope.sources.shared import shared_dir
from folioscope.sources.tables import table


def _folder(spark, name):
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def supplier_files(spark, sf_dir):
    """A canonical JSON file a supplier, with its nation and what its lines come to; name, size and hash of the files as they stand."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    rows = table(spark, sf_dir, "supplier").join(lines, F.col("l_suppkey") == F.col("s_suppkey"), "left").join(nations, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    content = F.to_json(F.struct(F.col("s_name").alias("name"), F.struct("n_lines", "quantity").alias("lines"), F.col("n_name").alias("country")), {"ignoreNullFields": "false"})
    path = _folder(spark, "supplier-files")
    files.write_files(rows.select(F.format_string("%d.json", "s_suppkey").alias("name"), content.alias("content")), path)
    return files.read_files(spark, path).select("name", F.length("content").cast("long").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


def package_headers(spark, sf_dir):
    """Documents as Word files whose header holds their first line; the headers, read without the bodies."""
    path = _folder(spark, "packages")
    files.write_files(packed(spark, sf_dir, header=True).select(F.concat("path", F.lit(".docx")).alias("name"), "content"), path, "bytes", dealt=True)
    found = packages.header_paragraphs(spark, path)
    return found.select(F.regexp_extract("path", r"([^/]+)\.docx$", 1).cast("long").alias("doc_id"), "part", "place", F.md5("text").alias("text"))


QUERIES = {f.__name__: f for f in (supplier_files, package_headers)}

SQL = {
    "supplier_files": """
        WITH l AS (SELECT l_suppkey, count(*) AS n, sum(CAST(l_quantity AS BIGINT)) AS q FROM lineitem GROUP BY ALL),
        t AS (SELECT s_suppkey, '{' || chr(10) || '  "country": ' || coalesce('"' || n_name || '"', 'null') || ',' || chr(10) || '  "lines": {' || chr(10) || '    "n_lines": ' || coalesce(CAST(n AS VARCHAR), 'null') || ',' || chr(10)
            || '    "quantity": ' || coalesce(CAST(CAST(q AS BIGINT) AS VARCHAR), 'null') || chr(10) || '  },' || chr(10) || '  "name": ' || coalesce('"' || s_name || '"', 'null') || chr(10) || '}' || chr(10) AS j
          FROM supplier LEFT JOIN l ON l_suppkey = s_suppkey LEFT JOIN nation ON n_nationkey = s_nationkey)
        SELECT s_suppkey || '.json' AS name, CAST(strlen(j) AS BIGINT) AS n_bytes, sha256(j) AS sha256 FROM t""",
    "package_headers": "SELECT doc_id, 'word/header1.xml' AS part, CAST(1 AS BIGINT) AS place, md5(string_split(coalesce(text, ''), chr(10))[1]) AS text FROM documents",
}
