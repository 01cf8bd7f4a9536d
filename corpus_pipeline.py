"""A training-corpus pipeline of five stages over the table `documents`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is
written as Parquet and read again as the next stage's documents.  All but the
last return the columns that came in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioscope.llm import decontam, langid, mixing, simhash, token_ids
from folioscope.llm.common import crc_mod, scratch_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that language identification rejects; learns from the labelled ones that are not held out.

    Null and empty texts and those without a letter are rejected, as is all
    where nothing is labelled.  A null language teaches nothing; a null id is
    not held out.  Rows that repeat are kept or dropped alike.
    """
    model = langid.fit(docs.filter(crc_mod("doc_id") != 0))
    return langid.accepted(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near-duplicates the document with the smallest id, nulls last.

    Ties of the id go to the smaller hash of the text, and of rows that repeat
    both one stays.  Null texts and texts without words are one group.
    """
    return simhash.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold four fifths or more of a benchmark item.

    Null and empty texts hold nothing and stay; null and empty items are held
    by nothing.  Rows that repeat are kept or dropped alike.
    """
    return decontam.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws the sources towards their targets; a document taken twice stands twice.

    Null sources are a source of their own and null texts have size 0, but are
    drawn like others of their source.  Rows that repeat are drawn one by one.
    """
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token ids of what is left and returns their index, read from the files.

    Null ids come first, rows that repeat an id side by side; a null text has
    the end id alone.
    """
    return token_ids.encode_documents(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: No stage but the mixture can be said in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each reread from what the one before wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = scratch_path(spark, f"pipeline-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
