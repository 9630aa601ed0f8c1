"""Documents to training ids: language, near copies, secrets, mixture, pieces. Each stage is written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortspark.llm import langid, mixing, pieces, queries, secrets, simhash
from cohortspark.runtime import ensure_checkpoint_dir

#: No SQL expresses the language profiles and piece ids; tests/llm/test_pipeline.py holds the stages against plain Python.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that labels name. Those without a text or a letter go, and those far from every language.

    Repeated rows stay repeated; an empty table stays empty; other columns are carried along, whatever their names.
    """
    return langid.decided(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id; of repeated rows one. Rows without an id stay."""
    return simhash.one_of_each(docs)


def clean_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with live-looking secrets replaced; widely copied examples stay. Null and empty texts stay as they are."""
    return secrets.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them: none to three equal rows. Null and empty texts have size 0; a null source is one more."""
    return mixing.mixed(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, ids, n_tokens, exact): the piece ids with the end id, and whether they decode to the text itself."""
    both = pieces.round_trip(docs, queries.model_path(), keep=["doc_id", "source", "text"])
    return both.select("doc_id", "source", "ids", F.size("ids").alias("n_tokens"),
                       (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("exact"))


STAGES = [("language", language), ("near_copies", near_copies), ("secrets", clean_secrets), ("mixture", mixture), ("pieces", encoded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each written as Parquet to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline/{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
