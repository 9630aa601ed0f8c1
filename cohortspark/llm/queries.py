"""Queries over the test tables, one per operator, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortspark.llm import (embeddings, langid, lexical, licenses, mixing, perplexity, pieces, secrets, sharding, simhash, toxicity, warc,
                             whitening)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Where the vocabulary of operator 1 lies; another path can be given to its functions.
PIECE_MODEL = "piece_bpe_32k.model"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(PIECE_MODEL)


@_query
def op1_sentencepiece(spark, folder):
    return pieces.digests(_table(spark, folder, "documents"), model_path())


@_query
def op2_perplexity(spark, folder):
    return perplexity.judge(_table(spark, folder, "documents"))


@_query
def op3_language(spark, folder):
    return langid.languages(_table(spark, folder, "documents"))


@_query
def op4_vectors(spark, folder):
    return embeddings.near_vectors(_table(spark, folder, "embeddings"))


@_query
def op5_sharding(spark, folder):
    return sharding.assign(_table(spark, folder, "documents"), sharding.even_tree(40))


@_query
def op6_simhash(spark, folder):
    found = simhash.near_copies(_table(spark, folder, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


@_query
def op7_mixing(spark, folder):
    return mixing.mix(_table(spark, folder, "documents"))


@_query
def op8_secrets(spark, folder):
    return secrets.digests(_table(spark, folder, "documents"))


@_query
def op9_licenses(spark, folder):
    return licenses.summary(_table(spark, folder, "documents"))


ORACLES["op9_licenses"] = licenses.summary_sql()
ORACLES["op7_mixing"] = mixing.mix_sql()
ORACLES["op5_sharding"] = sharding.assign_sql(sharding.even_tree(40))


@_query
def op10_toxicity(spark, folder):
    return toxicity.score(_table(spark, folder, "documents"), _table(spark, folder, "labels"))
ORACLES["op3_language"] = langid.languages_sql()


@_query
def op11_warc(spark, folder):
    return warc.round_trip(_table(spark, folder, "pages"))


ORACLES["op11_warc"] = warc.round_trip_sql()


@_query
def op12_lexical(spark, folder):
    return lexical.ranked(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


ORACLES["op12_lexical"] = lexical.ranked_sql()


@_query
def op13_whitening(spark, folder):
    return whitening.whitened(_table(spark, folder, "embeddings"))
