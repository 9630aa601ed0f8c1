"""Nearest labelled records and the risk in their neighbourhood."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from cohortspark.functions.text import double_text, ellipsis, join_list
from cohortspark.operators import neighbors, quality
from cohortspark.operators.joins import left_one_to_one
from cohortspark.sources.readers import document_frame
from cohortspark.sources.writers import manifest_json

METRIC = "inner_product_on_l2_normalized_vectors"


def prepare(records: DataFrame, embedder: Callable[[DataFrame, str, str], DataFrame],
            text_field: str = "retrieval_text", truncate_chars: int = 0, strict: bool = True) -> dict[str, DataFrame]:
    """Documents, their unit vectors, the validation table and the manifest statistics."""
    documents = document_frame(records, text_field, truncate_chars)
    validation = quality.validate_documents(documents, "doc_id", "text_embedded", strict=strict)
    embedded = embedder(documents, "text_embedded", "embedding")
    stats = quality.text_length_manifest(documents, "text_embedded", ["timepoint", "split"])
    return {"documents": embedded, "validation": validation, "statistics": stats,
            "manifest": manifest_json(stats, text_field=text_field, faiss_metric=METRIC)}


def split_warning(documents: DataFrame, expected: str = "development") -> DataFrame:
    """Split values of a corpus that should not be there, with counts."""
    split = F.coalesce(F.col("split").cast("string"), F.lit("NA"))
    return (documents.groupBy(split.alias("split")).agg(F.count("*").alias("n")).filter(F.col("split") != expected))


def bundle_report(documents: DataFrame, vectors: DataFrame, key: str, model: str, manifest_model: str) -> DataFrame:
    """Consistency of a stored corpus: row counts, unique ids, same embedding model."""
    checks = quality.embedding_checks(documents, vectors, vectors, key)
    model_row = documents.sparkSession.createDataFrame(
        [("embedding_model_differs", int(model != manifest_model))], "check string, value long")
    return checks.unionByName(model_row)


def retrieve(queries: DataFrame, corpus: DataFrame, labels: DataFrame, k: int = 5, key: str = "doc_id",
             vec: str = "embedding", text_col: str | None = None, text_chars: int = 0, validate: bool = True,
             **search) -> DataFrame:
    """Long retrieval table: one row per query and neighbour, with both labels.

    ``queries`` and ``corpus`` carry (key, patient_uid, timepoint, split, vec); ``labels`` (key, y_true).
    """
    # a file of labels is some 50 times smaller than their hash table, so its size must not make them a broadcast
    y = labels.select(key, F.col("y_true").cast("double").alias("y_true")).hint("merge")
    attach = left_one_to_one if validate else (lambda a, b, c: a.join(b, c, "left"))
    q = attach(queries, y, key)
    c = attach(corpus, y, key)
    found = neighbors.nearest(queries, corpus, k, "cosine", key, key, vec, vec, **search)
    q_side = q.select(F.col(key).alias("query_id"), F.col("patient_uid").alias("query_patient_uid"),
                      F.col("timepoint").alias("query_timepoint"), F.col("split").alias("query_split"),
                      F.col("y_true").alias("query_y_true"))
    extra = [ellipsis(F.col(text_col), text_chars).alias("neighbor_text")] if text_col else []
    c_side = c.select(F.col(key).alias("neighbor_id"), F.col("patient_uid").alias("neighbor_patient_uid"),
                      F.col("split").alias("neighbor_split"), F.col("y_true").alias("neighbor_y_true"), *extra)
    return (found.join(q_side, "query_id").join(c_side, "neighbor_id")
            .select(F.col("query_id").alias("query_doc_id"), "query_patient_uid", "query_timepoint", "query_split",
                    "query_y_true", "rank", F.col("neighbor_id").alias("neighbor_doc_id"), "neighbor_patient_uid",
                    "neighbor_split", "neighbor_y_true", "similarity", *(["neighbor_text"] if text_col else [])))


def weighted_risk(similarity, label):
    """Label mean weighted by similarity floored at 0; plain mean when all weights are 0; null without labels."""
    weight = F.when(label.isNotNull(), F.greatest(similarity, F.lit(0.0)))
    return F.when(F.sum(weight) > 0, F.sum(weight * label) / F.sum(weight)).otherwise(F.avg(label))


def summarize(long: DataFrame, queries: DataFrame, labels: DataFrame, k: int = 5, key: str = "doc_id",
              by: list[str] | None = None) -> DataFrame:
    """One row per query, also for queries without a neighbour."""
    by = by or []
    y, sim, rank = F.col("neighbor_y_true"), F.col("similarity"), F.col("rank")
    first = rank == 1
    listed = F.sort_array(F.collect_list(F.struct(
        rank, F.col("neighbor_doc_id").cast("string").alias("id"),
        F.col("neighbor_patient_uid").cast("string").alias("uid"),
        F.col("neighbor_split").cast("string").alias("split"),
        F.coalesce(double_text(y), F.lit("nan")).alias("y"), double_text(F.round(sim, 6)).alias("sim"))))
    grouped = long.groupBy(*by, "query_doc_id").agg(
        F.count("*").alias("n_neighbors_found"),
        F.max(F.when(first, F.col("neighbor_doc_id"))).alias("top1_neighbor_doc_id"),
        F.max(F.when(first, sim)).alias("top1_similarity"), F.max(F.when(first, y)).alias("top1_neighbor_y_true"),
        F.count_if(y == 1).alias("n_positive_in_topk"), F.avg(y).alias("retrieval_neighborhood_risk_mean"),
        weighted_risk(sim, y).alias("retrieval_neighborhood_risk_weighted"), listed.alias("_l"))
    all_queries = (queries.join(labels.select(key, F.col("y_true").cast("double").alias("query_y_true")).hint("merge"), key, "left")
                   .select(*by, F.col(key).alias("query_doc_id"), F.col("patient_uid").alias("query_patient_uid"),
                           F.col("timepoint").alias("query_timepoint"), F.col("split").alias("query_split"), "query_y_true"))
    joined = all_queries.join(grouped, [*by, "query_doc_id"], "left")
    return joined.select(
        *by, "query_doc_id", "query_patient_uid", "query_timepoint", "query_split", "query_y_true",
        F.lit(k).alias("top_k"), F.coalesce("n_neighbors_found", F.lit(0)).alias("n_neighbors_found"),
        "top1_neighbor_doc_id", "top1_similarity", "top1_neighbor_y_true",
        F.coalesce("n_positive_in_topk", F.lit(0)).alias("n_positive_in_topk"),
        "retrieval_neighborhood_risk_mean", "retrieval_neighborhood_risk_weighted",
        *[F.coalesce(join_list(F.col(f"_l.{f}")), F.lit("")).alias(name) for f, name in (
            ("id", "neighbor_doc_ids"), ("uid", "neighbor_patient_uids"), ("split", "neighbor_splits"),
            ("y", "neighbor_y_true_list"), ("sim", "neighbor_similarity_list"))])


def run(queries: DataFrame, corpus: DataFrame, labels: DataFrame, k: int = 5, text_col: str | None = None,
        text_chars: int = 0, **search) -> dict[str, DataFrame]:
    """Long table, summary and length statistics of one query set against one corpus."""
    long = retrieve(queries, corpus, labels, k, text_col=text_col, text_chars=text_chars, **search)
    return {"long": long, "summary": summarize(long, queries, labels, k)}


def run_many(runs: dict[str, tuple[DataFrame, DataFrame]], labels: DataFrame, k: int = 5, **search) -> dict[str, DataFrame]:
    """Several (query set, corpus) pairs as one table with a ``dataset`` column."""
    longs, summaries = [], []
    for name, (queries, corpus) in runs.items():
        one = run(queries, corpus, labels, k, **search)
        longs.append(one["long"].withColumn("dataset", F.lit(name)))
        summaries.append(one["summary"].withColumn("dataset", F.lit(name)))
    long, summary = longs[0], summaries[0]
    for a, b in zip(longs[1:], summaries[1:]):
        long, summary = long.unionByName(a), summary.unionByName(b)
    return {"long": long, "summary": summary}

