"""Text ids work wherever whole-number ids do, with the same result."""

import re

import numpy as np
from pyspark.sql import functions as F

from cohortspark.operators import graph, neighbors
from cohortspark.plans import embedding, phenotypes, retrieval
from cohortspark.runtime import cut, discard


def both(spark, n=60, d=5):
    x = np.random.default_rng(8).normal(size=(n, d))
    x[10:14] = x[10]
    rows = [(i, f"doc-{i:03}", [float(v) for v in row]) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "n long, id string, vec array<double>")


def test_neighbours_and_graph(spark):
    df = both(spark)
    a = neighbors.nearest(df, df, 4, query_id="n", corpus_id="n", exclude_same_id=True).collect()
    b = neighbors.nearest(df, df, 4, exclude_same_id=True).collect()
    assert sorted((f"doc-{r['query_id']:03}", r["rank"], f"doc-{r['neighbor_id']:03}") for r in a) == sorted((r["query_id"], r["rank"], r["neighbor_id"]) for r in b)
    knn = cut(graph.knn_graph(df, 5))
    weights = graph.fuzzy_graph(knn, 5)
    assert dict(weights.dtypes)["src"] == "string" and weights.count() == graph.fuzzy_graph(cut(graph.knn_graph(df, 5, id_col="n")), 5).count()


def test_clusters(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=(40, 2)) * 0.3 + c for c in ((0, 0), (9, 9))])
    rows = [(f"p{i:02}", [float(v) for v in row]) for i, row in enumerate(x)]
    labels = {r["id"]: r["cluster_label"] for r in phenotypes.cluster_points(spark.createDataFrame(rows, "id string, vec array<double>"), 20, 4).collect()}
    assert len({labels[f"p{i:02}"] for i in range(40)} - {-1}) == 1 and labels["p01"] != labels["p50"]


def test_retrieval_from_prepared_documents(spark):
    records = spark.createDataFrame([(f"D{i}", f"P{i % 3}", "t", "development", f"word{i % 4} other text number {i}") for i in range(12)],
                                    "doc_id string, patient_uid string, timepoint string, split string, retrieval_text string")
    made = retrieval.prepare(records, embedding.HashedTextEmbedder(32))
    labels = records.selectExpr("doc_id", "CAST(substring(doc_id, 2) % 2 AS double) AS y_true")
    found = retrieval.run(made["documents"], made["documents"], labels, 3)
    assert found["long"].count() == 36 and found["summary"].filter("top1_neighbor_doc_id = query_doc_id").count() == 12


def test_a_discarded_table_is_gone(spark):
    import os

    df = cut(spark.range(3))
    path = df._table_path.removeprefix("file:")
    assert os.path.isdir(path)
    discard(df)
    assert not os.path.exists(path)


def test_numbers_and_labels_are_not_broadcast(spark):
    """Their files are some 50 times smaller than their hash tables, so they grow past the driver's memory while the planner takes them for small."""
    df = both(spark).select(F.col("id").alias("doc_id"), F.lit("p").alias("patient_uid"), F.lit("t").alias("timepoint"), F.lit("s").alias("split"), F.col("vec").alias("embedding"))
    corpus = cut(df)
    labels = cut(df.select("doc_id", F.lit(1.0).alias("y_true")))
    points, numbers = phenotypes.numbered(corpus.selectExpr("doc_id AS id", "embedding AS vec"))
    for found in (retrieval.run(corpus, corpus, labels, 3)["summary"], phenotypes.named_again(points, numbers)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        by_id = {join: set(re.findall(rf"{join} \[(\w+)#", plan)) & {"doc_id", "id", "query_id", "neighbor_id"} for join in ("SortMergeJoin", "BroadcastHashJoin")}
        assert by_id["SortMergeJoin"] and not by_id["BroadcastHashJoin"]
