"""Vectors to clusters, comparison with clusters of the structured columns, and subgroup reruns."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F, types as T

from cohortspark.functions.text import contains_text
from cohortspark.operators import density, features as feat, graph, layout as lay, neighbors, spectral
from cohortspark.operators.joins import members, with_outcomes
from cohortspark.operators.summary import cluster_summary, concordance, contingency, noise_summary
from cohortspark.runtime import cut, together
from cohortspark.sources.readers import to_whole_id
from cohortspark.sources.writers import manifest_json


def cluster_points(points: DataFrame, min_cluster_size: int = 50, min_samples: int = 10, epsilon: float = 0.0) -> DataFrame:
    """Density clusters of (id, vec) in low dimensions: (id, cluster_label, cluster_probability). Ids may be of any type."""
    if not isinstance(points.schema["id"].dataType, T.LongType):
        points, numbers = numbered(points)
        found = cluster_points(points, min_cluster_size, min_samples, epsilon)
        return named_again(found, numbers)
    points = cut(points.select("id", "vec"))
    knn = cut(graph.knn_graph(points, min_samples, "euclidean"))
    edges = graph.mutual_reachability(knn, min_samples)
    core = graph.core_distances(knn, min_samples)
    radius = knn.groupBy(F.col("src").alias("id")).agg(F.max("dist").alias("radius"))
    tree = graph.spanning_tree(edges, points.select("id"), cut(points.join(core, "id")), cut(radius))
    return cut(density.density_clusters(tree, points.select("id"), min_cluster_size, epsilon))


def numbered(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, vec) with dense numbers for ids, and the numbers (id, ix)."""
    numbers = neighbors.dense_ids(points.select("id"))
    return cut(points.join(numbers, "id").select(F.col("ix").alias("id"), "vec")), numbers


def named_again(df: DataFrame, numbers: DataFrame) -> DataFrame:
    """The caller's ids in place of the numbers."""
    named = numbers.select(F.col("ix").alias("id"), F.col("id").alias("_id"))
    return df.join(named, "id").select(F.col("_id").alias("id"), *[c for c in df.columns if c != "id"])


def phenotype(vectors: DataFrame, dims: int = 3, viz_dims: int = 2, n_neighbors: int = 15, min_dist: float = 0.1,
              metric: str = "cosine", min_cluster_size: int = 50, min_samples: int = 10, epsilon: float = 0.0,
              seed: int = 42, epochs: int = lay.EPOCHS, outcomes: DataFrame | None = None,
              id_col: str = "id", vec_col: str = "vec", init: str = "components") -> dict[str, DataFrame]:
    """Neighbour graph once, a layout for clustering and a separate one for display, density clusters.

    Layouts start from principal components, or with ``init`` "spectral" from the leading vectors of the neighbour graph.
    Returns labels, coords (clustering), display, summary, noise and params.
    """
    if init not in ("components", "spectral"):
        raise ValueError(f"unknown start {init}")
    points, numbers = numbered(vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
                               .filter(F.col("id").isNotNull() & F.col("vec").isNotNull()))
    knn = cut(graph.knn_graph(points, n_neighbors, metric))
    weights = cut(graph.fuzzy_graph(knn, n_neighbors))
    start = None
    if init == "spectral":
        leading = spectral.leading_vectors(weights, max(dims, viz_dims))[0].withColumnRenamed("vector", "pc")
        start = cut(points.select("id").join(leading, "id", "left").withColumn("pc", F.coalesce("pc", F.array().cast("array<double>"))))

    def clustered() -> tuple[DataFrame, DataFrame]:
        space = cut(lay.layout(weights, points, dims, min_dist, epochs, seed, start=start))
        return space, cluster_points(space.select("id", F.col("y").alias("vec")), min_cluster_size, min_samples, epsilon)

    # the layout for display does not wait for the clusters
    (space, labels), flat = together(vectors.sparkSession, [
        clustered, lambda: cut(lay.layout(weights, points, viz_dims, min_dist, epochs, seed + 1, start=start))])
    labels, space, flat = (cut(named_again(df, numbers)) for df in (labels, space, flat))
    labels_out = labels if outcomes is None else with_outcomes(labels, outcomes, "id")
    noise = noise_summary(labels)
    coords = space.select("id", *[F.get("y", F.lit(i)).alias(f"umap_c{i + 1}") for i in range(dims)])
    names = ["umap_x", "umap_y"] + [f"umap_d{i + 1}" for i in range(2, viz_dims)]
    display = flat.select("id", *[F.get("y", F.lit(i)).alias(names[i]) for i in range(viz_dims)])
    found = noise.first()
    stats = points.agg(F.count("*").alias("n_samples"), F.first(F.size("vec")).alias("embedding_dim"))
    params = manifest_json(stats, n_clusters=found["n_clusters"], noise_fraction=found["noise_fraction"], n_components=dims,
                           viz_components=viz_dims, n_neighbors=n_neighbors, min_dist=min_dist, metric=metric,
                           min_cluster_size=min_cluster_size, min_samples=min_samples, epsilon=epsilon, seed=seed, epochs=epochs)
    return {"labels": labels_out, "coords": coords, "display": display, "noise": noise, "params": params,
            "summary": cluster_summary(labels, "id")}


def kmeans_range(scores: DataFrame, ks: list[int], seed: int = 42, starts: int = 10, id_col: str = "id",
                 vec_col: str = "pc", max_iter: int = 100) -> tuple[DataFrame, list[tuple[int, float]]]:
    """One label column kmeans_k{k}_label per k (the best of ``starts`` starts), and (k, cost)."""
    data = cut(scores.select(F.col(id_col).alias("id"), array_to_vector(vec_col).alias("features")))
    labels, costs = data, []
    tries = [(k, seed + i) for k in sorted(set(ks)) for i in range(starts)]

    def fit(k, at):
        return lambda: KMeans(k=k, seed=at, maxIter=max_iter, predictionCol=f"kmeans_k{k}_label").fit(data)

    models = together(scores.sparkSession, [fit(k, at) for k, at in tries])
    for k in sorted(set(ks)):
        best = min((m for (j, _), m in zip(tries, models) if j == k), key=lambda m: m.summary.trainingCost)
        costs.append((k, float(best.summary.trainingCost)))
        labels = best.transform(labels)
    return labels.drop("features"), costs


def compare(features: DataFrame, labels: DataFrame, key: str, wanted: list[str], binary: list[str],
            ks: list[int] | None = None, selected_k: int = 17, n_components: int = 50, n_neighbors: int = 15,
            min_dist: float = 0.1, min_cluster_size: int = 30, min_samples: int = 5, seed: int = 42, starts: int = 10,
            epochs: int = lay.EPOCHS) -> dict[str, DataFrame]:
    """Clusters of the structured columns and their agreement with the given labels.

    Imputed, continuous columns scaled; principal components with k-means for each k; layout with
    density clusters. Contingency tables keep noise, the agreement scores leave it out.
    """
    ks = sorted(set(ks or [2, 3, 4, 5, 6, 7, 8]) | {selected_k})
    frame, used = feat.feature_frame(features, labels, key, wanted, "continuous", binary, drop_noise=False)
    frame = cut(frame.select(F.col(key).alias("id"), F.col("cluster_label").alias("given"),
                             F.array(*[F.col(c) for c in used]).alias("vec")))
    n = frame.count()

    def by_means() -> tuple:
        scores, ratios = lay.principal_components(frame, min(n_components, n, len(used)))
        km, costs = kmeans_range(scores, ks, seed, starts)
        return cut(frame.select("id", "given").join(km, "id")), costs, ratios

    def by_density() -> dict[str, DataFrame]:
        return phenotype(frame.select("id", "vec"), n_neighbors=n_neighbors, min_dist=min_dist, metric="euclidean",
                         min_cluster_size=min_cluster_size, min_samples=min_samples, seed=seed, epochs=epochs)

    # both are many small jobs in a row, and neither needs the other
    (km, costs, ratios), structured = together(features.sparkSession, [by_means, by_density])
    both = frame.select("id", "given").join(structured["labels"].select("id", F.col("cluster_label").alias("structured")), "id")
    tables = [(f"embedding_vs_kmeans_k{k}", km, f"kmeans_k{k}_label") for k in ks]
    tables.append(("embedding_vs_structured_umap_hdbscan", cut(both), "structured"))
    agreement = reduce(DataFrame.unionByName, [concordance(df, "given", col, name) for name, df, col in tables])
    crossed = reduce(DataFrame.unionByName, [
        contingency(df, "given", col).select(F.lit(name).alias("comparison_pair"), "label_a",
                                             F.col("label_b").cast("long").alias("label_b"), "n")
        for name, df, col in tables])
    spark = features.sparkSession
    return {"concordance": agreement, "contingency": crossed, "kmeans_labels": km.drop("given"),
            "selected": km.select("id", F.col(f"kmeans_k{selected_k}_label").alias("cluster_label")),
            "structured": structured["labels"], "coords": structured["coords"], "display": structured["display"],
            "costs": spark.createDataFrame(costs, "k int, cost double"),
            "variance": explained_variance(spark, ratios)}


def explained_variance(spark, ratios: list[float]) -> DataFrame:
    """component, ratio, cumulative ratio (one row per component)."""
    rows, total = [], 0.0
    for i, r in enumerate(ratios, 1):
        total += r
        rows.append((i, r, total))
    return spark.createDataFrame(rows, "component int, ratio double, cumulative_ratio double")


def subgroup_ids(features: DataFrame, column: str, pattern: str, key: str, regex: bool = False) -> DataFrame:
    """Ids whose ``column`` contains the pattern, ignoring case; null never matches."""
    hit = contains_text(F.col(column).cast("string"), pattern, regex)
    return features.filter(hit).select(to_whole_id(F.col(key)).alias(key)).dropna().distinct()


def subgroup(vectors: DataFrame, features: DataFrame, column: str, pattern: str, key: str = "id", regex: bool = False,
             min_cluster_size: int = 20, min_samples: int = 5, **options) -> dict[str, DataFrame]:
    """The same clustering on the vectors of one subgroup; nothing is embedded again."""
    ids = subgroup_ids(features, column, pattern, key, regex)
    chosen = members(vectors, ids, key)
    if chosen.isEmpty():
        raise ValueError(f"no vector belongs to {column} ~ {pattern}")
    return phenotype(chosen, id_col=key, min_cluster_size=min_cluster_size, min_samples=min_samples, **options)
