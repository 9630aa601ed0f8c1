"""Cluster summaries, contingency, agreement and top-N tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

NOISE = -1
#: Columns of a wide table.
MOST_COLUMNS = 1000


def cluster_summary(labels: DataFrame, id_col: str, label: str = "cluster_label",
                    probability: str = "cluster_probability") -> DataFrame:
    return labels.groupBy(label).agg(F.count(id_col).alias("n"), F.avg(probability).alias("mean_probability"))


def noise_summary(labels: DataFrame, label: str = "cluster_label") -> DataFrame:
    """Cluster count without noise and the fraction of noise rows."""
    return labels.agg(F.count_distinct(F.when(F.col(label) != NOISE, F.col(label))).alias("n_clusters"),
                      F.avg((F.col(label) == NOISE).cast("int")).alias("noise_fraction"))


def cluster_sizes(labels: DataFrame, label: str = "cluster_label") -> DataFrame:
    return labels.groupBy(label).agg(F.count("*").alias("n"))


def contingency(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Long contingency table; noise is a label like any other here."""
    return pairs.groupBy(F.col(a).alias("label_a"), F.col(b).alias("label_b")).agg(F.count("*").alias("n"))


def known_labels(df: DataFrame, column: str, wanted: list | None = None, most: int = MOST_COLUMNS) -> list:
    """The labels of a column in order, null left out; ``wanted`` ones may be more, but a label not among them is an error."""
    found = sorted(r[0] for r in df.select(column).filter(F.col(column).isNotNull()).distinct().limit(most + 1).collect())
    if len(found) > most:
        raise ValueError(f"{column} has more than {most} labels")
    if wanted is None:
        return found
    unknown = set(found) - set(wanted)
    if unknown:
        raise ValueError(f"labels of {column} that are not listed: {sorted(unknown)}")
    return list(wanted)


def contingency_wide(pairs: DataFrame, a: str, b: str, columns: list | None = None) -> DataFrame:
    """Crosstab with one column per label of ``b`` (or the given ones, which have to hold all labels), 0 for empty cells.
    A null label of ``b`` has no column."""
    labels = known_labels(pairs, b, columns)
    return pairs.groupBy(F.col(a).alias("label_a")).pivot(b, labels).agg(F.count(F.lit(1))).na.fill(0)


def concordance(pairs: DataFrame, a: str, b: str, name: str | None = None) -> DataFrame:
    """Adjusted Rand index and normalised mutual information over rows without noise on either side.

    Works on contingency counts only. No rows: null scores and n_compared 0.
    """
    kept = pairs.filter((F.col(a) != NOISE) & (F.col(b) != NOISE))
    cells = contingency(kept, a, b)

    def choose2(c):
        return c * (c - 1) / 2

    def tagged(df, tag):
        return df.select(F.lit(tag).alias("tag"), F.col("n").cast("double").alias("m"))

    # cells and both margins in one table, one aggregate over it
    parts = (tagged(cells, "cell").unionByName(tagged(cells.groupBy("label_a").agg(F.sum("n").alias("n")), "a"))
             .unionByName(tagged(cells.groupBy("label_b").agg(F.sum("n").alias("n")), "b")))

    def over(tag, value):
        return F.coalesce(F.sum(F.when(F.col("tag") == tag, value)), F.lit(0.0))

    m = F.col("m")
    one = parts.agg(over("cell", m).alias("n"), over("cell", choose2(m)).alias("pij"), over("cell", m * F.log(m)).alias("nlogn"),
                    over("a", choose2(m)).alias("pa"), over("a", m * F.log(m)).alias("la"),
                    F.count_if(F.col("tag") == "a").alias("ka"), over("b", choose2(m)).alias("pb"),
                    over("b", m * F.log(m)).alias("lb"), F.count_if(F.col("tag") == "b").alias("kb"))
    n = F.col("n")
    total = choose2(n)
    expected = F.try_divide(F.col("pa") * F.col("pb"), total)
    best = (F.col("pa") + F.col("pb")) / 2
    trivial = ((F.col("ka") == 1) & (F.col("kb") == 1)) | ((F.col("ka") == n) & (F.col("kb") == n))
    ari = (F.when(n == 0, None).when(trivial, 1.0)
           .otherwise(F.try_divide(F.col("pij") - expected, best - expected)))
    ha, hb = F.log(n) - F.col("la") / n, F.log(n) - F.col("lb") / n
    mutual = F.greatest(F.log(n) + (F.col("nlogn") - F.col("la") - F.col("lb")) / n, F.lit(0.0))
    nmi = (F.when(n == 0, None).when((F.col("ka") == 1) & (F.col("kb") == 1), 1.0)
           .when((F.col("ka") == 1) | (F.col("kb") == 1), 0.0)
           .otherwise(F.try_divide(mutual, (ha + hb) / 2)))
    pair_name = name or f"{a}_vs_{b}"
    return one.select(F.lit(pair_name).alias("comparison_pair"), ari.cast("double").alias("ari"),
                      nmi.cast("double").alias("nmi"), n.cast("long").alias("n_compared"))


def top_per_group(df: DataFrame, group: str, by: str, tie: str, n: int = 15) -> DataFrame:
    """The ``n`` largest per group; the rank filter is pushed below the shuffle by Catalyst."""
    w = Window.partitionBy(group).orderBy(F.col(by).desc(), F.col(tie).asc())
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def top_overall(df: DataFrame, by: str, tie: str, n: int = 20) -> DataFrame:
    return df.orderBy(F.col(by).desc(), F.col(tie).asc()).limit(n)


def first_ids(df: DataFrame, key: str, n: int | None = None) -> DataFrame:
    """Distinct non-null ids in order, at most ``n`` (None or 0: all)."""
    ids = df.select(key).filter(F.col(key).isNotNull()).distinct()
    return ids.orderBy(key).limit(n) if n else ids


def mean_importance(df: DataFrame, feature: str = "feature", value: str = "importance") -> DataFrame:
    return df.groupBy(feature).agg(F.avg(value).alias(value))


def mean_abs_attribution(phi: DataFrame) -> DataFrame:
    """Mean |phi| per cluster and feature, over each cluster's own rows and own class only."""
    own = phi.filter(F.col("class") == F.col("cluster"))
    return own.groupBy("cluster", "feature").agg(F.avg(F.abs("phi")).alias("mean_abs_shap"))
