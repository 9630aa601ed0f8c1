"""Rank and recall metrics on long prediction tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortspark.operators.ordered import WINDOW_ROWS, plan_buckets, running
from cohortspark.runtime import cut


def average_ranks(scores: DataFrame, group: list[str], score: str = "score",
                  window_rows: int = WINDOW_ROWS) -> DataFrame:
    """One row per (group, distinct score): n, n_pos and the average rank its ties share.

    Counting distinct scores first keeps heavy ties out of the running sum.
    """
    counts = cut(scores.groupBy(*group, F.col(score).alias("score"))
                 .agg(F.count("*").alias("n"), F.sum(F.col("positive").cast("long")).alias("n_pos")))
    before = running(counts, group, "score", {"_before": "n"}, plan_buckets(counts, "score", window_rows), inclusive=False)
    return before.withColumn("average_rank", F.col("_before") + (F.col("n") + 1) / 2).drop("_before")


def auroc(scores: DataFrame, group: list[str], score: str = "score", window_rows: int = WINDOW_ROWS) -> DataFrame:
    """Area under the ROC curve per group (Mann-Whitney); null when a class is absent."""
    ranks = average_ranks(scores, group, score, window_rows)
    sums = ranks.groupBy(*group).agg(F.sum("n").alias("n"), F.sum("n_pos").alias("n_pos"),
                                     F.sum(F.col("average_rank") * F.col("n_pos")).alias("_r"))
    pos, neg = F.col("n_pos"), F.col("n") - F.col("n_pos")
    area = F.try_divide(F.col("_r") - pos * (pos + 1) / 2, pos * neg)
    return sums.select(*group, "n", "n_pos", area.cast("double").alias("auroc"))


def one_vs_rest(predictions: DataFrame, keep: list[str]) -> DataFrame:
    """(keep..., class, score, positive) from rows with ``truth`` and an array of (class, prob)."""
    exploded = predictions.select(*keep, "truth", F.explode("probs").alias("p"))
    return exploded.select(*keep, F.col("p.class").alias("class"), F.col("p.prob").alias("score"),
                           (F.col("truth") == F.col("p.class")).alias("positive"))


def class_recall(predictions: DataFrame, group: list[str], truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """Recall per class over classes seen as truth or as prediction; 0 for a class never true."""
    cells = (predictions.groupBy(*group, F.col(truth).alias("t"), F.col(predicted).alias("p"))
             .agg(F.count("*").alias("c")))
    sides = cells.select(*group, "c", F.explode(F.array(
        F.struct(F.col("t").alias("class"), F.lit(1).alias("is_true"), (F.col("t") == F.col("p")).cast("int").alias("hit")),
        F.struct(F.col("p").alias("class"), F.lit(0).alias("is_true"), F.lit(0).alias("hit")))).alias("s"))
    return (sides.groupBy(*group, F.col("s.class").alias("class"))
            .agg(F.sum(F.col("c") * F.col("s.is_true")).alias("n"), F.sum(F.col("c") * F.col("s.hit")).alias("hits"))
            .select(*group, "class", "n", F.coalesce(F.try_divide("hits", "n"), F.lit(0.0)).alias("recall")))


def macro_recall(predictions: DataFrame, group: list[str], truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    return class_recall(predictions, group, truth, predicted).groupBy(*group).agg(F.avg("recall").alias("macro_recall"))


def macro_auroc(per_class: DataFrame, group: list[str], binary: bool = False) -> DataFrame:
    """Mean one-vs-rest area; null as soon as one class has none. Two classes: the second one's area."""
    if binary:
        return per_class.groupBy(*group).agg(F.max_by("auroc", "class").alias("macro_auroc"))
    return per_class.groupBy(*group).agg(
        F.when(F.count("auroc") == F.count("*"), F.avg("auroc")).alias("macro_auroc"))


def fold_summary(folds: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean and sample deviation of each fold metric, three digits."""
    long = folds.unpivot([], metrics, "metric", "value")
    return long.groupBy("metric").agg(F.round(F.avg("value"), 3).alias("mean"), F.round(F.stddev_samp("value"), 3).alias("std"))
