"""Report tables and the tables behind the figures; a missing input leaves its table out."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortspark.operators.joins import merge_tables
from cohortspark.operators.metrics import fold_summary
from cohortspark.operators.summary import top_overall, top_per_group


def characterization(summary: DataFrame, mortality: DataFrame | None = None) -> DataFrame:
    """Cluster sizes with outcome columns; a cluster known to one side only is kept."""
    left = summary.withColumnRenamed("cluster_label", "cluster")
    if mortality is None:
        return left
    return merge_tables(left.withColumnRenamed("n", "n_clustered"), mortality, "cluster")


def tables(results: dict[str, DataFrame]) -> dict[str, DataFrame]:
    out = {}
    if "summary" in results:
        out["table1_cluster_characterization"] = characterization(results["summary"], results.get("mortality"))
    if "concordance" in results:
        out["table2_concordance_results"] = results["concordance"]
    if "folds" in results:
        out["table_backmapping_cv_summary"] = fold_summary(results["folds"], ["macro_auroc", "macro_recall"])
        if "classes" in results:
            out["table_backmapping_class_performance"] = results["classes"]
        if "importance" in results:
            out["table_backmapping_top_features"] = top_overall(results["importance"], "importance", "feature", 20)
    if "cox" in results:
        out["table_mortality_cox_results"] = results["cox"]
    return out


def plot_data(results: dict[str, DataFrame]) -> dict[str, DataFrame]:
    out = {}
    if "display" in results and "labels" in results:
        out["fig2_umap_clusters"] = results["display"].join(results["labels"].select("id", "cluster_label"), "id")
    if "attribution_summary" in results:
        out["fig3_shap_per_cluster"] = top_per_group(results["attribution_summary"], "cluster", "mean_abs_shap", "feature", 15)
    if "cumulative_incidence" in results:
        out["fig4_cumulative_incidence"] = results["cumulative_incidence"].select("cluster", "time", "cumulative_incidence")
    if "early" in results and "late" in results:
        out["fig5_early_late_mortality"] = (
            results["early"].select(F.lit("early").alias("period"), "cluster", "mortality_rate")
            .unionByName(results["late"].select(F.lit("late").alias("period"), "cluster", "mortality_rate")))
    return out
