"""Imputation, scaling, feature frames and stratified folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cohortspark.operators.ordered import WINDOW_ROWS, exact_quantiles, hashed_row_number
from cohortspark.runtime import cut, present

# The structured columns compared with the text clusters, and the 0/1 coded ones.
STRUCTURED_FEATURES = [
    "age_at_test", "sex", "charlson_score", "SBP", "RR", "PR", "Body_temperature", "GCS_2",
    "WBC_Count", "CRP", "Creatinine", "T_Bilirubin", "PLT_Count", "Albumin", "Hemoglobin",
    "icu", "Vasopressin_any", "sofa_score_2", "quick_sofa_score_2",
    "BSI_episode_3GCR", "BSI_episode_CarbaR", "BSI_episode_MRSA", "BSI_episode_VRE",
    "is_empiric_tt_excessivelylarge", "VRE_colonization", "CRE_colonization",
]
BINARY_FEATURES = [
    "sex", "icu", "Vasopressin_any",
    "BSI_episode_3GCR", "BSI_episode_CarbaR", "BSI_episode_MRSA", "BSI_episode_VRE",
    "is_empiric_tt_excessivelylarge", "VRE_colonization", "CRE_colonization",
]


def numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Listed columns as doubles, NaN as null. Text columns are refused, not silently emptied."""
    for name in columns:
        if df.schema[name].dataType.typeName() in ("string", "date", "timestamp"):
            raise ValueError(f"feature {name} must be numeric")
    return df.withColumns({c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in columns})


def melt(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    return df.unpivot(keep, columns, "feature", "value")


def medians(df: DataFrame, columns: list[str], window_rows: int = WINDOW_ROWS) -> DataFrame:
    """(feature, median) of every column in one pass; even counts average the middle two."""
    return exact_quantiles(melt(df.select(*columns), columns, []), ["feature"], "value", {"median": 0.5}, window_rows)


def impute_medians(df: DataFrame, columns: list[str], window_rows: int = WINDOW_ROWS) -> DataFrame:
    """Null values replaced by the exact column median (one value per column reaches the driver)."""
    fill = {r["feature"]: r["median"] for r in medians(df, columns, window_rows).collect()}
    return df.na.fill({c: v for c, v in fill.items() if v is not None})


def standardize(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / population deviation; a constant column is only centred."""
    stats = df.agg(*[F.avg(c).alias(f"a_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    scaled = {}
    for c in columns:
        mean, dev = stats[f"a_{c}"], stats[f"s_{c}"]
        if mean is not None:
            scaled[c] = (F.col(c) - F.lit(mean)) / F.lit(dev if dev else 1.0)
    return df.withColumns(scaled)


def feature_frame(features: DataFrame, labels: DataFrame, key: str, wanted: list[str], scale: str = "none",
                  binary: list[str] | None = None, label: str = "cluster_label", drop_noise: bool = True,
                  window_rows: int = WINDOW_ROWS) -> tuple[DataFrame, list[str]]:
    """Labelled, imputed and optionally scaled ("none", "all", "continuous") features.

    Returns the frame (key, label, features) and the names of the columns that were present.
    """
    used = present(features, wanted)
    joined = numeric(features.select(key, *used), used).join(labels.select(key, label), key)
    if drop_noise:
        joined = joined.filter(F.col(label) != -1)
    out = impute_medians(cut(joined), used, window_rows)
    if scale == "all":
        out = standardize(out, used)
    elif scale == "continuous":
        out = standardize(out, [c for c in used if c not in set(BINARY_FEATURES if binary is None else binary)])
    return out, used


def stratified_folds(df: DataFrame, key: str, label: str, k: int = 5, seed: int = 42, name: str = "fold") -> DataFrame:
    """Fold 0..k-1, sizes per class differ by at most one; the order inside a class is a seeded hash."""
    numbered = hashed_row_number(df, [label], F.xxhash64(F.lit(seed), F.col(key)), key, "_rn")
    return numbered.withColumn(name, F.pmod(F.col("_rn") - 1, F.lit(k)).cast("int")).drop("_rn")
