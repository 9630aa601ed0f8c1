import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from cohortspark.operators import features as feat, metrics
from cohortspark.operators.ordered import exact_quantiles, global_row_number, hashed_row_number, plan_buckets, running


def skewed(spark, n=3000):
    """One key holds more than a third of the rows, one value is heavily repeated."""
    rng = np.random.default_rng(1)
    key = np.where(rng.random(n) < 0.5, 0, rng.integers(1, 6, n))
    value = np.where(rng.random(n) < 0.35, 7.0, rng.integers(0, 900, n) / 4.0)
    return pd.DataFrame({"g": key, "v": value, "id": np.arange(n)})


def test_running_two_levels_equal_one_window(spark):
    pdf = skewed(spark).groupby(["g", "v"]).size().rename("c").reset_index()
    df = spark.createDataFrame(pdf)
    small, big = plan_buckets(df, "v"), plan_buckets(df, "v", window_rows=100)
    assert not small.bounds and len(big.bounds) > 10
    for descending in (False, True):
        for inclusive in (False, True):
            a = running(df, ["g"], "v", {"s": "c"}, small, descending, inclusive).toPandas()
            b = running(df, ["g"], "v", {"s": "c"}, big, descending, inclusive).toPandas()
            keys = ["g", "v"]
            assert a.sort_values(keys)["s"].tolist() == b.sort_values(keys)["s"].tolist()
            if inclusive and not descending:
                want = pdf.sort_values(keys).groupby("g")["c"].cumsum()
                assert a.sort_values(keys)["s"].tolist() == want.tolist()


def test_row_numbers(spark):
    df = spark.createDataFrame(skewed(spark)).repartition(7)
    got = global_row_number(df, [F.col("v").desc(), "id"], "rn").toPandas().sort_values("rn")
    want = skewed(spark).sort_values(["v", "id"], ascending=[False, True])
    assert got["rn"].tolist() == list(range(1, 3001)) and got["id"].tolist() == want["id"].tolist()
    hashed = hashed_row_number(df, ["g"], F.xxhash64("id"), "id", "rn").toPandas()
    for _, part in hashed.groupby("g"):
        assert sorted(part["rn"]) == list(range(1, len(part) + 1))


def test_quantiles_match_linear_interpolation(spark):
    pdf = skewed(spark)
    df = spark.createDataFrame(pdf).withColumn("v", F.when(F.col("id") < 3, None).when(F.col("id") < 6, float("nan")).otherwise(F.col("v")))
    for rows in (200_000, 50):
        got = exact_quantiles(df, ["g"], "v", {"m": 0.5, "p": 0.95}, rows).toPandas().set_index("g").sort_index()
        want = pdf[pdf.id >= 6].groupby("g")["v"]
        assert np.allclose(got["m"], want.median()) and np.allclose(got["p"], want.quantile(0.95))
    alone = exact_quantiles(df, [], "v", {"m": 0.5}).first()["m"]
    assert alone == pdf[pdf.id >= 6]["v"].median()
    even = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "v double")
    assert exact_quantiles(even, [], "v", {"m": 0.5}).first()["m"] == 2.5


def test_folds_are_balanced(spark):
    df = spark.createDataFrame(skewed(spark))
    a = feat.stratified_folds(df, "id", "g", 5, seed=1).toPandas()
    counts = a.groupby(["g", "fold"]).size().unstack()
    assert (counts.max(axis=1) - counts.min(axis=1)).max() <= 1 and len(a) == 3000
    b = feat.stratified_folds(df.repartition(3), "id", "g", 5, seed=1).toPandas()
    assert a.sort_values("id")["fold"].tolist() == b.sort_values("id")["fold"].tolist()
    c = feat.stratified_folds(df, "id", "g", 5, seed=2).toPandas()
    assert a.sort_values("id")["fold"].tolist() != c.sort_values("id")["fold"].tolist()


def brute_auroc(score, positive):
    pos, neg = score[positive], score[~positive]
    return np.mean([(p > neg).mean() + 0.5 * (p == neg).mean() for p in pos])


def test_auroc_with_ties(spark):
    pdf = skewed(spark, 600)
    pdf["positive"] = (pdf["id"] * 7919 % 13) < 5
    df = spark.createDataFrame(pdf.rename(columns={"v": "score"}))
    for rows in (200_000, 40):
        got = {r["g"]: r["auroc"] for r in metrics.auroc(df, ["g"], window_rows=rows).collect()}
        for g, part in pdf.groupby("g"):
            assert abs(got[g] - brute_auroc(part["v"].to_numpy(), part["positive"].to_numpy())) < 1e-12
    tied = spark.createDataFrame([(1.0, True), (1.0, False)], "score double, positive boolean")
    assert metrics.auroc(tied.withColumn("g", F.lit(1)), ["g"]).first()["auroc"] == 0.5
    missing = spark.createDataFrame([(1.0, True), (2.0, True)], "score double, positive boolean")
    assert metrics.auroc(missing.withColumn("g", F.lit(1)), ["g"]).first()["auroc"] is None


def test_recall_counts_predicted_only_classes(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "c")], "truth string, predicted string")
    assert metrics.macro_recall(df, []).first()[0] == (0.5 + 0.5 + 0.0) / 3


def test_impute_and_scale(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 2.0, 5.0), (3, float("nan"), 5.0), (4, 6.0, 5.0)], "id int, x double, k double")
    out = feat.standardize(feat.impute_medians(feat.numeric(df, ["x", "k"]), ["x", "k"]), ["x", "k"]).orderBy("id").toPandas()
    raw = np.array([1.0, 2.0, 2.0, 6.0])
    assert np.allclose(out["x"], (raw - raw.mean()) / raw.std()) and (out["k"] == 0).all()
