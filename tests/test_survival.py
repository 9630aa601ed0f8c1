import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortspark.operators import survival as sv


def make(spark, rows):
    return spark.createDataFrame(rows, "cluster long, time double, event double, competing double")


def sample(n=400, seed=3):
    rng = np.random.default_rng(seed)
    g = rng.integers(0, 3, n)
    t = np.ceil(rng.exponential(10 + 5 * g) * 2) / 2 - 1.0
    kind = rng.integers(0, 3, n)
    return pd.DataFrame({"cluster": g, "time": t, "event": (kind == 1).astype(float), "competing": (kind == 2).astype(float)})


def test_published_reference_values(spark):
    """Known incidence at days 30 and 50 on the line items of sf0.01."""
    base = "/root/testdata/sf0.01"
    try:
        items = spark.read.parquet(f"{base}/lineitem.parquet")
    except Exception:
        pytest.skip("test tables are not here")
    orders, customer = spark.read.parquet(f"{base}/orders.parquet"), spark.read.parquet(f"{base}/customer.parquet")
    df = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    frame = df.filter(F.col("l_partkey") % 17 != 0).select(
        F.col("c_mktsegment").alias("cluster"), F.col("l_quantity").alias("time"), (F.col("l_returnflag") == "R").cast("double").alias("event"),
        (F.col("l_returnflag") == "A").cast("double").alias("competing"))
    got = {(r["cluster"], r["time"]): r["cumulative_incidence"] for r in sv.cumulative_incidence(frame).collect()}
    want = {"AUTOMOBILE": (0.230251, 0.488049), "BUILDING": (0.224673, 0.484643), "FURNITURE": (0.235003, 0.492856),
            "HOUSEHOLD": (0.225619, 0.484974), "MACHINERY": (0.231793, 0.486989)}
    for cluster, (at30, at50) in want.items():
        assert abs(got[cluster, 30.0] - at30) < 1e-6 and abs(got[cluster, 50.0] - at50) < 1e-6


def test_incidence_against_brute_force(spark):
    pdf = sample()
    clipped = pdf.assign(time=pdf["time"].clip(lower=0))
    for rows in (200_000, 5):
        got = sv.cumulative_incidence(spark.createDataFrame(pdf), rows).toPandas()
        for g, part in clipped.groupby("cluster"):
            surv, c1, c2 = 1.0, 0.0, 0.0
            mine = got[got["cluster"] == g].set_index("time")
            for t in sorted(part["time"].unique()):
                n, at = (part["time"] >= t).sum(), part[part["time"] == t]
                c1, c2 = c1 + surv * at["event"].sum() / n, c2 + surv * at["competing"].sum() / n
                surv *= 1 - (at["event"].sum() + at["competing"].sum()) / n
                assert abs(mine.loc[t, "cumulative_incidence"] - c1) < 1e-12
                assert abs(mine.loc[t, "competing_incidence"] - c2) < 1e-12
            assert abs(c1 + c2 + surv - 1) < 1e-12


def test_incidence_edges(spark):
    got = sv.cumulative_incidence(make(spark, [(0, 1.0, 0.0, 0.0), (1, 2.0, 1.0, 0.0), (1, 2.0, 1.0, 0.0)])).collect()
    assert {(r["cluster"], r["time"]): r["cumulative_incidence"] for r in got} == {(0, 0.0): 0.0, (0, 1.0): 0.0, (1, 0.0): 0.0, (1, 2.0): 1.0}


def brute_logrank(pdf):
    groups = sorted(pdf["cluster"].unique())
    k = len(groups)
    diff, cov = np.zeros(k), np.zeros((k, k))
    for t in sorted(pdf.loc[pdf["event"] == 1, "time"].unique()):
        n = np.array([((pdf["cluster"] == g) & (pdf["time"] >= t)).sum() for g in groups], float)
        d = np.array([((pdf["cluster"] == g) & (pdf["time"] == t) & (pdf["event"] == 1)).sum() for g in groups], float)
        nn, dd = n.sum(), d.sum()
        diff += d - dd * n / nn
        if nn > 1:
            cov += dd * (nn - dd) / (nn * nn * (nn - 1)) * (np.diag(n) * nn - np.outer(n, n))
    return diff[1:] @ np.linalg.inv(cov[1:, 1:]) @ diff[1:]


def test_logrank(spark):
    pdf = sample()
    clipped = pdf.assign(time=pdf["time"].clip(lower=0))
    for rows in (200_000, 10):
        row = sv.logrank_k_sample(spark.createDataFrame(pdf), rows).first()
        assert row["test_statistic"] == pytest.approx(brute_logrank(clipped), rel=1e-9) and row["n_groups"] == 3
    assert row["p_value"] == pytest.approx(math.exp(-row["test_statistic"] / 2), rel=1e-9)
    assert sv.chi2_upper_tail(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-9)
    assert sv.chi2_upper_tail(7.814727903251179, 3) == pytest.approx(0.05, rel=1e-9)


def brute_cox(pdf, steps=30):
    groups = sorted(pdf["cluster"].unique())
    x = np.stack([(pdf["cluster"] == g).to_numpy(float) for g in groups[1:]], 1)
    t, e = pdf["time"].to_numpy(), pdf["event"].to_numpy()
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        grad, info, w = np.zeros(len(b)), np.zeros((len(b), len(b))), np.exp(x @ b)
        for s in np.unique(t[e == 1]):
            risk, dead = t >= s, (t == s) & (e == 1)
            d = dead.sum()
            grad += x[dead].sum(0)
            for l in range(d):
                ww = w * risk - l / d * w * dead
                phi, m = ww.sum(), (ww[:, None] * x).sum(0)
                grad -= m / phi
                info += (ww[:, None, None] * x[:, :, None] * x[:, None, :]).sum(0) / phi - np.outer(m, m) / phi ** 2
        b = b + np.linalg.solve(info, grad)
    return b, np.sqrt(np.diag(np.linalg.inv(info)))


def test_hazards_against_brute_force(spark):
    pdf = sample(200)
    b, se = brute_cox(pdf)
    got = sv.cause_specific_hazards(spark.createDataFrame(pdf), 0, tie_chunk=2).orderBy("covariate").collect()
    assert [r["covariate"] for r in got] == ["cluster_1_vs_0", "cluster_2_vs_0"] and all(r["converged"] for r in got)
    assert np.allclose([r["coef"] for r in got], b, atol=1e-8) and np.allclose([r["se_coef"] for r in got], se, atol=1e-8)


def test_hazards_without_events_in_a_group(spark):
    rows = [(0, float(t), 1.0, 0.0) for t in range(1, 8)] + [(1, float(t), 0.0, 0.0) for t in range(1, 8)]
    assert sv.cause_specific_hazards(make(spark, rows), 0).first()["converged"] is False


def test_landmark(spark):
    rows = [(0, 30.0, 1.0, 0.0), (0, 31.0, 1.0, 0.0), (0, 40.0, 0.0, 1.0), (0, 5.0, 1.0, 0.0)]
    early = sv.group_summary(sv.landmark_early(make(spark, rows), 30)).first()
    late = sv.group_summary(sv.landmark_late(make(spark, rows), 30)).first()
    assert (early["n"], early["n_events"], early["median_time"]) == (4, 2, 30.0)
    assert (late["n"], late["n_events"], late["median_time"]) == (2, 1, 5.5)


def test_frame_drops_noise_and_missing(spark):
    features = spark.createDataFrame([(1, "3", "1"), (2, "x", "0"), (3, "4", "0"), (None, "1", "1")], "id int, t string, e string")
    labels = spark.createDataFrame([(1, 0), (2, 0), (3, -1), (None, 0)], "id int, cluster_label int")
    got = sv.survival_frame(features, labels, "id", "t", "e", "absent").collect()
    assert [tuple(r) for r in got] == [(1, 0, 3.0, 1.0, 0.0)]
    with pytest.raises(ValueError):
        sv.survival_frame(features, labels, "id", "nope", "e")


def test_logrank_of_millions_of_records(spark):
    """Three million records at two times, halves of two groups: the counts' third power is beyond long."""
    n = 3_000_000
    frame = spark.range(n).select((F.col("id") % 2).alias("cluster"), F.when(F.col("id") < n / 3, 1.0).otherwise(2.0).alias("time"),
                                  (F.col("id") % 4 == 0).cast("double").alias("event"), F.lit(0.0).alias("competing"))
    cells = {(r["cluster"], r["other_cluster"]): r for r in sv.logrank_components(frame).collect()}
    want_expected = want_variance = observed = 0
    for at, left in ((n // 3, n), (n - n // 3, n - n // 3)):
        d = at // 4
        observed += d
        want_expected += d / 2
        want_variance += d * (left - d) / (left - 1) / 4
    assert cells[0, 0]["observed"] == observed and cells[1, 1]["observed"] == 0
    assert abs(cells[0, 0]["expected"] / want_expected - 1) < 1e-12
    assert abs(cells[0, 0]["variance"] / want_variance - 1) < 1e-12 and abs(cells[0, 1]["variance"] / want_variance + 1) < 1e-12
    assert sv.logrank_k_sample(frame).first()["test_statistic"] > 1e5
