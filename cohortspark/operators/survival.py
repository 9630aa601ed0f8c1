"""Competing-risk incidence, k-sample log-rank, cause-specific hazards and landmark summaries.

Everything starts from one aggregate per (cluster, time); its size is the number of distinct times,
not the number of records.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType

from cohortspark.functions.outcome import clip_high, clip_low, event_code
from cohortspark.operators.ordered import WINDOW_ROWS, exact_quantiles, plan_buckets, running
from cohortspark.runtime import cut, has

NOISE = -1

# Name and note of the k-sample test in result tables.
GRAY_NAME = "Gray_test_competing_risk"
GRAY_NOTE = ("Approximate Gray test via multivariate log-rank on primary event indicator. "
             "For formal Gray test, use cmprsk R package or equivalent.")


def survival_frame(features: DataFrame, labels: DataFrame, id_col: str, time: str, event: str,
                   competing: str | None = None, cluster: str = "cluster_label") -> DataFrame:
    """Join records to cluster labels, drop noise and rows without time or event.

    Returns (id, cluster, time, event, competing); an absent competing column counts as 0.
    """
    for name in (time, event):
        if not has(features, name):
            raise ValueError(f"column {name} not found")
    right = labels.select(id_col, F.col(cluster).alias("cluster"))
    joined = features.join(right, id_col).filter(F.col("cluster") != NOISE)

    def number(name):
        return F.nanvl(F.col(name).try_cast("double"), F.lit(None).cast("double"))

    other = number(competing) if competing and has(features, competing) else F.lit(0.0)
    return joined.select(id_col, "cluster", number(time).alias("time"), number(event).alias("event"),
                         other.alias("competing")).dropna(subset=["time", "event"])


def time_table(frame: DataFrame, clip: bool = True) -> DataFrame:
    """(cluster, time) -> d1 events, d2 competing events, leaving = all records ending there."""
    t = clip_low(F.col("time"), 0.0) if clip else F.col("time")
    code = event_code(F.col("event"), F.col("competing"))
    return (frame.select("cluster", t.alias("time"), code.alias("code"))
            .groupBy("cluster", "time")
            .agg(F.count_if(F.col("code") == 1).alias("d1"), F.count_if(F.col("code") == 2).alias("d2"),
                 F.count("*").alias("leaving")))


def cumulative_incidence(frame: DataFrame, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """Aalen-Johansen incidence of event 1 and of the competing event, by cluster.

    Tied times are treated exactly. One row per (cluster, time) plus the origin (0, 0).
    """
    counts = cut(time_table(frame))
    buckets = plan_buckets(counts, "time", window_rows)
    risk = running(counts, ["cluster"], "time", {"at_risk": "leaving"}, buckets, descending=True)
    step = risk.withColumn("log_stay", F.log(1 - (F.col("d1") + F.col("d2")) / F.col("at_risk")))
    before = running(step, ["cluster"], "time", {"log_before": "log_stay"}, buckets, inclusive=False)
    mass = before.withColumn("surv_before", F.exp("log_before"))
    cum = running(mass, ["cluster"], "time", {
        "cumulative_incidence": F.col("surv_before") * F.col("d1") / F.col("at_risk"),
        "competing_incidence": F.col("surv_before") * F.col("d2") / F.col("at_risk")}, buckets)
    rows = cum.select("cluster", F.col("time").cast("double").alias("time"), "at_risk", "d1", "d2",
                      "cumulative_incidence", "competing_incidence")
    origin = (counts.groupBy("cluster").agg(F.sum("leaving").alias("at_risk"), F.min("time").alias("_first"))
              .filter(F.col("_first") > 0)
              .select("cluster", F.lit(0.0).alias("time"), "at_risk", F.lit(0).cast("long").alias("d1"),
                      F.lit(0).cast("long").alias("d2"), F.lit(0.0).alias("cumulative_incidence"),
                      F.lit(0.0).alias("competing_incidence")))
    return rows.unionByName(origin)


def _groups(counts: DataFrame) -> list:
    """Cluster values in order. The tests need a groups x groups matrix, so this list is model-sized."""
    return [r[0] for r in counts.select("cluster").distinct().orderBy("cluster").collect()]


def risk_grid(counts: DataFrame, groups: list, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """One row per time with an event: arrays of at-risk and event counts in group order.

    The clusters missing at a time are added as zero rows before the running sum.
    """
    times = counts.groupBy("time").agg(F.sum("d1").alias("_d")).filter(F.col("_d") > 0).select("time")
    zeros = times.select(F.explode(F.array(*[F.lit(g) for g in groups])).alias("cluster"), "time",
                         F.lit(0).alias("d1"), F.lit(0).alias("leaving"))
    filled = cut(counts.select("cluster", "time", "d1", "leaving").unionByName(zeros)
                 .groupBy("cluster", "time").agg(F.sum("d1").alias("d1"), F.sum("leaving").alias("leaving")))
    buckets = plan_buckets(filled, "time", window_rows)
    risk = running(filled, ["cluster"], "time", {"n": "leaving"}, buckets, descending=True)
    # at most one row per cluster and time, so the list has len(groups) entries
    return (risk.groupBy("time")
            .agg(F.sort_array(F.collect_list(F.struct("cluster", "n", "d1"))).alias("g"), F.sum("d1").alias("d"))
            .filter(F.col("d") > 0)
            .select("time", "d", F.col("g.n").alias("n"), F.col("g.d1").alias("dg")))


def logrank_components(frame: DataFrame, groups: list | None = None,
                       window_rows: int = WINDOW_ROWS) -> DataFrame:
    """Observed and expected events per group and the covariance matrix, in long form."""
    counts = cut(time_table(frame))
    groups = _groups(counts) if groups is None else groups
    grid = (risk_grid(counts, groups, window_rows)
            .withColumn("total", F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)))
    # products of three counts pass the range of long from some two million records on, so they are taken in doubles
    d, total = F.col("d").cast("double"), F.col("total").cast("double")
    scale = d * (total - d) / (total * total * (total - 1))
    scaled = grid.withColumn("c", F.when(F.col("total") > 1, scale).otherwise(F.lit(0.0)))
    names = F.array(*[F.lit(g) for g in groups]).cast(ArrayType(frame.schema["cluster"].dataType))
    cells = (scaled.select("d", "total", "c", "n", F.posexplode(F.arrays_zip("n", "dg")).alias("i", "a"))
             .select("d", "total", "c", "i", F.col("a.n").alias("ni"), F.col("a.dg").alias("di"),
                     F.posexplode("n").alias("j", "nj")))
    same = (F.col("i") == F.col("j")).cast("double")
    return (cells.groupBy("i", "j")
            .agg(F.sum("di").alias("observed"), F.sum(F.col("d") * F.col("ni") / F.col("total")).alias("expected"),
                 F.sum(F.col("c") * F.col("ni") * (same * F.col("total") - F.col("nj"))).alias("variance"))
            .select(F.get(names, F.col("i")).alias("cluster"), F.get(names, F.col("j")).alias("other_cluster"),
                    "observed", "expected", "variance"))


def chi2_upper_tail(x: float, dof: int) -> float:
    """P(X > x) for a chi-square variable with whole degrees of freedom (finite sums)."""
    if x <= 0:
        return 1.0
    half = x / 2
    if dof % 2 == 0:
        term, total = math.exp(-half), 0.0
        for i in range(dof // 2):
            if i:
                term *= half / i
            total += term
        return min(1.0, total)
    total = math.erfc(math.sqrt(half))
    term = math.exp(-half) * math.sqrt(half) / math.gamma(1.5)
    for i in range((dof - 1) // 2):
        if i:
            term *= half / (i + 0.5)
        total += term
    return min(1.0, total)


def logrank_k_sample(frame: DataFrame, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """k-sample log-rank on event 1, reported as an approximate Gray test."""
    spark = frame.sparkSession
    cells = logrank_components(frame, window_rows=window_rows).collect()  # groups x groups cells
    groups = sorted({r["cluster"] for r in cells})
    place = {g: i for i, g in enumerate(groups)}
    k = len(groups)
    diff, cov = np.zeros(k), np.zeros((k, k))
    for r in cells:
        diff[place[r["cluster"]]] = r["observed"] - r["expected"]
        cov[place[r["cluster"]], place[r["other_cluster"]]] = r["variance"]
    statistic = p_value = None
    if k > 1:
        part = cov[1:, 1:]
        statistic = float(diff[1:] @ np.linalg.pinv(part) @ diff[1:])
        p_value = chi2_upper_tail(statistic, k - 1)
    return spark.createDataFrame(
        [(GRAY_NAME, statistic, p_value, k, GRAY_NOTE)],
        "test string, test_statistic double, p_value double, n_groups int, note string")


def cause_specific_hazards(frame: DataFrame, reference, max_iter: int = 25, tol: float = 1e-9, clip: bool = False,
                           tie_chunk: int = 1000, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """Proportional hazards on cluster indicators, competing events censored, Efron ties.

    With group indicators the data reduce to at-risk and event counts per (time, group). Each Newton
    step is one Spark aggregate over that table; only the G-vector and GxG matrix reach the driver.
    """
    spark = frame.sparkSession
    counts = cut(time_table(frame, clip=clip))
    groups = _groups(counts)
    if reference not in groups:
        raise ValueError(f"reference cluster {reference} not found")
    others = [g for g in groups if g != reference]
    grid = risk_grid(counts, groups, window_rows)
    # a time with very many ties is cut into chunks, so no row carries a long sequence
    chunks = cut(grid.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("d") - 1,
                                                       F.lit(tie_chunk).cast("long"))).alias("first"))
                 .withColumn("last", F.least(F.col("d") - 1, F.col("first") + tie_chunk - 1)))
    events = {r["i"]: r["e"] for r in
              grid.select(F.posexplode("dg").alias("i", "e")).groupBy("i").agg(F.sum("e").alias("e")).collect()}
    k = len(groups)
    beta = np.zeros(k)
    free = [groups.index(g) for g in others]
    converged, info = False, np.zeros((len(free), len(free)))

    def gradient_and_information(b):
        weight = F.array(*[F.lit(float(math.exp(x))) for x in b])
        row = (chunks
               .withColumn("wn", F.zip_with("n", weight, lambda x, y: x * y))
               .withColumn("wd", F.zip_with("dg", weight, lambda x, y: x * y))
               .withColumn("s0", F.aggregate("wn", F.lit(0.0), lambda a, x: a + x))
               .withColumn("r", F.aggregate("wd", F.lit(0.0), lambda a, x: a + x) / F.col("d"))
               .withColumn("ls", F.sequence("first", "last")))

        def over_ties(f):
            return F.aggregate("ls", F.lit(0.0), lambda a, l: a + f(l, F.col("s0") - l * F.col("r")))

        row = (row.withColumn("p0", over_ties(lambda l, phi: 1 / phi))
               .withColumn("p1", over_ties(lambda l, phi: l / phi) / F.col("d"))
               .withColumn("q0", over_ties(lambda l, phi: 1 / (phi * phi)))
               .withColumn("q1", over_ties(lambda l, phi: l / (phi * phi)) / F.col("d"))
               .withColumn("q2", over_ties(lambda l, phi: l * l / (phi * phi)) / (F.col("d") * F.col("d")))
               .select("p0", "p1", "q0", "q1", "q2", F.arrays_zip("wn", "wd").alias("w"))
               .select("*", F.posexplode("w").alias("i", "a")).select("*", F.posexplode("w").alias("j", "b")))
        ni, di, nj, dj = F.col("a.wn"), F.col("a.wd"), F.col("b.wn"), F.col("b.wd")
        first = ni * F.col("p0") - di * F.col("p1")
        cross = ni * nj * F.col("q0") - (ni * dj + di * nj) * F.col("q1") + di * dj * F.col("q2")
        cells = row.groupBy("i", "j").agg(F.sum(first).alias("m"), F.sum(cross).alias("c")).collect()
        grad, hess = np.zeros(k), np.zeros((k, k))
        for r in cells:
            hess[r["i"], r["j"]] -= r["c"]
            if r["i"] == r["j"]:
                grad[r["i"]] = events.get(r["i"], 0) - r["m"]
                hess[r["i"], r["i"]] += r["m"]
        return grad[free], hess[np.ix_(free, free)]

    for _ in range(max_iter):
        if not free or not events:
            break
        grad, info = gradient_and_information(beta)
        step = np.linalg.pinv(info) @ grad
        size = float(np.max(np.abs(step)))
        beta[free] += step * min(1.0, 5.0 / size) if size > 0 else 0.0
        if size < tol:
            converged = True
            break
        if np.max(np.abs(beta)) > 30:
            break  # monotone likelihood: a group without events has no finite estimate
    variance = np.diag(np.linalg.pinv(info)) if free else []
    rows = []
    for i, g in zip(free, others):
        coef, se = float(beta[i]), float(math.sqrt(max(variance[free.index(i)], 0.0)))
        z = coef / se if se > 0 else None
        p = math.erfc(abs(z) / math.sqrt(2)) if z is not None else None
        low, high = coef - 1.959963984540054 * se, coef + 1.959963984540054 * se
        rows.append((f"cluster_{g}_vs_{reference}", coef, math.exp(coef), se, low, high,
                     math.exp(low), math.exp(min(high, 700.0)), z, p, int(reference), converged))
    return spark.createDataFrame(
        rows, "covariate string, coef double, exp_coef double, se_coef double, coef_lower_95 double, "
              "coef_upper_95 double, exp_coef_lower_95 double, exp_coef_upper_95 double, z double, p double, "
              "reference_cluster int, converged boolean")


def landmark_early(frame: DataFrame, landmark: float) -> DataFrame:
    """Everyone, followed to the landmark; an event exactly on it is early."""
    hit = (F.col("event") == 1) & (F.col("time") <= landmark)
    return (frame.withColumn("event", hit.cast("int"))
            .withColumn("time", clip_high(F.col("time"), float(landmark))))


def landmark_late(frame: DataFrame, landmark: float) -> DataFrame:
    """Those still followed after the landmark, on a clock restarted there."""
    return (frame.filter(F.col("time") > landmark)
            .withColumn("event", (F.col("event") == 1).cast("int"))
            .withColumn("time", F.col("time") - landmark))


def group_summary(frame: DataFrame, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """cluster, n, n_events, mortality_rate, median_time."""
    stats = frame.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("event").cast("long").alias("n_events"),
                                         F.avg("event").alias("mortality_rate"))
    medians = exact_quantiles(frame, ["cluster"], "time", {"median_time": 0.5}, window_rows)
    return stats.join(medians, "cluster", "left")


def cluster_mortality(frame: DataFrame, landmark: int = 30, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """Counts and rates per cluster, overall and on both sides of the landmark."""
    event, late = F.col("event"), F.col("time") > landmark
    early_hits = F.count_if((event == 1) & ~late)
    late_hits = F.count_if((event == 1) & late)
    stats = frame.groupBy("cluster").agg(
        F.count("*").alias("n"),
        F.sum(event).cast("long").alias("n_inhospital_deaths"),
        F.sum("competing").cast("long").alias("n_discharge_alive"),
        (F.sum(event) / F.count("*")).alias("overall_mortality_rate"),
        (early_hits / F.count("*")).alias(f"early_mortality_rate_0_to_{landmark}d"),
        F.count_if(late).alias("late_mortality_eligible_n"),
        late_hits.alias(f"late_mortality_events_beyond_{landmark}d"),
        F.try_divide(late_hits, F.count_if(late)).alias(f"late_mortality_rate_beyond_{landmark}d"))
    medians = exact_quantiles(frame, ["cluster"], "time", {"median_time_days": 0.5}, window_rows)
    return stats.join(medians, "cluster", "left")


def event_rate(frame: DataFrame) -> DataFrame:
    return frame.agg(F.count("*").alias("n"), F.count_distinct("cluster").alias("clusters"),
                     F.avg("event").alias("event_rate"))
