"""Survival queries: line items as records, market segment as cluster, return flag as outcome."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from catalog.registry import Tables, long, query, rounded
from cohortspark.operators import survival as sv
from cohortspark.plans import reports

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def customer_labels(t: Tables) -> DataFrame:
    """(custkey, cluster_label): position of the market segment, -1 (noise) for accounts in debt."""
    place = F.array_position(F.array(*[F.lit(s) for s in SEGMENTS]), F.col("c_mktsegment")) - 1
    return t.customer.select(F.col("c_custkey").alias("custkey"),
                             F.when(F.col("c_acctbal") < 0, -1).otherwise(place).cast("long").alias("cluster_label"))


def records(t: Tables) -> DataFrame:
    items = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return items.select(F.col("o_custkey").alias("custkey"), F.col("l_quantity").alias("time"),
                        F.datediff("l_shipdate", "o_orderdate").cast("double").alias("offset"),
                        (F.col("l_returnflag") == "R").cast("int").alias("death"),
                        (F.col("l_returnflag") == "A").cast("int").alias("discharge"))


def frame(t: Tables, time: str = "time") -> DataFrame:
    return sv.survival_frame(records(t), customer_labels(t), "custkey", time, "death", "discharge")


SUR = """
lab AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN -1 ELSE
          list_position(['AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY'], c_mktsegment) - 1 END::BIGINT AS cluster
        FROM customer),
sur AS (SELECT lab.cluster, {time} AS time, (l_returnflag = 'R')::INT AS ev, (l_returnflag = 'A')::INT AS cmp
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN lab ON o_custkey = c_custkey
        WHERE lab.cluster <> -1)"""
QTY = SUR.format(time="l_quantity")
CLIPPED = SUR.format(time="greatest(0, date_diff('day', o_orderdate, l_shipdate))::DOUBLE")

CIF = """
WITH {frame},
tt AS (SELECT cluster, time, sum((ev = 1)::INT) AS d1, sum((ev <> 1 AND cmp = 1)::INT) AS d2, count(*) AS c FROM sur GROUP BY ALL),
rk AS (SELECT *, sum(c) OVER (PARTITION BY cluster ORDER BY time DESC) AS n FROM tt),
lg AS (SELECT *, CASE WHEN n > d1 + d2 THEN ln(1 - (d1 + d2) / n::DOUBLE) END AS l FROM rk),
st AS (SELECT *, exp(coalesce(sum(l) OVER (PARTITION BY cluster ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS s FROM lg),
cf AS (SELECT cluster, time, n, d1, d2, sum(s * d1 / n) OVER w AS ci, sum(s * d2 / n) OVER w AS cc FROM st
       WINDOW w AS (PARTITION BY cluster ORDER BY time ROWS UNBOUNDED PRECEDING)),
al AS (SELECT * FROM cf UNION ALL
       SELECT cluster, 0.0, sum(c), 0, 0, 0.0, 0.0 FROM tt GROUP BY cluster HAVING min(time) > 0)
SELECT cluster, time::DOUBLE AS time, n::BIGINT AS at_risk, d1::BIGINT AS d1, d2::BIGINT AS d2,
       round(ci, 6) AS cumulative_incidence, round(cc, 6) AS competing_incidence FROM al"""


def _cif(df: DataFrame) -> DataFrame:
    out = df.withColumns({c: long(c) for c in ("at_risk", "d1", "d2")})
    return rounded(out, "cumulative_incidence", "competing_incidence")


@query("survival_cif", CIF.format(frame=QTY))
def survival_cif(t):
    return _cif(sv.cumulative_incidence(frame(t)))


@query("survival_clip", CIF.format(frame=CLIPPED))
def survival_clip(t):
    return _cif(sv.cumulative_incidence(frame(t, "offset")))


@query("survival_events", f"""
WITH {QTY} SELECT cluster, time, sum((ev = 1)::INT)::BIGINT AS d1, sum((ev <> 1 AND cmp = 1)::INT)::BIGINT AS d2,
       count(*)::BIGINT AS leaving FROM sur GROUP BY ALL""")
def survival_events(t):
    return sv.time_table(frame(t))


@query("event_rate", f"""
WITH {QTY} SELECT count(*)::BIGINT AS n, count(DISTINCT cluster)::BIGINT AS clusters, round(avg(ev), 6) AS event_rate FROM sur""")
def event_rate(t):
    return rounded(sv.event_rate(frame(t)), "event_rate")


EARLY = """SELECT cluster, count(*)::BIGINT AS n, sum((ev = 1 AND time <= 30)::INT)::BIGINT AS n_events,
       round(avg((ev = 1 AND time <= 30)::INT), 6) AS mortality_rate, round(median(least(time, 30)), 6) AS median_time
       FROM sur GROUP BY cluster"""
LATE = """SELECT cluster, count(*)::BIGINT AS n, sum(ev)::BIGINT AS n_events, round(avg(ev), 6) AS mortality_rate,
       round(median(time - 30), 6) AS median_time FROM sur WHERE time > 30 GROUP BY cluster"""


@query("landmark_early", f"WITH {QTY} {EARLY}")
def landmark_early(t):
    return rounded(sv.group_summary(sv.landmark_early(frame(t), 30)), "mortality_rate", "median_time")


@query("landmark_late", f"WITH {QTY} {LATE}")
def landmark_late(t):
    return rounded(sv.group_summary(sv.landmark_late(frame(t), 30)), "mortality_rate", "median_time")


MORTALITY = """
SELECT cluster, count(*)::BIGINT AS n, sum(ev)::BIGINT AS n_inhospital_deaths, sum(cmp)::BIGINT AS n_discharge_alive,
       round(avg(ev), 6) AS overall_mortality_rate, round(avg((ev = 1 AND time <= 30)::INT), 6) AS early_mortality_rate_0_to_30d,
       count(*) FILTER (time > 30)::BIGINT AS late_mortality_eligible_n,
       sum((ev = 1 AND time > 30)::INT)::BIGINT AS late_mortality_events_beyond_30d,
       round(sum((ev = 1 AND time > 30)::INT) / nullif(count(*) FILTER (time > 30), 0)::DOUBLE, 6) AS late_mortality_rate_beyond_30d,
       round(median(time), 6) AS median_time_days FROM sur GROUP BY cluster"""


@query("mortality_by_cluster", f"WITH {QTY} {MORTALITY}")
def mortality_by_cluster(t):
    return rounded(sv.cluster_mortality(frame(t), 30), "overall_mortality_rate", "early_mortality_rate_0_to_30d",
                   "late_mortality_rate_beyond_30d", "median_time_days")


COMPONENTS = f"""{QTY},
gr AS (SELECT DISTINCT cluster FROM sur), ti AS (SELECT time, count(*) AS d FROM sur WHERE ev = 1 GROUP BY time),
ng AS (SELECT ti.time, any_value(ti.d) AS d, gr.cluster, count(s.time) AS n, count(s.time) FILTER (s.ev = 1 AND s.time = ti.time) AS dg
       FROM ti CROSS JOIN gr LEFT JOIN (SELECT cluster, time, ev FROM sur) s ON s.cluster = gr.cluster AND s.time >= ti.time
       GROUP BY ti.time, gr.cluster),
tot AS (SELECT time, sum(n) AS nn FROM ng GROUP BY time),
cov AS (SELECT a.cluster, b.cluster AS other_cluster, sum(a.dg)::BIGINT AS observed, sum(a.d * a.n / nn::DOUBLE) AS expected,
       sum(CASE WHEN nn > 1 THEN a.d * (nn - a.d) / (nn::DOUBLE * nn * (nn - 1)) * a.n * ((a.cluster = b.cluster)::INT * nn - b.n) ELSE 0 END) AS variance
FROM ng a JOIN ng b USING (time) JOIN tot USING (time) GROUP BY a.cluster, b.cluster)"""


@query("logrank_components", f"WITH {COMPONENTS} SELECT cluster, other_cluster, observed, round(expected, 6) AS expected, round(variance, 6) AS variance FROM cov")
def logrank_components(t):
    return rounded(sv.logrank_components(frame(t)), "expected", "variance")


@query("logrank_ksample", f"""
WITH RECURSIVE {COMPONENTS}, line AS (SELECT cluster, list_append(list(variance ORDER BY other_cluster), any_value(observed - expected)) AS v
  FROM cov WHERE cluster > 0 AND other_cluster > 0 GROUP BY cluster),
e AS (SELECT 1 AS k, list(v ORDER BY cluster) AS m, 0::DOUBLE AS stat FROM line
  UNION ALL SELECT k + 1, list_transform(m, lambda line: list_transform(line, lambda x, j: x - line[k] * m[k][j] / m[k][k])), stat + m[k][5] * m[k][5] / m[k][k]
  FROM e WHERE k <= 4)
SELECT round(stat, 6) AS test_statistic, round(exp(-stat / 2) * (1 + stat / 2), 6) AS p_value, 5::INT AS n_groups FROM e WHERE k = 5""")
def logrank_ksample(t):
    """Five groups: the SQL eliminates the four unknowns, and the tail of four degrees of freedom is a finite sum."""
    return rounded(sv.logrank_k_sample(frame(t)).select("test_statistic", "p_value", "n_groups"), "test_statistic", "p_value")


@query("logrank_two_groups", """
WITH sur AS (SELECT (l_linestatus = 'O')::INT AS g, l_quantity AS time, (l_returnflag = 'R')::INT AS ev FROM lineitem),
c AS (SELECT time, sum(ev) AS d, count(*) AS k, sum(g * ev) AS d1, sum(g) AS k1 FROM sur GROUP BY time),
r AS (SELECT d, d1, sum(k) OVER w AS n, sum(k1) OVER w AS n1 FROM c WINDOW w AS (ORDER BY time DESC)),
s AS (SELECT sum(d1) AS o, sum(d * n1 / n::DOUBLE) AS e,
             sum(CASE WHEN n > 1 THEN d * (n - d) / (n::DOUBLE * n * (n - 1)) * n1 * (n - n1) ELSE 0 END) AS v FROM r WHERE d > 0)
SELECT 'Gray_test_competing_risk' AS test, round((o - e) * (o - e) / v, 6) AS test_statistic, 2::INT AS n_groups FROM s""")
def logrank_two_groups(t):
    df = t.lineitem.select((F.col("l_linestatus") == "O").cast("int").alias("cluster"), F.col("l_quantity").alias("time"),
                           (F.col("l_returnflag") == "R").cast("int").alias("event"),
                           (F.col("l_returnflag") == "A").cast("int").alias("competing"))
    return rounded(sv.logrank_k_sample(df), "test_statistic").select("test", "test_statistic", "n_groups")


def _solved(size: int, width: int, source: str) -> str:
    """Gauss-Jordan elimination of the matrix ``m`` (a list of lines) of ``source``, other columns kept: the identity, then the solutions."""
    for k in range(1, size + 1):
        source = f"""(SELECT * REPLACE (list_transform(m, lambda line, i: CASE WHEN i = {k} THEN list_transform(line, lambda x: x / m[{k}][{k}])
  ELSE list_transform(line, lambda x, j: x - line[{k}] * m[{k}][j] / m[{k}][{k}]) END) AS m) FROM {source})"""
    return source


#: Newton steps for the four coefficients of five groups, tied events by Efron's rule: event l of d at a time sees the group sums less l / d of
#: those of the tied ones. ``a`` are the groups' shares of such a sum.
GROUPS = range(2, 6)
SHARES = ", ".join(f"(n[{i}] - l / d * dg[{i}]) * w[{i}] / s AS a{i}" for i in range(1, 6))
SUM = "list_sum(list_transform(range(1, 6), lambda i: (n[i] - l / d * dg[i]) * w[i]))"
INFORMATION = ", ".join("[" + ", ".join([f"sum({f'a{i}' if i == j else '0'} - a{i} * a{j})" for j in GROUPS] + [f"any_value(e[{i}]) - sum(a{i})"]) + "]" for i in GROUPS)
UNIT = ", ".join("[" + ", ".join([f"m[{i}][{j}]" for j in range(1, 5)] + [str(float(i == j)) for j in range(1, 5)]) + "]" for i in range(1, 5))
TAIL = """CASE WHEN abs(z) / sqrt(2) >= 5 THEN 0 ELSE 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(100), lambda k: (CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END)
  * exp((2 * k + 1) * ln(greatest(abs(z), 1e-300) / sqrt(2)) - lgamma(k + 1)) / (2 * k + 1))) END"""


@query("cox_cause_specific", f"""
WITH RECURSIVE {COMPONENTS}, tl AS (SELECT time, any_value(d)::DOUBLE AS d, list(n::DOUBLE ORDER BY cluster) AS n, list(dg::DOUBLE ORDER BY cluster) AS dg FROM ng GROUP BY time),
ev AS (SELECT [{", ".join(f"sum(dg[{i}])" for i in range(1, 6))}] AS e FROM tl), ties AS (SELECT d, n, dg, unnest(range(d::BIGINT))::DOUBLE AS l FROM tl),
step AS (SELECT 0 AS k, [0.0, 0.0, 0.0, 0.0]::DOUBLE[] AS b, NULL::DOUBLE[][] AS info
  UNION ALL SELECT k + 1, list_transform(b, lambda x, i: x + m[i][5]), raw FROM {_solved(4, 5, f"""(SELECT k, b, m, m AS raw FROM (
    SELECT any_value(k) AS k, any_value(b) AS b, [{INFORMATION}] AS m FROM (SELECT k, b, e, {SHARES} FROM (SELECT *, {SUM} AS s FROM (
      SELECT k, b, d, n, dg, l, e, list_prepend(1.0, list_transform(b, lambda x: exp(x))) AS w FROM step, ties, ev WHERE k < 12))) HAVING count(*) > 0))""")}),
last AS (SELECT b, info AS m FROM step WHERE k = 12), inverse AS (SELECT b, m FROM {_solved(4, 8, f"(SELECT b, [{UNIT}] AS m FROM last)")}),
r AS (SELECT i, b[i] AS coef, sqrt(m[i][i + 4]) AS se FROM inverse, range(1, 5) x(i)), z AS (SELECT *, coef / se AS z FROM r)
SELECT 'cluster_' || i || '_vs_0' AS covariate, round(coef, 6) AS coef, round(exp(coef), 6) AS exp_coef, round(se, 6) AS se_coef,
  round(coef - 1.959963984540054 * se, 6) AS coef_lower_95, round(coef + 1.959963984540054 * se, 6) AS coef_upper_95,
  round(exp(coef - 1.959963984540054 * se), 6) AS exp_coef_lower_95, round(exp(coef + 1.959963984540054 * se), 6) AS exp_coef_upper_95,
  round(z, 6) AS z, round({TAIL}, 6) AS p, 0::INT AS reference_cluster, true AS converged FROM z""")
def cox_cause_specific(t):
    found = sv.cause_specific_hazards(frame(t), reference=0)
    return rounded(found, *[c for c, kind in found.dtypes if kind == "double"])


@query("plot_incidence", CIF.format(frame=QTY).replace(
    """SELECT cluster, time::DOUBLE AS time, n::BIGINT AS at_risk, d1::BIGINT AS d1, d2::BIGINT AS d2,
       round(ci, 6) AS cumulative_incidence, round(cc, 6) AS competing_incidence FROM al""",
    "SELECT cluster, time::DOUBLE AS time, round(ci, 6) AS cumulative_incidence FROM al"))
def plot_incidence(t):
    found = reports.plot_data({"cumulative_incidence": sv.cumulative_incidence(frame(t))})
    return rounded(found["fig4_cumulative_incidence"], "cumulative_incidence")


@query("plot_early_late", f"""
WITH {QTY}, e AS ({EARLY}), l AS ({LATE})
SELECT 'early' AS period, cluster, mortality_rate FROM e UNION ALL SELECT 'late', cluster, mortality_rate FROM l""")
def plot_early_late(t):
    f = frame(t)
    found = reports.plot_data({"early": sv.group_summary(sv.landmark_early(f, 30)),
                               "late": sv.group_summary(sv.landmark_late(f, 30))})
    return rounded(found["fig5_early_late_mortality"], "mortality_rate")


@query("characterization", f"""
WITH {QTY}, m AS ({MORTALITY}), c AS (SELECT cluster, count(*)::BIGINT AS n_clustered, round(avg(1.0), 6)::DOUBLE AS mean_probability FROM lab GROUP BY cluster)
SELECT coalesce(c.cluster, m.cluster) AS cluster, n_clustered, mean_probability, m.* EXCLUDE (cluster)
FROM c FULL OUTER JOIN m ON c.cluster = m.cluster""")
def characterization(t):
    labels = customer_labels(t).withColumn("cluster_probability", F.lit(1.0))
    from cohortspark.operators.summary import cluster_summary

    table = reports.tables({"summary": cluster_summary(labels, "custkey"), "mortality": mortality_by_cluster(t)})
    return table["table1_cluster_characterization"]
