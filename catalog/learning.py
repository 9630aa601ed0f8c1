"""Learning queries: customers with order statistics as features, a rule on them as cluster label."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from catalog.registry import Tables, query, rounded
from cohortspark.operators import features as feat, layout as lay
from cohortspark.operators.summary import mean_abs_attribution
from cohortspark.plans import attribution, backmapping, phenotypes
from cohortspark.runtime import cut

WANTED = ["n_orders", "mean_price", "max_price", "urgent", "balance", "nation", "absent_column"]
BINARY = ["urgent"]


def customer_features(t: Tables) -> DataFrame:
    orders = t.orders.groupBy(F.col("o_custkey").alias("id")).agg(
        F.count("*").cast("double").alias("n_orders"), F.avg("o_totalprice").alias("mean_price"), F.max("o_totalprice").alias("max_price"),
        F.max((F.col("o_orderpriority") == "1-URGENT").cast("double")).alias("urgent"))
    people = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").cast("double").alias("nation"))
    return people.join(orders, "id", "left")


def rule_labels(t: Tables) -> DataFrame:
    """0 for few orders, else 1 or 2 by account balance; -1 (noise) for customers without an order."""
    df = customer_features(t)
    label = (F.when(F.col("n_orders").isNull(), -1).when(F.col("n_orders") < 8, 0).when(F.col("balance") < 4500, 1).otherwise(2))
    return df.select("id", label.cast("long").alias("cluster_label"))


FEATURES = """
o AS (SELECT o_custkey AS id, count(*)::DOUBLE AS n_orders, avg(o_totalprice) AS mean_price, max(o_totalprice) AS max_price,
        max((o_orderpriority = '1-URGENT')::INT)::DOUBLE AS urgent FROM orders GROUP BY ALL),
f AS (SELECT c_custkey AS id, c_acctbal AS balance, c_nationkey::DOUBLE AS nation, n_orders, mean_price, max_price, urgent,
        CASE WHEN n_orders IS NULL THEN -1 WHEN n_orders < 8 THEN 0 WHEN c_acctbal < 4500 THEN 1 ELSE 2 END::BIGINT AS cluster_label
      FROM customer LEFT JOIN o ON c_custkey = id)"""


@query("feature_frame", f"""
WITH {FEATURES}, i AS (SELECT id, cluster_label, coalesce(n_orders, (SELECT median(n_orders) FROM f)) AS n_orders, coalesce(mean_price, (SELECT median(mean_price) FROM f)) AS mean_price,
        coalesce(max_price, (SELECT median(max_price) FROM f)) AS max_price, coalesce(urgent, (SELECT median(urgent) FROM f)) AS urgent, balance, nation FROM f),
s AS (SELECT avg(n_orders) a1, stddev_pop(n_orders) s1, avg(mean_price) a2, stddev_pop(mean_price) s2, avg(max_price) a3, stddev_pop(max_price) s3,
        avg(balance) a4, stddev_pop(balance) s4, avg(nation) a5, stddev_pop(nation) s5 FROM i)
SELECT id, cluster_label, round((n_orders - a1) / s1, 5) AS n_orders, round((mean_price - a2) / s2, 5) AS mean_price, round((max_price - a3) / s3, 5) AS max_price,
  urgent, round((balance - a4) / s4, 5) AS balance, round((nation - a5) / s5, 5) AS nation FROM i, s""")
def feature_frame(t):
    frame, used = feat.feature_frame(customer_features(t), rule_labels(t), "id", WANTED, "continuous", BINARY, drop_noise=False)
    return rounded(frame, *[c for c in used if c not in BINARY], digits=5)


def _scaled(t: Tables) -> DataFrame:
    frame, used = feat.feature_frame(customer_features(t), rule_labels(t), "id", WANTED, "continuous", BINARY, drop_noise=False)
    return cut(frame.select("id", F.array(*used).alias("vec")))


def eigen_sql(count: int, d: int = 6, doublings: int = 40) -> str:
    """CTEs v1 .. v{count} (vector ``v``, eigenvalue ``l``) of the matrix c0 (``m``, d * d numbers), by squaring it until one direction is
    left, taking that off, and so on. The largest component of a vector is positive."""
    cells = range(d * d)
    diagonal = ", ".join(f"m[{i * d + i + 1}]" for i in range(d))
    square = ", ".join(" + ".join(f"m[{i * d + k + 1}] * m[{k * d + j + 1}]" for k in range(d)) for i in range(d) for j in range(d))
    out = []
    for n in range(1, count + 1):
        product = " + ".join(f"v[{i + 1}] * m[{i * d + j + 1}] * v[{j + 1}]" for i in range(d) for j in range(d))
        rest = ", ".join(f"m[{i + 1}] - l * v[{i // d + 1}] * v[{i % d + 1}]" for i in cells)
        trace = " + ".join(f"q[{i * d + i + 1}]" for i in range(d))
        out.append(f"""
m{n} AS (SELECT 0 AS step, m FROM c{n - 1} UNION ALL SELECT step + 1, list_transform(q, lambda x: x / ({trace})) FROM (SELECT step, [{square}] AS q FROM m{n} WHERE step < {doublings})),
u{n} AS (SELECT list_transform(range({d}), lambda i: m[(j - 1) * {d} + i + 1] / sqrt(m[(j - 1) * {d} + j])) AS u
  FROM (SELECT m, list_position([{diagonal}], list_max([{diagonal}])) AS j FROM m{n} WHERE step = {doublings})),
w{n} AS (SELECT CASE WHEN u[list_position(a, list_max(a))] < 0 THEN list_transform(u, lambda x: -x) ELSE u END AS v
  FROM (SELECT u, list_transform(u, lambda x: abs(x)) AS a FROM u{n})),
v{n} AS (SELECT v, {product} AS l FROM w{n}, c{n - 1}),
c{n} AS (SELECT [{rest}] AS m FROM v{n}, c{n - 1})""")
    return ",".join(out)


COLUMNS = ["n_orders", "mean_price", "max_price", "urgent", "balance", "nation"]
#: Rows as lists of six centred columns (urgent is not scaled), and their covariances.
SCALED = f"""{FEATURES},
i AS (SELECT id, {", ".join(f"coalesce({c}, (SELECT median({c}) FROM f)) AS {c}" for c in COLUMNS)} FROM f),
z AS (SELECT id, [{", ".join(f"({c} - avg({c}) OVER ())" + ("" if c == "urgent" else f" / stddev_pop({c}) OVER ()") for c in COLUMNS)}] AS x FROM i),
c0 AS (SELECT [{", ".join(f"avg(x[{i + 1}] * x[{j + 1}])" for i in range(6) for j in range(6))}] AS m FROM z)"""


@query("pca_scores", f"""
WITH RECURSIVE {SCALED}, {eigen_sql(3)}
SELECT id, {", ".join(f"round(list_inner_product(x, v{n}.v), 5) AS pc{n}" for n in (1, 2, 3))} FROM z, v1, v2, v3""")
def pca_scores(t):
    scores, _ = lay.principal_components(_scaled(t), 3)
    return scores.select("id", *[F.round(F.get("pc", F.lit(i)), 5).alias(f"pc{i + 1}") for i in range(3)])


@query("explained_variance", f"""
WITH RECURSIVE {SCALED}, {eigen_sql(6)}, t AS (SELECT {" + ".join(f"m[{i * 7 + 1}]" for i in range(6))} AS total FROM c0),
r AS ({" UNION ALL ".join(f"SELECT {n}::INT AS component, l / total AS ratio FROM v{n}, t" for n in range(1, 7))})
SELECT component, round(ratio, 6) AS ratio, round(sum(ratio) OVER (ORDER BY component), 6) AS cumulative_ratio FROM r""")
def explained_variance(t):
    """Variance ratios of all components of the scaled columns, and their running sum."""
    _, ratios = lay.principal_components(_scaled(t), 6)
    return rounded(phenotypes.explained_variance(t.spark, ratios), "ratio", "cumulative_ratio")


RULE = """
o AS (SELECT o_custkey AS id, count(*) AS n_orders FROM orders GROUP BY ALL),
c AS (SELECT c_custkey AS id, CASE WHEN n_orders < 8 THEN 0 WHEN c_acctbal < 4500 THEN 1 ELSE 2 END::BIGINT AS cluster_label FROM customer JOIN o ON c_custkey = id)"""


KS = [2, 3, 4, 5, 6, 7, 8, 17]


@query("kmeans_range")
def kmeans_range(t):
    """The label of every row for each number of clusters, with the cost of the best of ten starts."""
    scores, _ = lay.principal_components(_scaled(t), 3)
    labels, costs = phenotypes.kmeans_range(scores, KS)
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"kmeans_k{k}_label").cast("long").alias("label")) for k in KS]))
    known = t.spark.createDataFrame(costs, "k int, cost double")
    return rounded(labels.select("id", each.alias("l")).select("id", "l.*").join(F.broadcast(known), "k"), "cost", digits=3)


@query("structured_comparator")
def structured_comparator(t):
    """Agreement of the given labels with k-means for each k (ten starts) and with density clusters of a layout (200 epochs)."""
    return rounded(phenotypes.compare(customer_features(t), rule_labels(t), "id", WANTED, BINARY)["concordance"], "ari", "nmi")


@query("oof_predictions")
def oof_predictions(t):
    """Every row with its fold, its class, the predicted one and the probability of each."""
    frame, used = feat.feature_frame(customer_features(t), rule_labels(t), "id", WANTED, "all")
    oof, _ = backmapping.out_of_fold(frame, used, "id")
    wide = backmapping.wide_probabilities(oof, "id").join(oof.select("id", "fold"), "id")
    return rounded(wide, *[c for c in wide.columns if c.startswith("prob_")])


@query("backmapping_metrics")
def backmapping_metrics(t):
    """Area and recall per fold and per cluster."""
    found = backmapping.backmap(customer_features(t), rule_labels(t), "id", WANTED)
    folds = found["folds"].select(F.lit("fold").alias("level"), F.col("fold").cast("long").alias("name"), F.col("macro_auroc").alias("auroc"),
                                  F.col("macro_recall").alias("recall"))
    classes = found["classes"].select(F.lit("cluster").alias("level"), F.col("cluster").alias("name"), "auroc", "recall")
    return rounded(folds.unionByName(classes), "auroc", "recall")


@query("importance_table")
def importance_table(t):
    return rounded(backmapping.backmap(customer_features(t), rule_labels(t), "id", WANTED)["importance"], "importance")


def _model(t: Tables):
    frame, used = feat.feature_frame(customer_features(t), rule_labels(t), "id", WANTED, "none")
    frame = cut(frame)
    return backmapping.train(frame, used), frame


@query("permutation_importance")
def permutation_importance(t):
    model, frame = _model(t)
    return rounded(attribution.permutation_importance(model, frame, "id"), "mean_decrease_auroc", "std")


@query("attributions")
def attributions(t):
    """Sampled attributions of every row, column and class; with their common base they add up to the score."""
    model, frame = _model(t)
    return rounded(attribution.sampled_attributions(model, frame, "id"), "phi", "std_error", "base")


@query("attributions_exact")
def attributions_exact(t):
    """Attributions by all 64 coalitions of the six columns, against a background of 16 rows."""
    model, frame = _model(t)
    return rounded(attribution.exact_attributions(model, frame, "id", n_background=16), "phi", "base")


@query("attribution_summary")
def attribution_summary(t):
    model, frame = _model(t)
    return rounded(mean_abs_attribution(attribution.sampled_attributions(model, frame, "id")), "mean_abs_shap")


@query("boosted_predictions")
def boosted_predictions(t):
    """Class and probabilities by boosted trees, one model per class."""
    frame, used = feat.feature_frame(customer_features(t), rule_labels(t), "id", WANTED, "none")
    model = backmapping.train(cut(frame), used, boosted=True)
    found = model.predict(frame)
    return found.select("id", "cluster_label", "predicted", *[F.round(F.get("probs", F.lit(i))["prob"], 6).alias(f"prob_cluster_{c}")
                                                              for i, c in enumerate(model.classes)])
