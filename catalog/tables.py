"""Join, aggregate, agreement, feature, metric and quality queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from catalog.registry import Tables, long, query, rounded
from catalog.survival import SUR, customer_labels
from cohortspark.functions.outcome import indicators
from cohortspark.operators import features as feat, joins, metrics, quality, summary
from cohortspark.plans import phenotypes, reports
from cohortspark.sources import writers

TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


def part_labels(t: Tables) -> DataFrame:
    """Two clusterings of the parts, each with noise (small parts; cheap parts)."""
    a = F.array_position(F.array(*[F.lit(x) for x in TYPES]), F.col("p_type")) - 1
    return t.part.select(
        F.col("p_partkey").alias("id"), F.when(F.col("p_size") <= 5, -1).otherwise(a).cast("long").alias("a"),
        F.when(F.col("p_retailprice") < 905, -1).otherwise(F.floor(F.col("p_size") / 13)).cast("long").alias("b"),
        (F.col("p_size") / 50).alias("p"), "p_name", "p_retailprice")


CLU = """
clu AS (SELECT p_partkey AS id, p_name, p_retailprice, p_size / 50.0 AS p,
          CASE WHEN p_size <= 5 THEN -1 ELSE list_position(['ECONOMY','LARGE','MEDIUM','PROMO','SMALL','STANDARD'], p_type) - 1 END::BIGINT AS a,
          CASE WHEN p_retailprice < 905 THEN -1 ELSE floor(p_size / 13.0) END::BIGINT AS b FROM part)"""


@query("cluster_summary", f"""
WITH {CLU} SELECT a AS cluster_label, count(*)::BIGINT AS n, round(avg(p), 6)::DOUBLE AS mean_probability FROM clu GROUP BY a""")
def cluster_summary(t):
    df = part_labels(t)
    return rounded(summary.cluster_summary(df.select("id", F.col("a").alias("cluster_label"), F.col("p").alias("cluster_probability")), "id"),
                   "mean_probability")


@query("noise_fraction", f"""
WITH {CLU} SELECT count(DISTINCT a) FILTER (a <> -1)::BIGINT AS n_clusters, round(avg((a = -1)::INT), 6) AS noise_fraction FROM clu""")
def noise_fraction(t):
    return rounded(summary.noise_summary(part_labels(t), "a"), "noise_fraction")


@query("cluster_sizes", f"WITH {CLU} SELECT b, count(*)::BIGINT AS n FROM clu GROUP BY b")
def cluster_sizes(t):
    return summary.cluster_sizes(part_labels(t), "b")


@query("contingency", f"WITH {CLU} SELECT a AS label_a, b AS label_b, count(*)::BIGINT AS n FROM clu GROUP BY ALL")
def contingency(t):
    return summary.contingency(part_labels(t), "a", "b")


@query("contingency_wide", f"""
WITH {CLU} SELECT a AS label_a, count(*) FILTER (b = -1)::BIGINT AS "-1", count(*) FILTER (b = 0)::BIGINT AS "0", count(*) FILTER (b = 1)::BIGINT AS "1",
  count(*) FILTER (b = 2)::BIGINT AS "2", count(*) FILTER (b = 3)::BIGINT AS "3" FROM clu GROUP BY a""")
def contingency_wide(t):
    return summary.contingency_wide(part_labels(t), "a", "b", [-1, 0, 1, 2, 3])


CONCORDANCE = """
{0}k AS (SELECT {1} AS a, {2} AS b, count(*)::DOUBLE AS n FROM {3} WHERE {1} <> -1 AND {2} <> -1 GROUP BY ALL),
{0}ra AS (SELECT sum(n) AS m FROM {0}k GROUP BY a), {0}rb AS (SELECT sum(n) AS m FROM {0}k GROUP BY b),
{0}s AS (SELECT (SELECT sum(n) FROM {0}k) AS n, (SELECT sum(n * (n - 1) / 2) FROM {0}k) AS pij, (SELECT sum(m * (m - 1) / 2) FROM {0}ra) AS pa,
      (SELECT sum(m * (m - 1) / 2) FROM {0}rb) AS pb, (SELECT sum(n * ln(n)) FROM {0}k) AS l,
      (SELECT sum(m * ln(m)) FROM {0}ra) AS la, (SELECT sum(m * ln(m)) FROM {0}rb) AS lb),
{0}c AS (SELECT round((pij - pa * pb / (n * (n - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (n * (n - 1) / 2)), 6) AS ari,
  round((ln(n) + (l - la - lb) / n) / ((2 * ln(n) - (la + lb) / n) / 2), 6) AS nmi, n::BIGINT AS n_compared FROM {0}s)"""


@query("concordance", f"WITH {CLU}, {CONCORDANCE.format('x', 'a', 'b', 'clu')} SELECT 'a_vs_b' AS comparison_pair, * FROM xc")
def concordance(t):
    return rounded(summary.concordance(part_labels(t), "a", "b"), "ari", "nmi")


@query("concordance_table", f"""
WITH {CLU}, q AS (SELECT a, CASE WHEN p_retailprice < 950 THEN a ELSE b END AS c, b FROM clu),
{CONCORDANCE.format('x', 'a', 'b', 'q')}, {CONCORDANCE.format('y', 'a', 'c', 'q')}
SELECT 'a_vs_b' AS comparison_pair, * FROM xc UNION ALL SELECT 'a_vs_mixed', * FROM yc""")
def concordance_table(t):
    """Union of per-pair records, passed on as the report table."""
    df = part_labels(t).withColumn("c", F.when(F.col("p_retailprice") < 950, F.col("a")).otherwise(F.col("b")))
    both = summary.concordance(df, "a", "b").unionByName(summary.concordance(df, "a", "c", "a_vs_mixed"))
    return reports.tables({"concordance": rounded(both, "ari", "nmi")})["table2_concordance_results"]


@query("labelled_features", f"""
WITH {CLU} SELECT l_orderkey, l_linenumber, l_partkey AS id, l_quantity, a FROM lineitem JOIN clu ON l_partkey = id""")
def labelled_features(t):
    items = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("id"), "l_quantity")
    return joins.labelled(items, part_labels(t), "id", "a")


@query("labelled_outcomes", """
SELECT vec_id AS id, label, quality, toxic FROM embeddings LEFT JOIN labels ON vec_id = doc_id""")
def labelled_outcomes(t):
    outcomes = t.labels.select(F.col("doc_id").alias("id"), "quality", "toxic")
    return joins.with_outcomes(t.embeddings.select(F.col("vec_id").alias("id"), "label"), outcomes, "id")


@query("one_to_one_labels", """
SELECT doc_id, lang, quality AS y_true FROM documents LEFT JOIN labels USING (doc_id)""")
def one_to_one_labels(t):
    return joins.left_one_to_one(t.documents.select("doc_id", "lang"), t.labels.select("doc_id", F.col("quality").alias("y_true")), "doc_id")


@query("subset_by_pattern", """
SELECT l_orderkey AS id, count(*)::BIGINT AS n FROM lineitem
WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE lower(p_name) LIKE '%hot gear%') GROUP BY l_orderkey""")
def subset_by_pattern(t):
    named = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("id"), "p_name")
    ids = phenotypes.subgroup_ids(named, "p_name", "Hot Gear", "id")
    items = t.lineitem.select(F.col("l_orderkey").alias("id"))
    return joins.members(items, ids, "id").groupBy("id").agg(F.count("*").alias("n"))


@query("subset_by_regex", """
SELECT p_partkey AS id FROM part WHERE regexp_matches(p_name, '^(hot|red) g.*r$', 'i')""")
def subset_by_regex(t):
    return phenotypes.subgroup_ids(t.part.select(F.col("p_partkey").alias("id"), "p_name"), "p_name", "^(hot|red) g.*r$", "id", regex=True)


@query("resume_pending", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_pending(t):
    return joins.pending(t.documents.select("doc_id", "lang"), t.labels, "doc_id")


@query("set_difference", """
SELECT doc_id AS id, 'left_only' AS found_in FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)
UNION ALL SELECT vec_id, 'right_only' FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)""")
def set_difference(t):
    return joins.set_difference(t.documents.select(F.col("doc_id").alias("id")), t.embeddings.select(F.col("vec_id").alias("id")), "id")


@query("first_row_per_group", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts NULLS LAST, event_id) AS rn FROM events)
SELECT user_id, event_type, event_id, value FROM r WHERE rn = 1""")
def first_row_per_group(t):
    df = t.events.select("user_id", "event_type", "event_id", "value", "ts")
    return joins.first_row(df, ["user_id", "event_type"], [("ts", True), ("event_id", True)]).drop("ts")


@query("embed_qc", """
WITH v AS (SELECT vec_id AS id FROM embeddings), m AS (SELECT vec_id AS id FROM embeddings UNION ALL SELECT doc_id FROM labels WHERE toxic = 1),
d AS (SELECT doc_id AS id FROM documents)
SELECT 'metadata_rows' AS "check", count(*)::BIGINT AS value FROM m UNION ALL SELECT 'vector_rows', count(*) FROM v
UNION ALL SELECT 'duplicate_keys', count(*) - count(DISTINCT id) FROM m
UNION ALL SELECT 'missing_in_metadata', count(DISTINCT id) FROM d WHERE id NOT IN (SELECT id FROM m)
UNION ALL SELECT 'extra_in_metadata', count(DISTINCT id) FROM m WHERE id NOT IN (SELECT id FROM d)""")
def embed_qc(t):
    vectors = t.embeddings.select(F.col("vec_id").alias("id"))
    extra = t.labels.filter(F.col("toxic") == 1).select(F.col("doc_id").alias("id"))
    return quality.embedding_checks(vectors.unionByName(extra), vectors, t.documents.select(F.col("doc_id").alias("id")), "id")


@query("unique_keys", "SELECT count(*)::BIGINT AS n_rows, count(l_orderkey)::BIGINT AS n_keys, count(DISTINCT l_orderkey)::BIGINT AS n_distinct_keys FROM lineitem")
def unique_keys(t):
    return quality.unique_key_report(t.lineitem, "l_orderkey")


@query("shard_assign", """
SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) // 64 + 3)::BIGINT AS shard_id, ((row_number() OVER (ORDER BY doc_id) - 1) % 64)::BIGINT AS row_in_shard FROM documents""")
def shard_assign(t):
    return writers.assign_shards(t.documents.select("doc_id"), ["doc_id"], shard_size=64, first_shard=3)


@query("next_position", """
WITH s AS (SELECT ((row_number() OVER (ORDER BY event_id) - 1) // 2048) AS sh, ((row_number() OVER (ORDER BY event_id) - 1) % 2048) AS r FROM events)
SELECT max(sh)::BIGINT AS shard_id, (max(r) FILTER (sh = (SELECT max(sh) FROM s)) + 1)::BIGINT AS next_row FROM s""")
def next_position(t):
    return writers.next_position(writers.assign_shards(t.events.select("event_id"), ["event_id"]))


def measures(t: Tables) -> DataFrame:
    """Line item measures; the seventh lines miss their price and quantity."""
    seventh = F.col("l_linenumber") == 7
    return t.lineitem.select("l_orderkey", "l_linenumber", F.when(~seventh, F.col("l_quantity")).alias("quantity"),
                             F.when(~seventh, F.col("l_extendedprice")).alias("price"), F.col("l_discount").alias("discount"),
                             (F.col("l_linestatus") == "F").cast("int").alias("closed"))


MEASURES = """
m AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 7 THEN l_quantity END AS quantity,
        CASE WHEN l_linenumber <> 7 THEN l_extendedprice END AS price, l_discount AS discount, (l_linestatus = 'F')::DOUBLE AS closed FROM lineitem),
i AS (SELECT l_orderkey, l_linenumber, coalesce(quantity, (SELECT median(quantity) FROM m)) AS quantity,
        coalesce(price, (SELECT median(price) FROM m)) AS price, discount, closed FROM m)"""


@query("column_medians", """
WITH """ + MEASURES + """ SELECT 'quantity' AS feature, round(median(quantity), 6) AS median FROM m UNION ALL SELECT 'price', round(median(price), 6) FROM m
UNION ALL SELECT 'discount', round(median(discount), 6) FROM m""")
def column_medians(t):
    return rounded(feat.medians(feat.numeric(measures(t), ["quantity", "price", "discount"]), ["quantity", "price", "discount"]), "median")


@query("impute_scale", f"""
WITH {MEASURES}, s AS (SELECT avg(quantity) AS aq, stddev_pop(quantity) AS sq, avg(price) AS ap, stddev_pop(price) AS sp, avg(discount) AS ad, stddev_pop(discount) AS sd FROM i)
SELECT l_orderkey, l_linenumber, round((quantity - aq) / sq, 5) AS quantity, round((price - ap) / sp, 5) AS price, round((discount - ad) / sd, 5) AS discount, closed
FROM i, s""")
def impute_scale(t):
    used = ["quantity", "price", "discount", "closed"]
    df = feat.impute_medians(feat.numeric(measures(t), used), used)
    scaled = feat.standardize(df, [c for c in used if c != "closed"])
    return rounded(scaled, "quantity", "price", "discount", digits=5)


@query("one_hot", """
SELECT o_orderkey, (o_orderstatus = 'F')::INT AS "status_F", (o_orderstatus = 'P')::INT AS "status_P" FROM orders""")
def one_hot(t):
    return t.orders.select("o_orderkey", *indicators("o_orderstatus", ["F", "P"], "status_"))


FLAGS = ["A", "N", "R"]


def scored(t: Tables) -> DataFrame:
    """Line items as predictions: a made score per flag, coarse enough for many ties; fold = line number."""
    price, qty, disc = F.floor(F.col("l_extendedprice") / 5000), F.col("l_quantity"), F.round(F.col("l_discount") * 100)
    probs = F.array(*[F.struct(F.lit(c).alias("class"), s.cast("double").alias("prob")) for c, s in zip(FLAGS, (price, qty, disc))])
    predicted = F.when(qty > 30, "A").when(disc > 4, "N").otherwise("R")
    return t.lineitem.select(F.col("l_linenumber").alias("fold"), F.col("l_returnflag").alias("truth"), predicted.alias("predicted"), probs.alias("probs"))


SCORES = """
sc AS (SELECT l_linenumber AS fold, l_returnflag AS truth, CASE WHEN l_quantity > 30 THEN 'A' WHEN round(l_discount * 100) > 4 THEN 'N' ELSE 'R' END AS predicted,
         floor(l_extendedprice / 5000)::DOUBLE AS s0, l_quantity AS s1, round(l_discount * 100)::DOUBLE AS s2 FROM lineitem),
ov AS (SELECT fold, 'A' AS class, s0 AS score, truth = 'A' AS pos FROM sc UNION ALL SELECT fold, 'N', s1, truth = 'N' FROM sc
       UNION ALL SELECT fold, 'R', s2, truth = 'R' FROM sc)"""
AUROC = """
rk{0} AS (SELECT *, rank() OVER (PARTITION BY {1} ORDER BY score) + (count(*) OVER (PARTITION BY {1}, score) - 1) / 2.0 AS r FROM ov),
au{0} AS (SELECT {1}, count(*)::BIGINT AS n, sum(pos::INT)::BIGINT AS n_pos,
    (sum(r) FILTER (pos) - sum(pos::INT) * (sum(pos::INT) + 1) / 2.0) / (sum(pos::INT) * (count(*) - sum(pos::INT)))::DOUBLE AS auroc FROM rk{0} GROUP BY {1})"""


@query("average_ranks", f"""
WITH {SCORES} SELECT class, score, count(*)::BIGINT AS n, sum(pos::INT)::BIGINT AS n_pos, any_value(r)::DOUBLE AS average_rank FROM (
  SELECT *, rank() OVER (PARTITION BY class ORDER BY score) + (count(*) OVER (PARTITION BY class, score) - 1) / 2.0 AS r FROM ov) GROUP BY class, score""")
def average_ranks(t):
    return metrics.average_ranks(metrics.one_vs_rest(scored(t), []), ["class"])


@query("auroc_ovr", f"WITH {SCORES}, {AUROC.format('', 'class')} SELECT class, n, n_pos, round(auroc, 6) AS auroc FROM au")
def auroc_ovr(t):
    return rounded(metrics.auroc(metrics.one_vs_rest(scored(t), []), ["class"]), "auroc")


RECALL = """
rc AS (SELECT fold, truth AS class, avg((truth = predicted)::INT) AS recall FROM sc GROUP BY ALL),
pc AS (SELECT DISTINCT fold, predicted AS class FROM sc),
al AS (SELECT fold, class, coalesce(recall, 0) AS recall FROM rc FULL JOIN pc USING (fold, class)),
mr AS (SELECT fold, avg(recall) AS macro_recall FROM al GROUP BY fold)"""


@query("class_recall", f"""
WITH {SCORES} SELECT truth AS class, count(*)::BIGINT AS n, round(avg((truth = predicted)::INT), 6) AS recall FROM sc GROUP BY truth""")
def class_recall(t):
    return rounded(metrics.class_recall(scored(t), []), "recall")


@query("fold_metrics", f"""
WITH {SCORES}, {AUROC.format('f', 'fold, class')}, {RECALL}, ma AS (SELECT fold, avg(auroc) AS macro_auroc FROM auf GROUP BY fold)
SELECT fold, round(macro_auroc, 6) AS macro_auroc, round(macro_recall, 6) AS macro_recall FROM ma JOIN mr USING (fold)""")
def fold_metrics(t):
    from cohortspark.plans.backmapping import fold_metrics as by_fold

    return rounded(by_fold(scored(t), 3), "macro_auroc", "macro_recall")


@query("fold_summary", f"""
WITH {SCORES}, {AUROC.format('f', 'fold, class')}, {RECALL}, ma AS (SELECT fold, avg(auroc) AS macro_auroc FROM auf GROUP BY fold)
SELECT 'macro_auroc' AS metric, round(avg(macro_auroc), 3) AS mean, round(stddev_samp(macro_auroc), 3) AS std FROM ma
UNION ALL SELECT 'macro_recall', round(avg(macro_recall), 3), round(stddev_samp(macro_recall), 3) FROM mr""")
def fold_summary(t):
    from cohortspark.plans.backmapping import fold_metrics as by_fold

    return reports.tables({"folds": by_fold(scored(t), 3)})["table_backmapping_cv_summary"]


@query("stratified_folds", """
WITH n AS (SELECT c_mktsegment AS label, count(*) AS n FROM customer GROUP BY ALL), f AS (SELECT unnest(range(5))::INT AS fold)
SELECT label, fold, (n // 5 + (fold < n % 5)::INT)::BIGINT AS n FROM n CROSS JOIN f""")
def stratified_folds(t):
    folds = feat.stratified_folds(t.customer.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("label")), "id", "label", 5)
    return folds.groupBy("label", "fold").agg(F.count("*").alias("n"))


def importances(t: Tables) -> DataFrame:
    """Mean price per brand and part type, as importance per feature and cluster."""
    return t.part.groupBy(F.col("p_type").alias("cluster"), F.col("p_brand").alias("feature")).agg(F.avg("p_retailprice").alias("mean_abs_shap"))


IMP = "imp AS (SELECT p_type AS cluster, p_brand AS feature, avg(p_retailprice) AS v FROM part GROUP BY ALL)"


@query("top_features", f"""
WITH {IMP}, r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY v DESC, feature) AS rank FROM imp)
SELECT cluster, feature, round(v, 6) AS mean_abs_shap, rank::INT AS rank FROM r WHERE rank <= 15""")
def top_features(t):
    return rounded(reports.plot_data({"attribution_summary": importances(t)})["fig3_shap_per_cluster"], "mean_abs_shap")


@query("importance_mean", f"""
WITH {IMP} SELECT feature, round(avg(v), 6) AS importance FROM imp GROUP BY feature ORDER BY avg(v) DESC, feature LIMIT 20""")
def importance_mean(t):
    mean = summary.mean_importance(importances(t).withColumnRenamed("mean_abs_shap", "importance"))
    top = reports.tables({"folds": by_part(t), "importance": mean})["table_backmapping_top_features"]
    return rounded(top, "importance")


def by_part(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_size").alias("macro_auroc"), F.col("p_retailprice").alias("macro_recall"))


@query("mean_abs_attribution", """
WITH phi AS (SELECT l_returnflag AS cluster, l_linestatus AS class, 'quantity' AS feature, l_quantity - 25 AS phi FROM lineitem
  UNION ALL SELECT l_returnflag, l_linestatus, 'discount', 0.05 - l_discount FROM lineitem
  UNION ALL SELECT l_returnflag, l_returnflag, 'tax', l_tax - 0.04 FROM lineitem)
SELECT cluster, feature, round(avg(abs(phi)), 6) AS mean_abs_shap FROM phi WHERE class = cluster GROUP BY ALL""")
def mean_abs_attribution(t):
    rows = F.array(
        F.struct(F.col("l_linestatus").alias("class"), F.lit("quantity").alias("feature"), (F.col("l_quantity") - 25).alias("phi")),
        F.struct(F.col("l_linestatus").alias("class"), F.lit("discount").alias("feature"), (F.lit(0.05) - F.col("l_discount")).alias("phi")),
        F.struct(F.col("l_returnflag").alias("class"), F.lit("tax").alias("feature"), (F.col("l_tax") - 0.04).alias("phi")))
    phi = t.lineitem.select(F.col("l_returnflag").alias("cluster"), F.inline(rows))
    return rounded(summary.mean_abs_attribution(phi), "mean_abs_shap")


@query("plot_clusters", f"""
WITH {SUR.format(time='l_quantity')} SELECT c_custkey AS id, c_acctbal AS umap_x, c_nationkey AS umap_y, lab.cluster AS cluster_label
FROM customer JOIN lab USING (c_custkey)""")
def plot_clusters(t):
    """Customers on two of their columns, coloured by cluster."""
    display = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("umap_x"), F.col("c_nationkey").alias("umap_y"))
    labels = customer_labels(t).withColumnRenamed("custkey", "id")
    return reports.plot_data({"display": display, "labels": labels})["fig2_umap_clusters"]


@query("running_totals", """
WITH d AS (SELECT user_id, date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY ALL)
SELECT user_id, epoch(day)::BIGINT AS day, n::BIGINT AS n, (sum(n) OVER (PARTITION BY user_id ORDER BY day ROWS UNBOUNDED PRECEDING))::BIGINT AS upto,
  (sum(n) OVER (PARTITION BY user_id ORDER BY day DESC ROWS UNBOUNDED PRECEDING))::BIGINT AS at_risk FROM d""")
def running_totals(t):
    from cohortspark.operators.ordered import plan_buckets, running

    day = F.unix_timestamp(F.date_trunc("day", "ts"))
    counts = t.events.groupBy("user_id", day.alias("day")).agg(F.count("*").alias("n"))
    buckets = plan_buckets(counts, "day", window_rows=1000)
    up = running(counts, ["user_id"], "day", {"upto": "n"}, buckets)
    down = running(up, ["user_id"], "day", {"at_risk": "n"}, buckets, descending=True)
    return down.select("user_id", long("day").alias("day"), "n", "upto", "at_risk")
