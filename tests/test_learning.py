import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.operators import features as feat
from cohortspark.plans import attribution, backmapping, phenotypes
from cohortspark.runtime import cut


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(0)
    n = 300
    x = rng.normal(size=(n, 3))
    y = np.where(x[:, 0] < -0.4, 0, np.where(x[:, 0] < 0.5, 1, 2))
    rows = [(i, *[float(v) for v in row], int(c)) for i, (row, c) in enumerate(zip(x, y))]
    return cut(spark.createDataFrame(rows, "id long, a double, b double, c double, cluster_label int"))


def test_out_of_fold_covers_each_row_once(spark, frame):
    oof, weights = backmapping.out_of_fold(frame, ["a", "b", "c"], "id", folds=3, trees=5)
    pdf = oof.toPandas()
    assert sorted(pdf["id"]) == list(range(300)) and (pdf["truth"] == pdf["predicted"]).mean() > 0.85
    assert all(abs(sum(p["prob"] for p in row) - 1) < 1e-9 and [p["class"] for p in row] == [0, 1, 2] for row in pdf["probs"])
    wide = backmapping.wide_probabilities(oof, "id", [0, 1, 2])
    assert {"true_cluster", "predicted_cluster", "prob_cluster_0", "prob_cluster_2"} <= set(wide.columns)
    metrics = backmapping.fold_metrics(oof, 3).toPandas()
    assert len(metrics) == 3 and (metrics["macro_auroc"] > 0.9).all()
    classes = backmapping.class_metrics(oof).toPandas()
    assert classes["n"].sum() == 300 and (classes["auroc"] > 0.9).all()
    assert weights.count() == 9


def test_boosted_models_give_probabilities(spark, frame):
    model = backmapping.train(frame, ["a", "b", "c"], boosted=True, trees=3, depth=2)
    pdf = model.predict(frame).toPandas()
    assert all(abs(sum(p["prob"] for p in row) - 1) < 1e-9 for row in pdf["probs"]) and (pdf["predicted"] == pdf["cluster_label"]).mean() > 0.8
    two = frame.filter("cluster_label < 2")
    binary = backmapping.train(two, ["a", "b"], boosted=True, trees=3, depth=2)
    assert len(binary.models) == 1 and binary.predict(two).select("predicted").distinct().count() == 2


def test_permutation_importance_finds_the_column(spark, frame):
    model = backmapping.train(frame, ["a", "b", "c"], trees=5)
    got = {r["feature"]: r for r in attribution.permutation_importance(model, frame, "id", n_repeats=3).collect()}
    assert got["a"]["mean_decrease_auroc"] > 0.2 and abs(got["b"]["mean_decrease_auroc"]) < 0.1 and got["a"]["std"] >= 0
    two = frame.filter("cluster_label < 2")
    binary = backmapping.train(two, ["a", "b"], trees=3)
    scores = {r["feature"]: r["mean_decrease_auroc"] for r in attribution.permutation_importance(binary, two, "id", n_repeats=2).collect()}
    assert scores["a"] > 0.2


def test_attributions_add_up(spark, frame):
    """Sampled values and their common base, the mean score of the whole background, add up to the score of each row."""
    model = backmapping.train(frame, ["a", "b", "c"], trees=5)
    phi = cut(attribution.sampled_attributions(model, frame, "id", n_background=50, n_samples=4)).toPandas()
    assert len(phi) == 300 * 3 * 3 and (phi["n_samples"] == 4).all()
    assert (phi.groupby("class")["base"].nunique() == 1).all()
    scored = model.probabilities(frame).select("id", F.explode("probs").alias("p")).select("id", "p.class", "p.prob").toPandas()
    total = phi.groupby(["id", "class"]).agg(phi=("phi", "sum"), base=("base", "first")).reset_index().merge(scored, on=["id", "class"])
    assert np.allclose(total["phi"] + total["base"], total["prob"], atol=1e-9)
    strength = phi.assign(s=phi["phi"].abs()).groupby("feature")["s"].mean()
    assert strength.idxmax() == "a"


def plain_shapley(score, row, background):
    """By all orders of the columns and all background rows."""
    from itertools import permutations

    m = len(row)
    out, orders = np.zeros(m), list(permutations(range(m)))
    for b in background:
        for order in orders:
            at = np.array(b)
            last = score(at)
            for i in order:
                at[i] = row[i]
                now = score(at)
                out[i] += now - last
                last = now
    return out / len(orders) / len(background)


def test_exact_attributions_by_all_orders(spark, frame):
    model = backmapping.train(frame, ["a", "b", "c"], trees=3)
    few = cut(frame.filter("id < 12"))
    got = cut(attribution.exact_attributions(model, few, "id", n_background=5)).toPandas()
    rows, n = attribution._rows_in_random_order(few, ["a", "b", "c"], "id", "cluster_label", 42)
    placed = {r["at"]: (r["id"], list(r["x"])) for r in rows.collect()}
    background = [placed[i][1] for i in range(5)]
    forest = model.models[0]
    from pyspark.ml.linalg import Vectors

    known = {}

    def score(x):
        key = tuple(x)
        if key not in known:
            known[key] = forest.predictProbability(Vectors.dense(x)).toArray()[1]
        return known[key]

    for key, x in [placed[i] for i in (0, 3, 7, 11)]:
        want = plain_shapley(score, x, background)
        mine = got[(got["id"] == key) & (got["class"] == 1)].set_index("feature")["phi"]
        assert np.allclose([mine[c] for c in ("a", "b", "c")], want, atol=1e-9)
    base = got[got["class"] == 1]["base"].unique()
    assert len(base) == 1 and base[0] == pytest.approx(np.mean([score(b) for b in background]))


def test_sampled_attributions_are_near_the_exact_ones(spark, frame):
    model = backmapping.train(frame, ["a", "b", "c"], trees=3)
    few = cut(frame.filter("id < 40"))
    exact = attribution.exact_attributions(model, few, "id", n_background=20).withColumnRenamed("phi", "exact").drop("base", "cluster")
    sampled = attribution.sampled_attributions(model, few, "id", n_background=20, n_samples=60)
    pdf = sampled.join(exact, ["id", "feature", "class"]).toPandas()
    off = (pdf["phi"] - pdf["exact"]).abs()
    assert len(pdf) == 40 * 9 and (off <= 4 * pdf["std_error"] + 0.02).mean() > 0.97 and off.mean() < 0.03


def test_k_means_starts_run_together(spark):
    """The best of several starts is taken for every k; labels and costs belong together."""
    from cohortspark.plans import phenotypes

    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(40, 2)) + c for c in ((0, 0), (9, 0), (0, 9), (9, 9))])
    scores = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, pc array<double>")
    labels, costs = phenotypes.kmeans_range(scores, [3, 4], starts=4)
    once = dict(phenotypes.kmeans_range(scores, [3, 4], starts=1)[1])
    assert all(cost <= once[k] * (1 + 1e-9) for k, cost in costs)
    pdf = labels.toPandas().sort_values("id")
    for k, cost in costs:
        found = pdf[f"kmeans_k{k}_label"].to_numpy()
        centres = np.array([x[found == c].mean(0) for c in range(k)])
        d = ((x[:, None] - centres[None]) ** 2).sum(2)
        assert (d.argmin(1) == found).all() and d.min(1).sum() == pytest.approx(cost, rel=1e-6)


def test_feature_frame_rules(spark):
    df = spark.createDataFrame([(1, 1.0, 0.0), (2, None, 1.0), (3, 5.0, 1.0), (4, 9.0, None)], "id int, x double, flag double")
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, -1), (4, 1)], "id int, cluster_label int")
    out, used = feat.feature_frame(df, labels, "id", ["x", "gone", "flag"], "continuous", ["flag"])
    pdf = out.toPandas().sort_values("id")
    assert used == ["x", "flag"] and pdf["id"].tolist() == [1, 2, 4] and pdf["flag"].tolist() == [0.0, 1.0, 0.5]
    assert np.allclose(pdf["x"], np.array([-4, 0, 4]) / np.std([1, 5, 9]))
    text = spark.createDataFrame([(1, "m")], "id int, sex string")
    with pytest.raises(ValueError):
        feat.feature_frame(text, labels, "id", ["sex"])


def test_comparator_runs_both_clusterings_side_by_side(spark, monkeypatch):
    """k-means and the layout with its clusters wait for each other here: one after the other they would never meet."""
    both = threading.Barrier(2, timeout=60)

    def means(scores, ks, seed=42, starts=10, id_col="id", vec_col="pc", max_iter=100):
        both.wait()
        return scores.select("id", *[F.pmod("id", F.lit(k)).cast("int").alias(f"kmeans_k{k}_label") for k in ks]), [(k, 1.0) for k in ks]

    def dense(vectors, **options):
        both.wait()
        labels = vectors.select("id", F.pmod("id", F.lit(2)).alias("cluster_label"))
        return {"labels": labels, "coords": labels, "display": labels}

    monkeypatch.setattr(phenotypes, "kmeans_range", means)
    monkeypatch.setattr(phenotypes, "phenotype", dense)
    rows = spark.range(12).select("id", (F.col("id") % 5).cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("y"))
    labels = spark.range(12).select("id", (F.col("id") % 2).alias("cluster_label"))
    found = phenotypes.compare(rows, labels, "id", ["x", "y"], [], ks=[2], selected_k=3, n_components=2)
    scores = {r["comparison_pair"]: r["ari"] for r in found["concordance"].collect()}
    assert len(scores) == 3 and scores["embedding_vs_kmeans_k2"] == 1.0 and scores["embedding_vs_structured_umap_hdbscan"] == 1.0
