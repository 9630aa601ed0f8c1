"""Out-of-fold prediction of cluster labels from structured columns."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from cohortspark.operators import features as feat, metrics
from cohortspark.operators.summary import known_labels, mean_importance
from cohortspark.runtime import cut, ensure_checkpoint_dir, together


class FittedClassifier:
    """Class probabilities from either one multiclass forest or one boosted model per class."""

    def __init__(self, models: list, classes: list[int], used: list[str], boosted: bool):
        self.models, self.classes, self.used, self.boosted = models, classes, used, boosted

    def probabilities(self, df: DataFrame, out: str = "probs", vec: str | None = None) -> DataFrame:
        """Adds array<struct<class, prob>>, in class order."""
        if vec is None:
            df = VectorAssembler(inputCols=self.used, outputCol="_vec").transform(df)
            vec = "_vec"
        raw = []
        for i, model in enumerate(self.models):
            model = model.copy()
            model.setFeaturesCol(vec)
            model.setProbabilityCol(f"_p{i}")
            model.setPredictionCol(f"_c{i}")
            model.setRawPredictionCol(f"_r{i}")
            df = model.transform(df).drop(f"_c{i}", f"_r{i}")
            raw.append(vector_to_array(f"_p{i}"))
        n = len(self.classes)
        if not self.boosted:
            values = [F.get(raw[0], F.lit(i)) for i in range(n)]
        elif n == 2:
            values = [F.get(raw[0], F.lit(0)), F.get(raw[0], F.lit(1))]
        else:
            own = [F.get(r, F.lit(1)) for r in raw]
            total = reduce(lambda x, y: x + y, own)
            values = [F.when(total > 0, v / total).otherwise(1.0 / n) for v in own]
        cells = [F.struct(F.lit(int(c)).cast("long").alias("class"), v.alias("prob")) for c, v in zip(self.classes, values)]
        drop = [f"_p{i}" for i in range(len(self.models))] + (["_vec"] if vec == "_vec" else [])
        return df.withColumn(out, F.array(*cells)).drop(*drop)

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds ``probs`` and ``predicted`` (most probable class, the smaller one on a tie)."""
        scored = self.probabilities(df)
        best = F.array_max(F.transform("probs", lambda p: F.struct(p["prob"].alias("p"), (-p["class"]).alias("c"))))
        return scored.withColumn("predicted", -best["c"])

    def leaves(self, spark) -> list[tuple[dict[int, tuple[float | None, float | None]], list[float]]]:
        """Every leaf of the forest: its bounds (low, high] per column on its path, and what it adds to the probability of each class."""
        path = f"{ensure_checkpoint_dir(spark)}/models/{uuid.uuid4().hex}"
        self.models[0].write().save(path)
        nodes = {}
        for r in spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect():  # model-sized
            nodes[r["treeID"], r["id"]] = r
        trees = sorted({tree for tree, _ in nodes})
        out = []

        def walk(tree, at, bounds):
            node = nodes[tree, at]
            if node["leftChild"] < 0:
                total = sum(node["impurityStats"])
                out.append((bounds, [v / total / len(trees) for v in node["impurityStats"]]))
                return
            i, split = node["split"]["featureIndex"], node["split"]["leftCategoriesOrThreshold"][0]
            if node["split"]["numCategories"] != -1:
                raise ValueError("columns of categories have no bounds")
            low, high = bounds.get(i, (None, None))
            walk(tree, node["leftChild"], {**bounds, i: (low, split)})
            walk(tree, node["rightChild"], {**bounds, i: (split, high)})

        for tree in trees:
            walk(tree, 0, {})
        return out

    def importances(self, spark) -> DataFrame:
        """(feature, importance), averaged over the models."""
        total = [0.0] * len(self.used)
        for m in self.models:
            for i, v in enumerate(m.featureImportances.toArray()):
                total[i] += float(v) / len(self.models)
        return spark.createDataFrame(list(zip(self.used, total)), "feature string, importance double")


def train(df: DataFrame, used: list[str], label: str = "cluster_label", boosted: bool = False, trees: int = 20,
          depth: int = 5, seed: int = 42) -> FittedClassifier:
    """Forest over all classes, or boosted trees (one per class, one in all for two classes)."""
    classes = sorted(int(r[0]) for r in df.select(label).distinct().collect())  # class list: model-sized
    assembled = VectorAssembler(inputCols=used, outputCol="_vec").transform(df)
    place = F.create_map(*[F.lit(x) for i, c in enumerate(classes) for x in (c, float(i))])
    assembled = assembled.withColumn("_y", F.element_at(place, F.col(label).cast("int")))
    if not boosted:
        forest = RandomForestClassifier(featuresCol="_vec", labelCol="_y", numTrees=trees, maxDepth=depth, seed=seed)
        return FittedClassifier([forest.fit(assembled)], classes, used, False)
    targets = [1] if len(classes) == 2 else range(len(classes))

    def fit(i):
        one = assembled.withColumn("_t", (F.col("_y") == i).cast("double"))
        return lambda: GBTClassifier(featuresCol="_vec", labelCol="_t", maxIter=trees, maxDepth=depth, stepSize=0.05, seed=seed).fit(one)

    return FittedClassifier(together(df.sparkSession, [fit(i) for i in targets]), classes, used, True)


def out_of_fold(frame: DataFrame, used: list[str], key: str, label: str = "cluster_label", folds: int = 5, seed: int = 42,
                **options) -> tuple[DataFrame, DataFrame]:
    """(key, fold, truth, predicted, probs) with every row predicted by a model that did not see it,
    and (fold, feature, importance)."""
    with_fold = cut(feat.stratified_folds(frame, key, label, folds, seed))
    parts, weights = [], []

    def fit(fold):
        return lambda: train(with_fold.filter(F.col("fold") != fold), used, label, seed=seed, **options)

    for fold, model in enumerate(together(frame.sparkSession, [fit(fold) for fold in range(folds)])):
        held = model.predict(with_fold.filter(F.col("fold") == fold))
        parts.append(held.select(key, "fold", F.col(label).cast("long").alias("truth"), "predicted", "probs"))
        weights.append(model.importances(frame.sparkSession).withColumn("fold", F.lit(fold)))
    return cut(reduce(DataFrame.unionByName, parts)), reduce(DataFrame.unionByName, weights)


def wide_probabilities(oof: DataFrame, key: str, classes: list[int] | None = None) -> DataFrame:
    """One prob_cluster_{class} column per class found in the probabilities; given classes have to hold all of them."""
    classes = known_labels(oof.select(F.explode("probs").alias("p")).select("p.class"), "class", classes)
    lookup = F.map_from_entries("probs")
    return oof.select(key, F.col("truth").alias("true_cluster"), F.col("predicted").alias("predicted_cluster"),
                      *[F.element_at(lookup, F.lit(c).cast("long")).alias(f"prob_cluster_{c}") for c in classes])


def fold_metrics(oof: DataFrame, n_classes: int) -> DataFrame:
    """fold, macro_auroc, macro_recall."""
    areas = metrics.auroc(metrics.one_vs_rest(oof, ["fold"]), ["fold", "class"])
    return (metrics.macro_auroc(areas, ["fold"], binary=n_classes == 2)
            .join(metrics.macro_recall(oof, ["fold"]), "fold"))


def class_metrics(oof: DataFrame) -> DataFrame:
    """cluster, auroc, recall, n over all out-of-fold rows."""
    scores = metrics.one_vs_rest(oof.withColumn("_all", F.lit(1)), ["_all"])
    areas = metrics.auroc(scores, ["class"]).select("class", "auroc")
    recall = metrics.class_recall(oof, [])
    return areas.join(recall, "class").select(F.col("class").alias("cluster"), "auroc", "recall", "n")


def backmap(features: DataFrame, labels: DataFrame, key: str, wanted: list[str], folds: int = 5, seed: int = 42,
            **options) -> dict[str, DataFrame]:
    """Out-of-fold predictions, fold and class metrics, mean importance."""
    frame, used = feat.feature_frame(features, labels, key, wanted, "all")
    frame = cut(frame)
    oof, weights = out_of_fold(frame, used, key, folds=folds, seed=seed, **options)
    n_classes = frame.select("cluster_label").distinct().count()
    return {"oof": oof, "folds": fold_metrics(oof, n_classes), "classes": class_metrics(oof),
            "importance": mean_importance(weights).orderBy(F.col("importance").desc(), "feature")}


