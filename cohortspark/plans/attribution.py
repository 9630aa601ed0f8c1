"""Which columns carry a cluster: permutation importance and sampled Shapley attributions."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F, types as T

from cohortspark.operators import features as feat, metrics
from cohortspark.operators.ordered import global_row_number
from cohortspark.operators.summary import mean_abs_attribution
from cohortspark.plans.backmapping import FittedClassifier, train
from cohortspark.runtime import cut


#: Background rows that may be broadcast.
MOST_BACKGROUND = 10_000
#: Columns whose coalitions are all enumerated.
MOST_EXACT = 12


def _rows_in_random_order(frame: DataFrame, used: list[str], key: str, label: str, seed: int) -> tuple[DataFrame, int]:
    """(key, truth, x, at): features as an array, positions 0..n-1 along a seeded hash of the key."""
    rows = frame.select(key, F.col(label).cast("long").alias("truth"), F.array(*[F.col(c) for c in used]).alias("x"))
    hashed = rows.withColumn("_h", F.xxhash64(F.lit(seed), F.col(key)))
    placed = cut(global_row_number(hashed, ["_h", key], "at", 0).drop("_h"))
    return placed, placed.count()


def _multiplier(n: int, seed: int) -> int:
    """A factor without common divisor with n, near the golden section of n."""
    a = max(1, int(n * 0.6180339887) + seed)
    while math.gcd(a, n) != 1:
        a += 1
    return a % n or 1


def permutation_importance(model: FittedClassifier, frame: DataFrame, key: str, label: str = "cluster_label",
                           n_repeats: int = 10, seed: int = 42) -> DataFrame:
    """feature, mean_decrease_auroc, std (population) of the macro one-vs-rest area.

    Rows stand in a random order; the permutation of repeat r and feature f sends position p to
    (a p + b) mod n with a coprime to n and b from a hash of (r, f). So the shuffled value comes from one
    equi-join on the position, and all features and repeats are scored in one plan.
    """
    used = model.used
    rows, n = _rows_in_random_order(frame, used, key, label, seed)
    a = _multiplier(n, seed)
    jobs = F.explode(F.sequence(F.lit(0), F.lit(len(used) * n_repeats - 1)))
    wanted = (rows.withColumn("job", jobs)
              .withColumn("from_at", F.pmod(F.col("at") * a + F.pmod(F.xxhash64("job", F.lit(seed)), F.lit(n)), F.lit(n))))
    donors = rows.select(F.col("at").alias("from_at"), F.col("x").alias("donor"))
    feature = F.floor(F.col("job") / n_repeats).cast("int")
    mixed = wanted.join(donors, "from_at").select(
        "truth", "job", F.transform("x", lambda v, i: F.when(i == feature, F.get("donor", i)).otherwise(v)).alias("x"))
    # the unshuffled rows are job -1 of the same plan
    every = mixed.unionByName(rows.select("truth", F.lit(-1).alias("job"), "x"))
    scored = model.probabilities(every.select("truth", "job", array_to_vector("x").alias("_v")), vec="_v")
    per_class = metrics.auroc(metrics.one_vs_rest(scored, ["job"]), ["job", "class"])
    macro = cut(metrics.macro_auroc(per_class, ["job"], binary=len(model.classes) == 2))
    base = macro.filter(F.col("job") == -1).first()["macro_auroc"]
    names = F.array(*[F.lit(c) for c in used])
    drop = F.lit(base) - F.col("macro_auroc")
    return (macro.filter(F.col("job") >= 0)
            .groupBy(F.get(names, F.floor(F.col("job") / n_repeats).cast("int")).alias("feature"))
            .agg(F.avg(drop).alias("mean_decrease_auroc"), F.stddev_pop(drop).alias("std")))


def _background(model: FittedClassifier, frame: DataFrame, key: str, label: str, n_background: int, seed: int):
    """Rows in random order, the background rows (bg, b), their number, and their mean score per class (class, base)."""
    if n_background > MOST_BACKGROUND:
        raise ValueError(f"a background of more than {MOST_BACKGROUND} rows is not broadcast")
    rows, n = _rows_in_random_order(frame, model.used, key, label, seed)
    size = min(n_background, n)
    background = cut(rows.filter(F.col("at") < size).select(F.col("at").alias("bg"), F.col("x").alias("b")))
    scored = model.probabilities(background.select(array_to_vector("b").alias("_v")), vec="_v").select(F.explode("probs").alias("p"))
    base = cut(scored.groupBy(F.col("p.class").alias("class")).agg(F.avg("p.prob").alias("base")))
    return rows, background, size, base


def sampled_attributions(model: FittedClassifier, frame: DataFrame, key: str, label: str = "cluster_label",
                         n_background: int = 500, n_samples: int = 4, seed: int = 42) -> DataFrame:
    """(key, cluster, feature, class, phi, std_error, n_samples, base).

    Sampled Shapley values of the class probability: for each row and sample, one background row and one
    order of the columns; the columns are switched from the background to the row one after the other and
    each change of the score goes to the switched column. Samples come in pairs, the second with the order reversed; over all rows
    and samples every background row is drawn equally often, give or take one. ``base`` is the mean score of the whole
    background, the same for all rows. What the drawn background rows differ from it is shared among a row's columns in
    proportion to their squared standard errors, so base and phi always add up to the score.
    """
    used = model.used
    m = len(used)
    rows, background, size, base = _background(model, frame, key, label, n_background, seed)
    pair = F.floor(F.col("s") / 2)
    draws = (rows.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1))))
             # rows stand in random order, so consecutive places are as good as random ones and use the background evenly
             .withColumn("bg", F.pmod(F.col("at") * n_samples + F.col("s"), F.lit(size)).cast("long"))
             .join(F.broadcast(background), "bg"))  # at most n_background rows
    columns = F.sequence(F.lit(0), F.lit(m - 1))
    order = F.transform(F.sort_array(F.transform(columns, lambda i: F.struct(
        F.xxhash64(F.col("at"), pair, i, F.lit(seed + 1)).alias("h"), i.alias("i")))), lambda p: p["i"])
    order = F.when(F.col("s") % 2 == 1, F.reverse(order)).otherwise(order)
    steps = (draws.withColumn("order", order).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(m))))
             .withColumn("on", F.slice("order", 1, F.col("step")))
             .withColumn("v", F.transform("x", lambda v, i: F.when(F.array_contains(F.col("on"), i), v)
                                          .otherwise(F.get("b", i)))))
    scored = model.probabilities(steps.select(key, "truth", "s", "step", "order", array_to_vector("v").alias("_v")), vec="_v")
    # m + 1 scores per row and sample, so a list per (row, sample) is as small as a feature vector
    walks = scored.groupBy(key, "s").agg(
        F.first("truth").alias("truth"), F.first("order").alias("order"),
        F.transform(F.sort_array(F.collect_list(F.struct("step", "probs"))), lambda w: w["probs"]).alias("walk"))
    moves = walks.select(key, "truth", F.posexplode("order").alias("j", "i"), "walk").select(
        key, "truth", "i", F.explode(F.arrays_zip(
            F.get("walk", F.col("j")).alias("before"), F.get("walk", F.col("j") + 1).alias("after"),
            F.get("walk", F.lit(0)).alias("start"))).alias("c"))
    names = F.array(*[F.lit(c) for c in used])
    delta = F.col("c.after.prob") - F.col("c.before.prob")
    raw = (moves.groupBy(key, "truth", F.col("c.after.class").alias("class"), "i")
           .agg(F.avg(delta).alias("phi"), (F.stddev_samp(delta) / F.sqrt(F.count("*"))).alias("std_error"),
                F.count("*").alias("n_samples"), F.avg("c.start.prob").alias("start")))
    # a row's m values stand in one list while the rest is shared out
    lists = raw.groupBy(key, "truth", "class").agg(F.collect_list(F.struct("i", "phi", "std_error", "n_samples")).alias("v"), F.first("start").alias("start"))
    squared = F.aggregate("v", F.lit(0.0), lambda s, x: s + F.coalesce(x["std_error"] * x["std_error"], F.lit(0.0)))
    part = F.when(F.col("sum2") > 0, F.coalesce(F.col("c.std_error") * F.col("c.std_error"), F.lit(0.0)) / F.col("sum2")).otherwise(1.0 / m)
    return (lists.withColumn("sum2", squared).join(F.broadcast(base), "class")  # one row per class
            .select(key, "truth", "class", "start", "base", "sum2", F.explode("v").alias("c"))
            .select(key, F.col("truth").alias("cluster"), F.get(names, F.col("c.i")).alias("feature"), "class",
                    (F.col("c.phi") + (F.col("start") - F.col("base")) * part).alias("phi"), "c.std_error", "c.n_samples", "base"))


def exact_attributions(model: FittedClassifier, frame: DataFrame, key: str, label: str = "cluster_label", n_background: int = 100,
                       seed: int = 42) -> DataFrame:
    """(key, cluster, feature, class, phi, base): Shapley values by all coalitions of at most MOST_EXACT columns.

    The worth of a coalition is the mean score over the background rows with its columns taken from the row.
    """
    used = model.used
    m = len(used)
    if m > MOST_EXACT:
        raise ValueError(f"more than {MOST_EXACT} columns have too many coalitions; sample them")
    rows, background, _, base = _background(model, frame, key, label, n_background, seed)
    worth = _by_coalitions if model.boosted else _by_leaves
    wide = worth(model, rows, background, key).join(F.broadcast(base), "class")  # one row per class
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"_{i}").alias("phi")) for i, c in enumerate(used)]))
    return wide.select(key, F.col("truth").alias("cluster"), "class", each.alias("c"), "base").select(
        key, "cluster", "c.feature", "class", "c.phi", "base")


def _by_coalitions(model: FittedClassifier, rows: DataFrame, background: DataFrame, key: str) -> DataFrame:
    """(key, truth, class, _0, _1, ..): every row scored with every background row and coalition."""
    m = len(model.used)
    mixed = (rows.join(F.broadcast(background)).withColumn("on", F.explode(F.sequence(F.lit(0), F.lit((1 << m) - 1))))
             .withColumn("v", F.transform("x", lambda v, i: F.when(F.getbit(F.col("on"), i) == 1, v).otherwise(F.get("b", i)))))
    scored = model.probabilities(mixed.select(key, "truth", "on", array_to_vector("v").alias("_v")), vec="_v")
    worth = (scored.select(key, "truth", "on", F.explode("probs").alias("p"))
             .groupBy(key, "truth", F.col("p.class").alias("class"), "on").agg(F.avg("p.prob").alias("w")))
    # of a coalition of s columns each member gains, and each other column loses, its worth times a weight of s
    inside = F.array(*[F.lit(math.factorial(s - 1) * math.factorial(m - s) / math.factorial(m)) if s else F.lit(0.0) for s in range(m + 1)])
    outside = F.array(*[F.lit(math.factorial(s) * math.factorial(m - s - 1) / math.factorial(m)) if s < m else F.lit(0.0) for s in range(m + 1)])
    size = F.bit_count("on")
    terms = [F.sum(F.col("w") * F.when(F.getbit(F.col("on"), F.lit(i)) == 1, F.get(inside, size)).otherwise(-F.get(outside, size))).alias(f"_{i}") for i in range(m)]
    return worth.groupBy(key, "truth", "class").agg(*terms)


def _leaf_table(bounds: dict, probs: list[float], background: np.ndarray, m: int) -> tuple[list, np.ndarray]:
    """Tests (column, low, high) of a leaf, and for each set of tests a row passes what the leaf gives (class, column), on average over
    the background.

    A coalition leads a mixed row to the leaf if it holds all columns only the row passes and none of those only the background row
    passes; a column neither passes shuts the leaf off.
    """
    tests = [(i, *b) for i, b in sorted(bounds.items())]
    k = len(tests)
    seen, counts = np.unique(_passed(tests, background), return_counts=True)
    of_row = np.arange(1 << k)
    table = np.zeros((1 << k, len(probs), m))
    for other, n in zip(seen, counts):
        own, its = of_row & ~other, other & ~of_row
        a, b = (np.array([int(v).bit_count() for v in side]) for side in (own, its))
        open_ = (of_row | other) == (1 << k) - 1
        for j, (i, _, _) in enumerate(tests):
            gain = [math.factorial(x - 1) * math.factorial(y) / math.factorial(x + y) if x else 0.0 for x, y in zip(a, b)]
            loss = [math.factorial(x) * math.factorial(y - 1) / math.factorial(x + y) if y else 0.0 for x, y in zip(a, b)]
            share = np.where(own >> j & 1, gain, 0.0) - np.where(its >> j & 1, loss, 0.0)
            table[:, :, i] += (np.where(open_, share, 0.0) * n / len(background))[:, None] * np.array(probs)
    return tests, table.reshape(1 << k, -1)


def _passed(tests: list, x: np.ndarray) -> np.ndarray:
    """Bit j of a row is set if it passes test j."""
    out = np.zeros(len(x), dtype=np.int64)
    for j, (i, low, high) in enumerate(tests):
        passes = np.ones(len(x), dtype=bool)
        if low is not None:
            passes &= ~(x[:, i] <= low)
        if high is not None:
            passes &= x[:, i] <= high
        out |= passes.astype(np.int64) << j
    return out


def _by_leaves(model: FittedClassifier, rows: DataFrame, background: DataFrame, key: str) -> DataFrame:
    """As :func:`_by_coalitions`, for forests: a score is a sum over leaves, and so are its Shapley values.

    What a leaf gives depends on which of the few columns on its path a row passes, so it is worked out once for each such set, and a row
    looks it up.
    """
    m, n = len(model.used), len(model.classes)
    known = np.array([r["b"] for r in background.select("b").collect()], dtype=float).reshape(-1, m)  # at most MOST_BACKGROUND rows
    tables = [_leaf_table(bounds, probs[:n], known, m) for bounds, probs in model.leaves(rows.sparkSession)]

    def shares(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, m)
                phi = np.zeros((len(x), n * m))
                for tests, table in tables:
                    phi += table[_passed(tests, x)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(phi[:, j]) for j in range(n * m)]],
                                                 names=[key, "truth", *[f"_{j}" for j in range(n * m)]])

    given = rows.select(key, "truth", "x")
    schema = T.StructType([*given.schema.fields[:2], *[T.StructField(f"_{j}", T.DoubleType()) for j in range(n * m)]])
    # rows of one key and class label share their values
    mean = given.mapInArrow(shares, schema).groupBy(key, "truth").agg(*[F.avg(f"_{j}").alias(f"_{j}") for j in range(n * m)])
    each = F.explode(F.array(*[F.struct(F.lit(int(c)).cast("long").alias("class"), *[F.col(f"_{c_at * m + i}").alias(f"_{i}") for i in range(m)])
                               for c_at, c in enumerate(model.classes)]))
    return mean.select(key, "truth", each.alias("c")).select(key, "truth", "c.*")


def explain(features: DataFrame, labels: DataFrame, key: str, wanted: list[str], n_background: int = 500,
            n_repeats: int = 10, n_samples: int = 4, seed: int = 42, **options) -> dict[str, DataFrame]:
    """Classifier on imputed, unscaled columns; attributions, their summary and permutation importance."""
    frame, used = feat.feature_frame(features, labels, key, wanted, "none")
    frame = cut(frame)
    model = train(frame, used, seed=seed, **options)
    phi = cut(sampled_attributions(model, frame, key, n_background=n_background, n_samples=n_samples, seed=seed))
    return {"attributions": phi, "summary": mean_abs_attribution(phi),
            "importance": permutation_importance(model, frame, key, n_repeats=n_repeats, seed=seed)
            .orderBy(F.col("mean_decrease_auroc").desc(), "feature")}
