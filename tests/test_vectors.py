import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.operators import approximate, density, density as density_module, graph, layout as lay, neighbors, spectral
from cohortspark.operators.summary import concordance
from cohortspark.plans import phenotypes
from cohortspark.runtime import cut


def frame(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in zip(ids, x)], "id long, vec array<double>")


def clumped(n=400, d=6, seed=0):
    """A third of the rows are copies of one vector, some rows are zero, the rest sits in clumps."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * 0.3 + rng.integers(0, 4, (n, 1)) * rng.normal(size=(1, d)) * 2
    x[: n // 3] = x[0]
    x[n // 3: n // 3 + 3] = 0
    return x[rng.permutation(n)]


def brute(q, c, k, metric, exclude):
    if metric == "cosine":
        def unit(m):
            return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        score = np.round(unit(q) @ unit(c).T, 9)
    else:
        score = -np.round(np.linalg.norm(q[:, None, :] - c[None, :, :], axis=2), 9)
    out = []
    for i in range(len(q)):
        order = np.lexsort((np.arange(len(c)), -score[i]))
        order = [j for j in order if not (exclude and j == i)][:k]
        out.append([round(float(score[i, j]), 7) for j in order])
    return out


@pytest.mark.parametrize("metric,pivots,block,exclude", [("cosine", 12, 32_768, True), ("euclidean", 20, 16, False), ("euclidean", 1, 50, True)])
def test_nearest_is_exact(spark, metric, pivots, block, exclude):
    x = clumped()
    df = frame(spark, x).repartition(5)
    got = neighbors.nearest(df, df, 7, metric, exclude_same_id=exclude, n_pivots=pivots, block_rows=block).toPandas()
    value = "similarity" if metric == "cosine" else "distance"
    want = brute(x, x, 7, metric, exclude)
    assert len(got) == 7 * len(x)
    for q, part in got.sort_values(["query_id", "rank"]).groupby("query_id"):
        sign = 1 if metric == "cosine" else -1
        assert np.allclose(sign * part[value].to_numpy(), want[q], atol=2e-7)
        assert part["rank"].tolist() == list(range(1, 8)) and (not exclude or q not in set(part["neighbor_id"]))
        ties = part.groupby(part[value].round(9))["neighbor_id"]
        assert all(ids.is_monotonic_increasing for _, ids in ties)


@pytest.mark.parametrize("metric, exclude, most, pivots", [("cosine", True, 6, 30), ("euclidean", False, 4, 90)])
def test_two_levels_of_pivots_give_the_same(spark, monkeypatch, metric, exclude, most, pivots):
    monkeypatch.setattr(neighbors, "MAX_PIVOTS", most)
    x = clumped(500, 5, 3)
    df = frame(spark, x).repartition(4)
    calls = []
    build = neighbors.build_tree
    monkeypatch.setattr(neighbors, "build_tree", lambda *a: calls.append(build(*a)) or calls[-1])
    got = neighbors.nearest(df, df, 6, metric, exclude_same_id=exclude, n_pivots=pivots, block_rows=40).toPandas().sort_values(["query_id", "rank"])
    monkeypatch.setattr(neighbors, "MAX_PIVOTS", 1024)
    want = neighbors.nearest(df, df, 6, metric, exclude_same_id=exclude, n_pivots=8).toPandas().sort_values(["query_id", "rank"])
    assert len(calls) == 1 and calls[0][1].tops.size <= most
    cells = calls[0][1].branches.select("n").toPandas()["n"]
    assert len(cells) > most and cells.sum() == len(np.unique(x, axis=0)) and cells.max() < 200
    assert got.drop(columns=got.columns[3]).to_numpy().tolist() == want.drop(columns=want.columns[3]).to_numpy().tolist()
    assert np.allclose(got.iloc[:, 3], want.iloc[:, 3], atol=1e-6)


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_approximate_neighbours(spark, metric):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(3000, 24)) + rng.integers(0, 12, (3000, 1)) * rng.normal(size=(12, 24))[rng.integers(0, 12, 3000)] * 0.3
    x[:900] = x[0]  # a hot bucket in every table
    df = frame(spark, x).repartition(6)
    found = cut(approximate.nearest(df, df, 5, metric, exclude_same_id=True, bucket_rows=64))
    exact = cut(neighbors.nearest(df, df, 5, metric, exclude_same_id=True))
    recall = approximate.recall_per_query(found, exact).toPandas()
    assert len(recall) == 3000 and recall["recall"].mean() >= 0.9 and (recall["recall"][recall["query_id"] < 900] == 1).all()
    pdf = found.toPandas()
    assert (pdf.groupby("query_id")["rank"].apply(lambda r: sorted(r) == list(range(1, len(r) + 1)))).all()
    assert not (pdf["query_id"] == pdf["neighbor_id"]).any()
    assert approximate.nearest(df.limit(0), df, 3, metric).count() == 0 and approximate.nearest(df, df.limit(0), 3, metric).count() == 0


def test_approximate_search_visits_few_rows(spark, monkeypatch):
    """The rows a query is compared with do not grow with the table: twice the rows, about the same per query."""
    rng = np.random.default_rng(3)
    seen = {}
    for n in (2000, 4000):
        made = approximate.make_tables(n, 16, np.zeros(16), 4, 125)
        x = rng.normal(size=(n, 16))
        codes = made.codes(made.project(x))
        p = made.project(x[:200])
        visited = made.codes(p)[:, :, None] ^ made.masks(p)[0][:, :, :6]
        seen[n] = np.mean([np.isin(codes[:, t], visited[i, t]).sum() for i in range(200) for t in range(4)])
    assert seen[4000] < 1.3 * seen[2000] < 1300


def plain_ranks(x, metric):
    if metric == "cosine":
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    d = np.round(np.linalg.norm(x[:, None] - x[None], axis=2), 10)
    out = np.zeros(d.shape, int)
    for i in range(len(x)):
        order = sorted((j for j in range(len(x)) if j != i), key=lambda j: (d[i, j], j))
        out[i, order] = np.arange(1, len(x))
    return out


def test_neighbour_preservation_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    n, k = 160, 6
    x = rng.normal(size=(n, 7))
    x[:30] = x[0]
    y = np.concatenate([x[:, :2] + rng.normal(size=(n, 2)) * 0.4])
    y[100:110] = y[100]
    got = lay.preservation(frame(spark, x), frame(spark, y).withColumnRenamed("vec", "y"), k).toPandas().sort_values("id")
    rx, ry = plain_ranks(x, "cosine"), plain_ranks(y, "euclidean")
    most = k * (2 * n - 3 * k - 1) / 2
    off = ~np.eye(n, dtype=bool)
    trust = 1 - (np.where((ry <= k) & (rx > k) & off, rx - k, 0)).sum(1) / most
    continuity = 1 - (np.where((rx <= k) & (ry > k) & off, ry - k, 0)).sum(1) / most
    assert np.allclose(got["trustworthiness"], trust) and np.allclose(got["continuity"], continuity)


def test_copies_are_told_apart_by_id(spark):
    x = np.array([[1.0, 0.0]] * 6 + [[0.0, 1.0]])
    got = neighbors.nearest(frame(spark, x), frame(spark, x), 3, "euclidean", exclude_same_id=True).toPandas()
    lists = got.sort_values("rank").groupby("query_id")["neighbor_id"].apply(list).to_dict()
    assert lists[0] == [1, 2, 3] and lists[2] == [0, 1, 3] and lists[5] == [0, 1, 2] and lists[6] == [0, 1, 2]


def test_corpus_smaller_than_k_or_empty(spark):
    df = frame(spark, np.eye(3))
    assert neighbors.nearest(df, df, 10).count() == 9
    assert neighbors.nearest(df, df.limit(0), 10).count() == 0


def reachability(x, m):
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    core = np.sort(d, axis=1)[:, m]
    return np.maximum(np.maximum(core[:, None], core[None]), d)


def prim(w):
    n = len(w)
    inside, best, total = np.zeros(n, bool), w[0].copy(), 0.0
    inside[0] = True
    for _ in range(n - 1):
        j = np.where(inside, np.inf, best).argmin()
        total += best[j]
        inside[j] = True
        best = np.minimum(best, w[j])
    return total


def blobs(seed=5, scattered=30):
    rng = np.random.default_rng(seed)
    centers = np.array([[0, 0, 0], [10, 0, 0], [0, 10, 3]])
    x = np.concatenate([rng.normal(size=(80, 3)) * 0.7 + c for c in centers] + [rng.uniform(-8, 18, (scattered, 3))])
    return x, np.array([0] * 80 + [1] * 80 + [2] * 80 + [-1] * scattered)


def tree_of(spark, x, m):
    points = cut(frame(spark, x))
    knn = cut(graph.knn_graph(points, m, "euclidean"))
    radius = knn.groupBy(F.col("src").alias("id")).agg(F.max("dist").alias("radius"))
    return graph.spanning_tree(graph.mutual_reachability(knn, m), points.select("id"),
                               points.join(graph.core_distances(knn, m), "id"), radius)


def test_spanning_tree_is_the_exact_one(spark):
    x, _ = blobs()
    edges = tree_of(spark, x, 4).toPandas()
    assert len(edges) == len(x) - 1 and edges["w"].sum() == pytest.approx(prim(reachability(x, 4)), rel=1e-8)
    joined = graph.connected_components(spark.createDataFrame(edges[["a", "b"]])).select("component").distinct().count()
    assert joined == 1


def test_forest_of_the_neighbour_graph_alone(spark):
    x, _ = blobs(scattered=0)
    knn = cut(graph.knn_graph(frame(spark, x), 4, "euclidean"))
    edges = graph.mutual_reachability(knn, 4)
    forest = graph.spanning_tree(edges, frame(spark, x)).count()
    parts = graph.connected_components(edges).select("component").distinct().count()
    assert parts >= 3 and forest == len(x) - parts


def test_components(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 150, (90, 2))] + [(200, i) for i in range(201, 260)] + [(i, i + 1) for i in range(300, 360)]
    df = spark.createDataFrame(pairs, "a long, b long")
    root = {v: v for p in pairs for v in p}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in pairs:
        ra, rb = find(a), find(b)
        root[max(ra, rb)] = min(ra, rb)
    lone = spark.createDataFrame([(999,)], "id long")
    touched = {v for a, b in pairs if a != b for v in (a, b)}
    got = {r["id"]: r["component"] for r in graph.connected_components(df, lone).collect()}
    assert got == {**{v: find(v) for v in touched}, 999: 999}


def test_smooth_distances_and_union(spark):
    x = np.random.default_rng(4).normal(size=(120, 5))
    knn = cut(graph.knn_graph(frame(spark, x), 10, "euclidean"))
    scale = graph.smooth_distances(knn, 10).toPandas().set_index("src")
    pdf = knn.toPandas()
    for src, part in pdf.groupby("src"):
        gap = np.maximum(part["dist"] - scale.loc[src, "rho"], 0)
        assert np.exp(-gap / scale.loc[src, "sigma"]).sum() == pytest.approx(np.log2(10), abs=1e-4)
    fuzzy = graph.fuzzy_graph(knn, 10).toPandas()
    w = {(a, b): v for a, b, v in fuzzy[["src", "dst", "weight"]].itertuples(index=False)}
    assert all(0 < v <= 1 + 1e-12 for v in w.values()) and all(abs(w[b, a] - v) < 1e-12 for (a, b), v in w.items())


def agreement(spark, labels, truth):
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(labels, truth)], "a long, b long")
    return concordance(df, "a", "b").first()


def test_planted_clusters_are_found(spark):
    x, truth = blobs()
    got = phenotypes.cluster_points(frame(spark, x), 40, 5).toPandas().sort_values("id")
    assert got["cluster_label"].max() == 2 and agreement(spark, got["cluster_label"], truth)["ari"] > 0.95
    noise = got["cluster_label"] == -1
    assert (got.loc[noise, "cluster_probability"] == 0).all() and got["cluster_probability"].between(0, 1).all()
    assert noise[truth == -1].mean() > 0.5 and noise[truth != -1].mean() < 0.1


def plain_density(n, edges, least, epsilon=0.0):
    """Labels and probabilities by removing the edges weight by weight, all parts looked at each time."""
    def parts(members, limit):
        root = {v: v for v in members}

        def top(v):
            while root[v] != v:
                v = root[v]
            return v

        for a, b, w in edges:
            if a in root and b in root and w < limit:
                root[top(a)] = top(b)
        groups = {}
        for v in members:
            groups.setdefault(top(v), []).append(v)
        return list(groups.values())

    density = {w: 1 / max(w, density_module.TINY) for _, _, w in edges} | {np.inf: 0.0}
    tree = []  # per cluster: parent, birth, members, falls (point: lambda), children, death

    def grow(members, parent, birth):
        me = {"parent": parent, "birth": birth, "falls": {}, "kids": [], "all": members, "mass": 0.0, "death": 0.0}
        tree.append(me)
        now, limit = members, np.inf
        while True:
            inside = set(now)
            weights = [w for a, b, w in edges if a in inside and b in inside and w < limit]
            whole = parts(now, limit)
            if len(whole) > 1:
                w = limit
                pieces = whole
            elif not weights:
                return me
            else:
                w = max(weights)
                pieces = parts(now, w)
            here = density[w]
            big = [p for p in pieces if len(p) >= least]
            me["death"] = max(me["death"], here)
            for p in pieces:
                if len(p) < least or len(big) != 1:
                    me["mass"] += len(p) * (here - birth)
                if len(p) < least:
                    me["falls"].update({v: here for v in p})
            if len(big) >= 2:
                me["kids"] = [grow(p, me, here) for p in big]
                return me
            if not big:
                return me
            now, limit = big[0], w

    root = grow(list(range(n)), None, 0.0)

    def best(c):
        below = sum(best(k) for k in c["kids"])
        c["chosen"] = c is not root and c["mass"] >= below
        return max(c["mass"], below)

    best(root)
    picked = []

    def pick(c):
        if c["chosen"]:
            picked.append(c)
        else:
            for k in c["kids"]:
                pick(k)

    pick(root)
    final = []
    for c in picked:
        while epsilon and c["birth"] > 0 and 1 / c["birth"] < epsilon and c["parent"] is not root:
            c = c["parent"]
        final.append(c)
    label, prob = np.full(n, -1), np.zeros(n)

    def falls(c):
        out = dict(c["falls"])
        for k in c["kids"]:
            out.update(falls(k))
        return out

    final = sorted({id(c): c for c in final}.values(), key=lambda c: len(c["all"]))
    for i, c in enumerate(final):
        for v, here in falls(c).items():
            label[v], prob[v] = i, min(here, c["death"]) / c["death"] if c["death"] else 0.0
    return label, prob


def same_partition(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b)) and all((x == -1) == (y == -1) for x, y in zip(a, b))


@pytest.mark.parametrize("least, epsilon, leaf", [(5, 0.0, 50_000), (15, 0.0, 7), (3, 1.5, 1)])
def test_density_hierarchy_is_exact(spark, monkeypatch, least, epsilon, leaf):
    """Rounded weights give many ties; short runs go through the search over digits."""
    monkeypatch.setattr(density, "BASE", 4)
    if leaf == 7:
        monkeypatch.setattr(density, "LOCAL_CLUSTERS", 0)
    rng = np.random.default_rng(least)
    n = 300 if leaf > 1 else 90
    centers = rng.normal(size=(9, 2)) * 8
    x = centers[rng.integers(0, 9, n)] + rng.normal(size=(n, 2)) * rng.choice([0.3, 1.0, 3.0], (n, 1))
    d = np.round(np.linalg.norm(x[:, None] - x[None], axis=2), 1)
    inside, edges = {0}, []
    best = {j: (d[0, j], 0) for j in range(1, n)}
    while best:
        j = min(best, key=lambda v: best[v])
        w, i = best.pop(j)
        edges.append((i, j, float(w)))
        for v in best:
            best[v] = min(best[v], (d[j, v], j))
    tree = spark.createDataFrame(edges, "a long, b long, w double")
    got = density.density_clusters(tree, spark.range(n), least, epsilon, leaf).toPandas().sort_values("id")
    label, prob = plain_density(n, edges, least, epsilon)
    assert label.max() >= 1 and same_partition(got["cluster_label"].tolist(), label.tolist())
    assert np.allclose(got["cluster_probability"], prob)


def test_density_of_a_forest_and_of_text_ids(spark):
    edges = [(10 * p + i, 10 * p + i + 1, 1.0 + 0.01 * i) for p in range(3) for i in range(9)]
    tree = spark.createDataFrame([(f"v{a:03}", f"v{b:03}", w) for a, b, w in edges], "a string, b string, w double")
    ids = spark.createDataFrame([(f"v{i:03}",) for i in range(31)], "id string")
    got = {r["id"]: r["cluster_label"] for r in density.density_clusters(tree, ids, 8).collect()}
    want, _ = plain_density(31, [(a, b, w) for a, b, w in edges], 8)
    assert same_partition([got[f"v{i:03}"] for i in range(31)], want.tolist()) and want.max() == 2


def test_two_groups_of_ten_parts(spark):
    """Two far groups of ten touching parts each: two clusters, however many different weights there are."""
    rng = np.random.default_rng(1)
    edges = []
    for part in range(20):
        edges += [(100 * part + i, 100 * part + i + 1, 0.9 + 0.001 * rng.random()) for i in range(99)]
        if part % 10:
            edges.append((100 * part - 1, 100 * part, 1.0 + 0.001 * rng.random()))
    edges.append((999, 1000, 50.0))
    tree = spark.createDataFrame(edges, "a long, b long, w double")
    got = density.density_clusters(tree, spark.range(2000), 50).groupBy("cluster_label").count().collect()
    assert sorted((r["cluster_label"], r["count"]) for r in got) == [(0, 1000), (1, 1000)]


def test_too_small_for_any_cluster(spark):
    got = phenotypes.cluster_points(frame(spark, np.eye(4)), 50, 2).toPandas()
    assert (got["cluster_label"] == -1).all() and len(got) == 4


def test_layout_keeps_neighbours_and_is_repeatable(spark):
    rng = np.random.default_rng(6)
    centers = rng.normal(size=(3, 12)) * 6
    x = np.concatenate([rng.normal(size=(50, 12)) + c for c in centers])
    points = cut(frame(spark, x))
    weights = cut(graph.fuzzy_graph(cut(graph.knn_graph(points, 8, "euclidean")), 8))
    a = lay.layout(weights, points, 2, epochs=5).toPandas().sort_values("id")
    b = lay.layout(weights.repartition(3), points, 2, epochs=5).toPandas().sort_values("id")
    ya, yb = np.stack(a["y"]), np.stack(b["y"])
    assert ya.shape == (150, 2) and np.allclose(ya, yb, atol=1e-6)
    d = np.linalg.norm(ya[:, None] - ya[None], axis=2)
    np.fill_diagonal(d, np.inf)
    same = [(np.argsort(row)[:5] // 50 == i // 50).mean() for i, row in enumerate(d)]
    assert np.mean(same) > 0.95
    assert lay.curve_parameters(0.1) == pytest.approx((1.577, 0.895), abs=5e-3)


def test_layout_in_parts(spark, monkeypatch):
    """Parts, frozen neighbours and hubs: the groups still come out, and other partitions give the same."""
    monkeypatch.setattr(lay, "HUB_EDGES", 12)
    rng = np.random.default_rng(6)
    centers = rng.normal(size=(3, 12)) * 6
    x = np.concatenate([rng.normal(size=(50, 12)) + c for c in centers])
    points = cut(frame(spark, x))
    weights = cut(graph.fuzzy_graph(cut(graph.knn_graph(points, 8, "euclidean")), 8))
    a, b = (lay.layout(w, points, 2, epochs=12, part_rows=40, round_epochs=4).toPandas().sort_values("id") for w in (weights, weights.repartition(3)))
    ya, yb = np.stack(a["y"]), np.stack(b["y"])
    assert ya.shape == (150, 2) and np.allclose(ya, yb, atol=1e-6)
    d = np.linalg.norm(ya[:, None] - ya[None], axis=2)
    np.fill_diagonal(d, np.inf)
    assert np.mean([(np.argsort(row)[:5] // 50 == i // 50).mean() for i, row in enumerate(d)]) > 0.95


def test_one_epoch_by_the_book(spark):
    """Attraction of one epoch, worked out edge by edge (partners are drawn, so repulsion is switched off)."""
    rng = np.random.default_rng(9)
    y = rng.normal(size=(20, 2))
    edges = sorted({(int(i), int(j)) for i, j in rng.integers(0, 20, (60, 2)) if i != j})
    w = rng.random(len(edges))
    a, b = 1.577, 0.895
    rows = [(i, -1, 0.0, y[i].tolist(), [0.0, 0.0]) for i in range(20)]
    rows += [(i, j, float(k), [0.0, 0.0], y[j].tolist()) for (i, j), k in zip(edges, w)]
    import pyarrow as pa
    table = pa.table({n: [r[c] for r in rows] for c, n in enumerate(("v", "u", "weight", "y", "yu"))})
    import unittest.mock
    with unittest.mock.patch.object(lay, "NEGATIVE_RATE", 0.0):
        got = np.stack(lay._epochs(2, 20, 0, 1, 1, a, b, 1, np.zeros((0, 2)))(table).column("y").to_pylist())
    want = y.copy()
    for i in range(20):
        force, total = np.zeros(2), 0.0
        for (s, t), k in zip(edges, w):
            if s == i:
                d = y[i] - y[t]
                d2 = d @ d
                force += k * np.clip(-2 * a * b * d2 ** (b - 1) / (1 + a * d2 ** b) * d, -4, 4)
                total += k
        want[i] += force / max(total, 1.0)
    assert np.allclose(got, want)


def test_leading_vectors_against_a_dense_solver(spark):
    x = np.random.default_rng(11).normal(size=(60, 3))
    points = cut(frame(spark, x))
    weights = cut(graph.fuzzy_graph(cut(graph.knn_graph(points, 8, "euclidean")), 8))
    found, values = spectral.leading_vectors(weights, 3, steps=24)
    w = np.zeros((60, 60))
    for r in weights.collect():
        w[r["src"], r["dst"]] = r["weight"]
    root = np.sqrt(w.sum(1))
    matrix = w / root[:, None] / root[None, :]
    want = np.sort(np.linalg.eigvalsh(matrix))[::-1][1:4]
    got = np.stack(found.toPandas().sort_values("id")["vector"])
    assert np.allclose([v for v, _ in values], want, atol=1e-3)
    for i, (value, residual) in enumerate(values):
        v = got[:, i]
        assert np.linalg.norm(v) == pytest.approx(1, abs=1e-8) and abs(v @ root) < 1e-8
        assert np.linalg.norm(matrix @ v - value * v) == pytest.approx(residual, abs=1e-6) and residual < 0.05
        assert v[np.abs(v).argmax()] > 0
    start = found.withColumnRenamed("vector", "pc")
    y = lay.layout(weights, points, 2, epochs=3, start=start).toPandas()
    assert len(y) == 60 and np.isfinite(np.stack(y["y"])).all()


def test_leading_vectors_of_a_small_graph(spark):
    edges = [(0, 1, 1.0), (1, 0, 1.0), (1, 2, 1.0), (2, 1, 1.0)]
    found, values = spectral.leading_vectors(spark.createDataFrame(edges, "src long, dst long, weight double"), 5)
    assert [round(v, 6) for v, _ in values] == [0.0, -1.0] and found.count() == 3


def test_principal_components(spark):
    x = np.random.default_rng(7).normal(size=(80, 4)) @ np.diag([3, 2, 1, 0.1])
    scores, ratios = lay.principal_components(frame(spark, x), 2)
    got = np.stack(scores.toPandas().sort_values("id")["pc"])
    u, s, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(u[:, :2] * s[:2]), atol=1e-6)
    assert np.allclose(ratios, (s ** 2 / (s ** 2).sum())[:2])


def test_concordance_closed_forms(spark):
    same = agreement(spark, [0, 0, 1, 1, 2], [5, 5, 7, 7, 9])
    assert same["ari"] == pytest.approx(1) and same["nmi"] == pytest.approx(1) and same["n_compared"] == 5
    empty = agreement(spark, [-1, 0], [0, -1])
    assert empty["ari"] is None and empty["nmi"] is None and empty["n_compared"] == 0
    one = agreement(spark, [0, 0, 0], [4, 4, 4])
    assert (one["ari"], one["nmi"]) == (1.0, 1.0)
    half = agreement(spark, [0, 0, 1, 1], [0, 1, 0, 1])
    assert half["ari"] == pytest.approx(-0.5) and half["nmi"] == pytest.approx(0)


def test_a_query_travels_once_to_a_region(spark, monkeypatch):
    """Cells that a query visits share its vector, so rows grow with the regions, not with the cells."""
    x = np.random.default_rng(1).normal(size=(600, 8))
    routed = []

    def kept(queries, cells, *args, route=neighbors.route):
        routed.append((route(queries, cells, *args), cells))
        return routed[-1][0]

    monkeypatch.setattr(neighbors, "REGIONS", 4)
    monkeypatch.setattr(neighbors, "route", kept)
    df = frame(spark, x)
    got = neighbors.nearest(df, df, 5, "euclidean", exclude_same_id=True, n_pivots=60).toPandas()
    assert len(routed) == 2
    for df, cells in routed:
        regions = cells.regions(neighbors.BLOCK_ROWS)
        assert len(set(regions)) < 9 and np.bincount(regions, cells.counts).max() <= 150
        sent = df.agg(F.count("*").alias("n"), F.sum(F.size("cells")).alias("visits"), F.count_distinct("qrep", "region").alias("d")).first()
        assert sent["n"] == sent["d"] <= 600 * len(set(regions))
    assert sent["visits"] > 4 * sent["n"]
    value = got.sort_values(["query_id", "rank"]).groupby("query_id")["distance"].apply(lambda v: [-round(w, 7) for w in v]).tolist()
    assert np.allclose(value, brute(x, x, 5, "euclidean", True), atol=1e-6)


def test_few_rows_of_a_sample_reach_the_driver(spark):
    from cohortspark.operators.ordered import least_hashed

    df = spark.range(20_000).repartition(16)
    key = F.xxhash64("id", F.lit(3))
    want = [r["id"] for r in df.orderBy(key, "id").limit(100).collect()]
    found = least_hashed(df, key, "id", 100, 20_000)
    assert [r["id"] for r in found.collect()] == want
    assert "xxhash64" in found._jdf.queryExecution().optimizedPlan().toString().split("Filter")[1].split("\n")[0]
    copies = df.select((F.col("id") * 0).alias("id"))
    assert least_hashed(copies, F.xxhash64("id"), "id", 100, 20_000).count() == 100


def test_ranks_leave_out_every_row_of_the_two_ids(spark):
    """Ids that come again with other vectors; a start with several ends is measured once."""
    rng = np.random.default_rng(6)
    x, ids = rng.normal(size=(60, 2)), np.r_[np.arange(50), np.arange(10)]
    pairs = [(s, d) for s in range(20, 30) for d in (3, 7, 12, 40)]
    got = sorted(tuple(r) for r in neighbors.ranks(spark.createDataFrame(pairs, "src long, dst long"), frame(spark, x, ids), "euclidean", n_pivots=1).collect())
    want = []
    for s, d in pairs:
        for e in np.flatnonzero(ids == d):
            far, dist = np.linalg.norm(x[e] - x[s]), np.linalg.norm(x - x[s], axis=1)
            want.append((s, d, int(((dist < far) & (ids != s) & (ids != d)).sum()) + 1))
    assert got == sorted(want)


@pytest.mark.parametrize("cosine", [True, False])
def test_only_pairs_inside_the_bound_are_scored(monkeypatch, cosine):
    """With a bound that few pairs keep, the block is not ranked as a whole, and nothing inside the bound is lost."""
    import pandas as pd

    rng = np.random.default_rng(3)
    q, c = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (rng.normal(size=(300, 16)), rng.normal(size=(5000, 16))))
    c[100] = c[200]
    score = np.round(q @ c.T if cosine else -neighbors._distances(q, c), 12)
    bound = np.sort(score, axis=1)[:, -4]
    bound[0] = 2.0 if cosine else 0.0  # nothing is near enough
    wanted = {}
    for i in range(300):
        order = np.lexsort((np.arange(5000), -score[i]))
        wanted[i] = [(int(j), float(score[i, j])) for j in order[:3] if score[i, j] >= bound[i] - neighbors.SLACK]

    def queries(limits):
        return pd.DataFrame({"qrep": np.arange(300), "vec": list(q), "bound": limits})

    rows = pd.DataFrame({"rep": np.arange(5000), "vec": list(c)})
    every = neighbors._top_kernel(3, cosine, True)(queries(np.full(300, -1e300)), rows)
    monkeypatch.setattr(neighbors.np, "partition", lambda *a, **k: pytest.fail("all pairs were ranked"))
    found = neighbors._top_kernel(3, cosine, True)(queries(bound), rows)
    pairs = {i: [] for i in range(300)}
    for r in found.itertuples(index=False):
        pairs[int(r.qrep)].append((int(r.crep), float(r.score)))
    assert pairs == wanted and not pairs[0]
    tops = every.groupby("qrep")["crep"].apply(list)
    assert all(tops[i] == [j for j, _ in wanted[i]] for i in range(1, 300))
