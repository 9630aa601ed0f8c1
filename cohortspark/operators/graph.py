"""Neighbour graphs, spanning trees and components as repeated joins and aggregates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cohortspark.operators import neighbors
from cohortspark.runtime import cut, discard

BISECTION_STEPS = 64
MIN_SIGMA_SCALE = 1e-3


def knn_graph(points: DataFrame, k: int, metric: str = "cosine", id_col: str = "id", vec_col: str = "vec",
              **search) -> DataFrame:
    """(src, dst, rank, dist): the k nearest other points of every point; cosine distance is 1 - similarity."""
    found = neighbors.nearest(points, points, k, metric, id_col, id_col, vec_col, vec_col,
                              exclude_same_id=True, **search)
    dist = F.col("distance") if metric == "euclidean" else F.round(1 - F.col("similarity"), 12)
    return found.select(F.col("query_id").alias("src"), F.col("neighbor_id").alias("dst"), "rank", dist.alias("dist"))


def smooth_distances(knn: DataFrame, k: int) -> DataFrame:
    """(src, rho, sigma): rho is the nearest positive distance, sigma solves
    sum(exp(-max(0, d - rho) / sigma)) = log2(k) by bisection, vectorised over a batch of rows."""
    lists = knn.groupBy("src").agg(F.sort_array(F.collect_list("dist")).alias("d"))  # k entries per row
    average = knn.agg(F.avg("dist")).first()[0] or 0.0
    target = float(np.log2(k))

    def solve(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            width = max(len(x) for x in pdf["d"])
            d = np.full((len(pdf), width), np.inf)
            for i, x in enumerate(pdf["d"]):
                d[i, :len(x)] = x
            real = np.isfinite(d)
            positive = np.where(real & (d > 0), d, np.inf).min(1)
            rho = np.where(np.isfinite(positive), positive, 0.0)
            gap = np.where(real, np.maximum(np.where(real, d, 0.0) - rho[:, None], 0.0), np.inf)
            low, high = np.zeros(len(pdf)), np.full(len(pdf), np.inf)
            sigma = np.ones(len(pdf))
            for _ in range(BISECTION_STEPS):
                total = np.exp(-gap / sigma[:, None]).sum(1)
                above = total > target
                high = np.where(above, sigma, high)
                low = np.where(above, low, sigma)
                sigma = np.where(np.isinf(high), sigma * 2, (low + np.where(np.isinf(high), low, high)) / 2)
                sigma = np.maximum(sigma, 1e-300)
            mean = np.where(real, np.where(real, d, 0.0), 0.0).sum(1) / real.sum(1)
            floor = MIN_SIGMA_SCALE * np.where(rho > 0, mean, average)
            yield pd.DataFrame({"src": pdf["src"], "rho": rho, "sigma": np.maximum(sigma, floor)})

    return lists.mapInPandas(solve, f"src {knn.schema['src'].dataType.simpleString()}, rho double, sigma double")


def fuzzy_graph(knn: DataFrame, k: int) -> DataFrame:
    """(src, dst, weight) in both directions: membership a + b - ab of the two directed strengths."""
    scale = smooth_distances(knn, k)
    gap = F.greatest(F.col("dist") - F.col("rho"), F.lit(0.0))
    strength = F.when((gap <= 0) | (F.col("sigma") <= 0), 1.0).otherwise(F.exp(-gap / F.col("sigma")))
    directed = knn.join(scale, "src").select("src", "dst", strength.alias("a"))
    # a pair occurs at most once per direction: 1 - prod(1 - w) is a + b - ab
    both = directed.select("src", "dst", "a").unionByName(directed.select(F.col("dst").alias("src"),
                                                                          F.col("src").alias("dst"), "a"))
    merged = both.groupBy("src", "dst").agg(F.sum("a").alias("s"), F.min("a").alias("lo"), F.max("a").alias("hi"),
                                            F.count("*").alias("n"))
    weight = F.when(F.col("n") == 1, F.col("s")).otherwise(F.col("s") - F.col("lo") * F.col("hi"))
    return merged.select("src", "dst", weight.alias("weight"))


def core_distances(knn: DataFrame, min_samples: int) -> DataFrame:
    """(id, core): distance to the min_samples-th neighbour (the farthest known one when there are fewer)."""
    return (knn.filter(F.col("rank") <= min_samples).groupBy(F.col("src").alias("id"))
            .agg(F.max("dist").alias("core")))


def undirected(edges: DataFrame, weight: str) -> DataFrame:
    """One row (a < b) per unordered pair."""
    pair = edges.filter(F.col("src") != F.col("dst")).select(
        F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.col(weight).alias("w"))
    return pair.groupBy("a", "b").agg(F.min("w").alias("w"))


def mutual_reachability(knn: DataFrame, min_samples: int) -> DataFrame:
    """(a, b, w) with a < b and w = max(core of a, core of b, distance) on the neighbour graph."""
    core = core_distances(knn, min_samples)
    pairs = undirected(knn, "dist")
    return (pairs.join(core.select(F.col("id").alias("a"), F.col("core").alias("ca")), "a")
            .join(core.select(F.col("id").alias("b"), F.col("core").alias("cb")), "b")
            .select("a", "b", F.greatest("w", "ca", "cb").alias("w")))


def connected_components(edges: DataFrame, vertices: DataFrame | None = None, max_rounds: int = 100) -> DataFrame:
    """(id, component): smallest id of the component, for edges (a, b) and optional isolated vertices.

    Rounds of neighbour minimum followed by pointer jumping; only changed rows count for the stop test.
    A vertex with very many edges is combined map-side.
    """
    both = (edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            .filter(F.col("a") != F.col("b")).distinct())
    both = cut(both)
    ids = both.select(F.col("a").alias("id")).distinct()
    if vertices is not None:
        ids = ids.unionByName(vertices.select("id")).distinct()
    state = held = cut(ids.withColumn("component", F.col("id")))
    for _ in range(max_rounds):
        offered = (both.join(state.select(F.col("id").alias("b"), F.col("component").alias("c")), "b")
                   .groupBy(F.col("a").alias("id")).agg(F.min("c").alias("near")))
        hooked = (state.join(offered, "id", "left")
                  .select("id", F.col("component").alias("old"),
                          F.least("component", F.coalesce("near", "component")).alias("component")))
        # a root adopts the best offer any of its members got, then pointers are halved
        adopted = hooked.groupBy(F.col("old").alias("root")).agg(F.min("component").alias("best"))
        new = (hooked.join(adopted.select(F.col("root").alias("component"), F.col("best").alias("up")), "component", "left")
               .select("id", "old", F.least("component", F.coalesce("up", "component")).alias("component")))
        new = cut(new)
        discard(held)
        state, held = new.select("id", "component"), new
        if new.filter(F.col("old") != F.col("component")).isEmpty():
            discard(both)
            return state
    raise RuntimeError("components did not settle")


def pointer_jump(parents: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(id, root) from (id, parent), where roots point to themselves. Each round follows four pointers."""
    state = held = cut(parents.select("id", F.col("parent").alias("root")))

    def doubled(s):
        up = s.select(F.col("id").alias("root"), F.col("root").alias("next"))
        return s.join(up, "root").select("id", F.col("next").alias("root"), F.col("root").alias("before"))

    for _ in range(max_rounds):
        state_next = cut(doubled(doubled(state).select("id", "root")))
        discard(held)
        state, held = state_next.select("id", "root"), state_next
        if state_next.filter(F.col("root") != F.col("before")).isEmpty():
            return state
    raise RuntimeError("pointers did not settle")


def _nearest_outside(points: DataFrame, assigned: DataFrame, cells: neighbors.Cells, members: DataFrame,
                     limits: DataFrame) -> DataFrame:
    """For each point of a listed component: its best edge to another component not longer than the limit.

    ``points`` (id, vec, core), ``assigned`` (rep, vec, core, cell), ``members`` (id, component),
    ``limits`` (component, limit; null when no edge is known). Only cells within the limit are visited,
    and a cell that lies wholly in the component is skipped.
    """
    where = assigned.join(members.select(F.col("id").alias("rep"), F.col("component").alias("ccomp")), "rep")
    purity = where.groupBy("cell").agg(F.min("ccomp").alias("lo"), F.max("ccomp").alias("hi")).collect()
    one = np.full(cells.size, np.iinfo(np.int64).min)  # component of a pure cell
    for r in purity:
        if r["lo"] == r["hi"]:
            one[r["cell"]] = r["lo"]
    q = (points.join(members, "id").join(limits, "component")
         .select(F.col("id").alias("qrep"), "vec", F.col("core").alias("qcore"), F.col("component").alias("qcomp"),
                 F.coalesce("limit", F.lit(1e300)).alias("limit"))
         .filter(F.col("qcore") <= F.col("limit")))

    def reach(pdf, d):
        return neighbors._reach_mask(d, cells, pdf["limit"].to_numpy()) & (
            one[None, :] != pdf["qcomp"].to_numpy()[:, None])

    def kernel(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"a": [], "b": [], "w": []}).astype({"a": "int64", "b": "int64", "w": "float64"})
        if q.empty or c.empty:
            return empty
        c = c.sort_values("rep")
        rows, ids, core, comp = (neighbors._matrix(c["vec"]), c["rep"].to_numpy(), c["core"].to_numpy(),
                                 c["ccomp"].to_numpy())
        out = []
        for at in range(0, len(q), neighbors.SCORE_ROWS):
            part = q.iloc[at:at + neighbors.SCORE_ROWS]
            w = np.round(neighbors._distances(neighbors._matrix(part["vec"]), rows), 12)
            w = np.maximum(np.maximum(w, part["qcore"].to_numpy()[:, None]), core[None, :])
            w = np.where(part["qcomp"].to_numpy()[:, None] == comp[None, :], np.inf, w)
            best = w.argmin(1)
            value = w[np.arange(len(part)), best]
            keep = value <= part["limit"].to_numpy()
            keep &= np.isfinite(value)
            out.append(pd.DataFrame({"a": part["qrep"].to_numpy()[keep], "b": ids[best][keep], "w": value[keep]}))
        return pd.concat(out, ignore_index=True) if out else empty

    routed = neighbors.route(q, cells, reach)
    found = neighbors.visit(routed, where, cells, kernel, "a long, b long, w double", "qrep")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w")


def spanning_tree(edges: DataFrame, vertices: DataFrame, points: DataFrame | None = None,
                  knn_radius: DataFrame | None = None, max_rounds: int = 64) -> DataFrame:
    """Minimum spanning forest (a, b, w) by rounds in which every component takes its lightest edge.

    Edges are compared by (w, a, b), a total order, so a round cannot close a cycle.

    With ``points`` (id, vec, core) and ``knn_radius`` (id, radius of its neighbour list) the result is
    the exact tree of the complete mutual-reachability graph: in each round a component's best listed
    edge is accepted only if no point of it could have a shorter unlisted one; otherwise the missing
    edges are searched.
    """
    state = cut(vertices.select("id", F.col("id").alias("component")))
    visible = cut(edges.select("a", "b", "w"))
    tree = None
    assigned = cells = None
    n_components, n_before = state.count(), None
    for _ in range(max_rounds):
        if n_components <= 1 or n_components == n_before:
            break
        n_before = n_components
        ca = state.select(F.col("id").alias("a"), F.col("component").alias("compa"))
        cb = state.select(F.col("id").alias("b"), F.col("component").alias("compb"))

        def crossing(e):
            return (e.join(ca, "a").join(cb, "b").filter(F.col("compa") != F.col("compb"))
                    .select("a", "b", "w", "compa", "compb"))

        cross = cut(crossing(visible))
        both = cross.select(F.col("compa").alias("component"), "a", "b", "w").unionByName(
            cross.select(F.col("compb").alias("component"), "a", "b", "w"))
        if points is not None:
            best = both.groupBy("component").agg(F.min("w").alias("limit"))
            closest = state.join(knn_radius, "id").groupBy("component").agg(F.min("radius").alias("reach"))
            # an unlisted edge is at least as long as the radius of the list it is missing from
            open_ = cut(closest.join(best, "component", "left")
                        .filter(F.col("limit").isNull() | (F.col("reach") < F.col("limit")))
                        .select("component", "limit"))
            if not open_.isEmpty():
                if assigned is None:
                    plain = cut(points.select(F.col("id").alias("rep"), "vec"))
                    placed, cells = neighbors.build_cells(plain, plain.count())
                    assigned = cut(placed.join(points.select(F.col("id").alias("rep"), "core"), "rep"))
                inner = points.join(knn_radius, "id").join(state, "id").join(open_, "component")
                inner = inner.filter(F.col("limit").isNull() | (F.col("radius") < F.col("limit")))
                extra = _nearest_outside(inner.select("id", "vec", "core"), assigned, cells, state, open_)
                extra = cut(crossing(extra.groupBy("a", "b").agg(F.min("w").alias("w"))))
                cross = cross.unionByName(extra)
                both = cross.select(F.col("compa").alias("component"), "a", "b", "w").unionByName(
                    cross.select(F.col("compb").alias("component"), "a", "b", "w"))
        picks = cut(both.groupBy("component").agg(F.min(F.struct("w", "a", "b")).alias("e"))
                    .select("component", "e.*")
                    .join(ca, "a").join(cb, "b")
                    .withColumn("other", F.when(F.col("component") == F.col("compa"), F.col("compb"))
                                .otherwise(F.col("compa"))))
        if picks.isEmpty():
            break
        chosen = picks.select("a", "b", "w").distinct()
        tree = chosen if tree is None else tree.unionByName(chosen)
        back = picks.select(F.col("component").alias("other"), F.col("other").alias("back"))
        # a mutual pick is rooted at its smaller component; a component without any pick is a root
        rooted = (picks.join(back, "other", "left")
                  .select(F.col("component").alias("id"),
                          F.when((F.col("back") == F.col("component")) & (F.col("component") < F.col("other")),
                                 F.col("component")).otherwise(F.col("other")).alias("parent")))
        # only components with a pick move; the others stay as they are and need no pointer
        moved = pointer_jump(rooted.unionByName(
            rooted.select(F.col("parent").alias("id")).distinct().join(rooted.select("id"), "id", "left_anti").withColumn("parent", F.col("id"))))
        gone = moved.filter(F.col("id") != F.col("root")).count()
        new = cut(state.join(moved.select(F.col("id").alias("component"), "root"), "component", "left")
                  .select("id", F.coalesce("root", "component").alias("component")))
        n_components -= gone
        discard(state)
        state = new
        visible = cross.select("a", "b", "w")
    else:
        raise RuntimeError("the spanning tree did not settle")
    if tree is None:
        return visible.limit(0)
    return cut(tree)

