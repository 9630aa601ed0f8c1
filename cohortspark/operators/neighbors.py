"""Exact k-nearest-neighbour join with metric-space pruning.

Vectors are grouped around sampled pivots (cells). A first pass searches the cells next to each query
and gives a distance bound; a second pass visits only the cells which, by the triangle inequality, can
hold something closer. Cells next to each other make a region of at most a block of rows; a query travels once to each
region with a cell to visit, together with the list of these cells. Routing is an equi-join on (region, block, chunk): a
cell larger than a block is cut into blocks of corpus rows and queries into chunks, so one task never holds more than a
fixed number of either, and only the k best pairs per query and block leave it. Equal vectors are searched once.

With more than MAX_PIVOTS cells the pivots form a tree of two levels: pivots of the first level are sent to every task,
those of the second one meet the rows of their branch only, and queries descend by the bounds of both levels. So a cell
holds about ROWS_PER_PIVOT rows however many there are.

Nothing is dropped: where pruning does not help, all blocks are visited and the result stays exact.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from cohortspark.functions.vectors import l2_normalize
from cohortspark.operators.ordered import global_row_number, least_hashed
from cohortspark.runtime import cut

BLOCK_ROWS, BLOCK_BYTES = 32_768, 1 << 26
MAX_PIVOTS = 1_024
#: Regions that cells are put together to, where no region would hold more than a block of rows; else there are more.
REGIONS = 16
#: Pairs that a task gathers before it keeps the best of them.
GATHERED_ROWS = 1 << 20
ROWS_PER_PIVOT = 1_000
#: Second-level pivots of one branch.
MAX_BRANCH = 4_096
#: Groups whose sizes are broadcast; more are joined.
MOST_SIZES = 100_000
SCORE_ROWS = 256
#: Pairs inside the bound, as a multiple of those wanted, up to which they are scored one by one.
FEW_NEAR = 8
SLACK = 1e-7


@dataclass(frozen=True)
class Cells:
    """Pivot vectors with size and distance range of the corpus rows nearest to each of them."""

    pivots: np.ndarray
    counts: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @property
    def size(self) -> int:
        return len(self.pivots)

    def regions(self, block_rows: int) -> np.ndarray:
        """The region of every cell: runs along a chain in which the nearest pivot not yet seen comes next."""
        most = min(block_rows, -(-int(self.counts.sum()) // REGIONS))
        far, out = _distances(self.pivots, self.pivots), np.zeros(self.size, dtype=np.int32)
        at, region, held = 0, 0, 0
        for _ in range(self.size):
            far[:, at] = np.inf
            if held and held + self.counts[at] > most:
                region, held = region + 1, 0
            out[at], held = region, held + int(self.counts[at])
            at = int(far[at].argmin())
        return out


def _matrix(col: pd.Series) -> np.ndarray:
    return np.stack(col.to_numpy()).astype(np.float64) if len(col) else np.zeros((0, 0))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    sq = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(sq, 0.0))


def prepare(df: DataFrame, id_col: str, vec_col: str, metric: str, corpus: bool) -> DataFrame:
    """(id, vec) in the space searched by Euclidean distance.

    For cosine the rows are unit length. A zero row stays zero, which would upset the order by
    distance, so the corpus side gets one more coordinate that brings every row to length one.
    """
    raw = df.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull())
    if metric == "euclidean":
        vec = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    elif metric == "cosine":
        unit = l2_normalize(F.col(vec_col))
        norm2 = F.aggregate(unit, F.lit(0.0), lambda s, x: s + x * x)
        extra = F.when(norm2 < 0.5, 1.0).otherwise(0.0) if corpus else F.lit(0.0)
        vec = F.concat(unit, F.array(extra))
    else:
        raise ValueError(f"unknown metric {metric}")
    return raw.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"))


def _distinct_vectors(df: DataFrame, keep: int | None) -> tuple[DataFrame, DataFrame | None]:
    """(h1, h2, rep, vec) with one row per distinct vector, and the ``keep`` smallest ids behind each rep.

    Vectors meet by 128 bits of hash, so that only these travel where ids are all that is wanted; vectors that are not
    equal behind equal bits are an error.
    """
    alike = F.when(F.col("vec") == F.col("last"), F.col("vec")).otherwise(F.raise_error(F.lit("unlike vectors share 128 hash bits")))
    reps = (hashed(df).groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.min("vec").alias("vec"), F.max("vec").alias("last"))
            .select("h1", "h2", "rep", alike.alias("vec")))
    if keep is None:
        return reps, None
    # rank limit runs before the shuffle too, so a vector with very many copies stays cheap
    w = Window.partitionBy("h1", "h2").orderBy("id")
    few = hashed(df).select("id", "h1", "h2").withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= keep)
    behind = few.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.sort_array(F.collect_list("id")).alias("ids"))
    return reps, behind.select("rep", "ids")


def hashed(df: DataFrame) -> DataFrame:
    return df.withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit(1), "vec")})


def _with(df: DataFrame, **added: T.DataType) -> T.StructType:
    return T.StructType(df.schema.fields + [T.StructField(k, v) for k, v in added.items()])


def build_cells(corpus: DataFrame, n: int, n_pivots: int | None = None) -> tuple[DataFrame, Cells]:
    """Assign each corpus row (rep, vec) to its nearest pivot: (rep, vec, cell, pivot_dist)."""
    wanted = n_pivots or max(8, -(-n // ROWS_PER_PIVOT))
    wanted = max(1, min(wanted, MAX_PIVOTS, n))
    # a fixed number of rows picked by hash: at most MAX_PIVOTS vectors reach the driver
    picked = least_hashed(corpus, F.xxhash64("rep"), "rep", wanted, n).select("vec").collect()
    pivots = np.array([r["vec"] for r in picked], dtype=np.float64)

    def assign(batches):
        for pdf in batches:
            if len(pdf):
                d = _distances(_matrix(pdf["vec"]), pivots)
                cell = d.argmin(1)
                yield pdf.assign(cell=cell.astype("int32"), pivot_dist=d[np.arange(len(d)), cell])

    schema = _with(corpus, cell=T.IntegerType(), pivot_dist=T.DoubleType())
    assigned = cut(corpus.mapInPandas(assign, schema))
    stats = assigned.groupBy("cell").agg(F.count("*").alias("n"), F.min("pivot_dist").alias("lo"),
                                         F.max("pivot_dist").alias("hi")).collect()
    counts, low, high = np.zeros(len(pivots), dtype=np.int64), np.zeros(len(pivots)), np.zeros(len(pivots))
    for r in stats:
        counts[r["cell"]], low[r["cell"]], high[r["cell"]] = r["n"], r["lo"], r["hi"]
    return assigned, Cells(pivots, counts, low, high)


def _home_mask(d: np.ndarray, cells: Cells, need: int) -> np.ndarray:
    """For each query the nearest cells that together hold ``need`` rows."""
    order = np.argsort(d, axis=1, kind="stable")
    held = np.cumsum(cells.counts[order], axis=1)
    first = np.minimum((held < need).sum(1), cells.size - 1)
    mask = np.zeros(d.shape, dtype=bool)
    ranks = np.arange(cells.size)[None, :] <= first[:, None]
    np.put_along_axis(mask, order, ranks, axis=1)
    return mask & (cells.counts > 0)[None, :]


def _reach_mask(d: np.ndarray, cells: Cells, radius: np.ndarray) -> np.ndarray:
    """Cells that may hold a row within ``radius`` of the query."""
    bound = np.maximum(d - cells.high[None, :], cells.low[None, :] - d)
    return (bound <= radius[:, None] + SLACK) & (cells.counts > 0)[None, :]


def route(queries: DataFrame, cells: Cells, choose, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per query and region to visit, with the cells to visit there. ``choose(pdf, distances)`` returns a boolean matrix."""
    pivots, regions = cells.pivots, cells.regions(block_rows)

    def assign(batches):
        for pdf in batches:
            for at in range(0, len(pdf), SCORE_ROWS):
                part = pdf.iloc[at:at + SCORE_ROWS]
                rows, cell = np.nonzero(choose(part, _distances(_matrix(part["vec"]), pivots)))
                if len(rows):
                    region = regions[cell]
                    order = np.lexsort((cell, region, rows))
                    rows, cell, region = rows[order], cell[order].astype("int32"), region[order]
                    first = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]) | (region[1:] != region[:-1])])
                    yield part.iloc[rows[first]].assign(region=region[first], cells=np.split(cell, first[1:]))

    return queries.mapInPandas(assign, _with(queries, region=T.IntegerType(), cells=T.ArrayType(T.IntegerType())))


def _split_factor(sizes: dict[int, int], block_rows: int) -> Column:
    """Number of parts per region, 1 unless it is larger than a block."""
    many = {c: -(-n // block_rows) for c, n in sizes.items() if n > block_rows}
    if not many:
        return F.lit(1)
    lookup = F.create_map(*[F.lit(x) for kv in many.items() for x in kv])
    return F.coalesce(F.element_at(lookup, F.col("region")), F.lit(1))


def _by_cell(kernel, combine):
    """``kernel`` on each cell of a region with the queries that visit it; ``combine`` shortens what has been gathered."""

    def run(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return kernel(q, c)
        c = c.sort_values("cell", kind="stable")
        names, begin = np.unique(c["cell"].to_numpy(), return_index=True)
        end = np.r_[begin[1:], len(c)]
        lists = q["cells"].to_numpy()
        wanted, row = np.concatenate(lists), np.repeat(np.arange(len(q)), [len(x) for x in lists])
        order = np.argsort(wanted, kind="stable")
        wanted, row = wanted[order], row[order]
        low, high = np.searchsorted(wanted, names), np.searchsorted(wanted, names, "right")
        out, gathered = [kernel(q.iloc[:0], c.iloc[:0])], 0
        for i in range(len(names)):
            if low[i] < high[i]:
                found = kernel(q.iloc[row[low[i]:high[i]]], c.iloc[begin[i]:end[i]])
                out.append(found)
                gathered += len(found)
                if combine is not None and gathered > GATHERED_ROWS:
                    out, gathered = [combine(pd.concat(out, ignore_index=True))], 0
        out = pd.concat([f for f in out if len(f)] or out[:1], ignore_index=True)
        return out if combine is None else combine(out)

    return run


def visit(routed: DataFrame, corpus: DataFrame, cells: Cells, kernel, schema: str, query_key: str,
          block_rows: int = BLOCK_ROWS, combine=None) -> DataFrame:
    """Run ``kernel(queries, rows)`` on every (cell, block of rows, chunk of queries) that was routed.

    ``route`` must have had the same ``block_rows``. ``combine`` may shorten the rows found in one region and block.
    """
    routed = cut(routed)
    n_routed = {r["region"]: r["count"] for r in routed.groupBy("region").count().collect()}  # one row per region
    regions = cells.regions(block_rows)
    n_rows = {r: int(n) for r, n in enumerate(np.bincount(regions, cells.counts))}
    blocks, chunks = _split_factor(n_rows, block_rows), _split_factor(n_routed, block_rows)
    q = (routed.withColumn("chunk", F.pmod(F.xxhash64(query_key), chunks).cast("int"))
         .withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))))
    region = F.element_at(F.array(*[F.lit(int(r)) for r in regions]), F.col("cell") + 1)
    c = (corpus.withColumn("region", region).filter(F.col("region").isin(list(n_routed)))
         .withColumn("block", F.pmod(F.xxhash64("rep", F.lit(7)), blocks).cast("int"))
         .withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1))))
    keys = ["region", "block", "chunk"]
    return q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInPandas(_by_cell(kernel, combine), schema)


def meet(queries: DataFrame, rows: DataFrame, keys: list[str], kernel, schema: str, query_key: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Run ``kernel(queries, rows)`` on what has equal ``keys``, in blocks of rows (``rep``) and chunks of queries.

    Sizes of the groups are a table, not a list on the driver, so there may be any number of groups.
    """
    n, m = (df.groupBy(*keys).agg(F.count("*").alias(name)) for df, name in ((rows, "_n"), (queries, "_m")))
    sizes = cut(n.join(m, keys).select(*keys, F.ceil(F.col("_n") / block_rows).cast("int").alias("_blocks"),
                                       F.ceil(F.col("_m") / block_rows).cast("int").alias("_chunks")))
    few = sizes.count() <= MOST_SIZES

    def sized(df: DataFrame, blocks: str, chunks: str) -> DataFrame:
        named = sizes.withColumnsRenamed({"_blocks": blocks, "_chunks": chunks})
        return df.join(F.broadcast(named) if few else named, keys)

    q = (sized(queries, "_qb", "_qc").withColumn("_chunk", F.pmod(F.xxhash64(query_key), F.col("_qc")).cast("int"))
         .withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_qb") - 1))).drop("_qb", "_qc"))
    c = (sized(rows, "_cb", "_cc").withColumn("_block", F.pmod(F.xxhash64("rep", F.lit(7)), F.col("_cb")).cast("int"))
         .withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.col("_cc") - 1))).drop("_cb", "_cc"))
    at = [*keys, "_block", "_chunk"]
    return q.groupBy(*at).cogroup(c.groupBy(*at)).applyInPandas(kernel, schema)


@dataclass(frozen=True)
class Tree:
    """Pivots of the first level, and per branch the table (top, rep, vec, n, low, high) of its second-level pivots."""

    tops: Cells
    branches: DataFrame


def build_tree(corpus: DataFrame, n: int, wanted: int) -> tuple[DataFrame, Tree]:
    """Corpus rows with the second-level pivot (``cell``) nearest to them inside the branch of their first-level pivot."""
    first, tops = build_cells(corpus, n, min(MAX_PIVOTS, int(np.ceil(np.sqrt(wanted)))))
    rows = first.withColumnsRenamed({"cell": "top", "pivot_dist": "top_dist"})
    per_row = wanted / n
    held = F.element_at(F.create_map(*[F.lit(x) for i, c in enumerate(tops.counts.tolist()) for x in (i, float(c))]), F.col("top"))
    share = F.least(F.lit(per_row), F.lit(float(MAX_BRANCH)) / held)
    # the first-level pivot lies in its own branch, so each branch has a pivot
    draw = F.shiftrightunsigned(F.xxhash64("rep", F.lit(11)), 11) / F.lit(float(1 << 53))
    picked = cut(rows.filter((draw < share) | (F.col("top_dist") <= SLACK)).select("top", "rep", "vec"))

    def nearest_pivot(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return pd.DataFrame({"rep": [], "vec": [], "top": [], "cell": [], "pivot_dist": []})
        c = c.sort_values("rep")
        pivots, names, cell, dist = _matrix(c["vec"]), c["rep"].to_numpy(), [], []
        for at in range(0, len(q), SCORE_ROWS):
            d = _distances(_matrix(q["vec"].iloc[at:at + SCORE_ROWS]), pivots)
            best = d.argmin(1)
            cell.append(names[best])
            dist.append(d[np.arange(len(d)), best])
        return pd.DataFrame({"rep": q["rep"], "vec": q["vec"], "top": q["top"], "cell": np.concatenate(cell), "pivot_dist": np.concatenate(dist)})

    # a branch has at most some MAX_BRANCH pivots, so they are never cut into blocks
    assigned = cut(meet(rows.select("top", "rep", "vec"), picked, ["top"], nearest_pivot,
                        "rep long, vec array<double>, top int, cell long, pivot_dist double", "rep", max(BLOCK_ROWS, 4 * MAX_BRANCH)))
    stats = assigned.groupBy("top", F.col("cell").alias("rep")).agg(F.count("*").alias("n"), F.min("pivot_dist").alias("low"),
                                                                    F.max("pivot_dist").alias("high"))
    return assigned.select("cell", "rep", "vec"), Tree(tops, cut(picked.join(stats, ["top", "rep"])))


def descend(queries: DataFrame, tree: Tree, at_top, at_branch, need: int) -> DataFrame:
    """(qrep, vec, [bound,] cell): cells to visit. ``at_top`` and ``at_branch`` choose branches and cells of a branch; both get
    (rows, distances, cells) and the mask of those next to the query that hold ``need`` rows."""
    tops, kept = tree.tops, queries.columns

    def branches(batches):
        for pdf in batches:
            for at in range(0, len(pdf), SCORE_ROWS):
                part = pdf.iloc[at:at + SCORE_ROWS]
                d = _distances(_matrix(part["vec"]), tops.pivots)
                home = _home_mask(d, tops, need)
                rows, top = np.nonzero(at_top(part, d, tops, home))
                if len(rows):
                    yield part.iloc[rows].assign(top=top.astype("int32"), home=home[rows, top])

    def cells(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = []
        if not (q.empty or c.empty):
            c = c.sort_values("rep")
            names = c["rep"].to_numpy()
            level = Cells(_matrix(c["vec"]), c["n"].to_numpy(), c["low"].to_numpy(), c["high"].to_numpy())
            for at in range(0, len(q), SCORE_ROWS):
                part = q.iloc[at:at + SCORE_ROWS]
                d = _distances(_matrix(part["vec"]), level.pivots)
                home = _home_mask(d, level, need) & part["home"].to_numpy()[:, None]
                rows, cell = np.nonzero(at_branch(part, d, level, home))
                out.append(part.iloc[rows][kept].assign(cell=names[cell]))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({c: [] for c in [*kept, "cell"]})

    routed = cut(queries.mapInPandas(branches, _with(queries, top=T.IntegerType(), home=T.BooleanType())))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.schema.fields) + ", cell long"
    return cut(meet(routed, tree.branches, ["top"], cells, schema, "qrep", max(BLOCK_ROWS, 4 * MAX_BRANCH)))


def _within(product: np.ndarray, own: np.ndarray, length: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Which pairs of vectors, given by their products and squared lengths, can be no further apart than ``radius``."""
    least = (own * (1 - SLACK) - np.minimum(radius, 1e150) ** 2) / 2
    return product - (length * (1 - SLACK) / 2)[None, :] >= least[:, None]


def _places(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What ``np.nonzero`` gives for a matrix, some times faster where few entries are set."""
    return np.divmod(np.flatnonzero(mask), mask.shape[1])


def _top_kernel(k: int, cosine: bool, bounded: bool):
    """Best ``k`` rows per query inside one block; ``bounded`` also drops what exceeds the known radius."""

    def run(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return pd.DataFrame({"qrep": [], "crep": [], "score": []}).astype({"qrep": "int64", "crep": "int64"})
        c = c.sort_values("rep")
        rows, ids = _matrix(c["vec"]), c["rep"].to_numpy()
        take, length, out = min(k, len(ids)), (rows * rows).sum(1), []
        for at in range(0, len(q), SCORE_ROWS):
            part = q.iloc[at:at + SCORE_ROWS]
            vec = _matrix(part["vec"])
            product, own = vec @ rows.T, (vec * vec).sum(1)
            near = None
            if bounded:
                limit = part["bound"].to_numpy() - SLACK
                # pairs beyond the bound are told by their products; only the others are scored
                near = product >= (limit - SLACK)[:, None] if cosine else _within(product, own, length, SLACK - limit)
                if np.count_nonzero(near) > FEW_NEAR * take * len(vec):
                    near = None
            # larger is better; rounding makes equal scores equal whatever the block shape
            if near is None:
                score = np.round(product if cosine else -np.sqrt(np.maximum(own[:, None] + length[None, :] - 2.0 * product, 0.0)), 12)
                kth = -np.partition(-score, take - 1, axis=1)[:, take - 1]
                if bounded:
                    kth = np.maximum(kth, limit)
                at_row, at_col = _places(score >= kth[:, None])
                value = score[at_row, at_col]
            else:
                at_row, at_col = _places(near)
                value = product[at_row, at_col]
                if not cosine:
                    value = -np.sqrt(np.maximum(own[at_row] + length[at_col] - 2.0 * value, 0.0))
                value = np.round(value, 12)
                real = value >= limit[at_row]
                at_row, at_col, value = at_row[real], at_col[real], value[real]
            order = np.lexsort((at_col, -value, at_row))  # rows are in id order, so columns break ties by id
            place = np.arange(len(order)) - np.searchsorted(at_row, at_row)
            order = order[place < take]
            out.append(pd.DataFrame({"qrep": part["qrep"].to_numpy()[at_row[order]], "crep": ids[at_col[order]],
                                     "score": value[order]}))
        return pd.concat(out, ignore_index=True)

    return run


def _top_pairs(k: int):
    """The best ``k`` pairs of every query among those of one task, as :func:`_best` picks them."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        q, c, score = (pdf[name].to_numpy() for name in ("qrep", "crep", "score"))
        order = np.lexsort((c, -score, q))
        place = np.arange(len(order)) - np.searchsorted(q[order], q[order])
        return pdf.iloc[order[place < k]]

    return run


def _best(partials: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qrep").orderBy(F.col("score").desc(), F.col("crep").asc())
    return partials.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k)


def nearest(queries: DataFrame, corpus: DataFrame, k: int, metric: str = "cosine", query_id: str = "id",
            corpus_id: str = "id", query_vec: str = "vec", corpus_vec: str = "vec", exclude_same_id: bool = False,
            n_pivots: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, neighbor_id, rank, similarity | distance): the exact ``k`` best, ties by smaller id.

    Whole-number ids are searched as they are. Ids of other types are numbered in their order first, and put back at the
    end, so that only numbers travel through the search.
    """
    types = [queries.schema[query_id].dataType, corpus.schema[corpus_id].dataType]
    if all(isinstance(t, T.IntegralType) for t in types):
        found = _nearest(queries, corpus, k, metric, query_id, corpus_id, query_vec, corpus_vec, exclude_same_id, n_pivots, block_rows)
        return found.withColumns({"query_id": F.col("query_id").cast(types[0]), "neighbor_id": F.col("neighbor_id").cast(types[1])})
    if types[0] != types[1]:
        raise ValueError(f"ids of unlike types: {types[0].simpleString()}, {types[1].simpleString()}")
    numbers = dense_ids(queries.select(F.col(query_id).alias("id")).unionByName(corpus.select(F.col(corpus_id).alias("id"))))
    q, c = (df.join(numbers.withColumnRenamed("id", name), name).select(F.col("ix").alias("id"), F.col(vec).alias("vec"))
            for df, name, vec in ((queries, query_id, query_vec), (corpus, corpus_id, corpus_vec)))
    found = _nearest(q, c, k, metric, "id", "id", "vec", "vec", exclude_same_id, n_pivots, block_rows)
    for name in ("query_id", "neighbor_id"):
        found = found.join(numbers.select(F.col("ix").alias(name), F.col("id").alias("_id")), name).withColumn(name, F.col("_id")).drop("_id")
    return found.select("query_id", "neighbor_id", "rank", "similarity" if metric == "cosine" else "distance")


def dense_ids(ids: DataFrame) -> DataFrame:
    """(id, ix): distinct ids that are not null, numbered from 0 in their order.

    Numbers in order take a byte or two a row in a file and 70 to 160 in a hash table, so the planner, which goes by files, must not send them to all tasks.
    """
    return cut(global_row_number(ids.filter(F.col("id").isNotNull()).select("id").distinct(), ["id"], "ix", 0)).hint("merge")


def _nearest(queries: DataFrame, corpus: DataFrame, k: int, metric: str, query_id: str, corpus_id: str, query_vec: str,
             corpus_vec: str, exclude_same_id: bool, n_pivots: int | None, block_rows: int) -> DataFrame:
    cosine = metric == "cosine"
    depth = k + 1 if exclude_same_id else k
    c_raw = prepare(corpus, corpus_id, corpus_vec, metric, corpus=True)
    q_raw = prepare(queries, query_id, query_vec, metric, corpus=False)
    reps, behind = _distinct_vectors(c_raw, depth)
    reps = cut(reps.select("rep", "vec"))
    n = reps.count()
    out_name = "similarity" if cosine else "distance"
    if n == 0:
        return q_raw.limit(0).select(F.col("id").alias("query_id"), F.col("id").alias("neighbor_id"),
                                     F.lit(1).alias("rank"), F.lit(0.0).alias(out_name))
    wanted, tree = min(n, n_pivots or max(8, -(-n // ROWS_PER_PIVOT))), None
    if wanted > MAX_PIVOTS:
        assigned, tree = build_tree(reps, n, wanted)
        cells = tree.tops
    else:
        assigned, cells = build_cells(reps, n, wanted)
    block_rows = min(block_rows, max(SCORE_ROWS, BLOCK_BYTES // (8 * cells.pivots.shape[1])))
    q_named = cut(_distinct_vectors(q_raw, None)[0].withColumnRenamed("rep", "qrep"))
    q_reps = q_named.select("qrep", "vec")

    schema = "qrep long, crep long, score double"

    def radius_of(pdf):
        bound = pdf["bound"].to_numpy()
        if cosine:  # |q - c|^2 = |q|^2 + 1 - 2 q.c
            sq = (_matrix(pdf["vec"]) ** 2).sum(1)
            return np.sqrt(np.maximum(sq + 1.0 - 2.0 * np.maximum(bound, -1e6), 0.0))
        return -np.maximum(bound, -1e12)

    def bounded(near):
        kth = _best(near, depth).groupBy("qrep").agg(F.min("score").alias("bound"), F.count("*").alias("_n"))
        return (q_reps.join(kth, "qrep")
                .withColumn("bound", F.when(F.col("_n") >= depth, F.col("bound")).otherwise(F.lit(-1e300))).drop("_n"))

    if tree is None:
        home = route(q_reps, cells, lambda pdf, d: _home_mask(d, cells, depth), block_rows)
        near = cut(visit(home, assigned, cells, _top_kernel(depth, cosine, False), schema, "qrep", block_rows, _top_pairs(depth)))
        if cells.size > 1:
            far = route(bounded(near), cells, lambda pdf, d: _reach_mask(d, cells, radius_of(pdf)) & ~_home_mask(d, cells, depth), block_rows)
            near = near.unionByName(visit(far, assigned, cells, _top_kernel(depth, cosine, True), schema, "qrep", block_rows, _top_pairs(depth)))
    else:
        home = descend(q_reps, tree, lambda pdf, d, level, home: home, lambda pdf, d, level, home: home, depth)
        near = cut(meet(home, assigned, ["cell"], _top_kernel(depth, cosine, False), schema, "qrep", block_rows))
        far = descend(bounded(near), tree, lambda pdf, d, level, home: _reach_mask(d, level, radius_of(pdf)),
                      lambda pdf, d, level, home: _reach_mask(d, level, radius_of(pdf)) & ~home, depth)
        near = near.unionByName(meet(far, assigned, ["cell"], _top_kernel(depth, cosine, True), schema, "qrep", block_rows))
    return named_pairs(near, behind, q_raw, q_named, k, depth, exclude_same_id, cosine)


def named_pairs(near: DataFrame, behind: DataFrame, q_raw: DataFrame, q_named: DataFrame, k: int, depth: int, exclude_same_id: bool,
                cosine: bool) -> DataFrame:
    """Pairs of representatives (qrep, crep, score), each at most once, to the k best ids of every query id."""
    out_name = "similarity" if cosine else "distance"
    # reps back to ids: a list holds at most depth entries, each rep at most depth ids
    pairs = _best(near, depth).join(behind.withColumnRenamed("rep", "crep"), "crep")
    members = pairs.select("qrep", "score", F.explode("ids").alias("crep"))
    lists = (_best(members, depth).groupBy("qrep")
             .agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("crep").alias("id")))).alias("found")))
    q_of = hashed(q_raw).select("id", "h1", "h2").join(q_named.select("h1", "h2", "qrep"), ["h1", "h2"]).select(F.col("id").alias("query_id"), "qrep")
    joined = q_of.join(lists, "qrep")
    found = F.col("found")
    if exclude_same_id:
        found = F.filter(found, lambda x: x["id"] != F.col("query_id"))
    value = -F.col("hit.s")
    return (joined.select("query_id", F.posexplode(F.slice(found, 1, k)).alias("pos", "hit"))
            .select("query_id", F.col("hit.id").alias("neighbor_id"), (F.col("pos") + 1).alias("rank"),
                    (value if cosine else F.abs(F.col("hit.s"))).alias(out_name)))


def ranks(pairs: DataFrame, points: DataFrame, metric: str = "cosine", n_pivots: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(src, dst, rank): the place of ``dst`` among all other ``points`` (id, vec) in the order of distance from ``src``, then id.

    ``pairs`` (src, dst) are of ids among the points and not of one with itself. Exact: cells inside the distance of a pair count with their size,
    cells outside not at all, the others are visited.
    """
    rows = cut(prepare(points, "id", "vec", metric, corpus=True).select(F.col("id").alias("rep"), "vec"))
    n = rows.count()
    assigned, cells = build_cells(rows, n, n_pivots)
    own = assigned.select(F.col("rep").alias("src"), F.col("cell").alias("own"))
    starts = cut(rows.select(F.col("rep").alias("src"), "vec").join(own, "src").withColumn("qrep", F.monotonically_increasing_id()))
    near = SLACK * 10

    def measured(batches):
        for pdf in batches:
            if len(pdf):
                far = np.sqrt(((_matrix(pdf["vec"]) - _matrix(pdf["end"])) ** 2).sum(1))
                yield pd.DataFrame({"qrep": pdf["qrep"], "dst": pdf["dst"], "far": far})

    ends = rows.select(F.col("rep").alias("dst"), F.col("vec").alias("end"))
    asked = (pairs.select("src", "dst").join(starts, "src").join(ends, "dst").select("qrep", "dst", "vec", "end")
             .mapInPandas(measured, "qrep long, dst long, far double"))
    # a start is searched once for all its pairs, which stand in the order of distance
    listed = (asked.groupBy("qrep").agg(F.sort_array(F.collect_list(F.struct("far", "dst"))).alias("to"))
              .select("qrep", F.col("to.far").alias("far"), F.col("to.dst").alias("dst")))
    queries = cut(starts.join(listed, "qrep"))

    def spread(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of all pairs of some starts: place of the start, distance and end; and where each start's pairs begin."""
        sizes = np.array([len(x) for x in pdf["far"]])
        return np.repeat(np.arange(len(pdf)), sizes), np.concatenate(pdf["far"].to_list()), np.concatenate(pdf["dst"].to_list()), np.cumsum(sizes) - sizes

    def inside(d, high, far):
        return np.round(d, 9) + high < far - near

    def choose(pdf, d):
        row, far, _, begin = spread(pdf)
        d, far = d[row], far[:, None]
        outside = np.maximum(d - cells.high[None, :], cells.low[None, :] - d) > far + near
        crossed = (cells.counts > 0)[None, :] & ~outside & ~inside(d, cells.high[None, :], far)
        return np.logical_or.reduceat(crossed, begin, axis=0)

    def counted(batches):
        for pdf in batches:
            for at in range(0, len(pdf), SCORE_ROWS):
                part = pdf.iloc[at:at + SCORE_ROWS]
                row, far, _, begin = spread(part)
                whole = (cells.counts > 0)[None, :] & inside(_distances(_matrix(part["vec"]), cells.pivots)[row], cells.high[None, :], far[:, None])
                # the start itself is one of the rows of its cell
                yield pd.DataFrame({"qrep": part["qrep"].to_numpy()[row], "at": np.arange(len(row)) - begin[row],
                                    "n": (whole * cells.counts[None, :]).sum(1) - whole[np.arange(len(row)), part["own"].to_numpy()[row]]})

    def kernel(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return pd.DataFrame({"qrep": [], "at": [], "n": []}).astype("int64")
        x, ids, cell, out = _matrix(c["vec"]), c["rep"].to_numpy(), int(c["cell"].iloc[0]), []
        by_id = np.argsort(ids, kind="stable")
        names = ids[by_id]
        for at in range(0, len(q), SCORE_ROWS):
            part = q.iloc[at:at + SCORE_ROWS]
            start, m = _matrix(part["vec"]), len(part)
            row, far, dst, begin = spread(part)
            d = _distances(start, x)
            # starts are laid behind each other on one axis, so that all pairs' distances are in order there
            span = max(d.max(), far.max()) + 1.0
            axis = d + (np.arange(m) * span)[:, None]
            low = np.searchsorted(row * span + far - near, axis.ravel(), "right").reshape(d.shape)
            high = np.searchsorted(row * span + far + near, axis.ravel(), "right").reshape(d.shape)
            other = ids[None, :] != part["src"].to_numpy()[:, None]
            # a row is surely nearer than the pairs from ``low`` on; a start has one more place than pairs
            upto = np.cumsum(np.bincount((low + np.arange(m)[:, None])[other], minlength=len(far) + m))
            n = upto[np.arange(len(far)) + row] - np.r_[0, upto][(begin + np.arange(m))[row]]
            # an end does not count for its own pair, in whatever rows its id comes again
            copies = np.searchsorted(names, dst, "right") - np.searchsorted(names, dst)
            pair = np.repeat(np.arange(len(far)), copies)
            again = by_id[np.repeat(np.searchsorted(names, dst) - np.cumsum(copies) + copies, copies) + np.arange(copies.sum())]
            nearer = (low[row[pair], again] <= pair) & other[row[pair], again]
            n -= np.bincount(pair[nearer], minlength=len(far))
            i, j = np.nonzero(other & (low > high))
            for some in range(0, len(i), 1 << 16):
                a, b = i[some:some + (1 << 16)], j[some:some + (1 << 16)]
                exact = np.round(np.sqrt(((start[a] - x[b]) ** 2).sum(1)), 12)
                many = low[a, b] - high[a, b]
                pair = np.repeat(high[a, b] - np.cumsum(many) + many, many) + np.arange(many.sum())
                exact, who, limit = np.repeat(exact, many), np.repeat(ids[b], many), np.round(far[pair], 12)
                before = ((exact < limit) | ((exact == limit) & (who < dst[pair]))) & (who != dst[pair])
                n += np.bincount(pair[before], minlength=len(far))
            # cells inside the distance of a pair are counted as a whole
            real = (n > 0) & ~inside(_distances(start, cells.pivots[cell:cell + 1])[row, 0], cells.high[cell], far)
            place = np.arange(len(row)) - begin[row]
            out.append(pd.DataFrame({"qrep": part["qrep"].to_numpy()[row[real]], "at": place[real], "n": n[real].astype("int64")}))
        return pd.concat(out, ignore_index=True)

    schema = "qrep long, at long, n long"
    whole = queries.mapInPandas(counted, schema)
    visited = visit(route(queries, cells, choose, block_rows), assigned, cells, kernel, schema, "qrep", block_rows,
                    lambda found: found.groupby(["qrep", "at"], as_index=False)["n"].sum())
    total = whole.unionByName(visited).groupBy("qrep", "at").agg(F.sum("n").alias("n"))
    return (queries.select("qrep", "src", F.posexplode("dst").alias("at", "dst")).join(total, ["qrep", "at"])
            .select("src", "dst", (F.col("n") + 1).alias("rank")))
