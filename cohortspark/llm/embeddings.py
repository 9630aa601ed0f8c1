"""Near copies of vectors by cosine: tiles compared in the order of principal components.

Unit vectors with cosine t or more lie within sqrt(2 - 2 t) of each other, so in a grid of that width over the first
principal components they share a cell or lie in touching ones. Within a tile the products of the leading components are
taken first; what the others can add is at most the product of their norms, and a pair whose bound is below t is dropped
before the next components are read. Pairs that stay get their cosine in double precision from the vectors as given.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from cohortspark.operators.graph import connected_components
from cohortspark.runtime import cut

THRESHOLD = 0.95
#: Leading components that make the grid.
GRID = 3
#: Components read in one step.
STEP = 16
#: A block of a cell holds so many bytes of vectors and so many rows at most.
BLOCK_BYTES, BLOCK_ROWS = 1 << 24, 8192
#: Rows of a tile multiplied at one time, pairs looked at closer at one time.
ROWS, PAIRS = 512, 1 << 17
#: Cells whose sizes are broadcast; more are joined.
MOST_CELLS = 100_000
#: Room for rounding in bounds; cosines themselves are compared exactly.
SLACK = 1e-6
#: Different vector lengths a table may have.
MOST_LENGTHS = 100


def usable(vec: str) -> Column:
    """Whether a vector can link: not null, not empty, all components finite, one of them not zero."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.size(vec) > 0, F.lit(False)) & F.coalesce(finite, F.lit(False)) & F.coalesce(
        F.exists(vec, lambda x: x != 0), F.lit(False))


def units(rows: DataFrame, vec: str = "vec") -> DataFrame:
    """Usable vectors ``vec`` (array of double) at length 1, as ``unit`` in place of ``vec``; scaled by their largest component
    first, so that squares neither vanish nor overflow."""
    kept = [c for c in rows.columns if c != vec]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(len(kept))
            flat, lengths = lists.flatten().to_numpy(), pc.list_value_length(lists).to_numpy()
            starts = np.cumsum(lengths) - lengths
            flat = flat / np.repeat(np.maximum.reduceat(np.abs(flat), starts), lengths)
            flat = flat / np.repeat(np.sqrt(np.add.reduceat(flat * flat, starts)), lengths)
            offsets = pa.array(np.append(starts, len(flat)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(kept))] + [pa.ListArray.from_arrays(offsets, pa.array(flat))],
                                             names=[*kept, "unit"])

    source = rows.select(*kept, vec)
    schema = StructType(source.schema.fields[:-1] + StructType.fromDDL("unit array<double>").fields)
    return source.mapInArrow(run, schema)


def _basis(rows: DataFrame, length: int) -> np.ndarray:
    """Orthonormal principal directions, the widest first; any basis gives the same links."""
    fitted = PCA(k=length, inputCol="v", outputCol="p").fit(rows.select(array_to_vector("unit").alias("v")))
    return fitted.pc.toArray()


def _cells(rows: DataFrame, basis, width: float) -> DataFrame:
    """One row per cell that a vector belongs to (``home``) or has to be compared in; a pair meets in one cell."""
    schema = "cell string, home boolean, rid long, copies long, unit array<double>"
    out = to_arrow_schema(StructType.fromDDL(schema))
    steps = list(product((-1, 0, 1), repeat=GRID))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(2)
            flat = lists.flatten().to_numpy().reshape(batch.num_rows, -1)
            place = np.zeros((batch.num_rows, GRID))
            lead = flat @ basis.value[:, :GRID]
            place[:, :lead.shape[1]] = lead / width
            cell = np.floor(place).astype(np.int64)
            inside = place - cell
            for step in steps:
                if step < (0,) * GRID:
                    continue
                s = np.array(step)
                gap = np.where(s > 0, 1 - inside, np.where(s < 0, inside, 0.0))
                near = np.flatnonzero((gap * gap).sum(1) <= 1 + SLACK)
                if not len(near):
                    continue
                take = batch.take(pa.array(near))
                names = [",".join(map(str, c)) for c in (cell[near] + s).tolist()]
                home = np.full(len(near), not s.any())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(home), take.column(0), take.column(1),
                                                  take.column(2)], schema=out)

    return rows.select("rid", "copies", "unit").mapInArrow(run, schema)


def _tiles(placed: DataFrame, block_rows: int) -> DataFrame:
    """Rows dealt to tiles (cell, kind, i, j): two blocks of home rows, or a block of home rows and one of visitors."""
    counts = placed.groupBy("cell").agg(F.count(F.when(F.col("home"), 1)).alias("n"), F.count(F.when(~F.col("home"), 1)).alias("m"))
    blocks = counts.filter("n > 0").select(F.col("cell").alias("_c"), F.ceil(F.col("n") / block_rows).cast("int").alias("homes"),
                                           F.ceil(F.col("m") / block_rows).cast("int").alias("guests"))
    blocks = cut(blocks)
    if blocks.count() <= MOST_CELLS:
        blocks = F.broadcast(blocks)
    rows = placed.join(blocks, F.col("cell") == F.col("_c")).drop("_c")
    mine = F.pmod(F.xxhash64("rid"), F.when(F.col("home"), F.col("homes")).otherwise(F.col("guests"))).cast("int")
    rows = rows.withColumn("b", mine)
    others = F.sequence(F.lit(0), F.col("homes") - 1)

    def tile(kind, i, j, right):
        return F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), right.alias("right"))

    b = F.col("b")
    among = F.transform(others, lambda o: tile(0, F.least(b, o), F.greatest(b, o), b > o))
    with_guests = F.when(F.col("guests") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("guests"), F.lit(1)) - 1),
                                                           lambda o: tile(1, b, o, F.lit(False)))).otherwise(F.array().cast(
        "array<struct<kind:int,i:int,j:int,right:boolean>>"))
    visiting = F.transform(others, lambda o: tile(1, o, b, F.lit(True)))
    tiles = F.when(F.col("home"), F.concat(among, with_guests)).otherwise(visiting)
    return rows.select("cell", F.explode(tiles).alias("t"), "rid", "copies", "unit").select(
        "cell", "t.kind", "t.i", "t.j", "t.right", "rid", "copies", "unit")


def _linked(x: np.ndarray, y: np.ndarray, basis: np.ndarray, threshold: float):
    """Places of the pairs of unit vectors with cosine at the threshold or above, for some rows of ``x`` at a time.

    ``lead`` holds the components in order; beside those of a step stands the norm of the ones behind, so one product
    gives the bound. A pair whose bound falls below the threshold is dropped; the others get their cosine.
    """
    d = x.shape[1]
    steps = [*range(min(STEP, d), d, STEP), d]
    lead_x, lead_y = x @ basis, y @ basis
    rest_x = np.sqrt(np.maximum(0, 1 - np.cumsum(lead_x * lead_x, 1)))
    rest_y = np.sqrt(np.maximum(0, 1 - np.cumsum(lead_y * lead_y, 1)))
    first = steps[0]
    a = np.column_stack([lead_x[:, :first], rest_x[:, first - 1]]).astype(np.float32)
    b = np.column_stack([lead_y[:, :first], rest_y[:, first - 1]]).astype(np.float32).T
    for at in range(0, len(x), ROWS):
        i, j = np.nonzero(a[at:at + ROWS] @ b >= threshold - 1e-4)
        i += at
        for part in range(0, len(i), PAIRS):
            p, q = i[part:part + PAIRS], j[part:part + PAIRS]
            sofar, begin = np.zeros(len(p)), 0
            for end in steps:
                sofar = sofar + np.einsum("ij,ij->i", lead_x[p, begin:end], lead_y[q, begin:end])
                stay = sofar + rest_x[p, end - 1] * rest_y[q, end - 1] >= threshold - SLACK
                p, q, sofar, begin = p[stay], q[stay], sofar[stay], end
                if not len(p):
                    break
            near = np.einsum("ij,ij->i", x[p], y[q]) >= threshold
            if near.any():
                yield p[near], q[near]


def _join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots (the least place of a part) after the parts of ``a`` and ``b`` have been joined pair by pair."""
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        if (low == high).all():
            return root
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]


def _compare(basis, threshold: float):
    """Rows of one tile to (a, b, n): n linked vectors of a (b null), or an edge a - b that ties a to its linked part.
    Pairs are held for a few rows at a time, so a tile in which all are linked takes no more memory than another."""
    def run(table: pa.Table) -> pa.Table:
        right = table.column("right").to_numpy(zero_copy_only=False)
        kind, i, j = (table.column(c)[0].as_py() for c in ("kind", "i", "j"))
        vec = table.column("unit").combine_chunks().flatten().to_numpy().reshape(len(right), -1)
        rid, copies = table.column("rid").to_numpy(), table.column("copies").to_numpy()
        same = kind == 0 and i == j
        p = np.arange(len(right)) if same else np.flatnonzero(~right)
        q = p if same else np.flatnonzero(right)
        n, root = np.zeros(len(rid), np.int64), np.arange(len(rid))
        if len(p) and len(q):
            for a, b in _linked(vec[p], vec[q], basis.value, threshold):
                a, b = p[a], q[b]
                if same:
                    once = a < b
                    a, b = a[once], b[once]
                np.add.at(n, a, copies[b])
                np.add.at(n, b, copies[a])
                root = _join(root, a, b)
        tied, counted = np.flatnonzero(root != np.arange(len(rid))), np.flatnonzero(n)
        none = pa.nulls(len(counted), pa.int64())
        return pa.table({"a": pa.concat_arrays([pa.array(rid[tied]), pa.array(rid[counted])]),
                         "b": pa.concat_arrays([pa.array(rid[root[tied]]), none]),
                         "n": pa.concat_arrays([pa.array(np.zeros(len(tied), np.int64)), pa.array(n[counted])])})

    return run


def links(distinct: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, n) for distinct usable vectors (rid, copies, unit): edges that connect what is linked, and counts of the
    vectors linked with a, copies included (b null, several rows per a). Vectors of unlike length have no cosine."""
    spark, width = distinct.sparkSession, float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    lengths = [r["n"] for r in distinct.groupBy(F.size("unit").alias("d")).agg(F.count("*").alias("c")).filter("c > 1")
               .select(F.col("d").alias("n")).limit(MOST_LENGTHS + 1).collect()]
    if len(lengths) > MOST_LENGTHS:
        raise ValueError(f"more than {MOST_LENGTHS} vector lengths")
    out = None
    for length in sorted(lengths):
        alike = distinct.filter(F.size("unit") == length)
        basis = spark.sparkContext.broadcast(_basis(alike, length))  # length x length numbers
        placed = _cells(alike, basis, width or 1.0)
        block_rows = max(64, min(BLOCK_ROWS, BLOCK_BYTES // (8 * length)))
        found = (_tiles(cut(placed), block_rows).groupBy("cell", "kind", "i", "j")
                 .applyInArrow(_compare(basis, threshold), "a long, b long, n long"))
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], "a long, b long, n long") if out is None else out


def near_vectors(df: DataFrame, key: str = "vec_id", vec: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """(key, n_links, component_id, kept), one row per row of ``df``.

    ``n_links``: other rows linked directly. ``component_id``: the smallest key reachable. ``kept``: whether that is the
    row's own. Rows with equal vectors are searched once, and count for each other. Vectors that are null, empty, zero or
    hold null or non-finite components link with nothing, and vectors of unlike length not with each other. Null keys
    name no component unless nothing else is in it. Other columns are ignored. A table with more than MOST_LENGTHS lengths of
    usable vectors that occur twice or more is an error.
    """
    rows = cut(df.select(F.col(key).alias("key"), F.col(vec).cast("array<double>").alias("vec"))
               .withColumn("ok", usable("vec"))
               .select("key", "ok", F.when(F.col("ok"), F.transform("vec", lambda x: x + 0.0)).alias("vec"))
               .withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit(1), "vec")}))
    groups = (rows.filter("ok").groupBy("h1", "h2")
              .agg(F.min("key").alias("least"), F.count("*").alias("copies"), F.min("vec").alias("vec"), F.max("vec").alias("last")))
    alike = F.when(F.col("vec") == F.col("last"), F.col("vec")).otherwise(F.raise_error(F.lit("unlike vectors share 128 hash bits")))
    distinct = cut(units(groups.select("h1", "h2", "least", "copies", alike.alias("vec"))).withColumn("rid", F.monotonically_increasing_id()))
    found = cut(links(distinct.select("rid", "copies", "unit"), threshold))
    joined = connected_components(found.filter("b IS NOT NULL").select("a", "b"))
    counted = found.filter("b IS NULL").groupBy("a").agg(F.sum("n").alias("n"))
    base = distinct.select("rid", "least", "copies", "h1", "h2")
    each = (base.join(counted.withColumnRenamed("a", "rid"), "rid", "left")
            .join(joined.withColumnRenamed("id", "rid"), "rid", "left")
            .withColumn("root", F.coalesce("component", "rid")))
    named = each.groupBy("root").agg(F.min("least").alias("component_id"))
    result = cut(each.join(named, "root").select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                                                 "component_id"))
    linked = rows.filter("ok").select("key", "h1", "h2").join(result, ["h1", "h2"]).select("key", "n_links", "component_id")
    alone = rows.filter("NOT ok").select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    return linked.unionByName(alone).select(F.col("key").alias(key), "n_links", "component_id",
                                            F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))
