"""Whitening of vectors by an incremental eigendecomposition that Spark's tasks build and combine.

A task holds the spectrum of the vectors it has read: their number, their sums, eigenvalues and eigenvectors of their scatter
around their own mean. Every further centred row changes the scatter by a rank-one term; the new eigenvalues are the roots of
a secular equation, and rows that leave an eigenvalue as it is are deflated. Spectra of tasks are combined in rounds of a few
at a time: each eigenvector of one, times the root of its eigenvalue, is a rank-one term for the other, and so is the
distance of the means. The directions found so far then serve as basis of a Rayleigh-Ritz step over all vectors: the scatter of
their projections, summed by the tasks, is decomposed once, which makes the components exact to double precision.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from cohortspark.runtime import cut

COMPONENTS = 16
#: Whole numbers are made of entries by this factor and this shift.
SCALE, SHIFT = 64, 1_000_000
#: Vectors whose centred rows are brought to at most as many rows as there are dimensions (QR) before they are added.
BLOCK = 256
#: Spectra or sums that one task combines.
FAN_IN = 8
#: Entries above this have no whole number that sums can hold safely.
LARGEST = float(1 << 40)
EPS = np.finfo(float).eps
#: Components with less of the largest eigenvalue than this have no variance.
LEAST_SHARE = 1e-12
MOST_STEPS = 80


def _roots(lam: np.ndarray, zz: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum(zz / (lam - t)) = 0 for rising ``lam`` and positive ``zz``, and the matrix lam_j - t_i.

    Root i lies between lam_i and the next one, the last below lam_k + sum(zz). It is sought as a distance from the nearer
    end: both sides of the sum are replaced by one pole each, which gives a quadratic; what leaves the bracket is halved.
    """
    k, total = len(lam), zz.sum()
    nxt = np.append(lam[1:], lam[-1] + total)
    half = (nxt - lam) / 2
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        middle = 1 + (zz[:, None] / ((lam[:, None] - lam) - half)).sum(0)
        left = middle > 0
        left[-1] = True
        origin = np.where(left, lam, nxt)
        delta = lam[:, None] - origin  # pole j seen from the origin of root i
        low, high = np.where(left, 0.0, -half), np.where(left, half, 0.0)
        high[-1] = total
        before = np.arange(k)[:, None] <= np.arange(k)
        own, other = np.diagonal(delta).copy(), nxt - origin
        t = (low + high) / 2
        for _ in range(MOST_STEPS):
            d = delta - t
            w = zz[:, None] / d
            f = 1 + w.sum(0)
            over = f > 0
            high, low = np.where(over, t, high), np.where(over, low, t)
            done = (np.abs(f) <= 4 * EPS * k * (1 + np.abs(w).sum(0))) | (high - low <= 2 * EPS * np.maximum(np.abs(low), np.abs(high)))
            if done.all():
                break
            w2 = w / d
            psi = (w2 * before).sum(0)
            phi = w2.sum(0) - psi
            a, b = own - t, other - t
            c = f - a * psi - b * phi
            p, q = (a + b) * f - a * b * (psi + phi), a * b * f
            root = np.sqrt(np.maximum(p * p - 4 * q * c, 0))
            step = np.where(p <= 0, (p - root) / (2 * c), 2 * q / (p + root))
            last = f[-1] - a[-1] * psi[-1]
            step[-1] = a[-1] + a[-1] ** 2 * psi[-1] / last if last > 0 else np.nan
            new = t + step
            t = np.where(done, t, np.where((new > low) & (new < high), new, (low + high) / 2))
    return origin + t, delta - t


def rank_one(lam: np.ndarray, vectors: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and eigenvectors of ``vectors diag(lam) vectors^T + row row^T``."""
    z = vectors.T @ row
    norm = float(z @ z)
    if norm == 0:
        return lam, vectors
    slack = 8 * EPS * max(abs(lam[-1]), norm)
    # deflation of equal eigenvalues: their vectors are mirrored so that one alone has a share of the row
    close = np.flatnonzero(np.diff(lam) <= slack)
    if len(close):
        vectors, lam = vectors.copy(), lam.copy()
        for run in np.split(close, np.flatnonzero(np.diff(close) > 1) + 1):
            at = slice(run[0], run[-1] + 2)
            w = z[at].copy()
            size = np.sqrt(w @ w)
            u = w.copy()
            u[-1] += size if w[-1] > 0 else -size
            if size and (uu := u @ u):
                vectors[:, at] -= np.outer(vectors[:, at] @ u, u) * (2 / uu)
                z[at] = 0
                z[at.stop - 1] = -size if w[-1] > 0 else size
    # deflation of directions in which the row has no share
    on = np.flatnonzero(np.abs(z) * np.sqrt(norm) > slack)
    if not len(on):
        return lam, vectors
    for n in range(len(on) - 1):  # poles within the slack that the mirrors left apart
        if lam[on[n + 1]] <= lam[on[n]]:
            lam[on[n + 1]] = np.nextafter(lam[on[n]], np.inf)
    poles = lam[on]
    t, d = _roots(poles, z[on] ** 2)
    # the row that has exactly these roots: its eigenvectors are orthogonal however close the roots are
    gaps = poles - poles[:, None]
    np.fill_diagonal(gaps, 1.0)
    exact = np.sqrt(np.abs(np.prod(d / gaps, axis=1))) * np.sign(z[on])
    turn = exact[:, None] / d
    turn /= np.sqrt((turn * turn).sum(0))
    values, basis = lam.copy(), vectors.copy()
    values[on], basis[:, on] = t, vectors[:, on] @ turn
    order = np.argsort(values, kind="stable")
    return values[order], basis[:, order]


@dataclass
class Spectrum:
    """Number and sums of vectors, eigenvalues and eigenvectors of their scatter around their mean."""

    sums: list[int]
    n: int = 0
    lam: np.ndarray = field(default=None)
    vectors: np.ndarray = field(default=None)

    def __post_init__(self):
        if self.lam is None:
            self.lam, self.vectors = np.zeros(len(self.sums)), np.eye(len(self.sums))

    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums]) if self.n else np.zeros(len(self.sums))

    def merge(self, n: int, sums: list[int], rows: np.ndarray) -> None:
        """Add ``n`` vectors with these sums, whose scatter around their mean is that of ``rows`` (sum of outer products)."""
        if self.n:
            apart = np.array([s / n for s in sums]) - self.mean()
            rows = np.vstack([rows, np.sqrt(self.n * n / (self.n + n)) * apart])
        for row in rows:
            self.lam, self.vectors = rank_one(self.lam, self.vectors, row)
        self.n += n
        self.sums = [a + b for a, b in zip(self.sums, sums)]

    def add(self, x: np.ndarray) -> None:
        """Add vectors of whole numbers, the rows of ``x``."""
        sums = x.sum(0)
        rows = x - sums / len(x)
        if len(x) == 1:
            rows = rows[:0]
        elif len(x) > x.shape[1]:
            rows = np.linalg.qr(rows, mode="r")
        self.merge(len(x), [int(s) for s in sums], rows)

    def join(self, other: "Spectrum") -> None:
        kept = other.lam > 0
        self.merge(other.n, other.sums, (other.vectors[:, kept] * np.sqrt(other.lam[kept])).T)


SPECTRUM = "part long, n long, sums array<string>, lam array<double>, vectors array<double>"
SUMS = "part long, total array<double>"


def _spectrum_batch(part: int, s: Spectrum) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "n": pa.array([s.n], pa.int64()), "sums": pa.array([[str(v) for v in s.sums]], pa.list_(pa.string())),
                                       "lam": pa.array([s.lam.tolist()], pa.list_(pa.float64())), "vectors": pa.array([s.vectors.ravel().tolist()], pa.list_(pa.float64()))})


def _matrix(batch: pa.RecordBatch, name: str, length: int) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


def _folded(df: DataFrame, parts: int, join: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """One row of the rows with ``part`` 0 to parts - 1, FAN_IN of them at a time."""
    while parts > 1:
        df = df.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("part").applyInArrow(join, schema)
        parts = -(-parts // FAN_IN)
    return df


def _join_spectra(table: pa.Table) -> pa.Table:
    out = None
    for r in table.sort_by("n").to_pylist()[::-1]:
        d = len(r["sums"])
        one = Spectrum([int(v) for v in r["sums"]], r["n"], np.array(r["lam"]), np.array(r["vectors"]).reshape(d, d))
        if out is None:
            out = one
        else:
            out.join(one)
    return pa.Table.from_batches([_spectrum_batch(table.column("part")[0].as_py(), out)])


def _join_sums(table: pa.Table) -> pa.Table:
    total = sum(np.array(v) for v in table.column("total").to_pylist())
    return pa.table({"part": table.column("part").slice(0, 1), "total": pa.array([total.tolist()], pa.list_(pa.float64()))})


def spectrum(fit: DataFrame, length: int, parts: int, block: int = BLOCK) -> Spectrum:
    """Spectrum of the rows of ``fit`` (x, array of ``length`` whole numbers), taken less SHIFT; ``parts``: its partitions."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Spectrum([0] * length)
        for batch in batches:
            x = _matrix(batch, "x", length) - SHIFT
            for at in range(0, len(x), block):
                held.add(x[at:at + block])
        if held.n:
            yield _spectrum_batch(TaskContext.get().partitionId(), held)

    row = _folded(fit.select("x").mapInArrow(run, SPECTRUM), parts, _join_spectra, SPECTRUM).first()  # one row of length^2 numbers
    return Spectrum([int(v) for v in row["sums"]], row["n"], np.array(row["lam"]), np.array(row["vectors"]).reshape(length, length))


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S / n of rows of ``x`` (less SHIFT): n * x - S in whole numbers where they fit."""
    if n * max(1, int(np.abs(x).max(initial=0))) < 1 << 62:
        return (n * x - sums.astype(np.int64)) / n
    return np.array((n * x.astype(object) - sums) / n, float)


def _scatter(fit: DataFrame, length: int, parts: int, n: int, sums: np.ndarray, basis) -> np.ndarray:
    """Sum of the outer products of the centred rows' projections, and (last row) of the projections."""
    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                y = _centred(_matrix(batch, "x", length) - SHIFT, n, sums) @ basis.value
                new = np.vstack([y.T @ y, y.sum(0)])
                total = new if total is None else total + new
        if total is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()),
                                              "total": pa.array([total.ravel().tolist()], pa.list_(pa.float64()))})

    row = _folded(fit.select("x").mapInArrow(run, SUMS), parts, _join_sums, SUMS).first()
    return np.array(row["total"]).reshape(-1, basis.value.shape[1])


@dataclass
class Whitening:
    """Fitted whitening: numbers of the fit list, its sums (entries less SHIFT), components, eigenvalues, checks."""

    n: int
    sums: np.ndarray
    components: np.ndarray  # length x k
    values: np.ndarray
    trace: float
    identity_error: float


def fit(rows: DataFrame, length: int, components: int = COMPONENTS, block: int = BLOCK) -> Whitening:
    """Fit on the distinct ``x`` (array<long>, all of ``length``) of ``rows``, which must not be empty."""
    distinct = cut(rows.select("x").groupBy("x").agg(F.count("*").alias("copies")))
    parts = distinct.rdd.getNumPartitions()
    found = spectrum(distinct, length, parts, block)
    n, sums = found.n, np.array(found.sums, object)
    send = rows.sparkSession.sparkContext.broadcast
    basis = np.linalg.qr(found.vectors[:, ::-1])[0]  # length x length numbers, as all that is sent here
    inner = _scatter(distinct, length, parts, n, sums, send(basis))[:-1] / n
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    k = min(components, length)
    values, turn = values[::-1][:k], turn[:, ::-1][:, :k]
    trace = float(np.trace(inner))
    values = np.where(values > LEAST_SHARE * max(values[0], 0), values, 0.0)
    made = basis @ turn
    live = values > 0
    error = 0.0
    if live.any():
        check = _scatter(distinct, length, parts, n, sums, send(made[:, live] / np.sqrt(values[live])))
        mean = check[-1] / n
        error = float(np.abs(check[:-1] / n - np.outer(mean, mean) - np.eye(int(live.sum()))).max())
    return Whitening(n, sums, made, values, trace, error)


def whole(vec) -> F.Column:
    """Entries as whole numbers: floor(64 c) + 1,000,000."""
    return F.transform(F.col(vec), lambda c: F.floor(c * SCALE).cast("long") + SHIFT)


def whitened(df: DataFrame, key: str = "vec_id", vec: str = "embedding", components: int = COMPONENTS, block: int = BLOCK) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): a row per usable vector and component.

    Not usable, and left out: vectors that are null or empty, hold null or non-finite entries or one above 2^40, or have another length
    than most (of equally common lengths the longest counts). Repeated rows are returned as often as they occur and fitted
    once. ``deviation`` is null where it does not fit a long. Components without variance have null ``whitened`` and no part in
    ``identity_error``; ``explained`` is null if there is no variance at all. Other columns are ignored.
    """
    spark = df.sparkSession
    source = df.select(F.col(key).alias("key"), F.col(vec).cast("array<double>").alias("v"))
    schema = StructType.fromDDL("component int, n long, deviation long, whitened double, explained double, identity_error double")
    schema = StructType([source.schema["key"], *schema.fields])
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= LARGEST))
    good = source.filter(F.coalesce((F.size("v") > 0) & finite, F.lit(False)))
    lengths = good.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("d")).first()
    if lengths is None:
        return spark.createDataFrame([], schema).withColumnRenamed("key", key)
    length = lengths["d"]
    rows = good.filter(F.size("v") == length).select("key", whole("v").alias("x"))
    made = fit(rows, length, components, block)
    held = spark.sparkContext.broadcast(made)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            m = held.value
            k, live = len(m.values), m.values > 0
            x = _matrix(batch, "x", length) - SHIFT
            scale = np.divide(1.0, np.sqrt(m.values), out=np.full(k, np.nan), where=live)
            y = _centred(x, m.n, m.sums) @ m.components * scale
            far = _centred(x, m.n, m.sums) * m.n
            if (far * far).sum(1).max() < 2**62 and np.abs(far).max() < 2**52:
                r = m.n * x - m.sums.astype(np.int64)
                deviation = pa.array((r * r).sum(1))
            else:
                exact = [int((r * r).sum()) for r in m.n * x.astype(object) - m.sums]
                deviation = pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())
            each = np.repeat(np.arange(batch.num_rows), k)
            at = pa.array(each)
            many = len(each)
            share = pa.array(m.values / m.trace if m.trace > 0 else [None] * k, pa.float64())
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), batch.num_rows)), pa.array(np.full(many, m.n)),
                deviation.take(at), pa.array(y.ravel(), from_pandas=True), share.take(pa.array(np.tile(np.arange(k), batch.num_rows))),
                pa.array(np.full(many, m.identity_error))], names=schema.names)

    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
