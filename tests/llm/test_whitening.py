import math

import numpy as np
import pytest

from cohortspark.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def expected(rows, k=16):
    """By a dense solver: (n, per row (id, deviation, projections on the components over the root of the eigenvalue), explained)."""
    good = [r for r in rows if r[1] and all(c is not None and math.isfinite(c) for c in r[1])]
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in r[1]] for r in good]
    fit = sorted({tuple(v) for v in x})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    mean = np.array([s / n for s in sums])
    centred = np.array(fit, float) - mean
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    out = []
    for r, v in zip(good, x):
        out.append((r[0], sum((n * c - s) ** 2 for c, s in zip(v, sums)), (np.array(v) - mean) @ u / np.sqrt(e)))
    return n, out, e / (centred ** 2).sum() * n


def table(spark, rows, **options):
    return whitening.whitened(spark.createDataFrame(rows, SCHEMA).repartition(7), **options).collect()


def vectors(seed, n, d):
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(d, d)) * np.geomspace(1, 0.05, d)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(rng.normal(size=(n, d)) @ mix.T + rng.normal(size=d))]
    return rows + [(n + i, rows[5][1], 0) for i in range(n // 3)]


def compare(found, rows):
    n, want, explained = expected(rows)
    by = {}
    for r in found:
        by.setdefault(r["vec_id"], {})[r["component"]] = r
    assert len(found) == sum(len(v) for v in by.values()) and set(by) == {w[0] for w in want}
    k = len(explained)
    got = np.array([[by[w[0]][c]["whitened"] for c in range(1, k + 1)] for w in want])
    truth = np.array([w[2] for w in want])
    signs = np.sign((got * truth).sum(0))
    assert np.allclose(got * signs, truth, rtol=1e-6, atol=1e-6)
    for w in want:
        for r in by[w[0]].values():
            assert (r["n"], r["deviation"]) == (n, w[1])
            assert r["explained"] == pytest.approx(explained[r["component"] - 1], rel=1e-7)
            assert r["identity_error"] < 1e-9


@pytest.mark.parametrize("d, block", [(24, 256), (24, 1), (5, 3), (1, 256), (17, 40)])
def test_dense_solver(spark, d, block):
    rows = vectors(d + block, 150, d)
    compare(table(spark, rows, block=block), rows)


def test_fan_in_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    rows = vectors(2, 200, 12)
    compare(table(spark, rows, block=8), rows)


@pytest.mark.parametrize("d", [1, 2, 7, 40])
def test_rank_one_updates(d):
    """Eigenvalues and orthogonal vectors after many updates, equal eigenvalues and rows along eigenvectors among them."""
    rng = np.random.default_rng(d)
    lam, vectors, whole = np.zeros(d), np.eye(d), np.zeros((d, d))
    for i in range(150):
        row = rng.normal(size=d) * 10.0 ** rng.integers(-4, 4)
        if i % 5 == 0:
            row = np.eye(d)[i % d] * 2
        if i % 7 == 0:
            row = vectors[:, i % d] * 3
        if i % 11 == 0:
            row = row * 0
        whole += np.outer(row, row)
        lam, vectors = whitening.rank_one(lam, vectors, row)
    top = np.linalg.eigvalsh(whole)
    assert np.allclose(lam, top, atol=1e-11 * top[-1])
    assert np.abs(vectors.T @ vectors - np.eye(d)).max() < 1e-11
    assert np.abs(vectors * lam @ vectors.T - whole).max() < 1e-11 * top[-1]


def test_spectra_combine():
    rng = np.random.default_rng(8)
    x = rng.integers(-50, 50, size=(400, 9)) * np.arange(1, 10)
    one, two = whitening.Spectrum([0] * 9), whitening.Spectrum([0] * 9)
    for at in range(0, 250, 30):
        one.add(x[at:min(at + 30, 250)])
    for row in x[250:]:
        two.add(row[None])
    one.join(two)
    c = x - x.mean(0)
    assert one.n == 400 and one.sums == x.sum(0).tolist()
    assert np.allclose(one.vectors * one.lam @ one.vectors.T, c.T @ c, rtol=1e-9, atol=1e-6)


def test_odd_tables(spark):
    rows = vectors(4, 60, 6)
    odd = [(900, None, 0), (901, [], 0), (902, [0.0] * 6, 0), (903, [1.0, None, 1.0, 1.0, 1.0, 1.0], 0), (904, [float("nan")] * 6, 0),
           (905, [float("inf")] + [0.0] * 5, 0), (906, [1.0, 2.0], 0), (None, [0.5] * 6, 0)]
    df = spark.createDataFrame(rows + odd, SCHEMA)
    for name in ("key", "x", "v", "n", "component"):
        df = df.selectExpr("*", f"'a' AS `{name}`")
    found = whitening.whitened(df).collect()
    assert {r["vec_id"] for r in found} == {r[0] for r in rows} | {902, None}
    compare([r for r in found], rows + [odd[2], odd[7]])
    assert whitening.whitened(df.limit(0)).count() == 0


def test_no_variance(spark):
    found = table(spark, [(i, [1.0, 2.0, 3.0], 0) for i in range(5)])
    assert len(found) == 15 and {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in found} == {(1, 0, None, None, 0.0)}
    flat = table(spark, [(i, [float(i % 4), 2.0], 0) for i in range(8)])
    assert {r["component"]: r["whitened"] is None for r in flat} == {1: False, 2: True}
    assert all(r["identity_error"] < 1e-9 for r in flat)


def test_large_numbers_stay_exact(spark):
    rows = [(i, [float(v), float(i * i * 1000)], 0) for i, v in enumerate([1, -70_001, 900_003, 6_000_000, -7_000_000])]
    assert max(w[1] for w in expected(rows)[1]) > 2**62
    compare(table(spark, rows), rows)
    huge = table(spark, [(0, [2.0**39, 0.0], 0), (1, [-(2.0**39), 1.0], 0)])
    assert {r["deviation"] for r in huge} == {None}
