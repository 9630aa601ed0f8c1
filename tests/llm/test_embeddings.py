import numpy as np
import pytest

from cohortspark.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, label int"


def expected(rows, threshold=0.95):
    """By comparing all pairs."""
    good = [r for r in rows if r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    units = [np.array(r[1], np.float32).astype(float) for r in good]
    units = [u / np.abs(u).max() for u in units]
    units = [u / np.sqrt((u * u).sum()) for u in units]
    linked = [[i != j and len(a) == len(b) and a @ b >= threshold for j, b in enumerate(units)] for i, a in enumerate(units)]
    out, root = [], list(range(len(good)))
    while True:
        new = [min([root[i]] + [root[j] for j, yes in enumerate(linked[i]) if yes]) for i in range(len(good))]
        if new == root:
            break
        root = new
    least = {}
    for r, top in zip(good, root):
        if r[0] is not None:
            least[top] = min(r[0], least.get(top, r[0]))
    for i, r in enumerate(good):
        out.append((r[0], int(sum(linked[i])), least.get(root[i]), r[0] == least.get(root[i])))
    good_ids = {id(r) for r in good}
    out += [(r[0], 0, r[0], True) for r in rows if id(r) not in good_ids]
    return sorted(map(str, out))


def clustered(seed, n, d, noise):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, d))
    return [(int(i), (centres[rng.integers(8)] + noise * rng.normal(size=d)).tolist(), 0) for i in range(n)]


def run(spark, rows, **options):
    found = embeddings.near_vectors(spark.createDataFrame(rows, SCHEMA), **options).collect()
    assert len(found) == len(rows)
    return sorted(str(tuple(r)) for r in found)


@pytest.mark.parametrize("d, noise", [(8, 0.1), (40, 0.25), (2, 0.5), (1, 1.0)])
def test_all_pairs(spark, d, noise):
    rows = clustered(d, 250, d, noise)
    assert run(spark, rows) == expected(rows)


def test_small_blocks_and_steps(spark, monkeypatch):
    rows = clustered(9, 400, 24, 0.2)
    rows += [(1000 + i, rows[3][1], 1) for i in range(60)]
    monkeypatch.setattr(embeddings, "BLOCK_BYTES", 64 * 8 * 24)
    monkeypatch.setattr(embeddings, "ROWS", 10)
    monkeypatch.setattr(embeddings, "STEP", 5)
    assert run(spark, rows) == expected(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [None, 1.0], 0), (5, [nan, 1.0], 0), (6, [inf, 1.0], 0), (7, [1.0, 2.0], 0),
            (8, [2.0, 4.0], 0), (9, [1.0, 2.0], 0), (9, [1.0, 2.0], 0), (None, [1.0, 2.0], 0), (10, [1.0, 2.0, 0.0], 0), (11, [-1.0, -2.0], 0),
            (12, [1e-30, 2e-30], 0), (13, [3e38, 3e38], 0), (14, [0.0, -0.0, 1.0], 0), (15, [-0.0, 0.0, 1.0], 0), (None, [-5.0, 5.0], 0)]
    assert run(spark, rows) == expected(rows)
    assert embeddings.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    extra = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS n_links", "'x' AS h1", "2 AS unit", "3 AS key")
    assert sorted(str(tuple(r)) for r in embeddings.near_vectors(extra).collect()) == expected(rows)


def test_given_table(spark, folder):
    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    rows = [tuple(r) for r in table.collect()]
    assert sorted(str(tuple(r)) for r in embeddings.near_vectors(table).collect()) == expected(rows)
