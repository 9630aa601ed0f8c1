import random

import pytest

from cohortspark.llm import mixing
from tests.llm.rows import documents, odd_texts


def plain_targets(sizes, weights, budget):
    """Targets by handing the budget out again and again, until none is above three times its source."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full = {s for s in names if not sizes[s]}
    while True:
        left = budget - sum(3 * sizes[s] for s in full)
        rest = sum(weight[s] for s in names if s not in full)
        over = {s for s in names if s not in full and weight[s] * left / rest >= 3 * sizes[s]} if rest else set()
        if not over:
            return {s: 3.0 * sizes[s] if s in full else weight[s] * left / rest for s in names}
        full |= over


def corpus(seed, n=600):
    rng = random.Random(seed)
    sources = ["a", "b", "c", "d", "é", None, "zero"]
    rows = []
    for i in range(n):
        source = rng.choices(sources, [300, 3, 20, 100, 5, 8, 0])[0]
        rows.append((i, " ".join(["w"] * rng.randint(0, 30)), "en", source))
    return rows + [(n, "", "en", "zero"), (n + 1, None, "en", "zero"), rows[3], rows[3]]


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_taken(spark, seed):
    rows = corpus(seed)
    sizes = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    total = sum(sizes.values())
    want = plain_targets(sizes, mixing.WEIGHTS, total)
    # documents() cannot hold a null source by its default
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    found = mixing.mix(df).collect()
    assert len(found) == len(rows)
    key_source = {r[0]: r[3] for r in rows}
    taken = {}
    for r in found:
        s = key_source[r["doc_id"]]
        assert r["source_size"] == sizes[s]
        assert r["target"] == pytest.approx(want[s])
        assert r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"])
        taken[s] = taken.get(s, 0) + r["taken"]
    assert total - 30 * len(sizes) <= sum(taken.values()) <= total
    assert all(abs(taken[s] - want[s]) <= 31 for s in want)
    again = mixing.mix(df.repartition(7, "source")).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))


def test_many_parts_give_the_same_cut(spark, monkeypatch):
    df = spark.createDataFrame([(*r, 0) for r in corpus(3)], "doc_id long, text string, lang string, source string, n_chars long")
    found = sorted(map(str, mixing.mix(df).collect()))
    monkeypatch.setattr(mixing, "PART_ROWS", 40)
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 1)
    assert sorted(map(str, mixing.mix(df).collect())) == found


def test_odd_tables(spark):
    df = documents(spark, list(enumerate(odd_texts())), extra=["size", "rank", "target"])
    found = {r["doc_id"]: r["size"] for r in mixing.mix(df).collect()}
    import re

    assert found == {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(odd_texts())}
    assert mixing.mix(df.limit(0)).count() == 0
    blank = mixing.mix(documents(spark, [(1, None), (2, " ")])).collect()
    assert [r["taken"] for r in blank] == [0, 0]


def test_rows_of_the_mixture(spark):
    rows = [(i, "a b c d", "en", "s" if i < 10 else "t") for i in range(40)] + [(5, "a b c d", "en", "s")]
    df = documents(spark, rows, extra=["row", "copies"])
    plan, out = mixing.mix(df).collect(), mixing.mixed(df)
    assert out.columns == df.columns
    assert out.count() == sum(r["copies"] for r in plan)
    assert mixing.mixed(df.limit(0)).count() == 0
