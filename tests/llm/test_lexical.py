import math
import random
import re
from collections import Counter

import pytest

from cohortspark.llm import lexical
from tests.llm.rows import documents, odd_texts

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def expected(docs, items, top=20):
    """By the book, all pairs."""
    bags = [(k, Counter(terms(t))) for k, t in docs]
    bags = [(k, c) for k, c in bags if c]
    n, total = len(bags), sum(sum(c.values()) for _, c in bags)
    df = Counter(t for _, c in bags for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        want = Counter(terms(text))
        scores = []
        for k, c in bags:
            m = 100 - 25 + (25 * sum(c.values()) * n) // total
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m))
                    for t, q in want.items() if t in c)
            if s > 0:
                scores.append((s, k))
        scores.sort(key=lambda x: (-x[0], x[1] is None, x[1] if x[1] is not None else 0))
        out += [(item, rank, k, s) for rank, (s, k) in enumerate(scores[:top], 1)]
    return sorted(out, key=repr)


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("an", "Bo", "çé", "9d", "e") for b in ("x", "yé", "zZ", "1", "ww", "日")]
    weights = [1 / (i + 1) for i in range(len(words))]
    def text(k):
        return "".join(w + rng.choice([" ", ", ", "\n", "-", "_"]) for w in rng.choices(words, weights, k=k))
    docs = [(i, text(rng.choice([1, 3, 10, 40, 200]))) for i in range(n)]
    items = [(i, text(rng.choice([1, 5, 30]))) for i in range(25)]
    docs += [(n + i, items[i % 5][1] + " " + text(5)) for i in range(30)]
    docs += [(5000 + i, docs[7][1]) for i in range(60)]
    return docs, items


def found(spark, docs, items, **options):
    df = documents(spark, docs).repartition(6)
    rows = lexical.ranked(df, spark.createDataFrame(items, "item_id long, text string"), **options).collect()
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_all_pairs(spark, seed):
    docs, items = corpus(seed, 400)
    assert found(spark, docs, items) == expected(docs, items)


def test_small_buckets_and_several_passes(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BUCKET_ROWS", 8)
    monkeypatch.setattr(lexical, "FIRST", 30)
    monkeypatch.setattr(lexical, "QUERIES", 10)
    monkeypatch.setattr(lexical, "SLICE_BYTES", 100)
    docs, items = corpus(3, 200)
    assert found(spark, docs, items, top=7) == expected(docs, items, 7)


def test_odd_rows(spark):
    docs, items = corpus(4, 80)
    docs = docs + [(9000 + i, t) for i, t in enumerate(odd_texts())] + [(None, "anx Boyé"), (None, "anx Boyé"), (3, "anx"), (3, "anx")]
    items = items + [(100, None), (101, ""), (102, "!?"), (103, "unknownterm"), (104, "anx ANX anx"), (104, "anx ANX anx"), (None, "日本語 to BE"), (104, "one")]
    got = found(spark, docs, items)
    want = expected(docs, items)
    assert got == want
    assert found(spark, docs, items[:0]) == [] and found(spark, docs[:0], items) == []


def test_other_columns_and_text_keys(spark):
    docs, items = corpus(5, 60)
    df = documents(spark, docs, extra=["score", "rank", "key", "iid", "terms", "length", "item"]).withColumnRenamed("doc_id", "name")
    df = df.selectExpr("*", "lpad(cast(name AS string), 6, '0') AS doc_id")
    rows = lexical.ranked(df, spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' AS key", "'x' AS rank")).collect()
    got = sorted(((r["item_id"], r["rank"], int(r["doc_id"]), r["score"]) for r in rows), key=repr)
    assert got == expected(docs, items)


def test_buckets_are_passed_over(spark, monkeypatch):
    """With scores to beat, few vectors are scored in full."""
    import numpy as np

    rng = np.random.default_rng(1)
    vocabulary, rows = 300, 2000
    sizes = rng.integers(1, 30, rows)
    ids = [np.sort(rng.choice(vocabulary, s, replace=False)) for s in sizes]
    values = [rng.integers(1, 10**6, s) for s in sizes]
    length = np.array([np.sqrt((v.astype(float) ** 2).sum()) for v in values])
    order = np.argsort(-length)
    bucket = lexical.Bucket(length[order], np.concatenate([ids[i] for i in order]), np.concatenate([values[i] for i in order]), sizes[order], vocabulary)
    q = np.zeros(vocabulary, np.int64)
    q[rng.choice(vocabulary, 12, replace=False)] = rng.integers(1, 8000, 12)
    t = np.flatnonzero(q)[np.argsort(-q[np.flatnonzero(q)])]
    rests = np.sqrt(np.append(np.cumsum((q[t].astype(float) ** 2)[::-1])[::-1], 0.0))
    truth = np.array([(q[ids[i]] * values[i]).sum() for i in order])
    beat = int(np.sort(truth)[-20])
    rows = bucket.reach(t, q[t], rests, beat)
    assert set(np.flatnonzero(truth >= beat)) <= set(rows.tolist()) and len(rows) < 200
    assert (bucket.exact(rows, q) == truth[rows]).all()
