import random

import numpy as np
import pytest
import xxhash

from cohortspark.llm import simhash
from tests.llm.rows import documents, odd_texts


def plain(text):
    """The fingerprint by the book."""
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in lower + " ":
        if c in " \t\n\x0b\x0c\r":
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), 42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    """{print: least of its class} by comparing all pairs."""
    prints = sorted(set(prints))
    root = {p: p for p in prints}

    def top(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, p in enumerate(prints):
        for q in prints[:i]:
            if (p ^ q).bit_count() <= 3:
                a, b = sorted((top(p), top(q)))
                root[b] = a
    return {p: top(p) for p in prints}


def classes_of(spark, prints):
    signed = [(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)]
    found = simhash.classes(spark.createDataFrame(signed, "doc_id long, fp long").repartition(4)).collect()
    assert len(found) == len(prints)
    return {r["doc_id"]: r["component_id"] for r in found}


def expected(prints):
    root, least = components(prints), {}
    for i, p in enumerate(prints):
        least.setdefault(root[p], i)
    return {i: least[root[p]] for i, p in enumerate(prints)}


def crowd(rng, n, spread):
    """Prints around a few centres, some in chains, some equal, some alone."""
    out = [rng.getrandbits(64) for _ in range(5)] + [0, (1 << 64) - 1]
    while len(out) < n:
        p = rng.choice(out)
        for _ in range(rng.randint(0, spread)):
            p ^= 1 << rng.randrange(64)
        out.append(p)
    rng.shuffle(out)
    return out


def test_fingerprints():
    for text in odd_texts():
        assert simhash.fingerprint(text) == plain(text)


def test_hashing_in_parts(monkeypatch):
    text = odd_texts()[12]
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "HASHED_AT_ONCE", 100)
    assert simhash.fingerprint(text) == whole == plain(text)


@pytest.mark.parametrize("spread", [3, 6])
def test_classes(spark, spread):
    prints = crowd(random.Random(spread), 500, spread)
    assert classes_of(spark, prints) == expected(prints)


def test_large_groups_are_cut_again(spark, monkeypatch):
    """Every prints group above a handful goes through the second level; the classes stay the same."""
    import cohortspark.llm.simhash as module

    rng = random.Random(5)
    centre = rng.getrandbits(64)
    prints = crowd(rng, 150, 5) + [centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(32)) for _ in range(150)]
    values = np.array(sorted({p for p in prints}), np.uint64)
    keyed = sorted((int(k), int(p)) for p in values.tolist() for k in keys(p))
    import pyarrow as pa

    def batches(rows, names):
        for at in range(0, len(rows), 97):
            part = rows[at:at + 97]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(c, np.uint64).view(np.int64)) for c in zip(*part)], names=names)

    monkeypatch.setattr(module, "SEARCHED", 6)
    monkeypatch.setattr(module, "PAIRED", 3)
    first = [r for b in module._first_level(batches(keyed, ["key", "fp"])) for r in zip(*[c.to_pylist() for c in b.columns])]
    hot = sorted({(k, a & (1 << 64) - 1) for a, _, k in first if k >= 0})
    assert len(hot) > 100
    again = sorted((k, s, p) for k, p in hot for s in sub_keys(k, p))
    late = [r for b in module._second_level(batches(again, ["key", "sub", "fp"])) for r in zip(*[c.to_pylist() for c in b.columns])]
    links = [(a, b) for a, b, k in first if k < 0] + [(a, b) for a, b, _ in late]
    assert united(values.tolist(), links) == components(values.tolist())


def keys(p):
    return [(32 * half + bit) << 32 | ((p >> 32 * half & 0xFFFFFFFF) & ~(1 << bit)) for half in (0, 1) for bit in range(32)]


def sub_keys(key, p):
    other = p >> 32 * (1 - (key >> 37)) & 0xFFFFFFFF
    return [(16 * q + bit) << 16 | ((other >> 16 * q & 0xFFFF) & ~(1 << bit)) for q in (0, 1) for bit in range(16)]


def united(values, links):
    root = {v: v for v in values}

    def top(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in links:
        a, b = sorted((top(a & (1 << 64) - 1), top(b & (1 << 64) - 1)))
        root[b] = a
    return {v: top(v) for v in values}


def test_keys_in_spark_are_those_of_the_rule(spark):
    from pyspark.sql import functions as F

    p = 0xF123456789ABCDE7
    df = spark.createDataFrame([(p - (1 << 64),)], "fp long")
    got = df.select(F.explode(F.sequence(F.lit(0), F.lit(63))).alias("at"), "fp").select(simhash._wiped(F.col("fp"), F.col("at"), 32).alias("k"))
    assert sorted(r["k"] for r in got.collect()) == sorted(keys(p))


def test_dense_cube_equals_search():
    rng = np.random.default_rng(1)
    free = np.unique(rng.integers(0, 1 << 18, 3000))
    x = free.astype(np.uint64)
    a, b = simhash._linked_in_cube(x, free), simhash._linked_parts(x)
    assert len(set(a)) == len(set(zip(a, b))) == len(set(b))


def test_table(spark):
    texts = odd_texts()
    rows = [(100 - i, t) for i, t in enumerate(texts)] + [(None, "one two three"), (94, "one two three"), (94, "one two three")]
    df = documents(spark, rows, extra=["fp", "component_id"])
    found = simhash.near_copies(df).collect()
    prints = [plain(t) for _, t in rows]
    root = components(prints)
    least = {}
    for (key, _), p in zip(rows, prints):
        if key is not None:
            least[root[p]] = min(key, least.get(root[p], key))
    got = sorted(str((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"])) for r in found)
    assert got == sorted(str((key, p, least[root[p]])) for (key, _), p in zip(rows, prints))
    stay = simhash.one_of_each(df)
    assert stay.columns == df.columns
    assert sorted(r["doc_id"] for r in stay.filter("doc_id IS NOT NULL").collect()) == sorted(set(least.values()))
    assert stay.filter("doc_id IS NULL").count() == 1
    assert simhash.near_copies(df.limit(0)).count() == 0 and simhash.one_of_each(df.limit(0)).count() == 0
