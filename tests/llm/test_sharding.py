import zlib
from collections import Counter

from pyspark.sql import functions as F

from cohortspark.llm import sharding
from cohortspark.llm.sharding import Leaf, Tree
from tests.llm.rows import documents, odd_texts


def test_sizes_slots_and_growth(spark):
    rows = [(i, "x" * (i % 50)) for i in range(8000)] + [(5, "x" * 5)] * 3 + [(None, "n"), (None, None)]
    found = sharding.assign(documents(spark, rows, extra=["slot", "shard"]), sharding.even_tree(40)).collect()
    assert len(found) == len(rows)
    by = {}
    for r in found:
        by.setdefault(r["shard"], []).append(r["slot"])
        assert r["law"] == "key" and r["grown_shard"] in (r["shard"], 40)
    assert set(by) == set(range(40))
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert all(130 < len(s) < 280 for s in by.values())
    moved = sum(r["grown_shard"] == 40 for r in found)
    assert 130 < moved < 280
    assert len({r["shard"] for r in found if r["doc_id"] == 5}) == 1


def test_sizes_and_checksums(spark):
    rows = list(enumerate(odd_texts()))
    found = {r["doc_id"]: r for r in sharding.assign(documents(spark, rows), sharding.even_tree(40)).collect()}
    for key, text in rows:
        raw = (text or "").encode()
        assert (found[key]["size"], found[key]["text_crc32"]) == (len(raw) + 16, zlib.crc32(raw))
    assert sharding.assign(documents(spark, []), sharding.even_tree(40)).count() == 0


def test_weights_and_confined_movement(spark):
    tree = Tree((Leaf(0, 0, 0, 3.0), Leaf(0, 0, 1, 1.0), Leaf(0, 1, 2, 2.0), Leaf(1, 0, 3, 2.0)))
    grown = tree.grown(Leaf(1, 1, 4, 4.0), Leaf(0, 1, 5, 1.0))
    rows = spark.range(20_000).select(sharding.shard_of(F.col("id"), tree).alias("a"), sharding.shard_of(F.col("id"), grown).alias("b")).collect()
    share = Counter(r["a"] for r in rows)
    assert all(abs(share[s] / 20_000 - w / 8) < 0.015 for s, w in ((0, 3), (1, 1), (2, 2), (3, 2)))
    assert all(r["a"] == r["b"] or r["b"] in (4, 5) for r in rows)
    share = Counter(r["b"] for r in rows)
    assert all(abs(share[s] / 20_000 - w / 13) < 0.015 for s, w in ((4, 4), (5, 1)))
