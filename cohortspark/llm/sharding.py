"""Shards by a tree of weighted hash draws: region, rack, shard.

Every child of a node draws an exponential number of rate ``weight`` from the hash of (key, child); the least
draw wins and the walk goes on below the winner, so a shard gets its share of all weight. A shard that joins
later is an increment of the tree: it draws once at the top with its own weight and, where it wins, the row goes
straight to it. The draws of the earlier subtrees do not change, so rows move only into the subtree that grew.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from cohortspark.llm.common import shuffle_key, unit_draw
from cohortspark.operators.ordered import hashed_row_number


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


@dataclass(frozen=True)
class Tree:
    """Leaves the tree was built with and leaves that joined since."""

    leaves: tuple[Leaf, ...]
    joined: tuple[Leaf, ...] = ()

    def grown(self, *new: Leaf) -> Tree:
        return Tree(self.leaves, self.joined + new)

    def children(self) -> dict[str, list[tuple[str, float]]]:
        """Node path to the (path, weight) of its children; ``""`` is the top."""
        out: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
        for x in self.leaves:
            region, rack, shard = f"g{x.region}", f"g{x.region}.r{x.rack}", f"g{x.region}.r{x.rack}.s{x.shard}"
            for parent, child in (("", region), (region, rack), (rack, shard)):
                out[parent][child] += x.weight
        return {k: sorted(v.items()) for k, v in out.items()}


def even_tree(shards: int, shards_per_rack: int = 4, racks_per_region: int = 4) -> Tree:
    """Shards 0 to ``shards`` - 1 of equal weight, racks and regions filled in order."""
    return Tree(tuple(Leaf(s // shards_per_rack // racks_per_region, s // shards_per_rack % racks_per_region, s)
                      for s in range(shards)))


def _least(key: Column, children: Column) -> Column:
    """(draw, path) of the child with the least draw; equal draws go to the lesser path."""
    return F.array_min(F.transform(children, lambda c: F.struct(
        (-F.log(unit_draw(key, c["path"])) / c["weight"]).alias("draw"), c["path"].alias("path"))))


def shard_of(key: Column, tree: Tree) -> Column:
    """Shard of a key. A null key is the text ``null``."""
    key = F.coalesce(key.cast("string"), F.lit("null"))

    def literal(children):
        return F.array(*[F.struct(F.lit(p).alias("path"), F.lit(float(w)).alias("weight")) for p, w in children])

    below = tree.children()
    nodes = F.create_map(*[x for path, kids in below.items() if path for x in (F.lit(path), literal(kids))])
    top = _least(key, literal(below[""]))
    leaf = _least(key, F.element_at(nodes, _least(key, F.element_at(nodes, top["path"]))["path"]))["path"]
    if tree.joined:
        late = _least(key, literal([(f"g{x.region}.r{x.rack}.s{x.shard}", x.weight) for x in tree.joined]))
        leaf = F.when(late["draw"] < top["draw"], late["path"]).otherwise(leaf)
    return F.element_at(F.split(leaf, "s"), -1).cast("int")


def assign(df: DataFrame, tree: Tree, key: str = "doc_id", text: str = "text", per_row: int = 16) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard), one row per row of ``df``.

    ``size`` is the UTF-8 length of the text plus ``per_row``; a null text has no bytes (and the CRC of none). The
    slot counts the rows of a shard from 0 along a hash of the key, then key, size and CRC; rows equal in all three
    take neighbouring slots. ``grown_shard`` is the shard after one more shard of weight 1 has joined as the next
    of the last rack. Only the four small columns are shuffled, and a shard is numbered in hash buckets. Rows with a
    null key share one shard. Columns other than key and text are ignored, whatever their names.
    """
    last = max(tree.leaves + tree.joined, key=lambda x: x.shard)
    more = tree.grown(Leaf(last.region, last.rack, last.shard + 1))
    small = df.select(F.col(key), (F.coalesce(F.octet_length(text), F.lit(0)) + per_row).cast("long").alias("size"),
                      F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"))
    placed = small.select("*", F.lit("key").alias("law"), shard_of(F.col(key), tree).alias("shard"),
                          shard_of(F.col(key), more).alias("grown_shard"))
    tie = F.struct(key, "size", "text_crc32")
    numbered = hashed_row_number(placed, ["shard"], shuffle_key(F.col(key), F.lit("slot")), tie, "_nth")
    return numbered.select(key, "size", "text_crc32", "law", "shard", (F.col("_nth") - 1).alias("slot"), "grown_shard")


def assign_sql(tree: Tree) -> str:
    """:func:`assign` over the table ``documents``; the CRC goes byte by byte through its table of 256 remainders."""
    last = max(tree.leaves + tree.joined, key=lambda x: x.shard)
    kids = [(parent or "top", path, weight) for parent, all_ in tree.children().items() for path, weight in all_]
    kids += [("late", f"g{x.region}.r{x.rack}.s{x.shard}", x.weight) for x in (*tree.joined, Leaf(last.region, last.rack, last.shard + 1))]
    rows = ", ".join(f"('{parent}', '{path}', {float(weight)}::DOUBLE)" for parent, path, weight in kids)
    draw = "-ln((('0x' || substr(md5(key || '/' || path), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) / weight"

    def least(name, source, parent):
        return (f"{name} AS (SELECT row, (min({{'draw': {draw}, 'path': path}})).path AS path, min({draw}) AS draw "
                f"FROM {source} JOIN kid ON parent = {parent} GROUP BY row)")

    def shard(path):
        return f"split_part({path}, 's', -1)::INT"

    return f"""
WITH RECURSIVE kid(parent, path, weight) AS (VALUES {rows}),
bits AS (SELECT i::BIGINT AS i, i::BIGINT AS c, 0 AS n FROM range(256) x(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, n + 1 FROM bits WHERE n < 8),
crc AS (SELECT list(c ORDER BY i) AS remainder FROM bits WHERE n = 8),
doc AS (SELECT row_number() OVER () AS row, doc_id, coalesce(doc_id::VARCHAR, 'null') AS key, encode(coalesce(text, '')) AS raw FROM documents),
sized AS (SELECT row, doc_id, key, octet_length(raw)::BIGINT + 16 AS size, xor(list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(regexp_extract_all(hex(raw), '..'), lambda b: ('0x' || b)::BIGINT)),
    lambda a, b: xor(a >> 8, remainder[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) AS text_crc32 FROM doc, crc),
{least("region", "doc", "'top'")},
{least("rack", "(SELECT row, key, region.path AS up FROM doc JOIN region USING (row))", "up")},
{least("leaf", "(SELECT row, key, rack.path AS up FROM doc JOIN rack USING (row))", "up")},
{least("late", "doc", "'late'")},
placed AS (SELECT sized.*, {shard("leaf.path")} AS shard, CASE WHEN late.draw < region.draw THEN {shard("late.path")} ELSE {shard("leaf.path")} END AS grown_shard
  FROM sized JOIN region USING (row) JOIN leaf USING (row) JOIN late USING (row))
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard
    ORDER BY ('0x' || substr(md5(key || '/slot'), 1, 15))::BIGINT, doc_id, size, text_crc32) - 1 AS slot, grown_shard FROM placed"""
