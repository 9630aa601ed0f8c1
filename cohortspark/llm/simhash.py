"""Near copies by 64-bit fingerprints: one-wildcard variants of two halves, equal keys, verified distances.

Of two fingerprints that differ in three bits at most, one of the two 32-bit halves differs in one bit at most. Each
half is listed 32 times, each time with one bit wiped out, so such a pair meets under at least one equal key
(half, bit, wiped half). Rows of one key are streamed in key order; a group becomes the edges that hold its linked
parts together, never all its pairs. A group too large for that is cut again by the same rule over the two 16-bit
quarters of its other half: what then shares a key has 18 free bits, a bound no input can break.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from cohortspark.llm.common import add_columns
from cohortspark.operators.graph import connected_components
from cohortspark.runtime import cut

SEED = 42
WORDS = 3
BITS = 3
#: Groups up to this size list their linked pairs, each under one key only.
PAIRED = 16
#: Groups up to this size are searched whole; larger ones are cut again.
SEARCHED = 8192
HASHED_AT_ONCE = 1 << 16


def fingerprint(text: str | None) -> int:
    """Fingerprint of a text: per bit, whether over half of the shingle hashes have it. No word gives 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < WORDS:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-WORDS] + 1).tolist()]
    ends = ends[WORDS - 1:].tolist()
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), HASHED_AT_ONCE):
        part = slice(at, at + HASHED_AT_ONCE)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[part], ends[part])], ">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(starts)).tobytes(), "big")


def fingerprints(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``fp`` (long, the 64 bits); a null text has no words. A column named ``fp`` is replaced."""
    def run(texts):
        return {"fp": pa.array(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))}

    return add_columns(df, run, [text], "fp long", keep)


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _linked_parts(x: np.ndarray) -> np.ndarray:
    """For each of some fingerprints the place of the first of its linked part. Each one is compared once."""
    root, left = np.arange(len(x)), np.arange(len(x))
    while len(left):
        seed, left = left[0], left[1:]
        open_ = np.array([seed])
        while len(open_) and len(left):
            now, open_ = open_[:128], open_[128:]
            hit = (np.bitwise_count(x[now][:, None] ^ x[left][None, :]) <= BITS).any(0)
            root[left[hit]] = seed
            open_, left = np.concatenate([open_, left[hit]]), left[~hit]
    return root


_MASKS = [sum(1 << b for b in bits) for n in range(1, BITS + 1) for bits in combinations(range(18), n)]


def _linked_in_cube(x: np.ndarray, free: np.ndarray) -> np.ndarray:
    """The same for fingerprints that agree but for 18 bits: neighbours are looked up in a table of the free bits."""
    none = len(x)
    table = np.full(1 << 18, none)
    table[free] = np.arange(none)
    root = np.append(np.arange(none), none)
    while True:
        before = root.copy()
        for mask in _MASKS:
            root[:none] = np.minimum(root[:none], root[table[free ^ mask]])
        root = root[root] if none else root
        if (root == before).all():
            return root[:none]


def _canonical(x: np.ndarray, y: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether a pair belongs to this key: the first half that differs in one bit at most, at that bit or at bit 0."""
    diff = x ^ y
    low, high = diff & np.uint64(0xFFFFFFFF), diff >> np.uint64(32)
    use_high = np.bitwise_count(low) > 1
    part = np.where(use_high, high, low)
    bit = np.where(part == 0, 0, np.bitwise_count(part - np.uint64(1) * (part > 0)))
    return (key >> 32) == np.where(use_high, 32, 0) + bit


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]):
    """Whole key groups of rows sorted by key, some at a time: key columns, fingerprints; of a group above SEARCHED
    rows the parts come as they are read, with a flag."""
    held: list[np.ndarray] | None = None
    hot = False  # the held rows go on a group whose first part was given out
    for batch in batches:
        cols = [batch.column(k).to_numpy() for k in [*keys, "fp"]]
        if not len(cols[0]):
            continue
        if held is not None:
            cols = [np.concatenate([a, b]) for a, b in zip(held, cols)]
        change = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols[:-1]])) + 1
        if hot and len(change):  # the rest of a hot group
            yield [c[:change[0]] for c in cols], True
            cols = [c[change[0]:] for c in cols]
            change, hot = change[1:] - change[0], False
        last = change[-1] if len(change) else 0
        if last:
            yield [c[:last] for c in cols], False
            cols = [c[last:] for c in cols]
        if len(cols[0]) > SEARCHED and len(keys) == 1:
            yield cols, True
            hot, cols = True, [c[-1:] for c in cols]  # one row stays as the mark of the group
        held = cols
    if held is not None:
        yield held, hot


def _edges_of(key: np.ndarray, fp: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
    """Edges of whole groups of one level of keys, group by group or many small ones at once."""
    out = []
    small = np.repeat(sizes <= PAIRED, sizes)
    k, x = key[small], fp[small]
    for step in range(1, PAIRED):
        same = np.flatnonzero(k[step:] == k[:-step]) if step < len(k) else np.empty(0, int)
        if not len(same):
            break
        a, b = x[same], x[same + step]
        near = (np.bitwise_count(a ^ b) <= BITS) & _canonical(a, b, k[same])
        out.append((a[near], b[near]))
    for at, n in zip(starts[sizes > PAIRED], sizes[sizes > PAIRED]):
        x = fp[at:at + n]
        root = _linked_parts(x)
        tied = root != np.arange(n)
        out.append((x[root[tied]], x[tied]))
    return out


def _batch(a, b, hot):
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c).view(np.int64)) for c in (a, b, hot)], names=["a", "b", "hot"])


def _first_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (key, fp), hot in _groups(batches, ["key"]):
        fp = fp.view(np.uint64)
        starts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
        sizes = np.diff(np.append(starts, len(key)))
        whole = (sizes <= SEARCHED) & (not hot)
        take = np.repeat(whole, sizes)
        if not take.all():
            yield _batch(fp[~take], fp[~take], key[~take])
        if take.any():
            kept = sizes[whole]
            for a, b in _edges_of(key[take], fp[take], np.cumsum(kept) - kept, kept):
                if len(a):
                    yield _batch(a, b, np.full(len(a), -1))


def _second_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (key, sub, fp), _ in _groups(batches, ["key", "sub"]):
        fp = fp.view(np.uint64)
        starts = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]) | (sub[1:] != sub[:-1])) + 1])
        for at, n in zip(starts, np.diff(np.append(starts, len(key)))):
            if n < 2:
                continue
            x = np.unique(fp[at:at + n])
            if len(x) <= 1024:
                root = _linked_parts(x)
            else:
                half, bit = divmod(int(key[at]) >> 32, 32)
                quarter, bit2 = divmod(int(sub[at]) >> 16, 16)
                base = 32 * (1 - half) + 16 * quarter
                outer = base - 16 * quarter + 16 * (1 - quarter)  # the quarter in which one bit is free
                base, outer = np.uint64(outer), np.uint64(base + bit2)
                free = ((x >> np.uint64(32 * half + bit) & np.uint64(1)) << np.uint64(17)
                        | (x >> outer & np.uint64(1)) << np.uint64(16) | (x >> base & np.uint64(0xFFFF)))
                root = _linked_in_cube(x, free.astype(np.int64))
            tied = root != np.arange(len(x))
            if tied.any():
                yield _batch(x[root[tied]], x[tied], np.full(int(tied.sum()), -1))


def _wiped(value: Column, at: Column, width: int) -> Column:
    """(place, value without the bit at the place) as one number; ``at`` counts over the parts of ``width`` bits."""
    bit = at % width
    part = F.call_function("shiftrightunsigned", value, (at - bit).cast("int")).bitwiseAND(F.lit((1 << width) - 1))
    mask = F.lit((1 << width) - 1).bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit.cast("int")))
    return F.call_function("shiftleft", at.cast("long"), F.lit(width)).bitwiseOR(part.bitwiseAND(mask))


def edges(distinct: DataFrame) -> DataFrame:
    """(a, b): edges between the distinct fingerprints ``fp`` that link exactly what distances of BITS and less link."""
    listed = distinct.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("at"))
    keyed = listed.select(_wiped(F.col("fp"), F.col("at"), 32).alias("key"), "fp")
    first = cut(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_first_level, "a long, b long, hot long"))
    found = first.filter("hot < 0").select("a", "b")
    hot = first.filter("hot >= 0").select(F.col("hot").alias("key"), F.col("a").alias("fp")).distinct()
    half = F.call_function("shiftrightunsigned", F.col("key"), F.lit(37))
    other = F.call_function("shiftrightunsigned", F.col("fp"), (32 * (1 - half)).cast("int")).bitwiseAND(F.lit((1 << 32) - 1))
    again = (hot.select("key", "fp", other.alias("other"), F.explode(F.sequence(F.lit(0), F.lit(31))).alias("at"))
             .select("key", _wiped(F.col("other"), F.col("at"), 16).alias("sub"), "fp"))
    late = (again.repartition("key", "sub").sortWithinPartitions("key", "sub")
            .mapInArrow(_second_level, "a long, b long, hot long").select("a", "b"))
    return found.unionByName(late)


def classes(prints: DataFrame, key: str = "doc_id", print_col: str = "fp") -> DataFrame:
    """(key, fp, component_id) for rows (key, fp): the smallest key among all rows linked by chains of near fingerprints.

    Equal fingerprints are searched once. Null keys do not name a class: a class of nothing else has a null id.
    """
    prints = prints.select(F.col(key), F.col(print_col).alias("fp"))
    distinct = cut(prints.groupBy("fp").agg(F.min(key).alias("least")))
    linked = connected_components(edges(distinct.select("fp")))
    rooted = distinct.join(linked.select(F.col("id").alias("fp"), "component"), "fp", "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.select("fp", "root").join(named, "root").select("fp", "component_id")
    return prints.join(of, "fp").select(key, "fp", "component_id")


def near_copies(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp, component_id), one row per row of ``df``; see :func:`fingerprints` and :func:`classes`.

    Texts are read once and not shuffled. An empty table gives an empty result; other columns are ignored.
    """
    return classes(cut(fingerprints(df.select(key, text), text, keep=[key])), key)


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` without near copies: of each class the row with the smallest key stays, of rows equal in key
    one. Rows with a null key are not compared and stay."""
    found = cut(near_copies(df.filter(F.col(key).isNotNull()), key, text))
    firsts = found.filter(F.col(key) == F.col("component_id")).groupBy(key).agg(F.count("*").alias("_copies_of_key"))
    firsts = cut(firsts)
    # the list of keys grows with the table, so the plan is that of a large table at every size
    listed = firsts.select(F.col(key).alias("_first_of_class"), "_copies_of_key").hint("merge")
    kept = df.join(listed, F.col(key) == F.col("_first_of_class")).drop("_first_of_class")
    if not firsts.filter("_copies_of_key > 1").isEmpty():  # only rows that share a key are brought together
        several = kept.filter("_copies_of_key > 1").dropDuplicates([key])
        kept = kept.filter("_copies_of_key = 1").unionByName(several)
    return kept.drop("_copies_of_key").unionByName(df.filter(F.col(key).isNull()))
