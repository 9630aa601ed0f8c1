"""Helpers shared by the text operators: Arrow batches in small slices, hashes, hash buckets of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

#: Rows whose texts are held as Python objects at one time.
SLICE_ROWS = 256
#: Distinct numbers a counting task holds before it gives out its counts.
HELD = 1 << 20
#: White space of all word contracts: space, tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"


def add_columns(df: DataFrame, fn: Callable[..., dict[str, pa.Array]], inputs: list[str], added: str,
                keep: list[str] | None = None) -> DataFrame:
    """Add the columns ``fn(*input columns)`` returns; ``keep`` lists the columns carried along.

    ``fn`` gets Python lists of at most SLICE_ROWS values. A column of ``df`` that has the name of an added
    one is replaced. Rows stay in their partition, in their order.
    """
    names = [c.split(":")[0].split(" ")[0] for c in added.split(", ")]
    kept = [c for c in (df.columns if keep is None else keep) if c not in names]
    source = df.select(*kept, *[F.col(c).alias(f"_in{i}") for i, c in enumerate(inputs)])
    schema = StructType(source.schema.fields[:len(kept)] + StructType.fromDDL(added).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                new = fn(*[part.column(len(kept) + i).to_pylist() for i in range(len(inputs))])
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(kept))] + [new[n] for n in names],
                                                 names=kept + names)

    return source.mapInArrow(run, schema)


def tally(codes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers in order, and how often each occurs (or the sums of ``counts``)."""
    if counts is None:
        codes = np.sort(codes)
    else:
        order = np.argsort(codes, kind="stable")
        codes, counts = codes[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))[:len(codes)]
    if counts is None:
        return codes[starts], np.diff(np.append(starts, len(codes)))
    return codes[starts], np.add.reduceat(counts, starts) if len(starts) else counts


def gram_counts(df: DataFrame, group: str, text: str, grams: Callable[[str], np.ndarray]) -> DataFrame:
    """(grp, gram, n) over whole texts, ``grams`` turning one into 64-bit numbers; null texts give none. Counts are
    combined in the tasks, in bounded memory, before they are shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, tuple[np.ndarray, np.ndarray]] = {}

        def given_out():
            for name, (codes, counts) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes), pa.array(counts)],
                                                 names=["grp", "gram", "n"])
            held.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                by: dict[str | None, list[np.ndarray]] = {}
                for name, value in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    by.setdefault(name, []).append(grams(value))
                for name, found in by.items():
                    new = tally(np.concatenate(found))
                    if name in held:
                        new = tally(np.concatenate([held[name][0], new[0]]), np.concatenate([held[name][1], new[1]]))
                    held[name] = new
                if sum(len(c) for c, _ in held.values()) > HELD:
                    yield from given_out()
        yield from given_out()

    rows = df.filter(F.col(text).isNotNull()).select(F.col(group).cast("string").alias("grp"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "grp string, gram long, n long").groupBy("grp", "gram").agg(F.sum("n").alias("n"))


def unit_draw(*parts: Column) -> Column:
    """A number above 0 and below 1 from the MD5 of the parts, joined by ``/``; SQL engines can redo it."""
    digest = F.md5(F.concat_ws("/", *[p.cast("string") for p in parts]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def shuffle_key(*parts: Column) -> Column:
    """A whole number from 0 to 2^63 - 8 from the MD5 of the parts, joined by ``/``; null parts are the text ``null``."""
    digest = F.md5(F.concat_ws("/", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") * 8


def scalar(df: DataFrame, column: Column):
    """One aggregated value."""
    return df.agg(column).first()[0]
