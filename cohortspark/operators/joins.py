"""Join shapes used by the jobs. Strategy is left to Catalyst and AQE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def first_row(df: DataFrame, keys: list[str], order: list[tuple[str, bool]]) -> DataFrame:
    """First row per key along ``order`` = [(column, nulls_last)].

    Catalyst turns the rank filter into a group limit below the shuffle, so every task sends one row per
    key and a hot key does not meet in one task.
    """
    sort = [F.col(c).asc_nulls_last() if nulls_last else F.col(c).asc_nulls_first() for c, nulls_last in order]
    w = Window.partitionBy(*keys).orderBy(*sort)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def first_row_within(df: DataFrame, key: str, part: str, order: list[tuple[str, bool]]) -> DataFrame:
    """First row per (``key``, ``part``) along ``order``, where the rows of a key are needed together afterwards.

    Rows are dealt by the key alone and sorted once, so a join or a group on the key needs no further shuffle, and none at all if
    they come dealt by it. A null ``part`` is one of its own.
    """
    sort = [F.col(c).asc_nulls_last() if nulls_last else F.col(c).asc_nulls_first() for c, nulls_last in order]
    w = Window.partitionBy(key).orderBy(F.col(part).asc_nulls_first(), *sort)
    marked = df.withColumns({"_rn": F.row_number().over(w), "_before": F.lag(part).over(w)})
    return marked.filter((F.col("_rn") == 1) | ~F.col("_before").eqNullSafe(F.col(part))).drop("_rn", "_before")


def labelled(features: DataFrame, labels: DataFrame, key: str, label: str = "cluster_label") -> DataFrame:
    """Inner join with the label column only; null keys never match."""
    return features.join(labels.select(key, label), key)


def with_outcomes(labels: DataFrame, outcomes: DataFrame, key: str) -> DataFrame:
    """Keep every labelled row, outcome columns where known."""
    return labels.join(outcomes, key, "left")


def left_one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join that fails when a key repeats on either side.

    Duplicates are found by a counting aggregate (combined map-side) instead of a window over the key.
    """
    for side, df in (("left", left), ("right", right)):
        found = df.groupBy(key).count().filter((F.col("count") > 1) & F.col(key).isNotNull()).limit(10).collect()
        if found:
            raise ValueError(f"{key} is not unique on the {side} side, e.g. {[r[0] for r in found]}")
    return left.join(right, key, "left")


def merge_tables(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full outer join on a shared key name."""
    return left.join(right, key, "full_outer")


def members(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).filter(F.col(key).isNotNull()), key, "left_semi")


def pending(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key has not been processed yet."""
    return df.join(done.select(key), key, "left_anti")


def set_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, with the side they were found on."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    only_left = a.join(b, key, "left_anti").withColumn("found_in", F.lit("left_only"))
    only_right = b.join(a, key, "left_anti").withColumn("found_in", F.lit("right_only"))
    return only_left.unionByName(only_right)


def children_of(children: DataFrame, key: str, order: list[str], fields: dict[str, Column], name: str) -> DataFrame:
    """One array of structs (``order``, then ``fields``) per parent from its ordered children.

    The children must already be one row per entry: the list is the content of the result.
    """
    entry = F.struct(*[F.col(c) for c in order], *[c.alias(k) for k, c in fields.items()])
    return children.groupBy(key).agg(F.sort_array(F.collect_list(entry)).alias(name))
