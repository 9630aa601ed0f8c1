"""Order-dependent operators that never sort one whole group in one task.

Running sums, row numbers and quantiles are computed in two levels: inside buckets of the order
column, plus the totals of the earlier buckets. Small inputs take the same way with one bucket.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortspark.runtime import cut

WINDOW_ROWS = 200_000
#: Hash buckets of a group: at least 2 to this, more where a bucket would hold over BUCKET_ROWS rows.
HASH_BUCKET_BITS = 10
BUCKET_ROWS = 1 << 16
ROW_BITS = 33


@dataclass(frozen=True)
class Buckets:
    """Upper bounds of the order buckets; without any there is one bucket."""

    bounds: tuple[float, ...] = ()


def plan_buckets(df: DataFrame, order: str, window_rows: int = WINDOW_ROWS) -> Buckets:
    """Count ``df`` and pick bucket bounds holding about ``window_rows`` rows each."""
    n = df.count()
    n_buckets = -(-n // window_rows) if n else 1
    if n_buckets <= 1:
        return Buckets()
    n_buckets = min(n_buckets * 2, 4096)
    cuts = [i / n_buckets for i in range(1, n_buckets)]
    found = df.agg(F.percentile_approx(F.col(order).cast("double"), cuts, 50_000)).first()[0] or []
    return Buckets(tuple(sorted(set(found))))


def _bucket_of(order: str, buckets: Buckets) -> Column:
    bounds = F.array(*[F.lit(float(b)) for b in buckets.bounds]).cast("array<double>")
    return F.size(F.filter(bounds, lambda b: b < F.col(order).cast("double")))


def running(df: DataFrame, group: list[str], order: str, sums: dict[str, Column | str], buckets: Buckets,
            descending: bool = False, inclusive: bool = True) -> DataFrame:
    """Add running sums along ``order`` inside ``group``; (group, order) must be unique.

    ``sums`` maps new column names to the summed column or expression.
    """
    def sort(name):
        return F.col(name).desc() if descending else F.col(name).asc()

    end = 0 if inclusive else -1
    sums = {k: F.expr(v) if isinstance(v, str) else v for k, v in sums.items()}
    bucketed = df.withColumn("_bucket", _bucket_of(order, buckets))
    inside = (Window.partitionBy(*group, "_bucket").orderBy(sort(order))
              .rowsBetween(Window.unboundedPreceding, end))
    earlier = (Window.partitionBy(*group).orderBy(sort("_bucket"))
               .rowsBetween(Window.unboundedPreceding, -1))
    totals = bucketed.groupBy(*group, "_bucket").agg(*[F.sum(c).alias(f"_t_{k}") for k, c in sums.items()])
    offsets = totals.select(*group, "_bucket", *[
        F.coalesce(F.sum(f"_t_{k}").over(earlier), F.lit(0)).alias(f"_o_{k}") for k in sums])
    local = bucketed.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(k) for k, c in sums.items()])
    joined = local.alias("l").join(
        offsets.alias("o"),
        on=[F.col(f"l.{c}").eqNullSafe(F.col(f"o.{c}")) for c in [*group, "_bucket"]])
    return joined.select(*[F.col(f"l.{c}").alias(c) for c in df.columns],
                         *[(F.col(f"l.{k}") + F.col(f"o._o_{k}")).alias(k) for k in sums])


def global_row_number(df: DataFrame, order: list, name: str = "row_number", start: int = 1) -> DataFrame:
    """Exact row number along a total order, without a single-partition window.

    A range sort puts the rows in order over the partitions; the position inside each partition comes
    from the row id, and the sizes of the earlier partitions (one row per partition) are added.
    """
    placed = cut(df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", ROW_BITS)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    # one row per partition of the sort: bounded by the number of partitions
    numbered = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    position = F.col("_place").bitwiseAND((1 << ROW_BITS) - 1)
    return numbered.select(*df.columns, (F.col("_before") + position + start).alias(name))


def hashed_row_number(df: DataFrame, group: list[str], key: Column, tie: str, name: str = "row_number") -> DataFrame:
    """Row number inside ``group`` along a hash (then ``tie``); hot groups spread over hash buckets."""
    bits = max(HASH_BUCKET_BITS, (df.count() // BUCKET_ROWS).bit_length())
    hashed = df.withColumn("_h", key).withColumn("_bucket", F.shiftright("_h", 64 - bits))
    sizes = hashed.groupBy(*group, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("_bucket").alias("_b"),
                           F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*group, "_bucket").orderBy("_h", tie)
    ranked = hashed.withColumn("_rn", F.row_number().over(inside))
    on = [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group] + [F.col("_bucket") == F.col("_b")]
    return ranked.join(offsets, on).select(*df.columns, (F.col("_before") + F.col("_rn")).alias(name))


def least_hashed(df: DataFrame, key: Column, tie: str, rows: int, n: int) -> DataFrame:
    """The first ``rows`` of ``n`` rows in the order of the hash ``key``, then ``tie``.

    Only rows below a bound of the hash, some more than wanted, are sorted; otherwise every task would send as many to the driver.
    """
    wanted = rows + 8 * int(rows ** 0.5) + 8
    if wanted < n:
        bound = (wanted * (1 << 64)) // n - (1 << 63)
        below = df.filter(key < F.lit(bound))
        # hashes of repeated keys may lie unevenly
        if below.count() >= rows:
            df = below
    return df.orderBy(key, tie).limit(rows)


def exact_quantiles(df: DataFrame, group: list[str], value: str, probs: dict[str, float],
                    window_rows: int = WINDOW_ROWS, weight: str | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group; ``weight`` counts a row several times.

    Works on distinct values with counts, so neither the memory of one aggregate nor one sorted
    partition has to hold a group. Null and NaN are ignored.
    """
    kept = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    counts = cut(kept.groupBy(*group, F.col(value).cast("double").alias("_v"))
                 .agg((F.sum(weight) if weight else F.count("*")).alias("_c")))
    buckets = plan_buckets(counts, "_v", window_rows)
    cumulated = running(counts, group, "_v", {"_upto": "_c"}, buckets)
    if group:
        totals = counts.groupBy(*[F.col(g).alias(f"_g_{g}") for g in group]).agg(F.sum("_c").alias("_n"))
        joined = cumulated.join(totals, [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group])
    else:
        joined = cumulated.withColumn("_n", F.lit(counts.agg(F.sum("_c")).first()[0]).cast("long"))
    out = []
    for name, p in probs.items():
        spot = F.lit(float(p)) * (F.max("_n") - 1)
        # positions are taken per row so that both neighbours come out of one aggregate
        at = F.lit(float(p)) * (F.col("_n") - 1)
        low = F.min(F.when(F.col("_upto") > F.floor(at), F.col("_v")))
        high = F.min(F.when(F.col("_upto") > F.ceil(at), F.col("_v")))
        out.append((low + (high - low) * (spot - F.floor(spot))).alias(name))
    return joined.groupBy(*group).agg(*out)
