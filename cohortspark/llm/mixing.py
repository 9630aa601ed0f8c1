"""Sources mixed to target weights by weighted fair queueing.

The documents of a source stand in the order of a hash, three passes behind one another. A document's virtual finish
time is the number of words of its source up to its end, divided by the source's weight. All documents are served in
the order of their finish times until the budget is used up, so at each moment every source has been served in
proportion to its weight, and a source that has run out of passes leaves its share to the others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortspark.llm.common import shuffle_key
from cohortspark.operators.ordered import global_row_number
from cohortspark.runtime import cut

#: Weights of the sources in the order of their names, repeated.
WEIGHTS = (5.0, 2.0, 1.0)
PASSES = 3
#: Rows of the sorted queue that one of its parts is meant to hold, and most parts.
PART_ROWS, MOST_PARTS = 8192, 20_000
#: Hash buckets of a source: at least so many, more if a bucket would hold over BUCKET_ROWS rows.
LEAST_BITS, BUCKET_ROWS = 10, 1 << 16


def words(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, budget: float, weights: tuple[float, ...] = WEIGHTS, passes: int = PASSES) -> DataFrame:
    """(source, source_size, weight, rank, target) for (source, source_size): sources by code point, null last, take
    the weights in turn; what a target has above ``passes`` times its source goes to the others by weight, until none
    is above. One aggregate of the source table per round."""
    ranked = global_row_number(sizes, [F.col("source").asc_nulls_last()], "rank", 0)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    table = cut(ranked.withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int"))))
    limit = F.col("source_size") * float(passes)
    share, full = 0.0, -1
    while True:
        over = limit <= share * F.col("weight")
        found = table.agg(F.sum(F.when(over, limit).otherwise(0.0)).alias("used"), F.count(F.when(over, 1)).alias("full"),
                          F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("weight")).first()
        if found["full"] == full or not found["weight"]:
            break
        full, share = found["full"], (budget - found["used"]) / found["weight"]
    return table.withColumn("target", F.least(limit, F.lit(share) * F.col("weight")))


@dataclass(frozen=True)
class Cut:
    """The last served place of the queue; None: all is served."""

    finish: float | None
    rank: int | None


def _queue_order(docs: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """Add ``upto``, the words of the source up to the end of the document, in hash order; a source's running sums are
    made inside hash buckets and joined by the sums of the earlier buckets."""
    largest = sources.agg(F.max("_rows")).first()[0] or 0
    bits = max(LEAST_BITS, (largest // BUCKET_ROWS).bit_length())
    placed = docs.withColumn("_bucket", F.call_function("shiftrightunsigned", F.col("_hash"), F.lit(64 - bits)))
    sums = placed.groupBy("rank", "_bucket").agg(F.sum("size").alias("_sum"))
    earlier = Window.partitionBy("rank").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("rank", "_bucket", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("rank", "_bucket").orderBy("_hash", key, "size").rowsBetween(Window.unboundedPreceding, 0)
    return (placed.withColumn("_inside", F.sum("size").over(inside)).join(before, ["rank", "_bucket"])
            .withColumn("upto", F.col("_before") + F.col("_inside")).drop("_bucket", "_inside", "_before"))


def _finish(n: int | Column) -> Column:
    return (F.col("source_size") * n + F.col("upto")) / F.col("weight")


def _cut_off(queue: DataFrame, budget: int, passes: int) -> Cut:
    """Where the budget ends: a range sort into parts, the part in which the sums pass the budget, then its rows."""
    entries = (queue.filter("size > 0").select("size", "rank", "source_size", "upto", "weight",
                                               F.explode(F.sequence(F.lit(0), F.lit(passes - 1))).alias("_n"))
               .select(_finish(F.col("_n")).alias("finish"), "rank", "size"))
    n = queue.count() * passes
    least = int(queue.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = min(MOST_PARTS, max(least, n // PART_ROWS + 1))
    ranged = cut(entries.repartitionByRange(parts, "finish", "rank").withColumn("_part", F.spark_partition_id()))
    served = 0
    # one row per part
    for row in sorted(ranged.groupBy("_part").agg(F.sum("size").alias("_sum")).collect()):
        if served + row["_sum"] > budget:
            upto = F.sum("size").over(Window.orderBy("finish", "rank").rowsBetween(Window.unboundedPreceding, 0))
            here = ranged.filter(F.col("_part") == row["_part"])
            last = (here.select("finish", "rank", (upto + served).alias("_served")).filter(F.col("_served") <= budget)
                    .agg(F.max(F.struct("finish", "rank")).alias("last")).first()["last"])
            if last is None:  # the part's first row is too large: the cut lies at the end of the part before
                last = (ranged.filter(F.col("_part") < row["_part"]).agg(F.max(F.struct("finish", "rank")).alias("last"))
                        .first()["last"])
            return Cut(-1.0, -1) if last is None else Cut(last["finish"], last["rank"])
        served += row["_sum"]
    return Cut(None, None)


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
        weights: tuple[float, ...] = WEIGHTS, passes: int = PASSES, budget_share: float = 1.0,
        carry: str | None = None) -> DataFrame:
    """(key, size, source_size, target, taken, copies), one row per row of ``df``.

    ``size`` is the number of words, ``taken`` = ``copies`` x ``size`` the words served within the budget, the share
    ``budget_share`` of all words. Documents without words are never taken. Repeated rows are documents of their own;
    null sources form one source, the last. Order and result depend on keys, sizes and sources alone. Only numbers,
    keys and source names are shuffled; other columns but ``carry`` are ignored, whatever their names.
    """
    also = [] if carry is None else [F.col(carry).alias("carried")]
    docs = cut(df.select(*also, F.col(key).alias("key"), F.col(source).alias("source"), words(F.col(text)).alias("size"),
                         shuffle_key(F.col(key), F.lit("mix")).alias("_hash")))
    sizes = cut(docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows")))
    total = int(sizes.agg(F.sum("source_size")).first()[0] or 0)
    budget = int(total * budget_share)
    plan = cut(targets(sizes, float(budget), weights, passes))
    of = plan.withColumnRenamed("source", "_source")
    queue = cut(_queue_order(docs.join(of, F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "_rows"), plan, "key"))
    end = _cut_off(queue, budget, passes)
    copies = F.lit(0)
    for n in range(passes):
        inside = F.lit(True) if end.finish is None else F.struct(_finish(n).alias("f"), F.col("rank").alias("r")) <= F.struct(
            F.lit(end.finish).alias("f"), F.lit(end.rank).cast("long").alias("r"))
        copies = copies + F.when(inside & (F.col("size") > 0), 1).otherwise(0)
    return (queue.withColumn("copies", copies.cast("int"))
            .select(*([] if carry is None else [F.col("carried").alias(carry)]), F.col("key").alias(key), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"),
                    "copies"))


def mixed(df: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The rows of ``df`` as often as the mixture takes them; rows it does not take are left out.

    Repeated rows are rows of their own. A null or empty text has size 0 and is not taken; a null source is one more source, the last.
    An empty table stays empty. Columns are carried along, whatever their names.
    """
    rows = cut(df.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(df.columns)],
                         F.monotonically_increasing_id().alias("row")))
    named = rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns)], F.col("row").alias("_mix_row"))
    taken = mix(named, key, carry="_mix_row", **options).filter("copies > 0").select(F.col("_mix_row").alias("row"), "copies")
    # the plan of a large table at every size: what is taken grows with the rows
    often = rows.join(taken.hint("merge"), "row").withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return often.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns)])


def mix_sql(weights: tuple[float, ...] = WEIGHTS, passes: int = PASSES) -> str:
    """:func:`mix` over the table ``documents``: targets by filling up the sources in the order of size / weight."""
    cycle = ", ".join(f"{float(w)}::DOUBLE" for w in weights)
    return f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || '/mix'), 1, 15))::BIGINT * 8 AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank, {float(passes)} * source_size AS most FROM s),
w AS (SELECT *, [{cycle}][rank % {len(weights)} + 1] AS weight, sum(source_size) OVER ()::BIGINT AS budget FROM r),
f AS (SELECT *, row_number() OVER (ORDER BY most / weight, rank) AS k, most / weight AS ratio FROM w),
c AS (SELECT *, coalesce(sum(most) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
    sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM f),
l AS (SELECT (budget - used) / open AS share FROM c WHERE (budget - used) / open < ratio ORDER BY k LIMIT 1),
t AS (SELECT source, rank, source_size, weight, budget, least(most, coalesce((SELECT share FROM l), 1e300) * weight) AS target FROM w),
q AS (SELECT d.doc_id, d.size, t.*, sum(size) OVER (PARTITION BY t.rank ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
n AS (SELECT row_number() OVER () AS row, * FROM q),
e AS (SELECT row, size, rank, budget, (source_size * p + upto) / weight AS finish FROM n, range({passes}) x(p) WHERE size > 0),
o AS (SELECT *, sum(size) OVER (ORDER BY finish, rank ROWS UNBOUNDED PRECEDING) AS served FROM e),
g AS (SELECT row, count(*) AS copies FROM o WHERE served <= budget GROUP BY row)
SELECT doc_id, size, source_size, target::DOUBLE AS target, (size * coalesce(copies, 0))::BIGINT AS taken, coalesce(copies, 0)::INT AS copies
FROM n LEFT JOIN g USING (row)"""
