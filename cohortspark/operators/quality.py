"""Validation tables, embedding checks and the leakage audit."""

from __future__ import annotations

import uuid
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortspark.operators.ordered import exact_quantiles, global_row_number
from cohortspark.runtime import cut, ensure_checkpoint_dir

# Outcome names that must not show up in produced text.
OUTCOME_TERMS = [
    "mortality", "death_date", "discharge_status", "length_of_stay", "follow_up", "time_to_event",
    "cluster_label", "inhospital_mortality", "mortality_30d", "days_to_death",
]

EXAMPLES = 10
#: Distinct values that stand in a list of the manifest; more become a table.
MOST_LISTED = 1000


def _report(found: DataFrame) -> DataFrame:
    """rule, n and the smallest example ids (at most ten rows per rule are ever gathered) of (rule, id, rows)."""
    counts = found.groupBy("rule").agg(F.sum("rows").alias("n"))
    first = Window.partitionBy("rule").orderBy(F.col("id").asc_nulls_last())
    few = (found.withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") <= EXAMPLES)
           .withColumn("id", F.explode(F.when(F.col("rule") == "duplicate_key", F.array("id"))
                                       .otherwise(F.array_repeat("id", F.least(F.col("rows"), F.lit(EXAMPLES)).cast("int")))))
           .withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") <= EXAMPLES)
           .groupBy("rule").agg(F.sort_array(F.collect_list("id")).alias("examples")))
    return counts.join(few, "rule").select("rule", "n", F.array_join("examples", "|").alias("examples"))


def validate_documents(df: DataFrame, key: str, text: str, strict: bool = False) -> DataFrame:
    """Missing keys, repeated keys, missing and empty texts: one row per broken rule."""
    rules = F.array(F.when(F.col(key).isNull(), "missing_key"), F.when(F.col(text).isNull(), "missing_text"),
                    F.when(F.length(text) == 0, "empty_text"), F.when(F.col(key).isNotNull(), ""))
    # one pass: a row per broken rule, and a nameless one per key; both are summed before the shuffle
    per_key = (df.select(F.col(key).cast("string").alias("id"), F.explode(F.array_compact(rules)).alias("rule"))
               .groupBy("id", "rule").agg(F.count("*").alias("rows")))
    named = F.when(F.col("rule") != "", F.col("rule")).when(F.col("rows") > 1, "duplicate_key")
    report = _report(cut(per_key.withColumn("rule", named).filter(F.col("rule").isNotNull())))
    if strict:
        broken = report.collect()  # at most four rows
        if broken:
            raise ValueError("; ".join(f"{r['rule']}: {r['n']} rows, e.g. {r['examples']}" for r in broken))
    return report


def unique_key_report(df: DataFrame, key: str) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.count(key).alias("n_keys"),
                  F.count_distinct(key).alias("n_distinct_keys"))


def embedding_checks(metadata: DataFrame, vectors: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """check, value rows: row counts, duplicate keys and coverage in both directions."""
    def one(df, name, expr):
        return df.agg(expr.cast("long").alias("value")).select(F.lit(name).alias("check"), "value")

    counted = metadata.groupBy(key).agg(F.count("*").alias("_n"))
    rows = [
        one(metadata, "metadata_rows", F.count("*")),
        one(vectors, "vector_rows", F.count("*")),
        one(counted, "duplicate_keys", F.coalesce(F.sum(F.col("_n") - 1), F.lit(0))),
        one(sources.select(key).distinct().join(metadata.select(key), key, "left_anti"),
            "missing_in_metadata", F.count("*")),
        one(metadata.select(key).distinct().join(sources.select(key), key, "left_anti"),
            "extra_in_metadata", F.count("*")),
    ]
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out


def _lowered(data: bytes) -> bytes:
    """UTF-8 lower-cased as far as an ASCII term can tell: A-Z, and the two other characters whose lower case has an ASCII letter."""
    return data.lower().replace("\u212a".encode(), b"k").replace("\u0130".encode(), "i\u0307".encode())


def rows_with(texts: pa.Array, terms: list[str]) -> list[np.ndarray]:
    """For each ASCII term the rows whose lower-cased text holds it.

    The texts of a batch lie behind each other and are searched in one go; a term that holds another one is looked for only in
    the rows that have the other.
    """
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = memoryview(texts.buffers()[2] or b"")[at[0]:at[-1]].tobytes()
    low = _lowered(data)
    if len(low) != len(data):  # some letter changed its length: lengths are taken again
        pieces = [_lowered(data[a:b]) for a, b in zip(at[:-1] - at[0], at[1:] - at[0])]
        low, at = b"".join(pieces), np.r_[0, np.cumsum([len(p) for p in pieces])]
    at = at - at[0]
    ends, found = at[1:].tolist(), {}
    for term in sorted(terms, key=len):
        needle, rows = term.encode(), []
        inner = next((found[t] for t in found if t in term), None)
        if inner is not None:
            rows = [r for r in inner.tolist() if low.find(needle, at[r], at[r + 1]) >= 0]
        elif not term:
            rows = list(range(len(ends)))
        else:
            place = low.find(needle)
            while place >= 0:
                row = bisect_right(ends, place)
                if place + len(needle) <= ends[row]:
                    rows.append(row)
                    place = low.find(needle, ends[row])
                else:  # reaches into the next text
                    place = low.find(needle, place + 1)
        found[term] = np.array(rows, dtype=np.int64)
    return [found[t] for t in terms]


def _terms_found(column: Column, terms: list[str]) -> Column:
    """The rules ("term:...") a text breaks, null for a null text."""

    @F.arrow_udf("array<string>")
    def found(texts: pa.Array) -> pa.Array:
        real = np.asarray(pc.is_valid(texts))
        rows = [r[real[r]] for r in rows_with(texts, terms)]
        row, which = np.concatenate(rows), np.repeat(np.arange(len(terms)), [len(r) for r in rows])
        order = np.lexsort((which, row))
        offsets = np.r_[0, np.cumsum(np.bincount(row, minlength=len(texts)))].astype(np.int32)
        names = pa.array([f"term:{t}" for t in terms]).take(pa.array(which[order]))
        return pa.ListArray.from_arrays(pa.array(offsets), names)

    return found(column)


def leakage_audit(df: DataFrame, text: str, own_id: str, key: str, terms: list[str] | None = None) -> DataFrame:
    """Texts that mention an outcome term or their own patient id; one row per broken rule."""
    terms = terms or OUTCOME_TERMS
    plain, other = [t for t in terms if t.isascii()], [t for t in terms if not t.isascii()]
    own = F.when(F.col(text).contains(F.col(own_id)), F.lit("own_id"))
    df = df.withColumn("_own", own)
    found = [F.array("_own")]
    if plain:
        df = df.withColumn("_terms", _terms_found(F.col(text), plain))
        found.append(F.coalesce("_terms", F.array().cast("array<string>")))
    if other:
        df = df.withColumn("_body", F.lower(F.col(text)))
        found.append(F.array(*[F.when(F.col("_body").contains(t), F.lit(f"term:{t}")) for t in other]))
    hits = df.select(key, F.explode(F.concat(*found)).alias("rule")).filter(F.col("rule").isNotNull())
    return hits.groupBy("rule").agg(F.count("*").alias("n"), F.min(key).alias("first_id"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """(position, value): all distinct values that are not null in their order as text, numbered from 0."""
    values = df.select(F.col(column).cast("string").alias("value")).filter(F.col("value").isNotNull()).distinct()
    return global_row_number(values, ["value"], "position", 0).select("position", "value")


def text_length_manifest(df: DataFrame, text: str, distinct: list[str], values_folder: str | None = None) -> DataFrame:
    """One row: n, mean/median/p95 text length and the sorted distinct values of listed columns.

    Quantiles come from counts per length, so the table of texts is reduced before any sort. A column with more than MOST_LISTED values has
    null for its list; its values are a table (position, value), one row each, whose path stands in ``{column}_values_table``. It is
    written below ``values_folder``, by default the checkpoint folder.
    """
    # one pass over the texts; everything else works on the counts
    columns = [F.col(c).cast("string").alias(c) for c in distinct]
    counts = cut(df.select(F.length(F.col(text)).alias("_len"), *columns).groupBy("_len", *distinct)
                 .agg(F.count("*").alias("_n")))
    sizes = counts.agg(*[F.approx_count_distinct(c).alias(c) for c in distinct]).first() if distinct else {}
    listed = []
    tables = {}
    for c in distinct:
        few = counts.select(c).filter(F.col(c).isNotNull()).distinct().limit(MOST_LISTED + 1).count() if sizes[c] <= 2 * MOST_LISTED else MOST_LISTED + 1
        if few <= MOST_LISTED:
            listed.append(c)
        else:
            tables[c] = f"{values_folder or ensure_checkpoint_dir(df.sparkSession)}/{c}-values-{uuid.uuid4().hex}"
            distinct_values(counts, c).write.parquet(tables[c])
    stats = counts.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_docs"),
        F.try_divide(F.sum(F.col("_len") * F.col("_n")), F.sum(F.when(F.col("_len").isNotNull(), F.col("_n"))))
        .alias("text_char_len_mean"),
        *[(F.array_sort(F.collect_set(c)) if c in listed else F.lit(None).cast("array<string>")).alias(f"{c}_values") for c in distinct])
    quantiles = exact_quantiles(counts, [], "_len", {"text_char_len_median": 0.5, "text_char_len_p95": 0.95}, weight="_n")
    found = quantiles.first()
    stats = stats.withColumns({f"{c}_values_table": F.lit(path) for c, path in tables.items()})
    return stats.withColumns({c: F.lit(found[c]).cast("double") for c in quantiles.columns})
