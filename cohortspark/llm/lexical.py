"""Ranked lexical search of a query set over all documents, by buckets of vectors of like length.

A document is the vector of its terms' impacts, a query the vector of its terms' weights, and a score is their product.
Vectors are put in order of length. A bucket holds vectors of nearly one length; it is passed over for a query if the product
of both lengths is below the query's 20th best score so far (Cauchy and Schwarz). Inside a bucket the largest coordinates of
the query are looked up in lists by coordinate: what they give, and at most the product of the remaining lengths, bounds the
score of each vector. Vectors whose bound reaches the 20th best score are scored exactly, in whole numbers.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import IntegralType

from cohortspark.operators.neighbors import dense_ids
from cohortspark.runtime import cut

TOP = 20
#: Texts are turned into terms for so many bytes at a time.
SLICE_BYTES = 8 << 20
#: Queries of one pass over the documents, and terms of all of them; more queries take more passes.
QUERIES, QUERY_TERMS = 1024, 200_000
#: Rows of a bucket, and the least share of its largest length that a vector of it has.
BUCKET_ROWS, ALIKE = 4096, 0.9
#: Longest vectors, scored first for the scores to beat.
FIRST = 4096
#: Coordinates of a query are looked up until the others can give this share of the score to beat.
REST = 0.4
SLACK = 1 + 1e-9

#: Bytes of UTF-8 that belong to a term, A-Z lower-cased; others end one.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Terms of a text in UTF-8: maximal runs of ASCII letters, digits and all other characters above ASCII."""
    return text.translate(_TERM_BYTES).split()


def _texts(column: pa.Array):
    """Texts in UTF-8 (null: empty), a bounded number of bytes at a time."""
    at, held = 0, 0
    binary = column.cast(pa.large_binary())
    sizes = pa.compute.fill_null(pa.compute.binary_length(binary), 0).to_numpy(zero_copy_only=False)
    for end in range(1, len(sizes) + 1):
        held += sizes[end - 1]
        if held > SLICE_BYTES or end == len(sizes):
            yield at, [t or b"" for t in binary.slice(at, end - at).to_pylist()]
            at, held = end, 0


def query_terms(queries: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(iid, item, terms, counts) of the distinct (key, text) with at least one term."""
    def run(batches):
        for batch in batches:
            for at, texts in _texts(batch.column(1)):
                found = [Counter(terms_of(t)) for t in texts]
                yield pa.RecordBatch.from_pydict({"item": batch.column(0).slice(at, len(texts)),
                                                  "terms": pa.array([list(c) for c in found], pa.list_(pa.binary())),
                                                  "counts": pa.array([list(c.values()) for c in found], pa.list_(pa.int64()))})

    rows = queries.filter(F.col(text).isNotNull()).select(F.col(key).alias("item"), F.col(text).alias("text")).distinct()
    kind = rows.schema["item"].dataType.simpleString()
    return cut(rows.mapInArrow(run, f"item {kind}, terms array<binary>, counts array<long>").filter(F.size("terms") > 0)
               .withColumn("iid", F.monotonically_increasing_id()))


@dataclass
class Queries:
    """Queries of one pass: rows are queries, their terms by falling coordinate."""

    iid: list[int]
    terms: list[np.ndarray]
    weights: list[np.ndarray]
    lengths: np.ndarray
    rests: list[np.ndarray]  # length of what follows each prefix
    vocabulary: int

    @classmethod
    def of(cls, rows, index: dict[bytes, int], weight: np.ndarray) -> "Queries":
        iid, terms, weights, rests = [], [], [], []
        for r in rows:
            t = np.array([index[bytes(x)] for x in r["terms"]], np.int64)
            w = weight[t] * np.array(r["counts"], np.int64)
            order = np.argsort(-w, kind="stable")
            order = order[w[order] > 0]
            if len(order):
                iid.append(r["iid"])
                terms.append(t[order])
                weights.append(w[order])
                squares = w[order].astype(float) ** 2
                rests.append(np.sqrt(np.append(np.cumsum(squares[::-1])[::-1], 0.0)))
        return cls(iid, terms, weights, np.array([r[0] for r in rests]), rests, len(index))


def _counted(docs: DataFrame, index, key_kind: str) -> DataFrame:
    """(stat, key, n, total, terms, tfs): documents that hold terms of the queries; one ``stat`` row a task with the number of
    documents, of terms, and the documents per term."""
    def run(batches):
        known = index.value
        places = np.zeros(len(known), np.int64)
        documents = total = 0

        def batch_of(stat, key, n, sums, terms, tfs):
            return pa.RecordBatch.from_arrays([pa.array([stat] * len(n)), key, pa.array(n, pa.int64()), pa.array(sums, pa.int64()),
                                               pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))],
                                              names=["stat", "key", "n", "total", "terms", "tfs"])

        for batch in batches:
            for at, texts in _texts(batch.column(1)):
                rows, sizes, terms, tfs = [], [], [], []
                for row, text in enumerate(texts, at):
                    found = terms_of(text)
                    if not found:
                        continue
                    documents += 1
                    total += len(found)
                    counts = Counter(found)
                    hits = [(known[t], n) for t, n in counts.items() if t in known]
                    if hits:
                        rows.append(row)
                        sizes.append(len(found))
                        terms.append([h[0] for h in hits])
                        tfs.append([h[1] for h in hits])
                        places[terms[-1]] += 1
                if rows:
                    yield batch_of(False, batch.column(0).take(pa.array(rows)), sizes, [0] * len(rows), terms, tfs)
        if documents:
            seen = np.flatnonzero(places)
            yield batch_of(True, pa.nulls(1, kind), [documents], [total], [seen.tolist()], [places[seen].tolist()])

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(docs.schema["key"].dataType)
    return docs.mapInArrow(run, f"stat boolean, key {key_kind}, n long, total long, terms array<int>, tfs array<long>")


def _impacts(rows: DataFrame, documents: int, total: int) -> DataFrame:
    """(key, length, terms, impacts) of (key, n, terms, tfs)."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(3)
            sizes = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
            m = 75 + (25 * batch.column(1).to_numpy() * documents) // total
            tf = lists.flatten().to_numpy(zero_copy_only=False)
            impact = (1_000_000_000 * tf) // (1000 * tf + 12 * np.repeat(m, sizes))
            starts = np.cumsum(sizes) - sizes
            length = np.sqrt(np.add.reduceat(impact.astype(float) ** 2, starts))
            offsets = pa.array(np.append(starts, len(tf)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(length), batch.column(2), pa.ListArray.from_arrays(offsets, pa.array(impact))],
                                             names=["key", "length", "terms", "impacts"])

    return rows.select("key", "n", "terms", "tfs").mapInArrow(run, "key long, length double, terms array<int>, impacts array<long>")


class _Best:
    """The best (score, key) of one query, equal scores by key, null keys last."""

    def __init__(self, beat: int, top: int):
        self.score, self.key, self.none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.beat, self.top = beat, top

    def add(self, score: np.ndarray, key: np.ndarray, none: np.ndarray) -> None:
        score, key, none = (np.concatenate([a, b]) for a, b in ((self.score, score), (self.key, key), (self.none, none)))
        order = np.lexsort((key, none, -score))[:self.top]
        self.score, self.key, self.none = score[order], key[order], none[order]
        if len(order) == self.top:
            self.beat = max(self.beat, int(self.score[-1]))


class Bucket:
    """Vectors of like length, the longest first, with a list of rows and impacts for each coordinate."""

    def __init__(self, length: np.ndarray, terms: np.ndarray, impacts: np.ndarray, sizes: np.ndarray, vocabulary: int):
        self.length, self.terms, self.impacts = length, terms, impacts
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        rows = np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(terms, kind="stable")
        self.rows, self.values = rows[order], impacts[order]
        self.lists = np.searchsorted(terms[order], np.arange(vocabulary + 1))

    def reach(self, terms: np.ndarray, weights: np.ndarray, rests: np.ndarray, beat: int) -> np.ndarray:
        """Rows whose score may be ``beat`` or more."""
        look = max(1, int(np.searchsorted(-rests, -REST * beat / self.length[0])))
        look = min(look, len(terms))
        given, squares = np.zeros(len(self.length)), np.zeros(len(self.length))
        for t, w in zip(terms[:look].tolist(), weights[:look].tolist()):
            at = slice(self.lists[t], self.lists[t + 1])
            rows, v = self.rows[at], self.values[at].astype(float)
            given[rows] += w * v
            squares[rows] += v * v
        bound = given + rests[look] * np.sqrt(np.maximum(self.length * self.length * SLACK - squares, 0))
        return np.flatnonzero(bound * SLACK >= max(beat, 1))

    def exact(self, rows: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Scores of some rows against a query with the coordinates ``dense``."""
        sizes = self.ends[rows] - self.starts[rows]
        at = np.repeat(self.starts[rows] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        return np.add.reduceat(dense[self.terms[at]] * self.impacts[at], np.cumsum(sizes) - sizes)


def _search(vectors: DataFrame, queries, beat, top: int) -> DataFrame:
    """(iid, score, key): the best of each task's vectors (key, length, terms, impacts) that are in order of length."""
    def run(batches):
        q = queries.value
        best = [_Best(int(b), top) for b in beat.value]
        dense = np.zeros(q.vocabulary, np.int64)
        for batch in batches:
            length = batch.column(1).to_numpy()
            sizes = pa.compute.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
            terms = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            impacts = batch.column(3).flatten().to_numpy(zero_copy_only=False)
            none = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            keys = pa.compute.fill_null(batch.column(0), 0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            at = 0
            while at < len(length):
                end = min(at + BUCKET_ROWS, at + max(1, int(np.searchsorted(-length[at:], -ALIKE * length[at], side="right"))))
                scores_to_beat = np.array([b.beat for b in best], float)
                alive = np.flatnonzero(q.lengths * length[at] * SLACK >= np.maximum(scores_to_beat, 1))
                if len(alive):
                    part = slice(ends[at] - sizes[at], ends[end - 1])
                    bucket = Bucket(length[at:end], terms[part], impacts[part], sizes[at:end], q.vocabulary)
                    for i in alive.tolist():
                        b = best[i]
                        rows = bucket.reach(q.terms[i], q.weights[i], q.rests[i], b.beat)
                        if not len(rows):
                            continue
                        dense[q.terms[i]] = q.weights[i]
                        score = bucket.exact(rows, dense)
                        dense[q.terms[i]] = 0
                        good = score >= max(b.beat, 1)
                        if good.any():
                            rows = rows[good] + at
                            b.add(score[good], keys[rows], none[rows])
                at = end
        for iid, b in zip(q.iid, best):
            if len(b.score):
                yield pa.RecordBatch.from_arrays([pa.array([iid] * len(b.score), pa.int64()), pa.array(b.score), pa.array(b.key, mask=b.none)],
                                                 names=["iid", "score", "key"])

    return vectors.select("key", "length", "terms", "impacts").mapInArrow(run, "iid long, score long, key long")


def _best_of(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("iid").orderBy(F.desc("score"), F.asc_nulls_last("key"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def ranked(documents: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
           item_text: str = "text", top: int = TOP) -> DataFrame:
    """(item, rank, key, score): the ``top`` documents with the highest scores above 0 for each query; equal scores by key.

    All rows of ``documents`` are searched, repeated ones as documents of their own; a null text has no terms, a null key
    comes last among equal scores, keys that are not whole numbers go by their order. Queries without terms, or
    with none that a document has, give no rows. Equal rows of ``queries`` count once; several texts of one item are ranked each for
    itself. Other columns are ignored.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    key_type = docs.schema["key"].dataType
    items = query_terms(queries, item, item_text)
    size = items.agg(F.count("*").alias("n"), F.sum(F.size("terms")).alias("terms")).first()
    passes = max(-(-size["n"] // QUERIES), -(-(size["terms"] or 0) // QUERY_TERMS))
    names = cut(dense_ids(docs.select(F.col("key").alias("id")))) if not isinstance(key_type, IntegralType) and passes else None
    found = None
    for n in range(passes):
        rows = items.filter(F.pmod(F.xxhash64("iid"), F.lit(passes)) == n).select("iid", "terms", "counts").collect()  # about QUERIES
        index = {t: i for i, t in enumerate(sorted({bytes(t) for r in rows for t in r["terms"]}))}
        if not index:
            continue
        counted = cut(_counted(docs, spark.sparkContext.broadcast(index), key_type.simpleString()))
        stats = counted.filter("stat")
        whole = stats.agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
        if not whole["n"]:
            continue
        weight = np.full(len(index), 0, np.int64)
        places = stats.select(F.explode(F.arrays_zip("terms", "tfs")).alias("p")).groupBy("p.terms").agg(F.sum("p.tfs").alias("n"))
        df = {r["terms"]: r["n"] for r in places.collect()}  # terms of this pass's queries
        for i in range(len(index)):
            weight[i] = math.floor(1000 * math.log((2 * whole["n"] + 2) / (2 * df.get(i, 0) + 1)))
        q = Queries.of(rows, index, weight)
        if not q.iid:
            continue
        vectors = counted.filter("NOT stat")
        if names is None:
            vectors = vectors.withColumn("key", F.col("key").cast("long"))
        else:
            vectors = (vectors.join(names, F.col("key") == F.col("id"), "left").drop("key", "id").withColumnRenamed("ix", "key"))
        longest = F.desc("length")
        vectors = cut(_impacts(vectors, whole["n"], whole["total"]).repartitionByRange(longest, F.xxhash64("key")).sortWithinPartitions(longest))
        shared = spark.sparkContext.broadcast(q)
        zero = spark.sparkContext.broadcast(np.zeros(len(q.iid), np.int64))
        found_rows = vectors.agg(F.count("*").alias("n"), F.percentile_approx("length", [max(0.0, 1 - FIRST / max(1, whole["n"]))], 10_000).alias("least")).first()
        # only the tasks that hold some of the longest send any, not each its own longest
        longer = vectors.filter(F.col("length") >= found_rows["least"][0]) if found_rows["n"] > FIRST else vectors
        first = _best_of(_search(longer.orderBy(longest).limit(FIRST), shared, zero, top), top)
        to_beat = {r["iid"]: r["score"] for r in first.filter(F.col("rank") == top).select("iid", "score").collect()}  # one row a query
        beat = spark.sparkContext.broadcast(np.array([to_beat.get(i, 0) for i in q.iid], np.int64))
        one = _best_of(_search(vectors, shared, beat, top), top)
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = spark.createDataFrame([], "iid long, score long, key long, rank int")
    found = found.join(items.select("iid", "item"), "iid")
    if names is not None:
        found = found.join(names, F.col("key") == F.col("ix"), "left").drop("key").withColumnRenamed("id", "key")
    return found.select(F.col("item").alias(item), "rank", F.col("key").cast(key_type).alias(key), "score")


def ranked_sql(documents: str = "documents", queries: str = "benchmark", top: int = TOP) -> str:
    """What :func:`ranked` returns, in DuckDB SQL that scores all pairs."""
    terms = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS row, doc_id, {terms} AS words FROM {documents} WHERE text IS NOT NULL),
    n AS (SELECT row, doc_id, CAST(len(words) AS BIGINT) AS n FROM d WHERE len(words) > 0),
    whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM n),
    tf AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(words) AS term FROM d) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
    q AS (SELECT item_id, term, count(*) AS c FROM (SELECT item_id, unnest({terms}) AS term FROM (SELECT DISTINCT item_id, text FROM {queries})) GROUP BY ALL),
    w AS (SELECT item_id, term, c * CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
          FROM q JOIN df USING (term), whole),
    s AS (SELECT item_id, row, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total)))) AS BIGINT) AS score
          FROM w JOIN tf USING (term) JOIN n USING (row), whole GROUP BY ALL),
    r AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank
          FROM s JOIN n USING (row) WHERE score > 0)
    SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM r WHERE rank <= {top}"""
