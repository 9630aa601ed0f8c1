"""Text to vectors, incrementally: skip what is done, embed, give shard positions."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import PipelineModel
from pyspark.ml.feature import IDF, HashingTF, IDFModel, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F, types as T

from cohortspark.functions.vectors import l2_normalize
from cohortspark.operators.joins import pending
from cohortspark.sources.writers import SHARD_SIZE, assign_shards, first_free_shard

Embedder = Callable[[DataFrame, str, str], DataFrame]


class HashedTextEmbedder:
    """Signed feature hashing of words with optional inverse document frequencies, unit length.

    Runs on Spark ML transformers and column expressions, so no row goes through Python. Without a
    fitted model it needs no pass over the corpus and a text always gets the same vector.
    """

    def __init__(self, dims: int = 64, idf: IDFModel | None = None, name: str | None = None):
        self.dims = dims
        self.idf = idf
        self.name = name or f"hashed-words-{dims}{'-idf' if idf else ''}"

    def _counts(self, df: DataFrame, text: str, out: str) -> DataFrame:
        words = RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"[^\p{L}\p{N}]+")
        # twice the dimensions: the upper half of the buckets counts with a minus sign
        counter = HashingTF(inputCol="_words", outputCol=out, numFeatures=2 * self.dims)
        prepared = df.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
        return PipelineModel([words, counter]).transform(prepared).drop("_text", "_words")

    def fit(self, df: DataFrame, text: str, min_doc_freq: int = 0) -> "HashedTextEmbedder":
        counted = self._counts(df, text, "_counts")
        model = IDF(inputCol="_counts", outputCol="_weighted", minDocFreq=min_doc_freq).fit(counted)
        return HashedTextEmbedder(self.dims, model)

    def __call__(self, df: DataFrame, text: str, out: str) -> DataFrame:
        counted = self._counts(df, text, "_counts")
        if self.idf is not None:
            counted = self.idf.transform(counted).drop("_counts").withColumnRenamed("_weighted", "_counts")
        both = vector_to_array("_counts")
        d = self.dims
        signed = F.zip_with(F.slice(both, 1, d), F.slice(both, d + 1, d), lambda x, y: x - y)
        return (counted.withColumn("_signed", signed)
                .withColumn(out, F.transform(l2_normalize(F.col("_signed")), lambda x: x.cast("float")))
                .drop("_counts", "_signed"))


#: Words whose codes a task remembers, and words of a batch that are looked up at a time.
KNOWN_WORDS, SLICE_WORDS = 1 << 18, 1 << 20


def _projected(dims: int, nonzeros: int):
    """Lists of words to the signed sums of their codes. Each different word of a batch is hashed once."""
    known: dict[str, list[int]] = {}

    def codes(word: str) -> list[int]:
        found = known.get(word)
        if found is None:
            if len(known) >= KNOWN_WORDS:
                known.clear()
            found = known[word] = [int.from_bytes(hashlib.md5(f"{word}/{i}".encode()).digest()[:4], "big") % (2 * dims) for i in range(nonzeros)]
        return found

    def sums(words: pa.Array) -> np.ndarray:
        n, wide = len(words), 2 * dims
        distinct = pc.dictionary_encode(words.flatten())
        names, at = distinct.dictionary.to_pylist(), distinct.indices.to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(n), pc.list_value_length(words).to_numpy(zero_copy_only=False))
        if "" in names:
            real = at != names.index("")
            at, row = at[real], row[real]
        table = np.array([codes(w) for w in names], dtype=np.int64).reshape(-1, nonzeros)
        counts = np.zeros(n * wide)
        for i in range(nonzeros):
            counts += np.bincount(row * wide + table[at, i], minlength=n * wide)
        counts = counts.reshape(n, wide)
        return counts[:, :dims] - counts[:, dims:]

    def run(words: pa.Array) -> pa.Array:
        size = np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False))
        out, at = [np.zeros((0, dims))], 0
        while at < len(words):
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE_WORDS, "right")))
            out.append(sums(words.slice(at, end - at)))
            at = end
        return pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1, dtype=np.int32) * dims), pa.array(np.concatenate(out).ravel()))

    return run


class ProjectedTextEmbedder:
    """Signed random projection of word counts to ``dims`` dimensions, unit length.

    The projection matrix has a row for every possible word, with ``nonzeros`` entries of +1 or -1 whose places and signs come
    from the MD5 of the word and the number of the entry, so nothing is fitted or stored and other engines can redo it.
    An entry is a code below 2 * dims (the upper half counts with a minus sign); codes are counted inside the row, without a shuffle. Words are
    runs of letters and digits in lower case; a text without any is the zero vector. Texts are cut into words by Spark; the words of a batch go
    through Arrow, where each different one is hashed once.
    """

    def __init__(self, dims: int = 64, nonzeros: int = 4, name: str | None = None):
        self.dims, self.nonzeros = dims, nonzeros
        self.name = name or f"projected-words-{dims}"

    def __call__(self, df: DataFrame, text: str, out: str) -> DataFrame:
        words = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+")
        project = F.arrow_udf(_projected(self.dims, self.nonzeros), T.ArrayType(T.DoubleType()))
        return (df.withColumn("_signed", project(words))
                .withColumn(out, F.transform(l2_normalize(F.col("_signed")), lambda x: x.cast("float"))).drop("_signed"))


def function_embedder(encode: Callable[[list[str]], list], name: str, batch_size: int = 64) -> Embedder:
    """Plug-in point: ``encode`` turns a list of texts into vectors, one Arrow batch at a time."""

    def run(df: DataFrame, text: str, out: str) -> DataFrame:
        def encode_batches(batches):
            for pdf in batches:
                vectors = []
                values = pdf[text].fillna("").tolist()
                for at in range(0, len(values), batch_size):
                    vectors.extend(encode(values[at:at + batch_size]))
                yield pdf.assign(**{out: [[float(x) for x in v] for v in vectors]})

        vector = T.StructField(out, T.ArrayType(T.FloatType()))
        return df.mapInPandas(encode_batches, T.StructType(df.schema.fields + [vector]))

    run.name = name
    return run


def run(docs: DataFrame, key: str, text: str, embedder: Embedder, done: DataFrame | None = None,
        shard_size: int = SHARD_SIZE, model: str | None = None) -> DataFrame:
    """Vectors of the documents not done yet, with model name, shard_id and row_in_shard.

    A resumed run starts a new shard behind the highest one in ``done``.
    """
    todo = docs if done is None else pending(docs, done, key)
    # the positions come first: a sort of embedded rows would run the embedder once more to sample them
    placed = assign_shards(todo, [key], shard_size, first_free_shard(done))
    embedded = embedder(placed, text, "embedding").drop(text)
    places = ["shard_id", "row_in_shard"]
    return embedded.select(*[c for c in embedded.columns if c not in places],
                           F.lit(model or getattr(embedder, "name", "custom")).alias("model"), *places)
