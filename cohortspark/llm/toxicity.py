"""Toxicity by weak supervision: voters, a generative label model, a linear classifier of its posterior labels.

Voters are lexicons, patterns and word lists drawn from labelled rows; each fires on a text or does not. The label model is a
mixture of two classes in which every voter depends on the class and on one other voter (the tree with the most mutual
information within the classes), so it knows how accurate the voters are and which of them say the same twice. It is
estimated by EM from how often each combination of votes occurs among all texts; the labelled rows count with their
labels. A logistic regression over the presence of words then learns the posterior labels and scores all texts.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from cohortspark.llm.common import add_columns
from cohortspark.runtime import cut

# Common insults by theme, in some languages.
LEXICONS = {
    "wits": "idiot idiots moron morons imbecile stupid dumb dumbass dimwit halfwit idiota imbécil estúpido tonto imbécile crétin débile idiotin dummkopf trottel schwachkopf".split(),
    "worth": "loser losers worthless pathetic useless pitiful clown clowns perdedor inútil patético perdant minable nichtsnutz versager wertlos".split(),
    "disgust": "disgusting scum trash filth filthy vermin vile garbage repulsive basura asqueroso escoria ordure dégoûtant racaille abschaum widerlich ekelhaft".split(),
}
PATTERNS = {
    "address": re.compile(r"\byou(?:'re| are)? (?:all )?(?:a |an |such |so )", re.IGNORECASE),
    "shout": re.compile(r"!{3,}|(?:\b[A-Z]{4,}\b[ ,!]+){3}"),
    "masked": re.compile(r"\b[A-Za-z]+[*@#]{2,}[A-Za-z]*"),
}
WORD = re.compile(r"[^\W\d_]+")
#: Labelled rows on which the classifier is fitted, at most about this many; words are counted in all of them.
FIT_ROWS = 16_000
#: Words the classifier may use.
FEATURES = 1024
#: Word lists drawn from labelled rows, and the words in all of them; such a word has so many places, mostly toxic ones.
DRAWN, DRAWN_WORDS = 4, 128
LEAST_PLACES, MOSTLY = 4, 0.6
ROUNDS = 60
RIDGE = 1e-4
#: Places that a task holds before it gives them out, once without their repeats they are more than half as many.
HELD = 1 << 20
#: Labels that are sent to every task; more are joined, after a sieve of so many bits has let through few other texts.
MOST_SENT, SIEVE_BITS = 1_000_000, 24
PREDICTED = 0.7
#: The classes before any text is seen, as so many imagined texts.
PRIOR, HIT, FALSE_HIT, IMAGINED = 0.1, 0.5, 0.02, 20
MOST_VOTERS = 14


def held_out(key: Column, of: int = 3, part: int = 1) -> Column:
    """Whether crc32 of the key as text leaves this remainder; a null key is not held out, but has no label either."""
    return F.coalesce(F.crc32(key.cast("string")) % of == part, F.lit(False))


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


@dataclass
class Voters:
    """Names, word lists and the classifier's words."""

    lists: dict[str, list[str]]
    features: list[str]

    def __post_init__(self):
        self.names = [*self.lists, *PATTERNS]
        if len(self.names) > MOST_VOTERS:
            raise ValueError(f"more than {MOST_VOTERS} voters")
        self.of = {}
        for n, words in enumerate(self.lists.values()):
            for w in words:
                self.of[w] = self.of.get(w, 0) | 1 << n
        self.known = set(self.features)

    def read(self, text: str | None) -> tuple[int, list[str]]:
        """Votes as bits, and the classifier's words in the text (votes among them, as ``#name``)."""
        found = words_of(text)
        votes = 0
        for w in found & self.of.keys():
            votes |= self.of[w]
        if text:
            for n, pattern in enumerate(PATTERNS.values(), len(self.lists)):
                if pattern.search(text):
                    votes |= 1 << n
        return votes, sorted(found & self.known) + [f"#{name}" for n, name in enumerate(self.names) if votes >> n & 1]


def sample(labels: DataFrame, key: str, rows: int) -> DataFrame:
    """(key, toxic) of about ``rows`` labelled keys, those with the least hashes."""
    n = labels.count()
    if n <= rows:
        return labels
    edge = int(rows / n * 2**63)
    return labels.filter(F.xxhash64(F.col(key), F.lit("fit")).bitwiseAND(F.lit(2**63 - 1)) < edge)


def labelled_texts(docs: DataFrame, usable: DataFrame) -> DataFrame:
    """(toxic, text) of (key, text) whose key is in ``usable`` (key, toxic). Texts of other keys are not shuffled.

    Up to MOST_SENT labels go to every task. With more, one bit for the hash of each labelled key is set in a table of
    fixed size, which goes there instead; what passes it is joined.
    """
    if usable.count() <= MOST_SENT:
        return docs.join(F.broadcast(usable), "key").select("toxic", "text")

    def place(key):
        return F.shiftright(F.xxhash64(key), 64 - SIEVE_BITS).bitwiseAND(F.lit((1 << SIEVE_BITS) - 1))

    bit = F.expr("shiftleft(1L, CAST(_place & 63 AS INT))")
    sieve = usable.select(place("key").alias("_place")).groupBy(F.shiftright("_place", 6).alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    passed = (docs.withColumn("_place", place("key")).withColumn("_at", F.shiftright("_place", 6))
              .join(F.broadcast(sieve), F.col("_at") == F.col("_word")).filter(F.col("_bits").bitwiseAND(bit) != 0))
    return passed.select("key", "text").join(usable, "key").select("toxic", "text")


def _all_places(texts: DataFrame) -> DataFrame:
    """(toxic, word, before) of (toxic, text): a word and the hash of the word it follows, distinct within what a task holds."""
    def run(batches):
        number: dict[str, int] = {"": 0}  # of the words held
        held: dict[int, list[np.ndarray]] = {0: [], 1: []}
        sizes = {0: 0, 1: 0}

        def reduced(toxic):
            held[toxic] = [np.unique(np.concatenate(held[toxic]))]
            sizes[toxic] = len(held[toxic][0])

        def given_out():
            words = list(number)
            hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words)).view(np.int64)
            names = pa.array(words)
            for toxic in (0, 1):
                if sizes[toxic]:
                    reduced(toxic)
                    pairs = held[toxic][0]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), toxic, np.int32)), names.take(pa.array(pairs >> 32)),
                                                      pa.array(hashes[pairs & 0xFFFFFFFF])], names=["toxic", "word", "before"])
                held[toxic], sizes[toxic] = [], 0
            number.clear()
            number[""] = 0

        for batch in batches:
            for row in range(batch.num_rows):  # one text at a time is held as a Python object
                toxic, text = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                words = WORD.findall(text.lower()) if text else []
                if not words:
                    continue
                word = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
                pairs = word << 32
                pairs[1:] |= word[:-1]
                held[toxic].append(pairs)
                sizes[toxic] += len(words)
                if sizes[toxic] > HELD:
                    reduced(toxic)
                    if sizes[toxic] > HELD // 2:
                        yield from given_out()
        yield from given_out()

    return texts.mapInArrow(run, "toxic int, word string, before long")


def word_scores(texts: DataFrame) -> list[tuple[str, float]]:
    """(word, share) of the classifier's words, for (toxic, text): half of them the words of most places among those found
    mostly in toxic texts, half the words of most places in all. The share is that of toxic texts in a word's places.

    A word counts once for each word it follows, not for each text: copies of one text then count once, however many there
    are. What is shuffled is a word and the 64-bit hash of the one before it, repeats within a task left out.
    """
    places = _all_places(texts.select("toxic", "text")).groupBy("word", "before").agg(
        F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("a"), F.max(F.when(F.col("toxic") == 0, 1).otherwise(0)).alias("b"))
    counts = cut(places.groupBy("word").agg(F.sum("a").alias("a"), F.sum("b").alias("b")))
    share = F.col("a") / (F.col("a") + F.col("b"))
    toxic = counts.filter((F.col("a") >= LEAST_PLACES) & (share >= MOSTLY)).orderBy(F.col("a").desc(), "word").limit(FEATURES // 2)
    common = counts.orderBy((F.col("a") + F.col("b")).desc(), "word").limit(FEATURES // 2)
    best = [(r["word"], r["share"]) for part in (toxic, common) for r in part.select("word", share.alias("share")).collect()]
    return list(dict.fromkeys(best))


def make_voters(scores: list[tuple[str, float]]) -> Voters:
    """Fixed lexicons, and the toxic words of labelled rows dealt in turn to DRAWN lists."""
    drawn = [w for w, share in scores if share >= MOSTLY][:DRAWN_WORDS]
    lists = dict(LEXICONS)
    for n in range(DRAWN):
        lists[f"drawn{n}"] = drawn[n::DRAWN]
    return Voters(lists, sorted({w for w, _ in scores} | {w for words in LEXICONS.values() for w in words}))


@dataclass
class LabelModel:
    """P(class), and per class P(voter fires | its parent's vote)."""

    prior: float
    parent: list[int]
    fires: np.ndarray  # class, voter, parent's vote (0 if there is none)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        logs = np.stack([np.full(len(votes), math.log(1 - self.prior)), np.full(len(votes), math.log(self.prior))])
        for j, parent in enumerate(self.parent):
            own = votes >> j & 1
            above = votes >> parent & 1 if parent >= 0 else np.zeros(len(votes), np.int64)
            for y in (0, 1):
                p = self.fires[y, j, above]
                logs[y] += np.log(np.where(own == 1, p, 1 - p))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def _tree(joint: np.ndarray) -> list[int]:
    """Parents in the tree of the most mutual information within the classes; ``joint``: class, voter, voter, vote, vote."""
    m = joint.shape[1]
    total = joint.sum((3, 4), keepdims=True)
    p = joint / total
    info = (p * np.log(p / (p.sum(4, keepdims=True) * p.sum(3, keepdims=True)))).sum((3, 4))
    weight = (info * total[..., 0, 0] / total[..., 0, 0].sum(0)).sum(0)
    parent, inside = [-1] * m, {0}
    while len(inside) < m:
        _, j, k = max((weight[j, k], j, k) for j in inside for k in range(m) if k not in inside)
        parent[k] = j
        inside.add(k)
    return parent


def estimate(votes: np.ndarray, counts: np.ndarray, labelled: np.ndarray, m: int) -> LabelModel:
    """EM over combinations of votes: ``counts`` of all texts, ``labelled`` (combination, class) of those with a label."""
    bits = (votes[:, None] >> np.arange(m) & 1).astype(float)
    sides = np.stack([1 - bits, bits])  # vote, combination, voter
    known = labelled.sum(1)
    free = np.maximum(counts - known, 0)
    # imagined texts that vote as said above stand beside the others in every round: they keep the classes apart
    imagined = IMAGINED * np.array([1 - PRIOR, PRIOR])
    usual = np.stack([np.full(m, FALSE_HIT), np.full(m, HIT)])
    beside = np.stack([1 - usual, usual])  # vote, class, voter
    prior = (labelled[:, 1].sum() + imagined[1]) / (known.sum() + IMAGINED)
    start = np.stack([(labelled[:, y] @ bits + imagined[y] * usual[y]) / (labelled[:, y].sum() + imagined[y]) for y in (0, 1)])
    model = LabelModel(float(prior), [-1] * m, np.repeat(start[:, :, None], 2, axis=2))
    for _ in range(ROUNDS):
        post = model.posterior(votes)
        weight = np.stack([free * (1 - post) + labelled[:, 0], free * post + labelled[:, 1]])
        joint = np.empty((2, m, m, 2, 2))
        for y in (0, 1):
            for u in (0, 1):
                for v in (0, 1):
                    joint[y, :, :, u, v] = (sides[u] * weight[y][:, None]).T @ sides[v] + imagined[y] * np.outer(beside[u, y], beside[v, y])
        parent = _tree(joint)
        fires = np.empty((2, m, 2))
        for j, k in enumerate(parent):
            for y in (0, 1):
                if k < 0:
                    one = weight[y] @ bits[:, j]
                    fires[y, j] = (one + imagined[y] * usual[y, j]) / (weight[y].sum() + imagined[y])
                else:
                    fires[y, j] = joint[y, k, j, :, 1] / joint[y, k, j].sum(1)
        prior = float(np.clip((weight[1].sum() + imagined[1]) / (weight.sum() + IMAGINED), 1e-6, 1 - 1e-6))
        model = LabelModel(prior, parent, np.clip(fires, 1e-6, 1 - 1e-6))
    return model


def _by_combination(read: DataFrame, labels: DataFrame, key: str, m: int) -> LabelModel:
    """Label model from counts per combination of votes: at most 2 to the number of voters."""
    all_counts = {r["votes"]: r["n"] for r in read.groupBy("votes").agg(F.count("*").alias("n")).collect()}
    with_label = read.join(labels, key).groupBy("votes", "toxic").agg(F.count("*").alias("n")).collect()
    votes = np.array(sorted(all_counts) or [0], np.int64)
    at = {v: i for i, v in enumerate(votes.tolist())}
    labelled = np.zeros((len(votes), 2))
    for r in with_label:
        labelled[at[r["votes"]], r["toxic"]] += r["n"]
    return estimate(votes, np.array([all_counts.get(v, 0) for v in votes.tolist()], float), labelled, m)


def score(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", toxic: str = "toxic",
          fit_rows: int = FIT_ROWS) -> DataFrame:
    """(key, held_out, score, predicted, weak_label), one row per row of ``df``.

    ``labels`` (key, toxic 0 or 1): rows with other labels, null keys or held-out keys are not used; of a key with
    several labels the greatest counts. Words are chosen by all labelled rows and the classifier is fitted on about
    ``fit_rows`` of them; votes are counted over all texts. Null and empty texts have no words: their score is that of a text without any.
    Without both labels in the sample the score is the label model's posterior. Other columns are ignored.
    """
    spark = df.sparkSession
    usable = cut(labels.filter(F.col(toxic).isin(0, 1) & F.col(key).isNotNull() & ~held_out(F.col(key)))
                 .groupBy(F.col(key).alias("key")).agg(F.max(toxic).cast("int").alias("toxic")))
    docs = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    chosen = cut(sample(usable, "key", fit_rows))  # bounded by fit_rows, so that it can be broadcast
    # places are distinct, so that repeated rows of a key need not be dropped
    voters = make_voters(word_scores(labelled_texts(docs, usable)))
    shared = spark.sparkContext.broadcast(voters)

    def run(values):
        found = [shared.value.read(v) for v in values]
        return {"votes": pa.array([f[0] for f in found], pa.int64()), "words": pa.array([f[1] for f in found], pa.list_(pa.string()))}

    read = cut(add_columns(docs, run, ["text"], "votes long, words array<string>", keep=["key"]))
    model = _by_combination(read, usable, "key", len(voters.names))
    combos = [int(r["votes"]) for r in read.select("votes").distinct().collect()]  # bounded as above
    weak = spark.createDataFrame(list(zip(combos, model.posterior(np.array(combos or [0], np.int64)).tolist())), "votes long, weak_label double")
    labelled = read.join(F.broadcast(weak), "votes")
    vocabulary = voters.features + [f"#{n}" for n in voters.names]
    vectors = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="words", outputCol="x").setBinary(True)
    rows = labelled.join(F.broadcast(chosen.select("key")), "key").dropDuplicates(["key"])
    soft = vectors.transform(rows).select("x", F.explode(F.array(
        F.struct(F.lit(1.0).alias("label"), F.col("weak_label").alias("weight")),
        F.struct(F.lit(0.0).alias("label"), (1 - F.col("weak_label")).alias("weight")))).alias("s")).select("x", "s.label", "s.weight")
    out = F.struct(F.col("key").alias(key), held_out(F.col("key")).alias("held_out"))
    if soft.filter("weight > 0").select("label").distinct().count() < 2:
        scored = labelled.select(out.alias("o"), F.col("weak_label").alias("score"), "weak_label")
    else:
        fitted = LogisticRegression(featuresCol="x", labelCol="label", weightCol="weight", regParam=RIDGE, maxIter=60,
                                    standardization=False).fit(soft.filter("weight > 0"))
        scored = fitted.transform(vectors.transform(labelled)).select(out.alias("o"), vector_to_array("probability")[1].alias("score"),
                                                                    "weak_label")
    return scored.select("o.*", "score", (F.col("score") >= PREDICTED).cast("int").alias("predicted"), "weak_label")
