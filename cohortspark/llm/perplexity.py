"""Quality rules: word and line counts, and the perplexity of a text under an n-gram model of its language.

The model counts n-grams of ``ORDER`` characters over all texts and is smoothed by modified Kneser-Ney: lower orders count
the distinct longer n-grams they end, each order and language has its three discounts. Scoring looks n-grams up in
sorted arrays of their 64-bit hashes. The texts are dealt to two folds by their hash and each is scored by the model of the
other fold, so neither a text nor its copies are known to the model that judges it. A text outside the band of perplexity of
its language and length is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cohortspark.llm.common import SPACES, add_columns, gram_counts
from cohortspark.runtime import cut

ORDER = 5
#: Bits of a symbol. A character below NARROW is one symbol, any other two: what stands above its lower 12 bits (counted down from
#: the last symbol, which no narrow character has) and these bits. So no two characters are alike.
BITS = 12
NARROW = (1 << BITS) - 0x111
START = 0
#: Model entries broadcast at one time (12 bytes each); a larger model is scored in as many passes as it has parts.
PART_ENTRIES = 3_000_000
#: Languages a model may have; one of two folds has each twice.
MOST_LANGUAGES = 10_000
#: The band of log perplexity: so many times the median distance from the median, of texts of one language and length, and
#: no less than so many times what is usual for texts of that length, whatever their language.
FENCE, LEAST_SHARE = 9.0, 3.0
#: No band reaches less far than this, below and above: texts of another language have perplexities from 1.4 times the usual one on, own texts of
#: many repeats fall to two thirds of it. Nor is a text this near to its language's median left out when bands are set.
LEAST_BELOW, LEAST_ABOVE, ROUGH_REACH = float(np.log(1.5)), float(np.log(1.4)), float(np.log(1.5))
#: Lengths go by powers of two; neighbours are put together until so many texts share a band. A language of fewer than the
#: second number takes the distances of the texts of all languages around its own median.
LEAST_TEXTS, LEAST_IN_ALL = 100, 20
LEAST_WORDS, MOST_REPEATED = 10, 20
WINDOW = 5
SYMBOLS = "#*$%&|<>"


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words); a null text has none of all."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return (len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)),
            repeated_words(words))


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of five words that occur twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    window = ids[:n]
    for at in range(1, WINDOW):  # two numbers below 2^31 per step, renumbered so that equal means equal
        window = np.unique(window * len(number) + ids[at:n + at], return_inverse=True)[1]
    twice = np.bincount(window)[window] > 1
    if not twice.any():
        return 0
    change = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(change, at, 1)
    np.add.at(change, at + WINDOW, -1)
    return int((np.cumsum(change) > 0).sum())


def _chars(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    wide = codes >= NARROW
    if wide.any():
        first = np.cumsum(1 + wide) - (1 + wide)
        out = np.empty(len(codes) + int(wide.sum()), np.int64)
        out[first[~wide]] = codes[~wide]
        high, low = codes[wide] >> BITS, codes[wide] & ((1 << BITS) - 1)
        out[first[wide]], out[first[wide] + 1] = (1 << BITS) - 1 - high, low
        return out
    return codes


def grams(text: str) -> np.ndarray:
    """The n-gram that ends at each symbol, START standing before the text."""
    codes = np.concatenate([np.full(ORDER - 1, START), _chars(text)])
    n = len(codes) - ORDER + 1
    out = codes[:n].copy()
    for at in range(1, ORDER):
        out <<= BITS
        out |= codes[at:n + at]
    return out


def mixed(codes: np.ndarray, lang: int, order: int) -> np.ndarray:
    """64-bit hashes of n-grams of one language and order."""
    x = codes.astype(np.uint64) ^ (np.uint64(lang * 8 + order) << np.uint64(BITS * ORDER)) ^ np.uint64(lang * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Table:
    """A sorted array of hashes with values; a small index over the leading bits narrows each search."""

    def __init__(self, hashes: np.ndarray, values: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.values = hashes[order], values[order].astype(np.float32)
        self.shift = np.uint64(64 - max(1, len(hashes).bit_length() + 1))
        self.first = np.searchsorted(self.hashes >> self.shift, np.arange((1 << int(64 - self.shift)) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which are listed, their values)."""
        if not len(self.hashes):
            return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.float32)
        at = self.first[wanted >> self.shift]
        last = len(self.hashes) - 1
        at = np.minimum(at, last)
        open_ = np.flatnonzero(self.hashes[at] < wanted)
        while len(open_):
            at[open_] += 1
            open_ = open_[at[open_] <= last]
            open_ = open_[self.hashes[at[open_]] < wanted[open_]]
        at = np.minimum(at, last)
        return self.hashes[at] == wanted, self.values[at]


@dataclass
class Part:
    """One part of a model: by order the log probabilities of n-grams and the log weights of contexts."""

    langs: dict[str | None, int]
    floor: dict[int, float]
    parts: int = 1
    part: int = 0
    probs: dict[int, Table] = field(default_factory=dict)
    weights: dict[int, Table] = field(default_factory=dict)

    def log_prob(self, codes: np.ndarray, lang: int) -> np.ndarray:
        """Natural log probability of the last character of each n-gram; contexts of other parts give 0."""
        out = np.zeros(len(codes))
        here = np.arange(len(codes)) if self.parts == 1 else np.flatnonzero(part_of(codes >> BITS, self.parts) == self.part)
        for order in range(ORDER, 0, -1):
            if not len(here):
                return out
            own = codes[here] & ((1 << BITS * order) - 1)
            found, value = self.probs[order].find(mixed(own, lang, order))
            out[here[found]] += value[found]
            here, own = here[~found], own[~found]
            known, weight = self.weights[order].find(mixed(own >> BITS, lang, order))
            out[here[known]] += weight[known]
        out[here] += self.floor.get(lang, 0.0)
        return out


def part_of(context: np.ndarray, parts: int) -> np.ndarray:
    """The part that holds all n-grams of three characters and more with this context: by its last two characters."""
    return (context & ((1 << 2 * BITS) - 1)) * 2654435761 % 4294967291 % parts


def smoothed(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Model of (grp, gram, n): (order, grp, gram, logp) and (order, grp, gram, logw) of contexts.

    Every order is a few joins on (language, n-gram); nothing is collected.
    """
    levels = {ORDER: cut(counts)}
    for order in range(ORDER - 1, 0, -1):
        shorter = F.col("gram").bitwiseAND(F.lit((1 << BITS * order) - 1))
        levels[order] = cut(levels[order + 1].groupBy("grp", shorter.alias("gram")).agg(F.count("*").alias("n")))
    probs = levels[1].groupBy("grp").agg((1.0 / (F.count("*") + 1)).alias("lower"))  # even, with one unseen character
    lower, by_lang = probs, True
    all_probs, all_weights = [], []
    for order in range(1, ORDER + 1):
        level = levels[order]
        seen = level.groupBy("grp").agg(*[F.count(F.when(F.col("n") == i, 1)).alias(f"c{i}") for i in (1, 2, 3, 4)])
        y = F.try_divide(F.col("c1"), F.col("c1") + 2 * F.col("c2"))

        def discount(i):
            usual = i - (i + 1) * y * F.try_divide(F.col(f"c{i + 1}"), F.col(f"c{i}"))
            # too few counts to estimate: half of the count's first discount
            return F.when((F.col("c1") > 0) & (F.col(f"c{i}") > 0) & (usual > 0), F.least(usual, F.lit(float(i)))).otherwise(0.5)

        cuts = seen.select(F.col("grp").alias("_g"), *[discount(i).alias(f"d{i}") for i in (1, 2, 3)])
        priced = level.join(cuts, F.col("grp").eqNullSafe(F.col("_g"))).drop("_g").withColumn(
            "d", F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3")))
        context = F.call_function("shiftrightunsigned", F.col("gram"), F.lit(BITS))
        around = cut(priced.groupBy("grp", context.alias("ctx")).agg(F.sum("n").alias("total"), F.sum("d").alias("freed"))
                     .withColumn("w", F.col("freed") / F.col("total")))
        ctx = around.select(F.col("grp").alias("_g"), "ctx", "total", "w")
        joined = priced.join(ctx, F.col("grp").eqNullSafe(F.col("_g")) & (context == F.col("ctx"))).drop("_g", "ctx")
        if by_lang:
            low = lower.select(F.col("grp").alias("_g"), "lower")
            joined = joined.join(low, F.col("grp").eqNullSafe(F.col("_g")))
            by_lang = False
        else:
            low = lower.select(F.col("grp").alias("_g"), F.col("gram").alias("_s"), F.col("p").alias("lower"))
            shorter = F.col("gram").bitwiseAND(F.lit((1 << BITS * (order - 1)) - 1))
            joined = joined.join(low, F.col("grp").eqNullSafe(F.col("_g")) & (shorter == F.col("_s")))
        lower = cut(joined.select("grp", "gram", ((F.col("n") - F.col("d")) / F.col("total") + F.col("w") * F.col("lower")).alias("p")))
        all_probs.append(lower.select(F.lit(order).alias("order"), "grp", "gram", F.log("p").alias("value")))
        all_weights.append(around.select(F.lit(order).alias("order"), "grp", F.col("ctx").alias("gram"), F.log("w").alias("value")))
    out_p, out_w = all_probs[0], all_weights[0]
    for p, w in zip(all_probs[1:], all_weights[1:]):
        out_p, out_w = out_p.unionByName(p), out_w.unionByName(w)
    return cut(out_p), cut(out_w)


@dataclass
class Model:
    probs: DataFrame
    weights: DataFrame
    langs: dict[str | None, int]
    floor: dict[int, float]
    parts: int

    def load(self, part: int) -> Part:
        """One part, collected: at most about PART_ENTRIES entries. Orders 1 and 2, bounded by the characters, are in all."""
        out = Part(self.langs, self.floor, self.parts, part)
        number = F.create_map(*[F.lit(x) for k, v in self.langs.items() if k is not None for x in (k, v)]) if any(
            k is not None for k in self.langs) else F.create_map(F.lit(""), F.lit(-1))
        lang = F.when(F.col("grp").isNull(), F.lit(self.langs.get(None, -1))).otherwise(F.element_at(number, F.col("grp")))
        for name, table, shift in (("probs", self.probs, BITS), ("weights", self.weights, 0)):
            if self.parts > 1:
                two = F.call_function("shiftrightunsigned", F.col("gram"), F.lit(shift)).bitwiseAND(F.lit((1 << 2 * BITS) - 1))
                table = table.filter((F.col("order") <= 2) | (two * 2654435761 % 4294967291 % self.parts == part))
            for n in range(1, ORDER + 1):  # an order at a time, so that the driver holds one raw
                found = table.filter(F.col("order") == n).select(lang.cast("short").alias("lang"), "gram", F.col("value").cast("float")).toArrow()
                langs, gram, value = [found.column(i).to_numpy() for i in range(3)]
                hashes = np.empty(len(gram), np.uint64)
                for k in np.unique(langs):
                    hashes[langs == k] = mixed(gram[langs == k], int(k), n)
                getattr(out, name)[n] = Table(hashes, value)
        return out


def fit(df: DataFrame, text: str = "text", lang: str = "lang", part_entries: int = PART_ENTRIES) -> Model:
    """Model of all texts; rows without a language are one more language."""
    counts = cut(gram_counts(df, lang, text, grams))
    if counts.select("grp").distinct().count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    probs, weights = smoothed(counts)
    first = counts.select("grp", F.col("gram").bitwiseAND(F.lit((1 << BITS) - 1)).alias("c")).distinct().groupBy("grp").count().collect()
    langs = {r["grp"]: i for i, r in enumerate(sorted(first, key=lambda r: (r["grp"] is None, r["grp"] or "")))}
    floor = {langs[r["grp"]]: -float(np.log(r["count"] + 1)) for r in first}
    entries = probs.count() + weights.count()
    return Model(probs, weights, langs, floor, max(1, -(-entries // part_entries)))


def _scores(part: Part, langs: list[str | None], texts: list[str | None]) -> list[float]:
    """Sum of the log probabilities of each text, by language at once."""
    out = np.zeros(len(texts))
    by: dict[int, list[int]] = {}
    for i, (name, text) in enumerate(zip(langs, texts)):
        if text and name in part.langs:
            by.setdefault(part.langs[name], []).append(i)
    for lang, rows in by.items():
        codes = [grams(texts[i]) for i in rows]
        sums = np.cumsum(np.concatenate([[0.0], part.log_prob(np.concatenate(codes), lang)]))
        ends = np.cumsum([len(c) for c in codes])
        out[rows] = sums[ends] - sums[ends - [len(c) for c in codes]]
    return out.tolist()


def fold(text: str) -> Column:
    """0 or 1 by the hash of the text, so that copies are in one fold."""
    return F.xxhash64(text).bitwiseAND(F.lit(1))


def of_fold(number: Column, lang: str) -> Column:
    """Name of the model of a fold and a language; rows without a language are one more."""
    return F.concat(number.cast("string"), F.coalesce(F.concat(F.lit("="), F.col(lang).cast("string")), F.lit("")))


def score(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text", lang: str = "lang",
          by: Column | None = None) -> DataFrame:
    """(key, lang, n_chars, base counts, log_prob) of every row. Each part of the model takes a pass over the texts; the
    passes meet by key and text hash. ``by`` names the model's language for a row, its own language if not given; it
    may depend on the text and the language alone. A language the model does not know gives 0."""
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("_key"), F.col(lang).cast("string").alias("_lang"), F.xxhash64(text).alias("_hash"),
                     (F.col(lang).cast("string") if by is None else by).alias("_by"),
                     F.coalesce(F.length(text), F.lit(0)).cast("long").alias("_n"), F.col(text).alias("_text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    total = None
    for number in range(model.parts):
        shared = spark.sparkContext.broadcast(model.load(number))

        def run(langs, texts, shared=shared, with_base=number == 0):
            out = {"log_prob": pa.array(_scores(shared.value, langs, texts), pa.float64())}
            if with_base:
                counts = list(zip(*[base_counts(t) for t in texts]))
                out |= {name: pa.array(c, pa.int64()) for name, c in zip(names, counts)}
            return out

        if number == 0:
            added = ", ".join(["log_prob double", *[f"{name} long" for name in names]])
            total = cut(add_columns(rows, run, ["_by", "_text"], added, keep=["_key", "_lang", "_hash", "_n"]))
        else:
            more = (add_columns(rows, run, ["_by", "_text"], "log_prob double", keep=["_key", "_hash", "_lang"])
                    .dropDuplicates(["_key", "_hash", "_lang"])
                    .select(*[F.col(c).alias(f"{c}2") for c in ("_key", "_hash", "_lang")], F.col("log_prob").alias("_more")))
            same = F.lit(True)
            for c in ("_key", "_hash", "_lang"):
                same = same & F.col(c).eqNullSafe(F.col(f"{c}2"))
            total = cut(total.join(more, same).withColumn("log_prob", F.col("log_prob") + F.col("_more"))
                        .drop("_key2", "_hash2", "_lang2", "_more"))
    return total.select(F.col("_key").alias(key), F.col("_lang").alias("lang"), F.col("_n").alias("n_chars"), *names, "log_prob")


def failed_base() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def _matched(rows: DataFrame, found: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with the columns of ``found``, which has one row per ``by``; null equals null."""
    found = cut(found.withColumnsRenamed({c: f"_{c}" for c in by}))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by])
    return rows.join(F.broadcast(found), same, "left").drop(*[f"_{c}" for c in by])  # a row per language and length


def _around(rows: DataFrame, by: list[str], exact: bool = False) -> DataFrame:
    """``rows`` with the median of ``log_ppl`` (``middle``) and of the distances from it (``away``), over the ``usable`` ones of the same ``by``."""
    def median(c):
        return F.median(c) if exact else F.percentile_approx(c, 0.5, 10_000)

    both = _matched(rows, rows.filter("usable").groupBy(*by).agg(median(F.col("log_ppl")).alias("middle")), by)
    distance = F.abs(F.col("log_ppl") - F.col("middle"))
    return _matched(both, both.filter("usable").groupBy(*by).agg(median(distance).alias("away")), by)


def length_groups(rows: DataFrame) -> DataFrame:
    """(_lang, _bin, least): the powers of two of the lengths, those with the same ``least`` sharing a band. From the short
    ones on, neighbours are put together until LEAST_TEXTS of their texts are ``usable``."""
    counts: dict[str | None, list[tuple[int, int]]] = {}
    for r in rows.groupBy("lang", "bin").agg(F.count_if("usable").alias("n")).collect():  # some thirty lengths a language
        counts.setdefault(r["lang"], []).append((r["bin"], r["n"]))
    out = []
    for lang, bins in counts.items():
        if sum(n for _, n in bins) < LEAST_IN_ALL:
            continue
        groups: list[list] = []
        for at, n in sorted(bins):
            if groups and groups[-1][1] < LEAST_TEXTS:
                groups[-1][0].append(at)
                groups[-1][1] += n
            else:
                groups.append([[at], n])
        if len(groups) > 1 and groups[-1][1] < LEAST_TEXTS:  # the few longest join those before
            groups[-2][0].extend(groups.pop()[0])
        out += [(lang, at, group[0]) for group, _ in groups for at in group]
    return rows.sparkSession.createDataFrame(out, "_lang string, _bin int, least int")


def bands(scored: DataFrame) -> DataFrame:
    """``scored`` with ``low`` and ``high``, the fences of log perplexity of its language and length.

    The texts that pass the base rules count, less those far from the rest of their language: junk that fills a length does not
    set its band. The reach is FENCE times the median distance of the band's texts, at least LEAST_SHARE times the
    median distance of all texts of that length. A language of fewer than LEAST_IN_ALL texts has one band around its own median, with
    FENCE times the larger of its own and the common distance. Without any language of enough texts nothing is known to be usual, and
    there are no bands.
    """
    rough = _around(scored.withColumn("usable", ~F.col("base_failed") & F.col("log_ppl").isNotNull()), ["lang"])
    near = F.abs(F.col("log_ppl") - F.col("middle")) <= F.greatest(FENCE * F.col("away"), F.lit(ROUGH_REACH))
    rows = cut(rough.withColumn("usable", F.col("usable") & F.coalesce(near, F.lit(False))).drop("middle", "away"))
    same = F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("bin") == F.col("_bin"))
    grouped = rows.join(F.broadcast(length_groups(rows)), same, "left").drop("_lang", "_bin").withColumn("large", F.col("least").isNotNull())
    large = cut(_around(grouped.filter("large"), ["lang", "least"]))
    small = cut(_around(grouped.filter("NOT large"), ["lang"], exact=True))  # fewer than LEAST_IN_ALL usable texts each
    distance = F.abs(F.col("log_ppl") - F.col("middle"))
    usual = large.filter("usable").groupBy("bin").agg(F.percentile_approx(distance, 0.5, 10_000).alias("usual"))
    whole = large.filter("usable").agg(F.percentile_approx(distance, 0.5, 10_000)).first()[0]
    both = _matched(large.unionByName(small), usual, ["bin"]).withColumn("usual", F.coalesce("usual", F.lit(whole).cast("double")))
    own, common = FENCE * F.col("away"), F.col("usual")
    reach = F.when(F.col("large"), F.greatest(own, LEAST_SHARE * common)).otherwise(F.greatest(own, FENCE * common))
    below, above = (F.when(common.isNotNull(), F.greatest(reach, F.lit(least))) for least in (LEAST_BELOW, LEAST_ABOVE))
    return both.withColumn("low", F.col("middle") - below).withColumn("high", F.col("middle") + above)


def judge(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", model: Model | None = None) -> DataFrame:
    """(key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lang, perplexity, low, high).

    One row per row of ``df``, repeated rows included. ``low`` and ``high`` are the band for the text's language and
    length; a text without characters has no perplexity and fails the base rules. Without a model each half of the
    texts is scored by a model of the other half. Where the other half has no text of the language there is no perplexity,
    and where no language has LEAST_IN_ALL texts no band: the base rules alone decide. Other columns are ignored,
    whatever their names.
    """
    by = None
    if model is None:
        texts = df.select(F.col(text).alias("text"), of_fold(fold(text), lang).alias("lang"))
        model, by = fit(texts), of_fold(1 - fold(text), lang)
    scored = cut(score(df, model, key, text, lang, by).withColumn("base_failed", failed_base())
                 .withColumn("log_ppl", F.when(F.col("log_prob") < 0, -F.col("log_prob") / F.col("n_chars")))
                 .withColumn("bin", F.floor(F.log2(F.greatest(F.col("n_chars"), F.lit(1)))).cast("int")))
    banded = bands(scored).withColumn("low", F.exp("low")).withColumn("high", F.exp("high")).withColumn("perplexity", F.exp("log_ppl"))
    kept = ~F.col("base_failed") & F.coalesce(F.col("perplexity").between(F.col("low"), F.col("high")), F.lit(True))
    return banded.select(key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         kept.alias("kept"), "lang", "perplexity", "low", "high")
