"""Language of a text by rank-order profiles: its most frequent letter n-grams against those of each language.

The profile of a language is its ``TOP`` most frequent n-grams of 1 to 3 letters (the edge of a word counts as a
letter), of a text the same. The distance is the sum over the text's n-grams of how far each one is out of place,
``TOP`` where the language does not list it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortspark.llm.common import add_columns, gram_counts, tally
from cohortspark.runtime import cut

TOP = 400
#: Languages a set of profiles may have to be broadcast (TOP numbers each).
MOST_LANGUAGES = 5000
UNDECIDED = "und"
#: The fence of a language: this part of the score that all but so large a share of its labelled rows reach.
FENCE, LOWEST = 0.5, 0.01
EDGE, BITS = 1, 21


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point: itself if it is a letter, else EDGE."""
    return np.array([c if chr(c).isalpha() else EDGE for c in range(0x110000)], np.int64)


def grams(text: str) -> np.ndarray:
    """N-grams of a text as numbers, repeats included; none if it has no letter."""
    codes = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    codes = np.concatenate([[EDGE], codes, [EDGE]])
    letter = codes != EDGE
    codes = codes[letter | np.concatenate([[True], letter[:-1]])]  # one edge between words
    if len(codes) < 3:
        return np.empty(0, np.int64)
    pairs = codes[:-1] << BITS | codes[1:]
    triples = codes[:-2] << 2 * BITS | pairs[1:]
    return np.concatenate([codes[codes != EDGE], pairs, triples[codes[1:-1] != EDGE]])


def ranked(codes: np.ndarray, top: int = TOP) -> np.ndarray:
    """The most frequent n-grams in order; of equal counts the lesser number first."""
    found, counts = tally(codes)
    return found[np.argsort(-counts, kind="stable")[:top]]


@dataclass
class Profiles:
    """Names in order; per language its n-grams sorted by number, with their ranks."""

    names: list[str]
    grams: list[np.ndarray]
    ranks: list[np.ndarray]

    def nearest(self, text: str | None) -> tuple[str, float]:
        """(language, score): the score is 1 less the distance as a part of the greatest one. Ties: the lesser name."""
        own = ranked(grams(text)) if text else np.empty(0, np.int64)
        if not len(own) or not self.names:
            return UNDECIDED, 0.0
        place, best = np.arange(len(own)), (UNDECIDED, float("inf"))
        for name, known, ranks in zip(self.names, self.grams, self.ranks):
            at = np.minimum(np.searchsorted(known, own), len(known) - 1)
            out = np.where(known[at] == own, np.abs(ranks[at] - place), TOP).sum()
            if out < best[1]:
                best = (name, float(out))
        return best[0], max(0.0, 1.0 - best[1] / (TOP * len(own)))


def fit(df: DataFrame, text: str = "text", lang: str = "lang") -> Profiles:
    """Profiles of all languages with a letter in some text; rows with a null text or language are left out."""
    counts = cut(gram_counts(df.filter(F.col(lang).isNotNull()), lang, text, grams).withColumnRenamed("grp", "lang"))
    n = counts.select("lang").distinct().count()
    if n > MOST_LANGUAGES:
        raise ValueError(f"{n} languages, more than {MOST_LANGUAGES}")
    by_count = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    top = counts.withColumn("rank", F.row_number().over(by_count)).filter(F.col("rank") <= TOP).select("lang", "gram", "rank")
    rows = top.toPandas()  # at most TOP rows per language
    names = sorted(rows["lang"].unique())
    found = [rows[rows["lang"] == x].sort_values("gram") for x in names]
    return Profiles(list(names), [f["gram"].to_numpy() for f in found], [f["rank"].to_numpy() - 1 for f in found])


def predict(df: DataFrame, profiles: Profiles, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``lang_pred`` and ``score``; ``und`` and 0 for a null text or one without letters, or if no profile is known."""
    shared = df.sparkSession.sparkContext.broadcast(profiles)

    def run(texts):
        found = [shared.value.nearest(t) for t in texts]
        return {"lang_pred": pa.array([f[0] for f in found], pa.string()), "score": pa.array([f[1] for f in found], pa.float64())}

    return add_columns(df, run, [text], "lang_pred string, score double", keep)


def held_out(key: Column, of: int = 4, part: int = 2) -> Column:
    """Whether crc32 of the key as text leaves this remainder; a null key is not held out."""
    return F.coalesce(F.crc32(key.cast("string")) % of == part, F.lit(False))


def languages(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, held_out, lang_pred, score): learned from the labelled rows that are not held out, predicted for all.

    One row per row of ``df``, repeated rows included. ``und`` and 0 for a null text, one without letters, and where no label
    is known. Of equally near languages the lesser name counts. A null key is not held out. Other columns are ignored.
    """
    profiles = fit(df.filter(~held_out(F.col(key))), text, lang)
    rows = df.select(F.col(key), F.col(text).alias("_text"), held_out(F.col(key)).alias("held_out"))
    return predict(rows, profiles, "_text", keep=[key, "held_out"])


def fences(df: DataFrame, profiles: Profiles, text: str = "text", lang: str = "lang") -> dict[str, float]:
    """The least score of each language: FENCE times the score that all but LOWEST of the labelled rows predicted as labelled reach."""
    rows = df.filter(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    right = predict(rows, profiles, "text", keep=["lang"]).filter(F.col("lang") == F.col("lang_pred"))
    found = right.groupBy("lang").agg(F.percentile_approx("score", LOWEST, 10_000).alias("low")).collect()  # one row a language
    return {r["lang"]: FENCE * r["low"] for r in found}


def decided(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``df`` in a language that some label names, with all its columns.

    Rows go whose text is null or has no letter, and those whose score is 0 or below the fence of the predicted language:
    texts in a script or language that no profile holds. Profiles and fences are learned from all labelled rows. Without any
    label nothing is known and all rows with a letter stay. Repeated rows stay repeated.
    """
    profiles = fit(df, text, lang)
    # numbered names: a column of the table may be called like one of the prediction
    names = [f"c{i}" for i in range(len(df.columns))]
    rows = df.select(*[F.col(c).alias(name) for c, name in zip(df.columns, names)])
    inner = names[df.columns.index(text)]
    if not profiles.names:
        kept = rows.filter(F.regexp_like(inner, F.lit(r"\p{L}")))
    else:
        least = fences(df, profiles, text, lang)
        known = F.create_map(*[F.lit(x) for kv in least.items() for x in kv]) if least else F.create_map(F.lit(""), F.lit(0.0))
        out = predict(rows, profiles, inner, keep=names)
        fence = F.coalesce(F.element_at(known, F.col("lang_pred")), F.lit(0.0))
        kept = out.filter((F.col("lang_pred") != UNDECIDED) & (F.col("score") > 0) & (F.col("score") >= fence))
    return kept.select(*[F.col(name).alias(c) for c, name in zip(df.columns, names)])


def languages_sql(top: int = TOP) -> str:
    """:func:`languages` over the table ``documents`` for an engine with list functions."""
    code = " + ".join(f"CASE WHEN len(g) >= {i + 1} THEN unicode(substr(g, len(g) - {i}, 1))::BIGINT * {1 << BITS * i} ELSE 0 END" for i in range(3))
    return f"""
WITH RECURSIVE bits AS (SELECT i::BIGINT AS i, i::BIGINT AS c, 0 AS n FROM range(256) x(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, n + 1 FROM bits WHERE n < 8),
crc AS (SELECT list(c ORDER BY i) AS remainder FROM bits WHERE n = 8),
doc AS (SELECT row_number() OVER () AS row, doc_id, lang, text, doc_id IS NOT NULL AND xor(list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(regexp_extract_all(hex(encode(coalesce(doc_id::VARCHAR, ''))), '..'), lambda b: ('0x' || b)::BIGINT)),
    lambda a, b: xor(a >> 8, remainder[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) % 4 = 2 AS held_out FROM documents, crc),
word AS (SELECT row, w, count(*) AS n FROM (SELECT row, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS w FROM doc) GROUP BY row, w),
cut AS (SELECT row, n, unnest(list_concat(
    list_transform(range(1, len(w) + 1), lambda i: substr(w, i, 1)),
    list_transform(range(1, len(w) + 2), lambda i: substr(chr(1) || w || chr(1), i, 2)),
    list_transform(range(1, len(w) + 1), lambda i: substr(chr(1) || w || chr(1), i, 3)))) AS g FROM word),
gram AS (SELECT row, g, sum(n) AS n, any_value({code}) AS code FROM cut GROUP BY row, g),
own AS (SELECT row, g, row_number() OVER (PARTITION BY row ORDER BY n DESC, code) - 1 AS place FROM gram QUALIFY place < {top}),
total AS (SELECT lang, g, sum(n) AS n, any_value(code) AS code FROM gram JOIN doc USING (row) WHERE NOT held_out AND lang IS NOT NULL GROUP BY lang, g),
profile AS (SELECT lang AS known, g, row_number() OVER (PARTITION BY lang ORDER BY n DESC, code) - 1 AS rank FROM total QUALIFY rank < {top}),
away AS (SELECT row, l.known, sum(coalesce(abs(rank - place), {top}))::BIGINT AS out, count(*) AS size
  FROM own CROSS JOIN (SELECT DISTINCT known FROM profile) l LEFT JOIN profile p ON p.known = l.known AND p.g = own.g GROUP BY row, l.known),
best AS (SELECT row, min({{'out': out, 'known': known}}) AS b, any_value(size) AS size FROM away GROUP BY row)
SELECT doc_id, held_out, coalesce(b.known, '{UNDECIDED}') AS lang_pred,
  CASE WHEN b IS NULL THEN 0.0 ELSE greatest(0.0, 1.0 - b.out::DOUBLE / ({top} * size)) END::DOUBLE AS score FROM doc LEFT JOIN best USING (row)"""
