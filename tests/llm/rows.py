"""Small tables for the tests of the text operators."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows, extra=()):
    """A documents table from (doc_id, text[, lang[, source]]); ``extra`` names constant columns to be carried along."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "a", None if r[1] is None else len(r[1])) for r in rows]
    df = spark.createDataFrame(full, SCHEMA)
    for name in extra:
        df = df.selectExpr("*", f"'x' AS `{name}`")
    return df


def odd_texts(seed=7):
    """Null, empty, blank, short, repeated, very long and foreign texts."""
    rng = random.Random(seed)
    words = "alpha beta gamma délta εψιλον zeta, ETA. theta Theta iota kappa".split(" ")
    prose = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(20)]
    return [None, "", " ", "\n\t \x0b", "a", "one two", "one two three", "▁ ▁▁x", "日本語 テキスト 🙂", prose[0], prose[0], "x" * 30_000,
            "to be or not " * 4000, "line\nline\n\nline\nother line\n", "\x1c\x85word word", *prose]
