"""Licence texts in documents: word bigrams of lines, paragraphs, whole texts and windows against templates, by Dice's coefficient.

Lines, paragraphs and texts find a licence that stands alone. Windows find it anywhere: inside a line, over several paragraphs, before a
disclaimer. A window has as many words as the template and begins where some of the template's bigrams, met in the text, say that
it would begin. All of it is built-in column functions and joins. A unit whose size lies outside what the coefficient allows for a template
is never compared with it: of a and b bigrams at most the lesser number is shared, so 2 min(a, b) / (a + b) bounds the
coefficient. The same bound says how many of a template's bigrams a match shares at least, so a few words of it, those of
more bigrams than a match can miss, tell which texts and units have to be looked at.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cohortspark.runtime import cut

THRESHOLD = 0.8
#: Bigrams of all templates, a table that is broadcast.
MOST_BIGRAMS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The usual wordings of public licences and of the notices that point to them.
TEMPLATES = {
    "agpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-3-clause-line": "Licensed under the BSD 3-Clause License.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-line": "Licensed under CC BY 4.0.",
    "cc-by-nc-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-line": "Licensed under CC BY-SA 4.0.",
    "cc0-line": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "gpl-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "lgpl-3.0-line": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-line": "Released under the MIT License.",
    "mit-licensed-line": "Licensed under the MIT License.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


def anchors(templates: dict[str, str], threshold: float) -> list[str]:
    """Words of which every unit that matches some template holds at least one.

    A match shares at least low = threshold / (2 - threshold) of the template's b bigrams. Words that touch more than
    (1 - low) b of them cannot all be missing. Words that serve other templates already are taken first, then long words of
    many bigrams.
    """
    low, chosen = threshold / (2 - threshold), []
    for text in sorted(templates.values()):
        words = re.findall("[a-z0-9]+", text.translate(str.maketrans(UPPER, LOWER)))
        pairs = set(zip(words, words[1:]))
        own: set[str] = set()

        def touched():
            return [p for p in pairs if p[0] in own or p[1] in own]

        while len(touched()) <= (1 - low) * len(pairs):
            left = pairs - set(touched())
            own.add(min((w for p in left for w in p), key=lambda w: (w not in chosen, len(w) < 5, -sum(w in p for p in left), -len(w), w)))
        chosen += sorted(own - set(chosen))
    return chosen


def window_starts(templates: dict[str, str], threshold: float) -> list[tuple[str, str, int, int]]:
    """(license, bigram, place of the bigram in the template, words of the template): so many bigrams of each template that a match
    cannot miss them all, those of the longest words first."""
    low, out = threshold / (2 - threshold), []
    for name, text in sorted(templates.items()):
        words = re.findall("[a-z0-9]+", text.translate(str.maketrans(UPPER, LOWER)))
        first: dict[str, int] = {}
        for at, pair in enumerate(zip(words, words[1:])):
            first.setdefault(" ".join(pair), at)
        chosen = sorted(first, key=lambda g: (-len(g), g))[:int((1 - low) * len(first)) + 1]
        out += [(name, g, first[g], len(words)) for g in chosen]
    return out


def normalised(text: Column) -> Column:
    """ASCII lower case; all but ASCII letters, digits and line ends becomes a space."""
    return F.regexp_replace(F.translate(text, UPPER, LOWER), "[^a-z0-9\n]+", " ")


def all_bigrams(text: Column) -> Column:
    """Word pairs of a normalised text in order."""
    words = F.filter(F.split(text, "[ \n]+"), lambda w: w != "")
    pairs = F.when(F.size(words) > 1, F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1),
                                                 lambda a, b: F.concat(a, F.lit(" "), b)))
    return F.coalesce(pairs, F.array().cast("array<string>"))


def bigrams(text: Column) -> Column:
    """Distinct word pairs of a normalised text."""
    return F.array_distinct(all_bigrams(text))


def template_bigrams(spark: SparkSession, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """(license, b, bigram): the bigrams of each template and their number."""
    texts = spark.createDataFrame(sorted(templates.items()), "license string, template string")
    sized = texts.select("license", bigrams(normalised(F.col("template"))).alias("grams")).withColumn("b", F.size("grams"))
    return sized.select("license", "b", F.explode("grams").alias("bigram"))


def any_word(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def units(norm: Column, words: list[str]) -> Column:
    """(kind, place, text) of the lines of a normalised text, of the paragraphs if there are several, and of the whole if it has several lines,
    as far as they hold one of the words. The first entry, of kind ``none``, is there for every text, null ones included."""
    def listed(kind, parts):
        each = F.transform(parts, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("place"), x.alias("text")))
        return F.filter(each, lambda u: any_word(u["text"], words)) if kind != "none" else each

    lines, paragraphs = F.split(norm, "\n"), F.split(norm, "\n *\n[ \n]*")
    none = F.array().cast("array<struct<kind:string,place:int,text:string>>")
    found = F.concat(listed("none", F.array(F.lit(""))), listed("line", lines),
                     F.when(F.size(paragraphs) > 1, listed("paragraph", paragraphs)).otherwise(none),
                     F.when(F.size(lines) > 1, listed("text", F.array(norm))).otherwise(none))
    return F.when(norm.isNotNull(), found).otherwise(listed("none", F.array(F.lit(""))))


def windows(rows: DataFrame, grams: DataFrame, templates: dict[str, str], threshold: float) -> DataFrame:
    """(_row, place, license, dice) of the windows of (_row, norm) that reach the threshold; ``place`` counts words. Of windows of one
    template that overlap the best stays (then the first)."""
    starts = rows.sparkSession.createDataFrame(window_starts(templates, threshold), "license string, bigram string, offset int, size int")
    words = rows.filter("norm IS NOT NULL").select("_row", F.posexplode(all_bigrams(F.col("norm"))).alias("at", "gram"))
    # a table of fixed size, like that of the template's bigrams
    begun = (words.join(F.broadcast(starts), F.col("gram") == F.col("bigram"))
             .select("_row", "license", "size", F.greatest(F.col("at") - F.col("offset"), F.lit(0)).alias("place")).distinct())
    inside = (F.col("at") >= F.col("place")) & (F.col("at") <= F.col("place") + F.col("size") - 2)
    own = words.join(begun, "_row").filter(inside).select("_row", "license", "size", "place", "gram").distinct()
    known = F.broadcast(grams.select(F.col("license").alias("_l"), "b", "bigram"))
    shared = own.join(known, (F.col("license") == F.col("_l")) & (F.col("gram") == F.col("bigram")), "left")
    dice = 2.0 * F.count("bigram") / (F.count("*") + F.max("b"))
    good = shared.groupBy("_row", "license", "size", "place").agg(dice.alias("dice")).filter(F.col("dice") >= threshold)
    each = good.groupBy("_row", "license", "size").agg(F.collect_list(F.struct("place", "dice")).alias("w"))  # windows that match
    best = F.filter("w", lambda x: ~F.exists("w", lambda y: (F.abs(y["place"] - x["place"]) < F.col("size")) & (
        (y["dice"] > x["dice"]) | ((y["dice"] == x["dice"]) & (y["place"] < x["place"])))))
    return each.select("_row", "license", F.explode(best).alias("x")).select("_row", "x.place", "license", "x.dice")


def matches(df: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, str] = TEMPLATES,
            threshold: float = THRESHOLD) -> DataFrame:
    """(key, matches), one row per row of ``df``: the units and windows that reach the threshold for a template, as an array of
    (kind, place, license, dice), in that order.

    Null and empty texts match nothing; repeated rows stay repeated. Texts are not shuffled: only counts of shared
    bigrams are, one row per (document, unit, template) that shares any, one per document, and the bigrams of texts that hold
    words of a licence.
    """
    grams = template_bigrams(df.sparkSession, templates)
    n = grams.count()
    if n > MOST_BIGRAMS:
        raise ValueError(f"{n} template bigrams, more than {MOST_BIGRAMS}")
    words = anchors(templates, threshold)
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    sizes = grams.agg(F.min("b"), F.max("b")).first()
    smallest, largest = (sizes[0] or 0) * low, (sizes[1] or 0) * high
    body = F.col(text)
    rows = cut(df.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_key"),
                         F.when(any_word(F.lower(body), words), normalised(body)).alias("norm")))
    each = (rows.select("_row", "_key", F.explode(units(F.col("norm"), words)).alias("u")).select("_row", "_key", "u.kind", "u.place", bigrams(F.col("u.text")).alias("grams"))
            .withColumn("a", F.size("grams"))
            .filter((F.col("kind") == "none") | F.col("a").between(smallest, largest)))
    spread = each.select("_row", "_key", "kind", "place", "a", F.explode_outer("grams").alias("gram"))
    fits = (F.col("gram") == F.col("bigram")) & (F.col("a") >= F.col("b") * low) & (F.col("a") <= F.col("b") * high)
    shared = (spread.join(F.broadcast(grams), fits, "left").filter(F.col("license").isNotNull() | (F.col("kind") == "none"))
              .groupBy("_row", "_key", "kind", "place", "a", "license", "b").agg(F.count("*").alias("both"))
              .withColumn("dice", 2.0 * F.col("both") / (F.col("a") + F.col("b"))))
    hit = F.col("license").isNotNull() & (F.col("dice") >= threshold)
    found = shared.filter(hit | (F.col("kind") == "none")).select("_row", "_key", F.when(hit, F.struct("kind", "place", "license", "dice")).alias("m"))
    more = windows(rows.select("_row", "norm"), grams, templates, threshold)
    more = more.select("_row", F.struct(F.lit("window").alias("kind"), "place", "license", "dice").alias("m"))
    both = found.unionByName(more, allowMissingColumns=True)
    return (both.groupBy("_row").agg(F.max("_key").alias("_key"), F.array_sort(F.collect_list("m")).alias("matches"))
            .select(F.col("_key").alias(key), "matches"))


def summary(df: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """(key, n_matches, license, dice, found): the best template (ties: the longer one, then the first name), its coefficient
    (0 if none matches), and all matches as kind:place:license joined by commas."""
    found = matches(df, key, **options)
    length = F.create_map(*[F.lit(x) for name, t in (options.get("templates") or TEMPLATES).items() for x in (name, len(t))])
    best = F.array_min(F.transform("matches", lambda m: F.struct((-m["dice"]).alias("d"), (-F.element_at(length, m["license"])).alias("s"), m["license"].alias("l"))))
    listed = F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["kind"], m["place"], m["license"])), ",")
    return found.select(key, F.size("matches").cast("long").alias("n_matches"), best["l"].alias("license"),
                        F.coalesce(-best["d"], F.lit(0.0)).alias("dice"), listed.alias("found"))


def summary_sql(templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same over the table ``documents`` for an engine with list functions."""
    rows = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(templates.items()))
    norm = f"regexp_replace(translate({{}}, '{UPPER}', '{LOWER}'), '[^a-z0-9\\n]+', ' ', 'g')"
    grams = ("list_distinct(list_transform(range(1, greatest(len({0}), 1)), lambda i: {0}[i] || ' ' || {0}[i + 1]))")
    words = "list_filter(string_split_regex({}, '[ \\n]+'), lambda w: w <> '')"
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    begins = ", ".join(f"('{name}', '{g}', {at}, {size})" for name, g, at, size in window_starts(templates, threshold))
    return f"""
WITH wordings(name, wording) AS (VALUES {rows}),
template(license, words) AS (SELECT name, {words.format(norm.format('wording'))} FROM wordings),
bag AS (SELECT license, {grams.format('words')} AS grams FROM template),
gram AS (SELECT license, len(grams) AS b, unnest(grams) AS bigram FROM bag),
doc AS (SELECT row_number() OVER () AS r, doc_id, {norm.format("coalesce(text, '')")} AS norm FROM documents),
lines AS (SELECT r, string_split(norm, chr(10)) AS parts FROM doc),
paragraphs AS (SELECT r, string_split_regex(norm, '\\n *\\n[ \\n]*') AS parts FROM doc),
unit AS (
  SELECT r, 'line' AS kind, unnest(range(len(parts))) AS place, unnest(parts) AS text FROM lines
  UNION ALL SELECT r, 'paragraph', unnest(range(len(parts))), unnest(parts) FROM paragraphs WHERE len(parts) > 1
  UNION ALL SELECT r, 'text', 0, norm FROM doc JOIN lines USING (r) WHERE len(parts) > 1),
worded AS (SELECT r, kind, place, {words.format('text')} AS words FROM unit),
bagged AS (SELECT r, kind, place, {grams.format('words')} AS grams FROM worded),
spread AS (SELECT r, kind, place, len(grams) AS a, unnest(grams) AS bigram FROM bagged),
shared AS (SELECT r, kind, place, a, license, b, count(*) AS n FROM spread JOIN gram USING (bigram)
  WHERE a >= b * {low!r} AND a <= b * {high!r} GROUP BY ALL),
hit AS (SELECT r, kind, place, license, 2.0::DOUBLE * n / (a + b) AS dice FROM shared WHERE 2.0::DOUBLE * n / (a + b) >= {threshold!r}),
begins(license, bigram, place, size) AS (VALUES {begins}),
spot AS (SELECT r, unnest(range(len(words) - 1)) AS pos, unnest(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS bigram
  FROM (SELECT r, {words.format('norm')} AS words FROM doc) WHERE len(words) > 1),
begun AS (SELECT DISTINCT r, license, size, greatest(pos - place, 0) AS place FROM spot JOIN begins USING (bigram)),
own AS (SELECT DISTINCT r, license, size, place, spot.bigram FROM begun JOIN spot USING (r) WHERE pos BETWEEN place AND place + size - 2),
b AS (SELECT DISTINCT license, b FROM gram),
near AS (SELECT r, own.license, size, place, 2.0::DOUBLE * count(gram.bigram) / (count(*) + any_value(b.b)) AS dice
  FROM own JOIN b USING (license) LEFT JOIN gram ON gram.license = own.license AND gram.bigram = own.bigram GROUP BY ALL),
good AS (SELECT * FROM near WHERE dice >= {threshold!r}),
hits AS (SELECT r, kind, place, license, dice FROM hit UNION ALL SELECT r, 'window', place, license, dice FROM good g WHERE NOT EXISTS (
  SELECT 1 FROM good o WHERE o.r = g.r AND o.license = g.license AND abs(o.place - g.place) < g.size
    AND (o.dice > g.dice OR (o.dice = g.dice AND o.place < g.place)))),
each AS (SELECT r, count(*) AS n_matches, (min({{'d': -dice, 's': -length(wording), 'l': license}})).l AS license, max(dice) AS dice,
  string_agg(kind || ':' || place || ':' || license, ',' ORDER BY kind, place, license) AS found FROM hits JOIN wordings ON name = license GROUP BY r)
SELECT doc_id, coalesce(n_matches, 0) AS n_matches, license, coalesce(dice, 0.0)::DOUBLE AS dice, coalesce(found, '') AS found
FROM doc LEFT JOIN each USING (r)"""
