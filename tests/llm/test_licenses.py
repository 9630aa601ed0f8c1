import re

from cohortspark.llm import licenses
from tests.llm.rows import documents, odd_texts


def bag(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall("[a-z0-9]+", lower)
    return set(zip(words, words[1:]))


def plain(text):
    """All units against all templates."""
    text = text or ""
    norm = re.sub("[^a-z0-9\n]+", " ", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    lines, paragraphs = norm.split("\n"), re.split("\n *\n[ \n]*", norm)
    units = [("line", i, x) for i, x in enumerate(lines)]
    units += [("paragraph", i, x) for i, x in enumerate(paragraphs)] if len(paragraphs) > 1 else []
    units += [("text", 0, norm)] if len(lines) > 1 else []
    out = []
    for kind, place, unit in units:
        a = bag(unit)
        for name, template in licenses.TEMPLATES.items():
            b = bag(template)
            if a and 2 * len(a & b) / (len(a) + len(b)) >= licenses.THRESHOLD:
                out.append((kind, place, name, 2 * len(a & b) / (len(a) + len(b))))
    return sorted(out + plain_windows(norm))


def plain_windows(norm):
    """Windows of the length of a template where its chosen bigrams say it begins; of overlapping ones the best."""
    words, found = norm.split(), []
    pairs = list(zip(words, words[1:]))
    starts = {}
    for name, gram, offset, size in licenses.window_starts(licenses.TEMPLATES, licenses.THRESHOLD):
        for at, pair in enumerate(pairs):
            if " ".join(pair) == gram:
                starts.setdefault((name, size), set()).add(max(0, at - offset))
    for (name, size), places in starts.items():
        b = bag(licenses.TEMPLATES[name])
        good = {}
        for place in places:
            a = set(pairs[place:place + size - 1])
            dice = 2 * len(a & b) / (len(a) + len(b))
            if dice >= licenses.THRESHOLD:
                good[place] = dice
        found += [("window", p, name, d) for p, d in good.items() if not any(abs(q - p) < size and (-e, q) < (-d, p) for q, e in good.items())]
    return found


MIT = licenses.TEMPLATES["mit"]
TEXTS = [
    *odd_texts(), "All rights reserved.", "prose before\nReleased under the MIT license!\nprose behind", "ALL  RIGHTS\treserved", MIT,
    MIT.replace(". ", ".\n") + "\n", "Copyright (c) 2020 Someone\n\n" + MIT.replace(", ", ",\n") + "\n\nTHE END", "rights reserved", MIT[:200],
    "Licensed under the Apache License, Version 2.0.\n\n\n\nLicensed under CC BY-NC 4.0.", MIT + " " + "more words here and there " * 20,
]


DISCLAIMER = "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY."


def test_licences_anywhere(spark):
    """Whole licences on one line or over paragraphs, notices inside lines; prose about licences is none."""
    cases = [
        (f"MIT License Copyright (c) 2021 A. Person {MIT} {DISCLAIMER}", "mit"),
        (f"prose first. {MIT}\n\n{DISCLAIMER}\n\nprose last", "mit"),
        ("Our library is released under the MIT License. See the file.", "mit-line"),
        ("Copyright 2020 Example Inc. All rights reserved.", "all-rights-reserved"),
        ("Copyright 2019 B\n\n" + licenses.TEMPLATES["bsd-3-clause"].replace(" 1. ", "\n\n1. ").replace(" 2. ", "\n\n2. ").replace(" 3. ", "\n\n3. ") + f"\n\n{DISCLAIMER}", "bsd-3-clause"),
        (f"/* {licenses.TEMPLATES['apache-2.0-header']} */ package x; import y;", "apache-2.0-header"),
        ("one line to give the name. Copyright (C) year. " + licenses.TEMPLATES["gpl-3.0-notice"] + " This program is distributed in the hope", "gpl-3.0-notice"),
        ("It says: " + licenses.TEMPLATES["mpl-2.0-notice"] + " The end.", "mpl-2.0-notice"),
        ("The rights that were reserved by all the authors of a license are not a public matter, and the software is permitted.", None),
    ]
    found = {r["doc_id"]: r["found"] for r in licenses.summary(documents(spark, [(i, t) for i, (t, _) in enumerate(cases)])).collect()}
    for i, (_, name) in enumerate(cases):
        assert (f":{name}" in f"{found[i]},".replace(",", ":,") or found[i].endswith(f":{name}")) if name else found[i] == "", (i, found[i])


def test_all_templates_match_themselves(spark):
    rows = list(enumerate(licenses.TEMPLATES.items()))
    found = {r["doc_id"]: r for r in licenses.summary(documents(spark, [(i, t) for i, (_, t) in rows])).collect()}
    assert all(found[i]["license"] == name and found[i]["dice"] == 1.0 for i, (name, _) in rows)


def test_against_all_pairs(spark):
    rows = list(enumerate(TEXTS)) + [(None, "All rights reserved."), (3, "a"), (3, "a")]
    df = documents(spark, rows, extra=["license", "kind", "a", "_row"])
    found = licenses.matches(df).collect()
    got = sorted(str((r["doc_id"], [tuple(m) for m in r["matches"]])) for r in found)
    assert got == sorted(str((key, plain(t))) for key, t in rows)
    assert licenses.summary(df.limit(0)).count() == 0


def test_plan_is_native(spark, folder):
    df = licenses.summary(spark.read.parquet(f"{folder}/documents.parquet"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))
