import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from cohortspark.llm import perplexity
from tests.llm.rows import documents, odd_texts


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    times, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered.update(range(i, i + 5))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


TEXTS = [*odd_texts(), "a b c d e a b c d e", "a b c d e f " * 3, "# * $ | <x> & %", "same\n same\nsame\n\n\n\nsame ", "1 2 3 4 5 1 2 3 4 6 1 2 3 4 5"]


def test_base_counts():
    for text in TEXTS:
        assert perplexity.base_counts(text) == plain_counts(text), text


def plain_model(texts):
    """Modified Kneser-Ney by the book, from character tuples; returns the probability of a gram of any order."""
    order = perplexity.ORDER
    level = {order: Counter()}
    for t in texts:
        padded = [0] * (order - 1) + [ord(c) for c in t]
        level[order].update(tuple(padded[i:i + order]) for i in range(len(t)))
    for n in range(order - 1, 0, -1):
        level[n] = Counter(g[1:] for g in level[n + 1])
    cuts, total, freed = {}, {}, {}
    for n in level:
        c = Counter(level[n].values())
        y = c[1] / (c[1] + 2 * c[2]) if c[1] else 0
        cuts[n] = []
        for i in (1, 2, 3):
            d = i - (i + 1) * y * c[i + 1] / c[i] if c[1] and c[i] else 0
            cuts[n].append(min(d, i) if d > 0 else 0.5)
        total[n], freed[n] = Counter(), defaultdict(float)
        for g, k in level[n].items():
            total[n][g[:-1]] += k
            freed[n][g[:-1]] += cuts[n][min(k, 3) - 1]

    def prob(g):
        if not g:
            return 1 / (len(level[1]) + 1)
        n, ctx = len(g), g[:-1]
        low = prob(g[1:])
        if not total[n][ctx]:
            return low
        k = level[n][g]
        return (k - cuts[n][min(k, 3) - 1] if k else 0) / total[n][ctx] + freed[n][ctx] / total[n][ctx] * low

    return prob


def log_prob(prob, text):
    padded = [0] * (perplexity.ORDER - 1) + [ord(c) for c in text]
    return sum(math.log(prob(tuple(padded[i:i + perplexity.ORDER]))) for i in range(len(text)))


@pytest.mark.parametrize("part_entries", [3_000_000, 150])
def test_model_by_the_book(spark, part_entries):
    texts = {"en": ["the cat sat on the mat", "the dog sat on the log", "a cat and a dog", "the cat sat on the mat"], None: ["der hund", "die katze und der hund"]}
    rows = [(i, t, lang) for lang, all_ in texts.items() for i, t in enumerate(all_)] + [(9, None, "en"), (9, "", "en")]
    df = documents(spark, rows)
    model = perplexity.fit(df, part_entries=part_entries)
    assert (model.parts > 1) == (part_entries == 150)
    other = [(20, "the hat is on the cat!", "en"), (21, "zebra", None), (22, "zebra", "xx"), (23, None, "en"), (24, "the dog", "en"), (24, "the dog", "en")]
    found = sorted((r["doc_id"], str(r["lang"]), r["log_prob"]) for r in perplexity.score(documents(spark, rows + other), model).collect())
    probs = {lang: plain_model(all_) for lang, all_ in texts.items()}
    want = sorted((i, str(lang), log_prob(probs[lang], t) if t and lang in probs else 0.0) for i, t, lang in rows + other)
    assert [f[:2] for f in found] == [w[:2] for w in want]
    assert np.allclose([f[2] for f in found], [w[2] for w in want], atol=1e-4)


def test_probabilities_sum_to_one(spark):
    df = documents(spark, [(1, "abracadabra alakazam"), (2, "hocus pocus abra")])
    part = perplexity.fit(df).load(0)
    letters = sorted(set("abracadabra alakazamhocus pocus abra"))
    for context in ("abra", "zzzz", "cus "):
        codes = np.array([perplexity.grams(context + c)[-1] for c in letters])
        seen = np.exp(part.log_prob(codes, 0)).sum()
        unseen = np.exp(part.log_prob(perplexity.grams(context + "Q")[-1:], 0))[0]
        assert seen + unseen == pytest.approx(1, abs=1e-4)


def test_wide_characters_and_search():
    for text in ("aé中🙂", "\u0eee\u0eef\u0fff\u1000", "\U0010ffff"):
        assert (perplexity._chars(text) < 1 << perplexity.BITS).all() and (perplexity._chars(text) >= 0).all()
    every = [chr(c) for c in (*range(1, 0xd800, 7), *range(0xe000, 0x110000, 97))]
    assert len({tuple(perplexity._chars(c)) for c in every}) == len(every)
    assert len(perplexity._chars("ab中c")) == 5 and perplexity._chars("x中")[-2] >= perplexity.NARROW
    rng = np.random.default_rng(2)
    hashes = np.unique(rng.integers(0, 2**64, 5000, dtype=np.uint64))
    table = perplexity.Table(hashes, np.arange(len(hashes)))
    found, value = table.find(np.concatenate([hashes, hashes + np.uint64(1), np.array([0, 2**64 - 1], np.uint64)]))
    assert found[:len(hashes)].all() and (value[:len(hashes)] == np.arange(len(hashes))).all() and not found[len(hashes):].any()
    assert not perplexity.Table(hashes[:0], np.empty(0)).find(hashes[:3])[0].any()


def test_table(spark):
    rows = [(i, t, "en" if i % 3 else None) for i, t in enumerate(TEXTS)] + [(None, "one two"), (3, TEXTS[3], None), (3, TEXTS[3], None)]
    df = documents(spark, rows, extra=["kept", "lang_", "low", "n_words"])
    found = perplexity.judge(df).collect()
    want = []
    for r in rows:
        n = plain_counts(r[1])
        want.append(str((r[0], *n, n[0] < 10 or 100 * n[4] > 20 * n[0])))
    got = sorted(str(tuple(r)[:7]) for r in found)
    assert got == sorted(want)
    assert all(not r["kept"] for r in found if r["base_failed"])
    assert perplexity.judge(df.limit(0)).count() == 0


def test_junk_is_rejected_and_prose_kept(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang")
    junk = spark.createDataFrame([(-1, "qzx vvk jjq xxz wqk zzv qqj kkx vzq xjw zqv kxq jzv wxq qqz " * 3, "en"),
                                  (-2, "".join(chr(33 + i * 37 % 90) + (" " if i % 7 == 0 else "") for i in range(600)), "de")], docs.schema)
    found = {r["doc_id"]: r for r in perplexity.judge(docs.unionByName(junk)).collect()}
    assert not found[-2]["kept"] and not found[-2]["base_failed"]
    clean = plain_prose(docs)
    prose = [r for k, r in found.items() if k in clean and not r["base_failed"]]
    assert len(prose) > 100 and sum(r["kept"] for r in prose) >= 0.99 * len(prose)


def plain_prose(docs):
    """Ids of documents that are prose of their language and nothing else: no runs of symbols or menus, and few words that are
    common in another language only. The given documents also hold passages of other languages."""
    import collections

    rows = [r for r in docs.collect() if r["text"]]
    counts = {}
    for r in rows:
        counts.setdefault(r["lang"], collections.Counter()).update(set(r["text"].lower().split()))
    common = {lang: {w for w, _ in c.most_common(150)} for lang, c in counts.items()}
    out = set()
    for r in rows:
        words = r["text"].lower().split()
        foreign = set().union(*[c for lang, c in common.items() if lang != r["lang"]]) - common[r["lang"]]
        symbols = sum(map(r["text"].count, "#*$%&|<>"))
        if words and 50 * symbols <= len(words) and 50 * sum(w in foreign for w in words) <= len(words):
            out.add(r["doc_id"])
    return out


def letters(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(n))


@pytest.mark.parametrize("long_junk, times", [(0, 1), (40, 1), (0, 4)])
def test_letter_junk_alone_and_in_bulk(spark, folder, long_junk, times):
    rng = random.Random(6)
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang")
    short = [(-1 - i, letters(rng, n), "en") for i, n in enumerate([10, 15, 20, 25, 30, 40, 50] * times)]
    long_ = [(-1000 - i, letters(rng, 300), "en") for i in range(long_junk)]
    copy = [(-2000 - i, short[3][1], "en") for i in range(5)]  # copies do not vouch for each other
    found = perplexity.judge(docs.unionByName(spark.createDataFrame(short + long_ + copy, docs.schema))).collect()
    junk = [r for r in found if r["doc_id"] < 0]
    assert len(junk) == len(short) + long_junk + 5 and not any(r["base_failed"] for r in junk if r["doc_id"] > -2000)
    assert [r["doc_id"] for r in junk if r["kept"]] == []
    clean = plain_prose(docs)
    prose = [r for r in found if r["doc_id"] in clean and not r["base_failed"]]
    assert len(prose) > 100 and sum(r["kept"] for r in prose) >= 0.99 * len(prose)


BIG = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def many(spark):
    import os

    if not os.path.isdir(BIG):
        pytest.skip("test tables are not here")
    return spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "text", "lang")


def test_other_languages_and_reversed_texts_leave_the_band(spark, many):
    """Texts of another language under this one's name, and prose read backwards; prose itself stays."""
    prose = {x: [r for r in many.filter(f"lang = '{x}' AND length(text) BETWEEN 400 AND 3000").orderBy("doc_id").collect()] for x in ("en", "de", "fr", "es")}
    foreign = [(-1 - i, r["text"], "en") for i, r in enumerate((prose["de"] + prose["fr"] + prose["es"])[::7][:30])]
    backwards = [(-100 - i, r["text"][::-1], "en") for i, r in enumerate(prose["en"][:10])]
    assert len(foreign) == 30 and len(backwards) == 10
    found = {r["doc_id"]: r for r in perplexity.judge(many.unionByName(spark.createDataFrame(foreign + backwards, many.schema))).collect()}
    out = [sum(not found[k]["kept"] for k, _, _ in rows) for rows in (foreign, backwards)]
    assert out[0] >= 27 and out[1] >= 7 and sum(out) >= 36
    clean = plain_prose(many)
    own = [r for k, r in found.items() if k in clean and not r["base_failed"]]
    assert len(own) > 700 and sum(r["kept"] for r in own) >= 0.99 * len(own)
    whole = [r for k, r in found.items() if k >= 0 and not r["base_failed"]]
    assert sum(r["kept"] for r in whole) >= 0.975 * len(whole)


def plain_median(values):
    return sorted(values)[(len(values) + 1) // 2 - 1] if values else None


def plain_bands(rows):
    """(low, high) of each row of dicts with lang, n, log_ppl, failed, as the book says: medians over lists."""
    import statistics

    bin_of = {id(r): int(math.floor(math.log2(max(1, r["n"])))) for r in rows}
    use = [r for r in rows if not r["failed"] and r["log_ppl"] is not None]
    by = {}
    for r in use:
        by.setdefault(r["lang"], []).append(r)
    good = {}
    for lang, texts in by.items():
        m = plain_median([r["log_ppl"] for r in texts])
        reach = max(9 * plain_median([abs(r["log_ppl"] - m) for r in texts]), math.log(1.5))
        good[lang] = [r for r in texts if abs(r["log_ppl"] - m) <= reach]
    group, middle, away, usual = {}, {}, {}, {}
    for lang, texts in good.items():
        if len(texts) < 20:
            group[lang] = None
            m = statistics.median([r["log_ppl"] for r in texts])
            middle[lang, None], away[lang, None] = m, statistics.median([abs(r["log_ppl"] - m) for r in texts])
            continue
        groups = []
        for at in sorted({bin_of[id(r)] for r in rows if r["lang"] == lang}):
            n = sum(bin_of[id(r)] == at for r in texts)
            if groups and groups[-1][1] < 100:
                groups[-1][0].append(at)
                groups[-1][1] += n
            else:
                groups.append([[at], n])
        if len(groups) > 1 and groups[-1][1] < 100:
            groups[-2][0].extend(groups.pop()[0])
        group[lang] = {at: bins[0] for bins, _ in groups for at in bins}
        for first in set(group[lang].values()):
            inside = [r["log_ppl"] for r in texts if group[lang][bin_of[id(r)]] == first]
            middle[lang, first] = plain_median(inside)
            away[lang, first] = plain_median([abs(x - middle[lang, first]) for x in inside])
    far = {}
    for lang, texts in good.items():
        if group[lang]:
            for r in texts:
                far.setdefault(bin_of[id(r)], []).append(abs(r["log_ppl"] - middle[lang, group[lang][bin_of[id(r)]]]))
    whole = plain_median([x for v in far.values() for x in v])
    out = []
    for r in rows:
        key = (r["lang"], group[r["lang"]][bin_of[id(r)]] if group.get(r["lang"]) else None)
        common = plain_median(far.get(bin_of[id(r)], [])) if bin_of[id(r)] in far else whole
        if key not in middle or common is None:
            out.append((None, None))
            continue
        reach = max(9 * away[key], (3 if group[r["lang"]] else 9) * common)
        out.append((math.exp(middle[key] - max(reach, math.log(1.5))), math.exp(middle[key] + max(reach, math.log(1.4)))))
    return out


def test_bands_and_verdicts_by_the_book(spark, many):
    rng = random.Random(3)
    few = [(-1 - i, "".join(rng.choice("aeiou ") + rng.choice("kmnpt") for _ in range(60 + 20 * i)), "xx") for i in range(9)]
    rows = many.unionByName(spark.createDataFrame(few, many.schema))
    lengths = {r["doc_id"]: r["n"] for r in rows.selectExpr("doc_id", "coalesce(length(text), 0) AS n").collect()}
    found = perplexity.judge(rows).collect()
    plain = [{"lang": r["lang"], "n": lengths[r["doc_id"]], "failed": r["base_failed"], "log_ppl": math.log(r["perplexity"]) if r["perplexity"] else None} for r in found]
    for r, (low, high) in zip(found, plain_bands(plain)):
        if low is None:
            assert r["low"] is None
            continue
        assert r["low"] == pytest.approx(low, rel=1e-6) and r["high"] == pytest.approx(high, rel=1e-6)
        inside = r["perplexity"] is None or low * (1 - 1e-9) <= r["perplexity"] <= high * (1 + 1e-9)
        assert r["kept"] == (not r["base_failed"] and inside)
    small = [r for r in found if r["lang"] == "xx"]
    assert len(small) == 9 and all(r["high"] is not None for r in small) and sum(r["kept"] for r in small if not r["base_failed"]) >= 8


def test_small_languages_go_by_the_base_rules(spark):
    prose = "the quick brown fox jumps over the lazy dog and runs away"
    found = perplexity.judge(documents(spark, [(1, prose, "xx"), (2, prose, None), (3, "", "xx"), (4, "a b", "yy")])).collect()
    assert {r["doc_id"]: (r["kept"], r["perplexity"], r["high"]) for r in found} == {
        1: (True, None, None), 2: (True, None, None), 3: (False, None, None), 4: (False, None, None)}
