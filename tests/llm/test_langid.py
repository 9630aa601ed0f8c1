import zlib
from collections import Counter

from cohortspark.llm import langid
from tests.llm.rows import documents, odd_texts


def plain_grams(text):
    """1 to 3 letters of each run of letters with an edge on both sides."""
    out = Counter()
    word = ""
    for c in text.lower() + " ":
        if c.isalpha():
            word += c
        elif word:
            framed = f"\x01{word}\x01"
            out.update(word)
            out.update(framed[i:i + 2] for i in range(len(framed) - 1))
            out.update(framed[i:i + 3] for i in range(len(framed) - 2))
            word = ""
    return out


def code(gram):
    n = 0
    for c in gram:
        n = n << langid.BITS | ord(c)
    return n


def plain_profile(counts, top):
    return {g: i for i, g in enumerate(sorted(counts, key=lambda g: (-counts[g], code(g)))[:top])}


SAMPLES = {
    "en": ["the cat sat on the mat and that is that", "there is nothing that the other wants", "this and that, then those"],
    "de": ["der hund und die katze sind nicht hier", "das ist nicht der weg, und das auch nicht", "die straße ist nass"],
    "fr": ["le chat est sur la table et il mange", "les enfants sont dans la maison", "c'est la vie, été comme hiver"],
}


def test_grams():
    for text in odd_texts():
        got = Counter(langid.grams(text or "").tolist())
        assert got == Counter({code(g): n for g, n in plain_grams(text or "").items()})


def test_predictions_by_the_book(spark):
    rows = [(i * 7 + j, t, lang) for j, (lang, texts) in enumerate(SAMPLES.items()) for i, t in enumerate(texts * 4)]
    rows += [(1000 + i, t, None) for i, t in enumerate(odd_texts())] + [(None, "the one without an id", "en"), (8, "und die", "de"), (8, "und die", "de")]
    df = documents(spark, rows, extra=["score", "lang_pred"])

    def held(key):
        return key is not None and zlib.crc32(str(key).encode()) % 4 == 2

    counts = {}
    for key, text, lang in rows:
        if lang and text is not None and not held(key):
            counts.setdefault(lang, Counter()).update(plain_grams(text))
    profiles = {lang: plain_profile(c, langid.TOP) for lang, c in counts.items()}
    want = []
    for key, text, _ in rows:
        own = plain_profile(plain_grams(text or ""), langid.TOP)
        if not own:
            want.append((key, held(key), "und", 0.0))
            continue
        out = {lang: sum(abs(p[g] - i) if g in p else langid.TOP for g, i in own.items()) for lang, p in profiles.items()}
        best = min(sorted(out), key=out.get)
        want.append((key, held(key), best, 1 - out[best] / (langid.TOP * len(own))))
    found = [tuple(r) for r in langid.languages(df).collect()]
    assert sorted(str((a, b, c, round(max(d, 0), 9))) for a, b, c, d in found) == sorted(str((a, b, c, round(max(d, 0), 9))) for a, b, c, d in want)


def test_empty_and_unlabelled(spark):
    df = documents(spark, [(1, "hello", None), (2, None, "en")])
    assert {r["lang_pred"] for r in langid.languages(df).collect()} == {"und"}
    assert langid.languages(df.limit(0)).count() == 0 and langid.decided(df.limit(0)).count() == 0


def test_held_out_accuracy(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = langid.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert found.filter("lang_pred = lang").count() >= 0.97 * found.count() > 0


def test_rows_without_a_language_go(spark):
    df = documents(spark, [(1, "the cat", "en"), (2, "123 ...", "en"), (3, None, "en"), (4, "the dog", "en"), (5, "the cat", "en")], extra=["score"])
    kept = langid.decided(df)
    assert kept.columns == df.columns and {(r["doc_id"], r["score"]) for r in kept.collect()} == {(1, "x"), (4, "x"), (5, "x")}


def test_texts_far_from_every_language_go(spark):
    """A script that no label names scores 0, another language of the same script below the fence or with what letters it shares."""
    rng = __import__("random").Random(2)
    words = {"en": "the of and to in is that it was for on are with as his they be at one have".split(), "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split()}
    rows = [(i, " ".join(rng.choice(words[x]) for _ in range(rng.choice([1, 5, 40]))), x) for i, x in enumerate(["en", "de"] * 60)]
    odd = [(500, "слово другое слово и ещё слова на этом языке", None), (501, "日本語の文章です", None), (502, "12 34", None), (503, None, None)]
    kept = {r["doc_id"] for r in langid.decided(documents(spark, rows + odd, extra=["score", "lang_pred"])).collect()}
    assert kept == {r[0] for r in rows}
    assert {r["doc_id"] for r in langid.decided(documents(spark, [(1, "слово", None), (2, "12", None)])).collect()} == {1}
