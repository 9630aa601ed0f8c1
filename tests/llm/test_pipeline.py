import re

import pytest

pytest.importorskip("public_tokenizers")
import sentencepiece  # noqa: E402

import corpus_pipeline  # noqa: E402
from cohortspark.llm import langid, mixing, queries, secrets  # noqa: E402
from tests.llm.rows import documents, odd_texts  # noqa: E402
from tests.llm.test_langid import plain_grams  # noqa: E402
from tests.llm.test_mixing import plain_targets  # noqa: E402
from tests.llm.test_simhash import components, plain  # noqa: E402

HEX = "0123456789abcdef" * 2


def table():
    rows = [(i, t, "en", "s0") for i, t in enumerate(odd_texts())]
    rows += [(100 + i, f"text number n{i} says password={HEX[i % 8:]}q{i} and more words of its own {i * i} {i ** 3}", "en", f"s{i % 3}") for i in range(30)]
    rows += [(200 + i, "the same words in each of these copies, token: copied12345", "de", f"s{i % 5}") for i in range(8)]
    return rows + [rows[9], (None, "a row without an id", "en", None), (400, "12 34", None, "s1")]


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_copies", "secrets", "mixture", "pieces"]


def test_stages_by_plain_python(spark, tmp_path):
    rows = table()
    df = documents(spark, rows, extra=["score", "fp", "base"])
    df.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))

    def strings(d):
        return sorted(str((r["doc_id"], r["text"], r["source"])) for r in d.collect())

    first = corpus_pipeline.language(spark, docs, str(tmp_path))
    left = [r for r in rows if r[1] and plain_grams(r[1])]
    assert first.columns == docs.columns and strings(first) == sorted(str((r[0], r[1], r[3])) for r in left)

    second = corpus_pipeline.near_copies(spark, first, str(tmp_path))
    root = components([plain(r[1]) for r in left if r[0] is not None])
    least = {}
    for r in left:
        if r[0] is not None:
            c = root[plain(r[1])]
            least[c] = min(r[0], least.get(c, r[0]))
    left = [r for r in left if r[0] is None] + [{r[0]: r for r in left}[k] for k in least.values()]
    assert second.columns == docs.columns and strings(second) == sorted(str((r[0], r[1], r[3])) for r in left)

    third = corpus_pipeline.clean_secrets(spark, second, str(tmp_path))
    cleaned = {r["doc_id"]: r["text"] for r in third.collect()}
    assert len(cleaned) == len(left) and third.columns == docs.columns
    for r in left:
        spans = [(s["start"], s["end"]) for part in secrets.find(r[1]) for s in part]
        text = r[1]
        for a, b in sorted(spans, reverse=True):
            text = text[:a] + "[SECRET]" + text[b:]
        assert cleaned[r[0]] == (text if len(spans) < 2 else cleaned[r[0]])
        assert not re.search(r"password=[0-9a-f]", cleaned[r[0]])

    fourth = corpus_pipeline.mixture(spark, third, str(tmp_path))
    sizes, times = {}, {}
    for r in left:
        sizes[r[3]] = sizes.get(r[3], 0) + len(cleaned[r[0]].split())
    want = plain_targets(sizes, mixing.WEIGHTS, sum(sizes.values()))
    for r in fourth.collect():
        times[r["source"]] = times.get(r["source"], 0) + len(r["text"].split())
    largest = max(len(t.split()) for t in cleaned.values())
    assert fourth.columns == docs.columns and all(abs(times.get(s, 0) - want[s]) <= largest for s in want)

    fifth = corpus_pipeline.encoded(spark, fourth, str(tmp_path))
    library = sentencepiece.SentencePieceProcessor(model_file=queries.model_path())
    got = sorted(str((r["doc_id"], r["ids"], r["exact"])) for r in fifth.collect())
    ids = {k: library.encode(t) + [library.eos_id()] for k, t in cleaned.items()}
    assert got == sorted(str((r["doc_id"], ids[r["doc_id"]], "▁" not in r["text"])) for r in fourth.collect())


def test_run_over_a_folder(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert out.columns == ["doc_id", "source", "ids", "n_tokens", "exact"]
    assert 0 < out.select("doc_id").distinct().count() <= docs.count()
    assert out.filter("size(ids) != n_tokens").count() == 0


def test_empty_table(spark, tmp_path):
    documents(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_undecided_is_all_that_language_rejects(spark):
    df = documents(spark, [(1, "some words", "en"), (2, "weitere worte", "de")])
    assert langid.decided(df).count() == 2
