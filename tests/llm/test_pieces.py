import hashlib
import random

import pytest

pytest.importorskip("public_tokenizers")
import sentencepiece  # noqa: E402

from cohortspark.llm import pieces, queries  # noqa: E402
from tests.llm.rows import documents, odd_texts  # noqa: E402


@pytest.fixture(scope="module")
def model():
    return queries.model_path()


@pytest.fixture(scope="module")
def library(model):
    return sentencepiece.SentencePieceProcessor(model_file=model)


@pytest.fixture(scope="module")
def encoder(model):
    return pieces.Encoder(pieces.vocabulary(model))


def same(encoder, library, text):
    ids = encoder.encode(text).tolist()
    assert ids == library.encode(text), repr(text)
    assert encoder.decode(ids + [encoder.end]) == library.decode(ids + [encoder.end])


def test_odd_texts(encoder, library):
    for text in odd_texts():
        same(encoder, library, text or "")


def test_random_joins_of_pieces(encoder, library):
    rng = random.Random(3)
    parts = [p for p, _, kind in pieces.vocabulary(queries.model_path()) if kind == "normal"]
    more = [" ", "  ", "\n", " \n", "▁", "é", "中", "🙂", "\x00", "\r\n", " " * 17, "\t"]
    for _ in range(4000):
        text = "".join(rng.choice(parts if rng.random() < 0.6 else more) for _ in range(rng.randint(1, 9)))
        same(encoder, library, text.replace("▁", " ") if rng.random() < 0.8 else text)


def test_runs_of_spaces(encoder, library):
    for n in range(70):
        for text in (" " * n, " " * n + "x", "x" + " " * n + "y", "x" + " " * n):
            same(encoder, library, text)


def test_decoding_bytes_that_are_no_text(encoder):
    assert encoder.decode([encoder.byte[0xFF], encoder.byte[0x41]]) == "�A"
    assert encoder.decode([encoder.unk]) == "⁇ "


def test_a_full_memory_changes_nothing(encoder, library, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 3)
    monkeypatch.setattr(pieces, "REMEMBERED_PAIRS", 3)
    for text in odd_texts()[8:]:
        same(encoder, library, text)


def test_table(spark, model, library):
    rows = [(i, t) for i, t in enumerate(odd_texts())] + [(None, "no id"), (3, "same id"), (3, "same id")]
    df = documents(spark, rows, extra=["ids", "decoded"])
    found = pieces.digests(df, model)
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def sha(x):
        return hashlib.sha256(x.encode()).hexdigest()

    want = []
    for key, text in rows:
        ids = library.encode(text or "") + [library.eos_id()]
        want.append((key, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))))
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))
    assert pieces.digests(df.limit(0), model).count() == 0


def test_encode_and_decode_apart(spark, model):
    df = documents(spark, [(1, "Hello  world"), (2, None)], extra=["decoded"])
    ids = pieces.encode(df, model, end=False)
    back = {r["doc_id"]: (r["decoded"], r["ids"]) for r in pieces.decode(ids, model).collect()}
    assert back[1][0] == "Hello  world" and back[2] == ("", [])
