import random
import zlib

import numpy as np
import pytest

from cohortspark.llm import toxicity
from tests.llm.rows import documents, odd_texts


def truth_model(rng, n):
    """Votes of five voters: two good, one copy of the first, one poor, one that fires at random."""
    y = rng.random(n) < 0.2
    a, b, c = (np.where(y, rng.random(n) < p, rng.random(n) < q) for p, q in ((0.7, 0.03), (0.6, 0.05), (0.4, 0.2)))
    copy = np.where(rng.random(n) < 0.97, a, ~a)
    noise = rng.random(n) < 0.1
    return y, np.stack([a, copy, b, c, noise], 1).astype(int)


def test_label_model_knows_copies_of_votes():
    rng = np.random.default_rng(3)
    y, votes = truth_model(rng, 40_000)
    code = votes @ (1 << np.arange(5))
    values, counts = np.unique(code, return_counts=True)
    labelled = np.zeros((len(values), 2))
    for v, truth in zip(code[:400], y[:400]):
        labelled[np.searchsorted(values, v), int(truth)] += 1
    model = toxicity.estimate(values, counts.astype(float), labelled, 5)
    assert abs(model.prior - 0.2) < 0.05
    assert 0 in (model.parent[1],) or model.parent[0] == 1  # the copy hangs on its original
    post = model.posterior(values)
    real = np.array([y[code == v].mean() for v in values])
    many = counts > 200
    assert np.abs(post - real)[many].mean() < 0.08
    both_copies = np.searchsorted(values, 3)  # the first voter and its copy alone: little more than the first voter
    assert abs(post[both_copies] - real[both_copies]) < 0.15


def corpus(seed=4, n=900):
    rng = random.Random(seed)
    bad = ["blorgh", "snarkle", "vexnik", "grumbo", "idiot"]
    plain = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    copied = " ".join(rng.choice(plain) for _ in range(40)) + " copyjunk"
    for i in range(n):
        toxic = rng.random() < 0.25
        words = [rng.choice(plain) for _ in range(rng.randint(8, 60))]
        if toxic:
            for w in rng.sample(bad, rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), w)
        text = " ".join(words)
        if i % 30 == 0:
            text, toxic = copied, True
        rows.append((i, text))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = {r["doc_id"]: r for r in toxicity.score(documents(spark, rows), lab).collect()}
    assert len(found) == len(rows)
    truth = {k: t for k, _, t in labels}
    held = [k for k in found if found[k]["held_out"]]
    assert held == [k for k in held if zlib.crc32(str(k).encode()) % 3 == 1] and len(held) > 200
    right = sum((found[k]["score"] >= 0.5) == truth[k] for k in held)
    assert right >= 0.95 * len(held)
    assert all(r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in found.values())


def test_held_out_labels_are_not_read(spark):
    rows, labels = corpus(5, 300)
    df = documents(spark, rows)
    flipped = [(k, q, 1 - t if zlib.crc32(str(k).encode()) % 3 == 1 else t) for k, q, t in labels]
    schema = "doc_id long, quality int, toxic int"
    a, b = ({r["doc_id"]: r["score"] for r in toxicity.score(df, spark.createDataFrame(x, schema)).collect()} for x in (labels, flipped))
    assert a == pytest.approx(b, abs=1e-9)


def test_odd_tables(spark):
    rows, labels = corpus(6, 200)
    odd = [(1000 + i, t) for i, t in enumerate(odd_texts())] + [(None, "no id"), (1003, "again"), (1003, "again")]
    df = documents(spark, rows + odd, extra=["score", "votes", "words", "x", "key", "toxic"])
    lab = spark.createDataFrame(labels + [(0, 1, 1), (None, 1, 1), (2, None, None), (3, 1, 7), (1005, 0, 1)], "doc_id long, quality int, toxic int")
    found = toxicity.score(df, lab).collect()
    assert len(found) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 for r in found)
    blank = {r["score"] for r in found if r["doc_id"] in (1000, 1001, 1002)}
    assert len(blank) == 1
    assert toxicity.score(df.limit(0), lab).count() == 0
    unlabelled = toxicity.score(documents(spark, [(1, "you are an idiot and a moron, worthless scum"), (2, "a quiet day")]), lab.limit(0)).collect()
    scores = {r["doc_id"]: r["score"] for r in unlabelled}
    assert scores[1] > scores[2]


def test_words_are_chosen_by_all_labelled_rows(spark, monkeypatch):
    """A toxic word of some labelled rows votes, however few rows the classifier is fitted on."""
    rows = [(i, f"w{i % 7} w{i % 11} " + (f"blorgh w{i % 5}" if i % 4 == 0 else f"w{i % 13}")) for i in range(400)]
    rows += [(1000 + i, f"v{i} zorbex w{i % 3}") for i in range(12)]
    labels = spark.createDataFrame([(k, int("blorgh" in t or "zorbex" in t)) for k, t in rows], "doc_id long, toxic int")
    seen = []
    make = toxicity.make_voters
    monkeypatch.setattr(toxicity, "make_voters", lambda scores: seen.append(sorted(scores)) or make(scores))
    for fit_rows in (20, 16_000):
        toxicity.score(documents(spark, rows), labels, fit_rows=fit_rows)
    assert seen[0] == seen[1] and ("zorbex", 1.0) in seen[0]


@pytest.mark.parametrize("held, sent", [(1 << 20, 1_000_000), (40, 0)])
def test_word_scores_by_plain_counting(spark, monkeypatch, held, sent):
    """Distinct (word, word before) of labelled rows, with and without small limits; unlabelled and unused rows do not count."""
    import re

    monkeypatch.setattr(toxicity, "HELD", held)
    monkeypatch.setattr(toxicity, "MOST_SENT", sent)
    rows, labels = corpus(8, 300)
    labels = labels[:200] + [(900, 1, 1), (None, 1, 1)]
    docs = documents(spark, rows + [(10, "again blorgh here"), (None, "no id")]).selectExpr("doc_id AS key", "text")
    usable = spark.createDataFrame([(k, t) for k, _, t in labels if k is not None], "key long, toxic int")
    found = toxicity.word_scores(toxicity.labelled_texts(docs, usable))
    truth = {k: t for k, _, t in labels}
    places = {}
    for k, text in rows + [(10, "again blorgh here")]:
        words = re.findall(r"[^\W\d_]+", text.lower()) if k in truth else []
        for before, w in zip(["", *words], words):
            places.setdefault(w, {}).setdefault(before, set()).add(truth[k])
    a = {w: sum(1 in s for s in b.values()) for w, b in places.items()}
    b = {w: sum(0 in s for s in x.values()) for w, x in places.items()}
    share = {w: a[w] / (a[w] + b[w]) for w in places}
    toxic = sorted((w for w in places if a[w] >= 4 and share[w] >= 0.6), key=lambda w: (-a[w], w))[:512]
    common = sorted(places, key=lambda w: (-a[w] - b[w], w))[:512]
    assert found == list(dict.fromkeys((w, share[w]) for w in toxic + common))


def test_posterior_and_estimate_by_the_book():
    """The posterior is Bayes' rule over the tree; after the last round the parameters are the weighted counts they stand for."""
    rng = np.random.default_rng(5)
    y, votes = truth_model(rng, 3000)
    code = votes @ (1 << np.arange(5))
    values, counts = np.unique(code, return_counts=True)
    labelled = np.zeros((len(values), 2))
    for v, truth in zip(code[:200], y[:200]):
        labelled[np.searchsorted(values, v), int(truth)] += 1
    model = toxicity.estimate(values, counts.astype(float), labelled, 5)
    post = model.posterior(values)
    for v, p in zip(values.tolist(), post):
        joint = []
        for c, prior in ((0, 1 - model.prior), (1, model.prior)):
            for j in range(5):
                above = v >> model.parent[j] & 1 if model.parent[j] >= 0 else 0
                fires = model.fires[c, j, above]
                prior *= fires if v >> j & 1 else 1 - fires
            joint.append(prior)
        assert p == pytest.approx(joint[1] / sum(joint), abs=1e-9)
    free = counts - labelled.sum(1)
    weight = [free * (1 - post) + labelled[:, 0], free * post + labelled[:, 1]]
    bits = values[:, None] >> np.arange(5) & 1
    imagined = [20 * 0.9, 20 * 0.1]
    usual = [0.02, 0.5]
    assert model.prior == pytest.approx((weight[1].sum() + imagined[1]) / (sum(counts) + 20), abs=1e-3)
    for c in (0, 1):
        for j, k in enumerate(model.parent):
            for above in (0, 1) if k >= 0 else (0,):
                here = bits[:, k] == above if k >= 0 else np.ones(len(values), bool)
                side = (usual[c] if above else 1 - usual[c]) if k >= 0 else 1.0
                n = weight[c][here].sum() + imagined[c] * side
                hits = (weight[c] * bits[:, j])[here].sum() + imagined[c] * side * usual[c]
                assert model.fires[c, j, above] == pytest.approx(hits / n, abs=5e-3)
