import hashlib
import re

from cohortspark.llm import secrets
from tests.llm.rows import documents, odd_texts

HEX = "0123456789abcdef" * 2
LIVE = "Zx9Qw7Lk2Pm4Rt8Vb3Nc"


def plain(text):
    """Base spans by the three patterns, failing matches dropped afterwards."""
    found = []
    for kind, pattern, flags, good in (
        ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, lambda m: len(m[2]) >= 6),
        ("access", r"AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 20),
        ("hex", r"[0-9a-f]+", 0, lambda m: len(m[0]) >= 24),
    ):
        found += [(m.start(), secrets.KINDS.index(kind), kind, m.end()) for m in re.finditer(pattern, text or "", flags) if good(m)]
    return [(k, a, b) for a, _, k, b in sorted(found)]


TEXTS = [
    f"é {HEX} x", f'PassWord = "{HEX}"', "token: abc token:abcdef", "api_key=='x' apikey:'abc.def-12=='", "AKIA" + "A" * 15, "AKIA" + "A" * 16 + "b",
    "xAKIA" + "B2" * 20, "ſecret: abcdef1", "toKen: abcdef1", "secret : abcdef1", f"my {LIVE} key", "passwd:" + "a" * 5000, "deadbeef" * 4000, "0" * 23,
    f"🙂🙂 token={LIVE} 🙂 {HEX}{HEX}", "secret: secret: abcdefg", "a" * 24 + "g" + "b" * 24,
]


def test_base_spans():
    for text in TEXTS + odd_texts():
        base, _ = secrets.find(text)
        assert [(s["kind"], s["start"], s["end"]) for s in base] == plain(text), text


def test_table(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS + odd_texts())] + [(None, f"token={LIVE}"), (3, TEXTS[3]), (3, TEXTS[3])]
    df = documents(spark, rows, extra=["base", "spans", "hash", "kind"])
    found = secrets.digests(df).collect()
    got = sorted(str((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"])) for r in found)
    want = []
    for key, text in rows:
        spans = plain(text)
        n = [sum(k == kind for k, _, _ in spans) for kind in secrets.KINDS[:3]]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        want.append(str((key, *n, hashlib.sha256(joined.encode()).hexdigest())))
    assert got == sorted(want)
    for r in found:
        base = {s for s in r["spans"].split(",") if s and not s.startswith("owned")}
        assert len(base) == r["n_assign"] + r["n_access"] + r["n_hex"]
    assert secrets.digests(df.limit(0)).count() == 0


def test_ownership(spark):
    """A token of one owner is added, one that many owners have is not; base spans stay, but are told apart."""
    copied, own = "Aa1Bb2Cc3Dd4Ee5Ff6Gg7", LIVE
    rows = [(i, f"see {copied} and password={HEX}", "en", f"s{i}") for i in range(6)]
    rows += [(10 + i, f"use {own} now", "en", "s0") for i in range(5)]
    found = {r["doc_id"]: r for r in secrets.digests(documents(spark, rows)).collect()}
    assert found[10]["spans"] == f"owned:4:{4 + len(own)}" and (found[10]["n_live"], found[10]["n_copied"]) == (1, 0)
    assert "owned" not in found[0]["spans"] and found[0]["n_hex"] == 1 and (found[0]["n_live"], found[0]["n_copied"]) == (0, 2)
    judged = {r["doc_id"]: r["spans"] for r in secrets.judge(documents(spark, rows)).collect()}
    assert (judged[10][0]["owners"], judged[10][0]["repositories"]) == (1, 5)
    assert (judged[0][0]["owners"], judged[0][0]["repositories"]) == (6, 6)


def test_redaction(spark):
    rows = [(i, f"password={HEX} here", "en", f"s{i}") for i in range(6)]
    rows += [(7, f"é token={LIVE}, {LIVE}!", "en", "s0"), (8, "nothing", "en", "s0"), (9, None, "en", "s0"), (None, f"key {LIVE}", "en", None)]
    df = documents(spark, rows, extra=["_row", "spans"])
    out = secrets.redact(df)
    assert out.columns == df.columns
    found = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert found[0] == (rows[0][1], len(rows[0][1]))
    assert found[7] == ("é [SECRET], [SECRET]!", 21)
    assert found[8] == ("nothing", 7) and found[9] == (None, None) and found[None] == ("key [SECRET]", 12)
    assert secrets.redact(df.limit(0)).count() == 0


def test_value_in_thousands_of_documents_of_one_source_is_copied(spark):
    copied = "Aa1Bb2Cc3Dd4Ee5Ff6Gg7"
    rows = [(i, f"see {copied} and password={HEX}", "en", "s0") for i in range(3000)]
    rows += [(5000 + i, f"use {LIVE} now", "en", "s0") for i in range(20)] + [(6000, f"see {copied}", "en", "s1")]
    df = documents(spark, rows)
    found = {r["doc_id"]: (r["spans"], r["n_live"], r["n_copied"]) for r in secrets.digests(df).collect()}
    assert all("owned" not in found[i][0] and found[i][1:] == (0, 2) for i in range(3000)) and found[6000] == ("", 0, 0)
    assert all(found[5000 + i] == (f"owned:4:{4 + len(LIVE)}", 1, 0) for i in range(20))
    text = {r["doc_id"]: r["text"] for r in secrets.redact(df).collect()}
    assert text[0] == rows[0][1] and text[6000] == f"see {copied}" and text[5000] == "use [SECRET] now"


def test_key_of_one_owner_in_some_of_its_documents_is_live(spark):
    """An access key in 21 documents of one owner is no example, whether the owner has many documents or only these."""
    key = "AKIA" + "Q7W3E5R9T1Y2U4I6"
    for others in (0, 400):
        rows = [(i, f"conf {i} {key} end", "en", "s0") for i in range(21)] + [(100 + i, f"plain text {i}", "en", "s0") for i in range(others)]
        df = documents(spark, rows)
        assert {(r["n_live"], r["n_copied"]) for r in secrets.digests(df).filter("doc_id < 100").collect()} == {(1, 0)}
        assert all(key not in r["text"] for r in secrets.redact(df).collect())


def test_verdicts_by_plain_counting(spark):
    """Owned spans and verdicts of random tables, counted with dictionaries."""
    import random

    rng = random.Random(5)
    tokens = ["".join(rng.choice("ABCDEFabcdefghijk0123456789") for _ in range(24)) for _ in range(12)]
    tokens = [t for t in tokens if secrets._looks_live(t)]
    keys = ["AKIA" + "".join(rng.choice("ABCDEFGH23456789") for _ in range(16)) for _ in range(6)]
    rows = []
    for i in range(400):
        owner = rng.choice(["a", "a", "a", "b", "c", "d", None])
        words = [rng.choice(tokens) for _ in range(rng.choice([0, 0, 1]))] + [rng.choice(keys) for _ in range(rng.choice([0, 0, 0, 1]))]
        if owner == "b" and rng.random() < 0.7:
            words.append(tokens[0])
        if owner == "d":
            words.append(keys[0])
        words = [w for w in words if owner in ("a", "b") or w in (tokens[1], keys[0], keys[1])]
        rows.append((i, " and ".join(["x", *words, "y"]), "en", owner))
    df = documents(spark, rows)
    found = {r["doc_id"]: r["spans"] or [] for r in secrets.judge(df, few_repositories=5, few_owners=2).collect()}
    total, where = {}, {}
    for k, text, _, owner in rows:
        total[owner] = total.get(owner, 0) + 1
        for value in {s["value"] for part in secrets.find(text) for s in part}:
            where.setdefault(value, {}).setdefault(owner, set()).add(k)
    seen = set()
    for k, text, _, owner in rows:
        want = []
        for s in [s for part in secrets.find(text) for s in part]:
            holders = where[s["value"]]
            spread = max(min(len(r) / 5, len(r) / total[o] / 0.01) for o, r in holders.items())
            live = len(holders) <= 2 and spread <= (1 if s["kind"] == "owned" else 5)
            seen.add((s["kind"], live))
            if live or s["kind"] != "owned":
                want.append((s["start"], s["kind"], s["end"], len(holders), sum(map(len, holders.values())), live))
        assert [(s["start"], s["kind"], s["end"], s["owners"], s["repositories"], s["live"]) for s in found[k]] == sorted(want)
    assert {("owned", True), ("owned", False), ("access", True)} <= seen
