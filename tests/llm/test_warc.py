import gzip
import hashlib
import random
from pathlib import Path

import pytest

from cohortspark.llm import warc

SCHEMA = "page_id long, url string, html string"


def expected(rows):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1] is None, rows[i][1] or ""))
    first, out = {}, []
    for i in order:
        body = (rows[i][2] or "").encode()
        kind, refers = "response", None
        if len(body) >= 100:
            if body in first:
                kind, refers = "revisit", rows[first[body]][0]
            else:
                first[body] = i
        out.append((rows[i][0], len(body), hashlib.sha256(body).hexdigest(), kind, refers))
    return sorted(out, key=repr)


def pages(seed=3):
    rng = random.Random(seed)
    bodies = ["<p>" + " ".join(rng.choice(["one", "zwei", "três", "四"]) for _ in range(rng.randint(1, 80))) + "</p>" for _ in range(12)]
    bodies += [None, "", " ", "x" * 99, "x" * 100, "é" * 50, "x" * 99 + "\r\n\r\n", "y" * 120 + "\r\n", "z" * 120 + "\r", "\r\n\r\nWARC/1.1\r\n" * 30,
               "\n" * 130, "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 5, "long line " * 40_000]
    rows = [(i, rng.choice(["http://a.example/1", "http://b.example/é?x=1", None, "http://c.example/\r\nX: y"]), rng.choice(bodies))
            for i in range(300)]
    return rows + [(1000 + i, f"http://d.example/{i}", b) for i, b in enumerate(bodies)]


@pytest.mark.parametrize("sent", [200_000, 0])
def test_round_trip(spark, monkeypatch, sent):
    monkeypatch.setattr(warc, "MOST_SENT", sent)
    rows = pages()
    found = warc.round_trip(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert sorted((tuple(r) for r in found), key=repr) == expected(rows)


def test_repeated_rows_and_null_keys(spark):
    body = "word " * 40
    rows = [(5, "u", body)] * 4 + [(3, "u", body + "x"), (None, "u", body + "x"), (None, "u", body + "y"), (7, "b", "short"), (7, "b", "short")]
    found = warc.round_trip(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((tuple(r) for r in found), key=repr) == expected(rows)


def test_empty_table_and_other_columns(spark):
    df = spark.createDataFrame(pages()[:40], SCHEMA)
    for name in ("key", "payload", "digest", "n", "value", "record_type"):
        df = df.selectExpr("*", f"'x' AS `{name}`")
    assert warc.round_trip(df).count() == 40
    assert warc.round_trip(df.limit(0)).count() == 0


def test_keys_of_text(spark):
    rows = [("b\r\nc: d", "u", "t" * 200), ("a%0A é", "u", "t" * 200), ("10", "u", "s" * 200), ("9", "u", "s" * 200)]
    found = {r["k"]: (r["record_type"], r["refers_to"]) for r in warc.round_trip(spark.createDataFrame(rows, "k string, url string, html string"), key="k").collect()}
    assert found == {"a%0A é": ("response", None), "b\r\nc: d": ("revisit", "a%0A é"), "10": ("response", None), "9": ("revisit", "10")}


def test_archives_are_valid_and_can_be_resolved_again(spark, tmp_path):
    """Records stand where Content-Length says; archives that hold revisits are merged with others and written anew."""
    rows = pages(5)
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    warc.write(warc.deduplicated(warc.from_pages(spark.createDataFrame(rows[:150], SCHEMA)), date="2020-02-02T00:00:00Z"), one)
    for path in Path(one).glob("*.gz"):
        data = gzip.decompress(path.read_bytes())
        at = 0
        while at < len(data):
            head, _, _ = data[at:].partition(b"\r\n\r\n")
            assert head.startswith(b"WARC/1.1\r\nWARC-Type: ") and b"WARC-Date: 2020-02-02T00:00:00Z" in head
            length = int(next(x for x in head.split(b"\r\n") if x.startswith(b"Content-Length: ")).split()[1])
            at += len(head) + 4 + length
            assert data[at:at + 4] == b"\r\n\r\n"
            at += 4
    first = warc.read(spark, one)
    more = warc.from_pages(spark.createDataFrame(rows[150:], SCHEMA))
    columns = ["key", "url", "record_type", "payload", "payload_digest", "payload_bytes"]
    warc.write(warc.deduplicated(first.select(columns).unionByName(more.select(columns))), two)
    again = warc.read(spark, two)
    assert {r["intact"] for r in again.collect()} == {True}
    bodies = {hashlib.sha256((r[2] or "").encode()).hexdigest(): (r[2] or "").encode() for r in rows}
    kept = again.filter("record_type = 'response'").collect()
    assert all(bytes(r["payload"]) == bodies[r["payload_digest"]] for r in kept)
    assert {r["payload_digest"] for r in kept} == set(bodies)
    assert len({r["record_id"] for r in again.collect()}) == len(rows)
    found = warc.resolved(again).collect()
    big = [r for r in found if r["payload_bytes"] >= 100]
    got = sorted((int(r["key"]), r["record_type"], int(r["original"]) if r["original"] else None) for r in big)
    assert got == sorted((k, kind, refers) for k, size, _, kind, refers in expected(rows) if size >= 100)


def test_revisit_without_its_response(spark, tmp_path):
    rows = [("1", "u", "revisit", None, "ab" * 32, 500), ("2", "u", "response", b"q" * 50, hashlib.sha256(b"q" * 50).hexdigest(), 50),
            ("3", "u", "revisit", None, hashlib.sha256(b"q" * 50).hexdigest(), 50)]
    df = spark.createDataFrame(rows, "key string, url string, record_type string, payload binary, payload_digest string, payload_bytes long")
    warc.write(warc.deduplicated(df), str(tmp_path / "a"))
    found = {r["key"]: (r["record_type"], r["original"], r["payload_bytes"]) for r in warc.resolved(warc.read(spark, str(tmp_path / "a"))).collect()}
    assert found == {"1": ("revisit", None, 500), "2": ("response", None, 50), "3": ("revisit", "2", 50)}


def test_broken_archive_is_an_error(spark, tmp_path):
    folder = tmp_path / "bad"
    folder.mkdir()
    (folder / "x.gz").write_bytes(gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 500\r\n\r\nshort\r\n\r\n"))
    with pytest.raises(Exception, match="ends inside a record"):
        warc.read(spark, str(folder)).collect()
