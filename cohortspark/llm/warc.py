"""WARC archives: records written as Spark text files, revisits resolved by payload digest, archives read back as a stream.

Only headers (key, address, digest, length) are shuffled to find the original of each payload. An archive is then written
in which the original keeps its payload and every other record of that payload is a revisit with fresh headers that
refers to it. Writing needs no Python: a record is one value of Spark's text writer, with the blank lines that end a record
as separator. Reading takes the lines of a file in order (a compressed file is never split) and finds the records by their
Content-Length, so no file has to fit in memory.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cohortspark.runtime import cut, ensure_checkpoint_dir

#: Payloads below this length are always written in full.
LEAST_BYTES = 100
#: Originals that may be broadcast: at most so many, with at most so many bytes of addresses and keys.
MOST_SENT, MOST_SENT_BYTES = 200_000, 32 << 20
#: Payload bytes that a reading task holds before it gives out a batch, and records in a batch.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 4096
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"
#: Types of records that this module reads; others in an archive are passed over.
READ = ("response", "revisit")
HEADERS = ("record_id string, record_type string, key string, url string, date string, refers_to string, refers_to_url string, "
           "refers_to_date string, payload_digest string, payload_bytes long, intact boolean")


def from_pages(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """Records (key, url, record_type, payload, payload_digest, payload_bytes) of pages; a null body is an empty payload."""
    payload = F.coalesce(F.col(body).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).cast("string").alias("key"), F.col(url).cast("string").alias("url"), F.lit("response").alias("record_type"),
                        payload.alias("payload"))
    return rows.withColumns({"payload_digest": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("long")})


def _order(number: bool) -> Column:
    """What makes the least record of a payload: keys that are numbers go by value, other keys by code point, null last."""
    value = F.col("key").cast("decimal(38,0)") if number else F.col("key")
    return F.struct(F.col("key").isNull().alias("nokey"), value.alias("value"), F.col("url").isNull().alias("nourl"), "url", "key")


def _sum_bytes(*columns: str) -> Column:
    return F.sum(sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in columns), F.lit(64)))


def originals(records: DataFrame, numeric_keys: bool = True, least_bytes: int = LEAST_BYTES) -> tuple[DataFrame, DataFrame]:
    """Headers grouped, and the original of each payload that more than one record has.

    (key, url, payload_digest, payload_bytes, record_type, n) counts equal headers; the originals are (digest, o_key, o_url).
    A payload has one if it has a response and either a revisit beside it, or another response and at least ``least_bytes``.
    """
    headers = cut(records.groupBy("key", "url", "payload_digest", "payload_bytes", "record_type").agg(F.count("*").alias("n")))
    response = F.col("record_type") == "response"
    by = headers.groupBy("payload_digest").agg(
        F.min(F.when(response, _order(numeric_keys))).alias("o"), F.sum(F.when(response, F.col("n")).otherwise(0)).alias("responses"),
        F.sum("n").alias("all"), F.max("payload_bytes").alias("bytes"))
    again = (F.col("responses") > 0) & ((F.col("all") > F.col("responses")) | ((F.col("responses") > 1) & (F.col("bytes") >= least_bytes)))
    found = by.filter(again).select(F.col("payload_digest").alias("digest"), F.col("o.key").alias("o_key"), F.col("o.url").alias("o_url"))
    return headers, cut(found)


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing if the value is null; line ends inside a value would break the record, so they are escaped."""
    safe = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit("\r\n")), F.lit(""))


def _record(kind: str, record_id: Column, date: str, refers: tuple[Column, Column, Column] | None) -> Column:
    """Text of a record of columns key, url, payload_digest, payload_bytes and, for a response, payload."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.coalesce(F.col("payload_bytes"), F.lit(0)).cast("string"), F.lit(END))
    length = F.octet_length(http) + (F.coalesce(F.col("payload_bytes"), F.lit(0)) if kind == "response" else F.lit(0))
    lines = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\n"), _line("WARC-Record-ID", record_id), _line("WARC-Date", F.lit(date)),
             _line("WARC-Target-URI", F.col("url")), _line("Page-Key", F.url_encode("key")),
             _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest")))]
    if refers:
        lines += [_line("WARC-Profile", F.lit(PROFILE)), _line("WARC-Refers-To", refers[0]), _line("WARC-Refers-To-Target-URI", refers[1]),
                  _line("WARC-Refers-To-Date", refers[2])]
    lines += [F.lit("Content-Type: application/http; msgtype=response\r\n"), _line("Content-Length", length.cast("string")), F.lit("\r\n"), http]
    return F.concat(*lines, *([F.col("payload").cast("string")] if kind == "response" else []))


def _named(*parts: Column) -> Column:
    """A record id from the MD5 of the parts, the same in every run."""
    return _urn(F.md5(F.concat_ws("\n", *[F.coalesce(F.concat(F.lit("+"), p), F.lit("-")) for p in parts])))


def _urn(digits: Column) -> Column:
    cuts = [F.substring(digits, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def _new_id() -> Column:
    return F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">"))


def deduplicated(records: DataFrame, numeric_keys: bool = True, least_bytes: int = LEAST_BYTES, date: str | None = None) -> DataFrame:
    """Records as text (one column ``value``): one response for each repeated payload, revisits for its other records.

    ``records``: (key, url, record_type response or revisit, payload, payload_digest, payload_bytes), such as
    :func:`from_pages` or :func:`read` return. The response is the record of the least key (then url); of several equal rows
    one. Null keys come last. Responses below ``least_bytes`` stay as they are. Revisits that came in are joined with the
    response of their payload, whatever its length; without one among the records they refer to nothing. Every record
    gets a new id and the date given (now, by default).
    """
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = records.select("key", "url", "record_type", "payload", "payload_digest", "payload_bytes")
    headers, first = originals(rows.drop("payload"), numeric_keys, least_bytes)
    size = first.agg(F.count("*").alias("n"), _sum_bytes("digest", "o_key", "o_url").alias("bytes")).first()
    if size["n"] <= MOST_SENT and (size["bytes"] or 0) <= MOST_SENT_BYTES:
        first = F.broadcast(first)
    of_original = _named(F.col("digest"), F.col("o_key"), F.col("o_url"))
    is_original = F.col("key").eqNullSafe(F.col("o_key")) & F.col("url").eqNullSafe(F.col("o_url")) & (F.col("record_type") == "response")

    # responses: payloads are read here, and shuffled only if the originals are too many to be sent to every task
    responses = rows.filter("record_type = 'response'").join(first, F.col("payload_digest") == F.col("digest"), "left")
    small = F.col("payload_bytes") < least_bytes
    plain = responses.filter(F.col("digest").isNull() | (small & ~is_original))
    marked = responses.filter(F.col("digest").isNotNull() & is_original)
    repeated = (headers.join(first, F.col("payload_digest") == F.col("digest")).filter(is_original & (F.col("n") > 1))
                .select(F.col("digest").alias("twice")))
    # equal rows can both be the original: those few are met once more, by digest
    alone = marked.join(repeated, F.col("digest") == F.col("twice"), "left_anti")
    several = marked.join(repeated, F.col("digest") == F.col("twice"), "left_semi").groupBy("digest", "o_key", "o_url").agg(
        F.first("key").alias("key"), F.first("url").alias("url"), F.first("payload").alias("payload"),
        F.first("payload_digest").alias("payload_digest"), F.first("payload_bytes").alias("payload_bytes"))
    columns = ["digest", "o_key", "o_url", "key", "url", "payload", "payload_digest", "payload_bytes"]

    # revisits: from the headers alone
    here = headers.join(first, F.col("payload_digest") == F.col("digest"), "left")
    left = F.col("n") - F.when(is_original, 1).otherwise(0)
    becomes = (F.col("record_type") == "revisit") | (F.col("digest").isNotNull() & ~(F.coalesce(small, F.lit(False))))
    revisits = here.filter(becomes).withColumn("left", left).filter("left > 0").select("*", F.explode(F.sequence(F.lit(1), F.col("left"))))
    small_again = here.filter(~becomes & F.col("digest").isNotNull() & is_original & (F.col("n") > 1)).select(
        F.col("digest").alias("d2"), (F.col("n") - 1).alias("more"))
    again = several.join(small_again, F.col("digest") == F.col("d2")).select(*columns, F.explode(F.sequence(F.lit(1), F.col("more"))))
    return (plain.select(_record("response", _new_id(), date, None).alias("value"))
            .unionByName(alone.select(*columns).select(_record("response", of_original, date, None).alias("value")))
            .unionByName(several.select(*columns).select(_record("response", of_original, date, None).alias("value")))
            .unionByName(again.select(_record("response", _new_id(), date, None).alias("value")))
            .unionByName(revisits.select(_record("revisit", _new_id(), date, (
                F.when(F.col("digest").isNotNull(), of_original), F.col("o_url"),
                F.when(F.col("digest").isNotNull(), F.lit(date)))).alias("value"))))


def write(values: DataFrame, path: str) -> None:
    """Write record texts as gzip-compressed archives to a folder that must not exist."""
    values.select("value").write.option("compression", "gzip").option("lineSep", END).text(path)


class _Stream:
    """Bytes of the lines of one partition, taken by length or up to the end of a header."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        self.batches, self.held, self.at = batches, b"", 0

    def more(self) -> bool:
        for batch in self.batches:
            if batch.num_rows:
                lines = batch.column(0).cast(pa.binary()).to_pylist()
                self.held = b"".join([self.held[self.at:], b"\n".join(lines), b"\n"])
                self.at = 0
                return True
        return False

    def until(self, mark: bytes) -> bytes | None:
        """What stands before the mark; None at the end of the stream."""
        begin = self.at
        while (end := self.held.find(mark, begin)) < 0:
            begin = max(0, len(self.held) - self.at - len(mark) + 1)
            if not self.more():
                if self.held[self.at:].strip():
                    raise ValueError("an archive ends inside a header")
                return None
        found, self.at = self.held[self.at:end], end + len(mark)
        return found

    def take(self, n: int) -> bytes:
        while len(self.held) - self.at < n:
            if not self.more():
                raise ValueError("an archive ends inside a record")
        found, self.at = self.held[self.at:self.at + n], self.at + n
        return found


def parse(stream: _Stream) -> Iterator[tuple]:
    """Values of HEADERS and the payload of each response and revisit."""
    mark = END.encode()
    while (head := stream.until(mark)) is not None:
        lines = head.decode("utf-8", "replace").split("\r\n")
        while lines and not lines[0]:
            lines.pop(0)
        if not lines or not lines[0].startswith("WARC/"):
            raise ValueError(f"no record begins at {lines[:1]}")
        fields = {name.strip().lower(): value.strip() for name, _, value in (x.partition(":") for x in lines[1:])}
        block = stream.take(int(fields["content-length"]))
        if stream.take(4) != mark:
            raise ValueError("a record is longer than its Content-Length")
        if fields.get("warc-type") not in READ:
            continue
        http, _, payload = block.partition(mark)
        sizes = [x.partition(b":")[2] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        digest = fields.get("warc-payload-digest", "").removeprefix("sha256:") or None
        response = fields["warc-type"] == "response"
        size = len(payload) if response else int(sizes[0]) if sizes else None
        real = hashlib.sha256(payload).hexdigest() if response else digest
        yield (fields.get("warc-record-id"), fields["warc-type"], fields.get("page-key"), fields.get("warc-target-uri"), fields.get("warc-date"),
               fields.get("warc-refers-to"), fields.get("warc-refers-to-target-uri"), fields.get("warc-refers-to-date"), real, size,
               real == digest, payload if response else None)


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Responses and revisits of a folder of compressed archives: HEADERS, and ``payload`` if wanted (null for a revisit).

    ``payload_digest`` and ``payload_bytes`` of a response are taken from the payload itself, ``intact`` tells whether the
    header has the same digest; a revisit has those of its headers. A file that is cut off or malformed is an error.
    """
    schema = HEADERS + (", payload binary" if payloads else "")
    names = [c.split(" ")[0] for c in schema.split(", ")]
    types = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    kinds = [types[c.split(" ")[1]] for c in schema.split(", ")]

    def run(batches):
        rows, held = [], 0

        def given_out():
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)

        for row in parse(_Stream(batches)):
            rows.append(row)
            held += len(row[-1] or b"") if payloads else 0
            if held > BATCH_BYTES or len(rows) >= BATCH_ROWS:
                yield given_out()
                rows, held = [], 0
        yield given_out()

    lines = spark.read.option("lineSep", "\n").text(path).select("value")
    return lines.mapInArrow(run, schema).withColumn("key", F.url_decode("key"))


def resolved(records: DataFrame) -> DataFrame:
    """Revisits joined with the responses they refer to: (key, record_type, payload_digest, payload_bytes, original), all headers.

    ``original`` is the key of the response with the id and the digest that a revisit names, null for responses and for
    revisits without one.
    """
    wanted = records.select("key", "record_type", "payload_digest", "payload_bytes", "record_id", "refers_to")
    at = wanted.filter("record_type = 'response'").select(F.col("record_id").alias("_id"), F.col("payload_digest").alias("_digest"),
                                                          F.col("key").alias("original"))
    return wanted.join(at, (F.col("refers_to") == F.col("_id")) & (F.col("payload_digest") == F.col("_digest")), "left").select(
        "key", "record_type", "payload_digest", "payload_bytes", "original")


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html", least_bytes: int = LEAST_BYTES,
               folder: str | None = None) -> DataFrame:
    """(key, payload_bytes, payload_digest, record_type, refers_to) read back from the archives written for ``pages``.

    One row per row of ``pages``; a null or empty body is an empty payload. Of payloads of at least ``least_bytes`` that are
    equal, the record of the least key is the response (of equal rows one; null keys last; text keys by code point), the
    others are revisits that refer to it. No page, no file: an empty table gives an empty one. Other columns are ignored. The archives
    go to ``folder``, by default to a new one under the shared checkpoint folder.
    """
    spark, kind = pages.sparkSession, pages.schema[key].dataType
    numeric = kind.typeName() in ("byte", "short", "integer", "long")
    folder = folder or f"{ensure_checkpoint_dir(spark)}/archives/{uuid.uuid4().hex}"
    write(deduplicated(from_pages(pages, key, url, body), numeric, least_bytes), folder)
    found = resolved(cut(read(spark, folder, payloads=False)))
    return found.select(F.col("key").cast(kind).alias(key), "payload_bytes", "payload_digest", "record_type",
                        F.col("original").cast(kind).alias("refers_to"))


def round_trip_sql(table: str = "pages", least_bytes: int = LEAST_BYTES) -> str:
    """What :func:`round_trip` returns, in DuckDB SQL."""
    return f"""
    WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM {table}),
    d AS (SELECT page_id, url, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
    r AS (SELECT *, row_number() OVER w AS place, first_value(page_id) OVER w AS original FROM d
          WINDOW w AS (PARTITION BY payload_digest, payload_bytes ORDER BY page_id NULLS LAST, url NULLS LAST))
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN place > 1 AND payload_bytes >= {least_bytes} THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN place > 1 AND payload_bytes >= {least_bytes} THEN original END AS refers_to
    FROM r"""
