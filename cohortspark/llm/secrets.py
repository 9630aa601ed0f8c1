"""Secrets in whole texts, judged by how many owners and repositories share them.

Kinds found by pattern alone: ``assign``, ``access``, ``hex``. A further kind, ``owned``, is judged by the corpus: long
mixed tokens that look live and belong to few owners. The hash of every candidate value is counted over the distinct
repositories and owners of the whole table; a value that many owners have, or that is in many and in a good share of an owner's
repositories, is a copied example.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cohortspark.llm.common import add_columns
from cohortspark.runtime import cut

#: Order of the kinds at equal starts.
KINDS = ("assign", "access", "hex", "owned")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
KEYWORDS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}")
#: A live-looking token has so many digits, both cases or many digits, and so many bits per character.
TOKEN_DIGITS, TOKEN_BITS = 3, 3.2
#: Values that more owners have are copied examples. So are those that one owner has in more than so many repositories and in more than
#: this share of all its repositories: an example in a template is in many of them, a key in a few, however many there are.
FEW_OWNERS, FEW_REPOSITORIES, SHARE = 2, 100, 0.01
#: A value found as a credential (all kinds but ``owned``) takes more to be an example: so many times each of these.
STRONGER = 5

_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())])


def _looks_live(token: str) -> bool:
    digits = sum(c.isdigit() for c in token)
    if digits < TOKEN_DIGITS or digits == len(token):
        return False
    n = len(token)
    return -sum(k / n * math.log2(k / n) for k in Counter(token).values()) >= TOKEN_BITS


def find(text: str | None) -> tuple[list[dict], list[dict]]:
    """Base spans and further candidates of one text, by start; places count code points, ends are exclusive."""
    if not text:
        return [], []
    base = []
    lower = text.lower()
    if any(w in lower for w in KEYWORDS):
        base += [("assign", *m.span(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        base += [("access", *m.span(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    base += [("hex", *m.span(), m[0]) for m in HEX.finditer(text)]
    base.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    more, at, covered = [], 0, 0  # covered: where the base spans that start before the token end
    for m in TOKEN.finditer(text):
        while at < len(base) and base[at][1] < m.end():
            covered, at = max(covered, base[at][2]), at + 1
        if covered <= m.start() and _looks_live(m[0]):
            more.append(("owned", *m.span(), m[0]))
    names = ("kind", "start", "end", "value")
    return [dict(zip(names, s)) for s in base], [dict(zip(names, s)) for s in more]


def scan(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``base`` and ``candidates``, arrays of (kind, start, end, value); a null text is empty."""
    def run(texts):
        found = [find(t) for t in texts]
        return {"base": pa.array([f[0] for f in found], pa.list_(_SPAN)),
                "candidates": pa.array([f[1] for f in found], pa.list_(_SPAN))}

    spans = "array<struct<kind:string,start:int,end:int,value:string>>"
    return add_columns(df, run, [text], f"base {spans}, candidates {spans}", keep)


def ownership(found: DataFrame, repositories: DataFrame, few_repositories: int = FEW_REPOSITORIES, share: float = SHARE) -> DataFrame:
    """(hash, owners, repositories, spread) of (hash, _owner, _repo) occurrences. ``spread``: how far the value is spread inside one owner,
    as the greatest over the owners of min(repositories with it / ``few_repositories``, their share / ``share``).

    ``repositories`` (_owner, _all) counts those of each owner. Distinct counts are small aggregates, so a value that a third of all
    rows hold is combined before each shuffle. Null owners and repositories count as one.
    """
    in_repo = found.groupBy("hash", "_owner", "_repo").agg(F.lit(1).alias("_one"))
    of_owner = in_repo.groupBy("hash", "_owner").agg(F.count("*").alias("_repos"))
    sizes = repositories.withColumnRenamed("_owner", "_o")
    spread = F.least(F.col("_repos") / few_repositories, F.col("_repos") / F.col("_all") / share)
    return (of_owner.join(sizes, F.col("_owner").eqNullSafe(F.col("_o"))).groupBy("hash")
            .agg(F.count("*").alias("owners"), F.sum("_repos").alias("repositories"), F.max(spread).alias("spread")))


def _repositories(found: DataFrame) -> DataFrame:
    """(_owner, _all): distinct repositories of each owner, counted over all rows."""
    return found.groupBy("_owner", "_repo").agg(F.lit(1).alias("_one")).groupBy("_owner").agg(F.count("*").alias("_all"))


def judge(df: DataFrame, key: str = "doc_id", text: str = "text", owner: str = "source", repo: str = "doc_id",
          few_owners: int = FEW_OWNERS, few_repositories: int = FEW_REPOSITORIES) -> DataFrame:
    """(key, base, spans), one row per row of ``df``.

    ``spans`` is an array of (start, order, kind, end, owners, repositories, live): every base span, and the further
    candidates that are live. ``live`` tells values that few owners have, and each of them in few repositories or a small
    share of its own, from widely copied ones. It is empty where nothing is found. Repeated rows stay repeated. Texts are read once and
    not shuffled; only rows with a candidate are joined with the counts.
    """
    found = cut(scan(df.select(F.col(key).alias("_key"), F.col(owner).alias("_owner"), F.col(repo).alias("_repo"),
                               F.col(text).alias("_text")), "_text", keep=["_key", "_owner", "_repo"])
                .withColumn("_row", F.monotonically_increasing_id()))
    base = F.transform("base", lambda s: F.struct(s["kind"], s["start"], s["end"]))
    return (found.select("_row", F.col("_key").alias(key), base.alias("base"))
            .join(_judged(found, _repositories(found), few_owners, few_repositories), "_row", "left").drop("_row"))


def _judged(found: DataFrame, repositories: DataFrame, few_owners: int, few_repositories: int) -> DataFrame:
    """(_row, spans) of the scanned rows (_row, _owner, _repo, base, candidates) that hold any span."""
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("s.kind")).cast("int")
    each = (found.select("_row", "_owner", "_repo", F.explode(F.concat("base", "candidates")).alias("s"))
            .select("_row", "_owner", "_repo", F.sha2("s.value", 256).alias("hash"), "s.kind", "s.start", "s.end",
                    order.alias("order")))
    needed = F.when(F.col("kind") == "owned", 1).otherwise(STRONGER)
    live = (F.col("owners") <= few_owners) & (F.col("spread") <= needed)
    return (each.join(ownership(each, repositories, few_repositories), "hash").withColumn("live", live)
            .filter("live OR kind != 'owned'")
            .groupBy("_row").agg(F.array_sort(F.collect_list(F.struct(
                "start", "order", "kind", "end", "owners", "repositories", "live"))).alias("spans")))


def _without(text: str, spans: list[dict], mark: str) -> str:
    out, at = [], 0
    for s in spans:
        if s["live"]:
            if s["start"] >= at:
                out += [text[at:s["start"]], mark]
            at = max(at, s["end"])
    return "".join([*out, text[at:]])


def redact(df: DataFrame, text: str = "text", owner: str = "source", repo: str = "doc_id", few_owners: int = FEW_OWNERS,
           mark: str = "[SECRET]", length: str = "n_chars", few_repositories: int = FEW_REPOSITORIES) -> DataFrame:
    """``df`` with each run of overlapping live spans replaced by ``mark``, and ``length`` (if there) counted anew for the
    changed rows. Widely copied values stay. Only texts that hold a candidate are shuffled."""
    names = df.columns
    found = cut(scan(df.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)], F.col(owner).alias("_owner"),
                               F.col(repo).alias("_repo")), f"c{names.index(text)}",
                     keep=[*[f"c{i}" for i in range(len(names))], "_owner", "_repo"])
                .withColumn("_row", F.monotonically_increasing_id()))
    any_span = F.size("base") + F.size("candidates") > 0
    judged = _judged(found.filter(any_span), _repositories(found), few_owners, few_repositories).filter(F.exists("spans", lambda s: s["live"]))
    dirty = found.filter(any_span).drop("base", "candidates").join(judged, "_row", "left")
    inner = f"c{names.index(text)}"

    def run(texts, spans):
        return {"_new": pa.array([_without(t, s, mark) if s else t for t, s in zip(texts, spans)], pa.string())}

    kept = [f"c{i}" for i in range(len(names))]
    changed = add_columns(dirty, run, [inner, "spans"], "_new string", keep=[*kept, "spans"])
    if length in names:
        at = f"c{names.index(length)}"
        counted = F.when(F.col("spans").isNotNull(), F.length("_new").cast(changed.schema[at].dataType)).otherwise(F.col(at))
        changed = changed.withColumn(at, counted)
    changed = changed.withColumn(inner, F.col("_new")).select(*kept)
    both = found.filter(~any_span).select(*kept).unionByName(changed)
    return both.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def listed(spans: str) -> Column:
    """kind:start:end of spans, joined by commas."""
    return F.coalesce(F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","), F.lit(""))


def digests(df: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """(key, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied); see :func:`judge`."""
    found = judge(df, key, **options)

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def live(yes):
        return F.coalesce(F.size(F.filter("spans", lambda s: s["live"] == yes)), F.lit(0))

    return found.select(key, *[count(k) for k in KINDS[:3]], F.sha2(listed("base"), 256).alias("base_sha256"),
                        listed("spans").alias("spans"), F.when(F.col("spans").isNull(), 0).otherwise(live(True)).alias("n_live"),
                        F.when(F.col("spans").isNull(), 0).otherwise(live(False)).alias("n_copied"))
