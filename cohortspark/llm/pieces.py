"""SentencePiece encoding by prefix tables, and decoding, for merge-type models.

The encoding of a text is a chain of tokens of which each neighbouring pair is the encoding of its own joint
text, and each prefix of a text has exactly one such chain. So one token per prefix, its last, describes all of
them: at each end of a vocabulary match (found by an automaton) the token fits if it is compatible with the last
token of the prefix before it. The ids are read off backwards. The time is linear in the text, however long.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortspark.llm.common import add_columns

#: Words whose ids a worker remembers, twice: those seen lately and those seen before.
REMEMBERED = 250_000
#: Pairs of tokens whose compatibility a worker remembers.
REMEMBERED_PAIRS = 500_000
#: Pieces a vocabulary may have to be broadcast.
MOST_PIECES = 1_000_000
SPACE = "▁"
UNKNOWN = " ⁇ "


def vocabulary(model_file: str) -> list[tuple[str, float, str]]:
    """(piece, score, kind) by id, read on the driver; kind: normal, byte, control, unknown."""
    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    if sp.vocab_size() > MOST_PIECES:
        raise ValueError(f"more than {MOST_PIECES} pieces")
    probe = "a ﬁ  Å\t"
    if sp.normalize(probe) != SPACE + probe.replace(" ", SPACE):
        raise ValueError("only models without text normalisation and with a leading space are supported")
    kinds = [("unknown" if sp.is_unknown(i) else "control" if sp.is_control(i) else "byte" if sp.is_byte(i) else "normal")
             for i in range(sp.vocab_size())]
    return [(sp.id_to_piece(i), sp.get_score(i), kind) for i, kind in enumerate(kinds)]


class Encoder:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, vocab: list[tuple[str, float, str]]):
        self.bytes_of = [self._bytes(piece, kind) for piece, _, kind in vocab]
        normal = {piece: i for i, (piece, _, kind) in enumerate(vocab) if kind == "normal"}
        self.id = normal
        self.piece = [piece for piece, _, _ in vocab]
        byte = {int(piece[3:5], 16): i for i, (piece, _, kind) in enumerate(vocab) if kind == "byte"}
        self.byte = [byte.get(b) for b in range(256)] if len(byte) == 256 else None
        self.unk = next(i for i, (_, _, kind) in enumerate(vocab) if kind == "unknown")
        self.end = next(i for i, (piece, _, kind) in enumerate(vocab) if kind == "control" and piece == "</s>")
        scores = sorted({score for _, score, kind in vocab if kind == "normal"}, reverse=True)
        order = {score: n for n, score in enumerate(scores)}
        #: the lower, the sooner a merge into this piece happens
        self.rank = [order.get(score, 0) if kind == "normal" else 0 for _, score, kind in vocab]
        chars = {p for p in normal if len(p) == 1}
        if any(c not in chars for p in normal for c in p):
            raise ValueError("a piece holds a character that is no piece")
        if any(SPACE in p.lstrip(SPACE) for p in normal):
            raise ValueError("a piece holds a space after another character")
        self.foreign = re.compile("([^" + "".join(map(re.escape, sorted(chars))) + "])")
        self.split = {}
        for piece, i in normal.items():
            if len(piece) > 1 and piece.strip(SPACE):
                self.split[i] = self._last_merge(piece)
        self.matches = ahocorasick.Automaton()
        for piece, i in normal.items():
            if piece == SPACE or piece.strip(SPACE):
                if len(piece) == 1 or self.split[i]:
                    self.matches.add_word(piece, (i, len(piece)))
        self.matches.make_automaton()
        self.pairs: dict[int, bool] = {}
        runs = [len(p) for p in normal if not p.strip(SPACE)]
        self.longest_run = max(runs)
        self.runs = [[]] + [self._merged(SPACE * n)[0] for n in range(1, self.longest_run + 1)]
        if len(self.runs[-1]) != 1:
            raise ValueError("the longest run of spaces is never formed")
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _bytes(self, piece: str, kind: str) -> bytes:
        if kind == "byte":
            return bytes([int(piece[3:5], 16)])
        return {"control": "", "unknown": UNKNOWN}.get(kind, piece.replace(SPACE, " ")).encode()

    def _merged(self, text: str) -> tuple[list[int], tuple[int, int] | None]:
        """Ids by plain merging (for single pieces), and the last pair that was merged."""
        ids, last = [self.id[c] for c in text], None
        while True:
            best = None
            for at in range(len(ids) - 1):
                whole = self.id.get(self.piece[ids[at]] + self.piece[ids[at + 1]])
                if whole is not None and (best is None or self.rank[whole] < best[0]):
                    best = (self.rank[whole], at, whole)
            if best is None:
                return ids, last
            _, at, whole = best
            last = (ids[at], ids[at + 1])
            ids[at:at + 2] = [whole]

    def _last_merge(self, piece: str) -> tuple[int, int] | None:
        """The two tokens that were merged last; None if merging never gives this piece."""
        ids, last = self._merged(piece)
        return last if ids == [self.id[piece]] else None

    def compatible(self, left: int, right: int) -> bool:
        """Would the joint text of two tokens be encoded as just these two?

        The merges inside both are undone from the last to the first; at each step the two tokens that
        touch must not have been free to merge before the step that was undone. Of equal ranks the left
        merge comes first.
        """
        if len(self.pairs) >= REMEMBERED_PAIRS:
            self.pairs.clear()
        known = self.pairs[left * len(self.piece) + right] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        undone = None  # (rank, position: 0 in the left token, 2 in the right one) of the merge undone last
        while True:
            whole = self.id.get(self.piece[left] + self.piece[right])
            if whole is not None and (undone is None or (self.rank[whole], 1) < undone):
                return False
            a = (self.rank[left], 0) if self.split.get(left) else None
            b = (self.rank[right], 2) if self.split.get(right) else None
            if a is None and b is None:
                return True
            if b is None or (a is not None and a > b):
                left, undone = self.split[left][1], a
            else:
                right, undone = self.split[right][0], b

    def known(self, text: str) -> list[int]:
        """Ids of a text of known characters with a space at most in front."""
        last = [-1] * (len(text) + 1)
        pairs, width = self.pairs, len(self.piece)
        for at, (token, length) in self.matches.iter(text):
            at += 1
            if last[at] < 0:
                if length == at:
                    last[at] = token
                    continue
                left = last[at - length]
                if left >= 0:
                    fits = pairs.get(left * width + token)
                    if fits or (fits is None and self.compatible(left, token)):
                        last[at] = token
        ids, at = [], len(text)
        while at:
            token = last[at]
            ids.append(token)
            at -= len(self.piece[token])
        ids.reverse()
        return ids

    def unit(self, text: str) -> list[int]:
        """Ids of a text with a space at most in front; characters outside the vocabulary become bytes."""
        ids: list[int] = []
        for n, part in enumerate(self.foreign.split(text)):
            if n % 2 == 0:
                if part:
                    ids += self.known(part)
            elif self.byte:
                ids += [self.byte[b] for b in part.encode("utf-8", "surrogatepass")]
            else:
                ids.append(self.unk)
        return ids

    def spaced(self, text: str) -> list[int]:
        """Ids of a text with any number of spaces in front; merges among the spaces come last of all."""
        body = text.lstrip(SPACE)
        n = len(text) - len(body)
        ids = self.unit(SPACE + body) if n else self.unit(body)
        if n and ids[0] == self.id[SPACE]:
            ids, n = ids[1:], n + 1
        if n > 1:
            whole, rest = divmod(n - 1, self.longest_run)
            ids = self.runs[-1] * whole + self.runs[rest] + ids
        return ids

    def remembered(self, part: str) -> bytes:
        """Ids of a part of a text between spaces, as 32-bit numbers; a part that starts a line has no space in front."""
        found = self.new.get(part)
        if found is None:
            found = self.old.get(part)
            if found is None:
                text = part if part[:1] == "\n" else SPACE + part
                found = np.array(self.unit(text), np.int32).tobytes()
            if len(self.new) >= REMEMBERED:
                self.old, self.new = self.new, {}
            self.new[part] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text, without an end id."""
        if not text:
            return np.empty(0, np.int32)
        text = text.replace(SPACE, " ")
        if "  " in text or " \n" in text or text[0] in " \n" or text[-1] == " ":
            parts = re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + text.replace(" ", SPACE))
            return np.array([i for p in parts for i in self.spaced(p)], np.int32)
        new, remembered = self.new.get, self.remembered
        parts = text.replace("\n", " \n").split(" ")
        return np.frombuffer(b"".join([new(p) or remembered(p) for p in parts]), np.int32)

    def decode(self, ids: list[int]) -> str:
        """Text of ids: the space that encoding puts in front goes, bytes that are no UTF-8 become U+FFFD."""
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        text = raw.decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


class _Shared:
    """The encoder of a broadcast vocabulary, made once per worker."""

    made: dict[int, Encoder] = {}

    @classmethod
    def of(cls, broadcast) -> Encoder:
        key = hash(tuple(broadcast.value[-3:])) ^ len(broadcast.value)
        if key not in cls.made:
            cls.made.clear()
            cls.made[key] = Encoder(broadcast.value)
        return cls.made[key]


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int32), *arrays])))


def _broadcast(spark: SparkSession, model_file: str):
    return spark.sparkContext.broadcast(vocabulary(model_file))


def encode(df: DataFrame, model_file: str, text: str = "text", end: bool = True, keep: list[str] | None = None) -> DataFrame:
    """Add ``ids`` (array of int), the encoding of the whole text; a null text counts as empty.

    A column named ``ids`` is replaced, all others (or ``keep``) stay. An empty text has the end id alone, or none.
    """
    vocab = _broadcast(df.sparkSession, model_file)

    def run(texts):
        enc = _Shared.of(vocab)
        tail = np.array([enc.end] if end else [], np.int32)
        return {"ids": _lists([np.concatenate([enc.encode(t or ""), tail]) for t in texts])}

    return add_columns(df, run, [text], "ids array<int>", keep)


def decode(df: DataFrame, model_file: str, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Add ``decoded`` (string), the text of the ids; null ids give an empty text."""
    vocab = _broadcast(df.sparkSession, model_file)

    def run(lists):
        enc = _Shared.of(vocab)
        return {"decoded": pa.array([enc.decode(x or []) for x in lists], pa.string())}

    return add_columns(df, run, [ids], "decoded string", keep)


def round_trip(df: DataFrame, model_file: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``ids`` (with the end id) and ``decoded`` in one pass over the texts; see :func:`encode` and :func:`decode`."""
    vocab = _broadcast(df.sparkSession, model_file)

    def run(texts):
        enc = _Shared.of(vocab)
        ids = [np.append(enc.encode(t or ""), np.int32(enc.end)) for t in texts]
        return {"ids": _lists(ids), "decoded": pa.array([enc.decode(x.tolist()) for x in ids], pa.string())}

    return add_columns(df, run, [text], "ids array<int>, decoded string", keep)


def digests(df: DataFrame, model_file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of every row; repeated rows stay repeated."""
    both = round_trip(df, model_file, text, keep=[key])
    return both.select(key, F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))
