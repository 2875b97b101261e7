"""SentencePiece encoding and decoding by a weighted finite-state transducer.

The model file is compiled into three parts that are composed with each input:

* the normaliser writes a blank as ``▁``, puts one in front, and, where the model says so, drops
  superfluous blanks;
* the pieces are a trie of arcs.  For a unigram model an arc weighs the piece's negative score.
  For a merge (BPE) model the transducer has a state for each last piece, and an arc from piece x
  to piece y exists, with weight 0, only where merging the characters of xy by rank ends in x, y;
  one path is left then, the model's own segmentation, because merges that cross no border of
  pieces are the same in the whole as in each pair of neighbours;
* byte fallback rewrites a character without a piece as the pieces of its bytes, or as unknown.

The shortest path in the tropical semiring (minimum over paths, sum along them) gives the pieces.
Of a merge model, where one path weighs 0, it is sought in depth, longest pieces first.
No piece goes on behind a word, so words are composed one by one and distinct words once.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import text_slices

BLANK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
CACHE_ENTRIES = 600_000
UNIT = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
ODD = re.compile(f"^{BLANK}{BLANK}|{BLANK}$|{BLANK}{BLANK}")
FAR = float("inf")


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol-buffer message."""

    def number(at):
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = number(at)
        kind = key & 7
        if kind == 0:
            value, at = number(at)
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        elif kind == 2:
            size, at = number(at)
            value, at = data[at : at + size], at + size
        else:
            raise ValueError("not a model file")
        yield key >> 3, value


class Model:
    """Pieces and settings of a model file."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.fallback = UNIGRAM, False
        self.prefix, self.squeeze, self.escape, rules = True, True, True, b""
        for field, value in fields(data):
            if field == 1:
                f = dict(fields(value))
                score = float(np.frombuffer(f.get(2, b"\0\0\0\0"), "<f4")[0])
                self.pieces.append((f.get(1, b"").decode(), score, f.get(3, NORMAL)))
            elif field == 2:
                f = dict(fields(value))
                self.kind, self.fallback = f.get(3, UNIGRAM), bool(f.get(35, 0))
            elif field == 3:
                f = dict(fields(value))
                rules = f.get(2, b"")
                self.prefix, self.squeeze = bool(f.get(3, 1)), bool(f.get(4, 1))
                self.escape = bool(f.get(5, 1))
        if rules or not self.escape or self.kind not in (UNIGRAM, BPE):
            raise ValueError("only models of pieces or merges without character rules are compiled")
        if any(t == USER for _, _, t in self.pieces):
            raise ValueError("models with user-defined symbols are not compiled")


class Known(dict):
    """Ids of the words met, composed when first asked for."""

    def __init__(self, compose: Callable[[str], bytes]):
        super().__init__()
        self.compose = compose

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        code = self[word] = self.compose(word)
        return code


class Transducer:
    def __init__(self, model: Model):
        self.model = model
        self.id_of = {p: i for i, (p, _, t) in enumerate(model.pieces) if t == NORMAL}
        self.score = {p: s for p, s, t in model.pieces if t == NORMAL}
        self.unknown = next(i for i, x in enumerate(model.pieces) if x[2] == UNKNOWN)
        self.byte_id = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(model.pieces) if t == BYTE}
        self.longest = max(map(len, self.id_of), default=1)
        # heads of pieces, so that a walk down the trie stops early
        self.heads = {p[:k] for p in self.id_of for k in range(1, len(p) + 1)}
        if any(BLANK in p.lstrip(BLANK) for p in self.id_of):
            raise ValueError("pieces that go on behind a word are not compiled")
        # the trie, a dictionary of characters per node with the piece itself under "", and the next
        # shorter arc that starts like a piece
        self.trie: dict = {}
        self.shorter: dict[str, str] = {}
        for p in self.id_of:
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = p
            if len(p) > 1:
                self.shorter[p] = next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in self.id_of), p[0])
        self.lowest = min(self.score.values(), default=0.0) - 10.0  # an unknown character's score
        self.known = Known(self.ids)
        self.plain = Known(lambda word: self.ids(BLANK + word))  # words without their blank
        self.joins: dict[tuple[str, str], bool] = {}
        self.out = [self._written(p, t) for p, _, t in model.pieces]

    def _written(self, piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == UNKNOWN:
            return " ⁇ ".encode()
        return b"" if kind == CONTROL else piece.replace(BLANK, " ").encode()

    def normalised(self, text: str) -> str:
        if self.model.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return (BLANK if self.model.prefix else "") + text.replace(" ", BLANK)

    def merged(self, text: str) -> list[str]:
        """Segmentation of a short string by merging the best-ranked neighbours, leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            best, at = -FAR, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1], -FAR)
                if s > best:
                    best, at = s, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def weight(self, last: str, piece: str) -> float:
        """Of the arc that reads ``piece`` in the state of ``last``."""
        if self.model.kind == UNIGRAM:
            return -self.score.get(piece, self.lowest)
        key = (last, piece)
        joins = self.joins.get(key)
        if joins is None:
            joins = self.merged(last + piece) == ([last, piece] if last else [piece])
            if len(self.joins) >= CACHE_ENTRIES:
                self.joins.clear()
            self.joins[key] = joins
        return 0.0 if joins else FAR

    def merges(self, unit: str) -> list[str]:
        """Pieces of the path of weight 0 through one word of a merge model.

        The path to a position is the segmentation of what lies before it, so there is one at most,
        and a position from which no arc goes on to the end is tried once.
        """
        n, trie, shorter, joins = len(unit), self.trie, self.shorter, self.joins
        out: list[str] = []
        dead: set[int] = set()
        at, last, piece = 0, "", None
        while at < n:
            if piece is None:  # the longest arc
                node, piece = trie, unit[at]
                for k in range(at, n):
                    node = node.get(unit[k])
                    if node is None:
                        break
                    if "" in node:
                        piece = node[""]
            end = at + len(piece)
            fits = joins.get((last, piece)) if end not in dead else False
            if fits is None:
                fits = self.weight(last, piece) == 0.0
            if fits:
                out.append(piece)
                at, last, piece = end, piece, None
                continue
            piece = shorter.get(piece)
            while piece is None:
                dead.add(at)
                gone = out.pop()
                at, last, piece = at - len(gone), out[-1] if out else "", shorter.get(gone)
        return out

    def shortest(self, unit: str) -> list[str]:
        """Pieces of the shortest path through one word; a character without a piece stands for
        itself.  For equal weights the path with the longer last piece counts."""
        if self.model.kind == BPE:
            return self.merges(unit)
        n = len(unit)
        cost = [FAR] * (n + 1)
        back = [0] * (n + 1)
        last = [""] * (n + 1)
        cost[0] = 0.0
        for i in range(n):
            if cost[i] == FAR:
                continue
            for j in range(i + 1, min(n, i + self.longest) + 1):
                piece = unit[i:j]
                if piece not in self.heads and j > i + 1:
                    break
                if piece in self.id_of or j == i + 1:
                    w = cost[i] + self.weight(last[i], piece)
                    if w < cost[j]:
                        cost[j], back[j], last[j] = w, i, piece
        out = []
        while n:
            out.append(last[n])
            n = back[n]
        return out[::-1]

    def ids(self, unit: str) -> bytes:
        found = []
        for piece in self.shortest(unit):
            if piece in self.id_of:
                found.append(self.id_of[piece])
            elif self.model.fallback:
                found += [self.byte_id[b] for b in piece.encode()]
            elif not found or found[-1] != self.unknown:
                found.append(self.unknown)
        return struct.pack(f"<{len(found)}i", *found)

    def units(self, text: str) -> list[str]:
        text = self.normalised(text)
        if ODD.search(text) or not text.startswith(BLANK):
            return UNIT.findall(text)
        return [BLANK + w for w in text[1:].split(BLANK)]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit bytes."""
        if self.model.prefix and BLANK not in text:
            words = text.split(" ")
            if "" not in words:
                return b"".join(map(self.plain.__getitem__, words))
        return b"".join(map(self.known.__getitem__, self.units(text)))

    def decode(self, ids: Iterator[int]) -> str:
        out = self.out
        text = b"".join([out[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.model.prefix and text.startswith(" ") else text


_COMPILED: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """The compiled model, once a process."""
    if path not in _COMPILED:
        with open(path, "rb") as f:
            _COMPILED[path] = Transducer(Model(f.read()))
    return _COMPILED[path]


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """Ids of every row's whole text: doc_id, n_tokens, ids, round_trip.

    ``round_trip`` tells whether decoding the ids gives the normalised text again.  Null and empty
    texts have no ids.  Ids may repeat or be null; other columns are ignored; an empty table gives
    no rows.  ``model`` is a path that every executor has, as installed packages are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(model)
        for part in text_slices(batches, "text"):
            codes, fits = [], []
            for text in part["text"].to_pylist():
                code = np.frombuffer(t.encode(text or ""), "<i4")
                plain = t.normalised(text or "").replace(BLANK, " ")
                fits.append(t.decode(code.tolist()) == (plain[1:] if t.model.prefix else plain))
                codes.append(code)
            sizes = np.array([len(c) for c in codes], np.int64)
            ends = pa.array(np.cumsum([0, *sizes]), pa.int32())
            ids = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(codes), pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], pa.array(sizes), ids, pa.array(fits)],
                ["doc_id", "n_tokens", "ids", "round_trip"],
            )

    source = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    return source.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, round_trip boolean")


def decoded(tokens: DataFrame, model: str, column: str = "ids") -> DataFrame:
    """The rows with ``text``, decoded from an array of ids; a null array gives a null text."""

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        t = transducer(model)
        return ids.map(lambda x: None if x is None else t.decode(x))

    return tokens.withColumn("text", text(column))
