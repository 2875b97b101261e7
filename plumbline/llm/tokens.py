"""Token ids of whole texts, with a bounded memory of the pieces that texts share."""

from __future__ import annotations

import re
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MEMORY_BYTES = 128 << 20  # of pieces and ids in each of the two generations
ENTRY_BYTES = 250  # what a piece takes in a dictionary, its characters and ids included
SLICE_BYTES = 1 << 23  # of text that is encoded at once
TOGETHER = 4_000  # pieces that one call encodes as one text
_CUT = re.compile(r" (?=\S)")


class Memory:
    """Ids of the pieces that follow a blank, or of those that do not, as 32-bit words.

    Pieces live in two generations: those asked for move to the young one, and when that is full
    the old one is forgotten.  Frequent pieces therefore stay, whatever passes by.
    """

    def __init__(self, encode, most: int):
        self.encode, self.most = encode, max(1, most)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def learn(self, asked) -> dict[str, bytes]:
        """Ids by piece, of all the distinct pieces asked for at least."""
        wanted = [p for p in asked if p not in self.young]
        if len(self.young) + len(wanted) > self.most:
            self.old, self.young, wanted = self.young, {}, asked
        young, old = self.young, self.old
        new = []
        for piece in wanted:
            code = old.get(piece)
            if code is None:
                new.append(piece)
            else:
                young[piece] = code
        young.update(zip(new, self.encode(new), strict=True))
        return young


class Encoder:
    """Ids of whole texts as little-endian 32-bit words, by the tokenizer file.

    The tokenizer's pre-tokens never cross a blank that a visible character follows, so a text is
    encoded piece by piece, and distinct pieces are encoded once while remembered.
    """

    def __init__(self, path: str, memory: int = MEMORY_BYTES):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        vocabulary = self.model.get_vocab()
        # ids that begin with a blank
        self.blank = np.zeros(max(vocabulary.values()) + 1, bool)
        for word, number in vocabulary.items():
            self.blank[number] = word.startswith("\u0120")
        self.heads = Memory(self._each, memory // ENTRY_BYTES // 8)
        self.tails = Memory(self._behind_blanks, memory // ENTRY_BYTES)

    def _each(self, pieces: list[str]) -> list[bytes]:
        coded = self.model.encode_batch_fast(pieces, add_special_tokens=False)
        return [np.asarray(e.ids, "<u4").tobytes() for e in coded]

    def _behind_blanks(self, pieces: list[str]) -> list[bytes]:
        """Pieces that begin with a visible character and hold no blank are encoded as long texts, many
        at once: a piece starts where an id begins with a blank."""
        solid = [p != "" and not p[0].isspace() and " " not in p for p in pieces]
        plain = list(compress(pieces, solid))
        parts = [plain[at : at + TOGETHER] for at in range(0, len(plain), TOGETHER)]
        coded = self.model.encode_batch_fast([" " + " ".join(p) for p in parts], add_special_tokens=False)
        found: list[bytes] = []
        for own, e in zip(parts, coded, strict=True):
            ids = np.asarray(e.ids, "<u4")
            starts = (np.flatnonzero(self.blank[ids]) * 4).tolist()
            if len(starts) == len(own):
                raw = ids.tobytes()
                found += [raw[i:j] for i, j in zip(starts, [*starts[1:], len(raw)], strict=True)]
            else:  # ids that take a blank along
                found += self._each([" " + p for p in own])
        if len(plain) == len(pieces):
            return found
        rest = iter(self._each([" " + p for p, s in zip(pieces, solid, strict=True) if not s]))
        found = iter(found)
        return [next(found if s else rest) for s in solid]

    def _odd(self, text: str) -> bytes:
        """Ids of a text with a blank that no visible character follows."""
        first, *rest = _CUT.split(text)
        tails = self.tails.learn(list(dict.fromkeys(rest)))
        found = b"".join(map(tails.__getitem__, rest))
        return self.heads.learn([first])[first] + found

    def encode(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        # a piece is known by what follows its blank; equal ones are found and laid out by Arrow
        lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        distinct = lists.values.dictionary_encode()
        pieces, number = distinct.dictionary.to_numpy(zero_copy_only=False).tolist(), distinct.indices
        edges = lists.offsets.to_numpy()
        tails = self.tails.learn(pieces)
        codes = pa.array([tails[p] for p in pieces], pa.large_binary()).take(number)
        ends = np.frombuffer(codes.buffers()[1], np.int64)[codes.offset : codes.offset + len(codes) + 1]
        data = memoryview(codes.buffers()[2] or b"")
        number = number.to_numpy()
        firsts = [pieces[n] for n in number[edges[:-1]].tolist()]
        heads = self.heads.learn(list(dict.fromkeys(firsts)))
        # behind the first piece, one that is empty or begins with white space
        odd = np.array([not p or p[0].isspace() for p in pieces])[number]
        odd[edges[:-1]] = False
        odd = np.add.reduceat(odd, edges[:-1], dtype=np.int64) > 0
        start, end = ends[edges[:-1] + 1].tolist(), ends[edges[1:]].tolist()
        out = [heads[f] + data[i:j] for f, i, j in zip(firsts, start, end, strict=True)]
        for row in np.flatnonzero(odd).tolist():
            out[row] = self._odd(texts[row])
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
