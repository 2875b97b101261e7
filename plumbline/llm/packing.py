"""Packing of tokenised documents into windows of several lengths, without padding.

Documents are tokenised and packed block by block inside each task, in one pass without a shuffle,
so memory holds one block and a lost executor costs its own tasks.  In a block:

* a document's full long windows are cut off first, and the rest is routed to the smallest tier
  (a power of two) that holds it;
* every tier packs its rests, longest first, into windows of its length by best fit, and what fits
  no open window opens one;
* gaps of a tier's windows are filled from the shorter tiers, by whole rests where they fit and by
  a cut rest last;
* the rest of the block, less than one window, is laid out as windows of falling powers of two;
* windows of one length are dealt to step groups of equal token counts.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from plumbline.llm import tokens as ids_of
from plumbline.llm.common import text_slices

WINDOW = 2048
TIERS = (256, 512, 1024, 2048)
END = 1
BLOCK_TOKENS = 1 << 21
STEP_TOKENS = 1 << 16
CACHE_ENTRIES = 400_000  # pieces in each generation of the memory
TASK_BITS = 33  # sequence and group numbers start with the task's number
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
    "offset long, sequence_length long, step_group long"
)


class Encoder(ids_of.Encoder):
    def __init__(self, path: str):
        super().__init__(path, CACHE_ENTRIES * ids_of.ENTRY_BYTES)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pack(lengths: list[int], tiers=TIERS) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Windows of one block: (length, [(item, start, size), ...]); every token is in one piece.

    All windows are full, and their lengths are tiers or, at the end of the block, smaller powers
    of two.
    """
    tiers = sorted(tiers)
    top = tiers[-1]
    windows: list[tuple[int, list[tuple[int, int, int]]]] = []
    rests: dict[int, list[tuple[int, int, int]]] = {t: [] for t in tiers}  # (size, item, start)
    for item, n in enumerate(lengths):
        at = 0
        while n - at >= top:
            windows.append((top, [(item, at, top)]))
            at += top
        if n > at:
            tier = next(t for t in tiers if t >= n - at)
            insort(rests[tier], (n - at, item, at))
    for k in range(len(tiers) - 1, -1, -1):
        tier = tiers[k]
        open_: list[tuple[int, int]] = []  # (room, number), sorted
        packed: list[list[tuple[int, int, int]]] = []
        for size, item, start in reversed(rests[tier]):
            at = bisect_right(open_, (size - 1, len(packed)))
            if at < len(open_):
                room, number = open_.pop(at)
            else:
                room, number = tier, len(packed)
                packed.append([])
            packed[number].append((item, start, size))
            if room > size:
                insort(open_, (room - size, number))
        rests[tier] = []
        # gaps, widest last: whole rests of shorter tiers, then a cut one
        for room, number in open_:
            for short in reversed(tiers[:k]):
                while room and rests[short]:
                    at = bisect_right(rests[short], (room, float("inf"), 0))
                    if not at:
                        break
                    size, item, start = rests[short].pop(at - 1)
                    packed[number].append((item, start, size))
                    room -= size
            for short in tiers[:k]:
                if room and rests[short]:  # all that is left is longer than the gap
                    size, item, start = rests[short].pop()
                    packed[number].append((item, start, room))
                    left = size - room
                    insort(rests[next(t for t in tiers if t >= left)], (left, item, start + room))
                    room = 0
            if room:  # no shorter rest is left: the window is taken apart for the block's end
                rests.setdefault(0, []).extend((s, i, a) for i, a, s in packed[number])
                packed[number] = []
        windows += [(tier, p) for p in packed if p]
    # what is left is laid end to end and cut into tiers, then falling powers of two
    queue = sorted(rests.get(0, ()), key=lambda x: (x[1], x[2]))
    left = sum(s for s, _, _ in queue)
    queue.reverse()
    while left:
        size = top if left >= top else 1 << (left.bit_length() - 1)
        room, window = size, []
        while room:
            s, item, start = queue.pop()
            take = min(s, room)
            window.append((item, start, take))
            if s > take:
                queue.append((s - take, item, start + take))
            room -= take
        windows.append((size, window))
        left -= size
    return windows


def _block(
    ids: list[int], tokens: list[bytes], number: int, filled: dict[int, int] | None = None
) -> tuple[pa.RecordBatch, int]:
    """Pieces of one block, and the next sequence number.

    ``filled`` counts the windows of each length in the task's blocks so far.
    """
    lengths = [len(t) // 4 for t in tokens]
    out: list[tuple] = []
    filled = {} if filled is None else filled
    task = number >> TASK_BITS << TASK_BITS
    for size, pieces in pack(lengths):
        # windows of one length fill step groups of equal token counts, block after block
        dealt = filled[size] = filled.get(size, -1) + 1
        group = task | (size.bit_length() << 28) | (dealt * size // STEP_TOKENS)
        offset = 0
        for item, start, length in pieces:
            code = zlib.crc32(tokens[item][4 * start : 4 * (start + length)])
            out.append((ids[item], start, length, code, lengths[item], number, offset, size, group))
            offset += length
        number += 1
    arrays = [pa.array(x, pa.int64()) for x in zip(*out, strict=True)]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays(arrays, names), number


def packed(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text"):
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    sequence_length, step_group.

    A null or empty text is one end token.  Every id of a document, with its end token, is in one
    piece; a text of any length is cut over as many windows as it fills.  Sequences carry no
    padding.  Ids may repeat or be null; other columns are ignored; an empty table gives no rows.
    Sequence numbers are unique over all tasks and the same when a task runs again.  A step group
    has ``STEP_TOKENS`` tokens in windows of one length, but for the last one of a task and length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << TASK_BITS
        filled: dict[int, int] = {}
        code, end = encoder(tokenizer), np.asarray([END], "<u4").tobytes()
        ids: list[int] = []
        tokens: list[bytes] = []
        held = 0
        for part in text_slices(batches, "text", ids_of.SLICE_BYTES):
            for doc, t in zip(part["id"].to_pylist(), code.encode([x or "" for x in part["text"].to_pylist()]), strict=True):
                ids.append(doc)
                tokens.append(t + end)
                held += len(t) // 4 + 1
            if held >= BLOCK_TOKENS:
                batch, number = _block(ids, tokens, number, filled)
                yield batch
                ids, tokens, held = [], [], 0
        if ids:
            yield _block(ids, tokens, number, filled)[0]

    source = docs.selectExpr(f"cast(`{id_column}` as long) id", f"`{text_column}` text")
    return source.mapInArrow(run, SCHEMA)
