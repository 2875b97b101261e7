"""Best-two-fit packing of whole documents into as few windows as can be found.

A window is filled greedily, largest document first; then its smallest document gives way to two
unpacked ones, if a pair fills the room it leaves more tightly.  Sizes are small integers, so the
choices depend on the number of documents of each size only, and a window that can be built once
can be built as often as the counts allow.  The work is therefore

* one pass that tokenises, cuts what is longer than a window and numbers the pieces of each size
  within its task;
* the counts of sizes, at most ``window`` numbers, from which the driver lays out *patterns*: a
  window's sizes and how often it is repeated;
* one pass that looks up the place of the k-th piece of a size.

The packing is that of all documents at once, however they are dealt to tasks, and no document
goes through the driver or is moved.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.common import Tables, text_slices
from plumbline.llm.tokens import SLICE_BYTES, encoder

WINDOW = 2048
END = 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def _window(counts: dict[int, int], sizes: list[int], room: int) -> tuple[dict[int, int], int]:
    """Sizes of the next window (size -> copies) and the room that stays empty.

    ``sizes`` are those with a positive count, ascending; neither argument is changed.
    """
    used: dict[int, int] = {}
    upto = len(sizes)
    while room and (upto := bisect_right(sizes, room, 0, upto)):
        size = sizes[upto - 1]
        take = min(counts[size], room // size)
        used[size] = take
        room -= take * size
        upto -= 1  # either all of this size are taken or no other fits
    while room:
        small = min(used)
        pair = _pair(counts, used, sizes, small, room + small)
        if pair is None:
            break
        used[small] -= 1
        if not used[small]:
            del used[small]
        for size in pair:
            used[size] = used.get(size, 0) + 1
        room += small - sum(pair)
    return used, room


def _pair(counts, used, sizes, small: int, room: int) -> tuple[int, int] | None:
    """Two unpacked sizes of the largest sum in (small, room], the more even pair last."""

    def left(size: int) -> int:
        return counts[size] - used.get(size, 0)

    best, found = small, None
    low, high = 0, bisect_left(sizes, room) - 1  # the larger is below the room, the smaller not empty
    while low <= high:
        a, b = sizes[low], sizes[high]
        if left(a) < 1:
            low += 1
        elif left(b) < 1 or a + b > room or (low == high and left(a) < 2):
            high -= 1
        else:
            if a + b > best:
                best, found = a + b, (a, b)
                if best == room:
                    break
            low += 1
    return found


def patterns(counts: dict[int, int], window: int = WINDOW) -> Iterator[tuple[dict[int, int], int]]:
    """(size -> copies, repeats) of the windows that hold ``counts`` pieces of each size."""
    counts = {s: n for s, n in counts.items() if n > 0}
    sizes = sorted(counts)
    while sizes:
        used, _ = _window(counts, sizes, window)
        repeats = min(counts[s] // n for s, n in used.items())
        yield used, repeats
        for size, n in used.items():
            counts[size] -= n * repeats
            if not counts[size]:
                del counts[size]
                del sizes[bisect_left(sizes, size)]


class Layout:
    """Place of the k-th piece of a size, looked up for many pieces at once."""

    def __init__(self, counts: dict[int, int], window: int = WINDOW):
        taken = dict.fromkeys(counts, 0)
        rows: list[tuple[int, int, int, int, int]] = []
        self.windows = 0
        for used, repeats in patterns(counts, window):
            offset = 0
            for size in sorted(used, reverse=True):
                copies = used[size]
                rows.append((size, taken[size], copies, self.windows, offset))
                taken[size] += copies * repeats
                offset += copies * size
            self.windows += repeats
        table = np.array(sorted(rows), np.int64).reshape(len(rows), 5)
        self.size, self.first, self.copies, self.window, self.offset = table.T
        self.key = (self.size << 48) + self.first

    def place(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, offset in it) of the pieces ``rank`` of ``size``."""
        at = np.searchsorted(self.key, (size << 48) + rank, side="right") - 1
        window, slot = np.divmod(rank - self.first[at], self.copies[at])
        return self.window[at] + window, self.offset[at] + slot * size


def cut_pieces(
    docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text",
    window: int = WINDOW, end: int = END,
) -> DataFrame:
    """Pieces of the tokenised documents, numbered within (task, length) by ``nth``.

    A document's ids and its end id are one piece, or pieces of ``window`` ids behind a first one
    that may be shorter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        code, last = encoder(tokenizer), np.array([end], "<u4").tobytes()
        seen = [0] * (window + 1)
        names = [x.split()[0] for x in PIECES.split(", ")]
        for rows in text_slices(batches, "text", SLICE_BYTES):
            out: list[tuple] = []
            ids = code.encode([t or "" for t in rows["text"].to_pylist()])
            for doc, tokens in zip(rows["id"].to_pylist(), ids, strict=True):
                tokens += last
                size = len(tokens) // 4
                start, upto, piece = 0, size % window or window, 0
                while start < size:
                    length = upto - start
                    crc = zlib.crc32(tokens[4 * start : 4 * upto])
                    out.append((doc, piece, start, length, crc, part, seen[length]))
                    seen[length] += 1
                    start, upto, piece = upto, upto + window, piece + 1
            if out:
                kinds = [pa.int32() if n in ("piece", "part") else pa.int64() for n in names]
                arrays = [pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names)

    source = docs.selectExpr(f"cast(`{id_column}` as long) id", f"`{text_column}` text")
    return source.mapInArrow(run, PIECES)


def best_two_fit(
    docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text",
    window: int = WINDOW, end: int = END,
) -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Only documents of more than ``window`` ids are cut.  Sequences are numbered from 0 without
    gaps, and the pieces of one lie in it from 0 without gaps, longest first.  A null or empty
    text is one end id; ids may repeat or be null, since pieces are known by task and number;
    other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    tables = Tables(spark)
    pieces = tables.store(cut_pieces(docs, tokenizer, id_column, text_column, window, end))
    counts = tables.store(pieces.groupBy("part", "length").agg(F.count("*").alias("n")))
    sizes = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most ``window`` rows
    layout = spark.sparkContext.broadcast(Layout({r["length"]: r["n"] for r in sizes}, window))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = layout.value
        for rows in batches:
            size, rank = rows["length"].to_numpy(), rows["rank"].to_numpy()
            number, offset = plan.place(size, rank)
            arrays = [*rows.columns[:5], pa.array(number), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(arrays, [*rows.schema.names[:5], "sequence_id", "offset"])

    ranked = pieces.join(bases, ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank")
    )
    return ranked.mapInArrow(put, PLACED)
