"""Repeated passages of at least ``WIDTH`` words, found by locally consistent naming.

The parse is that of recompression: words get global names (fingerprints, so that no dictionary
has to travel), the names are parted into left and right by one of their bits, and wherever a left
name meets a right name the two become a pair symbol.  Where pairs stand depends on the words
alone, so equal passages have equal symbols inside.  A pair symbol is carried up to the phrase
around it, three words to either side; a window without any pair (one run of equal words, or a few
falling names) is its own symbol.  Then, in Spark:

1. Texts of equal word sequences are one class, by a digest of the whole sequence (the root of its
   parse); only the smallest doc_id of a class goes on, the others repeat it from end to end.
2. Symbols are grouped; those of one class only cannot lie in a repeated window.
3. Windows all of whose symbols are shared are fingerprinted with 96 bits and grouped, which
   verifies them and finds the smallest document each starts in.
4. Words under windows that a smaller document has are removed.

Groups are reduced by partial minima and maxima, so a passage that a third of all documents share
is a few rows a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import Tables, Words, rolling, text_slices

WIDTH = 13
PHRASE = 8  # words of a pair symbol with three words on either side
SIDE = 3
BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
EMPTY = hashlib.sha256(b"").hexdigest()


class Parse:
    """Symbols of a slice of texts.  All arrays are by word of the slice."""

    def __init__(self, column: pa.Array, width: int = WIDTH):
        self.words = words = Words(column)
        h, n = words.hash, len(words.hash)
        left = (h >> np.uint64(63)).astype(bool)
        ends = np.repeat(words.first[1:], np.diff(words.first))
        place = np.arange(n)
        self.window = place + width <= ends  # a window starts here
        self.pair = np.zeros(n, bool)  # a phrase with a pair in its middle starts here
        phrases = n - PHRASE + 1
        if phrases > 0:
            at = np.arange(phrases)
            self.pair[:phrases] = left[at + SIDE] & ~left[at + SIDE + 1]
            self.pair &= place + PHRASE <= ends
        self.phrase = self._padded(rolling(h, PHRASE, BASES[0]))
        self.prints = [self._padded(rolling(h, width, b)) for b in BASES]
        self.bare = self.window & ~self.within(self.pair, width)

    def _padded(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.words.hash), np.uint64)
        out[: len(values)] = values
        return out

    def within(self, marks: np.ndarray, width: int) -> np.ndarray:
        """Whether a marked phrase lies in the window that starts at each word."""
        total = np.zeros(len(marks) + 1, np.int64)
        np.cumsum(marks, out=total[1:])
        start = np.arange(len(marks))
        stop = np.minimum(start + width - PHRASE + 1, len(marks))
        return total[stop] > total[start]

    def symbols(self, row: int) -> np.ndarray:
        a, b = self.words.first[row], self.words.first[row + 1]
        return np.unique(
            np.concatenate([self.phrase[a:b][self.pair[a:b]], self.prints[0][a:b][self.bare[a:b]]])
        )

    def candidates(self, row: int, shared: np.ndarray, width: int) -> np.ndarray:
        """Window starts all of whose symbols are shared."""
        a, b = self.words.first[row], self.words.first[row + 1]
        alone = self.pair[a:b] & ~np.isin(self.phrase[a:b], shared)
        own = self.bare[a:b] & ~np.isin(self.prints[0][a:b], shared)
        return np.flatnonzero(self.window[a:b] & ~own & ~self.within(alone, width))


def _joined(words: Words, row: int, whole: bytes) -> bytes:
    a, b = words.first[row], words.first[row + 1]
    return b" ".join(whole[words.start[a] : words.end[b - 1]].split()) if b > a else b""


def _heads(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for part in text_slices(batches, "text"):
        parse = Parse(part["text"], width)
        whole = parse.words.data.tobytes()
        sizes = np.diff(parse.words.first)
        digest, symbols = [], []
        for row in range(part.num_rows):
            digest.append(hashlib.sha256(_joined(parse.words, row, whole)).hexdigest())
            symbols.append(parse.symbols(row).view(np.int64) if sizes[row] >= width else [])
        yield pa.RecordBatch.from_arrays(
            [part["id"], part["row"], pa.array(sizes, pa.int64()), pa.array(digest, pa.string()),
             pa.array(symbols, pa.list_(pa.int64()))],
            ["id", "row", "n_words", "digest", "symbols"],
        )


def _windows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    names = ["id", "row", "pos", "f1", "f2"]
    for part in text_slices(batches, "text", 1 << 20):
        parse = Parse(part["text"], width)
        shared = part["shared"]
        found, rows = [], []
        for row in range(part.num_rows):
            known = shared[row].values.to_numpy().view(np.uint64)
            at = parse.candidates(row, known, width)
            rows.append(np.full(len(at), row))
            found.append(at)
        row, at = np.concatenate(rows), np.concatenate(found)
        word = parse.words.first[row] + at
        take = pa.array(row, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [part["id"].take(take), part["row"].take(take), pa.array(at, pa.int32()),
             pa.array(parse.prints[0][word].view(np.int64)),
             pa.array((parse.prints[1][word] >> np.uint64(32)).astype(np.uint32).view(np.int32))],
            names,
        )


def _cut(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    names = ["id", "row", "n_removed", "kept_text", "kept_sha256"]
    for part in text_slices(batches, "text", 1 << 20):
        removed, texts = [], []
        for text, starts in zip(part["text"].to_pylist(), part["starts"], strict=True):
            words = text.encode("utf-8", "replace").split()
            steps = np.zeros(len(words) + 1, np.int64)
            at = starts.values.to_numpy()
            np.add.at(steps, at, 1)
            np.add.at(steps, at + width, -1)
            gone = np.cumsum(steps)[:-1] > 0
            removed.append(int(gone.sum()))
            texts.append(b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g))
        digests = [hashlib.sha256(t).hexdigest() for t in texts]
        yield pa.RecordBatch.from_arrays(
            [part["id"], part["row"], pa.array(removed, pa.int64()),
             pa.array([t.decode() for t in texts], pa.string()), pa.array(digests, pa.string())],
            names,
        )


def repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """What is removed from every row: doc_id, n_words, n_removed, kept_sha256, kept_text.

    Words are runs of other than white space, unchanged.  Every word is removed that a window of
    ``width`` words covers whose words also start, in this order, in a document with a smaller
    doc_id; windows are judged on the input.  ``kept_text`` (words joined by a blank) is null where
    nothing was removed.  Null texts have no words.  Rows of one doc_id never repeat one another,
    whatever their texts; rows with a null id lose nothing and take nothing from others.  Other
    columns are ignored; an empty table gives no rows.
    """
    if width < PHRASE:
        raise ValueError(f"a window has {PHRASE} words at least")
    spark = docs.sparkSession
    tables = Tables(spark)
    source = docs.select(
        F.col("doc_id").cast("long").alias("id"),
        F.xxhash64(F.col("text")).alias("row"),  # tells rows of one id apart
        "text",
    )
    heads = tables.store(
        source.mapInArrow(
            lambda it: _heads(it, width),
            "id long, row long, n_words long, digest string, symbols array<long>",
        )
    )
    long = heads.where(F.col("id").isNotNull() & (F.col("n_words") >= width))
    leaders = long.groupBy("digest").agg(F.min("id").alias("leader"))

    # symbols of more than one class
    named = long.select(F.xxhash64("digest").alias("class"), F.explode("symbols").alias("symbol"))
    extent = named.groupBy("symbol").agg(F.min("class").alias("p"), F.max("class").alias("q"))
    shared = tables.store(extent.where("p < q").select("symbol"))
    marked = named.join(shared, "symbol").groupBy("class").agg(
        F.collect_set("symbol").alias("shared")
    )
    firsts = long.select("id", "row", "digest").join(leaders, "digest")
    firsts = firsts.where("id = leader").select("id", "row", F.xxhash64("digest").alias("class"))
    firsts = tables.store(firsts.distinct().join(marked, "class").select("id", "row", "shared"))
    wide, heads = heads, tables.store(heads.select("id", "row", "n_words", "digest"))
    tables.drop(shared, wide)
    leaders = tables.store(
        heads.where(F.col("id").isNotNull() & (F.col("n_words") >= width))
        .groupBy("digest").agg(F.min("id").alias("leader"))
    )
    sought = tables.store(source.join(firsts, ["id", "row"]).dropDuplicates(["id", "row"]))
    tables.drop(firsts)

    windows = tables.store(
        sought.select("id", "row", "text", "shared").mapInArrow(
            lambda it: _windows(it, width), "id long, row long, pos int, f1 long, f2 int"
        )
    )
    first = windows.groupBy("f1", "f2").agg(F.min("id").alias("p"), F.max("id").alias("q"))
    # written, so that both sides of the join are shuffled and hot windows can be split
    first = tables.store(first.where("p < q").select("f1", "f2", "p"))
    starts = windows.join(first, ["f1", "f2"]).where("id > p")
    starts = tables.store(starts.groupBy("id", "row").agg(F.collect_list("pos").alias("starts")))
    cut = tables.store(
        sought.select("id", "row", "text").join(starts, ["id", "row"]).mapInArrow(
            lambda it: _cut(it, width),
            "id long, row long, n_removed long, kept_text string, kept_sha256 string",
        )
    )
    tables.drop(windows, sought, first)

    rows = heads.select("id", "row", "n_words", "digest").join(leaders, "digest", "left")
    rows = rows.alias("h").join(cut.alias("c"), ["id", "row"], "left")
    copy = F.coalesce((F.col("id") > F.col("leader")) & (F.col("n_words") >= width), F.lit(False))
    return rows.select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(EMPTY)).otherwise(F.coalesce("kept_sha256", "digest")).alias("kept_sha256"),
        F.when(copy, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"),
        "row",
    )


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows with what is left of their texts; rows that lose nothing keep theirs as it is.

    Columns stay as they are, but ``n_chars``, where there is one, follows the text.
    """
    cut = repeats(docs).where("n_removed > 0")
    cut = cut.select(
        F.col("doc_id").alias("_id"), F.col("row").alias("_row"), F.col("kept_text").alias("_kept")
    ).dropDuplicates(["_id", "_row"])
    same = (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_row"))
    joined = docs.join(cut, same, "left")
    left = F.coalesce("_kept", "text")
    columns = {"text": left}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.col("_kept").isNull(), F.col("n_chars")).otherwise(F.length("_kept"))
    return joined.select(
        *(columns[c].cast(docs.schema[c].dataType).alias(c) if c in columns else docs[c] for c in docs.columns)
    )
