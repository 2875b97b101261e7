"""Near duplicates by b-bit MinHash.

Per document the minima of ``BANDS * ROWS`` hash functions over its distinct word shingles are
taken.  Whole minima make the band keys that find candidates; of each minimum only the low two bits
are kept, packed into ``BANDS * ROWS / 32`` longs, and the share of equal pairs of bits, corrected
for the quarter that agrees by chance, estimates a candidate pair's similarity by bit counts.
An odd sketch (whether the number of shingles that fall on a bit is odd) bounds the number of
shingles that are in one set only from below, so it drops no linked pair.  What both leave is
confirmed on the full shingle sets.

Groups are found without emitting all pairs of a bucket: a round of stars (each document against a
few centres of its buckets) joins most of a group, and only documents that are still in different
groups, share a bucket and pass both bounds are emitted in the last, complete round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import Tables, Words, bucket_groups, connected, mix, rolling, text_slices

SHINGLE = 5
PERCENT = 85
BANDS, ROWS = 32, 7  # a pair of similarity 0.85 misses every band with a chance of 4e-6
LONGS = BANDS * ROWS // 32  # two bits a minimum
SLACK = 0.15  # five standard deviations of the estimate at 0.85
SKETCH = 8  # longs of the odd sketch
STAR_ROUNDS = 1
SIGNS = [*(f"s{i}" for i in range(LONGS)), *(f"o{i}" for i in range(SKETCH))]
SCHEMA = "id long, mark string, key binary, n_shingles long, bands array<long>, " + ", ".join(
    f"{c} long" for c in SIGNS
)


def _functions() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(85)
    a = r.integers(0, 2**31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    return a, r.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)


def minima(shingles: np.ndarray) -> np.ndarray:
    """Minimum of every hash function over 64-bit shingles, in blocks that stay in the cache."""
    a, b = _functions()
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), 2**32 - 1, np.uint32)
    for at in range(0, len(x), 256):
        np.minimum(out, (x[at : at + 256, None] * a + b).min(axis=0), out=out)
    return out


def band_keys(m: np.ndarray) -> np.ndarray:
    """One key a band, which names the band and its minima."""
    parts = m.reshape(BANDS, ROWS).astype(np.uint64)
    key = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    for k in range(ROWS):
        key = mix(key + parts[:, k] + np.uint64(k))
    return key.view(np.int64)


def packed(m: np.ndarray) -> np.ndarray:
    two = (m & np.uint32(3)).astype(np.uint64).reshape(LONGS, 32)
    return (two << np.arange(0, 64, 2, dtype=np.uint64)).sum(axis=1, dtype=np.uint64).view(np.int64)


def odd_sketch(shingles: np.ndarray) -> np.ndarray:
    """Parity of the number of distinct shingles that fall on each of ``64 * SKETCH`` bits."""
    bits = np.bincount((shingles % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH)
    return np.packbits((bits & 1).astype(bool), bitorder="little").view(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for part in text_slices(batches, "text"):
        words = Words(part["text"], lower=True)
        every = rolling(words.hash, width, 0xD1342543DE82EF95)
        rows = []
        whole = words.data
        for row in range(len(words)):
            a, b = int(words.first[row]), int(words.first[row + 1])
            if a == b:
                rows.append((None, 0, None, *[None] * len(SIGNS)))
                continue
            sequence = b" ".join(
                whole[words.start[a] : words.end[b - 1]].tobytes().lower().split()
            )
            key = hashlib.blake2b(sequence, digest_size=16).digest()
            if b - a < width:
                found = np.array([int.from_bytes(key[:8], "little")], np.uint64)
            else:
                found = np.unique(every[a : b - width + 1])
            m = minima(found)
            rows.append((key, len(found), band_keys(m), *packed(m).tolist(), *odd_sketch(found).tolist()))
        columns = list(zip(*rows, strict=True))
        kinds = [pa.binary(), pa.int64(), pa.list_(pa.int64())] + [pa.int64()] * len(SIGNS)
        arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
        names = ["id", "mark", "key", "n_shingles", "bands", *SIGNS]
        yield pa.RecordBatch.from_arrays([part["id"], part["mark"], *arrays], names)


def shingle_set(text: str, width: int = SHINGLE) -> set:
    """The full set, by the words themselves."""
    words = text.encode("utf-8", "replace").lower().split()
    if len(words) < width:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(width)), strict=False))


def _confirm(batches: Iterator[pd.DataFrame], percent: int, width: int) -> Iterator[pd.DataFrame]:
    last, kept = None, set()  # pairs arrive sorted by their first document
    for part in batches:
        linked = []
        for a, x, y in zip(part["a"], part["text_a"], part["text_b"], strict=True):
            if a != last:
                last, kept = a, shingle_set(x, width)
            other = shingle_set(y, width)
            both = len(kept & other)
            linked.append(100 * both >= percent * (len(kept) + len(other) - both))
        yield part.loc[np.array(linked, bool)].drop(columns=["text_a", "text_b"])


def _agreement(x: str, y: str):
    """Count of equal two-bit minima of two signatures."""
    mask = 0x5555555555555555
    differ = None
    for i in range(LONGS):
        z = F.col(f"{x}.s{i}").bitwiseXOR(F.col(f"{y}.s{i}"))
        z = z.bitwiseOR(F.shiftrightunsigned(z, 1)).bitwiseAND(F.lit(mask))
        differ = F.bit_count(z) if differ is None else differ + F.bit_count(z)
    return F.lit(BANDS * ROWS) - differ


def likeness(x: str, y: str, percent: int = PERCENT, slack: float = SLACK) -> Column:
    """Whether set sizes, the corrected estimate and the odd sketches allow a link."""
    nx, ny = F.col(f"{x}.n_shingles"), F.col(f"{y}.n_shingles")
    sizes = F.least(nx, ny) * 100 >= F.greatest(nx, ny) * percent
    estimate = (_agreement(x, y) / (BANDS * ROWS) - 0.25) / 0.75
    apart = F.lit(0)  # shingles in one set only, at least
    for i in range(SKETCH):
        apart = apart + F.bit_count(F.col(f"{x}.o{i}").bitwiseXOR(F.col(f"{y}.o{i}")))
    close = apart * (100 + percent) <= (nx + ny) * (100 - percent)
    return sizes & (estimate >= percent / 100 - slack) & close


def near_groups(
    docs: DataFrame, percent: int = PERCENT, width: int = SHINGLE, rounds: int = STAR_ROUNDS
) -> DataFrame:
    """Connected group of every row: doc_id, n_shingles, component_id, kept.

    Words are runs of other than white space, lower-cased in A-Z; a text of fewer words than a
    shingle is one shingle; null texts and those without words are linked with nothing.  Rows of
    equal word sequences are one class from the start, however many, and only classes are compared.
    Rows that share a doc_id are one document, linked by each of its texts.  Null ids are not linked
    and keep a null component.  Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    tables = Tables(spark)
    source = docs.select(F.col("doc_id").cast("long").alias("id"), F.md5("text").alias("mark"), "text")
    signed = tables.store(source.mapInArrow(lambda it: _signatures(it, width), SCHEMA))
    members = signed.where("id is not null and key is not null").select("id", "key")
    # a class is a word sequence, named by its digest; one row of it stands for all
    signs = ["n_shingles", *SIGNS]
    known = signed.where("id is not null and key is not null")
    classes = known.groupBy("key").agg(F.min(F.struct("id", "mark", *signs, "bands")).alias("c"))
    classes = tables.store(classes.select(F.col("key").alias("node"), "c.*"))
    buckets = classes.select("node", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    buckets = tables.store(buckets.join(shared.select("bucket"), "bucket"))
    # texts of classes that share a bucket, the only ones that are ever compared
    near = classes.select("node", "id", "mark").join(buckets.select("node").distinct(), "node")
    texts = source.join(near, ["id", "mark"]).select("node", "text")
    texts = tables.store(texts.dropDuplicates(["node"]))

    def confirmed(pairs: DataFrame) -> DataFrame:
        sided = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
        return sided.select(*pairs.columns, "text_a", "text_b").mapInPandas(
            lambda it: _confirm(it, percent, width), pairs.schema
        )

    traits = classes.select("node", F.struct(*signs).alias("t"))
    alike = lambda x, y: likeness(x, y, percent)
    groups = bucket_groups(tables, buckets, traits, alike, confirmed, rounds)
    placed = members.join(groups, F.col("key") == F.col("node"), "left")
    placed = tables.store(placed.select("id", F.coalesce("root", "key").alias("root")).distinct())
    # an id with texts in several groups makes them one
    several = placed.groupBy("id").agg(F.min("root").alias("a"), F.max("root").alias("z"))
    bridges = placed.join(several.where("a <> z").select("id", "a"), "id").where("a <> root")
    bridges = tables.store(bridges.select("a", F.col("root").alias("b")).distinct())
    if bridges._rows:
        moved = connected(tables, bridges).toDF("root", "new")
        placed = placed.join(moved, "root", "left").select("id", F.coalesce("new", "root").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("id").alias("component"))
    roots = placed.join(smallest, "root").select("id", "component").distinct()
    out = signed.select("id", "n_shingles").join(roots, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias("doc_id"), "n_shingles", component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )


def near_dedup(docs: DataFrame) -> DataFrame:
    """The documents of which one stays in each group, with their columns; null ids stay."""
    gone = near_groups(docs).where("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti")
