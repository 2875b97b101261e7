"""Shared pieces of the training-data operators: stored tables, word hashing, connected groups."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from plumbline.plans.storage import checkpoint_dir

WHITE = b" \t\n\x0b\f\r"


class Tables:
    """Intermediate Parquet tables of one operator call, in the folder that all executors share.

    A written table cuts lineage: a lost executor costs a re-read.  ``drop`` removes a table that
    no later step reads; those behind a returned (lazy) frame stay until the folder expires.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = os.path.join(checkpoint_dir(spark), f"llm-{uuid.uuid4().hex}")
        self.count = 0

    def store(self, df: DataFrame, total: Column | None = None) -> DataFrame:
        """Write and read back; the shuffle files behind the write are released after it.

        The write also counts the rows and adds up ``total``.
        """
        self.count += 1
        path = f"{self.folder}/{self.count}"
        key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = self.spark.conf.get(key, None)
        self.spark.conf.set(key, "true")
        seen = Observation()
        total = F.max(F.lit(0)) if total is None else F.sum(total)
        watched = df.observe(seen, F.count(F.lit(1)).alias("rows"), total.alias("sum"))
        try:
            watched.write.parquet(path)
        finally:
            self.spark.conf.unset(key) if before is None else self.spark.conf.set(key, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._stored_at = path
        out._rows, out._sum = seen.get["rows"], seen.get["sum"]
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
            conf = self.spark._jsc.hadoopConfiguration()
            path.getFileSystem(conf).delete(path, True)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def text_slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 21):
    """Cut Arrow batches into row slices of about ``most`` bytes of text, one row at least."""
    for batch in batches:
        sizes = pc.binary_length(batch[column]).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(at, upto - at)
            at = upto


def table_of(separators: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(separators)] = True
    return out


SPACES = table_of(WHITE)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RANDOM = np.random.default_rng(2024)
_BYTE = _RANDOM.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, as many as asked for."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base & (2**64 - 1), np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words of a slice of texts: 64-bit hashes, and where each text's words begin.

    ``first[i]:first[i + 1]`` are the words of row i; ``start`` and ``end`` are byte positions in
    ``data``, the UTF-8 of all rows together.
    """

    def __init__(self, column: pa.Array, separators=SPACES, lower: bool = False):
        column = column.cast(pa.large_string()).fill_null("")
        rows = len(column)
        ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + rows + 1]
        raw = column.buffers()[2]
        raw = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        data = raw[ends[0] : ends[-1]]
        edges = ends - ends[0]
        inside = ~separators[data]
        before = np.zeros(len(data) + 1, bool)
        before[1:] = inside
        before[edges] = False
        begin = inside & ~before[:-1]
        after = np.zeros(len(data) + 1, bool)
        after[:-1] = inside
        after[edges] = False
        finish = inside & ~after[1:]
        self.data, self.edges = data, edges
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(finish) + 1
        self.first = np.searchsorted(self.start, edges)
        power, inverse = _powers(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[_LOWER[data] if lower else data] * power[: len(data)], out=total[1:])
        self.total, self.inverse = total, inverse
        self.hash = self.span(self.start, self.end)

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of stretches of bytes; those of words are the same for the same bytes."""
        return mix((self.total[end] - self.total[start]) * self.inverse[start])

    def heads(self, size: int) -> np.ndarray:
        """Hashes of the first bytes of each word."""
        return self.span(self.start, np.minimum(self.start + size, self.end))

    def __len__(self) -> int:
        return len(self.first) - 1


def rolling(h: np.ndarray, width: int, base: int) -> np.ndarray:
    """Fingerprint of every ``width`` consecutive hashes."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    factor = np.uint64(base | 1)
    for k in range(1, width):
        out *= factor
        out += h[k : k + n]
    return mix(out)


def connected(tables: Tables, edges: DataFrame) -> DataFrame:
    """Smallest member of each connected group, by alternating large and small stars.

    ``edges`` has two columns of one ordered type, ``a`` and ``b``; the result has ``node`` and
    ``root`` for every node of an edge.  Each round replaces a node's links by links to its smallest
    neighbour, which shortens paths by a constant factor or more; minima are partial aggregates and
    a hot node's links meet one row in a join that Spark may split.  Rounds end when no link
    changes, whatever the depth.
    """

    def links(df):
        return df.where("a <> b").select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
        ).distinct()

    mark = F.xxhash64("a", "b") % (1 << 40)
    now = tables.store(links(edges), mark)
    while now._rows:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("low"))
        large = links(both.where("b > a").join(low, "a").select("b", "low").toDF("a", "b"))
        large = tables.store(large)
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        joined = large.join(low, "a")
        small = links(
            joined.select(F.col("b").alias("a"), F.col("low").alias("b")).unionAll(
                joined.select("a", F.col("low").alias("b"))
            )
        )
        small = tables.store(small, mark)
        tables.drop(now, large)
        done = (now._rows, now._sum) == (small._rows, small._sum)
        now = small
        if done:
            break
    roots = now.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots)


CENTRES = 4


def bucket_groups(
    tables: Tables,
    buckets: DataFrame,
    traits: DataFrame,
    likeness: Callable[[str, str], Column],
    confirmed: Callable[[DataFrame], DataFrame],
    rounds: int = 1,
) -> DataFrame:
    """Connected groups (node, root) of the links among members that share a bucket.

    ``buckets`` has ``bucket`` and ``node``, ``traits`` has ``node`` and a struct ``t``.
    ``likeness(x, y)`` gives, for two such structs, a condition that every linked pair meets.
    ``confirmed`` takes pairs ``a < b`` and returns those that are linked, with the same columns.

    A bucket's pairs are not emitted: in a round every bucket names a few centres, which are the
    same for buckets of the same nodes, each node meets those it may be linked with, and linked
    nodes become one group.  The last round is complete: it compares all nodes that share a bucket
    and are in different groups still, and emits those that meet the condition.  There is the same
    number of rounds for any table.
    """
    groups = tables.store(buckets.select("node").distinct().withColumn("root", F.col("node")))
    placed = buckets.join(traits, "node").select("bucket", "node", F.col("node").alias("root"), "t")
    placed = tables.store(placed)
    for turn in range(rounds + 1):
        if not placed._rows:
            break
        last = turn == rounds
        if not last:
            order = F.struct(F.xxhash64("node", F.lit(turn)).alias("o"), "node", "root", "t")
            salt = F.pmod(F.xxhash64("node", F.lit(turn), F.lit(1)), F.lit(CENTRES))
            centre = placed.groupBy("bucket", salt.alias("salt")).agg(F.min(order).alias("c"))
            met = placed.alias("x").join(centre, "bucket")
            pairs = met.where("root <> c.root").where(likeness("x.t", "c.t")).select(
                "node", "root", F.col("c.node").alias("other"), F.col("c.root").alias("far")
            )
        else:
            same = F.expr("x.bucket = y.bucket and x.node < y.node and x.root <> y.root")
            pairs = placed.alias("x").join(placed.alias("y"), same & likeness("x.t", "y.t"))
            pairs = pairs.select(
                "x.node", "x.root", F.col("y.node").alias("other"), F.col("y.root").alias("far")
            )
        first = F.col("node") < F.col("other")
        sided = [
            F.when(first, F.col(p)).otherwise(F.col(q)).alias(n)
            for n, p, q in (
                ("a", "node", "other"), ("b", "other", "node"), ("ra", "root", "far"), ("rb", "far", "root")
            )
        ]
        found = tables.store(confirmed(pairs.select(*sided).distinct()))
        if found._rows:
            moved = connected(tables, found.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
            moved = moved.toDF("root", "new")
            groups = groups.join(moved, "root", "left")
            groups = tables.store(groups.select("node", F.coalesce("new", "root").alias("root")))
        tables.drop(found)
        if last:
            break
        # buckets that have become one group stay so
        before = placed
        if found._rows:
            placed = placed.drop("root").join(groups, "node")
            live = placed.groupBy("bucket").agg(F.min("root").alias("p"), F.max("root").alias("q"))
            placed = placed.join(live.where("p < q").select("bucket"), "bucket")
            placed = tables.store(placed.select("bucket", "node", "root", "t"))
            tables.drop(before)
    tables.drop(placed)
    return groups
