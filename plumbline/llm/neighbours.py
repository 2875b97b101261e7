"""Approximate nearest neighbours by a forest of random-projection trees.

The trees are fitted on a bounded sample, chosen by hash; every row is then sent down every tree.
A query walks all trees at once through one priority queue of branches, ordered by the squared
margins on the wrong side of the planes passed, and takes leaves until they hold a share of the
index; the share is calibrated on the sample for ``RECALL``.  Rows of the leaves taken are ranked
by exact distance.  Leaves meet their queries in blocks of bounded size: a leaf that holds many
rows (equal vectors cannot be parted) or that many queries take is cut into several.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.common import Tables

TREES, LEAF = 10, 32
SAMPLE = 20_000  # rows the trees are fitted on
TRIALS = 200  # of these, queries the share is calibrated with
RECALL = 0.97
LEAST = 20_000  # leaf entries a query takes in any case
ROWS, QUERIES = 8192, 4096  # most rows and queries of a block
SPREAD = 1 << 30


class Tree:
    """Planes of the inner nodes; a child below 0 is leaf ``-1 - child``."""

    def __init__(self, points: np.ndarray, random: np.random.Generator, leaf: int):
        planes, offsets, children = [], [], []
        self.leaves = 0

        def leaf_node() -> int:
            self.leaves += 1
            return -self.leaves

        stack = [(np.arange(len(points)), -1, 0)]
        self.root = -1
        while stack:
            own, parent, side = stack.pop()
            split = None if len(own) <= leaf else _plane(points[own], random)
            if split is None:
                node = leaf_node()
            else:
                node = len(planes)
                planes.append(split[0])
                offsets.append(split[1])
                children.append([0, 0])
                right = points[own] @ split[0] > split[1]
                stack += [(own[~right], node, 0), (own[right], node, 1)]
            if parent < 0:
                self.root = node
            else:
                children[parent][side] = node
        self.planes = np.array(planes).reshape(len(planes), points.shape[1])
        self.offsets = np.array(offsets)
        self.children = np.array(children, int).reshape(len(planes), 2)

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        node = np.full(len(points), self.root)
        while (live := np.flatnonzero(node >= 0)).size:
            at = node[live]
            right = np.einsum("ij,ij->i", points[live], self.planes[at]) > self.offsets[at]
            node[live] = self.children[at, right.astype(int)]
        return -1 - node


def _plane(points: np.ndarray, random: np.random.Generator):
    """The plane halfway between two of the points that parts them, or None."""
    for _ in range(8):
        a, b = points[random.choice(len(points), 2, replace=False)]
        w = a - b
        size = np.sqrt(w @ w)
        if size == 0:
            continue
        w = w / size
        offset = w @ (a + b) / 2
        right = points @ w > offset
        if right.any() and not right.all():
            return w, offset
    return None


class Forest:
    def __init__(self, points: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = 7):
        random = np.random.default_rng(seed)
        self.trees = [Tree(points, random, leaf) for _ in range(trees)]
        self.first = np.cumsum([0, *(t.leaves for t in self.trees)])

    def leaves_of(self, points: np.ndarray) -> np.ndarray:
        """Leaf numbers, unique over all trees, one column a tree."""
        return np.stack([t.leaf_of(points) + f for t, f in zip(self.trees, self.first, strict=False)], 1)

    def walk(self, q: np.ndarray) -> Iterator[int]:
        """Leaves of all trees, likeliest first."""
        margins = [t.planes @ q - t.offsets for t in self.trees]
        queue = [(0.0, k, t.root) for k, t in enumerate(self.trees)]
        heapq.heapify(queue)
        while queue:
            cost, k, node = heapq.heappop(queue)
            while node >= 0:  # follow the near side, remember the far one
                m = margins[k][node]
                near = int(m > 0)
                far = self.trees[k].children[node, 1 - near]
                heapq.heappush(queue, (cost + m * m, k, int(far)))
                node = int(self.trees[k].children[node, near])
            yield int(self.first[k] - 1 - node)


def calibrated(forest: Forest, points: np.ndarray, k: int, trials: int = TRIALS) -> float:
    """Share of the index after which ``RECALL`` of the sample's true neighbours were met."""
    leaves = forest.leaves_of(points)
    sizes = np.bincount(leaves.ravel(), minlength=forest.first[-1])
    asked = np.linspace(0, len(points) - 1, min(trials, len(points))).astype(int)
    needed = []
    for i in asked:
        d = ((points - points[i]) ** 2).sum(1)
        d[i] = np.inf
        wanted = np.argsort(d, kind="stable")[: min(k, len(points) - 1)]
        place = {}
        mass = 0
        homes = set(leaves[wanted].ravel().tolist())
        for leaf in forest.walk(points[i]):
            mass += sizes[leaf]
            if leaf in homes:
                place.setdefault(leaf, mass)
                if len(place) == len(homes):
                    break
        needed += [min(place[x] for x in own if x in place) for own in leaves[wanted].tolist()]
    return float(np.quantile(needed, RECALL) / sizes.sum()) if needed else 1.0


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _distance(points: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean, added up dimension by dimension."""
    total = np.zeros(len(points))
    for j in range(points.shape[1]):
        step = points[:, j] - q[j]
        total += step * step
    return np.sqrt(total)


def _ranked(rows: pa.Table, probes: pa.Table, k: int) -> pa.Table:
    """Of one block, each query's ``k`` nearest rows, ties to the smaller id."""
    ids, points = rows["vec_id"].to_numpy(), _matrix(rows["v"])
    asked, queries = probes["query_id"].to_numpy(), _matrix(probes["v"])
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if len(ids) and len(asked):
        norms = (points * points).sum(1)
        for at in range(0, len(asked), 256):
            part = queries[at : at + 256]
            sizes = (part * part).sum(1)
            rough = norms + sizes[:, None] - 2 * part @ points.T
            rough[ids == asked[at : at + 256, None]] = np.inf
            last = np.partition(rough, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1]
            # whatever rounding may have put behind the last one is ranked exactly too
            slack = 1e-9 * (sizes + norms.max())
            for i in range(len(part)):
                near = np.flatnonzero((rough[i] <= last[i] + slack[i]) & np.isfinite(rough[i]))
                exact = _distance(points[near], part[i])
                best = np.lexsort((ids[near], exact))[:k]
                found.append((np.full(len(best), asked[at + i]), ids[near][best], exact[best]))
    columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0)] * 3
    kinds = (pa.int64(), pa.int64(), pa.float64())
    arrays = [pa.array(c.astype(t.to_pandas_dtype())) for c, t in zip(columns, kinds, strict=True)]
    return pa.table(arrays, ["query_id", "vec_id", "score"])


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and v of rows that take part: of the commonest length, finite and not zero."""
    clean = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    rows = rows.where("vec_id is not null and v is not null").where(F.coalesce(clean & some, F.lit(False)))
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").head(1)
    return rows.where(F.size("v") == (lengths[0]["n"] if lengths else 0))


def nearest(
    vectors: DataFrame, every: int = 100, k: int = 10, sample: int = SAMPLE, least: int = LEAST
) -> DataFrame:
    """``k`` nearest rows of every row whose vec_id is divisible by ``every``: query_id, rank,
    vec_id, score.

    Nearness is the smallest Euclidean distance in double precision, ties to the smaller vec_id.
    Candidates are all rows but those of the query's own vec_id.  Null and zero vectors, those with
    null or non-finite components or of another length than most, and null ids take no part.  Rows
    that repeat a vec_id are one candidate, at its nearest; as a query their lists are merged.
    With ``least`` leaf entries or fewer in the index the result is exact.  Other columns are
    ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    tables = Tables(spark)
    rows = tables.store(usable(vectors))
    share = min(1.0, sample / max(1, rows._rows))
    chosen = rows.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(SPREAD)) < int(share * SPREAD))
    picked = chosen.select("v").limit(2 * sample).toArrow()["v"]  # about ``sample`` rows
    points = _matrix(picked)
    forest = Forest(points) if len(points) else Forest(np.zeros((1, 1)), 1)
    part = calibrated(forest, points, k)
    shared = spark.sparkContext.broadcast(forest)  # trees over at most 2 * sample points

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                leaves = shared.value.leaves_of(_matrix(b["v"])).astype(np.int32)
                nested = pa.FixedSizeListArray.from_arrays(pa.array(leaves.ravel()), leaves.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [b["vec_id"], b["v"], nested.cast(pa.list_(pa.int32()))], ["vec_id", "v", "leaves"]
                )

    kind = rows.schema["v"].dataType.simpleString()
    indexed = tables.store(rows.mapInArrow(assign, f"vec_id long, v {kind}, leaves array<int>"))
    entries = indexed.select("vec_id", "v", F.explode("leaves").alias("leaf"))
    sizes = {r["leaf"]: r["count"] for r in entries.groupBy("leaf").count().collect()}
    most = max(least, part * sum(sizes.values()))
    held = spark.sparkContext.broadcast(sizes)  # one number a leaf

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            lists = []
            for q in _matrix(b["v"]):
                taken, mass = [], 0
                for leaf in shared.value.walk(q):
                    if leaf in held.value:
                        taken.append(leaf)
                        mass += held.value[leaf]
                        if mass >= most:
                            break
                lists.append(taken)
            leaves = pa.array(lists, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b["vec_id"], b["v"], leaves], ["query_id", "v", "leaves"])

    asked = rows.where(F.col("vec_id") % every == 0)
    probes = tables.store(asked.mapInArrow(search, f"query_id long, v {kind}, leaves array<int>"))
    probes = probes.select("query_id", "v", F.explode("leaves").alias("leaf"))
    taken = {r["leaf"]: r["count"] for r in probes.groupBy("leaf").count().collect()}
    cuts = [(x, -(-sizes[x] // ROWS), -(-n // QUERIES)) for x, n in taken.items()]
    cuts = F.broadcast(spark.createDataFrame(cuts, "leaf int, rows long, asks long"))
    block = ["leaf", "r", "q"]
    left = entries.join(cuts, "leaf").select(
        "leaf", F.pmod(F.xxhash64("vec_id"), "rows").alias("r"),
        F.explode(F.expr("sequence(0L, asks - 1)")).alias("q"), "vec_id", "v",
    )
    right = probes.join(cuts, "leaf").select(
        "leaf", F.explode(F.expr("sequence(0L, rows - 1)")).alias("r"),
        F.pmod(F.xxhash64("query_id"), "asks").alias("q"), "query_id", "v",
    )
    met = left.groupBy(*block).cogroup(right.groupBy(*block))
    met = met.applyInArrow(
        lambda rows, probes: _ranked(rows, probes, k), "query_id long, vec_id long, score double"
    )
    once = met.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
