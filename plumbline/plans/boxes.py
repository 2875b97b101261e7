"""Exact nearest neighbours through bounding boxes.

Rows are cut into boxes along planes found on a bounded sample; only how even the boxes are depends
on it.  Their bounds are a small table.  A probe first meets the nearest boxes that hold enough rows,
and then those that reach nearer than its k-th distance so far; the others hold nothing for it.
Boxes and the probes that meet them are cut into pieces of bounded size, each pair a task's work.
Few probes are taken along by a single scan instead, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.plans.storage import materialize

FEW = 1_024  # probes that one scan takes along
SAMPLE = 20_000  # rows the planes are found on
BOXES = 1_024  # at most
BOX_ROWS = 8_192  # rows of a box aimed at, and most rows of a piece
PROBE_ROWS = 4_096  # most probes of a piece
TOGETHER = 256  # probes whose distances to all boxes, or to all rows of a piece, a task holds at once
FOUND = "__probe bigint, neighbor_id bigint, distance double"
_NAMES = ["__probe", "neighbor_id", "distance"]


def k_best(found: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest of every probe, equal distances by id."""
    ordered = found.sort_values(_NAMES[::2] + ["neighbor_id"], kind="stable")
    return ordered[ordered.groupby("__probe").cumcount() < k]


def distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Euclidean distances (probe, row); features that are not finite give none."""
    out = np.zeros((len(p), len(x)))
    with np.errstate(invalid="ignore"):
        for j in range(x.shape[1]):
            out += (p[:, j, None] - x[:, j]) ** 2
    return np.where(np.isfinite(out), np.sqrt(out), np.inf)


class Search:
    """Column names and parameters that both ways share."""

    def __init__(self, id: str, split: str | None, features: Sequence[str], weights, k: int, exclude_self: bool):
        self.id, self.split, self.features = id, split, list(features)
        self.scale = np.array([1.0] * len(self.features) if weights is None else [float(w) for w in weights])
        self.k, self.exclude_self = k, exclude_self

    def points(self, rows: pd.DataFrame) -> np.ndarray:
        return rows[self.features].to_numpy(dtype=float) * self.scale

    def nearest(self, rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        """The k best of the given rows for each of the given probes."""
        x, ids = self.points(rows), rows[self.id].to_numpy()
        out = []
        for low in range(0, len(asked), TOGETHER):
            some = asked.iloc[low : low + TOGETHER]
            far = distances(x, self.points(some))
            if self.exclude_self:
                same = some[self.id].to_numpy()[:, None] == ids
                if self.split:
                    same &= some[self.split].to_numpy()[:, None] == rows[self.split].to_numpy()
                far[same] = np.inf
            if far.shape[1] > self.k:
                last = np.partition(far, self.k - 1, axis=1)[:, self.k - 1 : self.k]
            else:
                last = np.full((len(some), 1), np.inf)
            probe, row = np.nonzero((far <= last) & np.isfinite(far))
            found = [some["__probe"].to_numpy()[probe], ids[row], far[probe, row]]
            out.append(k_best(pd.DataFrame(dict(zip(_NAMES, found))), self.k))
        return pd.concat(out) if out else pd.DataFrame(columns=_NAMES)


def by_scan(search: Search, rows: DataFrame, probes: pd.DataFrame) -> DataFrame:
    """Every task keeps the k best of its rows for each of a few probes."""
    shared = rows.sparkSession.sparkContext.broadcast(probes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = pd.DataFrame(columns=_NAMES)
        for pdf in batches:
            found = search.nearest(pdf, shared.value)
            best = k_best(pd.concat([best, found]), search.k) if len(best) else found
        yield best.astype({"__probe": "int64", "neighbor_id": "int64", "distance": "float64"})

    return rows.mapInPandas(run, FOUND)


class Planes:
    """Medians that cut a sample into about ``boxes`` parts; every point lies in one."""

    def __init__(self, sample: np.ndarray, boxes: int):
        self.nodes: list[tuple[int, float, int, int]] = []  # feature, border, low child, high child
        self.boxes = 0
        self.root = self._cut(sample[np.isfinite(sample).all(axis=1)], boxes)

    def _cut(self, points: np.ndarray, boxes: int) -> int:
        if boxes > 1 and len(points) > 1:
            spread = points.max(axis=0) - points.min(axis=0)
            feature = int(spread.argmax())
            border = float(np.median(points[:, feature]))
            low = points[:, feature] <= border
            if low.all():  # most values equal the largest
                border = float(points[points[:, feature] < border, feature].max(initial=-np.inf))
                low = points[:, feature] <= border
            if low.any():
                node = len(self.nodes)
                self.nodes.append((feature, border, 0, 0))
                children = self._cut(points[low], boxes // 2), self._cut(points[~low], boxes - boxes // 2)
                self.nodes[node] = (feature, border, *children)
                return node
        self.boxes += 1
        return -self.boxes

    def box_of(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int64)
        stack = [(self.root, np.arange(len(points)))]
        while stack:
            node, own = stack.pop()
            if node < 0:
                out[own] = -1 - node
                continue
            feature, border, low, high = self.nodes[node]
            below = points[own, feature] <= border
            stack += [(low, own[below]), (high, own[~below])]
        return out


def by_boxes(
    search: Search, rows: DataFrame, probes: DataFrame, total: int,
    box_rows: int = BOX_ROWS, probe_rows: int = PROBE_ROWS,
) -> DataFrame:
    """Probes meet boxes; ``probes`` is a written table with a number per probe in ``__probe``."""
    features, keys = search.features, [search.split, search.id] if search.split else [search.id]
    order = F.xxhash64(*keys, *features)
    sample = rows.select(*features).orderBy(order).limit(SAMPLE).toPandas()
    planes = Planes(search.points(sample), min(BOXES, max(1, total // box_rows)))

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(__box=planes.box_of(search.points(pdf)))

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*keys, *features))
    boxed = materialize(rows.select(*keys, *features).mapInPandas(placed, f"{schema}, __box bigint"))
    scaled = [F.col(c).cast("double") * F.lit(float(w)) for c, w in zip(features, search.scale)]
    found = boxed.groupBy("__box").agg(
        F.count("*").alias("n"), F.array(*[F.min(c) for c in scaled]).alias("low"),
        F.array(*[F.max(c) for c in scaled]).alias("high"),
    ).orderBy("__box").toPandas()
    if found.empty:
        return rows.sparkSession.createDataFrame([], FOUND)
    number, size = found["__box"].to_numpy(), found["n"].to_numpy()
    low, high = np.array(found["low"].tolist(), float), np.array(found["high"].tolist(), float)
    pieces = dict(zip(number.tolist(), (-(-size // box_rows)).tolist()))

    def nearest_first(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distance to every box, the boxes in that order, and how many of them hold enough rows."""
        gap = np.zeros((len(points), len(number)))
        for j in range(points.shape[1]):
            p = points[:, j, None]
            gap += np.maximum(np.maximum(low[:, j] - p, p - high[:, j]), 0) ** 2
        gap = np.sqrt(gap)
        sequence = np.argsort(gap, axis=1, kind="stable")
        held = np.cumsum(size[sequence], axis=1)
        return gap, sequence, (held < search.k + 1).sum(axis=1) + 1

    def meetings(second: bool):
        def met(points: np.ndarray, reach: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
            gap, sequence, first = nearest_first(points)
            place = np.empty_like(sequence)
            np.put_along_axis(place, sequence, np.arange(len(number))[None, :], axis=1)
            out = place < first[:, None]
            if reach is not None:
                out = ~out & (gap <= reach[:, None] * (1 + 1e-12))
            out &= np.isfinite(points).all(axis=1)[:, None]
            return np.nonzero(out)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for low in range(0, len(pdf), TOGETHER):
                    some = pdf.iloc[low : low + TOGETHER]
                    reach = some["__reach"].to_numpy(dtype=float) if second else None
                    row, box = met(search.points(some), reach)
                    out = some.iloc[row].drop(columns=["__reach"] if second else [])
                    yield out.assign(__box=number[box])

        return run

    asked_schema = ", ".join(f"`{c}` {t}" for c, t in probes.dtypes)

    def meet(asked: DataFrame) -> DataFrame:
        asked = materialize(asked)
        counts = {r["__box"]: r["n"] for r in asked.groupBy("__box").agg(F.count("*").alias("n")).collect()}
        if not counts:
            return asked.sparkSession.createDataFrame([], FOUND)
        # one row a box that is met: how many pieces its rows and its probes are cut into
        cuts = [(b, int(pieces[b]), -(-n // probe_rows)) for b, n in counts.items()]
        cuts = [
            F.broadcast(asked.sparkSession.createDataFrame(cuts, "__box bigint, __pieces int, __blocks int"))
            for _ in range(2)  # one for each side, since both are joined
        ]
        left = boxed.join(cuts[0], "__box").withColumn("__piece", F.pmod(order, F.col("__pieces")).cast("int"))
        left = left.withColumn("__block", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
        left = left.drop("__pieces", "__blocks")
        right = asked.join(cuts[1], "__box")
        right = right.withColumn("__block", F.pmod(F.xxhash64("__probe"), F.col("__blocks")).cast("int"))
        right = right.withColumn("__piece", F.explode(F.sequence(F.lit(0), F.col("__pieces") - 1)))
        right = right.drop("__pieces", "__blocks")
        group = ["__box", "__piece", "__block"]
        both = left.groupBy(*group).cogroup(right.groupBy(*group))
        return both.applyInPandas(lambda a, b: search.nearest(a, b)[_NAMES], FOUND)

    first = materialize(meet(probes.mapInPandas(meetings(False), f"{asked_schema}, __box bigint")))
    rank = F.row_number().over(W.partitionBy("__probe").orderBy("distance", "neighbor_id"))
    last = first.withColumn("__rank", rank).where(F.col("__rank") == search.k)
    last = last.select("__probe", F.col("distance").alias("__reach"))
    again = probes.join(last, "__probe", "left")
    again = again.select(*probes.columns, F.coalesce("__reach", F.lit(float("inf"))).alias("__reach"))
    return first.unionAll(meet(again.mapInPandas(meetings(True), f"{asked_schema}, __box bigint")))

