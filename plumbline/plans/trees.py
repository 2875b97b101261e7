"""Boosted regression trees grown from gradient histograms.

Features are cut into bins once.  From then on a pass over the binned rows gives, per open leaf,
drawn feature and bin, the sum of gradients and the number of rows; that is all a split needs.  The
rows lie in blocks: a row of the written table has the bins, targets and predictions so far of up to
``BLOCK_ROWS`` rows, as arrays in binary cells, so that a pass converts no row.

Up to ``ALONE_ROWS`` rows a model is grown by one task, which holds its binned rows, so that a pass is
a scan of arrays in memory.  Models that leave out one fold each, and the one on all rows, are grown
side by side, and only trees reach the driver.  The table is written anew with the predictions every
``WRITE_EVERY`` trees: a lost executor costs its tasks' share of these.

Beyond, a pass is a Spark job over all blocks, which serves all models, and the driver adds up one
vector a task.  A task applies the few trees that came since the table was written, every
``PASSED_TREES`` trees.  Both ways give the same trees, but for the rounding of sums.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.plans.storage import discard, materialize

ALONE_ROWS = 8_000_000  # a task takes some 40 bytes and the bins of each
ROWS_A_TASK = 250_000
BLOCK_ROWS = 16_384  # most rows of a block
WRITE_EVERY = 256  # trees
PASSED_TREES = 4
MERGE_TASKS = 32  # up to that many partial results go straight to the driver
MASKED = 16  # leaves up to which a tree is applied by masks
PIECE = 65_536  # rows that are summed or scored at a time
ACCURACY = 100_000  # of approximate quantiles; exact up to that many rows
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Boosting:
    """Recipe of a boosted model.

    A tree splits the leaf of the largest gain next, until it has ``leaves`` leaves, no leaf above
    ``depth`` is left, or no split gains more than ``min_gain``.  The gain of a split is half of
    s(left) + s(right) - s(both) with s = T(G)^2 / (n + l2), where G sums the gradients, n counts the
    rows and T moves G towards 0 by ``l1``; a leaf adds -rate * T(G) / (n + l2).  The Huber loss clips
    gradients at the ``huber`` quantile of the absolute residuals, taken anew with each refresh.
    ``feature_share`` is drawn per tree, or per node.  ``row_share`` is drawn by row id, anew every
    ``bag_every`` trees.
    """

    trees: int = 720
    rate: float = 0.05
    leaves: int = 31
    depth: int = 64
    bins: int = 255
    min_rows: int = 1
    min_split: int = 2
    min_gain: float = 0.0
    l1: float = 0.0
    l2: float = 0.0
    huber: float | None = None
    feature_share: float = 1.0
    per_node: bool = False
    row_share: float = 1.0
    bag_every: int = 1
    refresh: int = 16
    seed: int = 7

    def smaller(self, trees: int) -> Boosting:
        """The same recipe with fewer trees."""
        return replace(self, trees=trees)


# --- fixed values: the three boosted models of the final ensemble


def huber_trees(n_features: int) -> Boosting:
    return Boosting(
        trees=3000, rate=0.05, depth=4, leaves=16, min_rows=15, min_split=10, huber=0.9,
        feature_share=max(1, int(np.sqrt(n_features))) / n_features, per_node=True,
    )


def level_trees() -> Boosting:
    return Boosting(
        trees=2200, rate=0.05, depth=3, leaves=8, min_rows=2, min_gain=0.0468, l1=0.464, l2=0.8571,
        feature_share=0.4603, row_share=0.5213,
    )


def leaf_trees() -> Boosting:
    return Boosting(
        trees=720, rate=0.05, leaves=5, bins=55, min_rows=11, feature_share=0.2319,
        row_share=0.8, bag_every=5,
    )


# --- trees


@dataclass
class Tree:
    """Splits in the order they were made: (node, feature, bin, left, right), and leaf values."""

    splits: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    values: list[float] = field(default_factory=lambda: [0.0])

    def nodes(self, x: Sequence[np.ndarray], n: int) -> np.ndarray:
        """Leaf of every row; ``x`` holds one array of bins a feature."""
        node = np.zeros(n, np.int16)
        for at, feature, cut, left, right in self.splits:
            mine = np.flatnonzero(node == at)
            node[mine] = np.where(x[feature][mine] <= cut, left, right)
        return node

    def predict(self, x: Sequence[np.ndarray], n: int) -> np.ndarray:
        return np.array(self.values)[self.nodes(x, n)]


_LEAF = np.zeros(1 << MASKED, np.uint8)  # number of the only bit
_LEAF[1 << np.arange(MASKED)] = np.arange(MASKED)


class _Applied:
    """A tree as one table a feature, which says for every bin the leaves that can be reached.

    Each split rules out the leaves on its other side, so the tables of all features agree in one.
    """

    def __init__(self, tree: Tree, width: int):
        self.tree, self.tables = tree, {}
        parents = {at for at, *_ in tree.splits}
        leaves = [k for k in range(len(tree.values)) if k not in parents]
        self.masked = len(leaves) <= MASKED
        if not self.masked:
            return
        self.values = np.array([tree.values[k] for k in leaves])
        under = {leaf: 1 << k for k, leaf in enumerate(leaves)}
        for at, _, _, left, right in reversed(tree.splits):
            under[at] = under[left] | under[right]
        full = (1 << len(leaves)) - 1
        for _, feature, cut, left, right in tree.splits:
            table = self.tables.setdefault(feature, np.full(width, full, np.uint16))
            table[: cut + 1] &= np.uint16(full & ~under[right])
            table[cut + 1 :] &= np.uint16(full & ~under[left])

    def add(self, x: Sequence[np.ndarray], out: np.ndarray) -> None:
        """Add the tree's values to ``out``."""
        if not self.masked:
            out += self.tree.predict(x, len(out))
        elif not self.tables:
            out += self.values[0]
        else:
            (j, table), *rest = self.tables.items()
            reach = table[x[j]]
            for j, table in rest:
                reach &= table[x[j]]
            out += self.values[_LEAF[reach]]


class _Growing:
    """A tree that waits for the histograms of its open leaves."""

    def __init__(self, recipe: Boosting, number: int, n_features: int):
        self.recipe = recipe
        self.random = np.random.default_rng((recipe.seed, number))
        self.n_features = n_features
        self.allowed = self._draw()
        self.tree = Tree()
        self.depth = [0]
        self.best: dict[int, tuple | None] = {}  # leaf -> its best split
        self.open = [0]  # leaves without a histogram
        self.drawn: dict[int, np.ndarray] = {}  # open leaf -> features that may split it

    def _draw(self) -> np.ndarray:
        n = max(1, round(self.recipe.feature_share * self.n_features))
        return np.sort(self.random.permutation(self.n_features)[:n])

    def ask(self) -> dict[int, np.ndarray]:
        """The features that may split each open leaf."""
        for leaf in self.open:
            self.drawn[leaf] = self._draw() if self.recipe.per_node and leaf else self.allowed
        return dict(self.drawn)

    def learn(self, found: np.ndarray) -> None:
        """Histograms (open leaf and drawn feature, sum or count, bin); split as far as they reach."""
        at = 0
        for leaf, drawn in self.drawn.items():
            g, n = found[at : at + len(drawn), 0], found[at : at + len(drawn), 1]
            at += len(drawn)
            total, rows = g[0].sum(), n[0].sum()
            if not leaf:
                self.tree.values[0] = self._value(total, rows)
            self.best[leaf] = self._split(g, n, total, rows, drawn)
        self.drawn = {}
        self.open = []
        # where the depth alone ends the growth, the order of the splits does not matter
        ordered = self.recipe.leaves < 2 ** min(self.recipe.depth, 30)
        while len(self.best) < self.recipe.leaves and not (self.open and ordered):
            able = [(split[0], -leaf) for leaf, split in self.best.items() if split]
            if not able:
                break
            self._apply(-max(able)[1])
        if len(self.best) >= self.recipe.leaves:
            self.open = []

    def _apply(self, leaf: int) -> None:
        _, feature, cut, *sides = self.best.pop(leaf)
        children = len(self.tree.values), len(self.tree.values) + 1
        self.tree.splits.append((leaf, feature, cut, *children))
        for child, (g, n) in zip(children, sides, strict=True):
            self.tree.values.append(self._value(g, n))
            self.depth.append(self.depth[leaf] + 1)
            self.best[child] = None
            if self.depth[child] < self.recipe.depth and n >= max(self.recipe.min_split, 2):
                self.open.append(child)

    def _shrunk(self, g):
        return np.sign(g) * np.maximum(np.abs(g) - self.recipe.l1, 0.0)

    def _value(self, g: float, n: float) -> float:
        return float(-self.recipe.rate * self._shrunk(g) / (n + self.recipe.l2)) if n else 0.0

    def _split(self, g, n, total, rows, allowed) -> tuple | None:
        """(gain, feature, cut, left sums, right sums) of the best split, if one gains enough."""
        r = self.recipe
        if rows < r.min_split:
            return None
        gl, nl = np.cumsum(g, axis=1)[:, :-1], np.cumsum(n, axis=1)[:, :-1]
        gr, nr = total - gl, rows - nl
        fit = (nl >= r.min_rows) & (nr >= r.min_rows) & (nl > 0) & (nr > 0)

        def s(g, n):
            return self._shrunk(g) ** 2 / np.where(n + r.l2 > 0, n + r.l2, 1.0)

        gain = np.where(fit, (s(gl, nl) + s(gr, nr) - s(total, rows)) / 2 - r.min_gain, -np.inf)
        if not gain.size:
            return None
        row, cut = divmod(int(gain.argmax()), gain.shape[1])
        # what rounding alone can give is no gain
        if not gain[row, cut] > 1e-12 * float(s(total, rows)):
            return None
        at = row, cut
        return float(gain[at]), int(allowed[row]), cut, (gl[at], nl[at]), (gr[at], nr[at])


@dataclass(frozen=True)
class Boosted:
    """Fitted models: one per left-out fold, and last the one on all rows."""

    features: tuple[str, ...]
    cuts: tuple[np.ndarray, ...]
    base: tuple[float, ...]
    trees: tuple[tuple[Tree, ...], ...]  # per model
    passes: int = 0

    def applied(self, model: int = -1) -> list[_Applied]:
        width = max([len(c) + 2 for c in self.cuts], default=2)
        return [_Applied(tree, width) for tree in self.trees[model]]

    def values(self, columns: Sequence[np.ndarray], model: int = -1, applied: list[_Applied] | None = None) -> np.ndarray:
        """Predictions for raw feature columns."""
        n = len(columns[0]) if columns else 0
        x = [_bins(c, cuts) for c, cuts in zip(columns, self.cuts, strict=True)]
        out = np.full(n, self.base[model])
        applied = self.applied(model) if applied is None else applied
        for low in range(0, n, PIECE):
            part, f = [c[low : low + PIECE] for c in x], out[low : low + PIECE]
            for tree in applied:
                tree.add(part, f)
        return out

    def predict(self, rows: DataFrame, name: str = "prediction", fold: str | None = None) -> DataFrame:
        """Rows with a prediction: by the model on all rows, or, with the name of the fold column,
        by the one that left out the row's fold."""
        features = list(self.features)
        schema = T.StructType([*rows.schema.fields, T.StructField(name, T.DoubleType())])
        used = self if fold is not None else replace(self, base=self.base[-1:], trees=self.trees[-1:])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ready: dict[int, list[_Applied]] = {}

            def values(columns, model):
                if model not in ready:
                    ready[model] = used.applied(model)
                return used.values(columns, model, ready[model])

            for batch in batches:
                columns = [_column(batch[c]) for c in features]
                if fold is None:
                    out = values(columns, -1)
                else:
                    own = batch[fold].to_numpy(zero_copy_only=False)
                    out = np.zeros(batch.num_rows)
                    for k in np.unique(own).tolist():
                        mine = own == k
                        out[mine] = values([c[mine] for c in columns], int(k))
                names = [*batch.schema.names, name]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names)

        return rows.mapInArrow(run, schema)


def _column(values: pa.Array) -> np.ndarray:
    """Doubles with NaN for null."""
    return values.cast(pa.float64()).to_numpy(zero_copy_only=False)


def _bins(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Bin 0 is for unknown values, bin i for those above cut i - 2 up to cut i - 1."""
    out = np.searchsorted(cuts, values, side="left") + 1
    out[np.isnan(values)] = 0
    return out.astype(np.uint8 if len(cuts) < 254 else np.int32)


def cut_points(rows: DataFrame, features: Sequence[str], bins: int) -> list[np.ndarray]:
    """Upper borders of the bins: every value where they are few, quantiles elsewhere."""
    doubles = [F.col(c).cast("double") for c in features]
    known = [F.when(~F.isnan(c), c) for c in doubles]
    found = rows.agg(*[F.approx_count_distinct(c).alias(f"c{i}") for i, c in enumerate(known)]).first()
    shares = [i / (bins - 1) for i in range(1, bins - 1)]
    few = [(found[i] or 0) <= 2 * bins for i in range(len(features))]
    wanted = [
        F.sort_array(F.collect_set(c)) if few[i] else F.percentile_approx(c, shares, ACCURACY)
        for i, c in enumerate(known)
    ]
    got = rows.agg(*[w.alias(f"c{i}") for i, w in enumerate(wanted)]).first()
    out = []
    for i in range(len(features)):
        values = np.unique(np.array(got[i] or [], float))
        if few[i]:
            values = values[:-1]
            if len(values) > bins - 2:
                values = values[np.unique(np.linspace(0, len(values) - 1, bins - 2).round().astype(int))]
        out.append(values)
    return out


BLOCKS = "n int, x binary, f binary, y binary, fold binary, u binary"


@dataclass
class _Block:
    """Rows: bins (feature, row), predictions so far (model, row), target, fold and hash of the id."""

    x: np.ndarray
    f: np.ndarray
    y: np.ndarray
    fold: np.ndarray
    u: np.ndarray

    def row(self) -> pa.RecordBatch:
        cells = [pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for a in (self.x, self.f, self.y, self.fold, self.u)]
        return pa.RecordBatch.from_arrays([pa.array([len(self.y)], pa.int32()), *cells], ["n", "x", "f", "y", "fold", "u"])

    def with_trees(self, since: list[list[_Applied]]) -> _Block:
        """Predictions with the trees of every model that came since."""
        f = self.f.copy()
        for own, trees in zip(f, since, strict=True):
            for tree in trees:
                tree.add(self.x, own)
        return replace(self, f=f)


def _blocks(batches: Iterator[pa.RecordBatch], d: int, models: int, kind: np.dtype) -> Iterator[_Block]:
    for batch in batches:
        for i, n in enumerate(batch["n"].to_pylist()):
            x, f, y, fold, u = (
                np.frombuffer(batch[c][i].as_buffer(), t)
                for c, t in zip(("x", "f", "y", "fold", "u"), (kind, float, float, np.int32, np.int64), strict=True)
            )
            yield _Block(x.reshape(d, n), f.reshape(models, n), y, fold, u)


class _Leaves:
    """Row numbers of the leaves of a growing tree, parted when they are asked for."""

    def __init__(self, x: np.ndarray, rows: np.ndarray):
        self.x, self.rows, self.parents = x, {0: rows}, {}

    def of(self, tree: Tree, leaf: int) -> np.ndarray:
        for split in tree.splits[len(self.parents) // 2 :]:
            self.parents[split[3]] = self.parents[split[4]] = split
        if leaf not in self.rows:
            at, feature, cut, left, right = self.parents[leaf]
            rows = self.of(tree, at)
            low = self.x[feature][rows] <= cut
            self.rows[left], self.rows[right] = rows[low], rows[~low]
            del self.rows[at]
        return self.rows[leaf]


def _histograms(
    out: np.ndarray, leaves: _Leaves, residual: np.ndarray, delta: float, tree: Tree, asked: dict[int, np.ndarray]
) -> None:
    """Add gradient sums and row counts to (open leaf and drawn feature, sum or count, bin)."""
    at, width = 0, out.shape[2]
    for leaf, drawn in asked.items():
        own = leaves.of(tree, leaf)
        for low in range(0, len(own), PIECE):
            rows = own[low : low + PIECE]
            weights = residual[rows]
            if delta < np.inf:
                np.clip(weights, -delta, delta, out=weights)
            for k, j in enumerate(drawn, at):
                key = leaves.x[j][rows].astype(np.intp)
                out[k, 0] += np.bincount(key, weights, width)
                out[k, 1] += np.bincount(key, minlength=width)
        at += len(drawn)


class _Alone:
    """The rows of one model in one task, which grows its trees."""

    def __init__(self, x: np.ndarray, residual: np.ndarray, u: np.ndarray, recipe: Boosting, delta: float, width: int):
        # a residual is a prediction less its target; the hash of the id is empty without bags
        self.x, self.residual, self.u = x, residual, u
        self.recipe, self.delta, self.width = recipe, delta, width
        self.rows, self.passes = None, 0

    def tree(self, number: int) -> Tree:
        recipe = self.recipe
        n = len(self.residual)
        if recipe.huber is not None and number % recipe.refresh == 0 and n:
            far = np.abs(self.residual)
            k = max(math.ceil(recipe.huber * n), 1) - 1
            far.partition(k)
            self.delta = float(far[k])
        if self.rows is None or recipe.row_share < 1 and number % recipe.bag_every == 0:
            self.rows = self._bag(number)
        growing, leaves = _Growing(recipe, number, len(self.x)), _Leaves(self.x, self.rows)
        while growing.open:
            asked = growing.ask()
            found = np.zeros((sum(map(len, asked.values())), 2, self.width))
            _histograms(found, leaves, self.residual, self.delta, growing.tree, asked)
            growing.learn(found)
            self.passes += 1
        applied = _Applied(growing.tree, self.width)
        for low in range(0, n, PIECE):
            applied.add([c[low : low + PIECE] for c in self.x], self.residual[low : low + PIECE])
        return growing.tree

    def _bag(self, number: int) -> np.ndarray:
        if self.recipe.row_share >= 1:
            return np.arange(len(self.residual), dtype=np.int32)
        pieces = range(0, len(self.u), PIECE)
        parts = [np.flatnonzero(_drawn(self.u[k : k + PIECE], self.recipe, number)).astype(np.int32) + np.int32(k) for k in pieces]
        return np.concatenate([np.zeros(0, np.int32), *parts])


class _Rows:
    """The binned rows with each model's predictions so far, and the trees since."""

    def __init__(
        self, table: DataFrame, parts: int, d: int, sizes: list[int], width: int, kind: np.dtype, recipe: Boosting
    ):
        self.table, self.parts, self.sizes = table, parts, sizes  # sizes: rows of every model
        self.d, self.m, self.width, self.kind, self.recipe = d, len(sizes), width, kind, recipe
        self.since: list[list[Tree]] = [[] for _ in sizes]
        self.delta = [np.inf] * len(sizes)
        self.passes = 0

    def grow_alone(self, numbers: range) -> list[list[Tree]]:
        """Trees of these numbers of every model, a task a model."""
        with ThreadPoolExecutor(self.m) as pool:
            found = list(pool.map(lambda m: self._model(m, numbers), range(self.m)))
        made = [pickle.loads(row["made"]) for row in found]
        self.delta = [row["delta"] for row in found]
        self.passes += max(row["passes"] for row in found)
        self.since = [a + b for a, b in zip(self.since, made, strict=True)]
        return made

    def _model(self, m: int, numbers: range) -> Row:
        """Trees of one model, as one task makes them."""
        d, width, kind, recipe, n, delta = self.d, self.width, self.kind, self.recipe, self.sizes[m], self.delta[m]
        bagged = recipe.row_share < 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x, residual, u = np.empty((d, n), kind), np.empty(n), np.empty(n if bagged else 0, np.int64)
            at = 0
            for block in _blocks(batches, d, 1, kind):
                mine = np.flatnonzero(block.fold != m)
                to = slice(at, at + len(mine))
                x[:, to], residual[to] = block.x[:, mine], block.f[0, mine] - block.y[mine]
                if bagged:
                    u[to] = block.u[mine]
                at += len(mine)
            state = _Alone(x, residual, u, recipe, delta, width)
            made = pickle.dumps([state.tree(number) for number in numbers])
            cells = {"made": [made], "delta": [float(state.delta)], "passes": [state.passes]}
            yield pa.RecordBatch.from_pydict(cells)

        own = F.expr(f"substring(f, n * 8 * {m} + 1, n * 8)").alias("f")
        rows = self.table.select("n", "x", own, "y", "fold", "u").coalesce(1)
        return rows.mapInArrow(run, "made binary, delta double, passes long").first()

    def grow_together(self, numbers: range) -> list[list[Tree]]:
        """The same, by passes over all blocks."""
        made: list[list[Tree]] = [[] for _ in range(self.m)]
        for number in numbers:
            if number % self.recipe.refresh == 0:
                self.clip()
            growing = [_Growing(self.recipe, number, self.d) for _ in range(self.m)]
            while any(g.open for g in growing):
                for g, found in zip(growing, self.histograms(growing, number), strict=True):
                    if g.open:
                        g.learn(found)
                self.passes += 1
            for m, g in enumerate(growing):
                made[m].append(g.tree)
                self.since[m].append(g.tree)
        return made

    def histograms(self, growing: list[_Growing], number: int) -> list[np.ndarray]:
        """Gradient sums and row counts (open leaf and drawn feature, sum or count, bin) of every model, in one pass."""
        asked = [g.ask() for g in growing]
        shapes = [(sum(map(len, a.values())), 2, self.width) for a in asked]
        ends = np.cumsum([0, *(int(np.prod(s)) for s in shapes)]).tolist()
        trees = [g.tree for g in growing]
        d, width, models, kind = self.d, self.width, self.m, self.kind
        recipe, delta = self.recipe, self.delta
        since = [own if a else [] for own, a in zip(self.since, asked, strict=True)]

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(ends[-1])
            applied = [[_Applied(t, width) for t in own] for own in since]
            for block in _blocks(batches, d, models, kind):
                block = block.with_trees(applied)
                drawn = _drawn(block.u, recipe, number)
                for m in range(models):
                    if asked[m]:
                        leaves = _Leaves(block.x, np.flatnonzero(drawn & (block.fold != m)))
                        out = sums[ends[m] : ends[m + 1]].reshape(shapes[m])
                        _histograms(out, leaves, block.f[m] - block.y, delta[m], trees[m], asked[m])
            yield _row(sums)

        out = _total(self.table.mapInArrow(part, "v array<double>"), ends[-1], self.parts)
        return [out[low:high].reshape(s) for low, high, s in zip(ends, ends[1:], shapes, strict=False)]

    def write(self) -> None:
        """Write the predictions down."""
        if not any(self.since):
            return
        d, models, kind, width, since = self.d, self.m, self.kind, self.width, self.since

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            applied = [[_Applied(t, width) for t in own] for own in since]
            for block in _blocks(batches, d, models, kind):
                yield block.with_trees(applied).row()

        newer = materialize(self.table.mapInArrow(run, BLOCKS))
        discard(self.table)
        self.table, self.since = newer, [[] for _ in range(self.m)]

    def clip(self) -> None:
        """Take the clipping points from the predictions."""
        if self.recipe.huber is None:
            return
        d, models, kind, width, since = self.d, self.m, self.kind, self.width, self.since
        names = [f"d{m}" for m in range(models)]

        def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            applied = [[_Applied(t, width) for t in own] for own in since]
            for block in _blocks(batches, d, models, kind):
                f = block.with_trees(applied).f
                own = [pa.array(np.abs(block.y - f[m]), mask=block.fold == m) for m in range(models)]
                yield pa.RecordBatch.from_arrays(own, names)

        rows = self.table.mapInArrow(far, ", ".join(f"{c} double" for c in names))
        row = rows.agg(*[F.percentile_approx(c, self.recipe.huber, ACCURACY).alias(c) for c in names]).first()
        self.delta = [np.inf if v is None else float(v) for v in row]


def _row(values: np.ndarray) -> pa.RecordBatch:
    flat = pa.array(values)
    one = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), flat)
    return pa.RecordBatch.from_arrays([one], ["v"])


def _total(parts: DataFrame, width: int, tasks: int) -> np.ndarray:
    """Sum of one vector a task; many are merged by tasks before the driver sees them."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                out += batch["v"].flatten().to_numpy().reshape(batch.num_rows, width).sum(axis=0)
        yield _row(out)

    if tasks > MERGE_TASKS:
        parts = parts.repartition(MERGE_TASKS).mapInArrow(merge, "v array<double>")
    vectors = parts.toArrow()["v"].combine_chunks()
    return vectors.flatten().to_numpy().reshape(len(vectors), width).sum(axis=0)


def _drawn(u: np.ndarray, recipe: Boosting, number: int) -> np.ndarray:
    """Rows of the bag of a tree, by their hash."""
    if recipe.row_share >= 1:
        return np.ones(len(u), bool)
    bag = np.uint64((number // recipe.bag_every + 1) * 2_654_435_761 + recipe.seed)
    h = (u.view(np.uint64) ^ bag) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return (h >> np.uint64(11)).astype(float) / 2.0**53 < recipe.row_share


def boost(
    rows: DataFrame, features: Sequence[str], target: str, recipe: Boosting,
    id: str, fold: Column | None = None, n_folds: int = 0,
) -> Boosted:
    """Fit ``n_folds`` models that leave out one fold each, and one on all rows.

    ``fold`` numbers the rows' folds from 0.  Rows without a target, or with a NaN there, take no
    part; unknown feature values are a bin of their own, below all others.  Without rows every
    prediction is 0.
    """
    features = list(features)
    d, models = len(features), n_folds + 1
    y = F.col(target).cast("double")
    known = rows.where(y.isNotNull() & ~F.isnan(y))
    cuts = cut_points(known, features, recipe.bins)
    # a fold number beyond the models' leaves a row out of none
    left = (fold if fold is not None else F.lit(-1)).cast("int")
    source = known.select(
        *[F.col(c).cast("double").alias(f"c{j}") for j, c in enumerate(features)],
        y.alias("y"),
        F.when(left < n_folds, left).otherwise(-1).alias("fold"),
        F.xxhash64(F.col(id)).alias("u"),
    )
    sums = {r["fold"]: (r["n"], r["s"]) for r in source.groupBy("fold").agg(F.count("*").alias("n"), F.sum("y").alias("s")).collect()}
    base = []
    for m in range(models):
        kept = [v for k, v in sums.items() if k != m or m == n_folds]
        n = sum(v[0] for v in kept)
        base.append(sum(v[1] for v in kept) / n if n else 0.0)
    if not sums:
        return Boosted(tuple(features), tuple(cuts), tuple(base), tuple(() for _ in range(models)))

    width = max([len(c) + 2 for c in cuts], default=2)
    kind = np.dtype(np.uint8 if width <= 256 else np.int32)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK_ROWS):
                rows = batch.slice(low, BLOCK_ROWS)
                n = rows.num_rows
                x = np.zeros((d, n), kind)
                for j, c in enumerate(cuts):
                    x[j] = _bins(_column(rows[f"c{j}"]), c)
                f = np.repeat(np.array(base)[:, None], n, axis=1)
                yield _Block(x, f, *(rows[c].to_numpy(zero_copy_only=False) for c in ("y", "fold", "u"))).row()

    count = sum(v[0] for v in sums.values())
    tasks = max(1, -(-count // ROWS_A_TASK))
    sizes = [count - (sums[m][0] if m < n_folds and m in sums else 0) for m in range(models)]
    blocks = source.mapInArrow(binned, BLOCKS).repartition(tasks)
    state = _Rows(materialize(blocks), tasks, d, sizes, width, kind, recipe)
    alone = count <= ALONE_ROWS
    step = WRITE_EVERY if alone else math.gcd(PASSED_TREES, recipe.refresh)
    trees: list[list[Tree]] = [[] for _ in range(models)]
    for low in range(0, recipe.trees, step):
        state.write()
        numbers = range(low, min(low + step, recipe.trees))
        made = state.grow_alone(numbers) if alone else state.grow_together(numbers)
        for own, new in zip(trees, made, strict=True):
            own += new
    discard(state.table)
    return Boosted(tuple(features), tuple(cuts), tuple(base), tuple(map(tuple, trees)), state.passes)
