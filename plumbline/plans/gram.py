"""Linear models from per-fold sufficient statistics.

One pass over the rows gives, per fold, the cross products of (1, features, target).  They add
up, so the statistics of "all folds but one" are a subtraction, and every linear model on any
subset of the features can be fitted and scored from them without another pass.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Model:
    """intercept + sum of coefs[i] * features[i]."""

    features: tuple[str, ...]
    coefs: tuple[float, ...]
    intercept: float
    iterations: int = 0

    def predict(self) -> Column:
        expr = F.lit(float(self.intercept))
        for c, w in zip(self.features, self.coefs):
            if w:
                expr = expr + F.col(c) * F.lit(float(w))
        return expr


@dataclass(frozen=True)
class Moments:
    """Row count, means and centred cross products of features plus target (last)."""

    n: float
    mean: np.ndarray
    cross: np.ndarray

    @classmethod
    def of(cls, raw: np.ndarray) -> Moments:
        n = raw[0, 0]
        mean = raw[0, 1:] / n if n else raw[0, 1:]
        return cls(n, mean, raw[1:, 1:] - n * np.outer(mean, mean))

    @classmethod
    def of_rows(cls, x: np.ndarray) -> Moments:
        mean = x.mean(axis=0)
        centred = x - mean
        return cls(float(len(x)), mean, centred.T @ centred)

    def plus(self, other: Moments) -> Moments:
        """The moments of both row sets together."""
        n = self.n + other.n
        if not n:
            return self
        gap = other.mean - self.mean
        cross = self.cross + other.cross + np.outer(gap, gap) * (self.n * other.n / n)
        return Moments(n, self.mean + gap * (other.n / n), cross)

    def about(self, point: np.ndarray) -> np.ndarray:
        """Cross products of (1, columns - point)."""
        d = len(self.mean) + 1
        raw, gap = np.zeros((d, d)), self.mean - point
        raw[0, 0] = self.n
        raw[0, 1:] = raw[1:, 0] = self.n * gap
        raw[1:, 1:] = self.cross + self.n * np.outer(gap, gap)
        return raw


@dataclass(frozen=True)
class Linear:
    """Recipe of a linear model: squared loss / (2n) + l1 * |w| + l2 / 2 * w'w."""

    l1: float = 0.0
    l2: float = 0.0
    intercept: bool = True
    max_iter: int = 10_000
    tolerance: float = 1e-10

    def solve(self, m: Moments, warm: np.ndarray | None = None):
        """(coefficients, intercept, iterations)."""
        cross, mean, n = m.cross, m.mean, max(m.n, 1.0)
        if not self.intercept:
            cross = cross + m.n * np.outer(mean, mean)
        a, b = cross[:-1, :-1] / n, cross[:-1, -1] / n
        if len(b) == 0:
            return b, (mean[-1] if self.intercept else 0.0), 0
        if self.l1 == 0:
            lhs = a + self.l2 * np.eye(len(b))
            # least-norm solution, so collinear one-hot blocks do not break the fit
            w = np.linalg.lstsq(lhs, b, rcond=1e-11)[0]
            rounds = 1
        else:
            w, rounds = self._descend(a, b, warm)
        bias = mean[-1] - w @ mean[:-1] if self.intercept else 0.0
        return w, float(bias), rounds

    def _descend(self, a, b, warm):
        """Coordinate descent on the cross products."""
        w = np.zeros(len(b)) if warm is None else warm.copy()
        grad = b - a @ w
        for sweep in range(1, self.max_iter + 1):
            biggest = 0.0
            for j in range(len(b)):
                if a[j, j] <= 0:
                    continue
                rho = grad[j] + a[j, j] * w[j]
                new = np.sign(rho) * max(abs(rho) - self.l1, 0.0) / (a[j, j] + self.l2)
                if new != w[j]:
                    biggest = max(biggest, abs(new - w[j]) * np.sqrt(a[j, j]))
                    grad -= a[:, j] * (new - w[j])
                    w[j] = new
            if biggest < self.tolerance * (np.sqrt(np.abs(b)).max() + 1e-300):
                return w, sweep
        return w, self.max_iter


def lasso(alpha: float, **kw) -> Linear:
    return Linear(l1=alpha, **kw)


def elastic_net(alpha: float, l1_ratio: float, **kw) -> Linear:
    return Linear(l1=alpha * l1_ratio, l2=alpha * (1 - l1_ratio), **kw)


def ridge(l2: float, **kw) -> Linear:
    return Linear(l2=l2, **kw)


def ols(**kw) -> Linear:
    return Linear(**kw)


@dataclass(frozen=True)
class Grams:
    """Cross products of (1, features - shift, target - shift) per fold."""

    features: tuple[str, ...]
    target: str
    shift: np.ndarray
    folds: dict[int, np.ndarray] = field(default_factory=dict)

    @property
    def total(self) -> np.ndarray:
        d = len(self.features) + 2
        return sum(self.folds.values(), np.zeros((d, d)))

    def subset(self, features: Sequence[str]) -> Grams:
        at = {c: i + 1 for i, c in enumerate(self.features)}
        pick = [0, *[at[c] for c in features], len(self.features) + 1]
        return Grams(
            tuple(features),
            self.target,
            self.shift[[p - 1 for p in pick[1:]]],
            {k: g[np.ix_(pick, pick)] for k, g in self.folds.items()},
        )

    def regroup(self, fold_of: dict[int, int]) -> Grams:
        """Merge fine buckets into folds."""
        merged: dict[int, np.ndarray] = {}
        for bucket, g in self.folds.items():
            k = fold_of[bucket]
            merged[k] = merged.get(k, 0) + g
        return Grams(self.features, self.target, self.shift, merged)

    def without_row(self, row: np.ndarray, fold: int) -> Grams:
        """The statistics without one row (features, target) of a fold."""
        v = np.concatenate([[1.0], row - self.shift])
        folds = {**self.folds, fold: self.folds[fold] - np.outer(v, v)}
        return Grams(self.features, self.target, self.shift, folds)

    def fit(self, recipe: Linear, without: int | None = None, warm=None) -> Model:
        raw = self.total if without is None else self.total - self.folds[without]
        if not recipe.intercept:
            raw = self._unshifted(raw)
            w, _, it = recipe.solve(Moments.of(raw), warm)
            return Model(self.features, tuple(map(float, w)), 0.0, it)
        w, bias, it = recipe.solve(Moments.of(raw), warm)
        bias = float(bias + self.shift[-1] - w @ self.shift[:-1])
        return Model(self.features, tuple(map(float, w)), bias, it)

    def _unshifted(self, raw: np.ndarray) -> np.ndarray:
        t = np.eye(len(raw))
        t[1:, 0] = self.shift
        return t @ raw @ t.T

    def squared_error(self, model: Model, raw: np.ndarray) -> float:
        """Sum of squared errors of a model over the rows behind ``raw``."""
        w = np.asarray(model.coefs)
        bias = model.intercept - self.shift[-1] + float(w @ self.shift[:-1])
        v = np.concatenate([[-bias], -w, [1.0]])
        return max(float(v @ raw @ v), 0.0)

    def rmse(self, model: Model, fold: int | None = None) -> float:
        raw = self.total if fold is None else self.folds[fold]
        return float(np.sqrt(self.squared_error(model, raw) / raw[0, 0]))

    def cv_scores(self, recipe: Linear) -> dict[int, float]:
        """RMSE on each fold of the model fitted on the other folds."""
        out, warm = {}, None
        for k in sorted(self.folds):
            if self.folds[k][0, 0] == 0:
                continue
            model = self.fit(recipe, without=k, warm=warm)
            warm = np.asarray(model.coefs) if recipe.l1 else None
            out[k] = self.rmse(model, k)
        return out

    def cv_rmse(self, recipe: Linear) -> float:
        """Unweighted mean of the fold scores."""
        return float(np.mean(list(self.cv_scores(recipe).values())))

    def std(self) -> np.ndarray:
        """Population standard deviation of each feature over all folds."""
        m = Moments.of(self.total)
        return np.sqrt(np.maximum(np.diag(m.cross)[:-1] / max(m.n, 1.0), 0.0))


# widest set of columns whose covariances are taken by JVM aggregates
JVM_WIDTH = 6
# tasks that merge the partial results; the driver receives one row per such task and fold
MERGE_TASKS = 32


def fold_grams(
    df: DataFrame, features: Sequence[str], target: str, fold: Column | None = None
) -> Grams:
    """Cross products per fold, in one pass.

    Rows with a null or NaN among features and target are left out, and an infinite number among
    the rest is an error, however many columns there are.  A few columns use covariance
    aggregates; more are multiplied block by block with NumPy, where every task centres its
    rows on their own mean, so that large means cost no digits.
    """
    features = list(features)
    names = [*features, target]
    rows = df.select(
        *[F.col(c).cast("double").alias(c) for c in names],
        (fold if fold is not None else F.lit(0)).cast("int").alias("__fold"),
    )
    if len(names) <= JVM_WIDTH:
        parts = _covariances(rows, names)
    else:
        parts = _block_moments(rows, names)
    whole = Moments(0.0, np.zeros(len(names)), np.zeros((len(names), len(names))))
    for m in parts.values():
        whole = whole.plus(m)
    folds = {k: m.about(whole.mean) for k, m in parts.items()}
    return Grams(tuple(features), target, whole.mean, folds)


def _covariances(rows: DataFrame, names: list[str]) -> dict[int, Moments]:
    d = len(names)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    found = (
        rows.dropna(subset=names)
        .groupBy("__fold")
        .agg(
            F.count("*").alias("n"),
            F.array(*[F.avg(c) for c in names]).alias("mean"),
            F.array(*[F.covar_pop(names[i], names[j]) for i, j in pairs]).alias("cov"),
            F.array(*[F.max(F.abs(c)) for c in names]).alias("most"),
        )
        .collect()
    )
    for r in found:
        _refuse_infinite(names, np.isinf(np.array(r["most"])))
    out = {}
    for r in found:
        cross = np.zeros((d, d))
        for (i, j), v in zip(pairs, r["cov"]):
            cross[i, j] = cross[j, i] = v * r["n"]
        out[r["__fold"]] = Moments(float(r["n"]), np.array(r["mean"]), cross)
    return out


def _refuse_infinite(names: list[str], found: np.ndarray) -> None:
    if found.any():
        raise ValueError(f"infinite values in {[n for n, bad in zip(names, found) if bad]}")


def _block_moments(rows: DataFrame, names: list[str]) -> dict[int, Moments]:
    d = len(names)
    at = np.triu_indices(d)
    schema = "fold int, n double, mean array<double>, cross array<double>"

    def pack(moments: dict[int, Moments]):
        import pandas as pd

        return pd.DataFrame(
            {
                "fold": list(moments),
                "n": [m.n for m in moments.values()],
                "mean": [m.mean.tolist() for m in moments.values()],
                "cross": [m.cross[at].tolist() for m in moments.values()],
            }
        )

    def unpack(r) -> Moments:
        cross = np.zeros((d, d))
        cross[at] = r.cross
        cross = cross + np.triu(cross, 1).T
        return Moments(r.n, np.asarray(r.mean, dtype=float), cross)

    def scan(batches: Iterator):
        sums: dict[int, Moments] = {}
        for pdf in batches:
            x = pdf[names].to_numpy(dtype=float)
            # incomplete rows are dropped here: as a filter, the test for nulls would repeat the
            # expression behind every column
            whole = ~np.isnan(x).any(axis=1)
            x, fold = x[whole], pdf["__fold"].to_numpy()[whole]
            _refuse_infinite(names, np.isinf(x).any(axis=0))
            for k in np.unique(fold):
                part = Moments.of_rows(x[fold == k])
                sums[int(k)] = sums[int(k)].plus(part) if int(k) in sums else part
        if sums:
            yield pack(sums)

    def merge(batches: Iterator):
        sums: dict[int, Moments] = {}
        for pdf in batches:
            for r in pdf.itertuples():
                m = unpack(r)
                sums[r.fold] = sums[r.fold].plus(m) if r.fold in sums else m
        if sums:
            yield pack(sums)

    # partials of one fold are spread over the merging tasks, each of which keeps one running sum
    merged = rows.mapInPandas(scan, schema).repartition(MERGE_TASKS).mapInPandas(merge, schema)
    out: dict[int, Moments] = {}
    for r in merged.collect():
        m = unpack(r)
        out[r["fold"]] = out[r["fold"]].plus(m) if r["fold"] in out else m
    return out
