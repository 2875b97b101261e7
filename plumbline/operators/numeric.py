"""Numeric transforms: constants are learned from the train rows and applied to all rows."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.plans.quantiles import column_quantiles
from plumbline.plans.storage import SMALL_ROWS
from plumbline.spec import CATEGORICAL, ColumnSpec
from plumbline.table import FeatureTable

# --- logarithm and scaling


def log1p(table: FeatureTable, column: str) -> FeatureTable:
    """Natural log of 1 + x; on the target, its inverse is remembered."""
    out = table.with_columns({column: F.log1p(column)})
    if column == table.spec.target:
        out = replace(out, inverse=(*table.inverse, F.expm1))
    return out


@dataclass(frozen=True)
class Affine:
    """(x - center) / width."""

    center: float
    width: float

    def apply(self, x: Column) -> Column:
        return (x - F.lit(self.center)) / F.lit(self.width)

    def invert(self, z: Column) -> Column:
        return z * F.lit(self.width) + F.lit(self.center)


def fit_zscore(df: DataFrame, columns: Sequence[str]) -> dict[str, Affine]:
    """Mean and population standard deviation; a constant column is only centred."""
    row = df.agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns],
        *[F.stddev_pop(c).alias(f"s_{c}") for c in columns],
    ).first()
    return {
        c: Affine(row[f"m_{c}"], row[f"s_{c}"] or 1.0)
        for c in columns
        if row[f"m_{c}"] is not None
    }


def zscore(table: FeatureTable, columns: Sequence[str] | None = None) -> FeatureTable:
    fitted = fit_zscore(table.train, list(columns or table.numeric))
    return table.with_columns({c: a.apply(F.col(c)) for c, a in fitted.items()})


def robust_scale(
    table: FeatureTable,
    columns: Sequence[str] | None = None,
    small: int = SMALL_ROWS,
    approx: bool = False,
) -> FeatureTable:
    """(x - median) / (upper quartile - lower quartile)."""
    columns = list(columns or table.numeric)
    quarters = {c: (0.25, 0.5, 0.75) for c in columns}
    q = column_quantiles(table.train, quarters, small, approx=approx)
    fitted = {c: Affine(v[1], (v[2] - v[0]) or 1.0) for c, v in q.items() if v}
    return table.with_columns({c: a.apply(F.col(c)) for c, a in fitted.items()})


def scale_target(table: FeatureTable) -> FeatureTable:
    t = table.spec.target
    fitted = fit_zscore(table.train, [t])[t]
    return replace(
        table,
        df=table.df.withColumn(t, fitted.apply(F.col(t))),
        inverse=(*table.inverse, fitted.invert),
    )


def landmark_position(x: Column, marks: Sequence[float]) -> Column:
    """Place in [0, 1] by linear interpolation between equally weighted landmarks.

    Values beyond the ends are clipped; a value on repeated landmarks gets the middle of their
    positions.
    """
    last = len(marks) - 1
    spots: dict[float, list[float]] = {}
    for i, m in enumerate(marks):
        spots.setdefault(m, []).append(i / last)
    knots = sorted(spots)
    expr = F.when(x <= knots[0], 0.0).when(x >= knots[-1], 1.0)
    for a, b in zip(knots, knots[1:]):
        if b != knots[-1]:
            expr = expr.when(x == b, (spots[b][0] + spots[b][-1]) / 2)
        rise = (spots[b][0] - spots[a][-1]) / (b - a)
        expr = expr.when((x > a) & (x < b), spots[a][-1] + (x - F.lit(a)) * F.lit(rise))
    return expr


def quantile_uniform(
    table: FeatureTable,
    columns: Sequence[str] | None = None,
    n_landmarks: int = 10,
    small: int = SMALL_ROWS,
    approx: bool = False,
) -> FeatureTable:
    columns = list(columns or table.numeric)
    probs = [i / (n_landmarks - 1) for i in range(n_landmarks)]
    marks = column_quantiles(table.train, {c: probs for c in columns}, small, approx=approx)
    return table.with_columns(
        {c: landmark_position(F.col(c), m) for c, m in marks.items() if m}
    )


# --- binning


def fit_bin_edges(
    table: FeatureTable,
    bins: Iterable[tuple[str, int]],
    small: int = SMALL_ROWS,
    approx: bool = False,
) -> dict[tuple[str, int], list[float] | None]:
    """Inner quantile edges per (column, bin count), all from one quantile fit.

    None where ties leave fewer bins than asked for.
    """
    wanted = list(bins)
    probs: dict[str, list[float]] = {}
    for c, n in wanted:
        probs.setdefault(c, []).extend(i / n for i in range(n + 1))
    probs = {c: sorted(set(p)) for c, p in probs.items()}
    found = column_quantiles(table.train, probs, small, approx=approx)
    out: dict[tuple[str, int], list[float] | None] = {}
    for c, n in wanted:
        at = dict(zip(probs[c], found[c]))
        edges = [at[i / n] for i in range(n + 1)] if at else []
        out[c, n] = edges[1:-1] if len(set(edges)) == n + 1 else None
    return out


def bin_id(x: Column, edges: Sequence[float]) -> Column:
    """Number of edges below x (right-closed bins), as a balanced tree of comparisons."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(x <= F.lit(edges[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return F.when(x.isNotNull(), tree(0, len(edges)))


def quantile_bins(
    table: FeatureTable, bins: dict[str, int], small: int = SMALL_ROWS, approx: bool = False
) -> FeatureTable | None:
    """Replace numeric columns by their bin number as a level; None if a column has too few bins.

    The outer bins are open, so any scored value falls into the level that train rows use.
    """
    edges = fit_bin_edges(table, bins.items(), small, approx)
    if any(e is None for e in edges.values()):
        return None
    spec = table.spec
    for c, n in bins.items():
        spec = spec.with_column(c, ColumnSpec(CATEGORICAL, tuple(str(i) for i in range(n))))
    cols = {c: bin_id(F.col(c), e).cast("string") for (c, _), e in edges.items()}
    return replace(table, df=table.df.withColumns(cols), spec=spec)


def bin_flags(x: Column, edges: Sequence[float]) -> list[Column]:
    """0/1 columns for every bin but the first; null gives 0."""
    flags = []
    for i, lo in enumerate(edges):
        inside = x > F.lit(lo)
        if i + 1 < len(edges):
            inside = inside & (x <= F.lit(edges[i + 1]))
        flags.append(F.coalesce(inside, F.lit(False)).cast("int"))
    return flags


def quantile_bin_one_hot(
    table: FeatureTable, bins: dict[str, int], small: int = SMALL_ROWS, approx: bool = False
) -> FeatureTable | None:
    """Replace numeric columns by 0/1 columns of their bins; None if a column has too few bins."""
    edges = fit_bin_edges(table, bins.items(), small, approx)
    if any(e is None for e in edges.values()):
        return None
    flags = {
        f"{c}_{i + 1}": flag
        for (c, _), e in edges.items()
        for i, flag in enumerate(bin_flags(F.col(c), e))
    }
    kept = [c for c in table.df.columns if c not in bins]
    df = table.df.select(*kept, *[e.alias(n) for n, e in flags.items()])
    return replace(table, df=df, spec=table.spec.without(*bins).with_numeric(flags))


def apply_recipe(
    table: FeatureTable, steps: Sequence[tuple[str, str]], small: int = SMALL_ROWS
) -> FeatureTable:
    """Run a transform plan: ``quantile_bin_<n>``, ``lower`` or ``pass`` per column.

    A column with too few distinct quantiles for its bins passes through unbinned.
    """
    bins = {c: int(s.rsplit("_", 1)[1]) for c, s in steps if s.startswith("quantile_bin_")}
    edges = fit_bin_edges(table, bins.items(), small)
    out = {c: bin_id(F.col(c), e) for (c, _), e in edges.items() if e is not None}
    out |= {c: F.lower(c) for c, s in steps if s == "lower"}
    return table.with_columns(out)


# --- linearising against the target


def fit_extract(
    table: FeatureTable, columns: Sequence[str], value: float
) -> dict[str, float | None]:
    """Per column: where the line through the other rows has the value's mean target.

    None where no row holds the value or the other rows give no line.
    """
    y, aggs = F.col(table.spec.target), []
    for c in columns:
        x = F.col(c)
        other = F.when(x != value, x)
        aggs += [
            F.regr_slope(y, other).alias(f"slope_{c}"),
            F.regr_intercept(y, other).alias(f"intercept_{c}"),
            F.avg(F.when(x == value, y)).alias(f"mean_{c}"),
        ]
    fit = table.train.agg(*aggs).first()
    out: dict[str, float | None] = {}
    for c in columns:
        slope, mean = fit[f"slope_{c}"], fit[f"mean_{c}"]
        out[c] = (mean - fit[f"intercept_{c}"]) / slope if slope and mean is not None else None
    return out


def extract_value(table: FeatureTable, column: str, value: float) -> FeatureTable | None:
    """Move one special value to where the line through the other rows has its mean target."""
    moved = fit_extract(table, [column], value)[column]
    if moved is None:
        return None
    x = F.col(column)
    return table.with_columns({column: F.when(x == value, F.lit(moved)).otherwise(x)})


@dataclass(frozen=True)
class Polynomial:
    """Sum of coefs[i] * ((x - center) / width) ** i."""

    coefs: tuple[float, ...]
    center: float
    width: float

    def apply(self, x: Column) -> Column:
        t = (x - F.lit(self.center)) / F.lit(self.width)
        expr = F.lit(self.coefs[-1])
        for c in reversed(self.coefs[:-1]):
            expr = expr * t + F.lit(c)
        return expr


def fit_polynomials(
    table: FeatureTable, columns: Sequence[str], orders: Sequence[int], skip: float | None = None
) -> dict[tuple[str, int], Polynomial | None]:
    """Least-squares polynomials target ~ f(column) per (column, order), from two aggregates.

    None where a column has fewer than two values.
    """
    out: dict[tuple[str, int], Polynomial | None] = {(c, o): None for c in columns for o in orders}
    if not out:
        return out
    y = F.col(table.spec.target)

    def usable(c):
        ok = F.col(c).isNotNull() & y.isNotNull()
        return ok if skip is None else ok & (F.col(c) != skip)

    x = {c: F.when(usable(c), F.col(c).cast("double")) for c in columns}
    first = table.train.agg(
        *[F.avg(x[c]).alias(f"m_{c}") for c in columns],
        *[F.stddev_pop(x[c]).alias(f"s_{c}") for c in columns],
    ).first()
    ok = [c for c in columns if first[f"s_{c}"]]
    if not ok:
        return out
    top, sums = max(orders), []
    for c in ok:
        t = (x[c] - F.lit(first[f"m_{c}"])) / F.lit(first[f"s_{c}"])
        power = F.when(x[c].isNotNull(), F.lit(1.0))
        for k in range(2 * top + 1):
            sums.append(F.sum(power).alias(f"p{k}_{c}"))
            if k <= top:
                sums.append(F.sum(power * y).alias(f"q{k}_{c}"))
            power = power * t
    got = table.train.agg(*sums).first()
    for c, order in ((c, o) for c in ok for o in orders):
        gram = np.array(
            [[got[f"p{i + j}_{c}"] for j in range(order + 1)] for i in range(order + 1)]
        )
        moment = np.array([got[f"q{i}_{c}"] for i in range(order + 1)])
        # fewer values than coefficients leave the system singular: take the smallest solution
        coefs = np.linalg.lstsq(gram, moment, rcond=1e-12)[0]
        out[c, order] = Polynomial(
            tuple(float(v) for v in coefs), first[f"m_{c}"], first[f"s_{c}"]
        )
    return out


def poly_linearize(
    table: FeatureTable, column: str, order: int = 2, skip: float | None = None
) -> FeatureTable | None:
    """Replace a column by its fitted polynomial; rows with the skipped value stay unchanged."""
    fitted = fit_polynomials(table, [column], [order], skip)[column, order]
    if fitted is None:
        return None
    x = F.col(column)
    value = fitted.apply(x)
    if skip is not None:
        value = F.when(x == skip, x).otherwise(value)
    return table.with_columns({column: value})


# --- principal components


def pca(table: FeatureTable, columns: Sequence[str], k: int) -> FeatureTable:
    """Add ``pc_1..pc_k``, fitted on the rows of both splits; the largest loading is positive."""
    from pyspark.ml.feature import PCA, VectorAssembler

    columns = list(columns)
    complete = table.df.dropna(subset=columns)
    means = complete.agg(*[F.avg(c).alias(c) for c in columns]).first()
    centred = complete.select(*[(F.col(c) - F.lit(means[c])).alias(c) for c in columns])
    vectors = VectorAssembler(inputCols=columns, outputCol="v").transform(centred)
    loadings = PCA(k=k, inputCol="v", outputCol="p").fit(vectors).pc.toArray()
    new = {}
    for j in range(k):
        w = loadings[:, j]
        w = w * (1.0 if w[np.argmax(np.abs(w))] > 0 else -1.0)
        expr = F.lit(0.0)
        for c, weight in zip(columns, w):
            expr = expr + (F.col(c) - F.lit(means[c])) * F.lit(float(weight))
        new[f"pc_{j + 1}"] = expr
    return table.with_numeric(new)
