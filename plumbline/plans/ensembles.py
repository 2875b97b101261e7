"""Several models fitted per fold at once, and what is built on their out-of-fold predictions.

A base fits "all folds but one" for every fold, and all rows, together: linear ones from one pass of
per-fold cross products, boosted trees by growing the models side by side.  Out-of-fold predictions
are then one more scan, in which each row takes the model that has not seen its fold.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from math import sqrt
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.metrics import rmse
from plumbline.operators.sampling import hash_split
from plumbline.plans import trees
from plumbline.plans.gram import Linear, Model, elastic_net, fold_grams, lasso
from plumbline.plans.storage import materialize
from plumbline.table import FeatureTable

FOLD = "__fold"


class Fitted(Protocol):
    def predict(self, rows: DataFrame, name: str, fold: str | None = None) -> DataFrame: ...


class Base(Protocol):
    """Fits on rows that hold the features, the target, an id and, with ``folds``, ``FOLD``."""

    def fit(self, rows: DataFrame, features: Sequence[str], target: str, id: str, folds: int) -> Fitted: ...


# --- linear bases


def quadratic_map(features: Sequence[str], coef0: float) -> dict[str, Column]:
    """Columns whose inner products are (x . z + coef0)^2."""
    x = [F.col(c).cast("double") for c in features]
    out = {"__q": F.lit(float(coef0))}
    if coef0:
        out |= {f"__q_{i}": a * sqrt(2 * coef0) for i, a in enumerate(x)}
    for i, a in enumerate(x):
        out[f"__q_{i}_{i}"] = a * a
        out |= {f"__q_{i}_{j}": a * x[j] * sqrt(2.0) for j in range(i + 1, len(x))}
    return out


@dataclass(frozen=True)
class LinearFolds:
    """Linear models per left-out fold, and the one on all rows, over mapped columns."""

    mapped: dict[str, Column]
    folds: dict[int, Model]
    whole: Model

    def predict(self, rows: DataFrame, name: str, fold: str | None = None) -> DataFrame:
        out = rows.withColumns(self.mapped) if self.mapped else rows
        value = self.whole.predict()
        if fold is not None:
            for k, model in self.folds.items():
                value = F.when(F.col(fold) == k, model.predict()).otherwise(value)
        return out.withColumn(name, value).drop(*self.mapped)


@dataclass(frozen=True)
class LinearBase:
    """A linear model of all features, or of the named ones."""

    recipe: Linear
    columns: tuple[str, ...] | None = None

    def fit(self, rows, features, target, id, folds=0) -> LinearFolds:
        grams = fold_grams(rows, self.columns or features, target, F.col(FOLD) if folds else None)
        parts = {k: grams.fit(self.recipe, without=k) for k in sorted(grams.folds) if folds}
        return LinearFolds({}, parts, grams.fit(self.recipe))


@dataclass(frozen=True)
class KernelBase:
    """Kernel ridge regression with the kernel (x . z + coef0)^2, from its finite feature map.

    The squared errors are summed, not averaged, against ``alpha`` times the squared length, and
    there is no intercept.  The map has (d + 1)(d + 2) / 2 columns, whatever the number of rows.
    """

    alpha: float = 0.6
    coef0: float = 2.5

    def fit(self, rows, features, target, id, folds=0) -> LinearFolds:
        mapped = quadratic_map(features, self.coef0)
        fold = F.col(FOLD) if folds else None
        grams = fold_grams(rows.withColumns(mapped), list(mapped), target, fold)
        total = grams.total[0, 0]

        def recipe(n: float) -> Linear:
            return Linear(l2=self.alpha / max(n, 1.0), intercept=False)

        parts = {
            k: grams.fit(recipe(total - grams.folds[k][0, 0]), without=k) for k in sorted(grams.folds) if folds
        }
        return LinearFolds(mapped, parts, grams.fit(recipe(total)))


@dataclass(frozen=True)
class TreeBase:
    recipe: trees.Boosting

    def fit(self, rows, features, target, id, folds=0) -> trees.Boosted:
        fold = F.col(FOLD) if folds else None
        return trees.boost(rows, features, target, self.recipe, id, fold, folds)


def final_bases(n_features: int, most_trees: int | None = None) -> dict[str, Base]:
    """The six models of the final ensemble; ``most_trees`` bounds the boosted ones."""
    boosted = {
        "huber_trees": trees.huber_trees(n_features),
        "level_trees": trees.level_trees(),
        "leaf_trees": trees.leaf_trees(),
    }
    if most_trees is not None:
        boosted = {k: r.smaller(min(r.trees, most_trees)) for k, r in boosted.items()}
    linear = {"lasso": LinearBase(lasso(0.0005)), "elastic_net": LinearBase(elastic_net(0.0005, 0.9))}
    return {**linear, "kernel_ridge": KernelBase(), **{k: TreeBase(r) for k, r in boosted.items()}}


# --- ensembles


def fit_all(
    rows: DataFrame, bases: Mapping[str, Base], features: Sequence[str], target: str, id: str, folds: int = 0
) -> dict[str, Fitted]:
    # boosted models of a small table take one task each, so those of all bases are grown at once
    with ThreadPoolExecutor(max(len(bases), 1)) as pool:
        jobs = {name: pool.submit(base.fit, rows, features, target, id, folds) for name, base in bases.items()}
        return {name: job.result() for name, job in jobs.items()}


def predict_all(rows: DataFrame, fitted: Mapping[str, Fitted], fold: str | None = None) -> DataFrame:
    for name, model in fitted.items():
        rows = model.predict(rows, name, fold)
    return rows


def mean_of(fitted: Mapping[str, Fitted]) -> Column:
    """Average of the models' predictions."""
    return sum((F.col(c) for c in fitted), F.lit(0.0)) / len(fitted)


@dataclass(frozen=True)
class Stack:
    """``level``: train ids, target and out-of-fold predictions; ``test``: ids, base predictions
    by the models on all rows, and the final ``prediction``."""

    level: DataFrame
    test: DataFrame
    names: tuple[str, ...]
    meta: Base
    target: str
    id: str

    def score(self, test_share: float = 0.4, seed: int = 0) -> DataFrame:
        """One-row RMSE of the meta model on a share of the train rows that it has not seen."""
        parted = hash_split(self.level, self.id, test_share, seed)
        model = self.meta.fit(parted.where("part <> 'test'"), self.names, self.target, self.id, 0)
        scored = model.predict(parted.where("part = 'test'"), "prediction")
        return scored.agg(rmse("prediction", self.target).alias("score"))


def stack(
    table: FeatureTable, features: Sequence[str], bases: Mapping[str, Base], meta: Base, fold: Column, folds: int
) -> Stack:
    """A meta model on the out-of-fold predictions of base models.

    ``fold`` numbers the train rows' folds from 0.  Every base is fitted for all folds together;
    test rows use the bases fitted on all train rows.
    """
    spec = table.spec
    train = materialize(table.train.select(spec.id, *features, spec.target, fold.cast("int").alias(FOLD)))
    fitted = fit_all(train, bases, features, spec.target, spec.id, folds)
    level = materialize(predict_all(train, fitted, FOLD).select(spec.id, spec.target, *bases))
    combine = meta.fit(level, list(bases), spec.target, spec.id, 0)
    test = predict_all(table.test.select(spec.id, *features), fitted)
    test = combine.predict(test, "prediction").select(spec.id, *bases, "prediction")
    return Stack(level, test, tuple(bases), meta, spec.target, spec.id)


def averaged_scores(table: FeatureTable, features: Sequence[str], bases: Mapping[str, Base]) -> DataFrame:
    """Train rows with ``predicted``, the mean of models fitted on them, and ``score``, its error."""
    spec = table.spec
    train = materialize(table.train.select(spec.id, *features, spec.target))
    fitted = fit_all(train, bases, features, spec.target, spec.id)
    out = predict_all(train, fitted).withColumn("predicted", mean_of(fitted)).drop(*fitted)
    return out.withColumn("score", F.abs(F.col("predicted") - F.col(spec.target)))


@dataclass(frozen=True)
class ErrorModel:
    """Models of the row score: ``metrics`` (metric, value) and ``rows`` with ``error`` added.

    Metrics are ``baseline``, the RMSE of the mean score; ``train``, that of the models on the
    rows they were fitted on; and ``cv``, the mean of the folds' RMSE.
    """

    metrics: DataFrame
    rows: DataFrame
    fitted: dict[str, Fitted]


def error_model(
    scored: DataFrame, features: Sequence[str], id: str, bases: Mapping[str, Base], fold: Column, folds: int
) -> ErrorModel:
    """How well the features tell which rows are predicted badly."""
    rows = materialize(scored.withColumn(FOLD, fold.cast("int")))
    fitted = fit_all(rows, bases, features, "score", id, folds)
    own = predict_all(rows, fitted).withColumn("error", mean_of(fitted)).drop(*fitted)
    unseen = predict_all(own, fitted, FOLD).withColumn("__cv", mean_of(fitted)).drop(*fitted)
    parts = unseen.groupBy(FOLD).agg(
        F.count("*").alias("n"),
        F.sum("score").alias("s"),
        F.sum(F.pow(F.col("error") - F.col("score"), 2)).alias("train"),
        F.avg(F.pow(F.col("__cv") - F.col("score"), 2)).alias("cv"),
        F.var_pop("score").alias("v"),
    )
    mean = F.sum("s") / F.sum("n")
    spread = F.sum(F.col("n") * F.col("v") + F.col("s") * F.col("s") / F.col("n")) / F.sum("n") - mean * mean
    whole = parts.agg(
        F.sqrt(spread).alias("baseline"),
        F.sqrt(F.sum("train") / F.sum("n")).alias("train"),
        F.avg(F.sqrt("cv")).alias("cv"),
    )
    metrics = whole.unpivot([], ["baseline", "train", "cv"], "metric", "value")
    return ErrorModel(metrics, own.drop(FOLD), fitted)
