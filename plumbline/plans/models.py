"""Fitting, cross-validation, ensembles and stacking on feature tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.ml import Estimator, Transformer
from pyspark.ml.feature import PolynomialExpansion, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.metrics import rmse
from plumbline.plans.gram import Grams, Linear, Model, fold_grams, lasso, ridge
from plumbline.plans.storage import materialize
from plumbline.table import FeatureTable

# fits a frame that has the features and the target, and returns "frame -> frame with prediction"
Fitter = Callable[[DataFrame], Callable[[DataFrame], DataFrame]]


# --- linear models


def fit_linear(table: FeatureTable, features: Sequence[str], recipe: Linear) -> Model:
    return fold_grams(table.train, features, table.spec.target).fit(recipe)


def coef_report(table: FeatureTable, model: Model, top: int = 20) -> DataFrame:
    """(column, coef, n_off_mode) of the largest coefficients.

    ``n_off_mode`` counts the train rows that do not hold the column's most frequent value.
    """
    from plumbline.operators.quality import mode_count

    spark = table.df.sparkSession
    ranked = sorted(zip(model.features, model.coefs), key=lambda cw: (-abs(cw[1]), cw[0]))[:top]
    coefs = spark.createDataFrame(
        [(c, float(w), abs(float(w))) for c, w in ranked],
        "column string, coef double, abs_coef double",
    )
    modes = mode_count(table, [c for c, _ in ranked])
    n = table.train.count()
    return coefs.join(modes, "column").select(
        "column", "coef", "abs_coef", (F.lit(n) - F.col("mode_n")).alias("n_off_mode")
    )


def lasso_cv(
    table: FeatureTable,
    features: Sequence[str],
    alphas: Sequence[float],
    fold: Column,
    inner_folds: int = 3,
) -> tuple[DataFrame, Model]:
    """Choose alpha inside each outer fold, average the choices and refit on everything.

    Rows fall into outer x inner buckets, so one pass serves every nested fit.
    Returns (fold, alpha, score) per outer fold, and the model.
    """
    from plumbline.operators.sampling import hash_fold

    inner = hash_fold(table.spec.id, inner_folds, seed=7_919)
    bucket = fold * F.lit(inner_folds) + inner
    grams = fold_grams(table.train, features, table.spec.target, bucket)
    outer = sorted({b // inner_folds for b in grams.folds})
    rows = []
    for k in outer:
        rest = {b: b % inner_folds for b in grams.folds if b // inner_folds != k}
        kept = Grams(
            grams.features, grams.target, grams.shift, {b: grams.folds[b] for b in rest}
        ).regroup(rest)
        alpha = min(alphas, key=lambda a: kept.cv_rmse(lasso(a)))
        model = kept.fit(lasso(alpha))
        whole = grams.regroup({b: b // inner_folds for b in grams.folds})
        rows.append((int(k), float(alpha), whole.rmse(model, k)))
    mean_alpha = float(np.mean([r[1] for r in rows]))
    spark = table.df.sparkSession
    chosen = spark.createDataFrame(rows, "fold int, alpha double, score double")
    return chosen, grams.fit(lasso(mean_alpha))


def compare_models(
    table: FeatureTable, features: Sequence[str], recipes: Mapping[str, Linear], fold: Column
) -> DataFrame:
    """(model, cv_rmse) of several linear models, from one pass."""
    grams = fold_grams(table.train, features, table.spec.target, fold)
    rows = [(name, grams.cv_rmse(r)) for name, r in recipes.items()]
    return table.df.sparkSession.createDataFrame(rows, "model string, cv_rmse double")


# --- fitters, for models that need their own passes


def linear_fitter(features: Sequence[str], target: str, recipe: Linear) -> Fitter:
    def fit(df: DataFrame):
        model = fold_grams(df, features, target).fit(recipe)
        return lambda rows: rows.withColumn("prediction", model.predict())

    return fit


def estimator_fitter(features: Sequence[str], target: str, *stages) -> Fitter:
    """Chain of ML stages after a vector assembler; the last one reads ``features``.

    A null feature is an error: fill before, since no row may go missing from a prediction.
    """

    def fit(df: DataFrame):
        chain: list[Transformer] = [
            VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error")
        ]
        cur = chain[0].transform(df)
        for s in stages:
            model = s.fit(cur) if isinstance(s, Estimator) else s
            cur = model.transform(cur) if s is not stages[-1] else cur
            chain.append(model)

        def predict(rows: DataFrame) -> DataFrame:
            out = rows
            for m in chain:
                out = m.transform(out)
            vectors = [n for n, t in out.dtypes if t == "vector"]
            return out.drop(*vectors)

        return predict

    return fit


def gbt_fitter(
    features: Sequence[str],
    target: str,
    max_iter: int = 20,
    max_depth: int = 3,
    step: float = 0.1,
    subsample: float = 1.0,
    feature_subset: str = "all",
    seed: int = 7,
) -> Fitter:
    """Gradient-boosted trees with squared loss."""
    gbt = GBTRegressor(
        featuresCol="features",
        labelCol=target,
        maxIter=max_iter,
        maxDepth=max_depth,
        stepSize=step,
        subsamplingRate=subsample,
        featureSubsetStrategy=feature_subset,
        seed=seed,
    )
    return estimator_fitter(features, target, gbt)


def poly_ridge_fitter(
    features: Sequence[str], target: str, degree: int = 2, l2: float = 0.6
) -> Fitter:
    """Ridge regression on the polynomial expansion of a few features."""
    expand = PolynomialExpansion(degree=degree, inputCol="features", outputCol="expanded")
    reg = LinearRegression(
        featuresCol="expanded", labelCol=target, regParam=l2, elasticNetParam=0.0, solver="auto"
    )
    return estimator_fitter(features, target, expand, reg)


# --- scores


def cv_fold_scores(df: DataFrame, target: str, fitter: Fitter, fold: str) -> DataFrame:
    """(fold, score): RMSE on each fold of a model fitted on the others."""
    folds = [r[0] for r in df.select(fold).distinct().orderBy(fold).collect()]
    out = None
    for k in folds:
        predict = fitter(df.where(F.col(fold) != k))
        scored = predict(df.where(F.col(fold) == k))
        row = scored.agg(rmse("prediction", target).alias("score"))
        row = row.select(F.lit(k).alias("fold"), "score")
        out = row if out is None else out.unionByName(row)
    return out


def split_score(df: DataFrame, target: str, fitter: Fitter, part: str = "part") -> DataFrame:
    """One-row RMSE on ``part = 'test'`` of a model fitted on the other rows."""
    predict = fitter(df.where(F.col(part) != "test"))
    return predict(df.where(F.col(part) == "test")).agg(rmse("prediction", target).alias("score"))


def segment_exclusion(table: FeatureTable, fitter: Fitter, excluded: Column) -> DataFrame:
    """Score over all train rows, and apart by segment, of a model fitted without a segment."""
    hit = F.coalesce(excluded, F.lit(False))
    predict = fitter(table.train.where(~hit))
    scored = predict(table.train).withColumn("excluded", hit.cast("int"))
    return scored.groupBy("excluded").agg(
        F.count("*").alias("n"), rmse("prediction", table.spec.target).alias("score")
    )


def cv_holdout_gap(
    table: FeatureTable,
    features: Sequence[str],
    recipe: Linear,
    k: int,
    holdout_share: float,
    seeds: Sequence[int],
) -> DataFrame:
    """Per seed: cross-validated score on the kept rows, holdout score, and their gap."""
    from plumbline.operators.sampling import fraction, hash_fold

    key, target = table.spec.id, table.spec.target
    seeds, width = list(seeds), k + 1
    # one copy of a row per seed, so that all seeds share one pass
    parts = []
    for i, s in enumerate(seeds):
        held = fraction(key, s) < holdout_share
        fold = F.when(held, F.lit(k)).otherwise(hash_fold(key, k, s + 1_000))
        parts.append(fold + F.lit(i * width))
    copies = table.train.select(*features, target, F.explode(F.array(*parts)).alias("__part"))
    grams = fold_grams(copies, features, target, F.col("__part"))
    rows = []
    for i, s in enumerate(seeds):
        mine = {p - i * width: g for p, g in grams.folds.items() if p // width == i}
        out = mine.pop(k)
        kept = Grams(grams.features, grams.target, grams.shift, mine)
        held_out = Grams(grams.features, grams.target, grams.shift, {0: out})
        cv = kept.cv_rmse(recipe)
        score = held_out.rmse(kept.fit(recipe))
        rows.append((int(s), cv, score, abs(cv - score)))
    return table.df.sparkSession.createDataFrame(
        rows, "seed int, cv_score double, holdout_score double, gap double"
    )


# --- ensembles


def out_of_fold(df: DataFrame, fitter: Fitter, fold: str, name: str, keys: Sequence[str]):
    """(keys, name): prediction of each row by the model that did not see its fold."""
    folds = [r[0] for r in df.select(fold).distinct().orderBy(fold).collect()]
    out = None
    for k in folds:
        predict = fitter(df.where(F.col(fold) != k))
        part = predict(df.where(F.col(fold) == k)).select(*keys, F.col("prediction").alias(name))
        out = part if out is None else out.unionByName(part)
    return out


def stack(
    table: FeatureTable, bases: Mapping[str, Fitter], meta: Callable[[Sequence[str]], Fitter],
    fold: Column,
) -> DataFrame:
    """Test ids with the prediction of a meta model over base models.

    The meta model learns from out-of-fold predictions; test rows use bases fitted on all train
    rows.
    """
    spec = table.spec
    train = materialize(table.train.withColumn("__fold", fold))
    level = train
    for name, fitter in bases.items():
        level = level.join(out_of_fold(train, fitter, "__fold", name, [spec.id]), spec.id)
    level = materialize(level.select(spec.id, spec.target, *bases))
    combine = meta(list(bases))(level)
    scored = table.test
    for name, fitter in bases.items():
        scored = fitter(train)(scored).withColumnRenamed("prediction", name)
    return combine(scored).select(spec.id, *bases, "prediction")


