"""Row scores, studentized residuals and leave-one-out influence of linear models."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import count

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.tdist import t_two_sided
from plumbline.operators.columns import drop_rows
from plumbline.operators.joins import rank_compare
from plumbline.plans.gram import Grams, Linear, Model, fold_grams
from plumbline.table import FeatureTable


def row_scores(table: FeatureTable, model: Model) -> DataFrame:
    """Train rows with ``predicted`` and ``score``, the absolute residual."""
    y = F.col(table.spec.target)
    out = table.train.withColumn("predicted", model.predict())
    return out.withColumn("score", F.abs(F.col("predicted") - y))


def with_fit(table: FeatureTable, features: Sequence[str], recipe: Linear) -> DataFrame:
    grams = fold_grams(table.train, features, table.spec.target)
    return row_scores(table, grams.fit(recipe))


def studentized(
    table: FeatureTable, features: Sequence[str], intercept: bool = False
) -> DataFrame:
    """Train rows with externally studentized residual ``t``, its p-value and Bonferroni p-value.

    A residual is scaled by the error estimate of the fit without its row.
    """
    grams = fold_grams(table.train, features, table.spec.target)
    return studentized_from(table, grams, intercept)


def studentized_from(table: FeatureTable, grams: Grams, intercept: bool) -> DataFrame:
    features = list(grams.features)
    target = table.spec.target
    raw = grams.total
    if not intercept:
        raw = grams._unshifted(raw)
    first = 0 if intercept else 1
    gram = raw[first:-1, first:-1]
    inverse = np.linalg.pinv(gram, hermitian=True, rcond=1e-11)
    beta = inverse @ raw[first:-1, -1]
    rank = int(np.linalg.matrix_rank(gram, hermitian=True, tol=1e-11 * np.abs(gram).max()))
    n = raw[0, 0]
    sse = float(raw[-1, -1] - beta @ raw[first:-1, -1])
    shift = grams.shift if intercept else np.zeros(len(grams.shift))
    dof = n - rank - 1

    rows = table.train.dropna(subset=[*features, target])
    extra = [T.StructField(n, T.DoubleType()) for n in ("t", "p", "bonf_p")]
    schema = T.StructType([*rows.schema.fields, *extra])

    def score(batches: Iterator):
        for pdf in batches:
            x = pdf[features].to_numpy(dtype=float) - shift[:-1]
            if intercept:
                x = np.column_stack([np.ones(len(x)), x])
            e = pdf[target].to_numpy(dtype=float) - shift[-1] - x @ beta
            spare = 1.0 - ((x @ inverse) * x).sum(axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                var = (sse - e * e / spare) / dof
                t = e / np.sqrt(var * spare)
            p = t_two_sided(t, dof)
            yield pdf.assign(t=t, p=p, bonf_p=np.minimum(p * n, 1.0))

    return rows.mapInPandas(score, schema)


def drop_outliers(
    table: FeatureTable,
    features: Sequence[str],
    max_bonferroni: float = 1e-3,
    intercept: bool = False,
) -> FeatureTable:
    """Remove train rows whose Bonferroni p-value is below the limit.

    The stricter form of the test uses an intercept and the limit 0.5.
    """
    flagged = studentized(table, features, intercept).where(F.col("bonf_p") < max_bonferroni)
    return drop_rows(table, flagged.select(table.spec.id))


def loo_influence(
    table: FeatureTable, features: Sequence[str], fold, ridge: float = 0.0
) -> DataFrame:
    """(id, score): cross-validated RMSE of the least-squares fit with that train row left out.

    Each fold's fit loses a row by a rank-one update, so all rows are scored in one scan.  The
    mean is taken over folds; a large score means that the row helps the fit.
    """
    grams = fold_grams(table.train, features, table.spec.target, fold)
    return loo_from(table, grams, fold, ridge)


def loo_from(table: FeatureTable, grams: Grams, fold, ridge: float = 0.0) -> DataFrame:
    key, target = table.spec.id, table.spec.target
    features = list(grams.features)
    total, shift = grams.total, grams.shift
    d = len(features) + 1
    fits = {}
    for k, g in grams.folds.items():
        rest = total - g
        a = rest[:d, :d] + ridge * np.diag([0.0] + [1.0] * (d - 1))
        inverse = np.linalg.pinv(a, hermitian=True, rcond=1e-11)
        fits[k] = (inverse, inverse @ rest[:d, -1], g)

    def score(batches: Iterator):
        import pandas as pd

        for pdf in batches:
            x = pdf[features].to_numpy(dtype=float) - shift[:-1]
            x = np.column_stack([np.ones(len(x)), x])
            y = pdf[target].to_numpy(dtype=float) - shift[-1]
            own = pdf["__fold"].to_numpy()
            parts = []
            for k, (inverse, w, g) in fits.items():
                mine = own == k
                e = y - x @ w
                reach = x @ inverse
                step = np.where(mine, 0.0, e / (1.0 - (reach * x).sum(axis=1)))
                w_row = w - reach * step[:, None]
                sse = g[-1, -1] - 2 * (w_row @ g[:d, -1]) + ((w_row @ g[:d, :d]) * w_row).sum(1)
                sse = np.where(mine, sse - e * e, sse)
                n = np.where(mine, g[0, 0] - 1, g[0, 0])
                parts.append(np.sqrt(np.maximum(sse, 0.0) / n))
            yield pd.DataFrame({key: pdf[key], "score": np.mean(parts, axis=0)})

    rows = table.train.dropna(subset=[*features, target]).select(
        key, *features, target, fold.cast("int").alias("__fold")
    )
    kind = dict(rows.dtypes)[key]
    return rows.mapInPandas(score, f"`{key}` {kind}, score double")


def error_model(
    scored: DataFrame, features: Sequence[str], id: str, recipe: Linear
) -> tuple[Model, DataFrame]:
    """Model of the row score, and (id, actual_rank, predicted_rank) of its worst rows.

    Rows are ranked by their score and by how badly the error model predicts that score.
    """
    model = fold_grams(scored, features, "score").fit(recipe)
    second = scored.withColumn("error_score", F.abs(model.predict() - F.col("score")))
    return model, rank_compare(second, id, "score", "error_score")


def greedy_removal(
    table: FeatureTable, features: Sequence[str], fold, max_rounds: int | None = None
) -> tuple[list[int], DataFrame]:
    """Take out one train row per round, the one whose absence scores best, while that helps.

    Every round scores the removal of each row in one scan.  Returns the ids and a
    (round, id, score) history that starts with the score of all rows.
    """
    key, names = table.spec.id, [*features, table.spec.target]
    grams = fold_grams(table.train, features, table.spec.target, fold)
    best = grams.cv_rmse(Linear())
    history: list[tuple] = [(0, None, best)]
    gone: list[int] = []
    cur = table
    for r in count(1) if max_rounds is None else range(1, max_rounds + 1):
        top = loo_from(cur, grams, fold).orderBy("score", key).first()
        if top is None or top["score"] >= best:
            break
        best = top["score"]
        gone.append(top[key])
        history.append((r, top[key], best))
        cur = drop_rows(table, gone)
        row = table.train.where(F.col(key) == top[key])
        row = row.select(*names, fold.alias("__fold")).first()
        grams = grams.without_row(np.array([row[c] for c in names], dtype=float), row["__fold"])
    spark = table.df.sparkSession
    return gone, spark.createDataFrame(history, "round int, id bigint, score double")


def outlier_report(
    table: FeatureTable, scored: DataFrame, k: int, **limits
) -> DataFrame:
    """The k worst predicted rows, each with its rare cells.

    Columns: id, actual, predicted, score, and column, value, kind, pct, n of a rare cell (null
    where a row has none).
    """
    from plumbline.operators.joins import worst_k
    from plumbline.operators.quality import row_rarity

    key = table.spec.id
    worst = worst_k(
        scored.select(key, F.col(table.spec.target).alias("actual"), "predicted", "score"),
        key,
        "score",
        k,
    )
    rarity = row_rarity(table, rows=worst, **limits)
    return worst.join(rarity, key, "left")
