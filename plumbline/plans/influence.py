"""Influence of single rows on penalised linear models, and greedy removal of rows.

A fit without one row changes its cross products by a rank-one term.  As long as the set of
coefficients that are not zero, and their signs, stay the same, the new coefficients are a rank-one
update of the old ones.  Whether they do is read off the optimality conditions; where they do not, those name the columns to try, and
what no try settles is solved from the row's own downdated cross products.  All rows are scored in
one scan, and no row reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.plans.gram import Grams, Linear, Moments, fold_grams
from plumbline.plans.storage import materialize
from plumbline.table import FeatureTable

FOLD = "__fold"
TRIES = 6  # sets of active columns a row tries before it is solved apart
LOOSE = 1e-9  # relative rounding allowance of the optimality conditions


@dataclass(frozen=True)
class Downdate:
    """The fit on some rows, ready to lose any one of them."""

    recipe: Linear
    moments: Moments
    coefs: np.ndarray

    @classmethod
    def of(cls, recipe: Linear, moments: Moments) -> Downdate:
        return cls(recipe, moments, recipe.solve(moments)[0])

    def without(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(coefficients, intercepts, changed) of the fits without each of the given rows, which
        hold the features and the target; ``changed`` marks those with other active columns.

        Rows whose optimality conditions fail try the active columns and signs that the failed
        conditions name, all rows with the same ones at once; what is left then is solved apart.
        """
        m = self.moments
        u = rows - m.mean
        width = len(self.coefs)
        first = np.sign(self.coefs).astype(np.int8) if self.recipe.l1 else np.ones(width, np.int8)
        signs = np.tile(first, (len(rows), 1))
        w = np.zeros((len(rows), width))
        todo = np.arange(len(rows))
        for _ in range(TRIES):
            kinds, kind = np.unique(signs[todo], axis=0, return_inverse=True)
            failed = []
            for i, sign in enumerate(kinds):
                own = todo[kind.ravel() == i]
                w[own], right, signs[own] = self._update(u[own], sign)
                failed.append(own[~right])
            todo = np.concatenate(failed) if failed else todo
            if not len(todo):
                break
        for i in todo:
            left = m.n - 1
            cross = m.cross - (m.n / left) * np.outer(u[i], u[i])
            w[i] = self.recipe.solve(Moments(left, m.mean - u[i] / left, cross), self.coefs)[0]
        mean = m.mean - u / (m.n - 1)
        bias = mean[:, -1] - (w * mean[:, :-1]).sum(axis=1)
        changed = (np.sign(w) != first).any(axis=1) if self.recipe.l1 else np.zeros(len(rows), bool)
        return w, bias, changed

    def _update(self, u: np.ndarray, sign: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(coefficients, optimal, signs to try next) without each row, by a rank-one update of the
        solution with the given signs."""
        m, l1 = self.moments, self.recipe.l1
        left = m.n - 1
        grow = m.n / left
        cross, right = m.cross[:-1, :-1], m.cross[:-1, -1]
        on = np.flatnonzero(sign)
        inverse = cross[np.ix_(on, on)] + left * self.recipe.l2 * np.eye(len(on))
        inverse = np.linalg.pinv(inverse, hermitian=True, rcond=1e-11)
        w = np.zeros((len(u), len(sign)))
        reach = u[:, on] @ inverse
        with np.errstate(divide="ignore", invalid="ignore"):
            plain = inverse @ (right[on] - left * l1 * sign[on]) - grow * u[:, -1:] * reach
            spare = 1 - grow * (reach * u[:, on]).sum(axis=1)
            w[:, on] = plain + grow * reach * ((u[:, on] * plain).sum(axis=1) / spare)[:, None]
        fine = np.isfinite(w).all(axis=1) & (spare > 1e-10)
        after = np.tile(sign, (len(u), 1))
        if l1:
            w[~fine] = 0
            slope = right - w @ cross - grow * u[:, :-1] * (u[:, -1] - (u[:, :-1] * w).sum(axis=1))[:, None]
            leave = (sign != 0) & (w * sign <= 0)
            enter = (sign == 0) & (np.abs(slope) > left * l1 * (1 + LOOSE))
            after[leave] = 0
            after[enter] = np.sign(slope[enter])
            fine &= ~(leave | enter).any(axis=1)
        return w, fine, after


def influence(rows: DataFrame, grams: Grams, id: str, recipe: Linear) -> DataFrame:
    """(id, score, changed): mean over the folds of the RMSE on the fold, with that row left out
    of the fits and of the scores.

    ``rows`` holds the id, features, target and ``FOLD`` of the rows to try, each of which is among
    those behind ``grams``.  A score below that of all rows says that the row does harm.
    ``changed`` counts the fits whose active columns change without the row.
    """
    if not recipe.intercept:
        raise ValueError("influence needs a model with an intercept")
    names, shift = [*grams.features, grams.target], grams.shift
    total = grams.total
    fits = {k: (Downdate.of(recipe, Moments.of(total - g)), g) for k, g in grams.folds.items()}
    kind = dict(rows.dtypes)[id]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            z = pdf[names].to_numpy(dtype=float) - shift
            own = pdf[FOLD].to_numpy()
            scores, moved = [], np.zeros(len(pdf), np.int64)
            for k, (fit, g) in fits.items():
                mine = own == k
                w, bias, changed = fit.without(z)
                whole = fit.coefs
                w[mine] = whole
                bias[mine] = fit.moments.mean[-1] - whole @ fit.moments.mean[:-1]
                v = np.column_stack([-bias, -w, np.ones(len(z))])
                sse = ((v @ g) * v).sum(axis=1)
                error = z[:, -1] - bias - (w * z[:, :-1]).sum(axis=1)
                sse, n = np.where(mine, sse - error * error, sse), np.where(mine, g[0, 0] - 1, g[0, 0])
                scores.append(np.sqrt(np.maximum(sse, 0) / n))
                moved += changed & ~mine
            yield pd.DataFrame({id: pdf[id], "score": np.mean(scores, axis=0), "changed": moved})

    return rows.mapInPandas(run, f"`{id}` {kind}, score double, changed long")


def complete_rows(table: FeatureTable, features, fold: Column) -> DataFrame:
    """Id, features, target and ``FOLD`` of the train rows that hold all of them."""
    names = [*features, table.spec.target]
    rows = table.train.dropna(subset=names)
    return rows.select(table.spec.id, *names, fold.cast("int").alias(FOLD))


def row_influence(table: FeatureTable, features, fold: Column, recipe: Linear) -> DataFrame:
    """(id, score, changed) of every train row."""
    rows = complete_rows(table, features, fold)
    grams = fold_grams(rows, features, table.spec.target, F.col(FOLD))
    return influence(rows, grams, table.spec.id, recipe)


def greedy_removal(
    table: FeatureTable, features, fold: Column, recipe: Linear, candidates: DataFrame | None = None,
    max_rounds: int | None = None,
) -> tuple[list, DataFrame]:
    """Take out the candidate whose absence scores best, again and again, until none helps.

    ``candidates`` has the ids to try; without it every train row is one.  A round scores all
    candidates in one scan.  Returns the ids and a (round, id, score) history that starts with the
    score of all rows.
    """
    key, names = table.spec.id, [*features, table.spec.target]
    rows = materialize(complete_rows(table, features, fold))
    grams = fold_grams(rows, features, table.spec.target, F.col(FOLD))
    if candidates is not None:
        rows = materialize(rows.join(candidates.select(key).distinct(), key, "left_semi"))
    best = grams.cv_rmse(recipe)
    history: list[tuple] = [(0, None, best)]
    gone: list = []
    for turn in count(1) if max_rounds is None else range(1, max_rounds + 1):
        top = influence(rows.where(~F.col(key).isin(gone)), grams, key, recipe).orderBy("score", key).first()
        if top is None or not top["score"] < best:
            break
        best = top["score"]
        gone.append(top[key])
        history.append((turn, top[key], best))
        row = rows.where(F.col(key) == top[key]).first()
        grams = grams.without_row(np.array([row[c] for c in names], dtype=float), row[FOLD])
    kind = dict(rows.dtypes)[key]
    out = table.df.sparkSession.createDataFrame(history, f"round int, id {kind}, score double")
    return gone, out
