"""Influence of rows on penalised models, greedy removal and wide ridge regression by brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators.joins import worst_k
from plumbline.plans import influence, outliers, sparse
from plumbline.plans.gram import Linear, Moments, elastic_net, fold_grams, lasso, ols, ridge
from plumbline.spec import SchemaSpec
from plumbline.table import FeatureTable

N, FOLDS = 300, 5
NAMES = [f"x{j}" for j in range(6)]


def by_fold():
    return F.col("id") % FOLDS


def made():
    r = np.random.default_rng(8)
    x = r.normal(size=(N, 6)) * [1, 3, 0.5, 1, 1, 2] + [4, 0, 0, 1, 0, 0]
    y = 2 + x @ [1.5, -0.4, 0.3, 0.1, 0, 0] + r.normal(size=N)
    y[[17, 90, 201]] += [30, -25, 18]
    return x, y


@pytest.fixture(scope="module")
def table(spark):
    x, y = made()
    data = [(i, *map(float, x[i]), float(y[i]), "train") for i in range(N)]
    df = spark.createDataFrame(data, f"id long, {', '.join(f'{c} double' for c in NAMES)}, y double, split string")
    return FeatureTable(df.repartition(3).cache(), SchemaSpec("id", "y"))


def cv_score(x, y, recipe, keep):
    fold, scores = np.arange(N) % FOLDS, []
    for k in range(FOLDS):
        fit, test = keep & (fold != k), keep & (fold == k)
        w, bias, _ = recipe.solve(Moments.of_rows(np.column_stack([x[fit], y[fit]])))
        scores.append(np.sqrt(np.mean((y[test] - bias - x[test] @ w) ** 2)))
    return np.mean(scores)


@pytest.mark.parametrize("recipe", [ols(), ridge(0.3), lasso(0.05), lasso(0.12), elastic_net(0.1, 0.7)])
def test_influence_equals_refits(table, recipe):
    x, y = made()
    got = {r.id: r for r in influence.row_influence(table, NAMES, by_fold(), recipe).collect()}
    for i in range(N):
        want = cv_score(x, y, recipe, np.arange(N) != i)
        assert got[i].score == pytest.approx(want, rel=1e-8)
    again = sum(r.changed for r in got.values())
    if recipe.l1:
        assert 0 < again < N  # some active sets change, most do not
    else:
        assert again == 0


def test_updates_are_optimal_whether_columns_change_or_not():
    x, y = made()
    m = Moments.of_rows(np.column_stack([x, y]))
    fit = influence.Downdate.of(lasso(0.05), m)
    w, bias, changed = fit.without(np.column_stack([x, y]))
    for i in [*np.flatnonzero(~changed)[:30], *np.flatnonzero(changed)[:30]]:
        keep = np.arange(N) != i
        want, b, _ = lasso(0.05).solve(Moments.of_rows(np.column_stack([x[keep], y[keep]])))
        np.testing.assert_allclose(w[i], want, atol=1e-8)
        assert bias[i] == pytest.approx(b, abs=1e-8)


def by_hand(x, y, recipe, candidates):
    keep, gone = np.ones(N, bool), []
    best = cv_score(x, y, recipe, keep)
    while True:
        tries = []
        for i in candidates:
            if keep[i]:
                keep[i] = False
                tries.append((cv_score(x, y, recipe, keep), i))
                keep[i] = True
        if not tries or min(tries)[0] >= best:
            return gone, best
        best, i = min(tries)
        keep[i] = False
        gone.append(i)


@pytest.mark.parametrize("recipe", [lasso(0.05), ols()])
def test_greedy_removal_runs_until_nothing_helps(table, recipe):
    x, y = made()
    fit = outliers.with_fit(table, NAMES, ols())
    tried = sorted([r.id for r in worst_k(fit, "id", "score", 3).collect()] + [5, 6, 7])
    assert {17, 90, 201} <= set(tried)
    ids = table.df.sparkSession.createDataFrame([(i,) for i in tried], "id long")
    gone, history = influence.greedy_removal(table, NAMES, by_fold(), recipe, ids)
    want, best = by_hand(x, y, recipe, tried)
    assert gone == want
    scores = [r.score for r in history.orderBy("round").collect()]
    assert scores == sorted(scores, reverse=True) and scores[-1] == pytest.approx(best)
    assert scores[0] == pytest.approx(cv_score(x, y, recipe, np.ones(N, bool)))


def test_no_candidates_and_no_intercept(table):
    none = table.df.select("id").limit(0)
    gone, history = influence.greedy_removal(table, NAMES, by_fold(), ols(), none)
    assert gone == [] and history.count() == 1
    with pytest.raises(ValueError):
        influence.row_influence(table, NAMES, by_fold(), Linear(intercept=False))


# --- wide ridge regression


def levels_of(spark, n=400):
    r = np.random.default_rng(3)
    a, b = r.integers(0, 40, n), r.integers(0, 5, n)
    y = a / 10 + np.array([0, 3, -1, 2, 5.0])[b] + r.normal(size=n)
    data = [(i, f"a{a[i]}" if a[i] else None, f"b{b[i]}", int(b[i] % 2), float(y[i]) if i % 50 else None) for i in range(n)]
    return spark.createDataFrame(data, "id long, a string, b string, c int, y double").repartition(4)


def test_wide_ridge_equals_the_dense_fit(spark):
    rows = levels_of(spark)
    columns = ["a", "b", "c"]
    fit = sparse.ridge_one_hot(rows, columns, "y", "id", 0.01)
    got = {r.id: r.prediction for r in fit.predict(rows, "id").collect()}
    pdf = rows.orderBy("id").toPandas()
    codes = {(r.column, r.level): r.code for r in fit.codes.collect()}
    assert sorted(codes.values()) == list(range(1, len(codes) + 1))
    assert ("a", None) in codes and ("c", "1") in codes
    design = np.zeros((len(pdf), len(codes)))
    for c in columns:
        for i, v in enumerate(pdf[c]):
            design[i, codes[c, None if v is None else str(v)] - 1] = 1
    known = pdf["y"].notna().to_numpy()
    y = pdf["y"].to_numpy()
    mean = design[known].mean(axis=0)
    x = design[known] - mean
    n = known.sum()
    w = np.linalg.solve(x.T @ x / n + 0.01 * np.eye(x.shape[1]), x.T @ (y[known] - y[known].mean()) / n)
    want = y[known].mean() + (design - mean) @ w
    np.testing.assert_allclose([got[i] for i in range(len(pdf))], want, atol=1e-7)
    dense = fold_grams(rows.where("y is not null")
                       .select("y", *[F.col("b").eqNullSafe(f"b{j}").cast("int").alias(f"b{j}") for j in range(5)]),
                       [f"b{j}" for j in range(5)], "y").fit(ridge(0.01))
    one = sparse.ridge_one_hot(rows, ["b"], "y", "id", 0.01)
    b = {r.id: r.prediction for r in one.predict(rows, "id").collect()}
    for i, v in enumerate(pdf["b"]):
        assert b[i] == pytest.approx(dense.intercept + dense.coefs[int(v[1])], abs=1e-8)


def test_unseen_levels_and_empty_tables(spark):
    rows = levels_of(spark)
    fit = sparse.ridge_one_hot(rows, ["b"], "y", "id", 0.01)
    new = spark.createDataFrame([(1, "new"), (2, "b0")], "id long, b string")
    got = {r.id: r.prediction for r in fit.predict(new, "id").collect()}
    assert got[1] == pytest.approx(fit.weights[0]) and got[2] != got[1]
    empty = sparse.ridge_one_hot(rows.limit(0), ["b"], "y", "id", 0.01)
    assert {r.prediction for r in empty.predict(new, "id").collect()} == {0.0}


def test_thousands_of_levels(spark):
    rows = spark.range(20_000).select("id", (F.col("id") % 5000).cast("string").alias("a"),
                                      (F.col("id") % 7).cast("string").alias("b"),
                                      ((F.col("id") % 5000) % 3 + F.col("id") % 7).cast("double").alias("y"))
    fit = sparse.ridge_one_hot(rows, ["a", "b"], "y", "id", 1e-6)
    assert len(fit.weights) == 5008 and fit.residual <= sparse.TOLERANCE and fit.steps < 200
    off = fit.predict(rows, "id").join(rows, "id").agg(F.max(F.abs(F.col("prediction") - F.col("y")))).first()[0]
    assert off < 0.05
