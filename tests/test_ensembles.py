"""Boosted trees and ensembles against plain refits on small tables."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.plans import ensembles, trees
from plumbline.plans.gram import lasso, ols
from plumbline.spec import SchemaSpec
from plumbline.table import FeatureTable

N, FOLDS = 240, 4
NAMES = ["a", "b", "c"]


def made():
    r = np.random.default_rng(5)
    x = np.column_stack([r.integers(0, 9, N), r.normal(size=N).round(2), r.integers(0, 30, N) / 2.0])
    y = 3 * (x[:, 0] > 4) + x[:, 1] ** 2 + np.where(x[:, 2] > 7, x[:, 0], 0) + r.normal(size=N)
    y[::40] += 25
    return x, y


@pytest.fixture(scope="module")
def rows(spark):
    x, y = made()
    data = [(i, *map(float, x[i]), float(y[i]), i % FOLDS) for i in range(N)]
    schema = f"id long, a double, b double, c double, y double, {ensembles.FOLD} int"
    return spark.createDataFrame(data, schema).repartition(3).cache()


def refit(x, y, cuts, r, keep):
    """Predictions for all rows of trees fitted on the kept ones, trying every split of every leaf."""
    f = np.full(len(y), y[keep].mean())

    def t(v):
        return np.sign(v) * max(abs(v) - r.l1, 0)

    for _ in range(r.trees):
        far = np.abs(y - f)[keep]
        delta = np.quantile(far, r.huber, method="inverted_cdf") if r.huber else np.inf
        g = np.clip(f - y, -delta, delta)

        def s(rows, g=g):
            return t(g[rows & keep].sum()) ** 2 / ((rows & keep).sum() + r.l2)

        leaves = [(np.ones(len(y), bool), 0)]
        while len(leaves) < r.leaves:
            best, split = 1e-9, None
            for at, (mine, depth) in enumerate(leaves):
                if depth >= r.depth or (mine & keep).sum() < max(2, r.min_split):
                    continue
                for j in range(x.shape[1]):
                    for cut in cuts[j]:
                        low, high = mine & (x[:, j] <= cut), mine & (x[:, j] > cut)
                        if min((low & keep).sum(), (high & keep).sum()) < max(1, r.min_rows):
                            continue
                        gain = (s(low) + s(high) - s(mine)) / 2 - r.min_gain
                        if gain > best + 1e-9:
                            best, split = gain, (at, low, high, depth + 1)
            if split is None:
                break
            at, low, high, depth = split
            leaves[at : at + 1] = [(low, depth), (high, depth)]
        for mine, _ in leaves:
            f[mine] -= r.rate * t(g[mine & keep].sum()) / ((mine & keep).sum() + r.l2)
    return f


RECIPES = {
    "leaf_wise": trees.Boosting(trees=6, rate=0.3, leaves=5, min_rows=6),
    "by_level": trees.Boosting(trees=5, rate=0.3, leaves=8, depth=3, min_rows=2, min_gain=0.05, l1=0.46, l2=0.86),
    "huber": trees.Boosting(trees=5, rate=0.3, leaves=16, depth=4, min_rows=15, min_split=40, huber=0.9, refresh=1),
}


@pytest.mark.parametrize("name", RECIPES)
def test_trees_equal_a_plain_refit(rows, name):
    recipe = RECIPES[name]
    x, y = made()
    model = trees.boost(rows, NAMES, "y", recipe, "id")
    got = np.array([r.p for r in model.predict(rows, "p").orderBy("id").collect()])
    want = refit(x, y, model.cuts, recipe, np.ones(N, bool))
    np.testing.assert_allclose(got, want, atol=1e-6)
    assert np.sqrt(np.mean((got - y) ** 2)) < y.std()


def test_models_of_folds_equal_fits_without_the_fold(rows):
    recipe = RECIPES["leaf_wise"]
    both = trees.boost(rows, NAMES, "y", recipe, "id", F.col(ensembles.FOLD), FOLDS)
    unseen = {r.id: r.p for r in both.predict(rows, "p", ensembles.FOLD).collect()}
    cuts = both.cuts
    x, y = made()
    for k in range(FOLDS):
        keep = np.arange(N) % FOLDS != k
        own = both.values(list(x.T), k)
        np.testing.assert_allclose(own, refit(x, y, cuts, recipe, keep), atol=1e-6)
        np.testing.assert_allclose([unseen[i] for i in np.flatnonzero(~keep)], own[~keep], atol=1e-12)
    alone = trees.boost(rows, NAMES, "y", recipe, "id")
    np.testing.assert_allclose(alone.values(list(x.T)), both.values(list(x.T)), atol=1e-9)


def test_tasks_merging_and_refreshing_change_nothing(rows, monkeypatch):
    recipe = replace(RECIPES["by_level"], row_share=0.6, bag_every=2, feature_share=0.5)
    x, _ = made()
    want = trees.boost(rows, NAMES, "y", recipe, "id").values(list(x.T))
    monkeypatch.setattr(trees, "ROWS_A_TASK", 60)
    monkeypatch.setattr(trees, "MERGE_TASKS", 2)
    got = trees.boost(rows, NAMES, "y", replace(recipe, refresh=2), "id").values(list(x.T))
    np.testing.assert_allclose(got, want, atol=1e-9)


def test_a_pass_reads_blocks_not_rows(rows, monkeypatch):
    written, plain = [], trees.materialize

    def counted(df):
        out = plain(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(trees, "materialize", counted)
    monkeypatch.setattr(trees, "WRITE_EVERY", 2)
    few = rows.coalesce(2)
    trees.boost(few, NAMES, "y", trees.Boosting(trees=5, rate=0.3, leaves=4), "id", F.col(ensembles.FOLD), FOLDS)
    assert written == [2, 2, 2]


def test_unknown_values_and_empty_tables(spark):
    data = [(i, None if i % 3 == 0 else float(i % 2), None if i == 7 else float(10 * (i % 3 == 0))) for i in range(60)]
    data.append((60, float("nan"), float("nan")))
    df = spark.createDataFrame(data, "id long, a double, y double")
    recipe = trees.Boosting(trees=40, rate=0.5, leaves=3)
    out = {r.id: r.prediction for r in trees.boost(df, ["a"], "y", recipe, "id").predict(df).collect()}
    assert len(out) == 61
    assert out[0] == pytest.approx(10, abs=1e-3) and out[60] == pytest.approx(10, abs=1e-3)
    assert out[1] == pytest.approx(0, abs=1e-3)
    model = trees.boost(df.limit(0), ["a"], "y", recipe, "id")
    assert {r.prediction for r in model.predict(df).collect()} == {0.0}


def test_bins_are_values_or_quantiles(spark):
    df = spark.range(5000).select((F.col("id") % 7).cast("double").alias("few"), F.col("id").cast("double").alias("many"))
    few, many = trees.cut_points(df, ["few", "many"], 55)
    assert few.tolist() == [0, 1, 2, 3, 4, 5]
    assert len(many) == 53
    counts = np.bincount(np.searchsorted(many, np.arange(5000.0)))
    assert counts.min() > 85 and counts.max() < 100


def kernel_fit(x, y, z, alpha=0.6, coef0=2.5):
    """Dual kernel ridge regression."""
    k = (x @ x.T + coef0) ** 2
    return (z @ x.T + coef0) ** 2 @ np.linalg.solve(k + alpha * np.eye(len(x)), y)


def test_kernel_ridge_equals_the_dual(rows):
    x, y = made()
    fitted = ensembles.KernelBase().fit(rows, NAMES, "y", "id", FOLDS)
    whole = [r.p for r in fitted.predict(rows, "p").orderBy("id").collect()]
    np.testing.assert_allclose(whole, kernel_fit(x, y, x), atol=1e-6)
    unseen = np.array([r.p for r in fitted.predict(rows, "p", ensembles.FOLD).orderBy("id").collect()])
    for k in range(FOLDS):
        out = np.arange(N) % FOLDS == k
        np.testing.assert_allclose(unseen[out], kernel_fit(x[~out], y[~out], x[out]), atol=1e-6)
    assert fitted.predict(rows, "p").columns == [*rows.columns, "p"]


def test_stack_has_one_row_per_test_id_and_unseen_predictions(spark, rows):
    x, y = made()
    table = small_table(spark, rows)
    bases = {"line": ensembles.LinearBase(lasso(0.0005)), "kernel": ensembles.KernelBase(),
             "trees": ensembles.TreeBase(RECIPES["leaf_wise"])}
    meta = ensembles.LinearBase(ols())
    found = ensembles.stack(table, NAMES, bases, meta, F.col("id") % FOLDS, FOLDS)
    level = {r.id: r for r in found.level.collect()}
    assert len(level) == N
    for k in range(FOLDS):
        out = np.flatnonzero(np.arange(N) % FOLDS == k)
        keep = np.arange(N) % FOLDS != k
        want = kernel_fit(x[keep], y[keep], x[out])
        np.testing.assert_allclose([level[i].kernel for i in out], want, atol=1e-6)
    p = np.array([[level[i].line, level[i].kernel, level[i].trees] for i in range(N)])
    w = np.linalg.lstsq(np.column_stack([np.ones(N), p]), y, rcond=None)[0]
    test = sorted(found.test.collect(), key=lambda r: r.id)
    assert [r.id for r in test] == list(range(20))
    for r in test:
        assert r.prediction == pytest.approx(w[0] + w[1:] @ [r.line, r.kernel, r.trees], abs=1e-6)
    assert found.score().first().score > 0


def small_table(spark, rows):
    spec = SchemaSpec("id", "y")
    train = rows.drop(ensembles.FOLD)
    test = train.where("id < 20").drop("y")
    return FeatureTable.from_pair(train, test, spec)


def test_error_model_metrics(spark, rows):
    x, y = made()
    line = {"line": ensembles.LinearBase(ols())}
    scored = ensembles.averaged_scores(small_table(spark, rows), NAMES, line)
    got = {r.id: r.score for r in scored.collect()}
    a = np.column_stack([np.ones(N), x])
    score = np.abs(a @ np.linalg.lstsq(a, y, rcond=None)[0] - y)
    np.testing.assert_allclose([got[i] for i in range(N)], score, atol=1e-9)
    found = ensembles.error_model(scored, NAMES, "id", line, F.col("id") % FOLDS, FOLDS)
    metrics = {r.metric: r.value for r in found.metrics.collect()}
    w = np.linalg.lstsq(a, score, rcond=None)[0]
    parts = []
    for k in range(FOLDS):
        out = np.arange(N) % FOLDS == k
        wk = np.linalg.lstsq(a[~out], score[~out], rcond=None)[0]
        parts.append(np.sqrt(np.mean((a[out] @ wk - score[out]) ** 2)))
    assert metrics["baseline"] == pytest.approx(score.std())
    assert metrics["train"] == pytest.approx(np.sqrt(np.mean((a @ w - score) ** 2)))
    assert metrics["cv"] == pytest.approx(np.mean(parts))


def test_final_ensemble_has_its_full_sizes():
    bases = ensembles.final_bases(100)
    assert list(bases) == ["lasso", "elastic_net", "kernel_ridge", "huber_trees", "level_trees", "leaf_trees"]
    assert [bases[k].recipe.trees for k in ("huber_trees", "level_trees", "leaf_trees")] == [3000, 2200, 720]
    assert ensembles.final_bases(100, 5)["leaf_trees"].recipe.trees == 5


def test_passes_give_the_trees_of_one_task(rows, monkeypatch):
    for recipe in (replace(RECIPES["huber"], trees=7, feature_share=0.67, per_node=True, refresh=2, min_split=10),
                   replace(RECIPES["leaf_wise"], row_share=0.7, bag_every=3, feature_share=0.67)):
        fits = []
        for most in (N, 0):
            monkeypatch.setattr(trees, "ALONE_ROWS", most)
            fits.append(trees.boost(rows, NAMES, "y", recipe, "id", F.col(ensembles.FOLD), FOLDS))
        for one, other in zip(fits[0].trees, fits[1].trees, strict=True):
            assert [t.splits for t in one] == [t.splits for t in other] and any(t.splits for t in one)
            for a, b in zip(one, other, strict=True):
                np.testing.assert_allclose(a.values, b.values, atol=1e-9)


def test_masks_reach_the_leaves_of_the_walk():
    r = np.random.default_rng(3)
    x = r.integers(0, 30, (3, 500)).astype(np.uint8)
    for leaves in (1, 2, 5, trees.MASKED, trees.MASKED + 4):
        tree = trees.Tree(values=r.normal(size=2 * leaves - 1).tolist())
        ends = [0]
        for k in range(leaves - 1):
            at = ends.pop(int(r.integers(len(ends))))
            tree.splits.append((at, int(r.integers(3)), int(r.integers(29)), 2 * k + 1, 2 * k + 2))
            ends += [2 * k + 1, 2 * k + 2]
        out = np.ones(500)
        trees._Applied(tree, 30).add(x, out)
        np.testing.assert_array_equal(out, 1 + tree.predict(x, 500))


def test_no_fold_number_leaves_rows_out_of_the_whole_model(rows):
    """A fold beyond the models', or none, leaves a row out of no model."""
    recipe = RECIPES["leaf_wise"]
    alone = trees.boost(rows, NAMES, "y", recipe, "id")
    odd = F.when(F.col("id") % 2 == 0, 2)
    for fold, folds in ((F.col("id") % 2 + 2, 2), (odd, 2), (F.col("id") % 3, 2)):
        model = trees.boost(rows, NAMES, "y", recipe, "id", fold, folds)
        np.testing.assert_allclose(model.values(list(made()[0].T)), alone.values(list(made()[0].T)), atol=1e-9)


def fitted_sizes(spark, folder, monkeypatch, name):
    """Trees of the boosted models that a query asks for, in order of size; few are grown."""
    import __spark_entry__ as e

    asked, plain = [], trees.boost

    def seen(rows, features, target, recipe, *rest):
        asked.append(recipe.trees)
        return plain(rows, features, target, recipe.smaller(2), *rest)

    monkeypatch.setattr(trees, "boost", seen)
    out = e.queries()[name](spark, folder)
    assert out.count()
    return sorted(asked)


def test_boosted_trees_are_grown_in_full(spark, folder, monkeypatch):
    assert fitted_sizes(spark, folder, monkeypatch, "boosted_trees") == [720, 2200, 3000]


def test_error_ensemble_is_grown_in_full(spark, folder, monkeypatch):
    assert fitted_sizes(spark, folder, monkeypatch, "error_ensemble") == [720, 720, 2200, 2200, 3000, 3000]


def test_stacked_models_are_grown_in_full(spark, folder, monkeypatch):
    assert fitted_sizes(spark, folder, monkeypatch, "stacked_models") == [720, 720, 2200, 3000]
