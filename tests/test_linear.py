"""Fits from cross products against direct fits, MLlib and brute force."""

import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from plumbline import ColumnSpec, FeatureTable, SchemaSpec
from plumbline.functions.tdist import t_two_sided
from plumbline.operators import encode, numeric, sampling
from plumbline.plans import gram, models, outliers, scorestats, search
from plumbline.plans.gram import elastic_net, fold_grams, lasso, ols, ridge

NAMES = ("a", "b", "c")


def make(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1, 5, 0.5] + [10, -3, 0]
    y = 3 + x @ [2.0, -0.5, 0.0] + rng.normal(size=n)
    data = [(i, *map(float, x[i]), float(y[i]), "train") for i in range(n)]
    df = spark.createDataFrame(data, "id bigint, a double, b double, c double, y double, split string")
    spec = SchemaSpec("id", "y", {c: ColumnSpec() for c in NAMES})
    return FeatureTable(df, spec), x, y


@pytest.fixture(scope="module")
def table(spark):
    t, x, y = make(spark)
    return FeatureTable(t.df.cache(), t.spec), x, y


def fold_of(t, k=5):
    got = t.df.select("id", sampling.hash_fold("id", k).alias("f")).collect()
    return np.array([r["f"] for r in sorted(got)])


def design(x):
    return np.column_stack([np.ones(len(x)), x])


def test_both_ways_of_summing_agree(table, monkeypatch):
    t, *_ = table
    fold = sampling.hash_fold("id", 5)
    jvm = fold_grams(t.train, NAMES, "y", fold)
    monkeypatch.setattr(gram, "JVM_WIDTH", 0)
    blocks = fold_grams(t.train, NAMES, "y", fold)
    assert set(jvm.folds) == set(blocks.folds)
    for k in jvm.folds:
        assert np.allclose(jvm.folds[k], blocks.folds[k])


def test_large_means_cost_no_digits(table, monkeypatch):
    t, x, y = table
    far = t.with_columns({"a": F.col("a") + 1e8, "y": F.col("y") - 1e8})
    want = np.linalg.lstsq(design(x), y, rcond=None)[0]
    for width in (6, 0):
        monkeypatch.setattr(gram, "JVM_WIDTH", width)
        m = fold_grams(far.train, NAMES, "y", sampling.hash_fold("id", 3)).fit(ols())
        assert m.coefs == pytest.approx(list(want[1:]), abs=1e-5)


def test_incomplete_rows_are_left_out(table, monkeypatch):
    t, x, y = table
    gaps = t.with_columns({"a": F.when(F.col("id") % 7 != 0, F.col("a"))})
    keep = np.arange(len(y)) % 7 != 0
    want = np.linalg.lstsq(design(x[keep]), y[keep], rcond=None)[0]
    for width in (6, 0):
        monkeypatch.setattr(gram, "JVM_WIDTH", width)
        model = fold_grams(gaps.train, NAMES, "y").fit(ols())
        assert [model.intercept, *model.coefs] == pytest.approx(list(want))


def test_ols_with_and_without_intercept(table):
    t, x, y = table
    g = fold_grams(t.train, NAMES, "y")
    m = g.fit(ols())
    assert [m.intercept, *m.coefs] == pytest.approx(list(np.linalg.lstsq(design(x), y, rcond=None)[0]))
    m0 = g.fit(ols(intercept=False))
    assert m0.coefs == pytest.approx(list(np.linalg.lstsq(x, y, rcond=None)[0]))
    assert m0.intercept == 0
    pred = t.train.select(m0.predict().alias("p"), "y").toPandas()
    assert g.rmse(m0) == pytest.approx(math.sqrt(((pred.p - pred.y) ** 2).mean()))


def test_collinear_columns(table):
    t, x, y = table
    twice = t.with_numeric({"d": F.col("a") * 2 + 1})
    m = fold_grams(twice.train, [*NAMES, "d"], "y").fit(ols())
    base = fold_grams(t.train, NAMES, "y")
    got = fold_grams(twice.train, [*NAMES, "d"], "y").rmse(m)
    assert got == pytest.approx(base.rmse(base.fit(ols())))


def test_cross_validation_equals_refitting(table):
    t, x, y = table
    fold = fold_of(t)
    got = fold_grams(t.train, NAMES, "y", sampling.hash_fold("id", 5)).cv_scores(ols())
    for k, score in got.items():
        w = np.linalg.lstsq(design(x[fold != k]), y[fold != k], rcond=None)[0]
        e = y[fold == k] - design(x[fold == k]) @ w
        assert score == pytest.approx(math.sqrt((e**2).mean()))


def test_subset_and_regroup(table):
    t, x, y = table
    g = fold_grams(t.train, NAMES, "y", sampling.hash_fold("id", 6))
    direct = fold_grams(t.train, ["c", "a"], "y", sampling.hash_fold("id", 6))
    assert g.subset(["c", "a"]).cv_rmse(ols()) == pytest.approx(direct.cv_rmse(ols()))
    merged = g.regroup({k: k % 2 for k in g.folds})
    assert np.allclose(merged.total, g.total) and set(merged.folds) == {0, 1}


@pytest.mark.parametrize("alpha,ratio", [(0.1, 1.0), (0.5, 0.9), (0.05, 0.3)])
def test_penalised_fits_equal_mllib(table, alpha, ratio):
    t, x, y = table
    m = fold_grams(t.train, NAMES, "y").fit(elastic_net(alpha, ratio))
    l1, l2 = alpha * ratio, alpha * (1 - ratio)
    sd = y.std(ddof=1)
    lam = l1 + l2 * sd
    rows = VectorAssembler(inputCols=list(NAMES), outputCol="features").transform(t.train)
    ref = LinearRegression(
        labelCol="y", regParam=lam, elasticNetParam=l1 / lam, standardization=False,
        tol=1e-12, maxIter=5000,
    ).fit(rows)
    assert m.coefs == pytest.approx(list(ref.coefficients), abs=1e-4)
    assert m.intercept == pytest.approx(ref.intercept, abs=1e-3)


def test_strong_lasso_predicts_the_mean(table):
    t, _, y = table
    m = fold_grams(t.train, NAMES, "y").fit(lasso(1e6))
    assert set(m.coefs) == {0.0} and m.intercept == pytest.approx(y.mean())


def test_t_tail():
    # two-sided tails of known quantiles
    for t, df, p in ((12.7062047, 1, 0.05), (2.2281389, 10, 0.05), (1.6448536, 1e7, 0.1), (0, 5, 1)):
        assert float(t_two_sided(np.array([t]), df)[0]) == pytest.approx(p, rel=1e-5)
    assert np.all(np.diff(t_two_sided(np.linspace(0, 60, 500), 30)) < 0)


@pytest.mark.parametrize("intercept", [True, False])
def test_studentized_residuals(spark, intercept):
    t, x, y = make(spark, n=40, seed=4)
    got = {r["id"]: r for r in outliers.studentized(t, NAMES, intercept).collect()}
    d = design(x) if intercept else x
    for i in range(len(y)):
        keep = np.arange(len(y)) != i
        w = np.linalg.lstsq(d[keep], y[keep], rcond=None)[0]
        s2 = ((y[keep] - d[keep] @ w) ** 2).sum() / (len(y) - 1 - d.shape[1])
        gap = y[i] - d[i] @ w
        scale = math.sqrt(s2 * (1 + d[i] @ np.linalg.inv(d[keep].T @ d[keep]) @ d[i]))
        assert got[i]["t"] == pytest.approx(gap / scale)
        assert got[i]["bonf_p"] == pytest.approx(min(got[i]["p"] * len(y), 1))


def test_planted_outlier_is_dropped(spark):
    t, _, _ = make(spark, n=60)
    bad = t.with_columns({"y": F.when(F.col("id") == 7, F.col("y") + 50).otherwise(F.col("y"))})
    left = outliers.drop_outliers(bad, NAMES, 1e-3, intercept=True)
    assert left.df.count() == 59 and left.df.where("id = 7").count() == 0
    gone, history = outliers.greedy_removal(bad, NAMES, sampling.hash_fold("id", 4), 3)
    assert gone[0] == 7
    scores = [r["score"] for r in history.orderBy("round").collect()]
    assert scores == sorted(scores, reverse=True)


def test_leave_one_out_equals_brute_force(spark):
    t, x, y = make(spark, n=50, seed=9)
    fold = fold_of(t)
    got = {r["id"]: r["score"] for r in outliers.loo_influence(t, NAMES, sampling.hash_fold("id", 5)).collect()}
    for i in range(50):
        keep = np.arange(50) != i
        scores = []
        for k in np.unique(fold):
            fit, test = keep & (fold != k), keep & (fold == k)
            w = np.linalg.lstsq(design(x[fit]), y[fit], rcond=None)[0]
            scores.append(math.sqrt(((y[test] - design(x[test]) @ w) ** 2).mean()))
        assert got[i] == pytest.approx(np.mean(scores))


def test_lasso_cv_picks_a_useful_alpha(table):
    t, *_ = table
    chosen, model = models.lasso_cv(t, NAMES, [1e-3, 1e-1, 1e3], sampling.hash_fold("id", 4))
    rows = chosen.collect()
    assert len(rows) == 4 and all(r["alpha"] < 1e3 for r in rows)
    assert abs(model.coefs[0] - 2) < 0.2


def test_stacking_never_sees_its_own_fold(spark, table):
    t, *_ = table
    seen = []

    def memory(df):
        ids = {r[0] for r in df.select("id").collect()}
        seen.append(ids)
        known = F.col("id").isin(list(ids)).cast("double")
        return lambda rows: rows.withColumn("prediction", known)

    folded = t.train.withColumn("f", sampling.hash_fold("id", 3))
    oof = models.out_of_fold(folded, memory, "f", "m", ["id"])
    assert oof.count() == 400 and oof.agg(F.max("m")).first()[0] == 0.0


def test_stack_and_fold_scores(spark, table):
    t, *_ = table
    halves = t.with_columns({"split": F.when(F.col("id") % 4 == 0, "test").otherwise("train")})
    bases = {
        "line": models.linear_fitter(NAMES, "y", ols()),
        "poly": models.poly_ridge_fitter(NAMES, "y", l2=0.01),
    }
    meta = lambda names: models.linear_fitter(names, "y", ols())
    out = models.stack(halves, bases, meta, sampling.hash_fold("id", 3))
    truth = halves.test.select("id", F.col("y"))
    error = out.join(truth, "id").agg(F.sqrt(F.avg(F.pow(F.col("prediction") - F.col("y"), 2)))).first()[0]
    assert out.count() == 100 and error < 1.3
    folded = t.train.withColumn("f", sampling.hash_fold("id", 5))
    loop = models.cv_fold_scores(folded, "y", bases["line"], "f")
    fast = fold_grams(t.train, NAMES, "y", sampling.hash_fold("id", 5)).cv_scores(ols())
    assert {r["fold"]: pytest.approx(r["score"]) for r in loop.collect()} == fast


def test_repeated_scores(table):
    t, *_ = table
    g = scorestats.bucket_grams(t, NAMES, 32)
    deal = scorestats.deal(list(g.folds), 5, seed=3)
    sizes = np.bincount(list(deal.values()))
    assert sizes.max() - sizes.min() <= 1
    assert scorestats.deal(list(g.folds), 5, seed=4) != deal
    for ratio in (0.05, 0.1, 0.25, 0.5):
        for seed in range(3):
            split = scorestats.test_split(range(scorestats.BUCKETS), ratio, seed)
            assert sum(split.values()) == ratio * scorestats.BUCKETS
    rows = scorestats.bucket_grams(t, NAMES)
    tested = rows.regroup(scorestats.test_split(list(rows.folds), 0.25, 0)).folds[1][0, 0]
    assert abs(tested / rows.total[0, 0] - 0.25) < 0.05
    sweep = scorestats.strategy_sweep(t, NAMES, ols(), (2, 3), (0.25,), seeds=(0, 1))
    assert sweep.count() == 6 and sweep.where("score < 0.8 OR score > 1.3").count() == 0


@pytest.mark.parametrize("width", [2, 9])
def test_infinite_values_are_an_error_at_any_width(spark, width):
    names = [f"c{i}" for i in range(width)]
    row = lambda i, x: (i, float(i), *[x + i * j for j in range(width)])
    schema = "id bigint, y double, " + ", ".join(f"{n} double" for n in names)
    good = [row(i, 1.0) for i in range(8)]
    missing = [(9, 1.0, *[None] * width), (10, 1.0, *[float("nan")] * width)]
    grams = fold_grams(spark.createDataFrame(good + missing, schema), names, "y")
    assert grams.total[0, 0] == len(good)
    with pytest.raises(Exception, match="infinite values"):
        fold_grams(spark.createDataFrame([*good, row(8, float("inf"))], schema), names, "y")


# --- search


def test_forward_selection_rules():
    gain = {"a": 3, "b": 2, "c": -1}
    evaluate = lambda sets: [10 - sum(gain[v] for v in vs) for vs in sets]
    rest = lambda names: lambda chosen: [v for v in names if v not in chosen]
    history = search.forward_select(rest("bac"), evaluate)
    assert list(history["round"]) == [1, 1, 1, 2, 2, 3]
    won = search.winners(history)
    assert list(won["candidate"]) == ["a", "b"] and list(won["score"]) == [7, 5]
    assert list(search.winners(history, improved_only=False)["improved"]) == [True, True, False]
    up = search.forward_select(rest("xy"), lambda sets: [len(vs) for vs in sets], goal="max")
    assert list(search.winners(up)["candidate"]) == ["x", "y"]
    whole = search.forward_select(rest("cda"), lambda sets: [len(vs) for vs in sets], exhaust=True)
    assert list(search.winners(whole, improved_only=False)["candidate"]) == ["c", "d", "a"]
    assert search.forward_select(rest(""), evaluate).empty


def test_first_of_equal_scores_wins():
    assert search.score_table(["x", "y", "z"], [1.0, 1.0, 1.0]).at[0, "candidate"] == "x"
    assert search.score_table([1, 2, 3], [1, 2, 3], "max").at[0, "candidate"] == 3


def test_batched_variants_equal_single_ones(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(300):
        x = float(rng.integers(0, 6)) if i % 3 else float(rng.normal(5, 2))
        g = "pqr"[int(rng.integers(0, 3))]
        rows.append((i, x, g, x * x + "pqr".index(g) + float(rng.normal()), "train" if i % 5 else "test"))
    df = spark.createDataFrame(rows, "id bigint, x double, g string, y double, split string")
    spec = SchemaSpec("id", "y", {"x": ColumnSpec(), "g": ColumnSpec("CATEGORICAL", ("p", "q", "r"))})
    t = FeatureTable(df.cache(), spec)
    variants = search.all_variants(t)
    assert len(variants) == 12
    batched = search.variant_columns(t, variants)
    assert set(search.valid_variants(t, variants)) == set(batched)
    for v, cols in batched.items():
        out, made = search.apply_variant(t, v)
        got = t.df.select("id", *[e.alias(n) for n, e in cols.items()]).orderBy("id").toPandas()
        want = out.df.select("id", *made).orderBy("id").toPandas()
        assert got.shape[1] == want.shape[1], v
        for a, b in zip(got.columns[1:], want.columns[1:]):
            assert np.allclose(got[a].astype(float), want[b].astype(float)), (v, a)


def test_greedy_search_finds_the_driver(spark):
    t, *_ = make(spark)
    encoded = search.encode_variants(t, search.all_variants(t), sampling.hash_fold("id", 4))
    history = search.forward_select(
        search.unused_columns(list(encoded.columns)),
        lambda sets: [encoded.score(vs, ols()) for vs in sets],
    )
    won = search.winners(history)
    chosen, best = list(won["candidate"]), won["score"].iloc[-1]
    assert {v.column for v in chosen[:2]} == {"a", "b"} and best < 1.2
    assert len({v.column for v in chosen}) == len(chosen)
    assert encoded.score([search.Variant("a", "no_such")], ols()) == search.FAIL_SCORE
    assert set(encoded.commit(chosen).features) == {c for v in chosen for c in encoded.columns[v]}


def test_scaling_statistics_equals_scaling_rows(table):
    t, *_ = table
    fold = sampling.hash_fold("id", 4)
    raw = search.scaled(fold_grams(t.train, NAMES, "y", fold))
    z = fold_grams(numeric.zscore(t).train, NAMES, "y", fold)
    assert raw.cv_rmse(lasso(0.1)) == pytest.approx(z.cv_rmse(lasso(0.1)))
    assert raw.cv_rmse(ridge(0.5)) == pytest.approx(z.cv_rmse(ridge(0.5)))


def test_pca_decorrelates(table):
    t, x, _ = table
    out = numeric.pca(t, NAMES, 2).df.select("pc_1", "pc_2").toPandas().to_numpy()
    assert abs(np.corrcoef(out.T)[0, 1]) < 1e-8 and np.allclose(out.mean(axis=0), 0)
    top = np.linalg.eigvalsh(np.cov(x.T))[-1]
    assert out[:, 0].var(ddof=1) == pytest.approx(top)


def test_out_of_fold_target_mean(table):
    t, _, y = table
    g = t.with_columns({"g": (F.col("id") % 3).cast("string")})
    g = g.with_spec(g.spec.with_column("g", ColumnSpec("CATEGORICAL", ("0", "1", "2"))))
    out = encode.target_mean(g, "g", folds=sampling.hash_fold("id", 5))
    fold, ids = fold_of(t), np.arange(len(y))
    got = {r["id"]: r["g"] for r in out.df.select("id", "g").collect()}
    for i in range(0, 400, 37):
        others = (ids % 3 == i % 3) & (fold != fold[i])
        assert got[i] == pytest.approx(y[others].mean())
