"""Queries on models, cross-validation, ensembles, outliers, neighbours and search."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from plumbline.catalog.features import mix_sql
from plumbline.catalog.registry import on_sales, query
from plumbline.catalog.tables import r4, rare_numbers_sql, union_all
from plumbline.operators import encode, joins, metrics, missing, numeric
from plumbline.operators import quality as qual
from plumbline.operators import sampling as split
from plumbline.operators.columns import retain_columns
from plumbline.plans import influence, models, outliers, scorestats, search
from plumbline.plans.gram import elastic_net, fold_grams, lasso, ols, ridge
from plumbline.plans.storage import checkpoint_dir, materialize
from plumbline.sources import io
from plumbline.sources.tables import KEY_SPLIT_SQL, TIME_SPLIT_SQL, sales, time_split

# --- a table whose target depends on its features

SIGNAL_COLUMNS = ("status", "n_lines", "sum_qty", "acctbal", "yr_sold", "mo_sold")


def signal(spark, folder, split_by=None):
    """Sales with nulls filled by 0 and a target that follows quantity and balance."""
    table = sales(spark, folder, SIGNAL_COLUMNS, split_by)
    table = missing.fill_columns(table, {"n_lines": 0, "sum_qty": 0})
    y = 2 * F.col("sum_qty") + 0.1 * F.col("acctbal") + F.col("target") / 10_000
    return table.with_columns({"target": y})


SIGNAL = """sig AS (SELECT id, split, status, coalesce(n_lines, 0) AS n_lines,
  coalesce(sum_qty, 0) AS sum_qty, acctbal, yr_sold, mo_sold,
  2 * coalesce(sum_qty, 0) + 0.1 * acctbal + target / 10000 AS target FROM sales),
  tr AS (SELECT * FROM sig WHERE split = 'train')"""

LINE = """line AS (SELECT regr_slope(target, sum_qty) AS b, regr_intercept(target, sum_qty) AS a
  FROM tr)"""


def on_signal(body: str, *ctes: str, by: str = KEY_SPLIT_SQL) -> str:
    return on_sales(body, ",\n".join((SIGNAL, *ctes)), by)


def line_scores(table):
    """Train rows scored by the line on quantity."""
    return outliers.with_fit(table, ["sum_qty"], ols())


# --- metrics


@query(
    "rmse",
    on_signal("SELECT round(sqrt(avg(pow(a + b * sum_qty - target, 2))), 4) AS rmse FROM tr, line", LINE),
)
def rmse(spark, folder):
    scored = line_scores(signal(spark, folder))
    return scored.agg(F.round(metrics.rmse("predicted", "target"), 4).alias("rmse"))


@query(
    "r2",
    on_signal(
        """SELECT round(1 - sum(pow(target - a - b * sum_qty, 2))
        / (var_pop(target) * count(*)), 6) AS r2 FROM tr, line""",
        LINE,
    ),
)
def r2(spark, folder):
    scored = line_scores(signal(spark, folder))
    return scored.agg(F.round(metrics.r2("predicted", "target"), 6).alias("r2"))


@query(
    "baseline_rmse",
    on_sales("SELECT round(stddev_pop(target), 4) AS rmse FROM sales WHERE split = 'train'"),
)
def baseline_rmse(spark, folder):
    train = sales(spark, folder, ()).train
    return train.agg(F.round(metrics.baseline_rmse("target"), 4).alias("rmse"))


# --- fits


@query(
    "ols_fit",
    on_signal(
        """SELECT unnest(['intercept', 'n_lines', 'acctbal']) AS term,
        round(unnest([my - b1 * m1 - b2 * m2, b1, b2]), 6) AS coef FROM (
          SELECT *, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1,
            (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2 FROM (
            SELECT avg(target) AS my, avg(n_lines) AS m1, avg(acctbal) AS m2,
              var_pop(n_lines) AS s11, var_pop(acctbal) AS s22,
              covar_pop(n_lines, acctbal) AS s12, covar_pop(n_lines, target) AS s1y,
              covar_pop(acctbal, target) AS s2y FROM tr))"""
    ),
)
def ols_fit(spark, folder):
    model = models.fit_linear(signal(spark, folder), ["n_lines", "acctbal"], ols())
    rows = [("intercept", model.intercept), *zip(model.features, model.coefs)]
    out = spark.createDataFrame(rows, "term string, coef double")
    return out.select("term", F.round("coef", 6).alias("coef"))


def encoded_signal(spark, folder):
    """Status one-hot, numbers scaled, no nulls."""
    table = encode.one_hot_levels(signal(spark, folder).materialized(), ["status"])
    return numeric.zscore(table)


def _coefs(spark, model):
    rows = [("intercept", model.intercept), *zip(model.features, model.coefs)]
    return spark.createDataFrame(rows, "term string, coef double")


@query("lasso_fit")
def lasso_fit(spark, folder):
    table = encoded_signal(spark, folder)
    return _coefs(spark, models.fit_linear(table, table.features, lasso(0.001)))


@query("elasticnet_fit")
def elasticnet_fit(spark, folder):
    table = encoded_signal(spark, folder)
    return _coefs(spark, models.fit_linear(table, table.features, elastic_net(0.0005, 0.9)))


@query(
    "penalised_lines",
    on_signal(
        """SELECT unnest(['lasso', 'elastic_net', 'ridge']) AS model,
        round(unnest([greatest(c - 5, 0), greatest(c - 2, 0) / 3, c / 1.5]), 6) AS coef
        FROM (SELECT covar_pop(sum_qty, target) / stddev_pop(sum_qty) AS c FROM tr)"""
    ),
)
def penalised_lines(spark, folder):
    """Slope on one scaled feature: soft-thresholded, shrunk, or both."""
    table = numeric.zscore(signal(spark, folder).materialized(), ["sum_qty"])
    grams = fold_grams(table.train, ["sum_qty"], "target")
    recipes = {"lasso": lasso(5.0), "elastic_net": elastic_net(4.0, 0.5), "ridge": ridge(0.5)}
    rows = [(name, grams.fit(r).coefs[0]) for name, r in recipes.items()]
    out = spark.createDataFrame(rows, "model string, coef double")
    return out.select("model", F.round("coef", 6).alias("coef"))


@query(
    "robust_line",
    on_signal(
        "SELECT id, round(a + b * sum_qty, 4) AS predicted FROM sig, line WHERE split = 'test'",
        LINE,
    ),
)
def robust_line(spark, folder):
    """Scale by median and quartiles, fit, predict: scaling does not change the line."""
    table = numeric.robust_scale(signal(spark, folder).materialized(), ["sum_qty"])
    model = models.fit_linear(table, ["sum_qty"], ols())
    return table.test.select("id", r4(model.predict(), "predicted"))


SCALED = """z AS (SELECT id, (sum_qty - m) / s AS x, target AS y FROM tr,
  (SELECT avg(sum_qty) AS m, stddev_pop(sum_qty) AS s FROM tr))"""


def scaled_quantity(spark, folder):
    return numeric.zscore(retain_columns(signal(spark, folder), ["sum_qty"]).materialized())


@query(
    "lasso_cv",
    on_signal(
        """SELECT CAST(o AS INT) AS fold, alpha, round(sqrt(avg(pow(y - my - w * (x - mx), 2))), 4)
          AS score
        FROM b JOIN (SELECT o, alpha, mx, my,
            sign(c) * greatest(abs(c) - alpha, 0) / v AS w
          FROM (SELECT o, avg(x) AS mx, avg(y) AS my, covar_pop(x, y) AS c, var_pop(x) AS v
            FROM b, folds WHERE fold <> o GROUP BY o) JOIN best USING (o)) ON fold = o
        GROUP BY o, alpha""",
        SCALED,
        f"""b AS (SELECT x, y, {mix_sql('id')} % 5 AS fold, {mix_sql('id', 7_919)} % 3 AS inn
          FROM z)""",
        "folds AS (SELECT unnest(range(5)) AS o)",
        "inners AS (SELECT unnest(range(3)) AS j)",
        "alphas AS (SELECT unnest([0.01, 1.0, 20.0, 100.0]::DOUBLE[]) AS alpha)",
        """fits AS (SELECT o, j, alpha, mx, my, sign(c) * greatest(abs(c) - alpha, 0) / v AS w
          FROM alphas, (SELECT o, j, avg(x) AS mx, avg(y) AS my, covar_pop(x, y) AS c,
            var_pop(x) AS v FROM b, folds, inners WHERE fold <> o AND inn <> j GROUP BY o, j))""",
        """best AS (SELECT o, arg_min(alpha, s) AS alpha FROM (
          SELECT o, alpha, avg(s) AS s FROM (
            SELECT o, j, alpha, sqrt(avg(pow(y - my - w * (x - mx), 2))) AS s
            FROM b, fits WHERE fold <> o AND inn = j GROUP BY o, j, alpha) GROUP BY o, alpha)
          GROUP BY o)""",
    ),
)
def lasso_cv(spark, folder):
    """Alpha chosen inside each outer fold, and the score of that choice on the fold."""
    table = scaled_quantity(spark, folder)
    chosen, _ = models.lasso_cv(
        table, ["sum_qty"], [0.01, 1.0, 20.0, 100.0], split.hash_fold("id", 5)
    )
    return chosen.select("fold", "alpha", r4("score"))


@query("lasso_path")
def lasso_path(spark, folder):
    """The same choice with all features."""
    table = encoded_signal(spark, folder)
    alphas = [10.0**e for e in range(-4, 1)]
    chosen, _ = models.lasso_cv(table, table.features, alphas, split.hash_fold("id", 5))
    return chosen


@query(
    "coef_report",
    on_signal(
        """SELECT column_name, round(coef, 6) AS coef, (SELECT count(*) FROM tr) - mode_n
        AS n_off_mode FROM (
          SELECT 'n_lines' AS column_name, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12)
            AS coef, (SELECT max(n) FROM (SELECT count(*) AS n FROM tr GROUP BY n_lines)) AS mode_n
          FROM c UNION ALL
          SELECT 'acctbal', (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12),
            (SELECT max(n) FROM (SELECT count(*) AS n FROM tr GROUP BY acctbal)) FROM c)""",
        """c AS (SELECT var_pop(n_lines) AS s11, var_pop(acctbal) AS s22,
          covar_pop(n_lines, acctbal) AS s12, covar_pop(n_lines, target) AS s1y,
          covar_pop(acctbal, target) AS s2y FROM tr)""",
    ),
)
def coef_report(spark, folder):
    table = signal(spark, folder)
    model = models.fit_linear(table, ["n_lines", "acctbal"], ols())
    out = models.coef_report(table, model, top=20)
    return out.select(
        F.col("column").alias("column_name"), F.round("coef", 6).alias("coef"), "n_off_mode"
    )


FOLDED = f"f AS (SELECT *, {mix_sql('id')} % 5 AS fold FROM tr)"
FOLD_LINES = """fl AS (SELECT k, regr_slope(target, sum_qty) AS b,
  regr_intercept(target, sum_qty) AS a FROM f, (SELECT unnest(range(5)) AS k)
  WHERE fold <> k GROUP BY k)"""


@query(
    "cv_rmse",
    on_signal(
        """SELECT CAST(k AS INT) AS fold, round(sqrt(avg(pow(a + b * sum_qty - target, 2))), 4)
        AS score FROM f JOIN fl ON fold = k GROUP BY k""",
        FOLDED,
        FOLD_LINES,
    ),
)
def cv_rmse(spark, folder):
    """Per-fold scores of the line, all from one pass."""
    table = signal(spark, folder)
    grams = fold_grams(table.train, ["sum_qty"], "target", split.hash_fold("id", 5))
    rows = [(int(k), v) for k, v in grams.cv_scores(ols()).items()]
    out = spark.createDataFrame(rows, "fold int, score double")
    return out.select("fold", r4("score"))


@query(
    "split_score",
    on_signal(
        """SELECT round(sqrt(avg(pow(a + b * sum_qty - target, 2))), 4) AS score FROM s,
        (SELECT regr_slope(target, sum_qty) AS b, regr_intercept(target, sum_qty) AS a FROM s
          WHERE part = 'train') WHERE part = 'test'""",
        f"""s AS (SELECT *, CASE WHEN {mix_sql('id', 1)} / 2147483647.0 < 0.25 THEN 'test'
          ELSE 'train' END AS part FROM tr)""",
    ),
)
def split_score(spark, folder):
    parted = split.hash_split(signal(spark, folder).train, "id", 0.25, seed=1)
    fitter = models.linear_fitter(["sum_qty"], "target", ols())
    return models.split_score(parted, "target", fitter).select(r4("score"))


@query(
    "segment_exclusion",
    on_signal(
        """SELECT CAST(status = 'P' AS INT) AS excluded, count(*) AS n,
        round(sqrt(avg(pow(a + b * sum_qty - target, 2))), 4) AS score FROM tr,
        (SELECT regr_slope(target, sum_qty) AS b, regr_intercept(target, sum_qty) AS a FROM tr
          WHERE status <> 'P') GROUP BY 1"""
    ),
)
def segment_exclusion(spark, folder):
    table = signal(spark, folder)
    fitter = models.linear_fitter(["sum_qty"], "target", ols())
    out = models.segment_exclusion(table, fitter, F.col("status") == "P")
    return out.select("excluded", "n", r4("score"))


def _gap_sql(seed: int) -> str:
    held = f"({mix_sql('id', seed)}) / 2147483647.0 < 0.3"
    fold = f"({mix_sql('id', seed + 1_000)}) % 3"
    return f"""SELECT {seed} AS seed, cv, ho FROM (
      SELECT avg(s) AS cv FROM (
        SELECT k, sqrt(avg(pow(a + b * sum_qty - target, 2))) AS s FROM tr, (
          SELECT k, regr_slope(target, sum_qty) AS b, regr_intercept(target, sum_qty) AS a
          FROM tr, (SELECT unnest(range(3)) AS k) WHERE NOT {held} AND {fold} <> k GROUP BY k)
        WHERE NOT {held} AND {fold} = k GROUP BY k)), (
      SELECT sqrt(avg(pow(a + b * sum_qty - target, 2))) AS ho FROM tr, (
        SELECT regr_slope(target, sum_qty) AS b, regr_intercept(target, sum_qty) AS a FROM tr
        WHERE NOT {held}) WHERE {held})"""


@query(
    "cv_holdout_gap",
    on_signal(
        f"""SELECT CAST(seed AS INT) AS seed, round(cv, 4) AS cv_score,
        round(ho, 4) AS holdout_score, round(abs(cv - ho), 4) AS gap
        FROM ({union_all(_gap_sql(s) for s in range(3))})"""
    ),
)
def cv_holdout_gap(spark, folder):
    table = signal(spark, folder)
    out = models.cv_holdout_gap(table, ["sum_qty"], ols(), 3, 0.3, range(3))
    return out.select("seed", r4("cv_score"), r4("holdout_score"), r4("gap"))


RECIPES = {"ols": ols(), "ridge": ridge(0.5), "lasso": lasso(5.0), "elastic_net": elastic_net(4.0, 0.5)}


@query(
    "model_comparison",
    on_signal(
        """SELECT model, round(avg(s), 4) AS cv_rmse FROM (
          SELECT k, model, sqrt(avg(pow(y - my - w * (x - mx), 2))) AS s FROM b JOIN (
            SELECT k, mx, my, unnest(['ols', 'ridge', 'lasso', 'elastic_net']) AS model,
              unnest([c / v, c / (v + 0.5), greatest(c - 5, 0) / v, greatest(c - 2, 0) / (v + 2)])
              AS w
            FROM (SELECT k, avg(x) AS mx, avg(y) AS my, covar_pop(x, y) AS c, var_pop(x) AS v
              FROM b, (SELECT unnest(range(5)) AS k) WHERE fold <> k GROUP BY k)) ON fold = k
          GROUP BY k, model) GROUP BY model""",
        SCALED,
        f"b AS (SELECT x, y, {mix_sql('id')} % 5 AS fold FROM z)",
    ),
)
def model_comparison(spark, folder):
    """Cross-validated scores of four linear models on one scaled feature, from one pass."""
    table = scaled_quantity(spark, folder)
    out = models.compare_models(table, ["sum_qty"], RECIPES, split.hash_fold("id", 5))
    return out.select("model", r4("cv_rmse"))


@query("model_comparison_wide")
def model_comparison_wide(spark, folder):
    table = encoded_signal(spark, folder)
    return models.compare_models(table, table.features, RECIPES, split.hash_fold("id", 5))


@query("binned_regression")
def binned_regression(spark, folder):
    """Test predictions of a lightly regularised linear model on one-hot quantile bins."""
    table = numeric.quantile_bin_one_hot(signal(spark, folder).materialized(), {"acctbal": 50})
    table = encode.one_hot_levels(table, ["status"])
    model = models.fit_linear(table, table.features, ridge(1e-6))
    return table.test.select("id", model.predict().alias("predicted"))


FEATURES = ("sum_qty", "acctbal", "n_lines", "mo_sold")


@query("poly_ridge")
def poly_ridge(spark, folder):
    table = numeric.zscore(signal(spark, folder).materialized(), FEATURES)
    predict = models.poly_ridge_fitter(FEATURES, "target")(table.train)
    return predict(table.test).select("id", "prediction")


@query("gbt_fit")
def gbt_fit(spark, folder):
    table = signal(spark, folder).materialized()
    predict = models.gbt_fitter(FEATURES, "target", max_iter=10)(table.train)
    return predict(table.test).select("id", "prediction")


@query("stacking")
def stacking(spark, folder):
    """Lasso and polynomial ridge below, boosted trees on top of their out-of-fold predictions."""
    table = numeric.zscore(signal(spark, folder).materialized(), FEATURES)
    bases = {
        "lasso": models.linear_fitter(FEATURES, "target", lasso(0.0005)),
        "poly": models.poly_ridge_fitter(FEATURES, "target"),
    }
    return models.stack(
        table,
        bases,
        lambda names: models.gbt_fitter(names, "target", max_iter=5),
        split.hash_fold("id", 5),
    )


@query(
    "model_roundtrip",
    on_signal(
        """SELECT round(sqrt(avg(pow(a + b * sum_qty - target, 2))), 3) AS score
        FROM sig, line WHERE split = 'test'""",
        LINE,
    ),
)
def model_roundtrip(spark, folder):
    """Fit, store, load, and evaluate the loaded model on the other split."""
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    table = signal(spark, folder)
    stages = [
        VectorAssembler(inputCols=["sum_qty"], outputCol="features"),
        LinearRegression(labelCol="target", solver="normal"),
    ]
    path = os.path.join(checkpoint_dir(spark), f"model-{uuid.uuid4().hex}")
    Pipeline(stages=stages).fit(table.train).write().save(path)
    scored = PipelineModel.load(path).transform(table.test)
    score = metrics.rmse("prediction", "target")
    return scored.agg(F.round(score, 3).alias("score"))


# --- blends

BLEND = """blend AS (SELECT id, a + b * sum_qty AS p1, c + d * acctbal AS p2, m AS p3
  FROM sig, line, (SELECT regr_slope(target, acctbal) AS d, regr_intercept(target, acctbal) AS c,
  avg(target) AS m FROM tr) WHERE split = 'test')"""


def three_models(spark, folder):
    """Test rows with the predictions of two lines and of the mean."""
    table = signal(spark, folder)
    grams = fold_grams(table.train, ["sum_qty", "acctbal"], "target")
    fits = [grams.subset(f).fit(ols()) for f in (["sum_qty"], ["acctbal"], [])]
    return table.test.select("id", *[f.predict().alias(f"p{i + 1}") for i, f in enumerate(fits)])


@query(
    "weighted_average",
    on_signal(
        "SELECT id, round((p1 + 2 * p2 + p3) / 4, 4) AS predicted FROM blend", LINE, BLEND
    ),
)
def weighted_average(spark, folder):
    df = three_models(spark, folder)
    return df.select("id", r4(metrics.weighted_average(("p1", "p2", "p3"), (1, 2, 1)), "predicted"))


@query(
    "weight_sweep",
    on_signal(
        """SELECT id, CAST(s AS INT) AS weight_set, round(((1 + CAST(s = 0 AS INT)) * p1
        + (2 + CAST(s = 1 AS INT)) * p2 + (1 + CAST(s = 2 AS INT)) * p3) / 5, 4) AS predicted
        FROM blend, (SELECT unnest(range(3)) AS s)""",
        LINE,
        BLEND,
    ),
)
def weight_sweep(spark, folder):
    out = metrics.weight_sweep(three_models(spark, folder), ("p1", "p2", "p3"), (1, 2, 1))
    return out.select("id", "weight_set", r4("blend", "predicted"))


@query(
    "submission",
    on_sales(
        """SELECT id AS "Id", round(exp(m) - 1, 4) AS "SalePrice" FROM sales JOIN (
          SELECT nation, avg(ln(1 + target)) AS m FROM sales WHERE split = 'train'
          GROUP BY nation) USING (nation) WHERE split = 'test'"""
    ),
)
def submission(spark, folder):
    """Fit on the log target, predict test rows, and go back to target units.

    The fit on one-hot columns of one category is its mean, which the SQL computes directly.
    """
    table = numeric.log1p(sales(spark, folder, ("nation",)).materialized(), "target")
    table = encode.one_hot_levels(table)
    model = models.fit_linear(table, table.features, ols())
    return io.submission(table, model.predict()).select("Id", r4("SalePrice"))


@query("submission_lasso")
def submission_lasso(spark, folder):
    """The same with filled, scaled and penalised features."""
    names = ("status", "segment", "acctbal", "sum_qty", "n_lines")
    table = sales(spark, folder, names).materialized()
    table = numeric.log1p(missing.fillna_mean(table), "target")
    table = numeric.zscore(encode.one_hot_levels(table), ["acctbal", "sum_qty", "n_lines"])
    model = models.fit_linear(table, table.features, lasso(0.0005))
    return io.submission(table, model.predict())


# --- outliers


SCORED = "sc AS (SELECT tr.*, a + b * sum_qty AS predicted, abs(a + b * sum_qty - target) AS score FROM tr, line)"


@query(
    "row_scores",
    on_signal("SELECT id, round(predicted, 4) AS predicted, round(score, 4) AS score FROM sc", LINE, SCORED),
)
def row_scores(spark, folder):
    return line_scores(signal(spark, folder)).select("id", r4("predicted"), r4("score"))


@query(
    "worst_k",
    on_signal(
        """SELECT id, round(target, 4) AS target, round(predicted, 4) AS predicted,
        round(score, 4) AS score FROM (SELECT * FROM sc ORDER BY sc.score DESC, id LIMIT 20)""",
        LINE,
        SCORED,
    ),
)
def worst_k(spark, folder):
    scored = line_scores(signal(spark, folder)).select("id", "target", "predicted", "score")
    worst = joins.worst_k(scored, "id", "score", 20)
    return worst.select("id", r4("target"), r4("predicted"), r4("score"))


@query("worst_predicted")
def worst_predicted(spark, folder):
    """Fill, one-hot, scale, lasso, score: the twenty worst predicted orders."""
    names = ("status", "segment", "acctbal", "sum_qty", "n_lines")
    table = sales(spark, folder, names).materialized()
    table = encode.one_hot_levels(missing.fillna_mean(table))
    table = numeric.zscore(table)
    scored = outliers.with_fit(table, table.features, lasso(0.001))
    return joins.worst_k(scored.select("id", "target", "predicted", "score"), "id", "score", 20)


@query(
    "studentized",
    on_signal(
        """SELECT id, round(e / sqrt((sse - e * e / (1 - h)) / (n - 2) * (1 - h)), 4) AS t
        FROM (SELECT id, target - b * sum_qty AS e, sum_qty * sum_qty / sxx AS h, sse, n FROM tr,
          (SELECT sum(sum_qty * target) / sum(sum_qty * sum_qty) AS b,
            sum(sum_qty * sum_qty) AS sxx, count(*) AS n,
            sum(target * target) - pow(sum(sum_qty * target), 2) / sum(sum_qty * sum_qty) AS sse
          FROM tr))"""
    ),
)
def studentized(spark, folder):
    out = outliers.studentized(signal(spark, folder), ["sum_qty"])
    return out.select("id", r4("t"))


def heavy_tailed(spark, folder):
    """The signal plus the inverse price, which is far out for the cheapest orders."""
    table = sales(spark, folder, ("n_lines", "sum_qty"))
    table = missing.fill_columns(table, {"n_lines": 0, "sum_qty": 0})
    y = 2 * F.col("sum_qty") + 1_000_000 / F.col("target")
    return table.with_columns({"target": y}).materialized()


@query("drop_outliers")
def drop_outliers(spark, folder):
    """Train rows left after removing those with a Bonferroni p-value below 0.001."""
    out = outliers.drop_outliers(heavy_tailed(spark, folder), ["sum_qty", "n_lines"], 1e-3)
    return out.train.select("id", "target")


@query("drop_outliers_intercept")
def drop_outliers_intercept(spark, folder):
    table = heavy_tailed(spark, folder)
    return outliers.drop_outliers(table, ["sum_qty"], 0.5, intercept=True).train.select("id")


@query(
    "loo_influence",
    on_signal(
        """SELECT id, round(avg(sqrt(greatest(CASE WHEN fold = k
            THEN q - y * y - 2 * m0 * (s - y) + (n - 1) * m0 * m0
            ELSE q - 2 * m1 * s + n * m1 * m1 END, 0)
            / CASE WHEN fold = k THEN n - 1 ELSE n END)), 4) AS score
        FROM (SELECT f.id, f.fold, f.target AS y, g.*, (ts - s) / (tn - n) AS m0,
            (ts - s - f.target) / (tn - n - 1) AS m1
          FROM f, (SELECT fold AS k, count(*) AS n, sum(target) AS s, sum(target * target) AS q
            FROM f GROUP BY fold) g, (SELECT count(*) AS tn, sum(target) AS ts FROM f))
        GROUP BY id""",
        FOLDED,
    ),
)
def loo_influence(spark, folder):
    """Cross-validated score of the mean prediction with each train row left out in turn."""
    out = outliers.loo_influence(signal(spark, folder), [], split.hash_fold("id", 5))
    return out.select("id", r4("score"))


LEFT_OUT_SQL = """SELECT id, round(avg(sqrt(greatest(kyy - 2 * a * ky - 2 * b * kxy + kn * a * a
            + 2 * a * b * kx + b * b * kxx, 0) / kn)), 4) AS score
        FROM (SELECT *, ty / tn - b * tx / tn AS a FROM (
          SELECT *, {slope} AS b FROM (
            SELECT id, n - o * 1 AS kn, sx - o * x AS kx, sy - o * y AS ky,
              sxx - o * x * x AS kxx, sxy - o * x * y AS kxy, syy - o * y * y AS kyy,
              an - n - (1 - o) AS tn, ax - sx - (1 - o) * x AS tx, ay - sy - (1 - o) * y AS ty,
              axx - sxx - (1 - o) * x * x AS txx, axy - sxy - (1 - o) * x * y AS txy
            FROM (SELECT id, CAST(fold = k AS INT) AS o, sum_qty - mx AS x, target - my AS y, g.*,
                all_.* FROM f, g, all_, mid))))
        GROUP BY id"""
LEFT_OUT_CTES = (
    FOLDED,
    "mid AS (SELECT avg(sum_qty) AS mx, avg(target) AS my FROM f)",
    """g AS (SELECT fold AS k, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx,
          sum(x * y) AS sxy, sum(y * y) AS syy
          FROM (SELECT fold, sum_qty - mx AS x, target - my AS y FROM f, mid) GROUP BY fold)""",
    """all_ AS (SELECT sum(n) AS an, sum(sx) AS ax, sum(sy) AS ay, sum(sxx) AS axx,
          sum(sxy) AS axy FROM g)""",
)


@query(
    "loo_influence_line",
    on_signal(
        LEFT_OUT_SQL.format(slope="(txy - tx * ty / tn) / (txx - tx * tx / tn)"), *LEFT_OUT_CTES
    ),
)
def loo_influence_line(spark, folder):
    """Cross-validated score of the line with each train row left out in turn."""
    out = outliers.loo_influence(signal(spark, folder), ["sum_qty"], split.hash_fold("id", 5))
    return out.select("id", r4("score"))


def worst_twenty(table):
    return joins.worst_k(line_scores(table), "id", "score", 20).select("id")


@query("greedy_outliers")
def greedy_outliers(spark, folder):
    """Taking out the twenty worst predicted rows one by one, as long as that helps the line."""
    table = retain_columns(signal(spark, folder), ["sum_qty"]).materialized()
    fold = split.hash_fold("id", 5)
    _, history = influence.greedy_removal(table, ["sum_qty"], fold, ols(), worst_twenty(table))
    return history


@query("greedy_outliers_lasso")
def greedy_outliers_lasso(spark, folder):
    """The same with a lasso on all numbers."""
    table = numeric.zscore(signal(spark, folder).materialized(), FEATURES)
    fold = split.hash_fold("id", 5)
    _, history = influence.greedy_removal(table, FEATURES, fold, lasso(0.001), worst_twenty(table))
    return history


@query(
    "lasso_influence_line",
    on_signal(
        LEFT_OUT_SQL.format(slope="""sign(txy - tx * ty / tn) * greatest(abs(txy - tx * ty / tn) - 10 * tn, 0)
            / (txx - tx * tx / tn)"""),
        *LEFT_OUT_CTES,
    ),
)
def lasso_influence_line(spark, folder):
    """Cross-validated score of the lasso on quantity with each train row left out in turn."""
    out = influence.row_influence(signal(spark, folder), ["sum_qty"], split.hash_fold("id", 5), lasso(10.0))
    return out.select("id", r4("score"))


@query("lasso_influence")
def lasso_influence(spark, folder):
    """The same on all numbers, and how many fits change their columns without the row."""
    table = numeric.zscore(signal(spark, folder).materialized(), FEATURES)
    return influence.row_influence(table, FEATURES, split.hash_fold("id", 5), lasso(0.001))


ERROR_LINE = """el AS (SELECT regr_slope(score, n_lines) AS eb,
  regr_intercept(score, n_lines) AS ea FROM sc)"""


@query(
    "error_model",
    on_signal(
        """SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS actual_rank,
        row_number() OVER (ORDER BY abs(ea + eb * n_lines - score) DESC, id) - 1
          AS predicted_rank FROM sc, el""",
        LINE,
        SCORED,
        ERROR_LINE,
    ),
)
def error_model(spark, folder):
    """Rank of each row by its error, and by how badly that error is predicted."""
    scored = materialize(line_scores(signal(spark, folder)).select("id", "n_lines", "score"))
    _, ranks = outliers.error_model(scored, ["n_lines"], "id", ols())
    return ranks


@query(
    "rank_compare",
    on_signal(
        """SELECT id, row_number() OVER (ORDER BY target DESC, id) - 1 AS actual_rank,
        row_number() OVER (ORDER BY sum_qty DESC, id) - 1 AS predicted_rank FROM tr"""
    ),
)
def rank_compare(spark, folder):
    """Rank of each train row by target and by quantity."""
    return joins.rank_compare(signal(spark, folder).train, "id", "target", "sum_qty")


@query(
    "error_feature_refit",
    on_signal(
        """SELECT round(sqrt(avg(pow(p - target, 2))), 4) AS score FROM (
          SELECT target, my + b1 * (sum_qty - m1) + b2 * (w - m2) AS p FROM x, (
            SELECT *, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1,
              (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2 FROM (
              SELECT avg(target) AS my, avg(sum_qty) AS m1, avg(w) AS m2,
                var_pop(sum_qty) AS s11, var_pop(w) AS s22, covar_pop(sum_qty, w) AS s12,
                covar_pop(sum_qty, target) AS s1y, covar_pop(w, target) AS s2y FROM x)))""",
        LINE,
        SCORED,
        ERROR_LINE,
        "x AS (SELECT target, sum_qty, ea + eb * n_lines AS w FROM sc, el)",
    ),
)
def error_feature_refit(spark, folder):
    """Refit with the predicted error as a further feature."""
    table = signal(spark, folder)
    scored = line_scores(table)
    error = fold_grams(scored, ["n_lines"], "score").fit(ols())
    wider = table.with_numeric({"error": error.predict()})
    again = outliers.with_fit(wider, ["sum_qty", "error"], ols())
    return again.agg(F.round(metrics.rmse("predicted", "target"), 4).alias("score"))


REPORTED = ("n_lines", "sum_qty", "acctbal", "yr_sold", "mo_sold")


@query(
    "outlier_report",
    on_signal(
        """SELECT w.id, round(w.target, 4) AS actual, round(w.predicted, 4) AS predicted,
        round(w.score, 4) AS score, column_name, value, kind, pct, n
        FROM (SELECT * FROM sc ORDER BY sc.score DESC, id LIMIT 20) w
        LEFT JOIN rare ON w.id = rare.id""",
        LINE,
        SCORED,
        f"rare AS ({rare_numbers_sql(REPORTED, 'tr')})",
    ),
)
def outlier_report(spark, folder):
    """The twenty worst predicted rows with their rare numbers."""
    table = signal(spark, folder)
    out = outliers.outlier_report(retain_columns(table, REPORTED), line_scores(table), 20)
    return out.select(
        "id",
        r4("actual"),
        r4("predicted"),
        r4("score"),
        F.col("column").alias("column_name"),
        F.col("value").cast("double").alias("value"),
        "kind",
        "pct",
        "n",
    )


@query(
    "out_of_range_ranked",
    on_signal(
        union_all(
            f"""SELECT id, '{c}' AS column_name, {c} AS value, rank FROM ranked,
            (SELECT min({c}) AS lo, max({c}) AS hi FROM tr) WHERE {c} < lo OR {c} > hi"""
            for c in ("acctbal", "n_lines", "sum_qty", "yr_sold")
        ),
        LINE,
        SCORED,
        ERROR_LINE,
        """ranked AS (SELECT *, row_number() OVER (ORDER BY ea + eb * n_lines DESC, id) - 1
          AS rank FROM sig, el WHERE split = 'test')""",
        by=TIME_SPLIT_SQL,
    ),
)
def out_of_range_ranked(spark, folder):
    """Out-of-range test cells with the rank of the row's predicted error."""
    table = signal(spark, folder, time_split())
    error = fold_grams(line_scores(table), ["n_lines"], "score").fit(ols())
    predicted = table.test.select("id", error.predict().alias("error"))
    ranks = joins.score_ranks(predicted, "id", "error", "rank")
    cells = qual.out_of_range(table, ("acctbal", "n_lines", "sum_qty", "yr_sold"))
    out = cells.join(ranks, "id", "left")
    return out.select("id", F.col("column").alias("column_name"), "value", "rank")


# --- neighbours

PROBES = "probes AS (SELECT * FROM sc ORDER BY sc.score DESC, id LIMIT 20)"
NEIGHBORS = """nb AS (SELECT p.id AS probe_id, t.id AS neighbor_id, t.target AS y,
    sqrt(pow(p.sum_qty - t.sum_qty, 2) + pow(0.01 * p.acctbal - 0.01 * t.acctbal, 2)) AS distance
  FROM probes p JOIN tr t ON p.id <> t.id),
  top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY probe_id
    ORDER BY distance, neighbor_id) AS rank FROM nb) WHERE rank <= 3)"""


def worst_neighbors(spark, folder):
    table = signal(spark, folder).materialized()
    scored = line_scores(table).select("id", "sum_qty", "acctbal", "target", "predicted", "score")
    worst = materialize(joins.worst_k(scored, "id", "score", 20))
    near = joins.nearest_neighbors(
        worst, table.train, "id", ["sum_qty", "acctbal"], k=3, weights=[1.0, 0.01]
    )
    return table, worst, near


@query(
    "knn",
    on_signal(
        """SELECT probe_id, CAST(rank AS INT) AS rank, neighbor_id, round(distance, 6) AS distance
        FROM top""",
        LINE,
        SCORED,
        PROBES,
        NEIGHBORS,
    ),
)
def knn(spark, folder):
    """The three nearest train rows of each of the twenty worst predicted rows."""
    _, _, near = worst_neighbors(spark, folder)
    return near.select("probe_id", "rank", "neighbor_id", F.round("distance", 6).alias("distance"))


@query(
    "knn_test_rows",
    on_signal(
        """SELECT t.id AS probe_id, n.id AS neighbor_id, round(sqrt(pow(t.sum_qty - n.sum_qty, 2)
          + pow(0.01 * t.acctbal - 0.01 * n.acctbal, 2)), 6) AS distance
        FROM sig t, LATERAL (SELECT id, sum_qty, acctbal FROM tr
          ORDER BY sqrt(pow(t.sum_qty - tr.sum_qty, 2) + pow(0.01 * t.acctbal - 0.01 * tr.acctbal, 2)), id
          LIMIT 1) n WHERE t.split = 'test'"""
    ),
)
def knn_test_rows(spark, folder):
    """The nearest train row of every test row."""
    table = signal(spark, folder).materialized()
    near = joins.nearest_neighbors(
        table.test, table.train, "id", ["sum_qty", "acctbal"], k=1, weights=[1.0, 0.01], exclude_self=False
    )
    return near.select("probe_id", "neighbor_id", F.round("distance", 6).alias("distance"))


@query(
    "knn_predict",
    on_signal(
        """SELECT p.id, round(avg(y), 4) AS neighbor_mean,
        round(abs(avg(y) - p.target) - p.score, 4) AS error_gap
        FROM probes p JOIN top t ON p.id = t.probe_id GROUP BY p.id, p.target, p.score""",
        LINE,
        SCORED,
        PROBES,
        NEIGHBORS,
    ),
)
def knn_predict(spark, folder):
    """Mean target of the neighbours, and its error beyond the model's."""
    table, worst, near = worst_neighbors(spark, folder)
    means = joins.neighbor_average(near, table.train, "id", "target")
    out = worst.join(means, worst.id == means.probe_id)
    gap = F.abs(F.col("neighbor_mean") - F.col("target")) - F.col("score")
    return out.select("id", r4("neighbor_mean"), r4(gap, "error_gap"))


# --- search


def search_table(spark, folder):
    return signal(spark, folder).materialized()


def _valid_sql() -> str:
    parts = []
    for c in ("n_lines", "sum_qty", "acctbal", "yr_sold", "mo_sold"):
        checks = {
            "none": "TRUE",
            "extract_0": f"""count(*) FILTER ({c} = 0) > 0 AND coalesce(regr_slope(target, {c})
              FILTER ({c} <> 0), 0) <> 0""",
            "linearize_order_2": f"count(DISTINCT {c}) >= 2",
            "extract_0_linearize_order_2": f"count(DISTINCT {c}) FILTER ({c} <> 0) >= 2",
            "linearize_order_3": f"count(DISTINCT {c}) >= 2",
        }
        for n in (5, 10, 20):
            grid = "[" + ", ".join(f"{i}/{n}.0" for i in range(n + 1)) + "]"
            checks[f"quantile_bin({n})"] = (
                f"len(list_distinct(quantile_cont({c}, {grid}))) = {n + 1}"
            )
        parts += [
            f"SELECT '{c}' AS column_name, '{t}' AS technique FROM tr HAVING {e}"
            for t, e in checks.items()
        ]
    for t in search.CATEGORICAL_TECHNIQUES:
        parts.append(f"SELECT 'status', '{t}' FROM tr HAVING count(DISTINCT status) > 1")
    return union_all(parts)


@query("valid_variants", on_signal(_valid_sql()))
def valid_variants(spark, folder):
    table = search_table(spark, folder)
    found = search.valid_variants(table, search.all_variants(table))
    return spark.createDataFrame([tuple(v) for v in found], "column_name string, technique string")


@query("variant_scores")
def variant_scores(spark, folder):
    """Cross-validated score of every variant on its own, next to the mean's score."""
    table = search_table(spark, folder)
    encoded = search.encode_variants(table, search.all_variants(table), split.hash_fold("id", 8))
    base = table.train.agg(metrics.baseline_rmse("target")).first()[0]
    return metrics.technique_ranking(search.variant_scores(encoded, lasso(0.0005), base))


@query("forward_select")
def forward_select(spark, folder):
    """Greedy search over all variants; one pass over the encoded table."""
    table = search_table(spark, folder)
    variants = search.all_variants(table)
    encoded = search.encode_variants(table, variants, split.hash_fold("id", 8))
    history = search.forward_select(
        search.unused_columns(list(encoded.columns)),
        lambda sets: encoded.scores(sets, lasso(0.0005)),
    )
    first = search.winners(history, improved_only=False)
    rows = [
        (int(r["round"]), *r["candidate"], float(r["score"]), int(r["improved"]))
        for r in first.to_dict("records")
    ]
    return spark.createDataFrame(
        rows, "round int, column string, technique string, score double, improved int"
    )


@query("encoder_comparison")
def encoder_comparison(spark, folder):
    """One-hot, mean and ordinal encoding of all categories, over repeated folds."""
    names = ("status", "priority", "segment", "region")
    table = sales(spark, folder, names)
    techniques = ("one_hot", "target_mean", "label_encoding")
    variants = [search.Variant(c, t) for t in techniques for c in names]
    bucket = F.pmod(split.mix("id"), F.lit(scorestats.BUCKETS))
    encoded = search.encode_variants(table, variants, bucket)
    rows = []
    for t in techniques:
        cols = [c for v, cs in encoded.columns.items() if v.technique == t for c in cs]
        part = search.scaled(encoded.grams.subset(cols))
        for s, k, v in scorestats.repeated_cv(part, lasso(0.0005), 3, range(5)):
            rows.append((t, s, k, v))
    scores = spark.createDataFrame(rows, "technique string, seed int, fold int, score double")
    return metrics.score_summary(scores, ["technique"], "score")


@query("strategy_sweep")
def strategy_sweep(spark, folder):
    """Mean and spread of the score under different fold counts and test shares."""
    table = encoded_signal(spark, folder)
    scores = scorestats.strategy_sweep(
        table, table.features, lasso(0.001), test_ratios=(0.1, 0.25), seeds=range(5)
    )
    return metrics.score_summary(scores, ["strategy"], "score")
