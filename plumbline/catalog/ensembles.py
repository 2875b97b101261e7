"""Queries on boosted trees, kernel ridge regression, stacking and models of the error."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.models import ERROR_LINE, FEATURES, FOLDED, LINE, SCORED, line_scores, on_signal, signal
from plumbline.catalog.registry import query
from plumbline.catalog.tables import r4
from plumbline.operators import joins, numeric
from plumbline.operators import quality as qual
from plumbline.operators import sampling as split
from plumbline.plans import ensembles, sparse, trees
from plumbline.plans.gram import fold_grams, ols
from plumbline.sources.tables import TIME_SPLIT_SQL, time_split

# --- boosted trees

STUMPS = trees.Boosting(trees=3, rate=0.5, leaves=2, l2=1.0, min_rows=5)
STUMP_FEATURES = ("n_lines", "mo_sold")


def _stumps_sql() -> str:
    """Three rounds of the best split of two columns, round by round."""
    steps = ["""s0 AS (SELECT id, split, n_lines, mo_sold, target,
        (SELECT avg(target) FROM tr) AS f FROM sig)"""]
    for k in range(3):
        long = " UNION ALL ".join(
            f"SELECT '{c}' AS c, {c} AS v, f - target AS g FROM s{k} WHERE split = 'train'" for c in STUMP_FEATURES
        )
        steps.append(f"""h{k} AS (SELECT c, v, sum(sum(g)) OVER w AS gl, sum(count(*)) OVER w AS nl,
          sum(sum(g)) OVER (PARTITION BY c) AS g, sum(count(*)) OVER (PARTITION BY c) AS n
          FROM ({long}) GROUP BY c, v WINDOW w AS (PARTITION BY c ORDER BY v))""")
        steps.append(f"""b{k} AS (SELECT c, v, -0.5 * gl / (nl + 1) AS low,
          -0.5 * (g - gl) / (n - nl + 1) AS high FROM h{k} WHERE nl >= 5 AND n - nl >= 5
          ORDER BY gl * gl / (nl + 1) + (g - gl) * (g - gl) / (n - nl + 1) DESC LIMIT 1)""")
        steps.append(f"""s{k + 1} AS (SELECT s.id, s.split, n_lines, mo_sold, target, f + CASE WHEN
          CASE c WHEN 'n_lines' THEN n_lines ELSE mo_sold END <= v THEN low ELSE high END AS f
          FROM s{k} s, b{k})""")
    return on_signal("SELECT id, round(f, 4) AS prediction FROM s3 WHERE split = 'test'", *steps)


@query("boosted_stumps", _stumps_sql())
def boosted_stumps(spark, folder):
    """Three boosted trees of two leaves on columns with few values."""
    table = signal(spark, folder)
    model = trees.boost(table.train, STUMP_FEATURES, "target", STUMPS, "id")
    return model.predict(table.test).select("id", r4("prediction"))


@query("boosted_trees")
def boosted_trees(spark, folder):
    """Test predictions of the three boosted recipes."""
    table = signal(spark, folder).materialized()
    bases = ensembles.final_bases(len(FEATURES))
    bases = {k: b for k, b in bases.items() if k.endswith("_trees")}
    fitted = ensembles.fit_all(table.train, bases, FEATURES, "target", "id")
    return ensembles.predict_all(table.test, fitted).select("id", *bases)


# --- kernel ridge regression


def _det(a: str, b: str, c: str) -> str:
    """Determinant of the 3 x 3 matrix with these columns, given as name prefixes."""
    return (
        f"({a}0 * ({b}1 * {c}2 - {c}1 * {b}2) - {b}0 * ({a}1 * {c}2 - {c}1 * {a}2)"
        f" + {c}0 * ({a}1 * {b}2 - {b}1 * {a}2))"
    )


@query(
    "kernel_ridge",
    on_signal(
        f"""SELECT id, round(({_det('y', 'b', 'c')} * 2.5 + {_det('a', 'y', 'c')} * sqrt(5.0) * x
          + {_det('a', 'b', 'y')} * x * x) / {_det('a', 'b', 'c')}, 4) AS prediction FROM t, e""",
        "m AS (SELECT avg(sum_qty) AS m, stddev_pop(sum_qty) AS s FROM tr)",
        "z AS (SELECT id, split, (sum_qty - m) / s AS x, target AS y FROM sig, m)",
        "t AS (SELECT id, x FROM z WHERE split = 'test')",
        """e AS (SELECT 6.25 * count(*) + 0.6 AS a0, 2.5 * sqrt(5.0) * sum(x) AS a1,
          2.5 * sum(x * x) AS a2, 2.5 * sqrt(5.0) * sum(x) AS b0, 5 * sum(x * x) + 0.6 AS b1,
          sqrt(5.0) * sum(x * x * x) AS b2, 2.5 * sum(x * x) AS c0, sqrt(5.0) * sum(x * x * x) AS c1,
          sum(x * x * x * x) + 0.6 AS c2, 2.5 * sum(y) AS y0, sqrt(5.0) * sum(x * y) AS y1,
          sum(x * x * y) AS y2 FROM z WHERE split = 'train')""",
    ),
)
def kernel_ridge(spark, folder):
    """Degree-2 kernel ridge regression on the scaled quantity."""
    table = numeric.zscore(signal(spark, folder).materialized(), ["sum_qty"])
    model = ensembles.KernelBase().fit(table.train, ["sum_qty"], "target", "id")
    return model.predict(table.test, "prediction").select("id", r4("prediction"))


# --- wide one-hot designs


def by_balance(spark, folder):
    """Train and test rows with the whole amount of the balance as a category."""
    table = signal(spark, folder)
    return table.with_columns({"amount": F.floor("acctbal").cast("string")})


@query(
    "wide_regression",
    on_signal(
        """SELECT id, round(b + coalesce((s - n * b) / (n + l), 0), 4) AS prediction
        FROM (SELECT id, floor(acctbal) AS a FROM sig WHERE split = 'test') t
        LEFT JOIN g USING (a), bias""",
        """g AS (SELECT floor(acctbal) AS a, count(*) AS n, sum(target) AS s,
          (SELECT 0.001 * count(*) FROM tr) AS l FROM tr GROUP BY 1)""",
        "bias AS (SELECT sum(s / (n + l)) / sum(n / (n + l)) AS b FROM g)",
    ),
)
def wide_regression(spark, folder):
    """Ridge regression on one column of thousands of levels."""
    table = by_balance(spark, folder)
    fit = sparse.ridge_one_hot(table.train, ["amount"], "target", "id", 0.001)
    return fit.predict(table.test, "id").select("id", r4("prediction"))


@query("wide_regression_columns")
def wide_regression_columns(spark, folder):
    """The same beside two further columns."""
    table = by_balance(spark, folder)
    columns = ["amount", "status", "mo_sold"]
    fit = sparse.ridge_one_hot(table.train, columns, "target", "id", 0.001)
    return fit.predict(table.test, "id")


# --- stacking

LINES = {"on_quantity": "sum_qty", "on_balance": "acctbal"}


@query(
    "stacked_lines",
    on_signal(
        """SELECT sig.id, round(q.a + q.b * sum_qty, 4) AS on_quantity,
        round(v.a + v.b * acctbal, 4) AS on_balance,
        round(my + b1 * (q.a + q.b * sum_qty - m1) + b2 * (v.a + v.b * acctbal - m2), 4) AS prediction
        FROM sig, whole, (SELECT a, b FROM fl WHERE k = 5 AND c = 'q') q,
        (SELECT a, b FROM fl WHERE k = 5 AND c = 'v') v WHERE split = 'test'""",
        FOLDED,
        """fl AS (SELECT k, 'q' AS c, regr_slope(target, sum_qty) AS b, regr_intercept(target, sum_qty) AS a
          FROM f, (SELECT unnest(range(6)) AS k) WHERE fold <> k GROUP BY k UNION ALL
          SELECT k, 'v', regr_slope(target, acctbal), regr_intercept(target, acctbal)
          FROM f, (SELECT unnest(range(6)) AS k) WHERE fold <> k GROUP BY k)""",
        """oof AS (SELECT target AS y, q.a + q.b * sum_qty AS p1, v.a + v.b * acctbal AS p2
          FROM f JOIN fl q ON q.k = fold AND q.c = 'q' JOIN fl v ON v.k = fold AND v.c = 'v')""",
        """whole AS (SELECT *, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1,
          (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2 FROM (
          SELECT avg(y) AS my, avg(p1) AS m1, avg(p2) AS m2, var_pop(p1) AS s11, var_pop(p2) AS s22,
            covar_pop(p1, p2) AS s12, covar_pop(p1, y) AS s1y, covar_pop(p2, y) AS s2y FROM oof))""",
    ),
)
def stacked_lines(spark, folder):
    """A plane over the out-of-fold predictions of two lines."""
    bases = {name: ensembles.LinearBase(ols(), (c,)) for name, c in LINES.items()}
    meta = ensembles.LinearBase(ols())
    found = ensembles.stack(
        signal(spark, folder), list(LINES.values()), bases, meta, split.hash_fold("id", 5), 5
    )
    return found.test.select("id", *[r4(c) for c in (*bases, "prediction")])


@query("stacked_models")
def stacked_models(spark, folder):
    """Six bases, and leaf-wise trees on their out-of-fold predictions."""
    table = numeric.zscore(signal(spark, folder).materialized(), FEATURES)
    bases = ensembles.final_bases(len(FEATURES))
    meta = ensembles.TreeBase(trees.leaf_trees())
    return ensembles.stack(table, FEATURES, bases, meta, split.hash_fold("id", 5), 5).test


# --- models of the error


@query(
    "error_model_scores",
    on_signal(
        """SELECT unnest(['baseline', 'train', 'cv']) AS metric,
        round(unnest([baseline, train, cv]), 4) AS value FROM
        (SELECT stddev_pop(score) AS baseline FROM sc),
        (SELECT sqrt(avg(pow(ea + eb * n_lines - score, 2))) AS train FROM sc, el),
        (SELECT avg(s) AS cv FROM (SELECT sqrt(avg(pow(a + b * n_lines - score, 2))) AS s
          FROM fs JOIN lines ON fold = k GROUP BY k))""",
        LINE,
        SCORED,
        ERROR_LINE,
        FOLDED.replace("f AS", "fs AS").replace("FROM tr", "FROM sc"),
        """lines AS (SELECT k, regr_slope(score, n_lines) AS b, regr_intercept(score, n_lines) AS a
          FROM fs, (SELECT unnest(range(5)) AS k) WHERE fold <> k GROUP BY k)""",
    ),
)
def error_model_scores(spark, folder):
    """Mean baseline, train score and cross-validated score of a line that predicts the error."""
    scored = line_scores(signal(spark, folder)).select("id", "n_lines", "score")
    line = {"line": ensembles.LinearBase(ols())}
    found = ensembles.error_model(scored, ["n_lines"], "id", line, split.hash_fold("id", 5), 5)
    return found.metrics.select("metric", r4("value"))


@query("error_ensemble")
def error_ensemble(spark, folder):
    """Error of the averaged six models, modelled by six models again: ranks of both errors."""
    table = numeric.zscore(signal(spark, folder).materialized(), FEATURES)
    bases = ensembles.final_bases(len(FEATURES))
    scored = ensembles.averaged_scores(table, FEATURES, bases)
    found = ensembles.error_model(scored, FEATURES, "id", bases, split.hash_fold("id", 5), 5)
    second = found.rows.withColumn("error_score", F.abs(F.col("error") - F.col("score")))
    return joins.rank_compare(second, "id", "score", "error_score")


@query(
    "unseen_ranked",
    on_signal(
        """SELECT id, 'yr' AS column_name, 'Y' || CAST(CAST(yr_sold AS INT) AS VARCHAR) AS value, rank FROM ranked
        WHERE yr_sold NOT IN (SELECT yr_sold FROM tr)""",
        LINE,
        SCORED,
        ERROR_LINE,
        """ranked AS (SELECT *, row_number() OVER (ORDER BY ea + eb * n_lines DESC, id) - 1
          AS rank FROM sig, el WHERE split = 'test')""",
        by=TIME_SPLIT_SQL,
    ),
)
def unseen_ranked(spark, folder):
    """Test cells with a category that no train row has, and the rank of the predicted error."""
    table = signal(spark, folder, time_split())
    error = fold_grams(line_scores(table), ["n_lines"], "score").fit(ols())
    predicted = table.test.select("id", error.predict().alias("error"))
    ranks = joins.score_ranks(predicted, "id", "error", "rank")
    year = F.concat(F.lit("Y"), F.col("yr_sold").cast("int").cast("string"))
    texts = table.with_columns({"yr": year})
    cells = qual.unseen_categories(texts, ["status", "yr"])
    out = cells.join(ranks, "id", "left")
    return out.select("id", F.col("column").alias("column_name"), "value", "rank")
