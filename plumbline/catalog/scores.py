"""Queries on score series, score summaries, metrics and blends."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.registry import on_sales, query
from plumbline.catalog.tables import PROFILED, profile_sql, r4, union_all
from plumbline.operators import metrics as m
from plumbline.operators import quality as qual
from plumbline.operators import windows as win
from plumbline.plans.search import (
    CATEGORICAL_TECHNIQUES,
    NUMERIC_TECHNIQUES,
    variant_grid,
)
from plumbline.sources.tables import read, sales


def series(spark, folder):
    """One series of scores per user: (run, i, score)."""
    return read(spark, folder, "events").select(
        F.col("user_id").alias("run"), F.col("event_id").alias("i"), F.col("value").alias("score")
    )


SERIES_SQL = "series AS (SELECT user_id AS run, event_id AS i, value AS score FROM events)"
RUNNING = "OVER (PARTITION BY run ORDER BY i ROWS UNBOUNDED PRECEDING)"


@query(
    "running_mean",
    f"""WITH {SERIES_SQL} SELECT run, i, round(avg(score) {RUNNING}, 10) AS running_mean
    FROM series""",
)
def running_mean(spark, folder):
    out = win.running_mean(series(spark, folder), ["run"], ["i"], "score")
    return out.select("run", "i", F.round("running_mean", 10).alias("running_mean"))


@query(
    "moving_average",
    f"""WITH {SERIES_SQL} SELECT run, i, moving_average FROM (
      SELECT run, i, round(avg(score) OVER (PARTITION BY run ORDER BY i
        ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 10) AS moving_average,
        row_number() OVER (PARTITION BY run ORDER BY i) AS n FROM series) WHERE n > 5""",
)
def moving_average(spark, folder):
    out = win.moving_average(series(spark, folder), ["run"], ["i"], "score", 5)
    return out.select("run", "i", F.round("moving_average", 10).alias("moving_average"))


@query(
    "convergence",
    f"""WITH {SERIES_SQL} SELECT run, i, round(abs(avg(score) {RUNNING}
      - avg(score) OVER (PARTITION BY run)), 10) AS gap FROM series""",
)
def convergence(spark, folder):
    out = win.convergence(series(spark, folder), ["run"], ["i"], "score")
    return out.select("run", "i", F.round("gap", 10).alias("gap"))


@query(
    "running_deviation",
    f"""WITH {SERIES_SQL}, d AS (SELECT run, i, score - avg(score) OVER (PARTITION BY run) AS dev
      FROM series)
    SELECT run, i, round(abs(avg(dev) {RUNNING}), 10) AS avg_deviation FROM d""",
)
def running_deviation(spark, folder):
    out = win.running_deviation(series(spark, folder), ["run"], ["i"], "score")
    return out.select("run", "i", F.round("avg_deviation", 10).alias("avg_deviation"))


@query(
    "block_average",
    f"""WITH {SERIES_SQL}, p AS (SELECT run, score,
      (row_number() OVER (PARTITION BY run ORDER BY i) - 1) // 3 AS block FROM series)
    SELECT run, block, round(avg(score), 10) AS block_mean FROM p GROUP BY run, block
    HAVING count(*) = 3""",
)
def block_average(spark, folder):
    out = win.block_average(series(spark, folder), ["run"], ["i"], "score", 3)
    return out.select("run", "block", F.round("block_mean", 10).alias("block_mean"))


@query(
    "progress_stop",
    f"""WITH {SERIES_SQL}, w AS (SELECT run, i,
        row_number() OVER (PARTITION BY run ORDER BY i) AS round,
        (coalesce(sum(score) OVER a, 0) + (8 - count(score) OVER a) * 999999.0) / 8 AS now,
        (coalesce(sum(score) OVER b, 0) + (8 - count(score) OVER b) * 999999.0) / 8 AS before
      FROM series WINDOW
        a AS (PARTITION BY run ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW),
        b AS (PARTITION BY run ORDER BY i ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING))
    SELECT run, min(round) FILTER (before - now <= 0.0001) AS stop_round FROM w GROUP BY run""",
)
def progress_stop(spark, folder):
    return win.progress_stop(series(spark, folder), ["run"], ["i"], "score")


@query(
    "score_summary",
    """SELECT event_type, count(value) AS n_scores, round(avg(value), 6) AS mean_score,
    round(stddev_pop(value), 6) AS std_score FROM events GROUP BY event_type""",
)
def score_summary(spark, folder):
    out = m.score_summary(read(spark, folder, "events"), ["event_type"], "value")
    return out.select(
        "event_type",
        "n_scores",
        F.round("mean_score", 6).alias("mean_score"),
        F.round("std_score", 6).alias("std_score"),
    )


@query(
    "ci_samples",
    """SELECT event_type, ci, CAST(ceil(pow(std * z / 0.5, 2)) AS BIGINT) AS n_samples
    FROM (SELECT event_type, stddev_pop(value) AS std FROM events GROUP BY event_type),
    (VALUES (80, 1.28::DOUBLE), (90, 1.645), (95, 1.96), (98, 2.33), (99, 2.58)) t(ci, z)""",
)
def ci_samples(spark, folder):
    """Scores needed per kind of event for a mean within half a unit."""
    return m.ci_samples(read(spark, folder, "events"), ["event_type"], "value", 0.5)


ENCODED = ("status", "priority", "segment", "region", "nation")


def technique_scores_sql() -> str:
    """In-sample RMSE of predicting by the category's mean and by its median."""
    parts = []
    for c in ENCODED:
        for technique, agg in (("target_mean", "avg"), ("target_median", "median")):
            parts.append(
                f"""SELECT '{c}' AS column_name, '{technique}' AS technique,
                sqrt(avg(pow(target - p, 2))) AS score FROM (SELECT target,
                {agg}(target) OVER (PARTITION BY {c}) AS p FROM sales WHERE split = 'train')"""
            )
    return union_all(parts)


def technique_scores(spark, folder):
    """(column, technique, score, baseline) from grouped error sums: sum of (y - p) squared."""
    from plumbline.operators.encode import category_stats
    from plumbline.operators.columns import long_form
    from plumbline.plans.storage import lookup_join

    table = sales(spark, folder, ENCODED)
    stats = category_stats(table, ENCODED)
    long = long_form(table.train, ["target"], ENCODED, "string")
    cells = lookup_join(long, stats, ["column", "value"], "inner")
    scores = cells.groupBy("column").agg(
        m.rmse("mean", "target").alias("target_mean"),
        m.rmse("median", "target").alias("target_median"),
        m.baseline_rmse("target").alias("baseline"),
    )
    return scores.unpivot(
        ["column", "baseline"], ["target_mean", "target_median"], "technique", "score"
    )


@query(
    "technique_ranking",
    on_sales(
        """SELECT column_name, technique, round(score, 4) AS score,
        round(score - min(score) OVER (PARTITION BY column_name), 4) AS diff,
        CASE WHEN score > base THEN 1 ELSE 0 END AS worse_than_mean FROM ts,
        (SELECT stddev_pop(target) AS base FROM sales WHERE split = 'train')""",
        f"ts AS ({technique_scores_sql()})",
    ),
)
def technique_ranking(spark, folder):
    out = m.technique_ranking(technique_scores(spark, folder))
    return out.select(
        F.col("column").alias("column_name"),
        "technique",
        r4("score"),
        r4("diff"),
        "worse_than_mean",
    )


@query(
    "argbest",
    on_sales(
        """SELECT column_name, technique, round(score, 4) AS score FROM ts
        ORDER BY ts.score, column_name, technique LIMIT 1""",
        f"ts AS ({technique_scores_sql()})",
    ),
)
def argbest(spark, folder):
    """The best of all (column, technique) pairs."""
    scores = technique_scores(spark, folder).withColumn(
        "ordinal", F.concat_ws("/", "column", "technique")
    )
    best = m.argbest(scores, "score", "ordinal")
    return best.select(F.col("column").alias("column_name"), "technique", r4("score"))


@query(
    "variant_grid",
    on_sales(
        f"""SELECT column_name, unnest(CASE WHEN type = 'NUMERIC'
        THEN {list(NUMERIC_TECHNIQUES)} ELSE {list(CATEGORICAL_TECHNIQUES)} END) AS technique
        FROM p WHERE column_name NOT IN (SELECT column_name FROM p WHERE has_null = 1)""",
        f"p AS ({profile_sql()})",
    ),
)
def variant_grid_query(spark, folder):
    """Techniques for every profiled column that has no nulls."""
    found = qual.profile(sales(spark, folder, PROFILED).df, PROFILED)
    out = variant_grid(found, found.where("has_null = 1"))
    return out.select(F.col("column").alias("column_name"), "technique")
