"""Scores of predictions and summaries of repeated scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# confidence level in percent -> z value; fixed values
Z_VALUES = {80: 1.28, 90: 1.645, 95: 1.96, 98: 2.33, 99: 2.58}


def rmse(predicted: str | Column, actual: str | Column) -> Column:
    p = F.col(predicted) if isinstance(predicted, str) else predicted
    a = F.col(actual) if isinstance(actual, str) else actual
    return F.sqrt(F.avg((p - a) * (p - a)))


def r2(predicted: str, actual: str) -> Column:
    gap = F.col(actual) - F.col(predicted)
    both = F.when(gap.isNotNull(), F.col(actual))
    return 1 - F.sum(gap * gap) / (F.var_pop(both) * F.count(both))


def baseline_rmse(actual: str) -> Column:
    """RMSE of always predicting the mean."""
    return F.stddev_pop(actual)


def score_summary(scores: DataFrame, groups: Sequence[str], score: str) -> DataFrame:
    return scores.groupBy(*groups).agg(
        F.count(score).alias("n_scores"),
        F.avg(score).alias("mean_score"),
        F.stddev_pop(score).alias("std_score"),
    )


def samples_for_precision(std: Column, z: Column, precision: float) -> Column:
    """How many scores must be averaged for a confidence interval of the given half width."""
    return F.ceil(F.pow(std * z / F.lit(precision), F.lit(2.0)))


def ci_samples(
    scores: DataFrame, groups: Sequence[str], score: str, precision: float
) -> DataFrame:
    levels = F.array(
        *[F.struct(F.lit(c).alias("ci"), F.lit(z).alias("z")) for c, z in Z_VALUES.items()]
    )
    out = score_summary(scores, groups, score).select(*groups, "std_score", F.inline(levels))
    return out.select(
        *groups,
        "ci",
        samples_for_precision(F.col("std_score"), F.col("z"), precision).alias("n_samples"),
    )


def technique_ranking(scores: DataFrame, baseline: str = "baseline") -> DataFrame:
    """Per column: gap of each technique to the best one, and whether it loses to the mean.

    ``scores`` holds (column, technique, score, baseline): one row per technique.
    """
    best = W.partitionBy("column")
    return scores.select(
        "column",
        "technique",
        "score",
        (F.col("score") - F.min("score").over(best)).alias("diff"),
        (F.col("score") > F.col(baseline)).cast("int").alias("worse_than_mean"),
    )


def argbest(scores: DataFrame, score: str, ordinal: str, goal: str = "min") -> DataFrame:
    """The row with the best score; of equal scores the first by ``ordinal`` wins."""
    value = F.col(score) if goal == "min" else -F.col(score)
    row = F.struct(*[F.col(c) for c in scores.columns])
    best = scores.where(F.col(score).isNotNull()).agg(
        F.min_by(row, F.struct(value, F.col(ordinal))).alias("r")
    )
    return best.select("r.*")


def weighted_average(predictions: Sequence[str], weights: Sequence[float] | None = None) -> Column:
    weights = list(weights) if weights is not None else [1.0] * len(predictions)
    blend = F.lit(0.0)
    for p, w in zip(predictions, weights, strict=True):
        blend = blend + F.col(p) * F.lit(float(w))
    return blend / F.lit(float(sum(weights)))


def weight_sweep(
    df: DataFrame, predictions: Sequence[str], weights: Sequence[float], name: str = "blend"
) -> DataFrame:
    """One blend per weight set, where set i raises weight i by one."""
    sets = []
    for i in range(len(weights)):
        raised = [w + (1 if i == j else 0) for j, w in enumerate(weights)]
        sets.append(
            F.struct(
                F.lit(i).alias("weight_set"), weighted_average(predictions, raised).alias(name)
            )
        )
    return df.select("*", F.inline(F.array(*sets)))
