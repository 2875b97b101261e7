"""Running, trailing and block statistics over series of scores.

A series is told apart by ``groups`` and ordered by ``order``; any series may be as long as the
table, so all of these go through the split-group primitives of ``plans.prefix``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.plans.prefix import positions, running_sums, trailing_windows
from plumbline.plans.storage import SMALL_ROWS, lookup_join, materialize

NO_SCORE = 999_999.0


def running_mean(
    df: DataFrame,
    groups: Sequence[str],
    order: Sequence[str],
    score: str,
    name: str = "running_mean",
    small: int = SMALL_ROWS,
) -> DataFrame:
    sums = {"__s": F.col(score), "__n": F.lit(1).cast("bigint")}
    out = running_sums(df, groups, order, sums, small)
    return out.withColumn(name, F.col("__s") / F.col("__n")).drop("__s", "__n")


def moving_average(
    df: DataFrame,
    groups: Sequence[str],
    order: Sequence[str],
    score: str,
    n: int = 5,
    name: str = "moving_average",
    small: int = SMALL_ROWS,
    block: int = 65_536,
) -> DataFrame:
    """Mean of the last n scores, for rows that have n earlier scores."""
    numbered = positions(df, groups, order, "__pos", small)
    out = trailing_windows(
        numbered,
        groups,
        "__pos",
        n,
        {name: lambda w: F.avg(score).over(w.rowsBetween(-(n - 1), 0))},
        block,
    )
    return out.where(F.col("__pos") >= n).drop("__pos")


def with_final_mean(df: DataFrame, groups: Sequence[str], score: str, name: str) -> DataFrame:
    """Add the mean over the whole series."""
    final = df.groupBy(*groups).agg(F.avg(score).alias(name))
    return lookup_join(df, final, list(groups))


def convergence(
    df: DataFrame, groups: Sequence[str], order: Sequence[str], score: str, small: int = SMALL_ROWS
) -> DataFrame:
    """How far the running mean is from the mean of the whole series."""
    out = running_mean(with_final_mean(df, groups, score, "__f"), groups, order, score, small=small)
    return out.withColumn("gap", F.abs(F.col("running_mean") - F.col("__f"))).drop("__f")


def running_deviation(
    df: DataFrame, groups: Sequence[str], order: Sequence[str], score: str, small: int = SMALL_ROWS
) -> DataFrame:
    """Absolute running mean of the signed deviations from the series mean."""
    centred = with_final_mean(df, groups, score, "__f").withColumn(
        "deviation", F.col(score) - F.col("__f")
    )
    out = running_mean(centred, groups, order, "deviation", "__m", small)
    return out.withColumn("avg_deviation", F.abs("__m")).drop("__m", "__f")


def block_average(
    df: DataFrame,
    groups: Sequence[str],
    order: Sequence[str],
    score: str,
    n: int,
    small: int = SMALL_ROWS,
) -> DataFrame:
    """Mean of each n consecutive scores; an incomplete last block is left out."""
    numbered = positions(df, groups, order, "__pos", small)
    block = (F.col("__pos") / F.lit(n)).cast("bigint").alias("block")
    means = numbered.groupBy(*groups, block).agg(
        F.avg(score).alias("block_mean"), F.count("*").alias("__n")
    )
    return means.where(F.col("__n") == n).drop("__n")


def progress_stop(
    df: DataFrame,
    groups: Sequence[str],
    order: Sequence[str],
    score: str,
    n: int = 8,
    min_delta: float = 0.0001,
    small: int = SMALL_ROWS,
    block: int = 65_536,
) -> DataFrame:
    """(groups, stop_round): first round whose trailing mean improves too little.

    Missing scores at the start count as a very bad score.  Null when a series never stops.
    """
    numbered = materialize(positions(df, groups, order, "__pos", small))

    def padded(first: int, last: int):
        def over(w):
            frame = w.rowsBetween(first, last)
            got = F.count(score).over(frame)
            got_sum = F.coalesce(F.sum(score).over(frame), F.lit(0.0))
            return (got_sum + (n - got) * F.lit(NO_SCORE)) / n

        return over

    means = trailing_windows(
        numbered,
        groups,
        "__pos",
        n,
        {"__now": padded(-(n - 1), 0), "__before": padded(-n, -1)},
        block,
    )
    stalled = F.col("__before") - F.col("__now") <= min_delta
    return means.groupBy(*groups).agg(
        F.min(F.when(stalled, F.col("__pos") + 1)).alias("stop_round")
    )
