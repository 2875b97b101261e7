"""Id-range completion, nearest neighbours and rank comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.plans import boxes
from plumbline.plans.prefix import positions
from plumbline.plans.storage import SMALL_ROWS, at_most, lookup_join, materialize


def complete_range(
    df: DataFrame, id: str, value: str, lo: int, hi: int, default: float
) -> DataFrame:
    """One row per id in [lo, hi]: its non-negative value, or the default; other ids are kept."""
    spark = df.sparkSession
    usable = df.select(
        F.col(id).cast("bigint").alias(id),
        F.when(F.col(value) < 0, F.lit(float(default))).otherwise(F.col(value)).alias(value),
    )
    wanted = spark.range(lo, hi + 1).withColumnRenamed("id", id)
    return wanted.join(usable, id, "full").withColumn(
        value, F.coalesce(F.col(value), F.lit(float(default)))
    )


def nearest_neighbors(
    probes: DataFrame,
    train: DataFrame,
    id: str,
    features: Sequence[str],
    k: int = 5,
    weights: Sequence[float] | None = None,
    exclude_self: bool = True,
    split: str | None = None,
    block_rows: int = boxes.PROBE_ROWS,
    chunk_rows: int = boxes.BOX_ROWS,
    few: int = boxes.FEW,
) -> DataFrame:
    """(probe_id, rank, neighbor_id, distance) of the k nearest train rows of each probe.

    With ``split``, rows are known by (split, id), a probe leaves out only the row that has both,
    and the result starts with ``probe_split``.  Probes that share a key are searched for one by
    one.  Rows with a null feature take no part.  Equal distances are ordered by id.

    Up to ``few`` probes (or ``block_rows``, if fewer) go along with one scan of the train rows; more
    of them meet only the bounding boxes that can hold a neighbour, in pieces of ``block_rows``
    probes and ``chunk_rows`` train rows.  The results are the same.
    """
    keys = [split, id] if split else [id]
    search = boxes.Search(id, split, features, weights, k, exclude_self)
    narrow = train.select(*keys, *features).dropna(subset=list(features))
    # written, so that the numbers that tell equal keys apart stay the same
    todo = probes.select(*keys, *features).dropna(subset=list(features))
    todo = materialize(todo.withColumn("__probe", F.monotonically_increasing_id()))
    if at_most(todo, min(few, block_rows)):
        found = boxes.by_scan(search, narrow, todo.toPandas())
    else:
        narrow = materialize(narrow)
        found = boxes.by_boxes(search, narrow, todo, narrow.count(), chunk_rows, block_rows)
    rank = F.row_number().over(W.partitionBy("__probe").orderBy("distance", "neighbor_id"))
    ranked = found.withColumn("rank", rank).where(F.col("rank") <= k)
    named = todo.select("__probe", *[F.col(c).alias(f"probe_{n}") for c, n in zip(keys[::-1], ("id", "split"))])
    first = ["probe_split"] if split else []
    return named.join(ranked, "__probe").select(*first, "probe_id", "rank", "neighbor_id", "distance")


def neighbor_average(
    neighbors: DataFrame, train: DataFrame, id: str, target: str
) -> DataFrame:
    """(probe_id, neighbor_mean): mean target of the neighbours of each probe."""
    values = train.select(F.col(id).alias("neighbor_id"), F.col(target).alias("__y"))
    pairs = neighbors.select("probe_id", "neighbor_id")
    joined = lookup_join(values, pairs, "neighbor_id", "inner")
    return joined.groupBy("probe_id").agg(F.avg("__y").alias("neighbor_mean"))


def score_ranks(
    df: DataFrame, id: str, score: str, name: str, small: int = SMALL_ROWS
) -> DataFrame:
    """(id, 0-based rank from the largest score down; equal scores by id)."""
    keyed = df.select(id, (-F.col(score)).alias("__neg"))
    return positions(keyed, [], ["__neg", id], name, small).drop("__neg")


def rank_compare(
    df: DataFrame, id: str, actual: str, predicted: str, small: int = SMALL_ROWS
) -> DataFrame:
    """(id, actual_rank, predicted_rank) of two score columns."""
    base = materialize(df.select(id, actual, predicted))
    a = score_ranks(base, id, actual, "actual_rank", small)
    p = score_ranks(base, id, predicted, "predicted_rank", small)
    return a.join(p, id)


def worst_k(df: DataFrame, id: str, score: str, k: int) -> DataFrame:
    """The k rows with the largest score; each task keeps only its own k candidates."""
    return df.orderBy(F.desc(score), id).limit(k)
