"""Row positions, running totals and trailing windows that never put a whole group in one task.

Rows are range-partitioned by (group, order), so a group that holds a third of the table is
spread over many tasks.  Each task contributes its totals; the totals of earlier tasks become
an offset that is added to the running value inside the task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from plumbline.plans.storage import SMALL_ROWS, at_most, lookup_join, materialize


def running_sums(
    df: DataFrame,
    groups: Sequence[str],
    order: Sequence[str],
    sums: dict[str, Column],
    small: int = SMALL_ROWS,
) -> DataFrame:
    """Add inclusive running totals ``{name: value expression}`` per group in ``order``.

    ``order`` must be unique inside a group.
    """
    frame = W.partitionBy(*groups).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    if at_most(df, small):
        return df.withColumns({n: F.sum(v).over(frame) for n, v in sums.items()})

    spark = df.sparkSession
    parts = max(
        int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism
    )
    tagged = df.withColumns({f"__v_{n}": v for n, v in sums.items()})
    tagged = tagged.repartitionByRange(parts, *groups, *order)
    # the written table freezes the partition number of each row for both uses below
    tagged = materialize(tagged.withColumn("__pid", F.spark_partition_id()))

    totals = tagged.groupBy(*groups, "__pid").agg(
        *[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums]
    )
    # at most one row per task in any group
    earlier = W.partitionBy(*groups).orderBy("__pid").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(g).alias(f"__g_{i}") for i, g in enumerate(groups)],
        F.col("__pid").alias("__opid"),
        *[F.coalesce(F.sum(f"__t_{n}").over(earlier), F.lit(0)).alias(f"__o_{n}") for n in sums],
    )
    inside = W.partitionBy("__pid", *groups).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = tagged.withColumns({f"__r_{n}": F.sum(f"__v_{n}").over(inside) for n in sums})
    match = F.col("__pid") == F.col("__opid")
    for i, g in enumerate(groups):
        match = match & F.col(g).eqNullSafe(F.col(f"__g_{i}"))
    joined = lookup_join(local, offsets, match)
    return joined.select(
        *df.columns, *[(F.col(f"__r_{n}") + F.col(f"__o_{n}")).alias(n) for n in sums]
    )


def positions(
    df: DataFrame,
    groups: Sequence[str],
    order: Sequence[str],
    name: str = "pos",
    small: int = SMALL_ROWS,
) -> DataFrame:
    """Add the 0-based position of each row within its group."""
    out = running_sums(df, groups, order, {name: F.lit(1).cast("bigint")}, small)
    return out.withColumn(name, F.col(name) - 1)


def trailing_windows(
    df: DataFrame,
    groups: Sequence[str],
    pos: str,
    n: int,
    columns: dict[str, Callable[[WindowSpec], Column]],
    block: int = 65_536,
) -> DataFrame:
    """Evaluate ``{name: fn(window)}``, where a frame reaches at most ``n`` rows back.

    ``fn`` gets the ordered window and sets its own row frame.  ``pos`` numbers the rows of a
    group from 0.  Rows are cut into blocks of consecutive positions, and the last ``n`` rows of
    a block are also sent to the next one, so a window task holds at most ``block + n`` rows.
    """
    block = max(block, n + 1)
    own = (F.col(pos) / F.lit(block)).cast("bigint")
    spill = F.col(pos) % block >= block - n
    copies = df.withColumn(
        "__block", F.explode(F.when(spill, F.array(own, own + 1)).otherwise(F.array(own)))
    )
    window = W.partitionBy(*groups, "__block").orderBy(pos)
    out = copies.withColumns({name: fn(window) for name, fn in columns.items()})
    return out.where(F.col("__block") == own).drop("__block")
