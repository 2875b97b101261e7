"""Exact quantiles (linear interpolation) without holding a group's values in one task.

``percentile`` keeps every distinct value of a group in one aggregation buffer, which is fine
up to a known row count.  Beyond it, a bounded sketch brackets each wanted rank, values outside
all brackets collapse to one counted row per gap, and the exact rank is read off the few
remaining values.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.plans.prefix import running_sums
from plumbline.plans.storage import SMALL_ROWS, at_most, lookup_join, materialize


def group_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    small: int = SMALL_ROWS,
    approx: bool = False,
    accuracy: int | None = None,
) -> DataFrame:
    """One row per key group: keys and ``q``, an array with one quantile per probability.

    ``small`` bounds the rows that are handled without brackets.  ``accuracy`` is that of the
    sketch behind the brackets; groups with fewer rows than it do not need one.
    """
    probs = [float(p) for p in probs]
    base = df.where(F.col(value).isNotNull())
    base = base.select(*keys, F.col(value).cast("double").alias("__v"))
    if approx:
        return base.groupBy(*keys).agg(F.percentile_approx("__v", probs, 10_000).alias("q"))
    if at_most(base, small):
        return _plain(base, keys, probs)
    return _bracketed(
        base, list(keys), probs, small, accuracy or max(10_000, 8_000 * len(probs))
    )


def _plain(base: DataFrame, keys: Sequence[str], probs: list[float]) -> DataFrame:
    return base.groupBy(*keys).agg(F.percentile("__v", F.array(*map(F.lit, probs))).alias("q"))


def _bracketed(
    base: DataFrame, keys: list[str], probs: list[float], small: int, accuracy: int
) -> DataFrame:
    # the sketch's rank error is n / accuracy; a bracket spans four times that on either side
    margin = 4.0 / accuracy
    grid = [g for p in probs for g in (max(p - margin, 0.0), min(p + margin, 1.0))]
    sketch = materialize(
        base.groupBy(*keys).agg(
            F.count("*").alias("__n"), F.percentile_approx("__v", grid, accuracy).alias("__b")
        )
    )
    bracket = [
        F.struct(F.col("__b")[2 * i].alias("lo"), F.col("__b")[2 * i + 1].alias("hi"))
        for i in range(len(probs))
    ]
    ranks = [F.lit(p) * (F.col("__n") - 1) for p in probs]
    plan = sketch.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys],
        "__n",
        F.array(*bracket).alias("__br"),
        F.array(*ranks).alias("__rank"),
    )
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    joined = lookup_join(base, plan.drop("__rank"), same, "inner")
    few = F.col("__n") < accuracy
    rows = joined.where(~few)

    v = F.col("__v")
    inside = F.exists("__br", lambda b: v.between(b["lo"], b["hi"]))
    floor = F.array_max(
        F.transform(F.filter("__br", lambda b: b["hi"] < v), lambda b: b["hi"])
    )
    cells = rows.select(
        *keys,
        F.when(inside, v).otherwise(F.coalesce(floor, F.lit(float("-inf")))).alias("__c"),
        F.when(inside, 0).otherwise(1).alias("__gap"),
    )
    counts = cells.groupBy(*keys, "__c", "__gap").agg(F.count("*").alias("__m"))
    cum = running_sums(
        materialize(counts), keys, ["__c", "__gap"], {"__cum": F.col("__m")}, small
    )
    hits = lookup_join(cum, plan.drop("__br"), same, "inner")
    upto, since = F.col("__cum"), F.col("__cum") - F.col("__m")

    def holds(rank: Column) -> Column:
        return (rank >= since) & (rank < upto)

    wanted = F.filter(
        F.transform(
            "__rank",
            lambda r, i: F.struct(
                i.alias("i"),
                (r - F.floor(r)).alias("frac"),
                holds(F.floor(r)).alias("at_lo"),
                holds(F.ceil(r)).alias("at_hi"),
            ),
        ),
        lambda t: t["at_lo"] | t["at_hi"],
    )
    found = hits.select(*keys, "__c", "__gap", F.explode(wanted).alias("t"))
    checked = F.when(F.col("__gap") == 0, F.col("__c")).otherwise(
        F.raise_error(F.lit("a quantile rank fell outside its bracket")).cast("double")
    )
    weight = F.when(F.col("t.at_lo"), 1 - F.col("t.frac")).otherwise(0.0) + F.when(
        F.col("t.at_hi"), F.col("t.frac")
    ).otherwise(0.0)
    per_rank = found.groupBy(*keys, F.col("t.i").alias("__i")).agg(
        F.sum(checked * weight).alias("__q")
    )
    large = per_rank.groupBy(*keys).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("__i", "__q"))), lambda s: s["__q"]
        ).alias("q")
    )
    return _plain(joined.where(few), keys, probs).unionByName(large)


def column_quantiles(
    df: DataFrame,
    probs: Mapping[str, Sequence[float]],
    small: int = SMALL_ROWS,
    accuracy: int | None = None,
    approx: bool = False,
) -> dict[str, list[float]]:
    """Quantiles of several columns, as driver-side constants; exact unless told otherwise."""
    if not probs:
        return {}
    if approx:
        row = df.agg(
            *[
                F.percentile_approx(F.col(c).cast("double"), list(p), accuracy or 10_000).alias(c)
                for c, p in probs.items()
            ]
        ).first()
        return {c: list(row[c] or []) for c in probs}
    if at_most(df, small):
        row = df.agg(
            *[
                F.percentile(F.col(c).cast("double"), F.array(*map(F.lit, p))).alias(c)
                for c, p in probs.items()
            ]
        ).first()
        return {c: list(row[c] or []) for c in probs}
    grid = sorted({p for ps in probs.values() for p in ps})
    long = df.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))
                    for c in probs
                ]
            )
        )
    )
    found = group_quantiles(
        long, ["column"], "value", grid, small, accuracy=accuracy
    ).collect()
    by_col = {r["column"]: dict(zip(grid, r["q"])) for r in found}
    return {c: [by_col[c][p] for p in ps] if c in by_col else [] for c, ps in probs.items()}
