"""Category levels as a table of dense codes that is joined to the rows and never reaches the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.columns import long_form
from plumbline.plans.prefix import positions
from plumbline.plans.storage import BROADCAST_ROWS, SMALL_ROWS, materialize

# more entries than this are joined as a table, not written into the plan; the result is the same
LITERAL_LEVELS = 1_000


def dictionary(rows: DataFrame, columns: Sequence[str], small: int = SMALL_ROWS) -> DataFrame:
    """(column, level, code) of every non-null value; a column's codes count from 0 in text order.

    Codes are ranks over a range partition of (column, level), so a column of any number of
    levels is spread over the tasks.  The table is written once.
    """
    found = long_form(rows, [], columns, "string").where("value IS NOT NULL").distinct()
    placed = positions(found, ["column"], ["value"], "code", small)
    return materialize(placed.select("column", F.col("value").alias("level"), "code"))


def wider_than(levels: DataFrame, limit: int) -> set[str]:
    """Columns with more than ``limit`` levels: those that have a code ``limit``."""
    return {r["column"] for r in levels.where(F.col("code") == limit).collect()}


def with_codes(
    df: DataFrame, columns: Sequence[str], levels: DataFrame, prefix: str = "__code_"
) -> DataFrame:
    """Add ``prefix + column`` as doubles; null for null and for levels without a code.

    A column's levels are broadcast if its codes show that there are few enough, else joined by
    shuffle.
    """
    wide = wider_than(levels, BROADCAST_ROWS)
    for c in columns:
        own = levels.where(F.col("column") == c).select(
            F.col("level").alias("__level"), F.col("code").cast("double").alias(f"{prefix}{c}")
        )
        own = own if c in wide else F.broadcast(own)
        df = df.join(own, F.col(c).cast("string") == F.col("__level"), "left").drop("__level")
    return df
