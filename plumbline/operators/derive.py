"""Patterns for derived feature columns; each function builds one Column expression."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.spec import safe_name
from plumbline.table import FeatureTable


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def flag(condition: Column) -> Column:
    """1 or 0; an unknown condition counts as false."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def membership(column: str | Column, values: Iterable) -> Column:
    """1 if the value is one of the listed ones, else 0, also for null."""
    return flag(_c(column).isin(list(values)))


def product(a: str | Column, b: str | Column) -> Column:
    return _c(a) * _c(b)


def total(*parts: str | Column) -> Column:
    """Sum of parts; null if any part is null."""
    return reduce(add, map(_c, parts))


def fractional_date(year: str | Column, month: str | Column) -> Column:
    return _c(year) + _c(month) / F.lit(12.0)


def share(part: str | Column, whole: str | Column) -> Column:
    """part / (1 + whole); the added one keeps a zero whole defined."""
    return F.try_divide(_c(part), 1 + _c(whole))


def gated(value: str | Column, condition: Column) -> Column:
    """The value where the condition holds, else 0."""
    return F.when(F.coalesce(condition, F.lit(False)), _c(value)).otherwise(0.0)


def elapsed(later: str | Column, earlier: str | Column, floor: float | None = None) -> Column:
    gap = _c(later) - _c(earlier)
    if floor is None:
        return gap
    return F.when(gap < floor, F.lit(floor)).otherwise(gap)


def equal(a: str | Column, b: str | Column) -> Column:
    """Equality flag; a null on either side is not equal."""
    return flag(_c(a) == _c(b))


def different(a: str | Column, b: str | Column) -> Column:
    """Inequality flag; a null on either side counts as different."""
    return 1 - equal(a, b)


def multi_hot(
    columns: Sequence[str], levels: Iterable[str], prefix: str, presence_prefix: str | None = None
) -> dict[str, Column]:
    """Per level: how many of the columns hold it, and whether any does."""
    out = {}
    for level in levels:
        count = total(*[flag(F.col(c) == F.lit(level)) for c in columns])
        out[safe_name(f"{prefix}_{level}")] = count
        if presence_prefix:
            out[safe_name(f"{presence_prefix}_{level}")] = flag(count > 0)
    return out


def separate_value(table: FeatureTable, column: str, value, new: str) -> FeatureTable:
    """Add an indicator column for one value; a missing source column changes nothing."""
    if column not in table.df.columns:
        return table
    return table.with_numeric({new: flag(F.col(column) == F.lit(value))})
