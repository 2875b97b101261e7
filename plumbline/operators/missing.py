"""Filling of nulls and repair of values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.spec import CATEGORICAL
from plumbline.table import FeatureTable


def fit_means(table: FeatureTable, columns: Sequence[str] | None = None) -> dict[str, float]:
    columns = list(columns or table.numeric)
    row = table.train.agg(*[F.avg(c).alias(c) for c in columns]).first()
    return {c: row[c] for c in columns if row[c] is not None}


def fillna_mean(table: FeatureTable, columns: Sequence[str] | None = None) -> FeatureTable:
    """Fill numeric nulls of both splits with the train mean."""
    return table.with_df(table.df.fillna(fit_means(table, columns)))


def fillna_value(table: FeatureTable, value) -> FeatureTable:
    """Fill the nulls of every feature whose type can hold the value."""
    return table.with_df(table.df.fillna(value, subset=table.features))


def fill_column(
    table: FeatureTable, column: str, value, position: int | None = None
) -> FeatureTable:
    """Fill one column and declare the fill value as a level."""
    spec = table.spec.with_fill_level(column, value, position)
    return replace(fill_columns(table, {column: value}), spec=spec)


def fill_columns(table: FeatureTable, rules: Mapping[str, object]) -> FeatureTable:
    """Fill several columns in one projection and declare the fill values as levels."""
    spec, fills = table.spec, {}
    for c, v in rules.items():
        text = spec[c].type == CATEGORICAL
        fills[c] = F.coalesce(F.col(c), F.lit(str(v) if text else float(v)))
        spec = spec.with_fill_level(c, v)
    return replace(table, df=table.df.withColumns(fills), spec=spec)


def replace_values(table: FeatureTable, rules: Mapping[str, Mapping]) -> FeatureTable:
    """Substitute values per column: ``{column: {from: to}}``, in one projection."""
    changes = {}
    for c, mapping in rules.items():
        expr = F.col(c)
        for old, new in mapping.items():
            expr = F.when(F.col(c) == F.lit(old), F.lit(new)).otherwise(expr)
        changes[c] = expr
    return table.with_columns(changes)


def conditional_fill(
    table: FeatureTable, when_null: str, columns: Sequence[str], value
) -> FeatureTable:
    """Set columns to a value on the rows where another column is null."""
    gone = F.col(when_null).isNull()
    return table.with_columns({c: F.when(gone, F.lit(value)).otherwise(F.col(c)) for c in columns})


def floor_negative(df: DataFrame, column: str, default: float) -> DataFrame:
    """Replace negative values by a default."""
    return df.withColumn(
        column, F.when(F.col(column) < 0, F.lit(float(default))).otherwise(F.col(column))
    )


def count_negative(df: DataFrame, column: str) -> int:
    return df.agg(F.count_if(F.col(column) < 0)).first()[0]
