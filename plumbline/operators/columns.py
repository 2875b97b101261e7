"""Column, row and set operators on feature tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.plans.storage import lookup_join
from plumbline.spec import CATEGORICAL, NUMERIC, ColumnSpec, safe_name
from plumbline.table import TRAIN, FeatureTable

# --- choosing and naming columns


def select_type(table: FeatureTable, type: str) -> FeatureTable:
    """Keep the features of one declared type."""
    return retain_columns(table, table.spec.names(type))


def retain_columns(table: FeatureTable, columns: Iterable[str]) -> FeatureTable:
    """Keep the listed features, id, target and split; names that do not exist are ignored."""
    keep = set(columns) | {table.spec.id, table.spec.target, table.spec.split}
    df = table.df.select(*[c for c in table.df.columns if c in keep])
    return replace(table, df=df, spec=table.spec.only(keep))


def drop_columns(table: FeatureTable, *columns: str) -> FeatureTable:
    return replace(table, df=table.df.drop(*columns), spec=table.spec.without(*columns))


def remove_categoricals(table: FeatureTable) -> FeatureTable:
    return drop_columns(table, *table.categorical)


def duplicate_column(table: FeatureTable, column: str, new: str) -> FeatureTable:
    spec = table.spec.with_column(new, table.spec[column])
    return replace(table, df=table.df.withColumn(new, F.col(column)), spec=spec)


def rename_columns(table: FeatureTable, mapping: Mapping[str, str]) -> FeatureTable:
    df = table.df.withColumnsRenamed(dict(mapping))
    return replace(table, df=df, spec=table.spec.rename(mapping))


def sanitize_names(table: FeatureTable) -> FeatureTable:
    """Replace every character that would need quoting by ``_``."""
    names = {c: safe_name(c) for c in table.df.columns}
    clash = len(set(names.values())) < len(names)
    if clash:
        raise ValueError("two column names become equal when made safe")
    return rename_columns(table, {c: n for c, n in names.items() if c != n})


def add_constant_target(table: FeatureTable, value: float = 0.0) -> FeatureTable:
    """Give test rows a constant target, so both splits have the same columns."""
    t = table.spec.target
    is_train = F.col(table.spec.split) == TRAIN
    return table.with_columns({t: F.when(is_train, F.col(t)).otherwise(F.lit(value))})


# --- data-dependent column choice: one aggregate, then a plain select


def constant_columns(table: FeatureTable) -> DataFrame:
    """(column, is_constant) over the train rows; a column with a null is never constant."""
    aggs = []
    for c in table.features:
        same = F.coalesce(F.min(c) == F.max(c), F.lit(False))
        aggs.append((same & (F.count(c) == F.count("*"))).cast("int").alias(c))
    return unpivot_row(table.train.agg(*aggs), "column", "is_constant")


def remove_constant_columns(table: FeatureTable) -> FeatureTable:
    flags = constant_columns(table).where("is_constant = 1").collect()
    return drop_columns(table, *[r["column"] for r in flags])


def non_null_columns(df: DataFrame) -> DataFrame:
    """(column, n_null) of the columns without nulls."""
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return unpivot_row(nulls, "column", "n_null").where("n_null = 0")


def keep_non_null_columns(table: FeatureTable) -> FeatureTable:
    full = {r["column"] for r in non_null_columns(table.train).collect()}
    return retain_columns(table, [c for c in table.features if c in full])


def unpivot_row(row: DataFrame, name: str, value: str) -> DataFrame:
    """Turn a one-row frame of same-typed columns into (name, value) rows."""
    return row.unpivot([], row.columns, name, value)


def long_form(df: DataFrame, keys: Sequence[str], columns: Sequence[str], type: str) -> DataFrame:
    """(keys, column, value) with values cast to one type."""
    cells = [
        F.struct(F.lit(c).alias("column"), F.col(c).cast(type).alias("value")) for c in columns
    ]
    return df.select(*keys, F.inline(F.array(*cells)))


def summary(table: FeatureTable) -> DataFrame:
    """Row count, feature count and feature names of the train rows."""
    return table.train.agg(F.count("*").alias("n_rows")).withColumns(
        {
            "n_columns": F.lit(len(table.features)).cast("bigint"),
            "columns": F.lit(",".join(sorted(table.features))),
        }
    )


# --- types


def explode_types(table: FeatureTable) -> FeatureTable:
    """Add the alternative reading of columns that may be read both ways.

    Possibly categorical numbers get a text copy; possibly numeric or ordered categories get a
    number copy, by cast or by position among the declared levels.  A text copy declares its levels
    if they are few.
    """
    # imported here: the encoders build on this module
    from plumbline.operators.encode import declared_levels, ordinal_code

    spec, new = table.spec, {}
    as_text = [c for c in table.numeric if spec[c].possibly_categorical]
    copies = {f"{c}_categorical": F.col(c).cast("string") for c in as_text}
    out = table.with_columns(copies) if copies else table
    levels = declared_levels(out, list(copies))
    for name in copies:
        spec = spec.with_column(name, ColumnSpec(CATEGORICAL, levels[name]))
    for c in table.categorical:
        if table.spec[c].possibly_numerical:
            new[f"{c}_numerical"] = F.col(c).try_cast("double")
        elif table.spec[c].meaningful_order:
            new[f"{c}_numerical"] = ordinal_code(F.col(c), table.spec[c].categories)
    out = replace(out, spec=spec)
    return out.with_numeric(new) if new else out


def cast_types(table: FeatureTable, types: Mapping[str, str]) -> FeatureTable:
    """Redeclare columns and cast them; values that do not parse become null."""
    spec = table.spec
    casts = {}
    for c, t in types.items():
        casts[c] = F.col(c).try_cast("double" if t == NUMERIC else "string")
        spec = spec.with_column(c, replace(spec[c], type=t))
    return replace(table, df=table.df.withColumns(casts), spec=spec)


# --- rows


def keep_rows(table: FeatureTable, condition: Column) -> FeatureTable:
    return table.with_df(table.df.where(condition))


def filter_not_value(table: FeatureTable, column: str, value) -> FeatureTable:
    """Remove train rows that hold a value; nulls stay."""
    hit = (F.col(table.spec.split) == TRAIN) & F.col(column).eqNullSafe(F.lit(value))
    return keep_rows(table, ~hit)


def drop_rows(table: FeatureTable, ids: DataFrame | Iterable[int]) -> FeatureTable:
    """Remove train rows by id, given as a list or as a frame with the id column."""
    key, split = table.spec.id, table.spec.split
    if isinstance(ids, DataFrame):
        doomed = ids.select(F.col(key)).distinct().withColumn(split, F.lit(TRAIN))
        return table.with_df(lookup_join(table.df, doomed, [split, key], "left_anti"))
    hit = (F.col(split) == TRAIN) & F.col(key).isin(list(ids))
    return keep_rows(table, ~hit)


def violations(df: DataFrame, bad: Column) -> DataFrame:
    return df.where(bad)


def fail_if_found(df: DataFrame, bad: Column, show: int = 5) -> None:
    """Raise if any row matches; the job stops after the first few hits."""
    found = df.where(bad).limit(show).collect()
    if found:
        raise ValueError(f"found rows that match {bad}: {found}")


# --- sets


def union_splits(train: DataFrame, test: DataFrame) -> DataFrame:
    return train.unionByName(test, allowMissingColumns=True)


def levels_union(table: FeatureTable, columns: Sequence[str]) -> DataFrame:
    """Distinct non-null values per column over both splits."""
    long = long_form(table.df, [], columns, "string")
    return long.where("value IS NOT NULL").distinct()


def column_difference(left: DataFrame, right: DataFrame) -> dict[str, list[str]]:
    a, b = set(left.columns), set(right.columns)
    return {"only_left": sorted(a - b), "only_right": sorted(b - a)}


def cell_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """(side, column, type, value, n) of cells that one table has more often than the other.

    Values are compared as text within a column name and type; nulls are equal.  Both tables are
    counted in one shuffle, of one row per task and distinct cell.
    """

    def cells(df: DataFrame, sign: int) -> DataFrame:
        parts = [
            F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col(f"`{c}`").cast("string").alias("value"))
            for c, t in df.dtypes
        ]
        return df.select(F.inline(F.array(*parts)), F.lit(sign).cast("bigint").alias("n"))

    both = cells(left, 1).unionAll(cells(right, -1)).groupBy("column", "type", "value")
    net = both.agg(F.sum("n").alias("n")).where("n <> 0")
    side = F.when(F.col("n") > 0, "only_left").otherwise("only_right")
    return net.select(side.alias("side"), "column", "type", "value", F.abs("n").alias("n"))
