"""Categorical encoders: declared levels drive one-hot and ordinal codes, the target drives
the statistics encoders."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from plumbline.operators.columns import long_form
from plumbline.plans.dictionary import LITERAL_LEVELS, dictionary, wider_than, with_codes
from plumbline.plans.quantiles import column_quantiles, group_quantiles
from plumbline.plans.storage import BROADCAST_ROWS, SMALL_ROWS, lookup_join, materialize
from plumbline.spec import CATEGORICAL, ColumnSpec, safe_name
from plumbline.table import TRAIN, FeatureTable

# --- levels


def infer_levels(table: FeatureTable, columns: Sequence[str]) -> dict[str, tuple[str, ...]]:
    """Sorted distinct values per column over both splits.

    The levels become part of the schema, so they are gathered on the driver, however many.
    """
    if not columns:
        return {}
    pairs = long_form(table.df, [], columns, "string").where("value IS NOT NULL").distinct()
    found: dict[str, list[str]] = {c: [] for c in columns}
    for r in pairs.toLocalIterator():
        found[r["column"]].append(r["value"])
    return {c: tuple(sorted(v)) for c, v in found.items()}


def declared_levels(
    table: FeatureTable, columns: Sequence[str], limit: int = LITERAL_LEVELS
) -> dict[str, tuple[str, ...]]:
    """Sorted distinct values of the columns that have at most ``limit``; none for the others.

    A column without declared levels takes its codes from a joined table (``label_encode``).
    """
    if not columns:
        return {}
    levels = dictionary(table.df, columns)
    wide = wider_than(levels, limit)
    few = [c for c in columns if c not in wide]
    found: dict[str, list[str]] = {c: [] for c in columns}
    for r in levels.where(F.col("column").isin(few)).collect():
        found[r["column"]].append(r["level"])
    return {c: tuple(sorted(v)) for c, v in found.items()}


def to_categorical(table: FeatureTable, column: str, levels: Sequence[str] | None = None):
    """Cast a number to text and declare its levels, by default those found in the data, if few."""
    out = table.with_columns({column: F.col(column).cast("string")})
    levels = tuple(levels) if levels is not None else declared_levels(out, [column])[column]
    return replace(out, spec=table.spec.with_column(column, ColumnSpec(CATEGORICAL, levels)))


def to_numeric(table: FeatureTable, column: str) -> FeatureTable:
    return table.with_numeric({column: F.col(column).try_cast("double")})


# --- one-hot


def one_hot_levels(
    table: FeatureTable,
    columns: Sequence[str] | None = None,
    strict: bool = True,
) -> FeatureTable:
    """One 0/1 column per declared level but the first; null and undeclared values are all 0.

    Columns that are constant over the train rows are left out.  With ``strict``, a source
    column that yields nothing is an error.
    """
    columns = list(columns if columns is not None else table.categorical)
    dummies: dict[str, tuple[str, Column]] = {}
    for c in columns:
        for level in table.spec[c].categories[1:]:
            hit = F.coalesce(F.col(c) == F.lit(level), F.lit(False)).cast("int")
            dummies[safe_name(f"{c}_{level}")] = (c, hit)
    if dummies:
        spread = table.train.agg(
            *[(F.max(e) != F.min(e)).alias(n) for n, (_, e) in dummies.items()]
        ).first()
        dummies = {n: d for n, d in dummies.items() if spread[n]}
    empty = set(columns) - {c for c, _ in dummies.values()}
    if empty and strict:
        raise ValueError(f"one-hot encoding leaves nothing of {sorted(empty)}")
    kept = [c for c in table.df.columns if c not in columns]
    df = table.df.select(*kept, *[e.alias(n) for n, (_, e) in dummies.items()])
    spec = table.spec.without(*columns).with_numeric(dummies)
    return replace(table, df=df, spec=spec)


# --- ordinal codes


def ordinal_code(column: Column, levels: Sequence[str]) -> Column:
    """Position among the levels as a double; null for other values."""
    at = F.array_position(F.array(*map(F.lit, levels)), column)
    return F.when(at > 0, (at - 1).cast("double"))


def label_encode(
    table: FeatureTable, columns: Sequence[str] | None = None, fail_on_unseen: bool = True
) -> FeatureTable | None:
    """Replace categories by their position among the declared levels.

    The levels of a column that declares none are its values in both splits, in text order; they
    are ranked and joined as a table, however many.  Values outside the levels, null included, are
    an error or become null.  None if a column has a single code over the train rows.
    """
    columns = list(columns if columns is not None else table.categorical)
    open_ = [c for c in columns if not table.spec[c].categories]
    if open_:
        table = table.with_df(materialize(with_codes(table.df, open_, dictionary(table.df, open_))))
    codes = {
        c: F.col(f"__code_{c}") if c in open_ else ordinal_code(F.col(c), table.spec[c].categories)
        for c in columns
    }
    is_train = F.col(table.spec.split) == TRAIN
    facts = table.df.agg(
        *[F.count_if(e.isNull()).alias(f"bad_{c}") for c, e in codes.items()],
        *[F.max(F.when(is_train, e)).alias(f"hi_{c}") for c, e in codes.items()],
        *[F.min(F.when(is_train, e)).alias(f"lo_{c}") for c, e in codes.items()],
    ).first()
    wrong = {c: facts[f"bad_{c}"] for c in columns if facts[f"bad_{c}"]}
    if wrong and fail_on_unseen:
        raise ValueError(f"values outside the declared levels: {wrong}")
    if any(facts[f"hi_{c}"] == facts[f"lo_{c}"] for c in columns):
        return None
    out = table.with_numeric(codes)
    return out.with_df(out.df.drop(*[f"__code_{c}" for c in open_]))


# --- statistics of the target


def _with_stats(
    table: FeatureTable, column: str, stats: DataFrame, default: float, keep: bool
) -> FeatureTable:
    """Join per-category values; categories without one get the default."""
    stats = stats.select(F.col(column).alias("__key"), F.col("__stat"))
    joined = lookup_join(table.df, stats, F.col(column) == F.col("__key"), "left")
    value = F.coalesce(F.col("__stat"), F.lit(default))
    name = f"{column}_enc" if keep else column
    df = joined.withColumn(name, value).drop("__key", "__stat")
    return replace(table, df=df, spec=table.spec.with_numeric([name]))


def target_aggregate(
    table: FeatureTable, column: str, build: Callable[[Column], Column], keep: bool = False
) -> FeatureTable:
    """Replace categories by an aggregate of the train target.

    ``build`` makes the aggregate from the target column.  Categories without train rows get the
    aggregate over all train rows.
    """
    y = F.col(table.spec.target)
    stats = table.train.groupBy(column).agg(build(y).alias("__stat"))
    default = table.train.agg(build(y).cast("double")).first()[0]
    return _with_stats(table, column, stats, default, keep)


def target_mean(
    table: FeatureTable, column: str, keep: bool = False, folds: Column | None = None
) -> FeatureTable:
    """Train mean per category.  With ``folds``, a train row does not see its own fold."""
    if folds is None:
        return target_aggregate(table, column, F.avg, keep)
    spec = table.spec
    y = F.col(spec.target)
    default = table.train.agg(F.avg(y)).first()[0]
    per_fold = (
        table.train.withColumn("__fold", folds)
        .groupBy(F.col(column).alias("__key"), "__fold")
        .agg(F.sum(y).alias("__s"), F.count(y).alias("__n"))
    )
    # one row per category: its fold totals as a map, no longer than the number of folds
    stats = per_fold.groupBy("__key").agg(
        F.sum("__s").alias("__ts"),
        F.sum("__n").alias("__tn"),
        F.map_from_entries(
            F.collect_list(F.struct("__fold", F.struct("__s", "__n")))
        ).alias("__by"),
    )
    joined = lookup_join(table.df, stats, F.col(column) == F.col("__key"), "left")
    own = F.when(F.col(spec.split) == "train", F.col("__by")[folds])
    s = F.col("__ts") - F.coalesce(own["__s"], F.lit(0.0))
    n = F.col("__tn") - F.coalesce(own["__n"], F.lit(0))
    name = f"{column}_enc" if keep else column
    df = joined.withColumn(name, F.coalesce(F.try_divide(s, n), F.lit(default)))
    df = df.drop("__key", "__ts", "__tn", "__by")
    return replace(table, df=df, spec=spec.with_numeric([name]))


def target_median(
    table: FeatureTable,
    column: str,
    keep: bool = False,
    small: int = SMALL_ROWS,
    approx: bool = False,
) -> FeatureTable:
    """Train median per category, exact unless told otherwise."""
    t = table.spec.target
    medians = group_quantiles(table.train, [column], t, [0.5], small, approx)
    stats = medians.select(column, F.col("q")[0].alias("__stat"))
    default = column_quantiles(table.train, {t: [0.5]}, small, approx=approx)[t][0]
    return _with_stats(table, column, stats, default, keep)


def category_stats(
    table: FeatureTable, columns: Sequence[str], small: int = SMALL_ROWS
) -> DataFrame:
    """(column, value, mean, median) of the train target per category of several columns."""
    t = table.spec.target
    long = long_form(table.train, [t], columns, "string").where("value IS NOT NULL")
    keys = ["column", "value"]
    means = long.groupBy(*keys).agg(F.avg(t).alias("mean"))
    medians = group_quantiles(long, keys, t, [0.5], small)
    return means.join(medians.select(*keys, F.col("q")[0].alias("median")), keys)


def target_stats_all(
    table: FeatureTable,
    columns: Sequence[str] | None = None,
    stat: str = "mean",
    small: int = SMALL_ROWS,
) -> FeatureTable:
    """Replace several categorical columns by the mean or median target of each category.

    All statistics come from one grouped pass.  Columns with many categories are joined.
    """
    columns = list(columns if columns is not None else table.categorical)
    t = table.spec.target
    if stat == "mean":
        default = table.train.agg(F.avg(t)).first()[0]
    else:
        default = column_quantiles(table.train, {t: [0.5]}, small)[t][0]
    joined, stats = stat_columns(table, columns, small)
    new = {c: F.coalesce(stats[c, stat], F.lit(default)) for c in columns}
    out = joined.with_numeric(new)
    return out.with_df(out.df.select(*table.df.columns))


def stat_columns(
    table: FeatureTable, columns: Sequence[str], small: int = SMALL_ROWS
) -> tuple[FeatureTable, dict[tuple[str, str], Column]]:
    """A table and, by (column, mean or median), the statistic of each row's category.

    The statistics are written once.  Those of columns with few categories become part of the
    expressions; the others stay in the table and are joined as columns of the table returned.
    Categories without train rows have null.
    """
    stats = materialize(category_stats(table, columns, small))
    sizes = {r["column"]: r["count"] for r in stats.groupBy("column").count().collect()}
    few = [c for c in columns if sizes.get(c, 0) <= LITERAL_LEVELS]
    found = stats.where(F.col("column").isin(few)).collect()
    made = {(c, k): stat_lookup(found, c, k, None) for c in few for k in ("mean", "median")}
    df = table.df
    for c in columns:
        if c not in few:
            names = {k: f"__{k}_{c}" for k in ("mean", "median")}
            own = stats.where(F.col("column") == c).select(
                F.col("value").alias("__key"), *[F.col(k).alias(n) for k, n in names.items()]
            )
            own = F.broadcast(own) if sizes[c] <= BROADCAST_ROWS else own
            df = df.join(own, F.col(c) == F.col("__key"), "left").drop("__key")
            made |= {(c, k): F.col(n) for k, n in names.items()}
    return table.with_df(df), made


def stat_lookup(stats: Sequence[Row], column: str, stat: str, default: float | None) -> Column:
    """The category's statistic from collected (column, value, mean, median) rows."""
    pairs = [x for r in stats if r["column"] == column for x in (r["value"], r[stat])]
    if not pairs:
        return F.lit(default).cast("double")
    value = F.try_element_at(F.create_map(*map(F.lit, pairs)), F.col(column))
    return value if default is None else F.coalesce(value, F.lit(default))


def target_moments(
    table: FeatureTable,
    column: str,
    partial: Callable,
    finish: Callable[[Column], Column],
    width: int,
    keep: bool = False,
) -> FeatureTable:
    """Replace categories by a statistic whose state a Python function computes.

    ``partial`` maps a pandas Series of targets to ``width`` numbers that add up across chunks
    of a category; ``finish`` turns the added-up array column into the value.  States are
    computed batch by batch and summed, so no task needs all rows of a category.
    """
    t, train = table.spec.target, table.train
    narrow = train.select(column, F.col(t).cast("double").alias("__y")).where("__y IS NOT NULL")
    kind = dict(narrow.dtypes)[column]

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [
                (key, [float(v) for v in partial(part["__y"])])
                for key, part in pdf.groupby(column, dropna=False, sort=False)
            ]
            out = pd.DataFrame(rows, columns=[column, "state"])
            out[column] = out[column].where(out[column].notna(), None)
            yield out

    states = narrow.mapInPandas(run, f"`{column}` {kind}, state array<double>")
    adders = [F.sum(F.col("state")[i]).alias(f"s{i}") for i in range(width)]
    whole = F.array(*[F.col(f"s{i}") for i in range(width)])
    stats = states.groupBy(column).agg(*adders).select(column, finish(whole).alias("__stat"))
    default = states.agg(*adders).select(finish(whole)).first()[0]
    return _with_stats(table, column, stats, default, keep)


# --- dictionaries


def map_values(
    table: FeatureTable, maps: Mapping[str, Mapping], strict: bool = True
) -> FeatureTable:
    """Map values through a dictionary per column; null stays null, unmapped values raise.

    A long dictionary is joined as a table instead of written into the plan.
    """
    out = {}
    for c, mapping in maps.items():
        if c not in table.df.columns:
            continue
        if len(mapping) > LITERAL_LEVELS:
            kind = table.df.schema[c].dataType.simpleString()
            value = "bigint" if all(isinstance(v, int) for v in mapping.values()) else "double"
            rows = [(k, v if value == "bigint" else float(v)) for k, v in mapping.items()]
            name = f"__map_{c}"
            entries = table.df.sparkSession.createDataFrame(rows, f"__key {kind}, `{name}` {value}")
            joined = table.df.join(entries, F.col(c) == F.col("__key"), "left").drop("__key")
            table, code = replace(table, df=joined), F.col(name)
        else:
            pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
            code = F.try_element_at(pairs, F.col(c))
        if strict:
            text = F.concat(F.lit(f"unmapped value in {c}: "), F.col(c).cast("string"))
            whole = all(isinstance(v, int) for v in mapping.values())
            failed = F.raise_error(text).cast("int" if whole else "double")
            code = F.when(F.col(c).isNotNull() & code.isNull(), failed).otherwise(code)
        out[c] = code
    mapped = table.with_numeric(out)
    return replace(mapped, df=mapped.df.drop(*[f"__map_{c}" for c in out]))
