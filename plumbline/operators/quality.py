"""Quality gates, profiles, out-of-range checks and row rarity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.operators.columns import long_form
from plumbline.plans.prefix import running_sums
from plumbline.plans.storage import SMALL_ROWS, lookup_join, materialize
from plumbline.spec import CATEGORICAL, NUMERIC
from plumbline.table import TRAIN, FeatureTable


def _is_train(table: FeatureTable):
    return F.col(table.spec.split) == TRAIN


def null_counts(table: FeatureTable, columns: Sequence[str] | None = None) -> DataFrame:
    """(split, column, n_null), from one aggregate over the table."""
    columns = list(columns or table.features)
    split = table.spec.split
    wide = table.df.groupBy(split).agg(
        *[F.count_if(F.col(c).isNull()).alias(c) for c in columns]
    )
    return wide.unpivot([split], columns, "column", "n_null")


def null_report(table: FeatureTable, top: int = 6) -> DataFrame:
    """The columns with most nulls of each split."""
    # the window holds one row per column
    window = W.partitionBy(table.spec.split).orderBy(F.desc("n_null"), "column")
    ranked = F.row_number().over(window)
    return null_counts(table).withColumn("rank", ranked).where(F.col("rank") <= top)


def diagnose_nas(table: FeatureTable) -> int:
    """Largest null count of a column: of the train rows, or of the test rows if train has none."""
    worst = {
        r[0]: r[1]
        for r in null_counts(table).groupBy(table.spec.split).agg(F.max("n_null")).collect()
    }
    train = worst.pop(TRAIN, 0)
    return train or max(worst.values(), default=0)


def health_checks(table: FeatureTable) -> DataFrame:
    """(name, ok, detail): columns are declared, ids are present and unique per split."""
    spec = table.spec
    own = {spec.id, spec.target, spec.split}
    undeclared = sorted(c for c in table.df.columns if c not in own and c not in spec.columns)
    missing = sorted(c for c in spec.names() if c not in table.df.columns)
    # ids are counted per id first, so one split never meets in a single task
    per_id = table.df.groupBy(spec.split, spec.id).agg(F.count("*").alias("n"))
    counts = per_id.agg(
        F.coalesce(F.sum(F.when(F.col(spec.id).isNull(), F.col("n"))), F.lit(0)).alias("no_id"),
        F.count_if((F.col("n") > 1) & F.col(spec.id).isNotNull()).alias("repeated"),
    )
    fixed = [
        ("columns_declared", int(not undeclared), ",".join(undeclared)),
        ("columns_present", int(not missing), ",".join(missing)),
    ]
    static = [
        F.struct(F.lit(n).alias("name"), F.lit(ok).alias("ok"), F.lit(d).alias("detail"))
        for n, ok, d in fixed
    ]

    def measured(name, value):
        return F.struct(
            F.lit(name).alias("name"),
            (F.col(value) == 0).cast("int").alias("ok"),
            F.col(value).cast("string").alias("detail"),
        )

    return counts.select(
        F.inline(
            F.array(*static, measured("ids_present", "no_id"), measured("ids_unique", "repeated"))
        )
    )


def readiness_report(table: FeatureTable) -> DataFrame:
    """Health checks plus: no nulls, only numeric features, target and id are no features."""
    spec = table.spec
    nulls = null_counts(table).agg(F.sum("n_null").alias("n"))
    no_nulls = nulls.select(
        F.lit("no_nulls").alias("name"),
        (F.col("n") == 0).cast("int").alias("ok"),
        F.col("n").cast("string").alias("detail"),
    )
    types = dict(table.df.dtypes)
    text = [
        c
        for c in table.features
        if spec[c].type != NUMERIC or types[c] not in ("double", "float", "int", "bigint")
    ]
    leaks = [c for c in table.features if c in (spec.id, spec.target)]
    fixed = [
        ("all_numeric", int(not text), ",".join(sorted(text))),
        ("target_and_id_apart", int(not leaks), ",".join(leaks)),
    ]
    static = no_nulls.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(n).alias("name"), F.lit(ok).alias("ok"), F.lit(d).alias("detail"))
                    for n, ok, d in fixed
                ]
            )
        )
    )
    return health_checks(table).unionByName(no_nulls).unionByName(static)


def require_ready(table: FeatureTable) -> FeatureTable:
    failed = readiness_report(table).where("ok = 0").collect()
    if failed:
        raise ValueError("; ".join(f"{r['name']}: {r['detail']}" for r in failed))
    return table


def require_numeric(table: FeatureTable) -> FeatureTable:
    if table.categorical:
        raise ValueError(f"not numeric: {table.categorical}")
    return table


def value_hits(table: FeatureTable, value: float, columns: Sequence[str] | None = None) -> DataFrame:
    """(split, column, n_hits): cells equal to a value; NaN and infinities can be asked for."""
    columns = list(columns or table.numeric)
    split = table.spec.split
    wide = table.df.groupBy(split).agg(
        *[F.count_if(F.col(c) == F.lit(float(value))).alias(c) for c in columns]
    )
    return wide.unpivot([split], columns, "column", "n_hits")


def has_nan(table: FeatureTable) -> bool:
    hit = [F.bool_or(F.coalesce(F.isnan(c), F.lit(False))) for c in table.numeric]
    found = F.lit(False)
    for h in hit:
        found = found | h
    return bool(table.df.agg(found).first()[0])


def incomplete(table: FeatureTable) -> Column:
    """Whether a row has a null feature, or is a train row with a null target."""
    bad = _is_train(table) & F.col(table.spec.target).isNull()
    for c in table.features:
        bad = bad | F.col(c).isNull()
    return bad


def sanity_counts(table: FeatureTable) -> DataFrame:
    """Per split: rows, incomplete rows, and rows with a NaN among their numbers, in one aggregate."""
    nan = F.lit(False)
    for c in table.numeric:
        nan = nan | F.coalesce(F.isnan(c), F.lit(False))
    return table.df.groupBy(table.spec.split).agg(
        F.count("*").alias("n_rows"),
        F.count_if(incomplete(table)).alias("n_incomplete"),
        F.count_if(nan).alias("n_nan"),
    )


def sanity_rows(table: FeatureTable, show: int = 5) -> DataFrame:
    """A few rows with a null feature, or train rows with a null target."""
    return table.df.where(incomplete(table)).limit(show)


def unseen_categories(table: FeatureTable, columns: Sequence[str] | None = None) -> DataFrame:
    """(id, column, value) of test cells whose category no train row has."""
    columns = list(columns or table.categorical)
    long = long_form(table.test, [table.spec.id], columns, "string")
    seen = long_form(table.train, [], columns, "string").distinct()
    s = seen.select(F.col("column").alias("s_column"), F.col("value").alias("s_value"))
    match = (F.col("column") == F.col("s_column")) & F.col("value").eqNullSafe(F.col("s_value"))
    return lookup_join(long, s, match, "left_anti")


def train_ranges(table: FeatureTable, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    row = table.train.agg(
        *[F.min(c).alias(f"lo_{c}") for c in columns],
        *[F.max(c).alias(f"hi_{c}") for c in columns],
    ).first()
    return {c: (row[f"lo_{c}"], row[f"hi_{c}"]) for c in columns}


def out_of_range(table: FeatureTable, columns: Sequence[str] | None = None) -> DataFrame:
    """(id, column, value, lo, hi) of test cells outside the train range."""
    columns = list(columns or table.numeric)
    ranges = train_ranges(table, columns)
    cells = []
    for c in columns:
        lo, hi = (F.lit(v).cast("double") for v in ranges[c])
        value = F.col(c).cast("double")
        cells.append(
            F.struct(
                F.lit(c).alias("column"), value.alias("value"), lo.alias("lo"), hi.alias("hi")
            )
        )
    long = table.test.select(table.spec.id, F.inline(F.array(*cells)))
    return long.where((F.col("value") < F.col("lo")) | (F.col("value") > F.col("hi")))


def value_counts(table: FeatureTable, column: str) -> DataFrame:
    return table.df.groupBy(table.spec.split, column).agg(F.count("*").alias("n"))


def _is_number(kind: str) -> bool:
    return kind in ("double", "float", "int", "bigint", "smallint", "tinyint") or "decimal" in kind


def cell_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, is_null, n): one row per distinct value of each column.

    Values are counted after a shuffle on (column, value), so neither a column with many values
    nor a value with many rows lands in one task.
    """
    types = dict(df.dtypes)
    numbers = [c for c in columns if _is_number(types[c])]
    texts = [c for c in columns if c not in numbers]
    out = None
    for names, kind in ((numbers, "double"), (texts, "string")):
        if names:
            part = long_form(df, [], names, kind).groupBy("column", "value")
            part = part.agg(F.count("*").alias("n")).select(
                "column", F.col("value").isNull().alias("is_null"), "n"
            )
            out = part if out is None else out.unionByName(part)
    return out


def profile(
    df: DataFrame, columns: Sequence[str], binary: bool = True, approx: bool = False
) -> DataFrame:
    """(column, n_distinct, has_null, type) of each column.

    ``approx`` estimates the distinct counts in one aggregate, without a shuffle of values.
    """
    types = dict(df.dtypes)
    declared = F.when(
        F.col("column").isin([c for c in columns if _is_number(types[c])]), NUMERIC
    ).otherwise(CATEGORICAL)
    if approx:
        facts = [
            F.struct(
                F.lit(c).alias("column"),
                F.approx_count_distinct(c, 0.01).alias("n_distinct"),
                F.max(F.col(c).isNull().cast("int")).alias("has_null"),
            )
            for c in columns
        ]
        out = df.agg(F.array(*facts).alias("f")).select(F.inline("f"))
    else:
        out = cell_counts(df, columns).groupBy("column").agg(
            F.count_if(~F.col("is_null")).alias("n_distinct"),
            F.max(F.col("is_null").cast("int")).alias("has_null"),
        )
    two = (F.col("n_distinct") == 2) & F.lit(binary) & (declared == CATEGORICAL)
    return out.withColumn("type", F.when(two, "BINARY").otherwise(declared))


def mode_count(table: FeatureTable, columns: Sequence[str]) -> DataFrame:
    """(column, mode_n): how many train rows hold the most frequent value."""
    counts = cell_counts(table.train, columns).where("NOT is_null")
    return counts.groupBy("column").agg(F.max("n").alias("mode_n"))


def row_rarity(
    table: FeatureTable,
    max_categorical_pct: int = 5,
    max_numeric_pct: int = 5,
    rows: DataFrame | None = None,
    small: int = SMALL_ROWS,
) -> DataFrame:
    """Rare cells of train rows: (id, column, value, kind, pct, n).

    ``kind`` is ``top`` or ``bottom`` for numbers that are rare and extreme, and ``matches`` for
    rare categories.  Percentages are truncated.  ``rows`` (a frame of ids) restricts the report,
    not the statistics.
    """
    key = table.spec.id
    total = table.train.count()
    pct = (F.col("n") * 100 / F.lit(max(total, 1))).cast("bigint")
    picked = table.train
    if rows is not None:
        picked = lookup_join(picked, rows.select(key).distinct(), key, "left_semi")
    reports = []
    if table.numeric:
        cells = long_form(table.train, [], table.numeric, "double").where("value IS NOT NULL")
        # written once: it is read for the totals, the running counts and the size checks
        counts = materialize(cells.groupBy("column", "value").agg(F.count("*").alias("n_match")))
        sizes = counts.groupBy("column").agg(F.sum("n_match").alias("n_all"))
        upto = running_sums(counts, ["column"], ["value"], {"n_below": F.col("n_match")}, small)
        stats = upto.join(F.broadcast(sizes), "column").withColumn(
            "n_above", F.col("n_all") - F.col("n_below") + F.col("n_match")
        )
        limit = F.lit(max_numeric_pct)
        whole = F.lit(max(total, 1))
        rare = (F.col("n_match") * 100 / whole).cast("bigint") <= limit
        ends = F.filter(
            F.array(
                F.struct(F.lit("top").alias("kind"), F.col("n_above").alias("n")),
                F.struct(F.lit("bottom").alias("kind"), F.col("n_below").alias("n")),
            ),
            lambda e: (e["n"] * 100 / whole).cast("bigint") <= limit,
        )
        extreme = stats.where(rare).select("column", "value", F.inline(ends))
        # reported values lie beyond one cut per column and end, so the bulk of the rows, and
        # any frequent value with them, never reaches the join
        beyond = F.lit(False)
        for r in extreme.groupBy("column", "kind").agg(
            F.min("value").alias("lo"), F.max("value").alias("hi")
        ).collect():
            cut = F.col("value") >= r["lo"] if r["kind"] == "top" else F.col("value") <= r["hi"]
            beyond = beyond | ((F.col("column") == r["column"]) & cut)
        mine = long_form(picked, [key], table.numeric, "double").where(beyond)
        hits = lookup_join(mine, extreme, ["column", "value"], "inner")
        reports.append(
            hits.select(key, "column", F.col("value").cast("string"), "kind", pct.alias("pct"), "n")
        )
    if table.categorical:
        cells = long_form(table.train, [], table.categorical, "string").where("value IS NOT NULL")
        rare = (
            cells.groupBy("column", "value")
            .agg(F.count("*").alias("n"))
            .where(pct <= max_categorical_pct)
        )
        mine = long_form(picked, [key], table.categorical, "string")
        hits = lookup_join(mine, rare, ["column", "value"], "inner")
        reports.append(
            hits.select(key, "column", "value", F.lit("matches").alias("kind"), pct.alias("pct"), "n")
        )
    out = reports[0]
    for more in reports[1:]:
        out = out.unionByName(more)
    return out


def rarity_lines(report: DataFrame) -> DataFrame:
    """The rarity report with a ``line`` of text per cell."""
    place = F.when(F.col("kind") == "matches", F.lit("matches")).otherwise(
        F.concat(F.lit("is in the "), F.col("kind"))
    )
    line = F.format_string(
        "Column %s = %s %s %d %% of the train set ( %d )",
        F.col("column"), F.col("value"), place, F.col("pct"), F.col("n"),
    )
    return report.withColumn("line", line)
