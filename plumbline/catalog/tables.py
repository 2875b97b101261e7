"""Queries on loading, columns, rows, sets and quality checks."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from plumbline.catalog.registry import on_sales, on_time_split_sales, query
from plumbline.operators import columns as cols
from plumbline.operators import quality as qual
from plumbline.operators.encode import map_values, to_numeric
from plumbline.operators.joins import complete_range
from plumbline.plans.storage import checkpoint_dir
from plumbline.sources import io
from plumbline.sources.tables import SALES_COLUMNS, read, sales, time_split
from plumbline.table import FeatureTable

NUMBERS = ("acctbal", "n_lines", "sum_qty", "avg_disc", "yr_sold", "mo_sold")
TEXTS = ("status", "priority", "segment", "nation", "region", "flag")


def r4(column, name: str | None = None):
    """Rounded to the precision the check SQL uses."""
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c, 4).alias(name or column)


def union_all(branches) -> str:
    return "\nUNION ALL\n".join(branches)


@query(
    "load_pair",
    on_sales(
        """SELECT id, CASE WHEN split = 'train' THEN target END AS target, status, priority,
        segment, region, acctbal, flag, split FROM sales"""
    ),
)
def load_pair(spark, folder):
    table = sales(spark, folder, ("status", "priority", "segment", "region", "acctbal", "flag"))
    paired = FeatureTable.from_pair(
        table.train.drop("split"), table.test.drop("split", "target"), table.spec
    )
    return paired.df.select(
        "id", "target", "status", "priority", "segment", "region", "acctbal", "flag", "split"
    )


@query(
    "select_numeric",
    on_sales(
        """SELECT id, target, acctbal, n_lines, sum_qty, round(avg_disc, 9) AS avg_disc,
        yr_sold, mo_sold, split FROM sales"""
    ),
)
def select_numeric(spark, folder):
    df = cols.select_type(sales(spark, folder), "NUMERIC").df
    return df.withColumn("avg_disc", F.round("avg_disc", 9))


@query(
    "retain_columns",
    on_sales("SELECT id, target, status, acctbal, split FROM sales"),
)
def retain_columns(spark, folder):
    return cols.retain_columns(sales(spark, folder), ["status", "acctbal", "no_such_column"]).df


@query(
    "constant_columns",
    on_sales(
        union_all(
            f"""SELECT '{c}' AS column_name, CASE WHEN count(DISTINCT {c}) = 1
            AND count({c}) = count(*) THEN 1 ELSE 0 END AS is_constant
            FROM (SELECT *, nation IS NULL AS placed FROM sales) WHERE split = 'train'"""
            for c in (*SALES_COLUMNS, "placed")
        )
    ),
)
def constant_columns(spark, folder):
    table = sales(spark, folder).with_numeric({"placed": F.col("nation").isNull().cast("int")})
    out = cols.constant_columns(table)
    return out.withColumnRenamed("column", "column_name")


@query(
    "rename",
    """SELECT o_orderkey AS "Id", o_totalprice AS "SalePrice", o_orderstatus AS "FirstFlrSF",
    o_orderpriority AS "a_b_c" FROM orders""",
)
def rename(spark, folder):
    """Rename by map, then make unsafe names safe."""
    df = read(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_totalprice").alias("target"),
        F.col("o_orderstatus").alias("1stFlrSF"),
        F.col("o_orderpriority").alias("a.b[c"),
        F.lit("train").alias("split"),
    )
    from plumbline.spec import SchemaSpec

    table = FeatureTable(df, SchemaSpec("id", "target"))
    names = {"id": "Id", "target": "SalePrice", "1stFlrSF": "FirstFlrSF"}
    return cols.sanitize_names(cols.rename_columns(table, names)).df.drop("split")


@query(
    "explode_types",
    on_sales(
        """SELECT id, status, priority, n_lines, mo_sold,
        CASE WHEN n_lines IS NOT NULL THEN CAST(CAST(n_lines AS INT) AS VARCHAR) || '.0' END
          AS n_lines_categorical,
        CAST(CAST(mo_sold AS INT) AS VARCHAR) || '.0' AS mo_sold_categorical,
        CAST(CAST(substr(priority, 1, 1) AS INT) - 1 AS DOUBLE) AS priority_numerical
        FROM sales"""
    ),
)
def explode_types(spark, folder):
    table = sales(spark, folder, ("status", "priority", "n_lines", "mo_sold"))
    return cols.explode_types(table).df.drop("target", "split")


@query(
    "non_null_columns",
    on_sales(
        "SELECT * FROM ("
        + union_all(
            f"""SELECT '{c}' AS column_name, CAST(count(*) - count({c}) AS BIGINT) AS n_null
            FROM sales"""
            for c in SALES_COLUMNS
        )
        + ") WHERE n_null = 0"
    ),
)
def non_null_columns(spark, folder):
    df = sales(spark, folder).df.select(*SALES_COLUMNS)
    return cols.non_null_columns(df).withColumnRenamed("column", "column_name")


@query(
    "summary",
    on_sales(
        f"""SELECT count(*) AS n_rows, CAST({len(SALES_COLUMNS)} AS BIGINT) AS n_columns,
        '{",".join(sorted(SALES_COLUMNS))}' AS columns FROM sales WHERE split = 'train'"""
    ),
)
def summary(spark, folder):
    return cols.summary(sales(spark, folder))


@query(
    "filter_not_value",
    on_sales(
        """SELECT id, flag, split FROM sales
        WHERE NOT (split = 'train' AND flag IS NOT DISTINCT FROM 'R')"""
    ),
)
def filter_not_value(spark, folder):
    table = sales(spark, folder, ("flag",))
    return cols.filter_not_value(table, "flag", "R").df.select("id", "flag", "split")


@query(
    "drop_rows",
    on_sales(
        """SELECT id, target, split FROM sales s WHERE NOT (split = 'train' AND EXISTS (
        SELECT 1 FROM lineitem l WHERE l.l_orderkey = s.id AND l.l_quantity >= 50))"""
    ),
)
def drop_rows(spark, folder):
    """Remove the train rows whose ids another table names."""
    table = sales(spark, folder, ())
    big = read(spark, folder, "lineitem").where("l_quantity >= 50")
    return cols.drop_rows(table, big.select(F.col("l_orderkey").alias("id"))).df


@query(
    "range_violations",
    on_sales("SELECT id, acctbal FROM sales WHERE acctbal > 9000 OR acctbal < -900"),
)
def range_violations(spark, folder):
    df = sales(spark, folder, ("acctbal",)).df
    bad = (F.col("acctbal") > 9000) | (F.col("acctbal") < -900)
    return cols.violations(df, bad).select("id", "acctbal")


CHECKS_SQL = """
SELECT 'columns_declared' AS name, 1 AS ok, '' AS detail
UNION ALL SELECT 'columns_present', 1, ''
UNION ALL SELECT 'ids_present', CASE WHEN count(*) = count(id) THEN 1 ELSE 0 END,
  CAST(count(*) - count(id) AS VARCHAR) FROM sales
UNION ALL SELECT 'ids_unique', CASE WHEN count(*) = 0 THEN 1 ELSE 0 END,
  CAST(count(*) AS VARCHAR)
  FROM (SELECT split, id FROM sales WHERE id IS NOT NULL GROUP BY split, id HAVING count(*) > 1)
"""


@query("health_check", on_sales(CHECKS_SQL))
def health_check(spark, folder):
    return qual.health_checks(sales(spark, folder))


@query(
    "readiness_report",
    on_sales(
        CHECKS_SQL
        + """UNION ALL SELECT 'no_nulls', CASE WHEN n = 0 THEN 1 ELSE 0 END, CAST(n AS VARCHAR)
        FROM (SELECT CAST(sum("""
        + " + ".join(f"(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)" for c in SALES_COLUMNS)
        + f""") AS BIGINT) AS n FROM sales)
        UNION ALL SELECT 'all_numeric', 0, '{",".join(sorted(TEXTS))}'
        UNION ALL SELECT 'target_and_id_apart', 1, ''"""
    ),
)
def readiness_report(spark, folder):
    return qual.readiness_report(sales(spark, folder))


NULLS_SQL = union_all(
    f"""SELECT split, '{c}' AS column_name, CAST(count(*) - count({c}) AS BIGINT) AS n_null
    FROM sales GROUP BY split"""
    for c in SALES_COLUMNS
)


@query(
    "null_report",
    on_sales(
        f"""SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY split
        ORDER BY n_null DESC, column_name) AS INT) AS rank FROM ({NULLS_SQL})) WHERE rank <= 6"""
    ),
)
def null_report(spark, folder):
    out = qual.null_report(sales(spark, folder))
    return out.withColumnRenamed("column", "column_name")


@query(
    "value_hits",
    on_sales(
        union_all(
            f"""SELECT split, '{c}' AS column_name,
            CAST(count(*) FILTER ({c} = 4) AS BIGINT) AS n_hits FROM sales GROUP BY split"""
            for c in NUMBERS
        )
    ),
)
def value_hits(spark, folder):
    out = qual.value_hits(sales(spark, folder, NUMBERS), 4)
    return out.withColumnRenamed("column", "column_name")


TIME_TEXTS = ("status", "priority", "flag", "nation")


@query(
    "unseen_categories",
    on_time_split_sales(
        """SELECT t.id, t.column_name, t.value FROM cells t
        LEFT JOIN (SELECT DISTINCT column_name, coalesce(value, '<null>') AS value, 1 AS seen
          FROM cells WHERE split = 'train') s
        ON s.column_name = t.column_name AND s.value = coalesce(t.value, '<null>')
        WHERE t.split = 'test' AND s.seen IS NULL""",
        """wide AS (SELECT id, split, status, priority, flag, nation,
          CASE WHEN yr_sold IS NOT NULL THEN 'Y' || CAST(CAST(yr_sold AS INT) AS VARCHAR) END
          AS yr FROM sales), cells AS ("""
        + union_all(
            f"SELECT id, split, '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM wide"
            for c in (*TIME_TEXTS, "yr")
        )
        + ")",
    ),
)
def unseen_categories(spark, folder):
    table = sales(spark, folder, (*TIME_TEXTS, "yr_sold"), time_split())
    year = F.concat(F.lit("Y"), F.col("yr_sold").cast("int").cast("string"))
    table = table.with_columns({"yr": year})
    return qual.unseen_categories(table, [*TIME_TEXTS, "yr"]).withColumnRenamed(
        "column", "column_name"
    )


RANGE_COLUMNS = ("acctbal", "n_lines", "sum_qty", "avg_disc", "yr_sold", "mo_sold")


@query(
    "out_of_range",
    on_time_split_sales(
        union_all(
            f"""SELECT id, '{c}' AS column_name, round({c}, 4) AS value, round(lo, 4) AS lo,
            round(hi, 4) AS hi FROM sales, (SELECT min({c}) AS lo, max({c}) AS hi FROM sales
            WHERE split = 'train') WHERE split = 'test' AND ({c} < lo OR {c} > hi)"""
            for c in RANGE_COLUMNS
        )
    ),
)
def out_of_range(spark, folder):
    out = qual.out_of_range(sales(spark, folder, RANGE_COLUMNS, time_split()), RANGE_COLUMNS)
    return out.select(
        "id", F.col("column").alias("column_name"), r4("value"), r4("lo"), r4("hi")
    )


@query(
    "value_counts",
    on_sales("SELECT split, priority, count(*) AS n FROM sales GROUP BY split, priority"),
)
def value_counts(spark, folder):
    return qual.value_counts(sales(spark, folder, ("priority",)), "priority")


PROFILED = ("status", "priority", "segment", "region", "flag", "acctbal", "n_lines", "mo_sold")


def profile_sql(columns=PROFILED) -> str:
    return union_all(
        f"""SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_distinct,
        CASE WHEN count(*) > count({c}) THEN 1 ELSE 0 END AS has_null,
        '{"NUMERIC" if c in NUMBERS else "CATEGORICAL"}' AS type FROM sales"""
        for c in columns
    )


@query("profile", on_sales(profile_sql()))
def profile(spark, folder):
    out = qual.profile(sales(spark, folder, PROFILED).df, PROFILED)
    return out.withColumnRenamed("column", "column_name")


@query(
    "mode_count",
    on_sales(
        union_all(
            f"""SELECT '{c}' AS column_name, max(n) AS mode_n FROM (SELECT count(*) AS n
            FROM sales WHERE split = 'train' AND {c} IS NOT NULL GROUP BY {c})"""
            for c in ("status", "priority", "flag", "n_lines", "acctbal")
        )
    ),
)
def mode_count(spark, folder):
    names = ("status", "priority", "flag", "n_lines", "acctbal")
    out = qual.mode_count(sales(spark, folder, names), names)
    return out.withColumnRenamed("column", "column_name")


RARE_NUMBERS = ("acctbal", "n_lines", "sum_qty")


def rare_numbers_sql(columns, train: str) -> str:
    """Rare and extreme numbers of the rows of a subquery."""
    return union_all(
        f"""SELECT id, '{c}' AS column_name, CAST({c} AS DOUBLE) AS value, kind,
        CAST(n * 100 // total AS BIGINT) AS pct, n FROM (
          SELECT id, {c}, total, same, unnest(['top', 'bottom']) AS kind,
            unnest([above, below]) AS n FROM (
            SELECT id, {c}, (SELECT count(*) FROM {train}) AS total,
              count(*) OVER (PARTITION BY {c}) AS same,
              count(*) OVER (ORDER BY {c} DESC) AS above,
              count(*) OVER (ORDER BY {c}) AS below
            FROM {train} WHERE {c} IS NOT NULL))
        WHERE same * 100 // total <= 5 AND n * 100 // total <= 5"""
        for c in columns
    )


@query(
    "row_rarity",
    on_sales(
        rare_numbers_sql(RARE_NUMBERS, "tr")
        + """ UNION ALL
            SELECT id, 'nation', CAST(substr(nation, 8) AS DOUBLE), 'matches',
            CAST(n * 100 // total AS BIGINT), n FROM (
              SELECT id, nation, count(*) OVER (PARTITION BY nation) AS n,
                count(*) OVER () AS total FROM tr)
            WHERE n * 100 // total <= 5""",
        "tr AS (SELECT * FROM sales WHERE split = 'train')",
    ),
)
def row_rarity(spark, folder):
    """Rare cells of every train row; values as numbers, since the engines print them apart."""
    out = qual.row_rarity(sales(spark, folder, (*RARE_NUMBERS, "nation")))
    number = F.regexp_replace("value", "NATION_", "").cast("double")
    return out.select(
        "id", F.col("column").alias("column_name"), number.alias("value"), "kind", "pct", "n"
    )


@query(
    "union_splits",
    on_sales(
        """SELECT id, status, target FROM sales WHERE split = 'train'
        UNION ALL SELECT id, status, NULL FROM sales WHERE split = 'test'"""
    ),
)
def union_splits(spark, folder):
    table = sales(spark, folder, ("status",))
    return cols.union_splits(
        table.train.select("id", "status", "target"), table.test.select("id", "status")
    )


@query(
    "levels_union",
    on_sales(
        union_all(
            f"SELECT DISTINCT '{c}' AS column_name, {c} AS value FROM sales WHERE {c} IS NOT NULL"
            for c in TEXTS
        )
    ),
)
def levels_union(spark, folder):
    out = cols.levels_union(sales(spark, folder, TEXTS), TEXTS)
    return out.withColumnRenamed("column", "column_name")


STATUS_CODES = {"F": 0, "O": 1, "P": 2}


@query(
    "map_values",
    on_sales(
        """SELECT id, CASE status WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 END AS status,
        CASE flag WHEN 'N' THEN 0 WHEN 'A' THEN 1 WHEN 'R' THEN 2 END AS flag FROM sales"""
    ),
)
def map_values_query(spark, folder):
    table = sales(spark, folder, ("status", "flag"))
    maps = {"status": STATUS_CODES, "flag": {"N": 0, "A": 1, "R": 2}}
    return map_values(table, maps).df.select("id", "status", "flag")


@query(
    "complete_range",
    """WITH b AS (SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders),
    p AS (SELECT l_orderkey AS id, sum(l_extendedprice * (1 - 20 * l_discount)) AS v
      FROM lineitem GROUP BY l_orderkey)
    SELECT g.id AS "Id", round(coalesce(CASE WHEN v < 0 THEN 100000 ELSE v END, 100000), 4)
      AS "SalePrice"
    FROM (SELECT unnest(range(lo, hi + 1)) AS id FROM b) g LEFT JOIN p ON p.id = g.id""",
)
def complete_range_query(spark, folder):
    """Every order id gets a value: negative and missing ones the default."""
    ids = read(spark, folder, "orders").agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    value = F.sum(F.col("l_extendedprice") * (1 - 20 * F.col("l_discount")))
    found = (
        read(spark, folder, "lineitem")
        .groupBy(F.col("l_orderkey").alias("Id"))
        .agg(value.alias("SalePrice"))
    )
    out = complete_range(found, "Id", "SalePrice", ids[0], ids[1], 100_000)
    return out.select("Id", r4("SalePrice"))


@query(
    "manifest",
    on_sales(
        "SELECT * FROM (VALUES "
        + ", ".join(
            f"({i}, '{c}', '{'CATEGORICAL' if c in TEXTS else 'NUMERIC'}', "
            f"{int(c == 'id')}, {int(c == 'target')})"
            for i, c in enumerate(("id", "target", *SALES_COLUMNS))
        )
        + ") t(position, attribute_name, attribute_type, is_row_id, is_target)"
    ),
)
def manifest(spark, folder):
    """Column manifest whose types come from the computed profile."""
    table = sales(spark, folder)
    return io.manifest(table, qual.profile(table.df, ("id", "target", *SALES_COLUMNS)))


@query(
    "csv_roundtrip",
    on_sales(
        """SELECT id, CASE WHEN split = 'train' THEN target END AS target, status, acctbal, flag,
        split FROM sales"""
    ),
)
def csv_roundtrip(spark, folder):
    """Write both splits as CSV and read them back by the schema, ids and numbers typed."""
    table = sales(spark, folder, ("status", "acctbal", "flag"))
    path = os.path.join(checkpoint_dir(spark), f"pair-{uuid.uuid4().hex}")
    io.write_csv(table.train.drop("split"), f"{path}/train.csv")
    io.write_csv(table.test.drop("split", "target"), f"{path}/test.csv")
    back = io.load_pair(spark, f"{path}/train.csv", f"{path}/test.csv", table.spec)
    return back.df.select("id", "target", "status", "acctbal", "flag", "split")


@query(
    "save_roundtrip",
    on_sales(
        """SELECT id, CASE WHEN split = 'train' THEN target END AS target, status, acctbal, flag,
        CASE WHEN split = 'train' THEN round(abs(target - acctbal), 4) END AS score, split
        FROM sales"""
    ),
)
def save_roundtrip(spark, folder):
    """Write both splits with row scores and the schema, and read them back."""
    table = sales(spark, folder, ("status", "acctbal", "flag"))
    gap = F.abs(F.col("target") - F.col("acctbal"))
    scores = table.train.select("split", "id", F.round(gap, 4).alias("score"))
    path = os.path.join(checkpoint_dir(spark), f"saved-{uuid.uuid4().hex}")
    io.save(table, path, scores, fmt="parquet")
    return io.load_saved(spark, path).df.select(
        "id", "target", "status", "acctbal", "flag", "score", "split"
    )


# --- column sets and guards, several operators a query


@query(
    "column_shapes",
    on_sales(
        """SELECT id, CASE WHEN split = 'train' THEN target ELSE 7.5 END AS target, acctbal,
        acctbal AS acctbal_copy, TRY_CAST(status AS DOUBLE) AS status_code,
        yr_sold, split
        FROM sales WHERE acctbal >= 0 AND (yr_sold IS NULL OR yr_sold >= 1995)"""
    ),
)
def column_shapes(spark, folder):
    """Copies of a column, a text cast to a number, categories dropped, rows kept by a condition,
    and a constant target for test rows."""
    table = sales(spark, folder, ("acctbal", "status", "segment", "yr_sold"))
    table = cols.keep_rows(
        table, (F.col("acctbal") >= 0) & (F.col("yr_sold").isNull() | (F.col("yr_sold") >= 1995))
    )
    table = cols.duplicate_column(table, "acctbal", "acctbal_copy")
    table = to_numeric(cols.duplicate_column(table, "status", "status_code"), "status_code")
    table = qual.require_numeric(cols.remove_categoricals(table))
    return cols.add_constant_target(table, 7.5).df.select(
        "id", "target", "acctbal", "acctbal_copy", "status_code", "yr_sold", "split"
    )


@query(
    "column_difference",
    on_sales(
        """SELECT CASE WHEN n > 0 THEN 'only_left' ELSE 'only_right' END AS side, column_name, value,
        CAST(abs(n) AS BIGINT) AS n FROM (
          SELECT column_name, value, sum(sign) AS n FROM (
            SELECT 'status' AS column_name, status AS value, 1 AS sign FROM sales
            UNION ALL SELECT 'segment', segment, 1 FROM sales
            UNION ALL SELECT 'status', status, -1 FROM sales WHERE split = 'train'
            UNION ALL SELECT 'flag', flag, -1 FROM sales WHERE split = 'train')
          GROUP BY column_name, value) WHERE n <> 0"""
    ),
)
def column_difference(spark, folder):
    """Cells of two tables that differ in columns and rows, counted per side, column and value."""
    left = sales(spark, folder, ("status", "segment")).df.select("status", "segment")
    right = sales(spark, folder, ("status", "flag")).train.select("status", "flag")
    out = cols.cell_difference(left, right)
    return out.select("side", F.col("column").alias("column_name"), "value", "n")


@query(
    "incomplete_rows",
    on_sales(
        """SELECT split, count(*) AS n_rows, count_if(n_lines IS NULL OR sum_qty IS NULL OR acctbal IS NULL)
        AS n_incomplete, count_if(acctbal < 0) AS n_nan FROM sales GROUP BY split"""
    ),
)
def incomplete_rows(spark, folder):
    """Rows, rows with a missing feature and rows with a NaN, by split; negative balances are made NaN."""
    table = sales(spark, folder, ("n_lines", "sum_qty", "acctbal"))
    lost = F.when(F.col("acctbal") < 0, F.lit(float("nan"))).otherwise(F.col("acctbal"))
    return qual.sanity_counts(table.with_columns({"acctbal": lost}))
