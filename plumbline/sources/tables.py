"""The shared ``sales`` feature table, built from the star-schema parquet files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.spec import CATEGORICAL, ColumnSpec, SchemaSpec
from plumbline.table import FeatureTable

LINE_COLUMNS = ("n_lines", "sum_qty", "avg_disc", "flag")
CUSTOMER_COLUMNS = ("segment", "acctbal")
PLACE_COLUMNS = ("nation", "region")
ORDER_COLUMNS = ("status", "priority", "yr_sold", "mo_sold")
SALES_COLUMNS = (
    "status", "priority", "segment", "nation", "region", "acctbal",
    "n_lines", "sum_qty", "avg_disc", "flag", "yr_sold", "mo_sold",
)


def _levels(*names: str, **flags) -> ColumnSpec:
    return ColumnSpec(CATEGORICAL, names, **flags)


SALES_SPEC = SchemaSpec(
    id="id",
    target="target",
    columns={
        "status": _levels("F", "O", "P"),
        "priority": _levels(
            "1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", meaningful_order=True
        ),
        "segment": _levels("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"),
        "nation": _levels(*[f"NATION_{i}" for i in range(25)]),
        "region": _levels("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"),
        "flag": _levels("A", "N", "R"),
        "acctbal": ColumnSpec(),
        "n_lines": ColumnSpec(possibly_categorical=True),
        "sum_qty": ColumnSpec(),
        "avg_disc": ColumnSpec(),
        "yr_sold": ColumnSpec(),
        "mo_sold": ColumnSpec(possibly_categorical=True),
    },
)


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def key_split() -> Column:
    """Four of five orders train, the fifth is scored."""
    return F.when(F.col("o_orderkey") % 5 < 4, "train").otherwise("test")


def time_split() -> Column:
    """Orders before 2000 train, later ones are scored, so scored values may be out of range."""
    return F.when(F.year("o_orderdate") < 2000, "train").otherwise("test")


def sales(
    spark: SparkSession,
    folder: str,
    columns: Sequence[str] = SALES_COLUMNS,
    split: Column | None = None,
) -> FeatureTable:
    """One row per order with the asked-for feature columns.

    Every lookup is a left join on a unique key, so tables that serve no asked-for column are
    not read at all.
    """
    ask = set(columns)
    df = read(spark, folder, "orders")
    out = {
        "status": F.col("o_orderstatus"),
        "priority": F.col("o_orderpriority"),
        "yr_sold": F.year("o_orderdate").cast("double"),
        "mo_sold": F.month("o_orderdate").cast("double"),
    }
    if ask & set(CUSTOMER_COLUMNS + PLACE_COLUMNS):
        customer = read(spark, folder, "customer")
        df = df.join(customer, df.o_custkey == customer.c_custkey, "left")
        out |= {"segment": F.col("c_mktsegment"), "acctbal": F.col("c_acctbal")}
    if ask & set(PLACE_COLUMNS):
        nation = read(spark, folder, "nation")
        region = read(spark, folder, "region")
        places = nation.join(region, nation.n_regionkey == region.r_regionkey, "left")
        df = df.join(places, df.c_nationkey == places.n_nationkey, "left")
        out |= {"nation": F.col("n_name"), "region": F.col("r_name")}
    if ask & set(LINE_COLUMNS):
        lines = (
            read(spark, folder, "lineitem")
            .groupBy("l_orderkey")
            .agg(
                F.count("*").cast("double").alias("n_lines"),
                F.sum("l_quantity").alias("sum_qty"),
                F.avg("l_discount").alias("avg_disc"),
                F.max("l_returnflag").alias("flag"),
            )
        )
        df = df.join(lines, df.o_orderkey == lines.l_orderkey, "left")
        out |= {c: F.col(c) for c in LINE_COLUMNS}
    picked = [out[c].alias(c) for c in SALES_COLUMNS if c in ask]
    df = df.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_totalprice").alias("target"),
        *picked,
        (key_split() if split is None else split).alias("split"),
    )
    return FeatureTable(df, SALES_SPEC.only(ask))


# the same table for the check queries; {split} is one of the two expressions below
SALES_SQL = """
sales AS (
  SELECT o.o_orderkey AS id, o.o_totalprice AS target, o.o_orderstatus AS status,
    o.o_orderpriority AS priority, c.c_mktsegment AS segment, n.n_name AS nation,
    r.r_name AS region, c.c_acctbal AS acctbal, CAST(li.n_lines AS DOUBLE) AS n_lines,
    li.sum_qty, li.avg_disc, li.flag,
    CAST(year(o.o_orderdate) AS DOUBLE) AS yr_sold,
    CAST(month(o.o_orderdate) AS DOUBLE) AS mo_sold,
    {split} AS split
  FROM orders o
  LEFT JOIN (
    SELECT l_orderkey, count(*) AS n_lines, sum(l_quantity) AS sum_qty,
      avg(l_discount) AS avg_disc, max(l_returnflag) AS flag
    FROM lineitem GROUP BY l_orderkey) li ON o.o_orderkey = li.l_orderkey
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN region r ON n.n_regionkey = r.r_regionkey)
"""
KEY_SPLIT_SQL = "CASE WHEN o.o_orderkey % 5 < 4 THEN 'train' ELSE 'test' END"
TIME_SPLIT_SQL = "CASE WHEN year(o.o_orderdate) < 2000 THEN 'train' ELSE 'test' END"
