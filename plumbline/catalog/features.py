"""Queries on missing values, derived columns, numeric transforms, encoders and splits."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from plumbline.catalog.registry import on_sales, query
from plumbline.catalog.tables import r4
from plumbline.operators import columns as cols
from plumbline.operators import derive as d
from plumbline.operators import encode, missing, numeric
from plumbline.operators import sampling as split
from plumbline.sources import io
from plumbline.sources.tables import key_split, read, sales
from plumbline.spec import CATEGORICAL, ColumnSpec, SchemaSpec
from plumbline.table import FeatureTable

# --- missing values and repairs


@query(
    "fillna_mean",
    on_sales(
        """SELECT id, round(coalesce(n_lines, m1), 4) AS n_lines,
        round(coalesce(sum_qty, m2), 4) AS sum_qty, acctbal
        FROM sales, (SELECT avg(n_lines) AS m1, avg(sum_qty) AS m2 FROM sales
        WHERE split = 'train')"""
    ),
)
def fillna_mean(spark, folder):
    table = sales(spark, folder, ("acctbal", "n_lines", "sum_qty"))
    return missing.fillna_mean(table).df.select("id", r4("n_lines"), r4("sum_qty"), "acctbal")


@query(
    "fillna_value",
    on_sales(
        """SELECT id, coalesce(n_lines, -1) AS n_lines, coalesce(sum_qty, -1) AS sum_qty, flag
        FROM sales"""
    ),
)
def fillna_value(spark, folder):
    table = sales(spark, folder, ("n_lines", "sum_qty", "flag"))
    return missing.fillna_value(table, -1.0).df.select("id", "n_lines", "sum_qty", "flag")


@query(
    "fillna_rules",
    on_sales(
        """SELECT id, coalesce(flag, 'None') AS flag, coalesce(n_lines, 0) AS n_lines,
        coalesce(sum_qty, 0) AS sum_qty,
        CAST(CASE coalesce(flag, 'None') WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2
          ELSE 3 END AS DOUBLE) AS flag_code FROM sales"""
    ),
)
def fillna_rules(spark, folder):
    """Fill by rule; the fill level is declared last, so it gets the highest code."""
    table = sales(spark, folder, ("flag", "n_lines", "sum_qty"))
    filled = missing.fill_columns(table, {"flag": "None", "n_lines": 0, "sum_qty": 0})
    code = encode.ordinal_code(F.col("flag"), filled.spec["flag"].categories)
    return filled.df.select("id", "flag", "n_lines", "sum_qty", code.alias("flag_code"))


@query(
    "replace_values",
    on_sales(
        """SELECT id, CASE status WHEN 'P' THEN 'O' ELSE status END AS status,
        CASE segment WHEN 'BUILDING' THEN 'HOUSEHOLD' WHEN 'FURNITURE' THEN 'HOUSEHOLD'
        ELSE segment END AS segment FROM sales"""
    ),
)
def replace_values(spark, folder):
    table = sales(spark, folder, ("status", "segment"))
    rules = {
        "status": {"P": "O"},
        "segment": {"BUILDING": "HOUSEHOLD", "FURNITURE": "HOUSEHOLD"},
    }
    return missing.replace_values(table, rules).df.select("id", "status", "segment")


@query(
    "conditional_fill",
    on_sales(
        """SELECT id, CASE WHEN flag IS NULL THEN 0 ELSE n_lines END AS n_lines,
        CASE WHEN flag IS NULL THEN 0 ELSE acctbal END AS acctbal FROM sales"""
    ),
)
def conditional_fill(spark, folder):
    table = sales(spark, folder, ("flag", "n_lines", "acctbal"))
    out = missing.conditional_fill(table, "flag", ("n_lines", "acctbal"), 0.0)
    return out.df.select("id", "n_lines", "acctbal")


# --- derived columns


@query(
    "feat_membership",
    on_sales(
        """SELECT id, CASE WHEN mo_sold IN (5, 6, 7) THEN 1 ELSE 0 END AS summer,
        CASE WHEN flag IN ('A', 'R') THEN 1 ELSE 0 END AS flagged FROM sales"""
    ),
)
def feat_membership(spark, folder):
    return sales(spark, folder, ("mo_sold", "flag")).df.select(
        "id",
        d.membership("mo_sold", (5, 6, 7)).alias("summer"),
        d.membership("flag", ("A", "R")).alias("flagged"),
    )


@query(
    "feat_interactions",
    on_sales(
        """SELECT id, n_lines * sum_qty AS lines_x_qty, n_lines + sum_qty AS lines_plus_qty
        FROM sales"""
    ),
)
def feat_interactions(spark, folder):
    return sales(spark, folder, ("n_lines", "sum_qty")).df.select(
        "id",
        d.product("n_lines", "sum_qty").alias("lines_x_qty"),
        d.total("n_lines", "sum_qty").alias("lines_plus_qty"),
    )


@query(
    "feat_dates",
    on_sales("SELECT id, round(yr_sold + mo_sold / 12.0, 4) AS date_sold FROM sales"),
)
def feat_dates(spark, folder):
    return sales(spark, folder, ("yr_sold", "mo_sold")).df.select(
        "id", r4(d.fractional_date("yr_sold", "mo_sold"), "date_sold")
    )


@query(
    "feat_ratio",
    on_sales(
        """SELECT id, sum_qty - n_lines AS extra_qty,
        round(n_lines / (1 + sum_qty), 9) AS line_share FROM sales"""
    ),
)
def feat_ratio(spark, folder):
    return sales(spark, folder, ("sum_qty", "n_lines")).df.select(
        "id",
        d.elapsed("sum_qty", "n_lines").alias("extra_qty"),
        F.round(d.share("n_lines", "sum_qty"), 9).alias("line_share"),
    )


@query(
    "feat_sums",
    on_sales("SELECT id, round(n_lines + sum_qty + acctbal, 4) AS total FROM sales"),
)
def feat_sums(spark, folder):
    return sales(spark, folder, ("n_lines", "sum_qty", "acctbal")).df.select(
        "id", r4(d.total("n_lines", "sum_qty", "acctbal"), "total")
    )


@query(
    "feat_gated",
    on_sales(
        """SELECT id, CASE WHEN status = 'F' THEN sum_qty ELSE 0 END AS finished_qty,
        CASE WHEN flag = 'R' THEN acctbal ELSE 0 END AS returned_balance FROM sales"""
    ),
)
def feat_gated(spark, folder):
    return sales(spark, folder, ("status", "sum_qty", "flag", "acctbal")).df.select(
        "id",
        d.gated("sum_qty", F.col("status") == "F").alias("finished_qty"),
        d.gated("acctbal", F.col("flag") == "R").alias("returned_balance"),
    )


LETTERS = ("A", "N", "R", "O", "F", "P")


@query(
    "feat_multihot",
    on_sales(
        "SELECT id, "
        + ", ".join(
            f"""(CASE WHEN status = '{v}' THEN 1 ELSE 0 END
            + CASE WHEN flag = '{v}' THEN 1 ELSE 0 END) AS "has_{v}",
            CASE WHEN coalesce(status = '{v}', FALSE) OR coalesce(flag = '{v}', FALSE)
            THEN 1 ELSE 0 END AS "any_{v}" """
            for v in LETTERS
        )
        + " FROM sales"
    ),
)
def feat_multihot(spark, folder):
    table = sales(spark, folder, ("status", "flag"))
    made = d.multi_hot(("status", "flag"), LETTERS, "has", "any")
    return table.df.select("id", *[e.alias(n) for n, e in made.items()])


@query(
    "feat_age",
    on_sales(
        """SELECT id, yr_sold - 1995 AS age, CASE WHEN n_lines - mo_sold < 0 THEN 0
        ELSE n_lines - mo_sold END AS floored FROM sales"""
    ),
)
def feat_age(spark, folder):
    return sales(spark, folder, ("yr_sold", "n_lines", "mo_sold")).df.select(
        "id",
        d.elapsed("yr_sold", F.lit(1995)).alias("age"),
        d.elapsed("n_lines", "mo_sold", floor=0.0).alias("floored"),
    )


@query(
    "feat_flags",
    on_sales(
        """SELECT id, CASE WHEN n_lines = mo_sold THEN 1 ELSE 0 END AS same,
        CASE WHEN n_lines = mo_sold THEN 0 ELSE 1 END AS differs,
        CASE WHEN flag = 'N' THEN 1 ELSE 0 END AS "flag_N" FROM sales"""
    ),
)
def feat_flags(spark, folder):
    return sales(spark, folder, ("n_lines", "mo_sold", "flag")).df.select(
        "id",
        d.equal("n_lines", "mo_sold").alias("same"),
        d.different("n_lines", "mo_sold").alias("differs"),
        d.equal("flag", F.lit("N")).alias("flag_N"),
    )


@query(
    "separate_value",
    on_sales(
        "SELECT id, n_lines, CASE WHEN n_lines = 1 THEN 1 ELSE 0 END AS single FROM sales"
    ),
)
def separate_value(spark, folder):
    out = d.separate_value(sales(spark, folder, ("n_lines",)), "n_lines", 1, "single")
    return out.df.select("id", "n_lines", "single")


# --- numeric transforms


@query(
    "log1p_target",
    on_sales(
        """SELECT id, round(ln(1 + target), 6) AS target, round(target, 2) AS restored,
        round(ln(1 + sum_qty), 6) AS sum_qty FROM sales"""
    ),
)
def log1p_target(spark, folder):
    table = numeric.log1p(sales(spark, folder, ("sum_qty",)), "target")
    table = numeric.log1p(table, "sum_qty")
    return table.df.select(
        "id",
        F.round("target", 6).alias("target"),
        F.round(table.untransform(F.col("target")), 2).alias("restored"),
        F.round("sum_qty", 6).alias("sum_qty"),
    )


@query(
    "zscore",
    on_sales(
        """SELECT id, round((acctbal - m1) / s1, 4) AS acctbal,
        round((sum_qty - m2) / s2, 4) AS sum_qty FROM sales,
        (SELECT avg(acctbal) AS m1, stddev_pop(acctbal) AS s1, avg(sum_qty) AS m2,
          stddev_pop(sum_qty) AS s2 FROM sales WHERE split = 'train')"""
    ),
)
def zscore(spark, folder):
    table = sales(spark, folder, ("acctbal", "sum_qty"))
    return numeric.zscore(table).df.select("id", r4("acctbal"), r4("sum_qty"))


def landmark_sql(c: str) -> str:
    """Interpolated place of a value among ten landmarks; repeated landmarks share their middle."""
    return f"""CASE WHEN {c} IS NULL THEN NULL
      WHEN {c} <= list_min(q_{c}) THEN 0.0 WHEN {c} >= list_max(q_{c}) THEN 1.0
      WHEN list_contains(q_{c}, {c}) THEN (list_position(q_{c}, {c}) - 1
        + len(list_filter(q_{c}, lambda e: e <= {c})) - 1) / 18.0
      ELSE (len(list_filter(q_{c}, lambda e: e < {c})) - 1
        + ({c} - list_max(list_filter(q_{c}, lambda e: e < {c})))
        / (list_min(list_filter(q_{c}, lambda e: e > {c}))
          - list_max(list_filter(q_{c}, lambda e: e < {c})))) / 9.0 END"""


NINTHS = "[" + ", ".join(f"{i}/9.0" for i in range(10)) + "]"


@query(
    "quantile_uniform",
    on_sales(
        f"""SELECT id, round({landmark_sql('acctbal')}, 6) AS acctbal,
        round({landmark_sql('n_lines')}, 6) AS n_lines FROM sales,
        (SELECT quantile_cont(acctbal, {NINTHS}) AS q_acctbal,
          quantile_cont(n_lines, {NINTHS}) AS q_n_lines FROM sales WHERE split = 'train')"""
    ),
)
def quantile_uniform(spark, folder):
    out = numeric.quantile_uniform(sales(spark, folder, ("acctbal", "n_lines")))
    return out.df.select(
        "id", F.round("acctbal", 6).alias("acctbal"), F.round("n_lines", 6).alias("n_lines")
    )


@query(
    "target_roundtrip",
    on_sales(
        """SELECT id, round((ln(1 + target) - m) / s, 4) AS scaled, round(target, 2) AS restored
        FROM sales, (SELECT avg(ln(1 + target)) AS m, stddev_pop(ln(1 + target)) AS s
        FROM sales WHERE split = 'train')"""
    ),
)
def target_roundtrip(spark, folder):
    table = numeric.scale_target(numeric.log1p(sales(spark, folder, ()), "target"))
    restored = table.untransform(F.col("target"))
    return table.df.select("id", r4("target", "scaled"), F.round(restored, 2).alias("restored"))


@query(
    "robust_scale",
    on_sales(
        """SELECT id, round((acctbal - q1[2]) / (q1[3] - q1[1]), 4) AS acctbal,
        round((sum_qty - q2[2]) / (q2[3] - q2[1]), 6) AS sum_qty FROM sales,
        (SELECT quantile_cont(acctbal, [0.25, 0.5, 0.75]) AS q1,
          quantile_cont(sum_qty, [0.25, 0.5, 0.75]) AS q2 FROM sales WHERE split = 'train')"""
    ),
)
def robust_scale(spark, folder):
    out = numeric.robust_scale(sales(spark, folder, ("acctbal", "sum_qty")))
    return out.df.select("id", r4("acctbal"), F.round("sum_qty", 6).alias("sum_qty"))


def _register_bins(n: int) -> None:
    inner = "[" + ", ".join(f"{i}/{n}.0" for i in range(1, n)) + "]"

    @query(
        f"quantile_bin_{n}",
        on_sales(
            f"""SELECT id, len(list_filter(e, lambda x: x < acctbal)) AS acctbal FROM sales,
            (SELECT quantile_cont(acctbal, {inner}) AS e FROM sales WHERE split = 'train')"""
        ),
    )
    def quantile_bin(spark, folder):
        out = numeric.quantile_bins(sales(spark, folder, ("acctbal",)), {"acctbal": n})
        return out.df.select("id", F.col("acctbal").cast("bigint").alias("acctbal"))


for _n in (5, 10, 20, 50):
    _register_bins(_n)


@query(
    "quantile_bin_one_hot",
    on_sales(
        "SELECT id, "
        + ", ".join(
            f"""CAST(len(list_filter(e, lambda x: x < acctbal)) = {i} AS INT)
            AS "acctbal_{i}" """
            for i in range(1, 5)
        )
        + """ FROM sales, (SELECT quantile_cont(acctbal, [0.2, 0.4, 0.6, 0.8]) AS e
        FROM sales WHERE split = 'train')"""
    ),
)
def quantile_bin_one_hot(spark, folder):
    out = numeric.quantile_bin_one_hot(sales(spark, folder, ("acctbal",)), {"acctbal": 5})
    return out.df.drop("target", "split")


TWENTIETHS = "[" + ", ".join(f"{i}/50.0" for i in range(1, 50)) + "]"


@query(
    "recipe_apply",
    on_sales(
        f"""SELECT id, lower(segment) AS segment, status,
        CAST(len(list_filter(e, lambda x: x < acctbal)) AS INT) AS acctbal, sum_qty FROM sales,
        (SELECT quantile_cont(acctbal, {TWENTIETHS}) AS e FROM sales WHERE split = 'train')"""
    ),
)
def recipe_apply(spark, folder):
    """Run a plan of column transforms: bin numbers, lower text, pass the rest.

    ``sum_qty`` has too few distinct quantiles for 50 bins and passes through.
    """
    table = sales(spark, folder, ("segment", "status", "acctbal", "n_lines"))
    table = cols.drop_columns(table, "n_lines")
    kinds = {c: table.spec[c].type for c in table.features}
    steps = dict(io.recipe(kinds, "id", "target"))
    steps["segment"] = "lower"
    out = numeric.apply_recipe(table, list(steps.items()))
    qty = sales(spark, folder, ("sum_qty",)).df.select("id", "sum_qty")
    return out.df.select("id", "segment", "status", "acctbal").join(qty, "id")


@query(
    "extract_value",
    on_sales(
        """SELECT id, round(CASE WHEN n_lines = 4 THEN (m - a) / b ELSE n_lines END, 4)
        AS n_lines FROM sales, (
          SELECT regr_slope(target, n_lines) FILTER (n_lines <> 4) AS b,
            regr_intercept(target, n_lines) FILTER (n_lines <> 4) AS a,
            avg(target) FILTER (n_lines = 4) AS m FROM sales WHERE split = 'train')"""
    ),
)
def extract_value(spark, folder):
    out = numeric.extract_value(sales(spark, folder, ("n_lines",)), "n_lines", 4)
    return out.df.select("id", r4("n_lines"))


def poly_sql(column: str, order: int, skip: str | None = None) -> str:
    """Least-squares polynomial through orthogonal powers of the centred column."""
    keep = f"AND {column} <> {skip}" if skip else ""
    changed = f"CASE WHEN {column} = {skip} THEN {column} ELSE f END" if skip else "f"
    cubic = ", sum(q3 * y) / sum(q3 * q3) AS b3" if order == 3 else ", 0.0 AS b3"
    return on_sales(
        f"""SELECT id, round({changed}, 2) AS {column} FROM (
          SELECT id, {column}, b0 + b1 * (({column} - m) / s)
            + b2 * (pow(({column} - m) / s, 2) - c20 - c21 * (({column} - m) / s))
            + b3 * (pow(({column} - m) / s, 3) - c30 - c31 * (({column} - m) / s)
              - c32 * (pow(({column} - m) / s, 2) - c20 - c21 * (({column} - m) / s))) AS f
          FROM sales, p1, p2, p3, fit)""",
        f"""p1 AS (SELECT avg({column}) AS m, stddev_pop({column}) AS s FROM sales
          WHERE split = 'train' AND {column} IS NOT NULL {keep}),
        t1 AS (SELECT ({column} - m) / s AS t, target AS y FROM sales, p1
          WHERE split = 'train' AND {column} IS NOT NULL {keep}),
        p2 AS (SELECT avg(t * t) AS c20, sum(t * t * t) / sum(t * t) AS c21 FROM t1),
        t2 AS (SELECT t, y, t * t - c20 - c21 * t AS q2 FROM t1, p2),
        p3 AS (SELECT avg(t * t * t) AS c30, sum(t * t * t * t) / sum(t * t) AS c31,
          sum(t * t * t * q2) / sum(q2 * q2) AS c32 FROM t2),
        t3 AS (SELECT t, y, q2, t * t * t - c30 - c31 * t - c32 * q2 AS q3 FROM t2, p3),
        fit AS (SELECT avg(y) AS b0, sum(t * y) / sum(t * t) AS b1,
          sum(q2 * y) / sum(q2 * q2) AS b2 {cubic} FROM t3)""",
    )


def _register_poly(name: str, column: str, order: int, skip: float | None) -> None:
    @query(name, poly_sql(column, order, None if skip is None else str(skip)))
    def poly(spark, folder):
        out = numeric.poly_linearize(sales(spark, folder, (column,)), column, order, skip)
        return out.df.select("id", F.round(column, 2).alias(column))


_register_poly("poly_linearize_2", "sum_qty", 2, None)
_register_poly("poly_linearize_3", "acctbal", 3, None)
_register_poly("poly_linearize_skip", "n_lines", 2, 4)


@query(
    "cast_types",
    on_sales(
        """SELECT id, CAST(CAST(mo_sold AS INT) AS VARCHAR) || '.0' AS mo_sold,
        CAST(substr(nation, 8) AS DOUBLE) AS nation_number,
        CAST(NULL AS DOUBLE) AS status FROM sales"""
    ),
)
def cast_types(spark, folder):
    """Cast both ways; text that is no number becomes null."""
    table = sales(spark, folder, ("mo_sold", "nation", "status"))
    table = table.with_columns({"nation_number": F.regexp_replace("nation", "NATION_", "")})
    table = replace(
        table, spec=table.spec.with_column("nation_number", ColumnSpec("CATEGORICAL"))
    )
    kinds = {"mo_sold": "CATEGORICAL", "nation_number": "NUMERIC", "status": "NUMERIC"}
    return cols.cast_types(table, kinds).df.select("id", "mo_sold", "nation_number", "status")


@query(
    "pca",
    on_sales(
        """SELECT id, round(cos(a) * (sum_qty - mx) + sin(a) * (n_lines - my), 3) AS pc_1
        FROM sales, m""",
        """m AS (SELECT avg(sum_qty) AS mx, avg(n_lines) AS my,
          0.5 * atan2(2 * covar_pop(sum_qty, n_lines), var_pop(sum_qty) - var_pop(n_lines)) AS a
          FROM sales WHERE n_lines IS NOT NULL)""",
    ),
)
def pca(spark, folder):
    out = numeric.pca(sales(spark, folder, ("sum_qty", "n_lines")), ["sum_qty", "n_lines"], 1)
    return out.df.select("id", F.round("pc_1", 3).alias("pc_1"))


# --- encoders


ONE_HOT_SQL = {
    "segment": ("BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"),
    "flag": ("N", "R"),
}


@query(
    "one_hot",
    on_sales(
        "SELECT id, "
        + ", ".join(
            f"""CASE WHEN {c} = '{v}' THEN 1 ELSE 0 END AS "{c}_{v}" """
            for c, levels in ONE_HOT_SQL.items()
            for v in levels
        )
        + " FROM sales"
    ),
)
def one_hot(spark, folder):
    return encode.one_hot_levels(sales(spark, folder, ("segment", "flag"))).df.drop(
        "target", "split"
    )


@query(
    "label_encode",
    on_sales(
        """SELECT id, CAST(substr(priority, 1, 1) AS DOUBLE) - 1 AS priority,
        CASE status WHEN 'F' THEN 0.0::DOUBLE WHEN 'O' THEN 1.0 WHEN 'P' THEN 2.0 END AS status
        FROM sales"""
    ),
)
def label_encode(spark, folder):
    out = encode.label_encode(sales(spark, folder, ("priority", "status")))
    return out.df.select("id", "priority", "status")


ORDERS_SQL = """WITH sales AS (SELECT o_orderkey AS id, o_totalprice AS target,
  CAST(o_custkey AS VARCHAR) AS customer,
  CASE WHEN o_orderkey % 5 < 4 THEN 'train' ELSE 'test' END AS split FROM orders)
"""


def customer_orders(spark, folder) -> FeatureTable:
    """Orders with the customer as a category of undeclared, many levels."""
    df = read(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_totalprice").alias("target"),
        F.col("o_custkey").cast("string").alias("customer"),
        key_split().alias("split"),
    )
    return FeatureTable(df, SchemaSpec("id", "target", {"customer": ColumnSpec(CATEGORICAL)}))


@query(
    "label_encode_many",
    ORDERS_SQL
    + """SELECT id, CAST(dense_rank() OVER (ORDER BY customer) - 1 AS DOUBLE) AS customer
    FROM sales""",
)
def label_encode_many(spark, folder):
    """Codes of a category with one level a customer, ranked and joined as a table."""
    return encode.label_encode(customer_orders(spark, folder)).df.select("id", "customer")


@query(
    "target_median_many",
    ORDERS_SQL
    + """SELECT s.id, round(coalesce(t.m, g.m), 4) AS customer FROM sales s
    LEFT JOIN (SELECT customer, median(target) AS m FROM sales WHERE split = 'train' GROUP BY customer) t
      ON s.customer = t.customer,
    (SELECT median(target) AS m FROM sales WHERE split = 'train') g""",
)
def target_median_many(spark, folder):
    """Target median of a category with one level a customer, joined as a table.

    Medians of amounts in cents have three decimals at most, so that no rounding ends in a tie.
    """
    out = encode.target_stats_all(customer_orders(spark, folder), stat="median")
    return out.df.select("id", r4("customer"))


def target_sql(column: str, aggregate: str) -> str:
    return on_sales(
        f"""SELECT s.id, round(coalesce(t.m, g.m), 4) AS {column} FROM sales s
        LEFT JOIN (SELECT {column}, {aggregate} AS m FROM sales WHERE split = 'train'
          GROUP BY {column}) t ON s.{column} = t.{column},
        (SELECT {aggregate} AS m FROM sales WHERE split = 'train') g"""
    )


@query("target_mean", target_sql("flag", "avg(target)"))
def target_mean(spark, folder):
    out = encode.target_mean(sales(spark, folder, ("flag",)), "flag")
    return out.df.select("id", r4("flag"))


@query("target_median", target_sql("nation", "median(target)"))
def target_median(spark, folder):
    out = encode.target_median(sales(spark, folder, ("nation",)), "nation")
    return out.df.select("id", r4("nation"))


@query("target_agg", target_sql("region", "stddev_pop(target)"))
def target_agg(spark, folder):
    out = encode.target_aggregate(sales(spark, folder, ("region",)), "region", F.stddev_pop)
    return out.df.select("id", r4("region"))


@query("target_agg_udf", target_sql("segment", "exp(avg(ln(1 + target))) - 1"))
def target_agg_udf(spark, folder):
    """Shifted geometric mean, whose partial state is a Python function of a batch."""

    def partial(y):
        import numpy as np

        return [np.log1p(y).sum(), len(y)]

    table = sales(spark, folder, ("segment",))
    out = encode.target_moments(table, "segment", partial, lambda s: F.expm1(s[0] / s[1]), 2)
    return out.df.select("id", r4("segment"))


# the seeded id mix of plans: two multiplications modulo a prime around a swap of halves
def mix_sql(id: str, seed: int = 0) -> str:
    once = f"((({id} % 2147483647) + {seed + 1}) * 48271) % 2147483647"
    return f"(((({once}) % 65536) * 32768 + ({once}) // 65536) * 48271) % 2147483647"


@query(
    "target_mean_folds",
    on_sales(
        """SELECT s.id, round(CASE WHEN s.split = 'train' THEN
          CASE WHEN t.n - o.n > 0 THEN (t.s - o.s) / (t.n - o.n) ELSE g.m END
          ELSE coalesce(t.s / t.n, g.m) END, 5) AS nation
        FROM f s
        LEFT JOIN (SELECT nation, sum(target) AS s, count(*) AS n FROM f WHERE split = 'train'
          GROUP BY nation) t ON s.nation = t.nation
        LEFT JOIN (SELECT nation, fold, sum(target) AS s, count(*) AS n FROM f
          WHERE split = 'train' GROUP BY nation, fold) o
          ON s.nation = o.nation AND s.fold = o.fold,
        (SELECT avg(target) AS m FROM f WHERE split = 'train') g""",
        f"f AS (SELECT *, {mix_sql('id')} % 5 AS fold FROM sales)",
    ),
)
def target_mean_folds(spark, folder):
    table = sales(spark, folder, ("nation",))
    out = encode.target_mean(table, "nation", folds=split.hash_fold("id", 5))
    return out.df.select("id", F.round("nation", 5).alias("nation"))


# --- shuffles and splits


@query(
    "shuffle",
    f"""SELECT o_orderkey AS id, row_number() OVER (ORDER BY {mix_sql('o_orderkey', 11)},
    o_orderkey) - 1 AS pos FROM orders""",
)
def shuffle(spark, folder):
    ids = read(spark, folder, "orders").select(F.col("o_orderkey").alias("id"))
    return split.shuffle_rows(ids, "id", seed=11)


@query(
    "hash_split",
    f"""SELECT o_orderkey AS id, CASE WHEN {mix_sql('o_orderkey', 3)} / 2147483647.0 < 0.2
    THEN 'test' ELSE 'train' END AS part FROM orders""",
)
def hash_split(spark, folder):
    ids = read(spark, folder, "orders").select(F.col("o_orderkey").alias("id"))
    return split.hash_split(ids, "id", 0.2, seed=3)


@query(
    "kfold_assign",
    on_sales(
        """SELECT id, CAST(ntile(7) OVER (ORDER BY id) - 1 AS INT) AS fold FROM sales
        WHERE split = 'train'"""
    ),
)
def kfold_assign(spark, folder):
    train = sales(spark, folder, ()).train.select("id")
    return split.contiguous_folds(train, "id", 7)


@query(
    "holdout",
    f"""SELECT o_orderkey AS id, CASE WHEN row_number() OVER (
      ORDER BY {mix_sql('o_orderkey', 5)} DESC, o_orderkey DESC) <= 300
      THEN 'holdout' ELSE 'train' END AS part FROM orders""",
)
def holdout(spark, folder):
    ids = read(spark, folder, "orders").select(F.col("o_orderkey").alias("id"))
    return split.holdout(ids, "id", 300, seed=5)


@query(
    "percent_range",
    """SELECT id FROM (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderkey) - 1 AS p,
    count(*) OVER () AS n FROM orders) WHERE p * 100.0 / n >= 20 AND p * 100.0 / n < 70""",
)
def percent_range(spark, folder):
    ids = read(spark, folder, "orders").select(F.col("o_orderkey").alias("id"))
    return split.percent_range(ids, "id", 20, 70)


def _all_means_sql() -> str:
    names = ("status", "segment", "flag")
    joins = " ".join(
        f"""LEFT JOIN (SELECT {c}, avg(target) AS m FROM sales WHERE split = 'train'
        GROUP BY {c}) t_{c} ON s.{c} = t_{c}.{c}"""
        for c in names
    )
    picks = ", ".join(f"round(coalesce(t_{c}.m, g.m), 4) AS {c}" for c in names)
    return on_sales(
        f"""SELECT s.id, {picks} FROM sales s {joins},
        (SELECT avg(target) AS m FROM sales WHERE split = 'train') g"""
    )


@query("target_mean_all", _all_means_sql())
def target_mean_all(spark, folder):
    """Every categorical column by its category means, fitted in one grouped pass."""
    out = encode.target_stats_all(sales(spark, folder, ("status", "segment", "flag")))
    return out.df.select("id", r4("status"), r4("segment"), r4("flag"))
