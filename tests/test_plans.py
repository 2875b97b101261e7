"""Physical plans: pruned scans, pushed filters, and fits that apply without a shuffle."""

import re

from pyspark.sql import functions as F

from conftest import plan
from plumbline.operators import columns as cols
from plumbline.operators import numeric
from plumbline.plans.house import clean_house
from plumbline.sources.house import house
from plumbline.sources.tables import sales


def read_schemas(text):
    return re.findall(r"ReadSchema: struct<(.*)>", text)


def test_unused_tables_are_not_read(spark, folder):
    text = plan(sales(spark, folder, ("status",)).df.select("id", "status"))
    assert read_schemas(text) == ["o_orderkey:bigint,o_orderstatus:string"]
    wide = plan(sales(spark, folder).df.select("id", "sum_qty"))
    assert "l_returnflag" not in " ".join(read_schemas(wide))


def test_filters_reach_the_scan(spark, folder):
    table = sales(spark, folder, ("status",))
    text = plan(cols.keep_rows(table, F.col("status") == "F").df)
    assert "EqualTo(o_orderstatus,F)" in text


def test_applied_constants_need_no_shuffle(spark, folder):
    table = sales(spark, folder, ("yr_sold", "mo_sold"))
    for done in (numeric.zscore(table), numeric.quantile_bins(table, {"mo_sold": 3})):
        assert "Exchange" not in plan(done.df)
    assert "Exchange" not in plan(clean_house(house(spark, folder), strict=False).df)


def test_running_totals_shuffle_on_more_than_the_group(spark, folder):
    from plumbline.operators.windows import running_mean
    from plumbline.sources.tables import read

    df = read(spark, folder, "events").select("user_id", "event_id", "value")
    text = plan(running_mean(df, ["user_id"], ["event_id"], "value", small=0))
    assert re.search(r"hashpartitioning\(__pid#\d+, user_id#\d+", text)
