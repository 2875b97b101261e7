"""The paths taken beyond the row bounds give what the short ones give."""

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.operators import encode, joins, numeric, quality, sampling, windows
from plumbline.plans import prefix, quantiles, storage
from plumbline.sources.tables import sales


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows, one value of it a third of all; some keys and values are null."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(3000):
        key = "hot" if i % 10 < 7 else (None if i % 10 == 7 else f"k{i % 10}")
        value = 4.0 if i % 3 == 0 else float(np.round(rng.normal(0, 50), 3))
        rows.append((i, key, None if i % 97 == 0 else value))
    return spark.createDataFrame(rows, "id bigint, k string, v double").cache()


def rows(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


def test_running_sums(skewed):
    sums = {"s": F.col("id"), "n": F.lit(1).cast("bigint")}
    short = prefix.running_sums(skewed, ["k"], ["id"], sums)
    long = prefix.running_sums(skewed, ["k"], ["id"], sums, small=0)
    assert rows(short) == rows(long)


def test_positions_without_groups(skewed):
    got = prefix.positions(skewed, [], ["v", "id"], small=0)
    w = W.orderBy("v", "id")
    want = skewed.withColumn("pos", F.row_number().over(w).cast("bigint") - 1)
    assert rows(got) == rows(want)


def test_group_quantiles(skewed):
    probs = [0.0, 0.1, 0.25, 0.5, 2 / 3, 0.9, 1.0]
    # three groups are shorter than the sketch is accurate, two are longer
    got = quantiles.group_quantiles(skewed, ["k"], "v", probs, small=0, accuracy=299).collect()
    data = skewed.where("v IS NOT NULL").toPandas()
    assert len(got) == data["k"].nunique(dropna=False)
    for r in got:
        part = data[data["k"].isna()] if r["k"] is None else data[data["k"] == r["k"]]
        assert r["q"] == pytest.approx(list(np.quantile(part["v"], probs)), abs=1e-9)


def test_column_quantiles(skewed):
    df = skewed.withColumn("w", F.col("v") * 2 + F.col("id"))
    probs = {"v": [i / 50 for i in range(51)], "w": [0.5]}
    long = quantiles.column_quantiles(df, probs, small=0, accuracy=500)
    short = quantiles.column_quantiles(df, probs)
    for c in probs:
        assert long[c] == pytest.approx(short[c], abs=1e-9)


def test_one_column_quantiles(skewed):
    long = quantiles.column_quantiles(skewed, {"v": [0.3]}, small=0, accuracy=200)
    assert long["v"] == pytest.approx(quantiles.column_quantiles(skewed, {"v": [0.3]})["v"])


def test_trailing_windows_cross_blocks(skewed):
    long = windows.moving_average(skewed, ["k"], ["id"], "id", 5, small=0, block=7)
    short = windows.moving_average(skewed, ["k"], ["id"], "id", 5)
    assert rows(long) == rows(short)
    stops_long = windows.progress_stop(skewed, ["k"], ["id"], "id", small=0, block=9)
    assert rows(stops_long) == rows(windows.progress_stop(skewed, ["k"], ["id"], "id"))


def test_folds_and_holdout(skewed):
    for k in (4, 7, 11):
        long = sampling.contiguous_folds(skewed.select("id"), "id", k, small=0)
        sizes = [r["count"] for r in long.groupBy("fold").count().orderBy("fold").collect()]
        assert max(sizes) - min(sizes) <= 1 and sizes == sorted(sizes, reverse=True)
    eleven = sampling.contiguous_folds(skewed.select("id").where("id < 11"), "id", 4)
    sizes = [r["count"] for r in eleven.groupBy("fold").count().orderBy("fold").collect()]
    assert sizes == [3, 3, 3, 2]
    short = sampling.holdout(skewed.select("id"), "id", 500, seed=3)
    long = sampling.holdout(skewed.select("id"), "id", 500, seed=3, take_limit=0, small=0)
    assert rows(short) == rows(long)
    assert short.where("part = 'holdout'").count() == 500


def test_shuffle_uses_its_seed(skewed):
    a = rows(sampling.shuffle_rows(skewed.select("id"), "id", 1))
    b = rows(sampling.shuffle_rows(skewed.select("id"), "id", 2))
    assert a != b and a == rows(sampling.shuffle_rows(skewed.select("id"), "id", 1, small=0))


def test_lookup_join_without_broadcast(skewed, monkeypatch):
    stats = skewed.groupBy("k").agg(F.avg("v").alias("m"))
    short = storage.lookup_join(skewed, stats, "k")
    monkeypatch.setattr(storage, "BROADCAST_ROWS", 0)
    assert rows(storage.lookup_join(skewed, stats, "k")) == rows(short)


def test_row_rarity(spark, folder):
    table = sales(spark, folder, ("acctbal", "n_lines", "nation"))
    assert rows(quality.row_rarity(table, small=0)) == rows(quality.row_rarity(table))
    ids = table.train.where("id < 100").select("id")
    some = quality.row_rarity(table, rows=ids)
    assert rows(some) == rows(quality.row_rarity(table).join(ids, "id", "left_semi"))


def test_fitted_transforms(spark, folder):
    table = sales(spark, folder, ("acctbal", "sum_qty", "nation"))
    for op in (
        lambda s: numeric.robust_scale(table, small=s),
        lambda s: numeric.quantile_uniform(table, small=s),
        lambda s: numeric.quantile_bins(table, {"acctbal": 20}, small=s),
        lambda s: encode.target_median(table, "nation", small=s),
    ):
        assert rows(op(0).df) == rows(op(10**9).df)


def test_neighbors_in_blocks(skewed):
    data = skewed.where("v IS NOT NULL").withColumn("w", F.col("id") % 13)
    probes = data.where("id % 300 = 1")
    got = joins.nearest_neighbors(
        probes, data, "id", ["v", "w"], k=4, weights=[1.0, 3.0], block_rows=3, chunk_rows=150
    )
    pdf = data.toPandas()
    x = pdf[["v", "w"]].to_numpy(float) * [1.0, 3.0]
    want = []
    for i in np.flatnonzero(pdf["id"] % 300 == 1):
        dist = np.sqrt(((x - x[i]) ** 2).sum(1))
        dist[i] = np.inf
        for rank, j in enumerate(np.lexsort((pdf["id"], dist))[:4], 1):
            want.append((int(pdf["id"][i]), rank, int(pdf["id"][j])))
    found = [(r["probe_id"], r["rank"], r["neighbor_id"]) for r in got.collect()]
    assert sorted(found) == sorted(want)


def test_neighbor_literal(spark):
    rows_ = [(1, 0.0, 0.0, 4.0), (2, 1.0, 0.0, 0.0), (3, 0.0, 0.0, 2.0)]
    train = spark.createDataFrame(rows_, "id bigint, a double, b double, c double")
    probe = spark.createDataFrame([(9, 0.0, 0.0, 1.3)], train.schema)
    got = joins.nearest_neighbors(probe, train, "id", ["a", "b", "c"], k=2).orderBy("rank")
    found = [(r["neighbor_id"], round(r["distance"], 4)) for r in got.collect()]
    assert found == [(3, 0.7), (2, 1.6401)]


def test_levels_and_maps_beyond_the_literal_bound(spark):
    from plumbline.spec import ColumnSpec, SchemaSpec
    from plumbline.table import FeatureTable

    n = encode.LITERAL_LEVELS + 500
    rows_ = [(i, f"v{i:05d}", float(i), "train") for i in range(n)] + [(n, None, 0.0, "test")]
    df = spark.createDataFrame(rows_, "id bigint, c string, y double, split string")
    table = FeatureTable(df, SchemaSpec("id", "y", {"c": ColumnSpec("CATEGORICAL", ())}))
    assert encode.infer_levels(table, ["c"])["c"] == tuple(f"v{i:05d}" for i in range(n))
    for size in (10, n):
        part = table.with_df(table.df.where(F.col("id").isNull() | (F.col("id") < size) | (F.col("id") == n)))
        out = encode.map_values(part, {"c": {f"v{i:05d}": i for i in range(size)}})
        got = {r["id"]: r["c"] for r in out.df.collect()}
        assert got == {**{i: i for i in range(size)}, n: None} and set(out.df.columns) == set(df.columns)
    with pytest.raises(Exception, match="unmapped value"):
        encode.map_values(table, {"c": {f"v{i:05d}": i for i in range(n - 1)}}).df.collect()


def test_neighbors_by_split_and_id(spark):
    schema = "split string, id bigint, x double"
    train = spark.createDataFrame([("train", 0, 0.0), ("train", 1, 1.0), ("train", 2, 5.0)], schema)
    probes = [("test", 0, 0.1), ("test", 0, 4.0), ("train", 0, 0.0), ("test", 7, None)]
    got = joins.nearest_neighbors(
        spark.createDataFrame(probes, schema), train, "id", ["x"], k=1, split="split", block_rows=1
    )
    found = sorted((r["probe_split"], r["probe_id"], r["neighbor_id"], round(r["distance"], 6)) for r in got.collect())
    assert found == [("test", 0, 0, 0.1), ("test", 0, 2, 1.0), ("train", 0, 1, 1.0)]


def test_approximate_forms_are_close(spark, folder):
    table = sales(spark, folder, ("acctbal", "nation", "status"))
    exact = numeric.fit_bin_edges(table, [("acctbal", 10)])["acctbal", 10]
    near = numeric.fit_bin_edges(table, [("acctbal", 10)], approx=True)["acctbal", 10]
    spread = table.train.agg(F.max("acctbal") - F.min("acctbal")).first()[0]
    assert np.abs(np.subtract(exact, near)).max() < 0.02 * spread
    a = encode.target_median(table, "nation").df.agg(F.avg("nation")).first()[0]
    b = encode.target_median(table, "nation", approx=True).df.agg(F.avg("nation")).first()[0]
    assert b == pytest.approx(a, rel=0.1)
    names = ("status", "nation", "acctbal")
    one = {r["column"]: r for r in quality.profile(table.df, names).collect()}
    two = {r["column"]: r for r in quality.profile(table.df, names, approx=True).collect()}
    for c in names:
        assert two[c]["n_distinct"] == pytest.approx(one[c]["n_distinct"], rel=0.05)
        assert (two[c]["has_null"], two[c]["type"]) == (one[c]["has_null"], one[c]["type"])


def test_house_features_are_written_as_short_methods(spark, monkeypatch):
    from plumbline.catalog import house as catalog
    from plumbline.plans import storage

    key, seen, write = "spark.sql.codegen.hugeMethodLimit", [], storage.materialize
    monkeypatch.setattr(storage, "materialize", lambda df: seen.append(spark.conf.get(key)) or write(df))
    before = spark.conf.get(key, None)
    out = catalog.house_features(spark, "/root/testdata/sf0.001")
    assert seen == ["8000"] and spark.conf.get(key, None) == before
    assert "CASE WHEN" not in out._jdf.queryExecution().executedPlan().toString()
