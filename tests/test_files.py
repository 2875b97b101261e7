"""Readers, writers, the house rules on files, and scoring of a stream."""

import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from plumbline import ColumnSpec, FeatureTable, SchemaSpec
from plumbline.operators import missing, numeric
from plumbline.plans.gram import fold_grams, ols
from plumbline.plans.house import clean_house
from plumbline.plans.storage import checkpoint_dir, materialize
from plumbline.sources import io
from plumbline.sources.house import house
from plumbline.streaming.scoring import score_stream

SPEC = SchemaSpec(
    "Id",
    "Price",
    {"Area": ColumnSpec(), "Type": ColumnSpec("CATEGORICAL", ("None", "C (all)", "1.5Fin"))},
)


@pytest.fixture
def csv_pair(spark, tmp_path):
    train, test = tmp_path / "train.csv", tmp_path / "test.csv"
    train.write_text("Id,Area,Type,Price\n1,10,C (all),100\n2,NA,None,200\n3,30,NA,300\n")
    test.write_text("Id,Area,Type\n1,5,1.5Fin\n4,NA,NA\n")
    return io.load_pair(spark, str(train), str(test), SPEC)


def test_na_is_null_and_none_is_text(csv_pair):
    got = {(r["split"], r["Id"]): (r["Area"], r["Type"], r["Price"]) for r in csv_pair.df.collect()}
    assert got["train", 2] == (None, "None", 200.0)
    assert got["train", 3] == (30.0, None, 300.0)
    assert got["test", 4] == (None, None, None)
    assert len(got) == 5


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_save_and_load(spark, csv_pair, tmp_path, fmt):
    scores = csv_pair.train.select("split", "Id", F.lit(1.5).alias("score"))
    io.save(csv_pair, str(tmp_path / "out"), fmt=fmt)
    back = io.load_saved(spark, str(tmp_path / "out"), fmt)
    order = sorted(csv_pair.df.columns)
    as_text = lambda df: sorted(tuple(map(str, r)) for r in df.select(*order).collect())
    assert as_text(back.df) == as_text(csv_pair.df)
    assert dict(back.df.dtypes) == dict(csv_pair.df.dtypes)
    assert back.spec == csv_pair.spec
    io.save(csv_pair, str(tmp_path / "scored"), scores, fmt="parquet")
    assert spark.read.parquet(str(tmp_path / "scored" / "train")).where("score = 1.5").count() == 3


def test_submission_file(spark, csv_pair, tmp_path):
    table = numeric.log1p(missing.fillna_mean(csv_pair), "Price")
    model = fold_grams(table.train, ["Area"], "Price").fit(ols())
    out = io.submission(table, model.predict())
    io.write_csv(out, str(tmp_path / "sub"))
    back = spark.read.option("header", True).csv(str(tmp_path / "sub"))
    assert back.columns == ["Id", "SalePrice"] and back.count() == 2
    assert out.where("SalePrice < 50 OR SalePrice > 500").count() == 0


def test_scores_are_written_in_order(spark, tmp_path):
    df = spark.range(1000).withColumn("score", (F.col("id") * 7919 % 1009).cast("double"))
    io.write_scores(df, str(tmp_path / "scores"))
    lines = []
    for name in sorted(os.listdir(tmp_path / "scores")):
        if name.startswith("part-"):
            lines += (tmp_path / "scores" / name).read_text().splitlines()[1:]
    got = [float(x.split(",")[1]) for x in lines]
    assert len(got) == 1000 and got == sorted(got, reverse=True)
    io.write_vector(df, "score", str(tmp_path / "vector"))
    assert spark.read.text(str(tmp_path / "vector")).count() == 1000


def test_ragged_catalogue(spark, tmp_path):
    path = tmp_path / "features.csv"
    path.write_text("ColName,NumDistinctValues,HasNA,Type,Comments\nA,5,true,NUMERIC,ok\nB,2,false,BINARY\n")
    rows = io.load_catalogue(spark, str(path)).orderBy("ColName").collect()
    assert rows[0]["HasNA"] is True and rows[1]["Type"] == "BINARY" and rows[1]["Comments"] is None


def test_maps_and_recipe(tmp_path):
    path = tmp_path / "map.json"
    path.write_text('{"Street": {"Grvl": 0, "Pave": 1}}')
    assert io.load_map(str(path)) == {"Street": {"Grvl": 0, "Pave": 1}}
    kinds = {"Id": "NUMERIC", "Area": "NUMERIC", "Type": "CATEGORICAL", "Price": "NUMERIC"}
    assert io.recipe(kinds, "Id", "Price") == [("Area", "quantile_bin_50"), ("Type", "pass")]


def test_manifest_file(spark, csv_pair, tmp_path):
    from plumbline.operators.quality import profile

    out = io.manifest(csv_pair, profile(csv_pair.df, ["Id", "Area", "Type", "Price"], binary=False))
    out.write.json(str(tmp_path / "manifest"))
    rows = {r["attribute_name"]: r for r in spark.read.json(str(tmp_path / "manifest")).collect()}
    assert rows["Type"]["attribute_type"] == "CATEGORICAL" and rows["Price"]["is_target"] == 1


def test_house_options(spark, folder):
    table = house(spark, folder)
    kept = clean_house(table, drop_partial=True, strict=False)
    assert kept.train.where("SaleCondition = 'Partial'").count() == 0
    assert kept.test.where("SaleCondition = 'Partial'").count() > 0
    raw = table.df.where("BsmtQual IS NULL AND BsmtUnfSF > 0").select("Id").limit(1).first()[0]
    plain = clean_house(table, strict=False).df.where(F.col("Id") == raw).first()
    repaired = clean_house(table, repair_basement=True, strict=False).df.where(F.col("Id") == raw)
    assert plain["BsmtUnfSF"] > 0 and repaired.first()["BsmtUnfSF"] == 0
    assert "None" == table.with_spec(kept.spec).spec["PoolQC"].categories[-1]


def test_named_checkpoint_folder_wins():
    def session(named, current, master="yarn"):
        context = SimpleNamespace(getCheckpointDir=lambda: current, master=master)
        conf = SimpleNamespace(get=lambda key, default: named)
        return SimpleNamespace(conf=conf, sparkContext=context)

    assert checkpoint_dir(session("/shared/a", "/other")) == "/shared/a"
    assert checkpoint_dir(session(None, "/shared/b")) == "/shared/b"
    with pytest.raises(RuntimeError):
        checkpoint_dir(session(None, None))


def test_written_tables_keep_rows_and_types(spark):
    df = spark.range(5).withColumn("x", F.col("id") / 2)
    back = materialize(df)
    assert back.schema.simpleString() == df.schema.simpleString()
    assert sorted(back.collect()) == sorted(df.collect())


def test_fitted_columns_score_a_stream(spark, tmp_path):
    rows = [(i, float(i), 2.0 * i + 1, "train") for i in range(20)]
    table = FeatureTable(
        spark.createDataFrame(rows, "id bigint, x double, y double, split string"),
        SchemaSpec("id", "y", {"x": ColumnSpec()}),
    )
    scaler = numeric.fit_zscore(table.train, ["x"])["x"]
    model = fold_grams(numeric.zscore(table).train, ["x"], "y").fit(ols())
    incoming = str(tmp_path / "in")
    spark.createDataFrame([(100, 50.0), (101, -1.0)], "id bigint, x double").write.parquet(incoming)
    stream = spark.readStream.schema("id bigint, x double").parquet(incoming)
    layers = [{"x": scaler.apply(F.col("x"))}, {"y": model.predict()}]
    score_stream(stream, layers, ["id", "y"], str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = {r["id"]: r["y"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {100: pytest.approx(101.0), 101: pytest.approx(-1.0)}
