"""The five-row fixture, declared schemas and the edge cases of the encoders."""

import math

import pytest
from pyspark.sql import functions as F

from plumbline import ColumnSpec, FeatureTable, SchemaSpec, safe_name
from plumbline.operators import columns as cols
from plumbline.operators import encode, missing, numeric, quality

SPEC = SchemaSpec(
    id="id",
    target="kids",
    columns={
        "kids": ColumnSpec(),
        "age": ColumnSpec(),
        "sex": ColumnSpec("CATEGORICAL", ("F", "M")),
    },
)


@pytest.fixture
def pair(spark):
    train = spark.createDataFrame(
        [(0, "M", 12, 0), (1, "F", 36, 2), (2, "M", 32, 3), (3, "M", 16, 0), (4, "F", 21, 1)],
        "id bigint, sex string, age bigint, kids bigint",
    )
    test = spark.createDataFrame(
        [(0, "F", 27), (1, "F", 26), (2, "M", 41)], "id bigint, sex string, age bigint"
    )
    return FeatureTable.from_pair(train, test, SPEC)


def by_id(table, column, split="train"):
    rows = table.df.where(F.col("split") == split).select("id", column).collect()
    return {r[0]: r[1] for r in rows}


def test_one_hot(pair):
    out = encode.one_hot_levels(pair)
    assert sorted(out.features) == ["age", "sex_M"]
    assert set(by_id(out, "sex_M").values()) == {0, 1}
    assert out.df.count() == 8


def test_ordinal_codes_follow_declared_order(pair):
    out = encode.label_encode(pair)
    codes = by_id(out, "sex")
    assert codes[0] == 1 and codes[1] == 0
    assert out.spec["sex"].type == "NUMERIC"


def test_target_is_null_on_test_rows(pair):
    assert pair.test.where("kids IS NOT NULL").count() == 0
    assert dict(pair.df.dtypes)["age"] == "double"


def test_undeclared_level(spark, pair):
    odd = pair.with_columns({"sex": F.when(F.col("id") == 1, "X").otherwise(F.col("sex"))})
    with pytest.raises(ValueError):
        encode.label_encode(odd)
    assert by_id(encode.label_encode(odd, fail_on_unseen=False), "sex")[1] is None
    assert by_id(encode.one_hot_levels(odd), "sex_M")[1] == 0


def test_constant_source(pair):
    same = pair.with_columns({"sex": F.lit("M")})
    with pytest.raises(ValueError):
        encode.one_hot_levels(same)
    assert encode.one_hot_levels(same, strict=False).features == ["age"]
    assert encode.label_encode(same) is None
    assert cols.remove_constant_columns(same).features == ["age"]


def test_constant_with_nulls_is_kept(pair):
    mixed = pair.with_columns({"age": F.when(F.col("id") > 1, 5.0)})
    assert "age" in cols.remove_constant_columns(mixed).features


def test_category_unseen_in_train_gets_global_value(pair):
    odd = pair.with_columns(
        {"sex": F.when(F.col("split") == "test", "X").otherwise(F.col("sex"))}
    )
    out = encode.target_mean(odd, "sex")
    assert set(by_id(out, "sex", "test").values()) == {6 / 5}
    assert by_id(out, "sex")[0] == pytest.approx(1.0)
    assert [r.column for r in quality.unseen_categories(odd).collect()] == ["sex"] * 3


def test_constants_come_from_train_only(pair):
    moved = pair.with_columns(
        {"age": F.when(F.col("split") == "test", F.col("age") + 1000).otherwise(F.col("age"))}
    )
    for op in (numeric.zscore, numeric.robust_scale, numeric.quantile_uniform):
        a, b = op(pair, ["age"]), op(moved, ["age"])
        assert by_id(a, "age") == by_id(b, "age")


def test_zscore_moments(pair):
    z = numeric.zscore(pair, ["age"])
    row = z.train.agg(F.avg("age"), F.stddev_pop("age")).first()
    assert row[0] == pytest.approx(0, abs=1e-12) and row[1] == pytest.approx(1)
    flat = numeric.zscore(pair.with_columns({"age": F.lit(3.0)}), ["age"])
    assert set(by_id(flat, "age").values()) == {0.0}


def test_target_inverse(pair):
    out = numeric.scale_target(numeric.log1p(pair, "kids"))
    back = out.train.select("id", out.untransform(F.col("kids")).alias("y")).collect()
    want = by_id(pair, "kids")
    assert all(math.isclose(r["y"], want[r["id"]], abs_tol=1e-9) for r in back)


def test_no_test_split(spark, pair):
    only = FeatureTable.from_pair(pair.train.drop("split"), None, SPEC)
    assert encode.one_hot_levels(numeric.zscore(only, ["age"])).df.count() == 5
    assert quality.diagnose_nas(only) == 0


def test_repeated_quantile_edges(pair):
    lumpy = pair.with_columns({"age": F.when(F.col("id") < 3, 1.0).otherwise(F.col("age"))})
    assert numeric.quantile_bins(lumpy, {"age": 4}) is None
    marks = [0.0, 0.0, 0.0, 1.0, 2.0, 2.0]
    x = F.col("x")
    rows = pair.df.sparkSession.createDataFrame([(0.0,), (0.5,), (1.0,), (2.0,), (9.0,)], "x double")
    got = [r[0] for r in rows.select(numeric.landmark_position(x, marks)).collect()]
    assert got == pytest.approx([0.0, 0.5, 0.6, 1.0, 1.0])


def test_extract_value_needs_a_match(pair):
    assert numeric.extract_value(pair, "age", 99) is None
    assert numeric.poly_linearize(pair.with_columns({"age": F.lit(1.0)}), "age") is None


def test_fill_level_positions():
    spec = SchemaSpec(
        "id",
        "y",
        {
            "pool": ColumnSpec("CATEGORICAL", ("Fa", "Ex")),
            "alley": ColumnSpec("CATEGORICAL", ("NA", "Grvl")),
        },
    )
    assert spec.with_fill_level("pool", "None")["pool"].categories == ("Fa", "Ex", "None")
    assert spec.with_fill_level("pool", "None", 0)["pool"].categories == ("None", "Fa", "Ex")
    assert spec.with_fill_level("alley", "None")["alley"].categories == ("None", "Grvl")
    assert SchemaSpec.from_json(spec.to_json()) == spec


def test_yaml_levels_stay_text(tmp_path):
    path = tmp_path / "schema.yaml"
    path.write_text(
        "id: Id\ntarget: y\ncolumns:\n  e:\n    type: CATEGORICAL\n    meaningful_order: true\n"
        "    categories:\n    - NA\n    - 'No'\n    - No\n    - 120\n"
    )
    spec = SchemaSpec.from_yaml(str(path))
    assert spec["e"].categories == ("NA", "No", "No", "120") and spec["e"].meaningful_order


def test_names():
    assert safe_name("HouseStyle_1.5Fin") == "HouseStyle_1_5Fin"
    assert safe_name("Cond+Qual") == "Cond_Qual"


def test_failures_name_the_problem(pair):
    with pytest.raises(ValueError, match="found rows"):
        cols.fail_if_found(pair.df, F.col("age") > 40)
    cols.fail_if_found(pair.df, F.col("age") > 100)
    with pytest.raises(ValueError, match="all_numeric"):
        quality.require_ready(pair)
    quality.require_ready(encode.one_hot_levels(pair))
    with pytest.raises(Exception, match="unmapped value in sex"):
        encode.map_values(pair, {"sex": {"F": 0}}).df.collect()


def test_row_removal(pair):
    assert cols.drop_rows(pair, [0, 99]).df.count() == 7  # test row 0 stays
    ids = pair.train.where("age > 30").select("id")
    assert cols.drop_rows(pair, ids).train.count() == 3
    kept = cols.filter_not_value(pair, "sex", "M")
    assert kept.train.count() == 2 and kept.test.count() == 3


def test_conditional_fill_and_rules(pair):
    gaps = pair.with_columns({"sex": F.when(F.col("id") > 0, F.col("sex"))})
    out = missing.conditional_fill(gaps, "sex", ["age"], 0.0)
    assert by_id(out, "age")[0] == 0.0 and by_id(out, "age")[1] == 36
    filled = missing.fill_column(gaps, "sex", "None")
    assert filled.spec["sex"].categories == ("F", "M", "None")
    assert by_id(filled, "sex")[0] == "None"


def test_value_hits_and_nan(pair):
    bad = pair.with_columns(
        {"age": F.when(F.col("id") == 1, float("nan")).otherwise(F.col("age"))}
    )
    assert quality.has_nan(bad) and not quality.has_nan(pair)
    hits = quality.value_hits(bad, float("nan"), ["age"]).collect()
    assert {r["split"]: r["n_hits"] for r in hits} == {"train": 1, "test": 1}
    assert quality.sanity_rows(pair).count() == 0


def test_add_constant_target(pair):
    assert set(by_id(cols.add_constant_target(pair), "kids", "test").values()) == {0.0}


def test_rarity_lines(pair):
    report = quality.row_rarity(pair, max_categorical_pct=40, max_numeric_pct=20)
    lines = {(r["id"], r["kind"]): r["line"] for r in quality.rarity_lines(report).collect()}
    assert lines[1, "top"] == "Column age = 36.0 is in the top 20 % of the train set ( 1 )"
    assert lines[0, "bottom"] == "Column age = 12.0 is in the bottom 20 % of the train set ( 1 )"
    assert lines[4, "matches"] == "Column sex = F matches 40 % of the train set ( 2 )"
