"""Levels that stay in a table, and candidate sets that are fitted in tasks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import columns, encode, sampling
from plumbline.plans import dictionary, search
from plumbline.plans.gram import lasso, ols
from plumbline.spec import ColumnSpec, SchemaSpec
from plumbline.table import FeatureTable


@pytest.fixture(scope="module")
def wide(spark):
    """More levels than are written into a plan; a hot level, a null, one level only in test."""
    n = dictionary.LITERAL_LEVELS + 201
    rows = [(i, f"v{i % n:05d}" if i % 3 else "hot", "ab"[i % 2], float(i % 7), "train") for i in range(2 * n)]
    rows += [(-1, None, "a", None, "test"), (-2, "z only here", "b", None, "test")]
    df = spark.createDataFrame(rows, "id bigint, c string, d string, y double, split string")
    spec = {"c": ColumnSpec("CATEGORICAL"), "d": ColumnSpec("CATEGORICAL", ("a", "b"))}
    return FeatureTable(df.cache(), SchemaSpec("id", "y", spec))


@pytest.mark.parametrize("small", [0, 1_000_000])
def test_codes_are_dense_ranks(wide, small):
    got = dictionary.dictionary(wide.df, ["c", "d"], small).collect()
    values = sorted({r["c"] for r in wide.df.collect()} - {None})
    want = {("c", v, i) for i, v in enumerate(values)} | {("d", "a", 0), ("d", "b", 1)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("rows", [10, 100_000])
def test_label_encoding_without_declared_levels(wide, monkeypatch, rows):
    monkeypatch.setattr(dictionary, "BROADCAST_ROWS", rows)
    values = sorted({r["c"] for r in wide.df.collect()} - {None})
    code = {v: float(i) for i, v in enumerate(values)}
    out = encode.label_encode(wide, fail_on_unseen=False)
    assert out.df.columns == wide.df.columns
    source = {r["id"]: r for r in wide.df.collect()}
    for r in out.df.collect():
        assert r["c"] == code.get(source[r["id"]]["c"])
        assert r["d"] == "ab".index(source[r["id"]]["d"])
    with pytest.raises(ValueError, match="outside"):
        encode.label_encode(wide)


def test_only_few_levels_are_declared(wide):
    found = encode.declared_levels(wide, ["c", "d"])
    assert found == {"c": (), "d": ("a", "b")}
    assert encode.declared_levels(wide, ["d"], limit=1) == {"d": ()}
    assert encode.declared_levels(wide.with_df(wide.df.where("id > 1e9")), ["c"]) == {"c": ()}
    assert encode.to_categorical(wide, "id").spec["id"].categories == ()
    spec = wide.spec.with_column("y2", ColumnSpec(possibly_categorical=True))
    table = FeatureTable(wide.df.withColumn("y2", F.col("y") + 1), spec)
    assert len(columns.explode_types(table).spec["y2_categorical"].categories) == 7


@pytest.mark.parametrize("stat", ["mean", "median"])
def test_joined_statistics(wide, stat):
    rows = wide.df.toPandas()
    train = rows[rows["split"] == "train"]
    out = encode.target_stats_all(wide, stat=stat).df.toPandas().set_index("id")
    for c in ("c", "d"):
        known = train.groupby(c)["y"].agg(stat)
        want = rows.set_index("id")[c].map(known).fillna(train["y"].agg(stat))
        assert np.allclose(out[c].loc[want.index].astype(float), want)


def test_variants_of_wide_categories(wide):
    v = search.Variant("c", "target_mean")
    out, made = search.apply_variant(wide, v)
    assert set(out.df.columns) == {*wide.df.columns, *made}
    with pytest.raises(ValueError, match="variant_table"):
        search.variant_columns(wide, [v])
    variants = [v, search.Variant("c", "target_median"), search.Variant("d", "target_mean")]
    encoded = search.encode_variants(wide, variants, sampling.hash_fold("id", 4))
    assert v in encoded.columns


@pytest.fixture(scope="module")
def encoded(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 5)).round(3)
    y = x[:, 0] * 2 - x[:, 1] + 0.3 * x[:, 2] ** 2 + rng.normal(size=400)
    rows = [(i, *map(float, r), float(t), "train") for i, (r, t) in enumerate(zip(x, y))]
    names = ["p", "q", "r", "s", "t"]
    schema = "id bigint, " + ", ".join(f"{n} double" for n in names) + ", y double, split string"
    table = FeatureTable(
        spark.createDataFrame(rows, schema), SchemaSpec("id", "y", {n: ColumnSpec() for n in names})
    )
    return search.encode_variants(table, search.all_variants(table), sampling.hash_fold("id", 4))


@pytest.mark.parametrize("recipe", [lasso(0.01), ols()])
def test_scores_of_many_sets_equal_single_ones(encoded, recipe):
    known = list(encoded.columns)
    others = [v for v in known if v.column != known[0].column]
    sets = [[known[0], v] for v in others] + [[search.Variant("p", "no_such")], known[:1]]
    # 700 candidates and more, most of them several times
    many = sets * (700 // len(sets) + 1)
    got = encoded.scores(many, recipe)
    assert len(got) == len(many) >= 700
    want = [encoded.score(vs, recipe) for vs in sets]
    assert got == want * (len(many) // len(sets))
    assert encoded.scores([], recipe) == []
    assert encoded.scores([[search.Variant("p", "no_such")]], recipe) == [search.FAIL_SCORE]


def test_same_winners(encoded):
    open_ = search.unused_columns(list(encoded.columns))
    one = search.forward_select(open_, lambda sets: [encoded.score(vs, lasso(0.01)) for vs in sets])
    two = search.forward_select(open_, lambda sets: encoded.scores(sets, lasso(0.01)))
    assert one.equals(two)
