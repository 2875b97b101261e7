"""Cell differences and counts of incomplete rows on hand-made tables."""

from plumbline import ColumnSpec, FeatureTable, SchemaSpec
from plumbline.operators import columns, quality


def test_cell_difference_counts_both_ways(spark):
    left = spark.createDataFrame([("a", 1), ("a", 2), (None, 2)], "x string, y int")
    right = spark.createDataFrame([("a", 1), (None, 7), (None, 8)], "x string, y long")
    got = sorted(map(tuple, columns.cell_difference(left, right).collect()), key=str)
    want = [
        ("only_left", "x", "string", "a", 1), ("only_right", "x", "string", None, 1),
        ("only_left", "y", "int", "1", 1), ("only_left", "y", "int", "2", 2),
        ("only_right", "y", "bigint", "1", 1), ("only_right", "y", "bigint", "7", 1), ("only_right", "y", "bigint", "8", 1),
    ]
    assert got == sorted(want, key=str)
    assert columns.cell_difference(left, left).count() == 0
    assert columns.cell_difference(left.limit(0), left.limit(0)).count() == 0


def test_sanity_counts(spark):
    nan = float("nan")
    rows = [
        (1, "a", 1.0, 2.0, "train"), (2, None, nan, 2.0, "train"), (3, "b", 1.0, None, "train"),
        (4, "b", None, None, "test"), (5, "b", nan, None, "test"),
    ]
    df = spark.createDataFrame(rows, "id long, t string, v double, y double, split string")
    spec = SchemaSpec("id", "y", {"t": ColumnSpec("CATEGORICAL", ("a", "b")), "v": ColumnSpec()})
    got = {r.split: (r.n_rows, r.n_incomplete, r.n_nan) for r in quality.sanity_counts(FeatureTable(df, spec)).collect()}
    assert got == {"train": (3, 2, 1), "test": (2, 1, 1)}
