"""Nearest neighbours through boxes against all distances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import joins
from plumbline.plans import boxes

SCHEMA = "id long, a double, b double, c double"


def rows_of(kind, n=1500):
    r = np.random.default_rng(6)
    x = r.normal(size=(n, 3))
    if kind == "clustered":
        x = x * 0.05 + r.integers(0, 6, (n, 3))
    if kind == "equal":  # a third of the rows at one point, and many ties
        x = r.integers(0, 4, (n, 3)).astype(float)
        x[: n // 3] = 1.0
    return x


def by_hand(x, p, ids, k, own=None):
    d = np.sqrt(((x - p) ** 2).sum(axis=1))
    if own is not None:
        d[ids == own] = np.inf
    at = np.lexsort((ids, d))[:k]
    return [(int(ids[i]), d[i]) for i in at if np.isfinite(d[i])]


@pytest.mark.parametrize("kind", ["spread", "clustered", "equal"])
@pytest.mark.parametrize("few", [boxes.FEW, 0])
def test_neighbours_equal_all_distances(spark, kind, few):
    x = rows_of(kind)
    data = [(i, *map(float, row)) for i, row in enumerate(x)]
    train = spark.createDataFrame([*data, (9999, None, 1.0, 1.0)], SCHEMA).repartition(5)
    probes = spark.createDataFrame([*data[:150], (5000, 40.0, -3.0, 0.5), (5001, None, 0.0, 0.0)], SCHEMA)
    got = {}
    sizes = {} if few else {"block_rows": 40, "chunk_rows": 100}
    found = joins.nearest_neighbors(probes, train, "id", ["a", "b", "c"], 4, [1.0, 2.0, 0.5], few=few, **sizes)
    for r in found.collect():
        got.setdefault(r.probe_id, []).append((r.rank, r.neighbor_id, r.distance))
    scale, ids = np.array([1.0, 2.0, 0.5]), np.arange(len(x))
    assert set(got) == {*range(150), 5000}
    for i, own in got.items():
        p = np.array([40.0, -3.0, 0.5]) if i == 5000 else x[i]
        want = by_hand(x * scale, p * scale, ids, 4, i)
        own = sorted(own)
        assert [n for _, n, _ in own] == [n for n, _ in want]
        np.testing.assert_allclose([d for *_, d in own], [d for _, d in want])


def test_most_boxes_are_left_out(spark):
    x = rows_of("clustered", 4000)
    rows = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], SCHEMA)
    seen = spark.sparkContext.accumulator(0)
    search = boxes.Search("id", None, ["a", "b", "c"], None, 3, True)
    plain = search.nearest

    def counted(a, b):
        seen.add(len(a) * len(b))
        return plain(a, b)

    search.nearest = counted
    probes = rows.where("id < 400").withColumn("__probe", F.col("id"))
    found = boxes.by_boxes(search, rows, probes, 4000, 60, 50).collect()
    assert len({r["__probe"] for r in found}) == 400
    assert seen.value < 400 * 4000 / 8


def test_planes_cut_evenly_and_take_equal_points():
    x = rows_of("spread", 4000)
    planes = boxes.Planes(x, 64)
    counts = np.bincount(planes.box_of(x), minlength=planes.boxes)
    assert planes.boxes == 64 and counts.min() > 40 and counts.max() < 90
    one = boxes.Planes(np.ones((50, 2)), 8)
    assert one.boxes == 1 and set(one.box_of(np.zeros((3, 2)))) == {0}
    assert boxes.Planes(np.zeros((0, 2)), 8).boxes == 1


def test_no_probes_and_no_rows(spark):
    rows = spark.createDataFrame([(1, 0.0, 0.0, 0.0)], SCHEMA)
    for few in (boxes.FEW, 0):
        for probes, train in ((rows.limit(0), rows), (rows, rows.limit(0)), (rows, rows)):
            assert joins.nearest_neighbors(probes, train, "id", ["a", "b"], 2, few=few).count() == 0


def test_probes_meet_the_boxes_in_small_blocks(spark):
    x = rows_of("clustered", 3000)
    rows = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], SCHEMA)
    wide = spark.sparkContext.accumulator(0)
    search = boxes.Search("id", None, ["a", "b", "c"], None, 3, True)
    plain, most = search.points, boxes.TOGETHER

    def counted(part):
        wide.add(int("__probe" in part and len(part) > most))
        return plain(part)

    search.points = counted
    probes = rows.withColumn("__probe", F.col("id")).coalesce(1)
    found = boxes.by_boxes(search, rows, probes, 3000, 60, 50).collect()
    assert len({r["__probe"] for r in found}) == 3000 and wide.value == 0
