import math

import numpy as np
import pytest

from plumbline.llm import registry, whitening

VECTORS = "vec_id long, embedding array<float>, n int, x string, v int, id int"


def by_hand(rows, components=whitening.COMPONENTS):
    """(id, component) -> (n, deviation, whitened, explained), from the dense covariance matrix."""
    kept = [
        (i, [math.floor(256 * float(c)) for c in v]) for i, v in rows
        if v and all(c is not None and math.isfinite(c) for c in v)
    ]
    x = np.array(sorted({tuple(v) for _, v in kept}), float)
    n = len(x)
    total = [int(s) for s in x.sum(axis=0)]
    y = x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(y.T @ y / n)
    out = []
    for i, v in kept:
        deviation = sum((n * c - s) ** 2 for c, s in zip(v, total))
        centred = np.array(v) - x.mean(axis=0)
        for k in range(1, min(components, len(values)) + 1):
            white = centred @ vectors[:, -k] / math.sqrt(values[-k])
            out.append((i, k, n, deviation, white, values[-k] / values.sum()))
    return out


def compare(got, want):
    rows = [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained) for r in got]
    assert len(rows) == len(want)
    for k in {w[1] for w in want}:
        a = sorted((r for r in rows if r[1] == k), key=lambda r: (str(r[0]), r[3], abs(r[4])))
        b = sorted((r for r in want if r[1] == k), key=lambda r: (str(r[0]), r[3], abs(r[4])))
        assert [r[:4] for r in a] == [r[:4] for r in b]
        left, right = np.array([r[4] for r in a]), np.array([r[4] for r in b])
        left = left * np.sign(left @ right)  # either sign, the same for all rows
        np.testing.assert_allclose(left, right, rtol=1e-9, atol=1e-9)
        np.testing.assert_allclose([r[5] for r in a], [r[5] for r in b], rtol=1e-12)
    assert len({r.identity_error for r in got}) <= 1
    assert all(r.identity_error < 1e-10 for r in got)


def test_query(spark, folder):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()
    compare(registry.op13_embedding_whitening(spark, folder).collect(), by_hand(rows))


def test_messy_vectors(spark):
    random = np.random.default_rng(3)
    points = (random.standard_normal((40, 5)) * [5, 3, 2, 1, 0.5]).tolist()
    rows = [(i, p) for i, p in enumerate(points)]
    rows += [(3, points[3]), (100, points[0]), (None, points[1]), (101, [0.0] * 5), (102, [-0.0] * 5)]
    bad = [(200, None), (201, []), (202, [1.0, None, 2.0, 3.0, 4.0]), (203, [float("nan")] * 5)]
    bad += [(204, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (205, [1.0, 2.0])]
    table = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows + bad], VECTORS).repartition(4)
    got = whitening.whitened(table).collect()
    assert {r.vec_id for r in got}.isdisjoint({200, 201, 202, 203, 204, 205})
    floats = [(i, [float(np.float32(c)) for c in v]) for i, v in rows]
    compare(got, by_hand(floats))


def test_no_variance_gives_no_component(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert whitening.whitened(empty).count() == 0
    same = spark.createDataFrame([(i, [0.5, 1.5]) for i in range(4)], "vec_id long, embedding array<float>")
    assert whitening.whitened(same).count() == 0
    line = spark.createDataFrame([(i, [float(i), 0.0, 1.0]) for i in range(4)], "vec_id long, embedding array<float>")
    got = whitening.whitened(line).collect()
    assert sorted((r.vec_id, r.component) for r in got) == [(i, 1) for i in range(4)]
    assert got[0].explained == pytest.approx(1.0)


def test_large_numbers_stay_exact(spark):
    values = [[2.0**30, 1.0], [-(2.0**30), 5.0], [3.0, 2.0**25]]
    table = spark.createDataFrame(list(enumerate(values)), "vec_id long, embedding array<double>")
    got = {r.vec_id: r.deviation for r in whitening.whitened(table).collect() if r.component == 1}
    want = {i: d for i, k, _, d, *_ in by_hand(list(enumerate(values))) if k == 1}
    assert got == {i: d if d < 2**63 else None for i, d in want.items()}
    assert None in got.values()


@pytest.mark.parametrize(
    "spectrum",
    [np.linspace(1, 2, 300), np.r_[np.ones(6) * 3, np.ones(94)], np.r_[np.zeros(18), 1, 2], np.zeros(10), [4.0]],
)
def test_eigenpairs(spectrum):
    spectrum = np.asarray(spectrum, float)
    width = len(spectrum)
    turn = np.linalg.qr(np.random.default_rng(1).standard_normal((width, width)))[0]
    matrix = (turn * spectrum) @ turn.T
    pairs = whitening.jacobi_davidson(lambda v: matrix @ v, width, 4)
    top = np.sort(spectrum)[::-1][:4]
    np.testing.assert_allclose(pairs.values, top, atol=1e-13 * max(top[0], 1))
    rest = matrix @ pairs.vectors - pairs.vectors * pairs.values
    assert np.linalg.norm(rest, axis=0).max() <= 2e-14 * top[0] * np.sqrt(width)
    np.testing.assert_allclose(pairs.vectors.T @ pairs.vectors, np.eye(len(top)), atol=1e-13)


def test_minres_solves_shifted_systems():
    random = np.random.default_rng(2)
    turn = np.linalg.qr(random.standard_normal((12, 12)))[0]
    matrix = (turn * np.linspace(-3, 8, 12)) @ turn.T
    shifts, right = np.array([0.5, 2.2]), random.standard_normal((12, 2))
    x = whitening.minres(lambda v: matrix @ v, shifts, lambda z: z, right, 30)
    for k in range(2):
        np.testing.assert_allclose(matrix @ x[:, k] - shifts[k] * x[:, k], right[:, k], atol=1e-8)
