import numpy as np
import pytest

from plumbline.llm.neighbours import Forest, calibrated, nearest


def expected(rows, every, k):
    good = [(i, np.array(v, float)) for i, v in rows
            if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    sizes = [len(v) for _, v in good]
    dims = max(set(sizes), key=lambda n: (sizes.count(n), -n)) if sizes else 0
    good = [(i, v) for i, v in good if len(v) == dims]
    lists = {}
    for q, v in good:
        if q % every == 0:
            for i, w in good:
                if i != q:
                    total = 0.0
                    for a, b in zip(w, v, strict=True):
                        total += (a - b) * (a - b)
                    d = float(np.sqrt(total))
                    own = lists.setdefault(q, {})
                    own[i] = min(own.get(i, np.inf), d)
    out = []
    for q, own in lists.items():
        for rank, (i, d) in enumerate(sorted(own.items(), key=lambda x: (x[1], x[0]))[:k], 1):
            out.append((q, rank, i, d))
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, v string, leaf int")


def test_messy_rows_are_exact(spark):
    r = np.random.default_rng(0)
    rows = [(i, [float(x) for x in r.integers(-3, 4, 5)]) for i in range(300)]
    rows += [(400, None), (401, []), (402, [0.0] * 5), (403, [1.0, None, 1.0, 1.0, 1.0]),
             (404, [float("nan")] * 5), (405, [float("inf"), 1.0, 1.0, 1.0, 1.0]), (410, [1.0, 2.0]),
             (None, [1.0] * 5), (20, [9.0, 9.0, 9.0, 9.0, 9.0]), (30, list(rows[30][1]))]
    rows += [(1000 + i, [1.0, 1.0, 0.0, 0.0, 1.0]) for i in range(150)]  # one hot vector
    df = table(spark, [(i, v, 1, "v", 2) for i, v in rows])
    got = sorted(map(tuple, nearest(df, every=10, k=10).collect()))
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    assert got == expected(rows, 10, 10)


def test_few_and_no_rows(spark):
    df = table(spark, [(0, [1.0, 2.0], 1, "v", 2), (1, [1.0, 3.0], 1, "v", 2)])
    assert list(map(tuple, nearest(df).collect())) == [(0, 1, 1, 1.0)]
    assert nearest(df.where("vec_id < 0")).collect() == []
    assert nearest(df.where("vec_id = 0")).collect() == []


def test_recall_without_visiting_all(spark):
    r = np.random.default_rng(2)
    centres = r.normal(size=(30, 16))
    points = (centres[r.integers(0, 30, 3000)] + 0.5 * r.normal(size=(3000, 16))).astype(np.float32)
    df = table(spark, [(i, p.tolist(), 1, "v", 2) for i, p in enumerate(points)])
    got = nearest(df, every=50, k=10, sample=1000, least=0).collect()
    found = {(x["query_id"], x["vec_id"]) for x in got}
    wide = points.astype(float)
    hit = total = 0
    for q in range(0, 3000, 50):
        d = ((wide - wide[q]) ** 2).sum(1)
        d[q] = np.inf
        hit += sum((q, int(i)) in found for i in np.argsort(d)[:10])
        total += 10
    assert hit / total >= 0.9


def test_walk_reaches_every_leaf_once():
    points = np.random.default_rng(1).normal(size=(500, 8))
    forest = Forest(points, trees=3, leaf=16)
    order = list(forest.walk(points[3]))
    assert sorted(order) == list(range(forest.first[-1]))
    assert set(order[:3]) & set(forest.leaves_of(points[3:4])[0].tolist())
    assert 0 < calibrated(forest, points, 10) <= 1


def test_equal_points_make_one_leaf():
    forest = Forest(np.ones((200, 4)), trees=2, leaf=8)
    assert forest.first[-1] == 2


@pytest.mark.parametrize("k", [1, 3])
def test_other_k(spark, k):
    df = table(spark, [(i, [float(i), 1.0], 1, "v", 2) for i in range(12)])
    got = sorted(map(tuple, nearest(df, every=5, k=k).collect()))
    assert got == expected([(i, [float(i), 1.0]) for i in range(12)], 5, k)
