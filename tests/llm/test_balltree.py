import math
import re
from collections import Counter

import numpy as np
import pytest

from plumbline.llm import balltree, registry
from tests.llm.conftest import LONG

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_hand(docs, items, k=20):
    bags = [(i, Counter(TERM.findall(t.translate(LOWER)))) for i, t in docs if t is not None]
    bags = [(i, b) for i, b in bags if b]
    n_docs, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for t, d in df.items()}
    out = []
    for item, text in items:
        asked = Counter(TERM.findall((text or "").translate(LOWER)))
        scores = []
        for i, bag in bags:
            m = 75 + 25 * sum(bag.values()) * n_docs // length
            score = sum(
                q * weight[t] * (1_000_000_000 * bag[t] // (1000 * bag[t] + 12 * m))
                for t, q in asked.items() if t in bag
            )
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def benchmark(spark, folder):
    return spark.read.parquet(f"{folder}/benchmark.parquet")


@pytest.mark.parametrize("text", [LONG, "", "A-b Ünï日本, x1Y\x7f\x00z", " . ", "a" * 50, "Z " * 40])
def test_terms_of_stretches_are_those_of_the_text(text, monkeypatch):
    want = Counter(t.encode() for t in TERM.findall(text.translate(LOWER)))
    for size in (1, 7, 1000, 1 << 20):
        monkeypatch.setattr(balltree, "STRETCH", size)
        assert balltree.term_counts(text) == want


def matrix(random, rows, width, copies):
    lists = [random.choice(width, random.integers(1, width // 2), replace=False) for _ in range(rows)]
    for i in random.choice(rows, copies):
        lists[i] = lists[0]
    values = [random.integers(1, 1_000_000, len(c)) for c in lists]
    for i, c in enumerate(lists):
        if c is lists[0]:
            values[i] = values[0]
    start = np.concatenate([[0], np.cumsum([len(c) for c in lists])])
    dense = np.zeros((rows, width), np.int64)
    for i, (c, v) in enumerate(zip(lists, values)):
        dense[i, c] = v
    return dense, start, np.concatenate(lists).astype(np.int64), np.concatenate(values)


@pytest.mark.parametrize("seed", range(8))
def test_bounds_hold_and_the_best_are_found(seed):
    random = np.random.default_rng(seed)
    rows, width = int(random.integers(1, 300)), int(random.integers(4, 60))
    dense, start, col, val = matrix(random, rows, width, rows // 3)
    tree = balltree.Tree(start, col, val, width, leaf=4)
    assert sorted(tree.order.tolist()) == list(range(rows))
    for _ in range(6):
        terms = np.sort(random.choice(width, random.integers(1, width), replace=False))
        weight = random.integers(0, 20_000, len(terms))
        q = np.zeros(width, np.int64)
        q[terms] = weight
        scores = dense @ q
        bounds = tree.bounds(terms, weight)
        for node, (low, high) in enumerate(zip(tree.low, tree.high)):
            own = tree.order[low:high]
            assert bounds[node] >= scores[own].max()
            assert tree.scores(node, q).tolist() == scores[own].tolist()
        best = []
        tree.search(terms, weight, q, best, 5, [-i for i in range(rows)], [1] * rows)
        want = sorted(((int(s), -i) for i, s in enumerate(scores) if s > 0), reverse=True)[:5]
        assert sorted(((s, i) for s, _, i in best), reverse=True) == want


def test_similar_documents_are_pruned():
    random = np.random.default_rng(0)
    centres = random.integers(1, 1_000_000, (16, 64)) * (random.random((16, 64)) < 0.2)
    dense = np.repeat(centres, 64, axis=0)
    dense = np.where(dense > 0, dense + random.integers(0, 1000, dense.shape), 0)
    rows, cols = np.nonzero(dense)
    start = np.searchsorted(rows, np.arange(len(dense) + 1))
    tree = balltree.Tree(start, cols, dense[rows, cols], 64)
    terms = np.flatnonzero(centres[3])
    q = np.zeros(64, np.int64)
    q[terms] = 1000
    best = []
    seen = tree.search(terms, q[terms], q, best, 20, list(range(len(dense))), [1] * len(dense))
    assert seen < len(dense) / 4


def test_query_against_plain_loops(spark, folder, small, benchmark):
    docs = [(r.doc_id, r.text) for r in small.collect()]
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    assert rows_of(registry.op11_ranked_search(spark, folder)) == by_hand(docs, items)


def test_blocks_chunks_and_tasks_change_nothing(small, benchmark, monkeypatch):
    want = rows_of(balltree.ranked(small, benchmark, 7))
    got = balltree.ranked(small.repartition(5), benchmark.repartition(3), 7, block_terms=300)
    assert rows_of(got) == want


def test_messy_tables(spark, messy, nothing):
    items = [(1, "quick BROWN fox one"), (2, None), (3, ""), (4, "!!"), (5, "日本 c ünïcode"), (5, "word3 and12"),
             (None, "one one 12"), (6, LONG), (7, "nowhere")]
    asked = spark.createDataFrame([(*i, "x", 1) for i in items], "item_id long, text string, term string, n int")
    docs = [(r.doc_id, r.text) for r in messy.collect()]
    assert rows_of(balltree.ranked(messy, asked)) == by_hand(docs, items)
    assert balltree.ranked(nothing, asked).count() == 0
    assert balltree.ranked(messy, asked.limit(0)).count() == 0
    assert balltree.ranked(messy, asked.where("item_id in (2, 3, 7)")).count() == 0


def test_large_totals_stay_exact():
    tf, n = np.array([1, 5]), np.array([10**8, 3])
    got = balltree.saturated(tf, n, 10**12, 10**15)
    want = [10**9 * t // (1000 * t + 12 * (75 + 25 * x * 10**12 // 10**15)) for t, x in ((1, 10**8), (5, 3))]
    assert got.tolist() == want
