import itertools
import random

import numpy as np

from plumbline.llm import minhash
from plumbline.llm.minhash import minima, near_dedup, near_groups, packed, shingle_set


def expected(rows, percent=85):
    sets = {}
    for i, t in rows:
        if i is not None and t is not None:
            sets.setdefault(i, []).append(shingle_set(t))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        for x, y in itertools.product(sets[a], sets[b]):
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return {i: find(i) for i in sets}


def test_against_all_pairs(small):
    rows = [(r["doc_id"], r["text"]) for r in small.collect()]
    got = {r["doc_id"]: r for r in near_groups(small).collect()}
    want = expected(rows)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(got[i]["n_shingles"] == len(shingle_set(t)) for i, t in rows)
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())


def test_messy_rows(messy):
    rows = [(r["doc_id"], r["text"]) for r in messy.select("doc_id", "text").collect()]
    got = near_groups(messy)
    assert got.count() == len(rows)
    want = expected(rows)
    for r in got.collect():
        assert r["component_id"] == want.get(r["doc_id"], r["doc_id"])
    assert {r["n_shingles"] for r in got.where("doc_id in (1, 2, 3)").collect()} == {0}


def test_drifting_group_is_one_component(spark):
    # neighbours are alike, the ends are not: found only through links between different texts
    r = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows, now = [], list(words)
    for i in range(60):
        rows.append((i, " ".join(now)))
        at = r.randrange(len(now))
        now = [*now[:at], f"new{i}", *now[at + 1 :]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_groups(df, rounds=1).collect()}
    assert got == expected(rows)


def test_one_id_with_several_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (1, b), (2, a + " word"), (3, b + " word"), (4, c), (5, c + " word"), (5, "none"), (6, "none")]

    rows += [(7, a), (9, "short one"), (9, None), (10, "short one")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in near_groups(df).collect()}
    assert got == expected(rows) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 7: 1, 9: 9, 10: 9}
    rows += [(7, c)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in near_groups(df).collect()}
    assert got == expected(rows) and got[6] == 1


def test_empty_table(nothing):
    assert near_groups(nothing).collect() == []
    assert near_dedup(nothing).columns == nothing.columns


def test_corrected_estimate():
    r = np.random.default_rng(1)
    for share in (0.3, 0.6, 0.9):
        n = 4000
        both = int(n * share)
        x = r.integers(0, 2**63, 2 * n - both).astype(np.uint64)
        a, b = packed(minima(x[:n])), packed(minima(x[n - both :]))
        differ = a ^ b
        pairs = sum(bin(((int(d) & (2**64 - 1)) | ((int(d) & (2**64 - 1)) >> 1)) & 0x5555555555555555).count("1") for d in differ)
        total = minhash.BANDS * minhash.ROWS
        estimate = ((total - pairs) / total - 0.25) / 0.75
        assert abs(estimate - both / (2 * n - both)) < 0.15


def test_missed_pairs_are_rare():
    chance = (1 - 0.85**minhash.ROWS) ** minhash.BANDS
    assert chance < 1e-5


def test_sketches_differ_in_no_more_bits_than_the_sets():
    r = np.random.default_rng(2)
    for n, apart in ((20, 0), (200, 7), (200, 60), (3000, 900)):
        x = r.integers(0, 2**63, n + apart).astype(np.uint64)
        a, b = (minhash.odd_sketch(s).view(np.uint64) for s in (x[:n], x[apart:]))
        bits = sum(int(v).bit_count() for v in a ^ b)
        assert bits <= 2 * apart and (n > 300 or bits >= 1.6 * apart)


def test_unlike_texts_of_one_bucket_are_not_emitted(spark, monkeypatch):
    # every two of 120 texts have a similarity of 0.75 and most share a band
    words = [f"w{i}" for i in range(1500)]
    texts = [" ".join([*words[:200]][: 10 * (k % 19)] + [f"x{k}y{j}" for j in range(10)] + words[10 * (k % 19) + 10 : 200]) for k in range(120)]
    rows = list(enumerate(texts))
    emitted, whole = [], minhash.bucket_groups

    def counted(tables, buckets, traits, alike, confirmed, rounds):
        def watched(pairs):
            emitted.append(pairs.count())
            return confirmed(pairs)

        return whole(tables, buckets, traits, alike, watched, rounds)

    monkeypatch.setattr(minhash, "bucket_groups", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_groups(df).collect()}
    assert got == expected(rows)
    links = sum(100 * len(a & b) >= 85 * len(a | b) for a, b in itertools.combinations([shingle_set(t) for t in texts], 2))
    assert sum(emitted) <= 2 * links + 60
