import random
import zlib

import numpy as np
import pyarrow as pa

from plumbline.llm import toxicity as tox


def corpus(n=900, seed=1):
    r = random.Random(seed)
    plain = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        words = [r.choice(plain) for _ in range(r.randrange(5, 60))]
        bad = r.random() < 0.2
        if bad:
            for _ in range(2):
                words[r.randrange(len(words))] = "nasty" + r.choice(["", "ish", "ness", "er"])
        rows.append((i, " ".join(words), r.choice(["en", "fr"])))
        labels.append((i, int(bad)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    truth = dict(labels)
    out = tox.toxicity(docs, marks).collect()
    assert len(out) == len(rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    assert all(r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in out)
    assert all(r["flagged"] == (r["score"] >= r["threshold"]) for r in out)
    held = [r for r in out if r["held_out"]]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.9


def test_scores_do_not_depend_on_neighbours():
    rows, labels = corpus(120)
    net = tox.train([t for _, t, _ in rows], np.array([y for _, y in labels], np.float32), epochs=2)
    texts = [t for _, t, _ in rows[:20]] + ["", None, "!!", "one"]
    together = net.scores(*tox.features(pa.array(texts, pa.string())))
    alone = [net.scores(*tox.features(pa.array([t], pa.string())))[0] for t in texts]
    assert np.allclose(together, alone, atol=1e-5)


def test_filters_against_plain_loops():
    net = tox.Network()
    ids, first = tox.features(pa.array(["a b c d", "e", "f g"]))
    x, values = net.hidden(ids, first)
    want = np.zeros_like(values)
    for a, b in zip(first[:-1], first[1:], strict=True):
        for i in range(a, b):
            at = 0
            for w in range(tox.WIDTHS):
                for k in range(w + 1):
                    if i + k < b:
                        want[i, w * tox.FILTERS : (w + 1) * tox.FILTERS] += x[i + k] @ net.filters[:, at]
                    at += 1
    assert np.allclose(values, want, atol=1e-5)


def test_messy_rows(spark, messy, nothing):
    labels = spark.createDataFrame([(4, 1, 9), (5, 0, 9), (None, 1, 9), (6, None, 9), (4, 0, 9)], "doc_id long, toxic int, text int")
    out = tox.toxicity(messy, labels).collect()
    assert len(out) == messy.count() and all(0 <= r["score"] <= 1 for r in out)
    bare = {r["score"] for r in out if r["doc_id"] in (1, 2, 3)}
    assert len(bare) == 1
    assert {r["score"] for r in tox.toxicity(messy, labels.limit(0)).collect()} == {0.5}
    assert tox.toxicity(nothing, labels).collect() == []


def test_threshold():
    score = np.array([0.9, 0.8, 0.4, 0.2])
    assert 0.4 < tox.threshold(score, np.array([1, 1, 0, 0])) < 0.8
    assert tox.threshold(score, np.zeros(4)) == tox.PREDICTED


def test_every_labelled_row_is_learned_from(spark, monkeypatch):
    """A word outside the rows to start from, in texts of any length, moves the score."""
    rows, labels = corpus(600)
    monkeypatch.setattr(tox, "SHARD_ROWS", 150)
    monkeypatch.setattr(tox, "LABELLED_CHARS", 2_000)
    long = [(10_000 + i, "filler " * 400 + ("rarebad" if i % 2 else "raregood"), "en") for i in range(80)]
    docs = spark.createDataFrame([*rows, *long], "doc_id long, text string, lang string").repartition(6)
    marks = spark.createDataFrame([*labels, *((i, int("rarebad" in t)) for i, t, _ in long)], "doc_id long, toxic int")
    net, found = tox.fit(docs, marks, rows=200)
    score = net.scores(*tox.features(pa.array(["filler " * 400 + w for w in ("rarebad", "raregood")])))
    assert score[0] > score[1] + 0.05
    assert set(found) == {"en", "fr"}
    assert len(tox.toxicity(docs, marks, rows=200).collect()) == 680


def test_threshold_of_counts():
    counts, hits = np.zeros(100), np.zeros(100)
    counts[[20, 40, 80, 90]], hits[[80, 90]] = 5, 5
    assert 0.41 <= tox.threshold_of(counts, hits) <= 0.8
    assert tox.threshold_of(counts, np.zeros(100)) == tox.PREDICTED


def test_texts_meet_their_labels_once(spark, monkeypatch):
    """One merge join at any size: its figures on small tables hold for large ones."""
    rows, labels = corpus(120)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    plans, whole = [], type(docs).join

    def joined(self, other, *args, **kwargs):
        out = whole(self, other, *args, **kwargs)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(type(docs), "join", joined)
    tox.fit(docs, marks, rows=40)
    assert len(plans) == 1 and "SortMergeJoin" in plans[0]
