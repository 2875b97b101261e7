"""Toxicity by a small convolutional network, trained in numpy on all labelled rows.

A word is the sum of hashed embeddings: of itself and of its first bytes, so that inflected forms
share.  Filters over one, two and three words run over the whole text, each keeps its maximum, and
one linear layer makes the score.  Scoring is one pass without a shuffle.  A threshold for each
language is calibrated on the labelled rows that were not trained on, a fifth; the language chooses
the threshold and never enters the score.

Few labelled rows are learned from on the driver.  Of many, some chosen by hash give the network to
start from; in each of the rounds then every task goes on with it over all of its rows, and the
changes are averaged: those of a word's embedding over the tasks that met the word, the others by rows.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import Tables, Words, text_slices

LABELLED_ROWS = 6_000  # most rows that the driver learns from, about
LABELLED_CHARS = 20_000  # in longer texts, and in more rows, only tasks learn
ROUNDS, ROUND_RATE = 2, 0.003  # over all rows; the rate of the first round
SHARD_ROWS = 4_000  # labelled rows a task learns from, at least
MERGE_TASKS = 4
CALIBRATES = 5  # one labelled row of so many
GRID = 4_096  # steps between which a threshold may lie
LANGUAGES = 500
PREDICTED = 0.3
FOLDS, HELD_OUT = 4, 2
HEADS = (4, 5, 6)
BUCKETS, SIZE, FILTERS, WIDTHS = 1 << 15, 16, 16, 3
EPOCHS, BATCH, RATE = 6, 32, 0.01
SPREAD = 1 << 30
SCHEMA = "doc_id long, lang string, score double"
# ASCII other than letters and digits parts words; bytes of other characters are letters
SEPARATORS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers (words x hashes), and where each row's words begin, with the end."""
    words = Words(column, SEPARATORS, lower=True)
    hashes = [words.hash, *(words.heads(n) + np.uint64(n) for n in HEADS)]
    ids = np.stack([(h >> np.uint64(40)) % np.uint64(BUCKETS) for h in hashes], 1)
    return ids.astype(np.int32), words.first


class Network:
    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        self.embed = r.normal(0, 0.1, (BUCKETS, SIZE)).astype(np.float32)
        self.filters = r.normal(0, 0.3, (SIZE, WIDTHS * (WIDTHS + 1) // 2, FILTERS)).astype(np.float32)
        self.out = r.normal(0, 0.1, WIDTHS * FILTERS).astype(np.float32)
        self.shift = np.zeros(WIDTHS * FILTERS, np.float32)
        self.bias = np.zeros(1, np.float32)

    def hidden(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word vectors, and every filter's value at every word (words x filters)."""
        x = self.embed[ids[:, 0]]
        for k in range(1, ids.shape[1]):
            x += self.embed[ids[:, k]]
        parts = (x @ self.filters.reshape(SIZE, -1)).reshape(len(x), -1, FILTERS)
        ends = np.repeat(first[1:], np.diff(first))
        values = np.zeros((len(x), WIDTHS, FILTERS), np.float32)
        at = 0
        for w in range(WIDTHS):
            for k in range(w + 1):
                n = len(x) - k
                if n > 0:  # words behind the text's end count as zero
                    inside = (np.arange(n) + k < ends[:n])[:, None]
                    values[:n, w] += parts[k:, at] * inside
                at += 1
        return x, values.reshape(len(x), -1)

    def scores(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Score of every row; a row without words has no filter active."""
        top = np.zeros((len(first) - 1, WIDTHS * FILTERS), np.float32)
        some = np.flatnonzero(np.diff(first))
        if len(some):
            top[some] = np.maximum.reduceat(self.hidden(ids, first)[1], first[some], axis=0)
            top[some] = np.maximum(top[some] + self.shift, 0)
        return 1 / (1 + np.exp(-(top @ self.out + self.bias[0]).astype(np.float64)))

    def step(self, ids, first, labels, memory, rate) -> None:
        """One step of adaptive gradient descent; gradients flow to the maxima alone."""
        x, values = self.hidden(ids, first)
        rows = len(labels)
        peak = np.zeros((rows, WIDTHS * FILTERS), int)
        top = np.zeros((rows, WIDTHS * FILTERS), np.float32)
        for b in range(rows):
            if first[b + 1] > first[b]:
                own = values[first[b] : first[b + 1]]
                peak[b] = own.argmax(0)
                top[b] = own[peak[b], np.arange(own.shape[1])]
                peak[b] += first[b]
        active = np.maximum(top + self.shift, 0)
        score = 1 / (1 + np.exp(-(active @ self.out + self.bias[0])))
        error = ((score - labels) / rows).astype(np.float32)
        back = error[:, None] * self.out * (active > 0)
        grads = {"out": error @ active, "bias": error.sum(keepdims=True), "shift": back.sum(0)}
        filters = np.zeros_like(self.filters)
        where, what = [], []
        at = 0
        ends = first[1:]
        for w in range(WIDTHS):
            mine = slice(w * FILTERS, (w + 1) * FILTERS)
            for k in range(w + 1):
                pos = peak[:, mine] + k
                g = back[:, mine] * (pos < ends[:, None])
                pos = np.minimum(pos, max(0, len(x) - 1))
                if len(x):
                    filters[:, at] += np.einsum("bfd,bf->df", x[pos], g)
                    live = np.nonzero(g)
                    where.append(ids[pos[live]])
                    what.append(g[live][:, None] * self.filters[:, at].T[live[1]])
                at += 1
        grads["filters"] = filters
        for name, g in grads.items():
            past = memory.setdefault(name, np.full_like(g, 1e-8))
            past *= 0.95
            past += 0.05 * g * g
            getattr(self, name)[...] -= rate * g / np.sqrt(past)
        if where:
            where, what = np.concatenate(where), np.concatenate(what)
            for k in range(where.shape[1]):
                rows_, inverse = np.unique(where[:, k], return_inverse=True)
                total = np.zeros((len(rows_), SIZE), np.float32)
                np.add.at(total, inverse, what)
                past = memory.setdefault("embed", np.full(BUCKETS, 1e-8, np.float32))
                past[rows_] += (total * total).mean(1)
                self.embed[rows_] -= 5 * rate * total / np.sqrt(past[rows_])[:, None]


def train(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 5, memory: dict | None = None) -> Network:
    """``memory`` receives the sums of squared gradients."""
    net = Network()
    if not len(labels):
        net.out[:] = 0
        return net
    share = np.clip(labels.mean(), 0.001, 0.999)
    net.bias[0] = np.log(share / (1 - share))
    parts = [features(pa.array([t])) for t in texts]
    r = np.random.default_rng(seed)
    memory = {} if memory is None else memory
    # few labels are gone over more often
    epochs = max(epochs, min(30, epochs * 3000 // len(labels)))
    for turn in range(epochs):
        order = r.permutation(len(labels))
        for at in range(0, len(order), BATCH):
            own = order[at : at + BATCH]
            ids = np.concatenate([parts[i][0] for i in own])
            first = np.cumsum([0, *(parts[i][0].shape[0] for i in own)])
            net.step(ids, first, labels[own], memory, RATE * (1 - turn / (epochs + 1)))
    return net


def threshold(scores: np.ndarray, labels: np.ndarray) -> float:
    """The score from which on the balance of precision and recall (F1) is best."""
    if not labels.any():
        return PREDICTED
    order = np.argsort(-scores, kind="stable")
    hits = np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + labels.sum())
    ends = np.flatnonzero(np.append(np.diff(scores[order]) != 0, True))
    best = ends[np.argmax(f1[ends])]
    below = scores[order[best + 1]] if best + 1 < len(order) else 0.0
    return float((scores[order[best]] + below) / 2)


def held_out(doc_id="doc_id"):
    return F.coalesce(
        F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False)
    )


def threshold_of(counts: np.ndarray, hits: np.ndarray) -> float:
    """``threshold`` from rows and toxic rows by grid step of the score, from 0 up."""
    if not hits.any():
        return PREDICTED
    caught = np.cumsum(hits[::-1])[::-1]
    f1 = 2 * caught / (np.cumsum(counts[::-1])[::-1] + hits.sum())
    best = int(len(f1) - 1 - np.argmax(np.where(counts > 0, f1, 0.0)[::-1]))
    below = np.flatnonzero(counts[:best])
    return float((best + (below[-1] + 1 if len(below) else 0)) / 2 / len(counts))


def calibrates(doc_id="doc_id"):
    return F.pmod(F.xxhash64(doc_id), F.lit(CALIBRATES)) == 0


PARTS = ("filters", "out", "shift", "bias")


def learn_round(net: Network, memory: dict, learned: DataFrame, rate: float) -> Network:
    """The network after every task has gone over its rows (text, toxic) once."""
    shared = learned.sparkSession.sparkContext.broadcast((net, memory))  # of fixed size
    width = BUCKETS * (SIZE + 1) + sum(getattr(net, p).size for p in PARTS) + 1

    def packed(total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, past = shared.value
        own, past = copy.deepcopy(start), copy.deepcopy(past)
        rows = 0
        for part in text_slices(batches, "text", 1 << 19):
            ids, first = features(part["text"])
            labels = part["toxic"].to_numpy(zero_copy_only=False).astype(np.float32)
            for at in range(0, len(labels), BATCH):
                ends = first[at : at + BATCH + 1]
                own.step(ids[ends[0] : ends[-1]], ends - ends[0], labels[at : at + BATCH], past, rate)
            rows += len(labels)
        if rows:
            moved = own.embed - start.embed
            met = moved.any(axis=1)
            rest = [(getattr(own, p) - getattr(start, p)).ravel() * float(rows) for p in PARTS]
            yield packed(np.concatenate([moved.ravel(), met, *rest, [rows]]).astype(np.float64))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            for v in batch["v"]:
                total += np.frombuffer(v.as_buffer())
        yield packed(total)

    changes = learned.mapInArrow(go, "v binary").repartition(MERGE_TASKS).mapInArrow(merge, "v binary")
    total = sum((np.frombuffer(r["v"]) for r in changes.collect()), np.zeros(width))
    shared.destroy()
    out, rows = copy.deepcopy(net), max(total[-1], 1.0)
    embed, met = total[: BUCKETS * SIZE].reshape(BUCKETS, SIZE), total[BUCKETS * SIZE : BUCKETS * (SIZE + 1)]
    out.embed += (embed / np.maximum(met, 1.0)[:, None]).astype(np.float32)
    at = BUCKETS * (SIZE + 1)
    for p in PARTS:
        value = getattr(out, p)
        value += (total[at : at + value.size] / rows).reshape(value.shape).astype(np.float32)
        at += value.size
    return out


def fit(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS):
    """A network and thresholds by language, from all labelled rows.

    Held-out rows, and those with null text or label, are not learned from.  Of a doc_id with
    several labels, toxic counts.  More than about ``rows`` rows, or longer texts, are learned
    from in tasks.
    """
    known = labels.where(F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(
        F.max("toxic").cast("int").alias("toxic")
    )
    size = known.count()
    share = int(min(1.0, rows / max(1, size)) * SPREAD)
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text", F.col("lang").cast("string"))
    # texts meet their labels once, by the same join at any size, since labels grow with the texts
    tables = Tables(docs.sparkSession)
    every = tables.store(texts.join(known.hint("merge"), "doc_id").withColumn("calibrates", calibrates()))
    some = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(SPREAD)) < share
    start = every.where((F.length("text") <= LABELLED_CHARS) & some)
    start = start.limit(2 * rows).toArrow().sort_by("doc_id")
    text, label = start["text"].to_pylist(), np.array(start["toxic"].to_pylist(), np.float32)
    kept = ~np.array(start["calibrates"].to_pylist(), bool)
    memory: dict[str, np.ndarray] = {}
    net = train([t for t, k in zip(text, kept, strict=True) if k], label[kept], memory=memory)
    if every._rows > len(text):
        learned = every.where(~F.col("calibrates")).select("text", "toxic")
        learned = learned.coalesce(max(1, every._rows // SHARD_ROWS))
        for turn in range(ROUNDS):
            net = learn_round(net, memory, learned, ROUND_RATE / (turn + 1))
    limits = thresholds(net, every.where("calibrates"))
    tables.drop(every)
    return net, limits


def thresholds(net: Network, rows: DataFrame) -> dict[str, float]:
    """Threshold of every language, from all the given rows (text, lang, toxic)."""
    shared = rows.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text", 1 << 20):
            step = np.minimum(shared.value.scores(*features(part["text"])) * GRID, GRID - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part["lang"], part["toxic"], pa.array(step)], ["lang", "toxic", "step"])

    scored = rows.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), "text", "toxic")
    steps = scored.mapInArrow(run, "lang string, toxic int, step int").groupBy("lang", "step").agg(
        F.count("*").alias("n"), F.sum("toxic").alias("hits")
    )
    names = rows.select("lang").distinct().limit(LANGUAGES + 1).count()
    if names > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} language labels")
    counts: dict[str, np.ndarray] = {}
    for r in steps.collect():
        own = counts.setdefault(r["lang"], np.zeros((2, GRID)))
        own[:, r["step"]] = r["n"], r["hits"]
    return {n: threshold_of(*counts[n]) for n in sorted(counts)}


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> DataFrame:
    """Score of every row: doc_id, held_out, score, predicted, threshold, flagged.

    ``predicted`` is 1 from a score of 0.3 on; ``flagged`` compares with the language's threshold
    (0.3 for a null or unseen language).  Null, empty and wordless texts get the score of no
    evidence.  Without labels every score is 0.5.  Texts of any length are read whole.  Repeated
    rows are scored alike; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    net, limits = fit(docs, labels, rows)
    shared = spark.sparkContext.broadcast(net)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text", 1 << 20):
            score = shared.value.scores(*features(part["text"]))
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], part["lang"], pa.array(score)], ["doc_id", "lang", "score"]
            )

    source = docs.selectExpr("cast(doc_id as long) doc_id", "cast(lang as string) lang", "text")
    scored = source.mapInArrow(run, SCHEMA)
    own = F.lit(PREDICTED)
    for name, value in limits.items():
        own = F.when(F.coalesce("lang", F.lit("")) == name, value).otherwise(own)
    scored = scored.withColumn("threshold", own)
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score",
        (F.col("score") >= PREDICTED).cast("int").alias("predicted"),
        "threshold", (F.col("score") >= F.col("threshold")).alias("flagged"),
    )
