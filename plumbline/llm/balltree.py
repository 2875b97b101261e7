"""Ranked lexical search as exact inner-product search in ball trees over sparse vectors.

A document's vector holds, per term, the saturated count of the ranking formula; it needs the
corpus totals only, so the vectors are made once, whatever is asked.  A query's vector holds the
term weights times the repeats, and the score is the inner product, in integers.

``term_table`` tokenises every document in one pass.  ``clustered`` orders the rows by a sketch of
their words, so that similar documents become neighbours.  ``ranked`` sends blocks of queries over
the table.  A task cuts its rows into chunks of bounded size; a chunk is projected on the block's
terms, which changes no score, and becomes a ball tree.  A node keeps the centroid of its
documents, the radius around it, and the largest entry of each term; a query's score in the subtree is
at most the smaller of

* centroid part + (length of the query) x (radius), and
* the sum over the query's terms of weight x largest entry,

both rounded up.  Nodes are opened best bound first until no bound reaches the query's k-th best
score of the task so far.  Equal bounds are opened, so ties are whole.  Leaves are scored in
integers.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.common import Tables, text_slices

RESULTS = 20
LEAF = 8  # documents a leaf holds, unless all of them are equal
CHUNK_ROWS, CHUNK_ENTRIES = 2048, 1 << 18  # of one tree; a single document may have more entries
BLOCK_TERMS = 1 << 18  # distinct terms of the items searched together, on average
STRETCH = 1 << 20  # bytes of a text that are tokenised at a time
SLACK = 1e-9  # relative rounding allowance of a bound, far above the errors of its sums
LONG = 1 << 63
_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
TERMS = "uid long, id long, sketch int, n long, terms array<binary>, counts array<long>"


def term_counts(text: str) -> Counter:
    """Terms of a text (UTF-8, A-Z lower-cased) with their counts, stretch by stretch."""
    data = text.encode("utf-8", "surrogatepass").lower()
    found: Counter = Counter()
    at = 0
    while at < len(data):
        cut = _GAP.search(data, min(at + STRETCH, len(data)))  # no term is cut
        end = cut.start() if cut else len(data)
        found.update(_TERM.findall(data, at, end))
        at = end
    return found


def _sketch(found: Counter, known: dict[bytes, int]) -> int:
    """Sixteen sign bits of the terms' random signs, weighted by the root of the counts."""
    bits = np.empty(len(found), np.uint16)
    for i, term in enumerate(found):
        code = known.get(term)
        if code is None:
            if len(known) >= 1 << 18:
                known.clear()
            code = known[term] = zlib.crc32(term) & 0xFFFF
        bits[i] = code
    weight = np.sqrt(np.fromiter(found.values(), float, len(found)))
    sums = [weight[(bits >> b) & 1 == 1].sum() for b in range(16)]
    half = weight.sum() / 2
    return sum(1 << b for b in range(16) if sums[b] > half)


def term_table(rows: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """One row per text that has terms: number of the row, id, sketch, length, terms, counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 33
        known: dict[bytes, int] = {}
        names = [x.split()[0] for x in TERMS.split(", ")]
        for part in text_slices(batches, "text"):
            out: list[tuple] = []
            for i, text in zip(part["id"].to_pylist(), part["text"].to_pylist(), strict=True):
                uid += 1
                found = term_counts(text or "")
                if found:
                    counts = list(found.values())
                    out.append((uid, i, _sketch(found, known), sum(counts), list(found), counts))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64())]
                arrays = [pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names)

    source = rows.selectExpr(f"cast(`{id_column}` as long) id", f"`{text_column}` text")
    return source.mapInArrow(run, TERMS)


def clustered(tables: Tables, docs: DataFrame) -> DataFrame:
    """The table in order of the sketches; a sketch that many rows share covers many tasks."""
    parts = int(tables.spark.conf.get("spark.sql.shuffle.partitions"))
    by = ["sketch", F.xxhash64("uid"), "uid"]
    out = tables.store(docs.repartitionByRange(parts, *by).sortWithinPartitions(*by), F.col("n"))
    tables.drop(docs)
    return out


def weighted_terms(tables: Tables, items: DataFrame, index: DataFrame, n_docs: int) -> DataFrame:
    """(item, id, term, weight): weight times repeats of every term of an item that the corpus has.

    The items' terms are written first, so that their size decides how they meet the documents'.
    """
    asked = items.select(F.col("uid").alias("item"), "id", F.explode(F.arrays_zip("terms", "counts")).alias("t"))
    asked = tables.store(asked.select("item", "id", F.col("t.terms").alias("term"), F.col("t.counts").alias("tf")))
    held = index.select(F.explode("terms").alias("term")).join(asked.select("term"), "term", "left_semi")
    have = held.groupBy("term").agg(F.count("*").alias("df"))
    w = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2 * F.col("df") + 1)))
    out = asked.join(have, "term").select("item", "id", "term", (w * F.col("tf")).alias("weight"))
    return tables.store(out)


class Tree:
    """Ball tree over the rows of a sparse matrix: ``start``, ``col`` and ``val`` in row order.

    After building, ``order`` lists the rows so that a node is a stretch ``low:high`` of it, and
    the matrix is kept in that order.
    """

    def __init__(self, start: np.ndarray, col: np.ndarray, val: np.ndarray, width: int, leaf: int = LEAF):
        self.width = width
        rows = len(start) - 1
        self.order = np.arange(rows)
        row = np.repeat(np.arange(rows), np.diff(start))
        flat = val.astype(float)
        square = np.bincount(row, weights=flat * flat, minlength=rows)
        self.low, self.high, self.child, radius = [], [], [], []
        stats: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        stack = [(0, rows, -1, 0)]
        while stack:
            low, high, parent, side = stack.pop()
            node = len(self.low)
            if parent >= 0:
                self.child[parent][side] = node
            own = self.order[low:high]
            at, lengths = self._entries(start, own)
            c, v = col[at], flat[at]
            total = np.bincount(c, weights=v, minlength=width)
            most = np.zeros(width)
            np.maximum.at(most, c, v)
            terms = np.flatnonzero(total)
            centre = total / (high - low)
            local = np.repeat(np.arange(high - low), lengths)

            def dot(direction, c=c, v=v, local=local, size=high - low):
                return np.bincount(local, weights=v * direction[c], minlength=size)

            size = centre @ centre
            far = square[own] - 2 * dot(centre) + size
            # rounded up by more than the sums can lose
            far = np.sqrt(np.maximum(far, 0) + SLACK * (square[own] + size))
            self.low.append(low)
            self.high.append(high)
            self.child.append([-1, -1])
            radius.append(far.max())
            stats.append((terms, centre[terms], most[terms]))
            equal = (lengths == len(terms)).all() and (v == most[c]).all()
            if high - low <= leaf or equal:
                continue
            a = int(far.argmax())
            one = np.zeros(width)
            first, past = start[own[a]], start[own[a] + 1]
            one[col[first:past]] = flat[first:past]
            reach = dot(one)
            b = int((square[own] - 2 * reach).argmax())
            other = np.zeros(width)
            first, past = start[own[b]], start[own[b] + 1]
            other[col[first:past]] = flat[first:past]
            self.order[low:high] = own[np.argsort(dot(other) - reach, kind="stable")]
            middle = (low + high) // 2
            stack += [(middle, high, node, 1), (low, middle, node, 0)]
        self.radius = np.array(radius)
        at, lengths = self._entries(start, self.order)
        self.start = np.concatenate([[0], np.cumsum(lengths)])
        self.col, self.val = col[at], val[at]
        # the nodes' centroids by term
        term = np.concatenate([s[0] for s in stats])
        by = np.argsort(term, kind="stable")
        self.node = np.repeat(np.arange(len(stats)), [len(s[0]) for s in stats])[by]
        self.centre = np.concatenate([s[1] for s in stats])[by]
        self.most = np.concatenate([s[2] for s in stats])[by]
        self.first = np.searchsorted(term[by], np.arange(width + 1))

    @staticmethod
    def _entries(start: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the entries of rows, and how many each has."""
        lengths = start[rows + 1] - start[rows]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return np.arange(total) + np.repeat(start[rows] - (ends - lengths), lengths), lengths

    def bounds(self, terms: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """What a query's score can be at most in each node."""
        at, lengths = self._entries(self.first, terms)
        w = np.repeat(weight.astype(float), lengths)
        node, n = self.node[at], len(self.low)
        inner = np.bincount(node, weights=w * self.centre[at], minlength=n)
        norm = np.sqrt(np.bincount(node, weights=w * w, minlength=n))
        axis = np.bincount(node, weights=w * self.most[at], minlength=n)
        return np.minimum(inner + norm * self.radius, axis) * (1 + SLACK) + 1

    def scores(self, node: int, dense: np.ndarray) -> np.ndarray:
        """Exact scores of a node's rows; ``dense`` has the query's weight of every column."""
        low, high = self.low[node], self.high[node]
        first, past = self.start[low], self.start[high]
        part = dense[self.col[first:past]] * self.val[first:past]
        sums = np.concatenate([[0], np.cumsum(part)])
        return sums[self.start[low + 1 : high + 1] - first] - sums[self.start[low:high] - first]

    def search(self, terms, weight, dense, best: list, k: int, ids: list, kinds: list) -> int:
        """Bring the k best (score, order, id) of a query up to date; returns the rows scored."""
        bound = self.bounds(terms, weight)
        queue = [(-bound[0], 0)]
        seen = 0
        while queue:
            b, node = heapq.heappop(queue)
            if len(best) >= k and -b < best[0][0]:
                break
            left, right = self.child[node]
            if left >= 0:
                heapq.heappush(queue, (-bound[left], left))
                heapq.heappush(queue, (-bound[right], right))
                continue
            score = self.scores(node, dense)
            seen += len(score)
            for i in np.flatnonzero(score > 0 if len(best) < k else score >= best[0][0]).tolist():
                row = self.order[self.low[node] + i]
                entry = (int(score[i]), kinds[row], ids[row])
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
        return seen


def saturated(tf: np.ndarray, n: np.ndarray, n_docs: int, length: int) -> np.ndarray:
    """(10^9 tf) div (1000 tf + 12 m) with m = 75 + (25 n N) div L, in integers."""
    if len(n) and 25 * int(n.max()) * n_docs >= LONG:
        m = np.array([75 + 25 * int(x) * n_docs // length for x in n], np.int64)
    else:
        m = 75 + 25 * n * n_docs // length
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


class Block:
    """Queries of one block, by the numbers of the block's distinct terms."""

    def __init__(self, rows: pa.Table):
        rows = rows.sort_by([("item", "ascending"), ("term", "ascending")])
        coded = rows["term"].combine_chunks().dictionary_encode()
        self.terms = coded.dictionary
        column = coded.indices.to_numpy().astype(np.int64)
        weight = rows["weight"].to_numpy()
        item = rows["item"].to_numpy()
        cuts = np.flatnonzero(np.diff(item, prepend=item[:1] - 1)) if len(item) else np.zeros(0, int)
        ends = [*cuts[1:].tolist(), len(item)]
        ids = rows["id"].to_pylist()
        self.queries = [
            (int(item[a]), ids[a], column[a:b], weight[a:b]) for a, b in zip(cuts.tolist(), ends, strict=False)
        ]


def _chunks(batches: Iterator[pa.RecordBatch], terms: pa.Array, n_docs: int, length: int):
    """Rows restricted to the given terms: ids, row starts, columns and saturated counts."""
    held: list[tuple] = []
    rows = entries = 0

    def joined():
        ids = [i for h in held for i in h[0]]
        sizes = np.concatenate([h[1] for h in held])
        start = np.concatenate([[0], np.cumsum(sizes)])
        return ids, start, np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held])

    for batch in batches:
        lists = batch["terms"]
        flat = lists.flatten()
        column = pc.index_in(flat, value_set=terms)
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(batch.num_rows), sizes)
        hit = pc.is_valid(column).to_numpy(zero_copy_only=False)
        row, column = row[hit], column.drop_null().to_numpy().astype(np.int64)
        tf = batch["counts"].flatten().to_numpy()[hit]
        value = saturated(tf, batch["n"].to_numpy()[row], n_docs, length)
        per = np.bincount(row, minlength=batch.num_rows)
        ends = np.cumsum(per)
        ids = batch["id"].to_pylist()
        kept = np.flatnonzero(per)
        at = 0
        while at < len(kept):
            base = ends[kept[at]] - per[kept[at]]
            room = CHUNK_ENTRIES - entries
            upto = at + int(np.searchsorted(ends[kept[at:]], base + room, side="right"))
            upto = min(upto, at + CHUNK_ROWS - rows, len(kept))
            if upto == at and not held:
                upto = at + 1  # one document alone is a chunk, whatever its size
            if upto > at:
                own = kept[at:upto]
                first, past = base, ends[own[-1]]
                held.append(([ids[i] for i in own], per[own], column[first:past], value[first:past]))
                rows, entries = rows + len(own), entries + int(past - first)
            if upto < len(kept):
                yield joined()
                held, rows, entries = [], 0, 0
            at = upto
    if held:
        yield joined()


RANKED = "item_id long, rank int, doc_id long, score long, n_scored long, n_rows long"
FOUND = "item long, item_id long, doc_id long, score long, n_scored long, n_rows long"


def _searched(index: DataFrame, rows: pa.Table, k: int, n_docs: int, length: int) -> DataFrame:
    """The k best documents of every task for each query of a block."""
    shared = index.sparkSession.sparkContext.broadcast(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(shared.value)
        best: list[list] = [[] for _ in block.queries]
        scored, total = [0] * len(block.queries), 0
        place = np.full(len(block.terms), -1)
        for ids, start, column, value in _chunks(batches, block.terms, n_docs, length):
            used = np.unique(column)
            place[used] = np.arange(len(used))
            tree = Tree(start, place[column], value, len(used))
            # of equal scores the smaller id is better, and no id is worst
            keys = [0 if i is None else 1 for i in ids]
            backward = [0 if i is None else -i for i in ids]
            total += len(ids)
            dense = np.zeros(len(used), np.int64)
            for q, (_, _, terms, weight) in enumerate(block.queries):
                mine = place[terms]
                have = mine >= 0
                if have.any():
                    mine, w = mine[have], weight[have]
                    dense[mine] = w
                    scored[q] += tree.search(mine, w, dense, best[q], k, backward, keys)
                    dense[mine] = 0
            place[used] = -1
        out = [
            (item, i, -doc if kind else None, score, scored[q], total)
            for q, (item, i, _, _) in enumerate(block.queries) for score, kind, doc in best[q]
        ]
        if out:
            names = [x.split()[0] for x in FOUND.split(", ")]
            arrays = [pa.array(x, pa.int64()) for x in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return index.select("id", "n", "terms", "counts").mapInArrow(run, FOUND)


def ranked(
    docs: DataFrame, items: DataFrame, k: int = RESULTS,
    id_column: str = "doc_id", text_column: str = "text",
    item_column: str = "item_id", item_text: str = "text", block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents of every item, by exact scores.

    Documents and items without a term (null, empty, signs only) have no part in the result, and
    items without a document above score 0 have no rows.  Equal scores go by ascending doc_id, a
    null id last.  Rows that share an id are documents, or items, of their own.  Other columns are
    ignored; an empty table on either side gives no rows.  Items are searched in blocks of about
    ``block_terms`` terms; an item is never cut.  ``n_scored`` and ``n_rows`` say how many
    documents the task behind a row scored for the item, and how many it held.
    """
    spark = docs.sparkSession
    tables = Tables(spark)
    index = clustered(tables, tables.store(term_table(docs, id_column, text_column)))
    n_docs, length = index._rows, index._sum
    if not n_docs:
        return spark.createDataFrame([], RANKED)
    asked = weighted_terms(tables, term_table(items, item_column, item_text), index, n_docs)
    blocks = max(1, math.ceil(asked._rows / block_terms))
    found = []
    for b in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)
        found.append(_searched(index, mine.toArrow(), k, n_docs, length))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    out = reduce(DataFrame.unionAll, found).withColumn("rank", F.row_number().over(order))
    return out.where(F.col("rank") <= k).select(*[x.split()[0] for x in RANKED.split(", ")])
