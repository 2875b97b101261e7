"""Ridge regression on one-hot designs that are too wide for a dense matrix of cross products.

Levels get dense codes from range-partitioned ranks and stay in a table.  Of the cross products only
those of levels that occur together are kept, as a table of (i, j, sum), and the normal equations
are solved by conjugate gradients with one distributed product a step.  The driver holds a few
vectors as long as the design is wide.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.plans.prefix import positions
from plumbline.plans.storage import materialize

TOLERANCE = 1e-11
STEPS = 2000


def levels(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, level, code) of all values, null among them; codes count from 1 without gaps."""
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in columns]
    found = rows.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").distinct()
    # a level may be null, so it is sorted as (is null, level)
    keyed = found.select("column", "level", F.col("level").isNull().alias("none"))
    placed = positions(keyed, [], ["column", "none", "level"], "code")
    return placed.select("column", "level", (F.col("code") + 1).cast("long").alias("code"))


def coded(rows: DataFrame, columns: Sequence[str], codes: DataFrame, id: str, keep: Sequence[str] = ()) -> DataFrame:
    """(id, keep, codes): the codes of every row's levels; a level without a code is left out."""
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in columns]
    long = rows.select(id, *keep, F.explode(F.array(*pairs)).alias("p")).select(id, *keep, "p.*")
    known = codes.select(F.col("column").alias("__c"), F.col("level").alias("__l"), "code")
    same = (F.col("column") == F.col("__c")) & F.col("level").eqNullSafe(F.col("__l"))
    joined = long.join(known, same, "left").groupBy(id, *keep)
    return joined.agg(F.sort_array(F.collect_list("code")).alias("codes"))


@dataclass(frozen=True)
class SparseFit:
    """Weights by code, the intercept first, and the steps and relative residual of the solution."""

    weights: np.ndarray
    codes: DataFrame
    columns: tuple[str, ...]
    steps: int
    residual: float

    def predict(self, rows: DataFrame, id: str, name: str = "prediction") -> DataFrame:
        """(id, prediction); levels that the fit has not seen add nothing."""
        w = rows.sparkSession.sparkContext.broadcast(self.weights)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = batch["codes"]
                size = lists.value_lengths().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(batch.num_rows), size)
                part = w.value[lists.flatten().to_numpy()]
                out = np.bincount(row, weights=part, minlength=batch.num_rows) + w.value[0]
                yield pa.RecordBatch.from_arrays([batch[id], pa.array(out)], [id, name])

        kind = dict(rows.dtypes)[id]
        return coded(rows, self.columns, self.codes, id).mapInArrow(run, f"`{id}` {kind}, `{name}` double")


def _product(pairs: DataFrame, v: np.ndarray) -> np.ndarray:
    """The symmetric matrix of (i <= j, sum) times a vector."""
    shared = pairs.sparkSession.sparkContext.broadcast(v)
    d = len(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, x = np.zeros(d), shared.value
        for batch in batches:
            i, j, s = (batch[c].to_numpy() for c in ("i", "j", "s"))
            out += np.bincount(i, weights=s * x[j], minlength=d)
            off = i != j
            out += np.bincount(j[off], weights=s[off] * x[i[off]], minlength=d)
        own = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(out[own])], ["i", "s"])

    parts = pairs.mapInArrow(run, "i long, s double").groupBy("i").agg(F.sum("s").alias("s"))
    got = parts.toArrow()
    out = np.zeros(d)
    out[got["i"].to_numpy()] = got["s"].to_numpy()
    shared.destroy()
    return out


def ridge_one_hot(
    rows: DataFrame, columns: Sequence[str], target: str, id: str, l2: float,
    tolerance: float = TOLERANCE, most_steps: int = STEPS,
) -> SparseFit:
    """Squared loss / (2n) + l2 / 2 * w'w over the one-hot levels of all columns, with a free intercept.

    Null is a level of its own.  Rows without a target take no part.  Conjugate gradients, scaled by
    the diagonal, stop when the residual is below ``tolerance`` times the right side.
    """
    columns = list(columns)
    known = rows.where(F.col(target).isNotNull())
    codes = materialize(levels(known, columns))
    target_ = F.col(target).cast("double").alias("__y")
    whole = materialize(coded(known.select(id, *columns, target_), columns, codes, id, ["__y"]))
    n = whole.count()
    width = codes.count() + 1
    if not n:
        return SparseFit(np.zeros(1), codes, tuple(columns), 0, 0.0)
    all_ = F.concat(F.array(F.lit(0).cast("long")), "codes")
    listed = whole.select("__y", all_.alias("codes"))
    left = listed.select("codes", F.explode("codes").alias("i"))
    both = left.select("i", F.explode("codes").alias("j")).where("i <= j")
    pairs = materialize(both.groupBy("i", "j").agg(F.count("*").cast("double").alias("s")))
    sums = listed.select("__y", F.explode("codes").alias("i")).groupBy("i").agg(F.sum("__y").alias("s")).toArrow()
    b = np.zeros(width)
    b[sums["i"].to_numpy()] = sums["s"].to_numpy() / n
    diagonal = pairs.where("i = j").select("i", "s").toArrow()
    scale = np.ones(width)
    scale[diagonal["i"].to_numpy()] = diagonal["s"].to_numpy() / n
    penalty = np.full(width, float(l2))
    penalty[0] = 0.0
    scale = scale + penalty

    w = np.zeros(width)
    rest = b.copy()
    z = rest / scale
    p, rz, start = z.copy(), float(rest @ z), float(np.linalg.norm(b))
    steps = 0
    while steps < most_steps and np.linalg.norm(rest) > tolerance * start:
        image = _product(pairs, p) / n + penalty * p
        step = rz / float(p @ image)
        w, rest = w + step * p, rest - step * image
        z = rest / scale
        new = float(rest @ z)
        p, rz = z + p * (new / rz), new
        steps += 1
    residual = float(np.linalg.norm(rest) / start) if start else 0.0
    return SparseFit(w, codes, tuple(columns), steps, residual)
