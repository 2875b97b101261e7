"""Whitening of embeddings along leading principal components, by Jacobi-Davidson.

The covariance matrix is never formed.  Each product with a few vectors is one distributed pass
over the centred rows; only vectors of the embedding's width reach the driver.  An outer step
takes the leading Ritz pairs of a small subspace, locks those whose residuals are at rounding
level, and extends the subspace by the solutions of the projected correction equations, which
block MINRES approximates: all open equations share the passes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import Tables

COMPONENTS = 4
SCALE = 256
INNER = 3  # MINRES steps of a correction equation
GUARDS = 8  # pairs beyond the wanted ones that are corrected along, in the same passes
SPACE = 64  # vectors of the subspace before it restarts
RESIDUAL = 8 * np.finfo(float).eps  # of a component, as a multiple of the largest eigenvalue
ROUNDS = 200
LONG = 1 << 63
OUT = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, "
    "identity_error double"
)

Product = Callable[[np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Pairs:
    """Leading eigenpairs, with residual norms and the number of products taken."""

    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    products: int


def _orthonormal(new: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """Columns of ``new`` made orthonormal to the bases and to each other; dependent ones go."""
    out = np.zeros((len(new), 0))
    for v in new.T:
        size = np.linalg.norm(v)
        if not size:
            continue
        v = v / size
        for _ in range(3):  # repeated, since one pass leaves rounding errors behind
            for base in (*bases, out):
                v = v - base @ (base.T @ v)
            left = np.linalg.norm(v)
            if left < 1e-12:
                break
            v = v / left
        if left >= 1e-12:
            out = np.column_stack([out, v])
    return out


def minres(
    product: Product, shifts: np.ndarray, project: Callable[[np.ndarray], np.ndarray],
    right: np.ndarray, steps: int,
) -> np.ndarray:
    """Solutions of P (A - shift) P x = right, one column a system, after some MINRES steps.

    Every system runs its own Lanczos and Givens recurrences; a step takes one product with the
    vectors of all systems.
    """
    x = np.zeros_like(right)
    beta = np.linalg.norm(right, axis=0)
    live = beta > 0
    v_old = np.zeros_like(right)
    v = np.where(live, right / np.where(live, beta, 1.0), 0.0)
    w_old, w = np.zeros_like(right), np.zeros_like(right)
    rhs = beta.copy()
    k = right.shape[1]
    c_old, s_old, c, s = np.ones(k), np.zeros(k), np.ones(k), np.zeros(k)
    b = np.zeros(k)
    start = np.where(live, beta, 1.0)
    for _ in range(steps):
        if not live.any():
            break
        z = np.zeros_like(v)
        z[:, live] = project(product(v[:, live]) - v[:, live] * shifts[live])
        alpha = (v * z).sum(axis=0)
        z = z - v * alpha - v_old * b
        z = project(z)
        b_next = np.linalg.norm(z, axis=0)
        # rotations of the last two steps, then the one that clears b_next
        rho3 = s_old * b
        delta = c_old * b
        rho2 = c * delta + s * alpha
        gap = -s * delta + c * alpha
        rho1 = np.hypot(gap, b_next)
        ok = live & (rho1 > 1e-300)
        safe = np.where(ok, rho1, 1.0)
        c_old, s_old = c, s
        c, s = np.where(ok, gap / safe, 1.0), np.where(ok, b_next / safe, 0.0)
        w_old, w = w, np.where(ok, (v - w_old * rho3 - w * rho2) / safe, 0.0)
        x = x + np.where(ok, w * (c * rhs), 0.0)
        rhs = -s * rhs
        live = ok & (b_next > 1e-14 * start) & (np.abs(rhs) > 1e-14 * start)
        v_old, v = v, np.where(live, z / np.where(live, b_next, 1.0), 0.0)
        b = b_next
    return x


def jacobi_davidson(
    product: Product, width: int, wanted: int, inner: int = INNER, guards: int = GUARDS,
    space: int = SPACE, residual: float = RESIDUAL, seed: int = 11,
) -> Pairs:
    """The ``wanted`` largest eigenpairs of a symmetric positive semi-definite operator.

    A pair is locked, and later vectors are kept orthogonal to it, when its residual norm is at
    most ``residual`` times the largest eigenvalue times the root of the width.
    """
    wanted = min(wanted, width)
    space = max(space, 3 * (wanted + guards))
    taken = 0

    def times(v: np.ndarray) -> np.ndarray:
        nonlocal taken
        taken += 1
        return product(v)

    locked = np.zeros((width, 0))
    values: list[float] = []
    norms: list[float] = []
    start = np.random.default_rng(seed).standard_normal((width, min(width, wanted + guards)))
    basis = _orthonormal(start)
    image = times(basis)
    for _ in range(ROUNDS):
        h = basis.T @ image
        theta, turn = np.linalg.eigh((h + h.T) / 2)
        order = np.argsort(-theta, kind="stable")
        theta, turn = theta[order], turn[:, order]
        open_pairs = min(wanted - len(values), len(theta))
        count = min(open_pairs + guards, len(theta))
        ritz, ritz_image = basis @ turn[:, :count], image @ turn[:, :count]
        rest = ritz_image - ritz * theta[:count]
        rest = rest - locked @ (locked.T @ rest)
        size = np.linalg.norm(rest, axis=0)
        top = max([*values, *theta[:1].tolist(), 0.0])
        limit = residual * top * np.sqrt(width)
        whole = basis.shape[1] + locked.shape[1] >= width  # nothing is left to add
        done = 0
        while done < open_pairs and (size[done] <= limit or whole):
            done += 1
        if done:
            locked = np.column_stack([locked, ritz[:, :done]])
            values += theta[:done].tolist()
            norms += size[:done].tolist()
            basis, image = basis @ turn[:, done:], image @ turn[:, done:]
            # the images keep what the locked vectors gave them, the basis does not
            theta = theta[done:]
            turn = np.eye(len(theta))
        if len(values) >= wanted or not basis.shape[1]:
            break
        ritz, rest, size = ritz[:, done:], rest[:, done:], size[done:]
        held = np.column_stack([locked, ritz])

        def project(z: np.ndarray, held=held) -> np.ndarray:
            for _ in range(2):
                z = z - held @ (held.T @ z)
            return z

        open_ = size > limit
        new = minres(times, theta[: count - done][open_], project, project(-rest[:, open_]), inner)
        if basis.shape[1] + new.shape[1] > space:
            keep = min(wanted + guards, basis.shape[1])
            basis, image = basis @ turn[:, :keep], image @ turn[:, :keep]
        new = _orthonormal(new, locked, basis)
        if not new.shape[1]:  # corrections within the subspace: go on with a fresh direction
            fresh = np.random.default_rng(seed + taken).standard_normal((width, 1))
            new = _orthonormal(fresh, locked, basis)
            if not new.shape[1]:
                continue
        basis, image = np.column_stack([basis, new]), np.column_stack([image, times(new)])
    else:
        raise RuntimeError(f"{wanted - len(values)} components did not settle")
    order = np.argsort(-np.array(values), kind="stable")
    vectors = locked[:, order]
    flip = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))])
    return Pairs(np.array(values)[order], vectors * flip, np.array(norms)[order], taken)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), width)


def _sum_of(rows: DataFrame, width: int, n_out: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all rows of ``part``: tasks add up their own, Spark adds the tasks' results."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_out)
        for rows_ in batches:
            if rows_.num_rows:
                total += part(_matrix(rows_[0], width)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["v"])

    parts = rows.mapInArrow(run, "v array<double>")
    sums = parts.select(F.posexplode("v")).groupBy("pos").agg(F.sum("col").alias("s"))
    out = np.zeros(n_out)
    for r in sums.collect():
        out[r["pos"]] = r["s"]
    return out


def _integers(rows: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, x) of the rows that take part."""
    vector = F.col(f"`{vector_column}`").cast("array<double>")
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    kept = rows.select(F.col(f"`{id_column}`").cast("long").alias("id"), vector.alias("v"))
    kept = kept.where(F.col("v").isNotNull() & (F.size("v") > 0) & finite)
    return kept.select("id", F.transform("v", lambda c: F.floor(c * SCALE).cast("long")).alias("x"))


def whitened(
    rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding",
    components: int = COMPONENTS,
) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every row kept.

    Rows whose vector is null, empty or holds a null or non-finite entry take no part, nor do
    vectors of another length than most rows have (of equally frequent lengths the longest
    counts).  Ids may be null or repeat, and repeated vectors count once in the fit; other columns
    are ignored.  Components without variance (an eigenvalue at rounding level) are left out, so
    that an empty table, and one whose vectors are all equal, give no rows.  ``deviation`` is null
    where the exact number does not fit into a long.
    """
    spark = rows.sparkSession
    tables = Tables(spark)
    ints = _integers(rows, id_column, vector_column)
    lengths = ints.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"))
    most = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    if most is None:
        return spark.createDataFrame([], OUT)
    width = most["d"]
    ints = ints.where(F.size("x") == width)
    fit = tables.store(ints.select("x").distinct())
    n = fit._rows
    # decimal sums are exact whatever the number of rows
    sums = fit.select(F.posexplode("x")).groupBy("pos")
    sums = sums.agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("s")).collect()
    total = [0] * width
    for r in sums:
        total[r["pos"]] = int(r["s"])

    def gaps(x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly; as Python's integers where 64 bits do not hold it."""
        biggest = max(int(x.max()), -int(x.min()), 1) * n + max(map(abs, total))
        if biggest >= LONG:
            return x.astype(object) * n - np.array(total, object)
        return x * n - np.array(total, np.int64)

    def centred(x: np.ndarray) -> np.ndarray:
        return gaps(x).astype(float) / n

    def product(v: np.ndarray) -> np.ndarray:
        def part(x):
            y = centred(x)
            return y.T @ (y @ v)

        return _sum_of(fit, width, v.size, part).reshape(v.shape) / n

    trace = float(_sum_of(fit, width, 1, lambda x: np.array([(centred(x) ** 2).sum()]))[0]) / n
    pairs = jacobi_davidson(product, width, components)
    real = pairs.values > width * np.finfo(float).eps * trace
    if not real.any():
        return spark.createDataFrame([], OUT)
    values, vectors = pairs.values[real], pairs.vectors[:, real]
    k, axes = len(values), vectors / np.sqrt(values)

    def moments(x: np.ndarray) -> np.ndarray:
        w = centred(x) @ axes
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    found = _sum_of(fit, width, k + k * k, moments) / n
    spread = found[k:].reshape(k, k) - np.outer(found[:k], found[:k])
    error = float(np.abs(spread - np.eye(k)).max())
    explained = values / trace

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in OUT.split(", ")]
        for rows_ in batches:
            if not rows_.num_rows:
                continue
            gap = gaps(_matrix(rows_["x"], width))
            w = (gap.astype(float) / n) @ axes
            most_ = max(abs(int(gap.max())), abs(int(gap.min())))
            if most_ * most_ * width >= LONG:
                gap = gap.astype(object)
            deviation = [d if d < LONG else None for d in (gap * gap).sum(axis=1).tolist()]
            m = rows_.num_rows
            pick = pa.array(np.repeat(np.arange(m), k))
            arrays = [
                rows_["id"].take(pick),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, n)),
                pa.array(deviation, pa.int64()).take(pick),
                pa.array(w.ravel()),
                pa.array(np.tile(explained, m)),
                pa.array(np.full(m * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return ints.mapInArrow(put, OUT)
