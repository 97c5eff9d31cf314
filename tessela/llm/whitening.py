"""Whitening of embeddings: blockwise QR of the centred rows, then a bidiagonal solver for the small triangle.

Entries become integers x = floor(64 c) + 1000000, so counts and sums are exact. Every task reduces its centred rows block
by block to one upper triangle; triangles are stacked and reduced again in groups of bounded size until one is left. Its
singular values come from a bidiagonal form by the differential qd algorithm with shifts, its right singular vectors from
twisted factorisations of the tridiagonal product. No covariance matrix is formed on the way, so small variances keep
their digits. Only the triangle, as large as the vectors are long, is ever in one place.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessela.llm.common import arrow_map, stage, table
from tessela.llm.registry import query

COMPONENTS = 32
SCALE, OFFSET = 64.0, 1_000_000
LARGEST = 1 << 61
BLOCK_VALUES = 1 << 19
FAN = 16
EPS = float(np.finfo(np.float64).eps)
TINY = float(np.finfo(np.float64).tiny)


# ---- the small solver -----------------------------------------------------------------------------------------------

def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Householder reduction of a square matrix to upper bidiagonal form.

    Returns the diagonal, the superdiagonal and the right reflectors: with V their product in order, U^T r V is bidiagonal.
    """
    a, d = r.astype(np.float64).copy(), len(r)
    right: list[np.ndarray] = []
    for k in range(d):
        v = _reflector(a[k:, k])
        a[k:, k:] -= np.outer(2 * v, v @ a[k:, k:])
        if k + 2 < d:
            v = _reflector(a[k, k + 1 :])
            a[k:, k + 1 :] -= np.outer(a[k:, k + 1 :] @ v, 2 * v)
            right.append(v)
    return np.diagonal(a).copy(), np.diagonal(a, 1).copy(), right


def _reflector(x: np.ndarray) -> np.ndarray:
    """The unit vector v with (I - 2 v v^T) x a multiple of the first axis; zero if x is zero."""
    big = np.abs(x).max() if len(x) else 0.0
    if big == 0.0:
        return np.zeros_like(x)
    v = x / big
    v[0] += np.copysign(np.sqrt(v @ v), v[0])
    return v / np.sqrt(v @ v)


def _apply_reflectors(right: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """V y for the product V of the right reflectors; reflector k acts on rows k + 1 and beyond."""
    y = y.copy()
    for k in range(len(right) - 1, -1, -1):
        v = right[k]
        y[k + 1 :] -= np.outer(2 * v, v @ y[k + 1 :])
    return y


def _dqds(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float, bool]:
    """One differential qd step with a shift: new q and e, the least pivot, and whether only the last pivot was negative."""
    n, d = len(q), q[0] - shift
    new_q, new_e, least = [0.0] * n, [0.0] * (n - 1), d
    for i in range(n - 1):
        if d < 0:
            return new_q, new_e, d, False
        new_q[i] = d + e[i]
        ratio = q[i + 1] / new_q[i] if new_q[i] > 0 else 0.0
        new_e[i] = e[i] * ratio
        d = d * ratio - shift
        least = min(least, d)
    new_q[-1] = d
    return new_q, new_e, least, d < 0


def squared_singular_values(diagonal: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """All squared singular values of an upper bidiagonal matrix, largest first, each to high relative accuracy.

    Works on squares q and e only. A value is split off when its last e is negligible; shifts stay below the smallest
    value, are corrected by the negative last pivot after a near miss, and fall back to zero.
    """
    blocks = [([float(x) ** 2 for x in diagonal], [float(x) ** 2 for x in upper], 0.0)] if len(diagonal) else []
    found: list[float] = []
    negligible = (10 * EPS) ** 2
    while blocks:
        q, e, moved = blocks.pop()
        last_least = 0.0
        while q:
            n = len(q)
            if n == 1 or e[-1] <= negligible * (moved + q[-1]) or e[-1] < TINY:
                found.append(moved + max(q.pop(), 0.0))
                if e:
                    e.pop()
                continue
            cut = next((i for i in range(n - 3, -1, -1) if e[i] <= negligible * moved or e[i] < TINY), None)
            if cut is not None:
                blocks.append((q[: cut + 1], e[:cut], moved))
                q, e, last_least = q[cut + 1 :], e[cut + 1 :], 0.0
                continue
            if q[0] < q[-1] / 1.5:  # the small end belongs last
                q, e, last_least = q[::-1], e[::-1], 0.0
            # the smaller value of the last two rows bounds the smallest from above, the least pivot of the last step too
            half, off = (q[-2] + e[-1] + q[-1]) / 2, q[-2] * q[-1]
            root = max(half * half - off, 0.0) ** 0.5
            shift = min(off / (half + root) if half + root > 0 else 0.0, last_least)
            for attempt in itertools.count():
                new_q, new_e, least, late = _dqds(q, e, shift)
                if least >= 0:
                    break
                corrected = (shift + least) * (1 - 4 * EPS) if late and attempt < 2 else shift / 4
                shift = corrected if 0 < corrected < shift and attempt < 4 else 0.0
            q, e, last_least, moved = new_q, new_e, least, moved + shift
    return np.array(sorted(found, reverse=True))


def _twisted(d: np.ndarray, l: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Multipliers of the stationary (downward) and progressive (upward) factorisation of L D L^T - value, and all twist pivots."""
    n, m = len(d), len(values)
    low, up, gamma, s, p = np.empty((n - 1, m)), np.empty((n - 1, m)), np.empty((n, m)), -values, d[-1] - values
    for i in range(n - 1):
        gamma[i] = s
        low[i] = d[i] * l[i] / _away(d[i] + s)
        s = low[i] * l[i] * s - values
    gamma[-1] = s + d[-1]
    for i in range(n - 2, -1, -1):
        ratio = d[i] / _away(d[i] * l[i] * l[i] + p)
        up[i] = l[i] * ratio
        gamma[i] += ratio * p
        p = p * ratio - values
    return low, up, gamma


def _away(x: np.ndarray) -> np.ndarray:
    """``x`` kept away from zero, so that a pivot of exactly zero gives a large multiplier and no infinity."""
    return np.where(np.abs(x) < TINY / EPS, TINY / EPS, x)


def tridiagonal_vectors(diagonal: np.ndarray, upper: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit right singular vectors of an upper bidiagonal matrix for its squared singular ``values``, as columns.

    Each value's vector is the solution of the twisted factorisation with the least pivot. Values that are so close that
    these are not orthogonal get theirs by inverse iteration, orthogonal to those before.
    """
    n = len(diagonal)
    if n == 1 or not len(values):
        return np.ones((n, len(values)))
    norm = max(float(np.abs(diagonal).max()), float(np.abs(upper).max()))
    if norm == 0:
        return np.eye(n)[:, : len(values)]
    # a zero on the diagonal is moved by far less than rounding, so that the triangular form exists
    a = np.where(np.abs(diagonal) < EPS * EPS * norm, EPS * EPS * norm, diagonal)
    d, l = a * a, upper / a[:-1]
    with np.errstate(over="ignore", invalid="ignore"):
        low, up, gamma = _twisted(d, l, values)
    product = d + np.concatenate([[0.0], upper * upper])
    twist, each = np.nan_to_num(np.abs(gamma), nan=np.inf).argmin(axis=0), np.arange(len(values))
    z = np.zeros((n, len(values)))
    z[twist, each] = 1.0
    with np.errstate(over="ignore", invalid="ignore"):
        for i in range(n - 2, -1, -1):
            z[i] = np.where(i < twist, -low[i] * z[i + 1], z[i])
        for i in range(n - 1):
            z[i + 1] = np.where(i >= twist, -up[i] * z[i], z[i + 1])
        z /= np.abs(z).max(axis=0)
        z /= np.sqrt((z * z).sum(axis=0))
    rng = np.random.default_rng(1)
    start = 0
    for j in range(1, len(values) + 1):
        if j < len(values) and values[j - 1] - values[j] <= max(1e-3 * values[j - 1], EPS * values[0]):
            continue
        inside = slice(start, j)
        mine = z[:, inside]
        if not np.isfinite(mine).all() or np.abs(mine.T @ mine - np.eye(j - start)).max() > 1e-13:
            for k in range(start, j):
                z[:, k] = _inverse_iteration(product, a[:-1] * upper, values[k], z[:, :k], rng)
        start = j
    # what is left between groups is rounding, or a direction without variance that leans on another
    for k in range(1, len(values)):
        if np.abs(z[:, :k].T @ z[:, k]).max() > 1e-9:
            z[:, k] = _inverse_iteration(product, a[:-1] * upper, values[k], z[:, :k], rng)
        z[:, k] = _orthogonal(z[:, k], z[:, :k])
    return z


def _inverse_iteration(diagonal: np.ndarray, off: np.ndarray, value: float, before: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A unit vector near the eigenvalue ``value`` of a symmetric tridiagonal matrix, orthogonal to the columns of ``before``.

    Elimination with row exchanges, so that repeated values and split matrices do no harm.
    """
    n = len(diagonal)
    floor = EPS * max(float(np.abs(diagonal).max()), float(np.abs(off).max()))
    main, first, second = (diagonal - value).tolist(), [*off.tolist(), 0.0], [0.0] * n
    factor, swapped = [0.0] * n, [False] * n
    for i in range(n - 1):
        below = float(off[i])
        if abs(below) > abs(main[i]):
            swapped[i] = True
            main[i], first[i], second[i], main[i + 1], first[i + 1], below = below, main[i + 1], first[i + 1], first[i], 0.0, main[i]
        if abs(main[i]) < floor:
            main[i] = floor
        factor[i] = below / main[i]
        main[i + 1] -= factor[i] * first[i]
        first[i + 1] -= factor[i] * second[i]
    if abs(main[-1]) < floor:
        main[-1] = floor
    z = rng.standard_normal(n)
    for _ in range(5):
        z = _orthogonal(z, before).tolist()
        for i in range(n - 1):
            if swapped[i]:
                z[i], z[i + 1] = z[i + 1], z[i]
            z[i + 1] -= factor[i] * z[i]
        z[n - 1] /= main[n - 1]
        z[n - 2] = (z[n - 2] - first[n - 2] * z[n - 1]) / main[n - 2]
        for i in range(n - 3, -1, -1):
            z[i] = (z[i] - first[i] * z[i + 1] - second[i] * z[i + 2]) / main[i]
        z = np.array(z)
    return _orthogonal(z, before)


def _orthogonal(z: np.ndarray, before: np.ndarray) -> np.ndarray:
    for _ in range(2):
        z = z / np.abs(z).max()
        z = z - before @ (before.T @ z)
        z /= np.sqrt(z @ z)
    return z


def principal(r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(all squared singular values, the first ``k`` right singular vectors as columns) of an upper triangle ``r``."""
    dim = r.shape[1]
    square = np.zeros((dim, dim))
    square[: len(r)] = r
    big = float(np.abs(square).max()) if dim else 0.0
    if big == 0.0:
        return np.zeros(dim), np.eye(dim)[:, :k]
    diagonal, upper, right = bidiagonalise(square / big)
    values = squared_singular_values(diagonal, upper)
    vectors = _apply_reflectors(right, tridiagonal_vectors(diagonal, upper, values[:k]))
    return values * big * big, vectors


# ---- exact integers -------------------------------------------------------------------------------------------------

def _integers(column: pa.Array, dim: int) -> np.ndarray:
    """x = floor(64 c) + 1000000 of each entry; beyond 2**61 it stops there."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(flat * SCALE), -float(LARGEST), float(LARGEST)).astype(np.int64) + OFFSET


def _column_sums(x: np.ndarray) -> list[int]:
    if len(x) and int(np.abs(x).max()) * len(x) >= 1 << 62:
        return [int(s) for s in x.astype(object).sum(axis=0)]
    return x.sum(axis=0).tolist()


def _scaled_deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exactly; Python integers where 64 bits may not hold them."""
    if len(x) and n * int(np.abs(x).max()) < 1 << 62 and max(map(abs, sums)) < 1 << 62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _square_sums(y: np.ndarray) -> pa.Array:
    if y.dtype != object and (not y.size or float(np.abs(y).max()) ** 2 * y.shape[1] < 2.0**62):
        return pa.array((y * y).sum(axis=1), pa.int64())
    exact = [sum(int(v) * int(v) for v in row) for row in y]
    return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())


# ---- tables ---------------------------------------------------------------------------------------------------------

@dataclass
class Model:
    """The fit of all vectors of one length: exact count and sums, all variances, and the leading directions as columns."""

    n: int
    sums: list[int]
    variances: np.ndarray
    directions: np.ndarray

    @property
    def dim(self) -> int:
        return len(self.sums)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (_scaled_deviations(x, self.n, self.sums) / self.n).astype(np.float64)

    def scales(self) -> np.ndarray:
        """One over the standard deviation of each direction; NaN where there is no variance beyond rounding."""
        e = self.variances[: self.directions.shape[1]]
        floor = (e[0] if len(e) else 0.0) * (EPS * max(self.dim, 2)) ** 2
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(e > floor, 1 / np.sqrt(e), np.nan)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return (self.centred(x) @ self.directions) * self.scales()


def _valid(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, v, dim) of the rows that take part: a vector with entries, none of them null or non-finite."""
    v = F.col("v")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v")).where(fine).withColumn("dim", F.size("v"))


def _by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Blocks of rows of one length, of bounded size."""
    for batch in batches:
        dims = batch.column("dim").to_numpy(zero_copy_only=False)
        for dim in np.unique(dims).tolist():
            mine = batch if (dims == dim).all() else batch.filter(pc.equal(batch.column("dim"), dim))
            step = max(1, BLOCK_VALUES // dim)
            for a in range(0, mine.num_rows, step):
                yield dim, mine.slice(a, step)


def _sums(rows: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Exact count and per-dimension sums of each length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, list[int]]] = {}
        for dim, block in _by_length(batches):
            count, total = held.get(dim, (0, [0] * dim))
            held[dim] = count + block.num_rows, [a + b for a, b in zip(total, _column_sums(_integers(block.column("v"), dim)), strict=True)]
        for dim, (count, total) in held.items():
            yield pa.RecordBatch.from_pydict({
                "dim": pa.array([dim] * dim, pa.int32()), "at": pa.array(range(dim), pa.int32()),
                "n": pa.array([count] * dim, pa.int64()), "s": [str(t) for t in total],
            })

    parts = arrow_map(rows, run, "dim int, at int, n long, s string")
    # one row per length and dimension
    got = parts.groupBy("dim", "at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).cast("string").alias("s")).orderBy("dim", "at").collect()
    return {dim: (group[0]["n"], [int(r["s"]) for r in group]) for dim, group in ((d, list(g)) for d, g in itertools.groupby(got, lambda r: r["dim"]))}


def _triangle_batch(dim: int, part: int, r: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "dim": pa.array([dim], pa.int32()), "part": pa.array([part], pa.int64()), "r": pa.array([r.ravel()], pa.list_(pa.float64())),
    })


TRIANGLE = "dim int, part long, r array<double>"


def _stack(triangle: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    """The triangle of ``triangle`` with ``rows`` below it."""
    return np.linalg.qr(rows if triangle is None else np.vstack([triangle, rows]), mode="r")


def _triangles(rows: DataFrame, sums: dict[int, tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """The triangle of all centred rows of each length: blocks in a task, then trees of at most FAN triangles at a time."""

    def reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        part = TaskContext.get().partitionId()
        for dim, block in _by_length(batches):
            n, total = sums[dim]
            y = (_scaled_deviations(_integers(block.column("v"), dim), n, total) / n).astype(np.float64)
            held[dim] = _stack(held.get(dim), y)
            if len(held) > 1 and sum(r.size for r in held.values()) > BLOCK_VALUES * 16:
                yield from (_triangle_batch(d, part, held.pop(d)) for d in list(held))
        yield from (_triangle_batch(d, part, r) for d, r in held.items())

    def reduce_triangles(keys: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim, group, held = keys[0].as_py(), keys[1].as_py(), None
        for batch in batches:
            for r in batch.column("r"):
                held = _stack(held, np.asarray(r.values).reshape(-1, dim))
        yield _triangle_batch(dim, group, held)

    level = stage(arrow_map(rows, reduce_rows, TRIANGLE), "triangles")
    while True:
        # the number of triangles, not the triangles
        counts = level.groupBy("dim").count().agg(F.max("count")).first()[0]
        if counts is None or counts == 1:
            break
        # dense numbers over a table with one row per task
        number = F.row_number().over(Window.partitionBy("dim").orderBy("part")) - 1
        order = level.select("dim", "part").distinct().withColumn("group", F.floor(number / FAN).cast("long"))
        grouped = level.join(order, ["dim", "part"]).drop("part").withColumnRenamed("group", "part")
        level = stage(grouped.groupBy("dim", "part").applyInArrow(reduce_triangles, TRIANGLE), "triangles")
    return {r["dim"]: np.array(r["r"]).reshape(-1, r["dim"]) for r in level.collect()}


def fit(df: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", vector: str = "embedding") -> dict[int, Model]:
    """One model per vector length; a table without a usable vector gives none.

    What reaches the driver is one triangle per length, whatever the number of rows. An entry whose integer would pass
    2**61 counts as 2**61.
    """
    rows = _valid(df, vec_id, vector)
    sums = _sums(rows)
    if not sums:
        return {}
    models = {}
    for dim, r in _triangles(rows, sums).items():
        values, vectors = principal(r, min(components, dim))
        models[dim] = Model(*sums[dim], values / sums[dim][0], vectors)
    return models


def identity_errors(df: DataFrame, models: dict[int, Model], vec_id: str = "vec_id", vector: str = "embedding") -> dict[int, float]:
    """Per length, the largest entry of (covariance of the whitened rows - identity), over directions that have a variance."""
    if not models:
        return {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for dim, block in _by_length(batches):
            model = models[dim]
            w = np.column_stack([np.ones(block.num_rows), np.nan_to_num(model.whiten(_integers(block.column("v"), dim)))])
            held[dim] = held.get(dim, 0.0) + w.T @ w
        for dim, m in held.items():
            i, j = np.triu_indices(len(m))
            yield pa.RecordBatch.from_pydict({"dim": pa.array([dim] * len(i), pa.int32()), "i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "s": m[i, j]})

    parts = arrow_map(_valid(df, vec_id, vector), run, "dim int, i int, j int, s double")
    moments = parts.groupBy("dim", "i", "j").agg(F.sum("s").alias("s")).toPandas()
    errors = {}
    for dim, group in moments.groupby("dim"):
        model = models[int(dim)]
        k = model.directions.shape[1] + 1
        m = np.zeros((k, k))
        m[group["i"], group["j"]] = group["s"] / model.n
        covariance = m[1:, 1:] - np.outer(m[0, 1:], m[0, 1:])
        real = np.isfinite(model.scales())
        off = np.abs(np.triu(covariance - np.eye(k - 1)))[np.ix_(real, real)]
        errors[int(dim)] = float(off.max()) if off.size else 0.0
    return errors


def whiten(df: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Whitened coordinates: one row per vector and component with vec_id, component (from 1), n, deviation, whitened,
    explained and identity_error.

    Vectors that are null, empty or hold a null or non-finite entry have no rows. Vectors of different lengths are fitted
    apart, each with its own n. Repeated rows count and return as often as they occur, also without a vec_id. A component
    without variance has whitened null; explained is null if no component has any. A deviation beyond 64 bits is null.
    Other columns of ``df`` are ignored; a table without a usable vector gives no rows.
    """
    models = fit(df, components, vec_id, vector)
    errors = identity_errors(df, models, vec_id, vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, whole in _by_length(batches):
            model = models[dim]
            k = model.directions.shape[1]
            total = float(model.variances.sum())
            explained = model.variances[:k] / total if total > 0 else np.full(k, np.nan)
            step = max(1, 1 << 16 // k)
            for a in range(0, whole.num_rows, step):
                block = whole.slice(a, step)
                x, rows = _integers(block.column("v"), dim), block.num_rows
                each = np.repeat(np.arange(rows), k)
                yield pa.RecordBatch.from_pydict({
                    "vec_id": block.column("vec_id").take(pa.array(each)),
                    "component": pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()),
                    "n": pa.array(np.full(rows * k, model.n), pa.int64()),
                    "deviation": _square_sums(_scaled_deviations(x, model.n, model.sums)).take(pa.array(each)),
                    "whitened": pa.array(model.whiten(x).ravel(), pa.float64(), from_pandas=True),
                    "explained": pa.array(np.tile(explained, rows), pa.float64(), from_pandas=True),
                    "identity_error": pa.array(np.full(rows * k, errors[dim]), pa.float64()),
                })

    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return arrow_map(_valid(df, vec_id, vector), run, schema)


@query("op11_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
