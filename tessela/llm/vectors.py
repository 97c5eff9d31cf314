"""What the two vector operators share: valid vectors, classes of equal vectors, balanced centroids, the centroid graph."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_BYTES = 16 << 20
SEED = 20240101


def valid(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, v): rows that take part: an id, no null or non-finite component, not zero."""
    v = F.col("v")
    fine = v.isNotNull() & (F.size(v) > 0) & F.col("vec_id").isNotNull()
    fine &= F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v")).where(fine & F.exists(v, lambda x: x != 0))


def by_length(rows: DataFrame) -> list[DataFrame]:
    """The rows of each length of ``v`` apart: vectors of different lengths have no cosine. One part if all are alike."""
    lengths = sorted(r["d"] for r in rows.select(F.size("v").alias("d")).distinct().collect())
    return [rows] if len(lengths) == 1 else [rows.where(F.size("v") == d) for d in lengths]


def matrix(column: pa.Array) -> np.ndarray:
    """A list column as a matrix of doubles; every list has the same length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first so that very large and very small components do not leave the range of doubles."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / norms(x)[:, None]


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of each row of x with the same row of y; the same two rows always give the same bits."""
    return (x * y).sum(axis=1) / (norms(x) * norms(y))


def sample(rows: DataFrame, count: int, dim: int) -> np.ndarray:
    """Unit vectors of a hashed sample of at most SAMPLE_BYTES in expectation; all rows if they fit."""
    bound = max(256, SAMPLE_BYTES // (8 * dim))
    share = min(1.0, bound / max(count, 1))
    chosen = rows if share == 1.0 else rows.where(F.pmod(F.xxhash64(F.lit("sample"), "vec_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    got = chosen.select("vec_id", "v").toPandas().sort_values("vec_id")
    return unit(np.stack(got["v"].to_numpy()).astype(np.float64)) if len(got) else np.empty((0, dim))


def balanced_centroids(points: np.ndarray, k: int, rounds: int = 4) -> np.ndarray:
    """``k`` unit centroids: the sample is halved again and again at equal sizes, then a few rounds with a size penalty."""
    rng = np.random.default_rng(SEED)
    leaves: list[np.ndarray] = []
    jobs = [(np.arange(len(points)), k)]
    while jobs:
        index, parts = jobs.pop()
        if parts == 1:
            leaves.append(index)
            continue
        left, x = parts // 2, points[index]
        centre = x[rng.choice(len(index), 2, replace=len(index) < 2)]
        for _ in range(5):
            order = np.argsort(-(x @ (centre[0] - centre[1])), kind="stable")
            cut = max(1, min(len(index) - 1, len(index) * left // parts)) if len(index) > 1 else 1
            centre = np.stack([x[order[:cut]].mean(0), x[order[cut:]].mean(0) if cut < len(index) else x[order[0]]])
        jobs += [(index[order[:cut]], left), (index[order[cut:]] if cut < len(index) else index, parts - left)]
    centroids = np.stack([points[i].mean(0) for i in leaves])
    penalty = np.zeros(k)
    for _ in range(rounds):
        owner = np.concatenate([(points[a : a + 4096] @ centroids.T - penalty).argmax(1) for a in range(0, len(points), 4096)])
        sizes = np.bincount(owner, minlength=k)
        total = np.zeros_like(centroids)
        np.add.at(total, owner, points)
        centroids = np.where(sizes[:, None] > 0, total / np.maximum(sizes, 1)[:, None], centroids)
        penalty += 0.02 * (sizes * k / len(points) - 1).clip(-1, 4)
        length = norms(centroids)
        centroids = np.where(length[:, None] > 1e-9, centroids / np.maximum(length, 1e-9)[:, None], points[rng.integers(len(points), size=k)])
    return centroids


class CentroidGraph:
    """Centroids linked to their nearest and to a few far ones, searched best first for a batch of vectors at once."""

    def __init__(self, centroids: np.ndarray, degree: int = 16, far: int = 4):
        self.centroids = centroids.astype(np.float32)
        k = len(centroids)
        rng = np.random.default_rng(SEED + 1)
        near = np.empty((k, min(degree, k)), np.int64)
        for a in range(0, k, 1024):
            s = self.centroids[a : a + 1024] @ self.centroids.T
            near[a : a + 1024] = np.argpartition(-s, min(degree, k) - 1, axis=1)[:, :degree]
        # a ring keeps the graph connected, whatever the nearest links are
        self.links = np.concatenate([near, rng.integers(k, size=(k, far)), ((np.arange(k) + 1) % k)[:, None]], axis=1)
        self.entries = np.unique(rng.integers(k, size=min(8, k)))

    def search(self, vectors: np.ndarray, ratio: float, at_least: int) -> np.ndarray:
        """Distances to all centroids that were reached (others infinite): at least those within ``ratio`` of the best.

        Expands the nearest unexpanded centroids while they are within the ratio or among the ``at_least`` best.
        """
        q = vectors.astype(np.float32)
        n, k = len(q), len(self.centroids)
        found = np.full((n, k), np.inf, np.float32)
        found[:, self.entries] = np.sqrt(np.maximum(0, 2 - 2 * q @ self.centroids[self.entries].T))
        done = np.zeros((n, k), bool)
        at_least = min(at_least, k)
        wide = min(8, k)
        while True:
            limit = np.maximum(found.min(axis=1) * (1 + ratio), np.partition(found, at_least - 1, axis=1)[:, at_least - 1])
            open_ = np.where(done | (found > limit[:, None]), np.inf, found)
            pick = np.argpartition(open_, wide - 1, axis=1)[:, :wide]
            row, slot = np.nonzero(np.isfinite(np.take_along_axis(open_, pick, axis=1)))
            if not len(row):
                return found
            node = pick[row, slot]
            done[row, node] = True
            r, c = np.repeat(row, self.links.shape[1]), self.links[node].ravel()
            new = np.isinf(found[r, c])
            r, c = r[new], c[new]
            pair = np.unique(r * k + c)
            r, c = pair // k, pair % k
            for a in range(0, len(r), 1 << 16):
                x, y = r[a : a + (1 << 16)], c[a : a + (1 << 16)]
                found[x, y] = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", q[x], self.centroids[y])))

