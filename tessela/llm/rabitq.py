"""Near-duplicate vectors: randomly rotated binary codes estimate cosines, bounds decide which pairs are computed exactly.

Equal vectors are one class. Classes meet in cells around centroids: a vector is at home in the nearest cell and a guest
in every cell whose boundary is near. Inside a tile, the code of one vector (the signs of its rotated components) and its
stored correction factor give an unbiased estimate of the cosine with another. Only pairs whose upper confidence bound
reaches the threshold are computed from the original vectors, in doubles.

Guests: two vectors at the threshold are r = sqrt(2 - 2t) apart. If neither is a guest in the other's cell, the line
between them crosses the boundary at more than ``2 * margin``; the margin is r / 2, which excludes that wherever the
vectors lie. How many cells there are decides the work and never the result; the number with the least work in a sample
is taken, down to one cell, where no cells separate the vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessela.llm.common import arrow_map, components, spread, stage, table
from tessela.llm.registry import query
from tessela.llm.sigtree import runs
from tessela.llm.vectors import SEED, balanced_centroids, by_length, cosines, matrix, sample, unit, valid

EPSILON = 6.0
BLOCK = 4096  # rows of a side that are compared at once
FEW_BLOCKS = 16  # a cell is dealt in at most so many blocks, whose copies are the bytes that tiles move,
BLOCKS_AT_ONCE = 8  # while a block has no more than so many times BLOCK rows
PER_CENTROID = 8
MOVED = 10_000  # a row that is moved costs as much as so many estimates, its bytes on disk included


def rotation(dim: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(SEED + 2).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def encode(u: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed signs of the rotated components, correction factor <code, vector>) of unit vectors."""
    y = u @ turn
    return np.packbits(y > 0, axis=1), np.abs(y).sum(axis=1) / np.sqrt(u.shape[1])


def estimates(bits: np.ndarray, factor: np.ndarray, rotated: np.ndarray) -> np.ndarray:
    """Unbiased estimates of the inner products of coded vectors (rows) with rotated unit vectors (columns)."""
    dim = rotated.shape[1]
    signs = np.unpackbits(bits, axis=1, count=dim).astype(np.float32) * 2 - 1
    return (signs / (np.sqrt(dim) * factor[:, None]).astype(np.float32)) @ rotated.astype(np.float32).T


def least_estimate(factor: np.ndarray, dim: int, threshold: float, epsilon: float = EPSILON) -> np.ndarray:
    """The estimate below which a pair is surely under the threshold, per coded vector.

    The estimate of a cosine t errs by a standard deviation of sqrt(1 - t^2) sqrt(1 - f^2) / (f sqrt(dim - 1)) at most.
    """
    spread_ = np.sqrt(max(0.0, 1 - threshold**2)) * np.sqrt(np.maximum(0, 1 - factor**2)) / (factor * np.sqrt(max(dim - 1, 1)))
    return threshold - epsilon * spread_ - 1e-5


def near_pairs(x: np.ndarray, bits: np.ndarray, factor: np.ndarray, y: np.ndarray, turn: np.ndarray, threshold: float, upper: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with cosine at the threshold or more; with ``upper``, x and y are the same rows and i < j."""
    rows, cols = [], []
    rotated = unit(y) @ turn
    low = least_estimate(factor, x.shape[1], threshold).astype(np.float32)
    for a in range(0, len(x), 256):
        # few of all pairs are found, which is much faster in one dimension
        i, j = np.divmod(np.flatnonzero(estimates(bits[a : a + 256], factor[a : a + 256], rotated) >= low[a : a + 256, None]), len(y))
        i += a
        if upper:
            i, j = i[i < j], j[i < j]
        for b in range(0, len(i), 1 << 14):
            p, q = i[b : b + (1 << 14)], j[b : b + (1 << 14)]
            ok = cosines(x[p], y[q]) >= threshold
            rows.append(p[ok])
            cols.append(q[ok])
    none = np.empty(0, np.int64)
    return np.concatenate(rows or [none]), np.concatenate(cols or [none])


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of 0..n-1 reaches by the pairs (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def distances(centroids: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (centroids**2).sum(1)[:, None] + (centroids**2).sum(1) - 2 * centroids @ centroids.T))


def homes(u: np.ndarray, centroids: np.ndarray, apart: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(home, near): the cell of each unit vector, and whether it is at home or a guest in each cell."""
    # all centroids are unit vectors: the nearest boundary is where the products are equal
    product = u @ centroids.T
    home = product.argmax(1)
    at = np.arange(len(u)), home
    # half of the distance at the threshold, and more than rounding can take away
    near = product[at][:, None] - product <= np.sqrt(max(0.0, 2 - 2 * threshold)) / 2 * apart[home] + 1e-7
    near[at] = True
    return home, near


def block_count(rows: np.ndarray) -> np.ndarray:
    """Blocks that so many rows of a cell are dealt in."""
    few = np.minimum(np.ceil(rows / BLOCK), FEW_BLOCKS)
    return np.maximum(1, np.maximum(few, np.ceil(rows / (BLOCK * BLOCKS_AT_ONCE))))


def work(points: np.ndarray, centroids: np.ndarray, threshold: float, count: int) -> float:
    """Estimates and moved rows that ``count`` vectors distributed like ``points`` take in these cells."""
    k, apart = len(centroids), distances(centroids)
    at_home, in_all = np.zeros(k), np.zeros(k)
    for a in range(0, len(points), 4096):
        home, near = homes(points[a : a + 4096], centroids, apart, threshold)
        at_home += np.bincount(home, minlength=k)
        in_all += near.sum(0)
    h, g = at_home * count / len(points), (in_all - at_home) * count / len(points)
    blocks, guest_blocks = block_count(h), block_count(g)
    return float((h * h / 2 + h * g + MOVED * (h + g + h * (blocks + guest_blocks) + g * blocks)).sum())


def cell_centroids(points: np.ndarray, threshold: float, count: int) -> np.ndarray:
    """Centroids of the cells with the least work, out of the root of ``count``, half as many, and so on down to one."""
    k = max(1, min(round(count**0.5), len(points) // PER_CENTROID))
    made = [balanced_centroids(points, k >> halved) for halved in range(k.bit_length())]
    return min(made, key=lambda centroids: work(points, centroids, threshold, count))


def _cells(rows: DataFrame, centroids: np.ndarray, threshold: float) -> DataFrame:
    """(rep, copies, v, bits, factor, cell, home, guests): every class in its own cell and in those it is a guest of."""
    turn = rotation(centroids.shape[1])
    apart = distances(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                u = unit(matrix(part.column("v")))
                bits, factor = encode(u, turn)
                home, near = homes(u, centroids, apart, threshold)
                row, cell = np.nonzero(near)
                ids = pa.array(row)
                guests = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(u) + 1)), pa.int32()), pa.array(cell, pa.int32()))
                yield pa.RecordBatch.from_pydict({
                    "rep": part.column("rep").take(ids), "copies": part.column("copies").take(ids), "v": part.column("v").take(ids),
                    "bits": pa.array([b.tobytes() for b in bits], pa.binary()).take(ids), "factor": factor[row],
                    "cell": pa.array(cell, pa.int32()), "home": pa.array(home[row], pa.int32()), "guests": guests.take(ids),
                })

    kind = rows.schema["v"].dataType.simpleString()
    return arrow_map(rows, run, f"rep long, copies long, v {kind}, bits binary, factor double, cell int, home int, guests array<int>")


def _tiles(cells: DataFrame) -> DataFrame:
    """Home rows of a cell in blocks; a tile is two home blocks, or a home and a guest block.

    A row goes to one tile for each other block, so larger cells have larger blocks, up to ``BLOCKS_AT_ONCE`` times BLOCK rows.
    """
    def blocks(rows):
        few = F.least(F.ceil(rows / BLOCK), F.lit(FEW_BLOCKS))
        return F.greatest(F.lit(1), few, F.ceil(rows / (BLOCK * BLOCKS_AT_ONCE))).cast("int")

    is_home = F.col("cell") == F.col("home")
    sizes = cells.groupBy("cell").agg(F.sum(is_home.cast("long")).alias("h"), F.sum((~is_home).cast("long")).alias("g"))
    # one row per cell, of which there are at most as many as centroids from a sample of bounded size
    sizes = sizes.select(F.col("cell").alias("c"), blocks(F.col("h")).alias("h"), blocks(F.col("g")).alias("g"))
    rows = cells.join(F.broadcast(sizes), F.col("cell") == F.col("c")).withColumn("at_home", is_home)
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.lit("cell"), "rep"), F.when(F.col("at_home"), F.col("h")).otherwise(F.col("g"))).cast("int"))
    other = F.when(F.col("at_home"), F.concat(F.sequence(F.lit(0), F.col("h") - 1), F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda j: -1 - j))).otherwise(
        F.sequence(F.lit(0), F.col("h") - 1))
    rows = rows.withColumn("other", F.explode(other))
    first = F.when(~F.col("at_home"), F.col("other")).when(F.col("other") < 0, F.col("block")).otherwise(F.least("block", "other"))
    second = F.when(~F.col("at_home"), -1 - F.col("block")).when(F.col("other") < 0, F.col("other")).otherwise(F.greatest("block", "other"))
    return rows.withColumn("tile", F.xxhash64("cell", first, second)).withColumn(
        "part", F.when(F.col("at_home"), F.col("block")).otherwise(F.lit(-1))).withColumn("hosting", second < 0)


def _found(a: list[np.ndarray], b: list[np.ndarray | None], n: list[np.ndarray]) -> pa.RecordBatch:
    first = np.concatenate(a) if a else np.empty(0, np.int64)
    second = [pa.nulls(len(x), pa.int64()) if y is None else pa.array(y, pa.int64()) for x, y in zip(a, b, strict=True)]
    return pa.RecordBatch.from_arrays([
        pa.array(first, pa.int64()), pa.concat_arrays(second) if second else pa.array([], pa.int64()), pa.array(np.concatenate(n) if n else first, pa.int64()),
    ], names=["a", "b", "n"])


def _squares(x: np.ndarray, y: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Two lists of rows in pieces of BLOCK rows, every two pieces once; whether they are the same piece."""
    for p in range(0, len(x), BLOCK):
        for q in range(p if same else 0, len(y), BLOCK):
            yield x[p : p + BLOCK], y[q : q + BLOCK], same and p == q


def _among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which keys are among the ascending ``known``."""
    if not len(known):
        return np.zeros(len(keys), bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


def linked(rows: DataFrame, centroids: np.ndarray, threshold: float) -> DataFrame:
    """(a, b, n): with b null, class a has n further linked vectors; else a and b are connected."""
    turn = rotation(centroids.shape[1])
    cells = stage(_cells(rows, centroids, threshold), "vector-cells")
    tiles = spread(_tiles(cells).select("tile", "part", "hosting", "rep", "copies", "v", "bits", "factor", "cell", "home", "guests"), "tile").sortWithinPartitions("tile")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[np.ndarray] = []
        b: list[np.ndarray | None] = []
        n: list[np.ndarray] = []
        for tile in runs(batches, "tile"):
            part, rep, copies, home = (tile.column(c).to_numpy() for c in ("part", "rep", "copies", "home"))
            v, factor = matrix(tile.column("v").combine_chunks()), tile.column("factor").to_numpy()
            bits = np.frombuffer(b"".join(tile.column("bits").to_pylist()), np.uint8).reshape(len(rep), -1)
            blocks = np.unique(part)
            x = np.flatnonzero(part == blocks[-1])
            y = np.flatnonzero(part == blocks[0])
            same = len(blocks) == 1
            if same and tile.column("hosting")[0].as_py():
                continue  # hosts without guests, or guests without hosts
            hosted = None
            if not same and blocks[0] < 0:
                lists = tile.column("guests").combine_chunks()
                host = np.repeat(np.arange(len(rep)), np.diff(lists.offsets.to_numpy()))
                hosted = np.unique(host * (1 << 31) + lists.flatten().to_numpy())
            count, ups, tops = np.zeros(len(rep)), [], []
            for xs, ys, alike in _squares(x, y, same):
                i, j = near_pairs(v[xs], bits[xs], factor[xs], v[ys], turn, threshold, upper=alike)
                i, j = xs[i], ys[j]
                if hosted is not None:
                    # a host that is a guest in its guest's cell meets it there too: the smaller cell counts
                    keep = ~_among(i * (1 << 31) + home[j], hosted) | (home[i] < home[j])
                    i, j = i[keep], j[keep]
                if not len(i):
                    continue
                count += np.bincount(i, weights=copies[j], minlength=len(rep)) + np.bincount(j, weights=copies[i], minlength=len(rep))
                root = local_roots(len(rep), i, j)
                ups.append(np.flatnonzero(root != np.arange(len(rep))))
                tops.append(root[ups[-1]])
            if not ups:
                continue
            some = np.flatnonzero(count)
            root = root if len(ups) == 1 else local_roots(len(rep), np.concatenate(ups), np.concatenate(tops))
            moved = np.flatnonzero(root != np.arange(len(rep)))
            a += [rep[some], rep[moved]]
            b += [None, rep[root[moved]]]
            n += [count[some].astype(np.int64), np.zeros(len(moved), np.int64)]
            if sum(map(len, a)) > 1 << 16:
                yield _found(a, b, n)
                a, b, n = [], [], []
        yield _found(a, b, n)

    return arrow_map(tiles, run, "a long, b long, n long")


def near_vectors(df: DataFrame, threshold: float, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row: links at ``threshold`` or more, whatever other columns say.

    Vectors that are null, zero or hold null or non-finite components, or without an id have no links and are kept.
    Vectors of different lengths do not link; each length is compared on its own. Equal vectors link. Rows of equal id are one vector per distinct content; the id gets the sum of
    their links, less those among themselves. An empty table gives an empty result.
    """
    every = df.select(F.col(vec_id).cast("long").alias("vec_id"))
    rows = valid(df, vec_id, vector).select("vec_id", F.transform("v", lambda x: x.cast("double")).alias("v"))
    # doubles that were floats go on as floats, which are half as long
    kept = "array<float>" if df.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    rows = rows.withColumn("x", F.xxhash64("v")).withColumn("y", F.xxhash64(F.lit("v"), "v"))
    classes = stage(rows.groupBy("x", "y").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("v").cast(kept).alias("v")), "vector-classes")
    parts = by_length(classes)
    if not parts:
        return every.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))

    def links(part: DataFrame) -> DataFrame:
        count = part.count()
        points = sample(part.withColumnRenamed("rep", "vec_id"), count, len(part.first()["v"]))
        centroids = cell_centroids(points, threshold, count)
        return stage(linked(part.select("rep", "copies", "v"), centroids, threshold), "vector-links")

    # a rep may stand for vectors of two lengths under one id: its links add up, as those of two contents of an id do
    found = reduce(DataFrame.unionByName, [links(part) for part in parts])
    counts = found.where("b IS NULL").groupBy("a").agg(F.sum("n").alias("n"))
    groups = components(found.where("b IS NOT NULL").select("a", "b"))
    of_class = classes.select("x", "y", "rep", "copies").join(counts, F.col("rep") == F.col("a"), "left").drop("a")
    of_class = of_class.join(groups, F.col("rep") == F.col("id"), "left").select(
        "x", "y", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    of_id = rows.select("vec_id", "x", "y").join(of_class, ["x", "y"]).groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = every.join(of_id, "vec_id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


_OP8 = """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0 AND list_sum(list_transform(embedding, lambda c: abs(c))) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.95),
r(vec_id, reached) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.reached = l.a),
c AS (SELECT vec_id, min(reached) AS component_id FROM r GROUP BY 1), n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)"""


@query("op8_embedding_near_dedup", _OP8)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), 0.95)
