"""Nearest neighbours by cosine over balanced posting lists.

Centroids are fitted on a bounded sample by balanced halving; every row of the table is indexed. A vector goes to its
nearest list and, near a boundary, to further lists that lie in another direction. A query finds its nearest centroids in
a graph held in memory and takes all lists within a ratio of the nearest distance. Lists meet queries in tiles of bounded
size, so a list that holds a third of all rows is many tasks. Scores are exact cosines of the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessela.llm.common import arrow_map, spread, stage, table
from tessela.llm.registry import query
from tessela.llm.sigtree import runs
from tessela.llm.vectors import CentroidGraph, balanced_centroids, by_length, cosines, matrix, sample, unit, valid

REPLICAS = 4
BOUNDARY = 0.02
RATIO = 0.35
PER_CENTROID = 8
BASE_BLOCK, QUERY_BLOCK = 4096, 1024
BATCH = 512


@dataclass
class Index:
    """The fitted graph, and the written posting lists: rows (list, vec_id, v, home) and sizes by list."""

    graph: CentroidGraph
    postings: DataFrame
    sizes: np.ndarray
    homes: np.ndarray
    keep: int


def build(rows: DataFrame, keep: int) -> Index | None:
    """Index (vec_id, v). Of equal vectors only the ``keep`` smallest ids are held, which is all a search for fewer can return.

    The number of lists follows the square root of the table, at most one per PER_CENTROID sampled vectors. None if empty.
    """
    count = rows.count()
    if not count:
        return None
    dim = len(rows.first()["v"])
    points = sample(rows, count, dim)
    lists = max(1, min(round(count**0.5), len(points) // PER_CENTROID))
    graph = CentroidGraph(balanced_centroids(points, lists))
    same = Window.partitionBy(F.xxhash64("v"), F.xxhash64(F.lit("v"), "v")).orderBy("vec_id")
    base = rows.withColumn("__n", F.row_number().over(same)).where(F.col("__n") <= keep).drop("__n")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH):
                part = batch.slice(a, BATCH)
                x = matrix(part.column("v"))
                row, where, home = boundary_lists(unit(x), graph)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(where, pa.int32()), part.column("vec_id").take(pa.array(row)), part.column("v").take(pa.array(row)).cast(pa.list_(pa.float64())), pa.array(home)],
                    names=["list", "vec_id", "v", "home"])

    postings = stage(arrow_map(base, assign, "list int, vec_id long, v array<double>, home boolean"), "postings")
    counted = postings.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("home").cast("int")).alias("h")).toPandas()
    sizes, homes = np.zeros(lists, np.int64), np.zeros(lists, np.int64)
    sizes[counted["list"]], homes[counted["list"]] = counted["n"], counted["h"]
    return Index(graph, postings, sizes, homes, keep)


def boundary_lists(x: np.ndarray, graph: CentroidGraph) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, list, home): the nearest list of each vector and up to REPLICAS - 1 boundary lists.

    A boundary list is within BOUNDARY of the nearest distance and not nearer to a chosen centroid than to the vector.
    """
    far = graph.search(x, BOUNDARY, 2 * REPLICAS)
    order = np.argsort(far, axis=1, kind="stable")[:, : 2 * REPLICAS]
    near = np.take_along_axis(far, order, axis=1)
    rows, lists, homes = [np.arange(len(x))], [order[:, 0]], [np.ones(len(x), bool)]
    c = graph.centroids
    taken = np.zeros(order.shape, bool)
    taken[:, 0] = True
    for j in range(1, order.shape[1]):
        ok = np.isfinite(near[:, j]) & (near[:, j] <= near[:, 0] * (1 + BOUNDARY)) & (taken.sum(1) < REPLICAS)
        for i in range(j):
            between = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", c[order[:, i]], c[order[:, j]])))
            ok &= ~taken[:, i] | (between >= 0.5 * near[:, j])
        taken[:, j] = ok
        rows.append(np.flatnonzero(ok))
        lists.append(order[ok, j])
        homes.append(np.zeros(int(ok.sum()), bool))
    return np.concatenate(rows), np.concatenate(lists), np.concatenate(homes)


def chosen_lists(x: np.ndarray, index_graph: CentroidGraph, homes: np.ndarray, k: int, ratio: float = RATIO) -> tuple[np.ndarray, np.ndarray]:
    """(row, list): all lists within ``ratio`` of the nearest, and more, nearest first, until they hold more than k vectors."""
    far = index_graph.search(x, ratio, 8)
    missing = np.isinf(far)
    if missing.any():  # only for the rows that need more lists than the walk has reached
        short = ((~missing) @ homes) <= k
        if short.any():
            far[short] = np.sqrt(np.maximum(0, 2 - 2 * x[short].astype(np.float32) @ index_graph.centroids.T))
    order = np.argsort(far, axis=1, kind="stable")
    near = np.take_along_axis(far, order, axis=1)
    held = np.cumsum(homes[order], axis=1) - homes[order]
    take = np.isfinite(near) & ((near <= near[:, :1] * (1 + ratio)) | (held <= k))
    row, slot = np.nonzero(take)
    return row, order[row, slot]


def search(index: Index, queries: DataFrame, k: int, ratio: float = RATIO) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each of queries (vec_id, v), never the query itself."""
    if k >= index.keep:
        raise ValueError("the index holds too few of each group of equal vectors for this k")
    graph, sizes, homes = index.graph, index.sizes, index.homes

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH):
                part = batch.slice(a, BATCH)
                row, where = chosen_lists(unit(matrix(part.column("v"))), graph, homes, k, ratio)
                ids = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(where, pa.int32()), part.column("vec_id").take(ids), part.column("v").take(ids).cast(pa.list_(pa.float64()))], names=["list", "vec_id", "v"])

    asked = stage(arrow_map(queries, route, "list int, vec_id long, v array<double>"), "asked")
    # one number per list, the same bound as the centroids: blocks of its vectors, slices of the queries that chose it (none: not read)
    counted = asked.groupBy("list").count().toPandas()
    slices = np.zeros(len(sizes), np.int64)
    slices[counted["list"]] = -(-counted["count"] // (QUERY_BLOCK * 4))
    n_slices = F.element_at(F.array(*[F.lit(int(n)) for n in slices]), F.col("list") + 1)
    blocks = F.array(*[F.lit(int(b)) for b in np.maximum(1, -(-sizes // BASE_BLOCK))])
    n_blocks = F.element_at(blocks, F.col("list") + 1)
    base = index.postings.withColumn("block", F.pmod(F.xxhash64(F.lit("b"), "vec_id"), n_blocks).cast("int"))
    base = base.where(n_slices > 0).withColumn("slice", F.explode(F.sequence(F.lit(0), n_slices - 1))).withColumn("is_query", F.lit(False))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
    asked = asked.withColumn("slice", F.pmod(F.xxhash64(F.lit("q"), "vec_id"), n_slices).cast("int")).withColumn("is_query", F.lit(True))
    columns = [F.xxhash64("list", "block", "slice").alias("tile"), "is_query", "vec_id", "v"]
    both = spread(base.select(*columns).unionByName(asked.select(*columns)), "tile").sortWithinPartitions("tile")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        for tile in runs(batches, "tile"):
            is_query = tile.column("is_query").to_numpy()
            ids, v = tile.column("vec_id").to_numpy(), matrix(tile.column("v").combine_chunks())
            if is_query.any() and not is_query.all():
                found = nearest(ids[is_query], v[is_query], ids[~is_query], v[~is_query], k)
                held = tuple(np.concatenate(x) for x in zip(held, found, strict=True))
                if len(held[0]) > 1 << 18:
                    held = best(*held, k)
                    if len(held[0]) > 1 << 17:
                        yield _hits(*held)
                        held = tuple(x[:0] for x in held)
        yield _hits(*best(*held, k))

    hits = arrow_map(both, run, "query_id long, vec_id long, score double").distinct()
    first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _hits(query: np.ndarray, vec: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"query_id": query, "vec_id": vec, "score": score})


def best(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best distinct neighbours of each query."""
    order = np.lexsort((vec, -score, query))
    query, vec, score = query[order], vec[order], score[order]
    fresh = np.ones(len(query), bool)
    fresh[1:] = (query[1:] != query[:-1]) | (vec[1:] != vec[:-1])
    query, vec, score = query[fresh], vec[fresh], score[fresh]
    begin = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.empty(0, np.int64)
    place = np.arange(len(query)) - np.repeat(begin, np.diff(np.append(begin, len(query))))
    keep = place < k
    return query[keep], vec[keep], score[keep]


def nearest(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest rows of v for each row of q: a matrix product proposes, exact cosines decide ties and order."""
    out: list[tuple[np.ndarray, ...]] = []
    base = unit(v)
    for a in range(0, len(q), 256):
        mine = q_ids[a : a + 256]
        s = unit(q[a : a + 256]) @ base.T
        s[mine[:, None] == ids[None, :]] = -np.inf
        m = min(k, s.shape[1])
        floor = np.partition(s, s.shape[1] - m, axis=1)[:, s.shape[1] - m]
        row, col = np.nonzero((s >= floor[:, None] - 1e-9) & np.isfinite(s))
        out.append(best(mine[row], ids[col], cosines(q[a + row], v[col]), k))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def knn(df: DataFrame, queries, k: int, vec_id: str = "vec_id", vector: str = "embedding", ratio: float = RATIO) -> DataFrame:
    """The k nearest rows of the table for the rows that the condition ``queries`` on vec_id selects.

    Vectors that are null, zero, or hold null or non-finite components neither ask nor answer; nor do rows without an id.
    Vectors of different lengths are no neighbours; each length has its own index. Fewer candidates than k: all of them. Equal scores go by the smaller id. Rows of equal id are never neighbours of each
    other. An empty table gives an empty result.
    """
    rows = stage(valid(df, vec_id, vector), "vectors")
    parts = [search(build(part, k + 1), part.where(queries), k, ratio) for part in by_length(rows)]
    if not parts:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if len(parts) == 1:
        return parts[0]
    # an id may stand for vectors of several lengths
    found = reduce(DataFrame.unionByName, parts).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


@query("op3_nearest_neighbours")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)
