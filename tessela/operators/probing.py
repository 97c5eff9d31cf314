"""Exact searches that never meet what cannot matter.

A cell of an index and a block of a threshold join both have a few numbers that bound every score inside them. A query
visits a cell only while that bound can beat what the query has, so the result is exact whatever the data look like; only the
share of pairs that are scored depends on them. Random directions bound badly and are nearly all scored, clusters are not.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessela.functions import vectors
from tessela.operators import ann
from tessela.session import materialize

SLACK = 1e-8  # scores are ranked at nine digits
SAMPLE_ROWS = 512


@dataclass
class Bounded:
    """(query_id, id, score, rank), and how many of all pairs were scored."""

    found: DataFrame
    share: float


@dataclass
class _Cells:
    """What bounds the scores of each cell: its size, radius around the centroid, widest angle, shortest and longest vector."""

    centroids: np.ndarray
    size: np.ndarray
    radius: np.ndarray
    angle: np.ndarray
    short: np.ndarray
    long: np.ndarray

    def best_possible(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For a batch of queries, the inner product with each centroid and a bound on that with any vector of the cell."""
        toward = queries @ self.centroids.T
        length = np.sqrt((queries ** 2).sum(axis=1))[:, None]
        ball = toward + length * self.radius
        norms = length * np.sqrt((self.centroids ** 2).sum(axis=1))
        to_centroid = np.arccos(np.clip(np.divide(toward, norms, out=np.ones_like(toward), where=norms > 0), -1.0, 1.0))
        nearest = np.cos(np.maximum(0.0, to_centroid - self.angle))
        cone = length * nearest * np.where(nearest >= 0, self.long, self.short)
        bound = np.minimum(ball, cone) + SLACK * (1.0 + length * self.long)
        return toward, np.where(self.size > 0, bound, -np.inf)


def _cells(index: ann.IvfIndex) -> _Cells:
    """One aggregate over the index; one row per cell comes to the driver, as the centroids did."""
    centroids = index.centroids

    @F.pandas_udf("distance double, angle double, length double")
    def place(vector: pd.Series, cell: pd.Series) -> pd.DataFrame:
        if vector.empty:
            return pd.DataFrame({"distance": [], "angle": [], "length": []}, dtype=float)
        v, c = ann._matrix(vector), centroids[cell.to_numpy()]
        length, norms = np.sqrt((v ** 2).sum(axis=1)), np.sqrt((c ** 2).sum(axis=1))
        cosine = np.divide((v * c).sum(axis=1), length * norms, out=np.full(len(v), -1.0), where=length * norms > 0)
        return pd.DataFrame({"distance": np.sqrt(((v - c) ** 2).sum(axis=1)), "angle": np.arccos(np.clip(cosine, -1.0, 1.0)), "length": length})

    rows = index.table.select("cell", place("vector", "cell").alias("p")).groupBy("cell").agg(
        F.count(F.lit(1)).alias("size"), F.max("p.distance").alias("radius"), F.max("p.angle").alias("angle"),
        F.min("p.length").alias("short"), F.max("p.length").alias("long")).collect()
    columns = {name: np.zeros(len(centroids)) for name in ("size", "radius", "angle", "short", "long")}
    for row in rows:
        for name, values in columns.items():
            values[row["cell"]] = row[name]
    return _Cells(centroids, **columns)


def ivf_search_bounded(
    queries: DataFrame, index: ann.IvfIndex, k: int = 10, exclude_self: bool = False, first: int = 2, growth: int = 4,
    block_rows: int = ann.BLOCK_ROWS,
) -> Bounded:
    """The exact k best: a query visits no cell that cannot hold anything better than its k-th.

    The first round asks the ``first * (1 + growth)`` cells with the best centroids, or an eighth of all cells if that is fewer but
    more than ``first``, only for a k-th score, one number per query and block. The second visits all cells that can reach the best of these numbers, those of the first round included, and
    its blocks hand on only what reaches it. So neighbours are shuffled once and never written. A query that finds fewer than k neighbours
    in the first round stays open; without queries or vectors the result is empty.
    """
    cells = _cells(index)
    head = max(first, min(first * (1 + growth), index.nlist // 8))

    @F.pandas_udf("cells binary, scored long")
    def open_cells(vector: pd.Series, least: pd.Series, last: pd.Series) -> pd.DataFrame:
        sets, scored = [], []
        for at in range(0, len(vector), 256):
            part = slice(at, at + 256)
            toward, bound = cells.best_possible(ann._matrix(vector.iloc[part]))
            if last.iloc[at]:
                opened = bound >= least.iloc[part].fillna(-np.inf).to_numpy(dtype=float)[:, None]
            else:
                opened = np.zeros(bound.shape, bool)
                np.put_along_axis(opened, np.argsort(-toward, axis=1, kind="stable")[:, :head], True, axis=1)
            opened &= cells.size > 0
            sets.append(ann._cell_set(opened))
            scored.append(opened @ cells.size)
        if not sets:
            return pd.DataFrame({"cells": [], "scored": []})
        return pd.DataFrame({"cells": pd.concat(sets, ignore_index=True), "scored": np.concatenate(scored).astype(np.int64)})

    query_type, base = f"query_id {ann._id_type(queries, 'query_id')}", index.table.select("id", "vector", "cell")
    best_of_block = ann._cells_top_k(k, exclude_self, index.nlist, block_rows, ann._inner_products)

    def kth_of_block(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = best_of_block(q, b).sort_values("score", ascending=False, kind="stable")
        return found.groupby("query_id").nth(k - 1)[["query_id", "score"]]

    def in_blocks(asking: DataFrame, last: bool, work, schema: str) -> tuple[DataFrame, float]:
        visits = materialize(asking.select("query_id", "vector", "least", open_cells("vector", "least", F.lit(last)).alias("visit")).select(
            "query_id", "vector", "least", "visit.cells", "visit.scored").where(F.col("scored") > 0), "visits")
        asked, met = visits.agg(F.count(F.lit(1)), F.sum("scored")).first()
        # a block hands on k rows of each query in the last round, often more than its vector weighs
        weight = 8.0 * cells.centroids.shape[1]
        rows = ann._least_sent(
            asked, int(cells.size.sum()), queries.sparkSession.sparkContext.defaultParallelism, weight + 32.0 * (k if last else 1), weight)
        q, b, keys = ann._in_cell_blocks(
            visits.drop("scored"), base, cells.size.astype(np.int64), max(block_rows, rows), max(block_rows, ann.BLOCK_ROWS))
        return ann._in_blocks(q, b, keys, work, schema), float(met or 0)

    asking, scored = queries.select("query_id", "vector", F.lit(None).cast("double").alias("least")), 0.0
    if head < index.nlist:
        kth, scored = in_blocks(asking, False, kth_of_block, f"{query_type}, score double")
        asking = asking.drop("least").join(kth.groupBy("query_id").agg(F.max("score").alias("least")), "query_id", "left")
    found, met = in_blocks(asking, True, best_of_block, f"{query_type}, id {ann._id_type(index.table, 'id')}, score double")
    return Bounded(ann._merge_top_k(found, k), (scored + met) / max(1.0, float(queries.count()) * cells.size.sum()))


def _pivots(base: DataFrame, count: int) -> np.ndarray:
    """Vectors far from each other, out of at most ``SAMPLE_ROWS`` base vectors. They decide the work, never the result."""
    sample = [r["vector"] for r in base.select("vector", F.xxhash64("id").alias("h")).orderBy("h").limit(SAMPLE_ROWS).collect()]
    points = np.array(sample, dtype=float)
    if not len(points):
        return points
    chosen = [int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmax())]
    while len(chosen) < min(count, len(points)):
        nearest = np.min([((points - points[c]) ** 2).sum(axis=1) for c in chosen], axis=0)
        chosen.append(int(nearest.argmax()))
    return points[chosen]


@dataclass
class _Boxes:
    """Boxes of distances to the pivots, by the name of their cell; a box holds at least one base vector, at most 16 boxes lie along a pivot."""

    low: np.ndarray
    high: np.ndarray
    longest: np.ndarray
    size: np.ndarray
    threshold: float

    def reached(self, distances: np.ndarray, length: np.ndarray) -> np.ndarray:
        """(query, box): can the box hold a vector whose product with the query reaches the threshold."""
        square = length[:, None] ** 2 + self.longest ** 2 - 2 * (self.threshold - SLACK)
        reach = np.sqrt(np.maximum(square, 0.0)) + SLACK
        opened = square >= 0
        for i in range(distances.shape[1]):
            d = distances[:, i, None]
            opened &= (d - self.high[:, i] <= reach) & (self.low[:, i] - d <= reach)
        return opened


def _in_boxes(queries: DataFrame, base: DataFrame, threshold: float, pivots: int) -> tuple[DataFrame, DataFrame, _Boxes] | None:
    """Queries with the set ``cells`` of the boxes that they can reach, base rows with the number ``cell`` of theirs; None without base vectors.

    A base cell is a box of distances to the pivots. Two vectors whose product reaches the threshold are at most
    sqrt(|q|^2 + |v|^2 - 2 threshold) apart, so their distances to a pivot differ by no more than that. One row per box comes to the driver.
    """
    points = _pivots(base, pivots)
    if not len(points):
        return None

    @F.pandas_udf("array<double>")
    def distances(vector: pd.Series) -> pd.Series:
        if vector.empty:
            return pd.Series([], dtype=object)
        v = ann._matrix(vector)
        return pd.Series(list(np.stack([np.sqrt(((v - p) ** 2).sum(axis=1)) for p in points], axis=1)))

    # written once: lengths and distances are asked for many times below
    far = materialize(base.withColumn("d", distances("vector")).withColumn("length", vectors.norm(F.col("vector"))), "pivot-base")
    at = [F.col("d")[i] for i in range(len(points))]
    ends = far.agg(F.max("length").alias("longest"), *[f(d).alias(f"{n}{i}") for i, d in enumerate(at) for n, f in (("low", F.min), ("high", F.max))]).first()
    widest = float(np.sqrt(max(0.0, 2 * ends["longest"] ** 2 - 2 * threshold)))
    widths = [max(widest / 2, (ends[f"high{i}"] - ends[f"low{i}"]) / 16) or 1.0 for i in range(len(points))]
    name = F.concat_ws(":", *[F.floor(d / w).cast("string") for d, w in zip(at, widths)])
    rows = far.groupBy(name.alias("name")).agg(
        F.count(F.lit(1)).alias("size"), F.max("length").alias("longest"),
        *[f(d).alias(f"{n}{i}") for i, d in enumerate(at) for n, f in (("low", F.min), ("high", F.max))]).collect()
    # boxes next to each other are likely to be visited together
    rows.sort(key=lambda r: [r[f"low{i}"] for i in range(len(points))])
    columns = {c: np.array([[r[f"{c}{i}"] for i in range(len(points))] for r in rows], float) for c in ("low", "high")}
    boxes = _Boxes(**columns, longest=np.array([r["longest"] for r in rows], float), size=np.array([r["size"] for r in rows]), threshold=threshold)
    numbers = {r["name"]: i for i, r in enumerate(rows)}

    @F.pandas_udf("int")
    def number(names: pd.Series) -> pd.Series:
        return names.map(numbers).astype("int32")

    @F.pandas_udf("binary")
    def reached(vector: pd.Series, d: pd.Series, length: pd.Series) -> pd.Series:
        sets = [ann._cell_set(boxes.reached(ann._matrix(d.iloc[i:i + 256]), length.iloc[i:i + 256].to_numpy())) for i in range(0, len(d), 256)]
        return pd.concat(sets, ignore_index=True) if sets else pd.Series([], dtype=object)

    ask = queries.withColumn("cells", reached("vector", distances("vector"), vectors.norm(F.col("vector"))))
    return materialize(ask, "pivot-visits"), far.select(*base.columns, number(name).alias("cell")), boxes


def pivot_cells(queries: DataFrame, base: DataFrame, threshold: float, pivots: int = 4) -> tuple[DataFrame, DataFrame]:
    """Both sides with a ``cell``, queries once for each: no base vector with an inner product of at least ``threshold`` lies outside the
    cells of its query. The searches below send a query once for many cells instead."""
    sides = _in_boxes(queries, base, threshold, pivots)
    if sides is None:
        return queries.withColumn("cell", F.lit(None).cast("int")).limit(0), base.withColumn("cell", F.lit(None).cast("int"))
    ask, far, boxes = sides

    @F.pandas_udf("array<int>")
    def numbers(sets: pd.Series) -> pd.Series:
        if sets.empty:
            return pd.Series([], dtype=object)
        return pd.Series([np.flatnonzero(row).astype(np.int32) for row in ann._opened(sets, len(boxes.size))], dtype=object)

    return ask.select(*queries.columns, F.explode(numbers("cells")).alias("cell")), far


def _meet_in_boxes(queries: DataFrame, base: DataFrame, threshold: float, pivots: int, block_rows: int, work_of, schema: str) -> DataFrame:
    """``work_of(number of boxes)`` on the common blocks of queries and base rows; empty without base vectors."""
    sides = _in_boxes(queries, base, threshold, pivots)
    if sides is None:
        return queries.sparkSession.createDataFrame([], schema)
    q, b, boxes = sides
    weight = q.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    rows = ann._least_sent(
        weight[0], int(boxes.size.sum()), queries.sparkSession.sparkContext.defaultParallelism, 8.0 * (weight[1] or 1), 8.0 * (weight[1] or 1))
    q, b, keys = ann._in_cell_blocks(q, b, boxes.size, max(block_rows, rows), max(block_rows, ann.BLOCK_ROWS))
    return ann._in_blocks(q, b, keys, work_of(len(boxes.size)), schema)


def similar_above_pruned(
    queries: DataFrame, base: DataFrame, threshold: float, pivots: int = 4, block_rows: int = ann.BLOCK_ROWS
) -> DataFrame:
    """``ann.similar_above`` without the pairs that pivots rule out; queries without a neighbour have no row."""
    schema = f"query_id {ann._id_type(queries, 'query_id')}, similarity_sum double, weighted_sum double, neighbours long"
    sums = _meet_in_boxes(
        queries.select("query_id", "vector"), base.select("id", "vector", "value"), threshold, pivots, block_rows,
        lambda cells: ann._cells_sums_above(threshold, cells), schema)
    return sums.groupBy("query_id").agg(
        F.sum("similarity_sum").alias("similarity_sum"), F.sum("weighted_sum").alias("weighted_sum"), F.sum("neighbours").alias("neighbours"),
    ).where(F.col("neighbours") > 0)


def topk_above(
    queries: DataFrame, base: DataFrame, threshold: float, k: int = 5, exclude_self: bool = False, pivots: int = 4,
    block_rows: int = ann.BLOCK_ROWS,
) -> DataFrame:
    """(query_id, id, score, rank): the k best cosines of each query that reach the threshold, exact."""
    unit = vectors.l2_normalize(F.col("vector"))
    schema = f"query_id {ann._id_type(queries, 'query_id')}, id {ann._id_type(base, 'id')}, score double"
    found = _meet_in_boxes(
        queries.select("query_id", unit.alias("vector")), base.select("id", unit.alias("vector")), threshold, pivots, block_rows,
        lambda cells: ann._cells_top_k(k, exclude_self, cells, block_rows, ann._inner_products, threshold), schema)
    return ann._merge_top_k(found.where(F.col("score") >= threshold), k)
