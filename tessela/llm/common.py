"""Shared helpers: staged tables, word hashing over Arrow buffers, disjoint sets, table reading."""

from __future__ import annotations

import contextlib
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessela.session import scratch_path, ship

WORD = r"[^\x20\x09-\x0D]+"
BATCH_BYTES = 8 << 20
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BASE, _MASK = 0x9E3779B97F4A7C15 | 1, (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back; the shuffle files it needed are given up at once."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str, at_least: int = 1) -> DataFrame:
    """Deal rows by key to as many partitions as the session asks for."""
    n = max(at_least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *keys)


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with batches bounded by bytes, so that long texts do not add up in a worker."""
    ship(df.sparkSession)
    df.sparkSession.conf.set(_BATCH_BYTES, str(BATCH_BYTES))
    return df.mapInArrow(fn, schema)


def word_count(text) -> F.Column:
    """Number of words of a text column; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


# ---- text buffers ---------------------------------------------------------------------------------------------------

def text_slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Cut a batch into slices of at most ``limit`` bytes of text, one row at least."""
    sizes = np.fromiter((0 if v is None else v for v in pc.binary_length(batch.column(column)).to_pylist()), np.int64, batch.num_rows)
    at = 0
    while at < batch.num_rows:
        n = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), limit, side="right")))
        yield batch.slice(at, n)
        at += n


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, and the n + 1 offsets; null counts as empty."""
    array = pc.fill_null(array.cast(pa.large_string()), "")
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    buffer = array.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data[:0], offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[65:91] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _UPPER[data]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words in text order, and the number of words of each text."""
    if not len(data):
        none = np.empty(0, np.int64)
        return none, none, np.zeros(len(offsets) - 1, np.int64)
    word = ~_SPACE[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over all output bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """64-bit hashes of byte spans (ascending, not overlapping); equal bytes give equal hashes wherever they stand."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        lo = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, lo + block, side="right")))
        hi = ends[to - 1]
        power, inverse = _power_tables(max(block, int(hi - lo)) + 1)
        sums = np.empty(hi - lo + 1, np.uint64)
        sums[0] = 0
        np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * power[: hi - lo], out=sums[1:])
        s, e = starts[at:to] - lo, ends[at:to] - lo
        out[at:to] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        at = to
    return out


def gram_hashes(words: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hashes of all runs of ``n`` words, in order; len(words) - n + 1 of them."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    total = np.full(len(words) - n + 1, np.uint64((salt * 0x632BE59BD9B4E019 + n) & _MASK), np.uint64)
    for i in range(n):
        total = mix(total * np.uint64(0xFF51AFD7ED558CCD) + words[i : len(words) - n + 1 + i])
    return total


def utf8(data: np.ndarray) -> bytes:
    return data.tobytes()


# ---- disjoint sets --------------------------------------------------------------------------------------------------

class Disjoint:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contract the edges of one partition to stars around the smallest vertex of each local component."""
    for batch in batches:
        a, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b"))
        ids, index = np.unique(np.concatenate([a, b]), return_inverse=True)
        sets = Disjoint(len(ids))
        for x, y in zip(index[: len(a)].tolist(), index[len(a) :].tolist(), strict=True):
            sets.union(x, y)
        root = np.fromiter((sets.find(i) for i in range(len(ids))), np.int64, len(ids))
        keep = root != np.arange(len(ids))
        yield pa.RecordBatch.from_pydict({"a": ids[keep], "b": ids[root[keep]]})


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges (a, b)``: rows (id, component), component the smallest id reachable.

    Alternates large-star and small-star steps until nothing changes. Each step is one aggregate of minima and one join
    with it, so a hub with very many edges is combined before the shuffle and its join may be split. Each step is a
    written table. Vertices without an edge are not returned; self loops are ignored.
    """
    edges = edges.where("a <> b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    edges = stage(arrow_map(edges, _local_stars, "a long, b long").distinct(), "edges")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = stage(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == now:
            break
        seen = now
    found = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return found.unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


# ---- files ----------------------------------------------------------------------------------------------------------

def file_system(uri: str):
    """A file system for tasks, and the path on it; any scheme that pyarrow knows, a bare path is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


@contextlib.contextmanager
def open_output(uri: str):
    where, path = file_system(uri)
    where.create_dir(os.path.dirname(path), recursive=True)
    with where.open_output_stream(path, compression=None) as out:
        yield out


def drop_folder(spark: SparkSession, uri: str) -> None:
    """Delete a folder that this library wrote."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
