"""Exact Jaccard join of shingle sets with signature trees.

1. Every document becomes the set of its word shingles; equal sets are one class, represented by the smallest id.
2. Representatives meet in buckets of min-hash bands. A bucket is a signature tree: leaves hold bitmaps of hashed
   shingles, inner nodes their OR and the range of sizes. Walking the tree against itself drops node pairs whose largest
   possible overlap is too small; what is left are links that may hold. They join representatives to families.
3. Inside a family the sets themselves are compared, again along a signature tree, and pairs that pass are links.

Bands: a pair at the threshold of 0.85 shares no band with probability (1 - 0.85 ** 5) ** 40 = 7e-11 (0.8: 1e-7), less above it; all
later steps are exact. Buckets and families of any size are cut into tiles of bounded size, so no task holds a whole one.
Inside a tile, pairs whose ends are already linked are skipped unless all links are asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessela.llm.common import (
    Disjoint, arrow_map, components, gram_hashes, lower_ascii, mix, span_hashes, spread, stage, table, text_bytes,
    text_slices, word_spans,
)
from tessela.llm.registry import query

BANDS, ROWS = 40, 5
BITS = 2048
LEAF, FAN = 16, 8
BUCKET_BLOCK = 2048
FAMILY_DOCS, FAMILY_SHINGLES = 512, 1 << 20

_A = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint32) | np.uint32(1)
_B = mix(np.arange(7001, 7001 + BANDS * ROWS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint32)


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, A-Z lower-cased; a text of fewer than n words is one shingle."""
    data, offsets = text_bytes(texts)
    data = lower_ascii(data)
    starts, ends, per = word_spans(data, offsets)
    words = span_hashes(data, starts, ends)
    every = gram_hashes(words, n)
    out, at = [], 0
    for k in per.tolist():
        if k >= n:
            out.append(np.unique(every[at : at + k - n + 1]))
        elif k:
            out.append(gram_hashes(words[at : at + k], k, salt=1))
        else:
            out.append(np.empty(0, np.uint64))
        at += k
    return out


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    """BANDS * ROWS minima, each under a hash function of its own."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        h = np.multiply.outer(x[at : at + 2048], _A)
        h += _B
        h ^= h >> np.uint32(15)
        np.minimum(low, h.min(axis=0), out=low)
    return low


def bitmap(shingles: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The set as ``bits`` bits, one per shingle hash."""
    out = np.zeros(bits, np.uint8)
    out[(shingles & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").view(np.uint64)


def sketches(documents: DataFrame, doc_id: str, text: str, n: int) -> DataFrame:
    """(doc_id, n_shingles, lo, hi, bands, bits): the size, a 128-bit name, the band keys and the bitmap of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                sets = shingle_sets(part.column("text"), n)
                with np.errstate(over="ignore"):
                    lo = [int(mix(s).sum()) if len(s) else 0 for s in sets]
                    hi = [int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum()) if len(s) else 0 for s in sets]
                low = np.stack([min_hashes(s) for s in sets]).astype(np.uint64).reshape(len(sets), BANDS, ROWS)
                keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sets), BANDS)).copy()
                for r in range(ROWS):
                    keys = mix(keys * np.uint64(0xFF51AFD7ED558CCD) + low[:, :, r])
                offsets = np.cumsum([0] + [BANDS if len(s) else 0 for s in sets])
                some = np.array([len(s) > 0 for s in sets])
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                    "lo": np.array(lo, np.uint64).view(np.int64), "hi": np.array(hi, np.uint64).view(np.int64),
                    "bands": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys[some].ravel().view(np.int64))),
                    "bits": pa.array([bitmap(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                })

    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return arrow_map(rows, run, "doc_id long, n_shingles long, lo long, hi long, bands array<long>, bits binary")


# ---- the tree -------------------------------------------------------------------------------------------------------

def _needed(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap of sets of sizes a and b that reaches ``percent``: overlap * (100 + percent) >= percent * (a + b)."""
    return -(-percent * (a + b) // (100 + percent))


class SignatureTree:
    """Rows sorted by size in leaves of LEAF; FAN nodes under each inner node. Level 0 holds the rows themselves."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        excess = sizes - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)  # shingles that share a bit with another
        self.levels = [(sizes, sizes, excess, bits)]
        width = LEAF
        while len(self.levels[-1][0]) > 1 or len(self.levels) < 2:
            low, high, most, ors = self.levels[-1]
            cut = np.arange(0, len(low), width)
            self.levels.append((np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(most, cut), np.bitwise_or.reduceat(ors, cut, axis=0)))
            width = FAN

    def may_link(self, level: int, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        """Whether a pair below these nodes can reach the threshold: by sizes first, then by shared bits."""
        low, high, most, ors = self.levels[level]
        ok = (100 * high[a] >= percent * low[b]) & (100 * high[b] >= percent * low[a])
        at = np.flatnonzero(ok)
        for k in range(0, len(at), 1 << 14):
            i = at[k : k + (1 << 14)]
            x, y = a[i], b[i]
            shared = np.bitwise_count(ors[x] & ors[y]).sum(axis=1, dtype=np.int64) + np.minimum(most[x], most[y])
            shared = np.minimum(shared, np.minimum(high[x], high[y]))
            ok[i] = shared >= _needed(low[x], low[y], percent)
        return ok


def tree_links(sizes: np.ndarray, bits: np.ndarray, percent: int, verify: Callable[[int, int], bool] | None = None,
               side: np.ndarray | None = None, forest: bool = True) -> list[tuple[int, int]]:
    """Links among the rows, found by walking the tree against itself; near leaves first.

    ``verify`` decides a pair that the bitmaps cannot exclude. With ``side``, only pairs of different sides count. With
    ``forest``, pairs whose ends are already linked by others are not looked at.
    """
    m = len(sizes)
    if m < 2:
        return []
    order = np.argsort(sizes, kind="stable")
    tree = SignatureTree(sizes[order], bits[order])
    sides = None if side is None else side[order]
    sets, links = Disjoint(m), []
    label = np.arange(m)

    def expand(level: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        width, n = (FAN if level > 1 else LEAF), len(tree.levels[level - 1][0])
        step = np.arange(width)
        x = (a[:, None, None] * width + step[None, :, None]) + 0 * step
        y = (b[:, None, None] * width + step[None, None, :]) + 0 * step[:, None]
        x, y = x.ravel(), y.ravel()
        keep = (x < n) & (y < n) & ((x < y) | ((x == y) & (level > 1)))
        return x[keep], y[keep]

    top = len(tree.levels) - 1
    a = b = np.zeros(1, np.int64)
    for level in range(top, 1, -1):
        a, b = expand(level, a, b)
        keep = tree.may_link(level - 1, a, b, percent)
        a, b = a[keep], b[keep]
    near = np.argsort(b - a, kind="stable")
    a, b = a[near], b[near]
    for k in range(0, len(a), 64):
        p, q = a[k : k + 64], b[k : k + 64]
        if forest and k:
            cut = np.arange(0, m, LEAF)
            lo, hi = np.minimum.reduceat(label, cut), np.maximum.reduceat(label, cut)
            todo = ~((lo[p] == hi[p]) & (lo[q] == hi[q]) & (lo[p] == lo[q]))
            p, q = p[todo], q[todo]
        x, y = expand(1, p, q)
        if sides is not None:
            keep = sides[x] != sides[y]
            x, y = x[keep], y[keep]
        if forest:
            keep = label[x] != label[y]
            x, y = x[keep], y[keep]
        keep = tree.may_link(0, x, y, percent)
        x, y = x[keep], y[keep]
        if verify is None and forest and len(x):
            _, first = np.unique(label[x] * m + label[y], return_index=True)
            x, y = x[first], y[first]
        found = False
        for i, j in zip(x.tolist(), y.tolist(), strict=True):
            if forest and sets.find(i) == sets.find(j):
                continue
            if verify is None or verify(int(order[i]), int(order[j])):
                links.append((int(order[i]), int(order[j])))
                sets.union(i, j)
                found = True
        if found and forest:
            label = np.fromiter((sets.find(i) for i in range(m)), np.int64, m)
    return links


# ---- tiles ----------------------------------------------------------------------------------------------------------

def with_tiles(rows: DataFrame, key: str, member: str, blocks) -> DataFrame:
    """Deal the rows of each key to ``blocks`` hashed blocks and every pair of blocks to a tile: adds tile and block.

    A key of one block is one tile. A pair of rows meets in exactly one tile where they are compared: the tile of their
    two blocks, or that of the block they share.
    """
    rows = rows.withColumn("__blocks", blocks).withColumn("block", F.pmod(F.xxhash64(F.lit("tile"), member), F.col("__blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("__blocks").cast("int") - 1))
    rows = rows.withColumn("__other", other)
    low, high = F.least("block", "__other"), F.greatest("block", "__other")
    return rows.withColumn("tile", F.xxhash64(key, low, high)).withColumn("inner", F.col("block") == F.col("__other")).drop("__blocks", "__other")


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The runs of equal ``key`` of a sorted partition, each as one table."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cut = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            if a == b:
                continue
            if held and keys[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = keys[a]
    if held:
        yield pa.Table.from_batches(held)


def _side(inner: np.ndarray, block: np.ndarray) -> np.ndarray | None:
    return None if inner.all() else block


def _link_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in pairs], pa.int64()), "b": pa.array([y for _, y in pairs], pa.int64())})


def possible_links(reps: DataFrame, percent: int) -> DataFrame:
    """Step 2: links (a, b) that the bitmaps allow between representatives that share a band; a forest per tile."""
    keyed = spread(reps.select("rep", F.explode("bands").alias("key")), "key")
    buckets = keyed.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.min("rep").alias("low"), F.max("rep").alias("high"),
    ).where("low < high")
    rows = stage(keyed.join(buckets, "key").select("key", "rep", "n", "x", "low", "high"), "join-buckets")
    # buckets with the same members say the same: one of them is enough
    kept = rows.groupBy("n", "x", "low", "high").agg(F.min("key").alias("key")).select("key")
    rows = rows.select("key", "rep", "n").join(kept, "key")
    rows = rows.join(reps.select("rep", "n_shingles", "bits"), "rep")
    rows = with_tiles(rows, "key", "rep", F.ceil(F.col("n") / BUCKET_BLOCK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        for one in runs(batches, "tile"):
            reps_, sizes, block = (one.column(c).to_numpy() for c in ("rep", "n_shingles", "block"))
            bits = np.frombuffer(b"".join(one.column("bits").to_pylist()), np.uint64).reshape(len(reps_), -1)
            links = tree_links(sizes, bits, percent, side=_side(one.column("inner").to_numpy(zero_copy_only=False), block))
            found += [(int(reps_[i]), int(reps_[j])) for i, j in links]
            if len(found) > 10_000:
                yield _link_batch(found)
                found = []
        yield _link_batch(found)

    dealt = spread(rows.select("tile", "inner", "block", "rep", "n_shingles", "bits"), "tile").sortWithinPartitions("tile")
    return arrow_map(dealt, run, "a long, b long")


def verified_links(documents: DataFrame, families: DataFrame, percent: int, n: int, forest: bool = True) -> DataFrame:
    """Step 3: links (a, b) whose sets reach the threshold; families (id, family, n_shingles) say who may be compared."""
    total = families.groupBy("family").agg(F.count(F.lit(1)).alias("__docs"), F.sum("n_shingles").alias("__shingles"))
    blocks = F.greatest(F.ceil(F.col("__docs") / FAMILY_DOCS), F.ceil(F.col("__shingles") / FAMILY_SHINGLES))
    rows = with_tiles(families.join(total, "family"), "family", "id", blocks).select("id", "tile", "inner", "block")
    texts = documents.join(rows, documents["doc_id"] == rows["id"]).select("id", "tile", "inner", "block", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        for one in runs(batches, "tile"):
            ids, block = (one.column(c).to_numpy() for c in ("id", "block"))
            sets = shingle_sets(one.column("text").combine_chunks(), n)
            sizes = np.array([len(s) for s in sets], np.int64)

            def verify(i: int, j: int, sets=sets) -> bool:
                same = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                return 100 * same >= percent * (len(sets[i]) + len(sets[j]) - same)

            links = tree_links(sizes, np.stack([bitmap(s) for s in sets]), percent, verify, _side(one.column("inner").to_numpy(zero_copy_only=False), block), forest)
            found += [(int(ids[i]), int(ids[j])) for i, j in links]
            if len(found) > 10_000:
                yield _link_batch(found)
                found = []
        yield _link_batch(found)

    return arrow_map(spread(texts, "tile").sortWithinPartitions("tile"), run, "a long, b long").where("a <> b")


def jaccard_join(documents: DataFrame, n: int, percent: int, doc_id: str = "doc_id", text: str = "text", forest: bool = True) -> tuple[DataFrame, DataFrame]:
    """(links, members): links (a, b) between representatives at ``percent`` or more, members (doc_id, n_shingles, rep).

    With ``forest``, links span every component but skip pairs that others already connect; without, all links of
    representatives are given. Documents with equal sets have one representative and are linked. Empty sets (null,
    empty or blank texts) are linked with nothing, nor are rows without an id; their representative is null. Rows of
    equal id are one document with several texts. An empty table gives empty tables.
    """
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sketched = stage(sketches(rows, "doc_id", "text", n), "join-sketches")
    reps = sketched.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("lo", "hi", "n_shingles").agg(
        F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("bits").alias("bits"))
    reps = stage(reps, "join-reps")
    possible = components(possible_links(reps, percent))
    families = reps.select(F.col("rep").alias("id"), "n_shingles").join(possible.select("id", F.col("component").alias("family")), "id")
    families = families.groupBy("id", "family").agg(F.max("n_shingles").alias("n_shingles"))
    links = verified_links(rows, families, percent, n, forest)
    classes = reps.select("lo", "hi", "n_shingles", "rep")
    members = sketched.select("doc_id", "n_shingles", "lo", "hi").join(classes, ["lo", "hi", "n_shingles"], "left")
    return links, members.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("rep")).alias("rep"))


def near_classes(documents: DataFrame, n: int, percent: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): the smallest id reachable by links; one row per document.

    Of rows with equal id the largest set counts for n_shingles and all link. Rows without an id have no component.
    """
    links, members = jaccard_join(documents, n, percent, doc_id, text)
    unnamed = members.where("doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    # an id with several texts connects their classes
    own = members.where("rep <> doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    several = members.groupBy("doc_id").agg(F.min("rep").alias("x"), F.max("rep").alias("y")).where("x < y").select("doc_id")
    links = links.unionByName(own.join(several, F.col("a") == F.col("doc_id")).select("a", "b"))
    members = members.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"), F.min("rep").alias("rep"))
    found = components(links).withColumnRenamed("id", "rep")
    joined = members.join(found, "rep", "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id")).unionByName(unnamed)


_OP10 = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' ')) END) AS sh FROM w),
n AS MATERIALIZED (SELECT doc_id, len(sh)::BIGINT AS n_shingles FROM s),
e AS MATERIALIZED (SELECT doc_id, unnest(sh) AS g FROM s),
p AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM e x JOIN e y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n_shingles + nb.n_shingles - c)),
u AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, u.b FROM r JOIN u ON r.reached = u.a)
SELECT n.doc_id, n_shingles, min(reached) AS component_id FROM n JOIN r USING (doc_id) GROUP BY 1, 2"""


@query("op10_jaccard_join", _OP10)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"), 4, 85)
