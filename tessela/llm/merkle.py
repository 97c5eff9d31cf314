"""Merkle manifest of a dataset: a tree per group (language) over its rows, and a tree over the group roots.

Only every few levels of a tree are written (``LEVELS``). What lies between is an aligned subtree of at most 8 ** 3 stored
nodes: a task that needs it regenerates it from those nodes, takes the siblings, and drops it again. Building climbs from
one written level to the next; proofs come down the same way, a subtree at a time, each with the path of its own root.
Rows get their place by ranges of the order and a small table of range sizes, so no group meets in one task.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessela.llm.common import stage, table
from tessela.llm.registry import query
from tessela.session import ship

ARITY = 8
LEVELS = 3
SPAN = ARITY**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_PATH = pa.list_(pa.struct([("place", pa.int32()), ("siblings", pa.list_(pa.string()))]))
PATH = "array<struct<place:int,siblings:array<string>>>"


# ---- digests and paths ----------------------------------------------------------------------------------------------

def row_digest(*fields: Column) -> Column:
    """H of the fields of a row: ``-`` for null, else UTF-8 byte count, ``:`` and the value, integers in decimal."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text]), 256)


def combine(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def regenerate(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes and ``levels`` levels above them: every 8 consecutive ones become one, the last run may be shorter."""
    rows = [nodes]
    for _ in range(levels):
        rows.append([combine(rows[-1][a : a + ARITY]) for a in range(0, len(rows[-1]), ARITY)])
    return rows


def siblings_of(rows: list[list[str]], at: int) -> list[dict]:
    """Per level below the top of ``rows``, the place of node ``at`` in its run and the others of the run."""
    path = []
    for level in rows[:-1]:
        first, place = at - at % ARITY, at % ARITY
        path.append({"place": place, "siblings": level[first:at] + level[at + 1 : first + ARITY]})
        at //= ARITY
    return path


def fold(digest: str, path: list[dict]) -> str:
    """The root that follows from a leaf digest and its path."""
    for step in path:
        digest = combine([*step["siblings"][: step["place"]], digest, *step["siblings"][step["place"] :]])
    return digest


# ---- building -------------------------------------------------------------------------------------------------------

@dataclass
class Tree:
    """Trees by key: ``levels[j]`` holds the written nodes of height 3 j (tree, pos, left, digest, ...), left being the
    levels still above; ``roots`` has one row (tree, level, digest) per tree, level the index of its written table."""

    levels: list[DataFrame]
    roots: DataFrame


@dataclass
class Manifest:
    groups: Tree
    top: Tree
    root: str | None

    def nodes(self) -> DataFrame:
        """All written nodes: (tree, height, pos, digest); the tree over the groups has a null key."""
        parts = [t.select(F.col("tree") if own else F.lit(None).cast("string").alias("tree"), F.lit(k * LEVELS).alias("height"), "pos", "digest")
                 for own, tree in ((True, self.groups), (False, self.top)) for k, t in enumerate(tree.levels)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


def _placed(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Add ``pos`` in its tree, from 0 by ``order``, and ``left``, the height of the tree.

    Ranges of the order are tasks. Equal rows are told apart by where they are written, so that they too spread.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col("tree"), *order, F.col("__tie")]
    # after the sort the row ids count up inside a range; the table is written once, so both readers see the same ids
    ranged = stage(
        rows.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop("__tie")
        .withColumn("__row", F.monotonically_increasing_id()).withColumn("__range", F.spark_partition_id()), "merkle-order")
    parts = ranged.groupBy("tree", "__range").agg(F.min("__row").alias("__first"), F.count(F.lit(1)).alias("__n"))
    # one row per tree and range
    before = Window.partitionBy("tree").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("__n").over(Window.partitionBy("tree"))
    height = sum(((total > ARITY**k).cast("int") for k in range(21)), F.lit(0))
    offsets = parts.select("tree", "__range", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__base"), height.alias("left"))
    return ranged.join(offsets, ["tree", "__range"]).withColumn("pos", F.col("__row") + F.col("__base")).drop("__row", "__range", "__base")


def _block() -> Column:
    return F.floor(F.col("pos") / SPAN).cast("long").alias("block")


def _climb(data: pa.Table) -> pa.Table:
    data = data.sort_by("pos")
    left = data.column("left")[0].as_py()
    up = regenerate(data.column("digest").to_pylist(), min(LEVELS, left))[-1][0]
    return pa.table({"tree": data.column("tree").slice(0, 1), "pos": data.column("block").slice(0, 1), "left": pa.array([max(0, left - LEVELS)], pa.int32()), "digest": [up]})


def grow(leaves: DataFrame) -> Tree:
    """The trees over leaves (tree, pos, left, digest, ...), written every LEVELS levels."""
    ship(leaves.sparkSession)
    levels, roots = [leaves], leaves.where("left = 0").select("tree", F.lit(0).alias("level"), "digest")
    # the height of the highest tree
    highest = leaves.agg(F.max("left")).first()[0] or 0
    while highest > 0:
        below = levels[-1].where("left > 0").select("tree", "pos", "left", "digest", _block())
        level = stage(below.groupBy("tree", "block").applyInArrow(_climb, "tree string, pos long, left int, digest string"), "merkle-level")
        roots = roots.unionByName(level.where("left = 0").select("tree", F.lit(len(levels)).alias("level"), "digest"))
        levels.append(level)
        highest -= LEVELS
    return Tree(levels, roots)


def build(documents: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "lang", key: str = "doc_id", changed: Column | None = None) -> Manifest:
    """The manifest of ``documents``: a tree per value of ``group`` (null is a value) with leaves by ``key``.

    Null keys come first, equal keys are ordered by their digest, repeated rows are leaves of their own. ``changed`` is
    the digest that a row has by now, where it is another (null: the same), for ``verify``. Columns other than ``fields``
    are ignored. An empty table has no tree, and the root None.
    """
    text_key = F.when(F.col(group).isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    rows = documents.select(
        text_key.alias("tree"), F.col(key).cast("long").alias("doc_id"), row_digest(*[F.col(f) for f in fields]).alias("digest"),
        (F.lit(None).cast("string") if changed is None else changed).alias("changed"))
    groups = grow(_placed(stage(rows, "merkle-leaves"), [F.col("doc_id").asc_nulls_first(), F.col("digest")]))
    # `=` and `-` keep the order of the keys: null first, then bytewise
    subroots = groups.roots.select(F.lit("").alias("tree"), F.col("tree").alias("of"), "level", "digest")
    top = grow(_placed(stage(subroots, "merkle-subroots"), [F.col("of")]))
    found = top.roots.first()
    return Manifest(groups, top, found["digest"] if found else None)


# ---- proofs ---------------------------------------------------------------------------------------------------------

def _descend(tree: Tree, above: DataFrame, down_to: int, emit, schema: str) -> DataFrame:
    """Paths of the nodes of level ``down_to``; ``above`` (tree, level, path, subroot) has the path of each tree's root.

    One subtree at a time: its nodes meet the one path of their common ancestor, which continues the path of each.
    ``emit(nodes, up)`` makes rows of one subtree's nodes, given their paths inside it and what is above.
    """

    def run(nodes: pa.Table, up: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("pos")
        rows = regenerate(nodes.column("digest").to_pylist(), min(LEVELS, nodes.column("left")[0].as_py()))
        return emit(nodes, rows, up.column("path")[0].as_py(), up.column("subroot")[0].as_py())

    upper = above.where(F.col("level") == down_to).select("tree", F.lit(0).cast("long").alias("block"), "path", "subroot")
    if down_to + 1 < len(tree.levels):
        upper = upper.unionByName(_descend(tree, above, down_to + 1, _emit_nodes, NODE_PATHS).select("tree", F.col("pos").alias("block"), "path", "subroot"))
    upper = upper.select(F.col("tree").alias("of_tree"), F.col("block").alias("of_block"), "path", "subroot")
    nodes = tree.levels[down_to].withColumn("block", F.when(F.col("left") > 0, _block()).otherwise(F.lit(0).cast("long")))
    return nodes.groupBy("tree", "block").cogroup(upper.groupBy("of_tree", "of_block")).applyInArrow(run, schema)


NODE_PATHS = f"tree string, pos long, path {PATH}, subroot string"


def _emit_nodes(nodes: pa.Table, rows: list[list[str]], above: list[dict], subroot: str) -> pa.Table:
    paths = [siblings_of(rows, k) + above for k in range(nodes.num_rows)]
    return pa.table({"tree": nodes.column("tree"), "pos": nodes.column("pos"), "path": pa.array(paths, _PATH), "subroot": pa.array([subroot] * len(paths), pa.string())})


def _emit_tops(nodes: pa.Table, rows: list[list[str]], above: list[dict], subroot: str) -> pa.Table:
    paths = [siblings_of(rows, k) + above for k in range(nodes.num_rows)]
    return pa.table({"tree": nodes.column("of"), "level": nodes.column("level"), "path": pa.array(paths, _PATH), "subroot": nodes.column("digest")})


def _emit_proofs(nodes: pa.Table, rows: list[list[str]], above: list[dict], subroot: str) -> pa.Table:
    paths = [siblings_of(rows, k) + above for k in range(nodes.num_rows)]
    return pa.table({"doc_id": nodes.column("doc_id"), "leaf": nodes.column("digest"), "subroot": pa.array([subroot] * len(paths), pa.string()), "path": pa.array(paths, _PATH)})


def _emit_checks(nodes: pa.Table, rows: list[list[str]], above: list[dict], subroot: str) -> pa.Table:
    tail, folded, proofs = "".join(d for step in above for d in step["siblings"]), [], []
    for k, (leaf, changed) in enumerate(zip(nodes.column("digest").to_pylist(), nodes.column("changed").to_pylist(), strict=True)):
        path = siblings_of(rows, k)
        proofs.append(combine([*(d for step in path for d in step["siblings"]), tail]))
        folded.append(fold(fold(leaf if changed is None else changed, path), above))
    return pa.table({
        "doc_id": nodes.column("doc_id"), "leaf": nodes.column("digest"), "subroot": pa.array([subroot] * len(folded), pa.string()),
        "proof_sha256": pa.array(proofs, pa.string()), "folded_root": pa.array(folded, pa.string()),
    })


def _leaf_rows(manifest: Manifest, emit, schema: str) -> DataFrame:
    spark = manifest.top.roots.sparkSession
    at_root = manifest.top.roots.select("tree", "level", F.lit(None).cast(PATH).alias("path"), F.lit(None).cast("string").alias("subroot"))
    at_root = at_root.withColumn("path", F.coalesce("path", F.array().cast(PATH)))
    ship(spark)
    tops = _descend(manifest.top, at_root, 0, _emit_tops, f"tree string, level int, path {PATH}, subroot string")
    return _descend(manifest.groups, tops, 0, emit, schema)


def proofs(manifest: Manifest) -> DataFrame:
    """One row per document: doc_id, leaf, subroot and path, the siblings from the leaf to the root with its own place."""
    return _leaf_rows(manifest, _emit_proofs, f"doc_id long, leaf string, subroot string, path {PATH}")


def verify(manifest: Manifest) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root and verified.

    ``folded_root`` follows from the digest the row has now and the siblings it was built with; the siblings are hashed
    and folded where they are regenerated and never leave the task.
    """
    checks = _leaf_rows(manifest, _emit_checks, "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string")
    root = F.lit(manifest.root).cast("string")
    return checks.select("doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def _sql(heights: int = 10, tops: int = 3) -> str:
    """The same manifest in SQL, level by level: every node of every level, then each leaf's siblings and folds."""

    def field(c: str) -> str:
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR END"

    def digest(text: str) -> str:
        return "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    def tree(prefix: str, depth: int) -> list[str]:
        """Levels 1 to depth above ``prefix``0 (tree, pos, h, n); a tree of one node is done."""
        return [
            f"{prefix}{k} AS (SELECT tree, pos // 8 AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h, (any_value(n) + 7) // 8 AS n "
            f"FROM {prefix}{k - 1} WHERE n > 1 GROUP BY tree, pos // 8)" for k in range(1, depth + 1)
        ]

    def walk(prefix: str, start: str, depth: int, name: str) -> list[str]:
        """From (row, tree, pos, cur, sibs) up: siblings joined, the current digest folded in at its place."""
        steps, last = [], start
        for k in range(depth):
            steps.append(
                f"{name}{k} AS (SELECT w.row, w.tree, w.pos // 8 AS pos, w.sibs || coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (WHERE s.pos <> w.pos), '') AS sibs, "
                f"CASE WHEN count(s.h) = 0 THEN w.cur ELSE sha256(string_agg(CASE WHEN s.pos = w.pos THEN w.cur ELSE s.h END, '' ORDER BY s.pos)) END AS cur "
                f"FROM {last} w LEFT JOIN {prefix}{k} s ON s.tree = w.tree AND s.pos // 8 = w.pos // 8 AND s.n > 1 GROUP BY w.row, w.tree, w.pos, w.cur, w.sibs)")
            last = f"{name}{k}"
        return steps

    lower = f"translate(text, '{_UPPER}', '{_LOWER}')"
    steps = [
        "bits AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t)",
        "docs AS (SELECT row_number() OVER () AS row, *, " + digest("text") + " AS leaf, " + digest("lowered") + " AS changed, "
        "CASE WHEN lang IS NULL THEN '-' ELSE '=' || lang END AS tree, "
        "xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295), 4294967295) AS crc "
        f"FROM (SELECT *, {lower} AS lowered FROM documents), bits)",
        "g0 AS (SELECT row, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM docs)",
        *tree("g", heights),
        "subs AS (" + " UNION ALL ".join(f"SELECT tree AS of, h FROM g{k} WHERE n = 1" for k in range(heights + 1)) + ")",
        "t0 AS (SELECT '' AS tree, of, row_number() OVER (ORDER BY of) - 1 AS pos, h, count(*) OVER () AS n FROM subs)",
        *tree("t", tops),
        "root AS (" + " UNION ALL ".join(f"SELECT h FROM t{k} WHERE n = 1" for k in range(tops + 1)) + ")",
        "w AS (SELECT d.row, d.tree, g.pos, '' AS sibs, CASE WHEN d.crc % 3 = 0 THEN d.changed ELSE d.leaf END AS cur FROM docs d JOIN g0 g USING (row))",
        *walk("g", "w", heights, "a"),
        f"v AS (SELECT a.row, '' AS tree, t.pos, a.sibs, a.cur FROM a{heights - 1} a JOIN t0 t ON t.of = a.tree)",
        *walk("t", "v", tops, "b"),
    ]
    return "WITH " + ",\n".join(steps) + (
        f"\nSELECT d.doc_id, d.leaf, s.h AS subroot, r.h AS root, sha256(b.sibs) AS proof_sha256, b.cur AS folded_root, b.cur = r.h AS verified "
        f"FROM docs d JOIN b{tops - 1} b USING (row) JOIN subs s ON s.of = d.tree, root r")


@query("op12_merkle_manifest", _sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lowered = F.translate(F.col("text"), _UPPER, _LOWER)
    changed = F.when(tampered, row_digest(*[lowered if f == "text" else F.col(f) for f in FIELDS]))
    return verify(build(documents, changed=changed))
