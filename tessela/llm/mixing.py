"""Mixing sources to target weights with pivotal dependent rounding, in DataFrame operations only.

Every document of a source should appear target / source size times. The whole part of that number is certain, the rest
is a probability. Pivotal steps move mass between two documents, weighted with their sizes, until one probability is 0 or
1, so the expected words of the source never change. Documents are folded in buckets of bounded size; the one fractional
document that a bucket leaves goes up a reduction tree, and only the last of each source is rounded by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessela.llm.common import stage, table, word_count
from tessela.llm.registry import query

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
FAN = 64
_EPS = 1e-12


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, n, source_size, target) from rows (source, size).

    Sources by code point, null last, weigh ``weights``, repeating. ``share`` of all sizes is dealt by weight; a target
    stops at ``most`` times its source's size and the excess goes to the others by weight. That is the level at which
    the capped sum meets the total: sources sorted by cap per weight are full up to some rank, the rest get equal
    words per weight. The windows see one row per source, after a combined aggregate.
    """
    sources = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    # one row per source from here on
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    ranked = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(most))
    by_level = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy(F.lit(0))
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    filled = ranked.select(
        "*", (F.col("cap") / F.col("weight")).alias("level"), (F.sum("source_size").over(all_rows) * F.lit(share)).alias("total"),
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("full"), F.sum("weight").over(onward).alias("rest"),
    ).withColumn("fair", (F.col("total") - F.col("full")) / F.col("rest"))
    # the first source whose cap is not reached sets the level for itself and all after it
    open_level = F.min(F.when(F.col("level") >= F.col("fair"), F.struct("level", "fair"))).over(all_rows)["fair"]
    target = F.least(F.col("cap"), F.coalesce(open_level * F.col("weight"), F.col("cap")))
    return filled.select("source", "n", "source_size", F.greatest(target, F.lit(0.0)).alias("target"))


def _uniform(*parts: Column) -> Column:
    """A number in (0, 1) that depends on ``parts`` only."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 12).cast("double") + 0.5) / F.lit(float(1 << 52))


_DOC = "struct<size:bigint,tie:bigint,doc_id:bigint,p:double>"


def _pivot(carry: Column, x: Column, level: int) -> Column:
    """One step between the carried document and the next: (settled document, carried document)."""
    a, b, p, q = carry["size"].cast("double"), x["size"].cast("double"), carry["p"], x["p"]
    up, down = F.least(1 - p, q * b / a), F.least(p, (1 - q) * b / a)
    raised = _uniform(F.lit(level), carry["tie"], x["tie"]) * (up + down) < down
    p2 = F.when(raised, F.when(up >= 1 - p, F.lit(1.0)).otherwise(p + up)).otherwise(F.when(down >= p, F.lit(0.0)).otherwise(p - down))
    q2 = F.when(raised, F.when(up >= q * b / a, F.lit(0.0)).otherwise(q - up * a / b)).otherwise(
        F.when(down >= (1 - q) * b / a, F.lit(1.0)).otherwise(q + down * a / b))
    first = F.struct(carry["size"].alias("size"), carry["tie"].alias("tie"), carry["doc_id"].alias("doc_id"), p2.alias("p"))
    second = F.struct(x["size"].alias("size"), x["tie"].alias("tie"), x["doc_id"].alias("doc_id"), q2.alias("p"))
    return F.when((p2 <= _EPS) | (p2 >= 1 - _EPS), F.struct(first.alias("done"), second.alias("carry"))).otherwise(
        F.struct(second.alias("done"), first.alias("carry")))


def _fold(rows: DataFrame, level: int, top: bool) -> DataFrame:
    """Settle all but one document of each (source, bucket); rows keep (source, bucket, size, tie, doc_id, p, open)."""
    docs = F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("k"), "tie", F.struct("size", "tie", "doc_id", "p").alias("d"))))
    grouped = rows.groupBy("source", "bucket").agg(F.transform(docs, lambda r: r["d"]).alias("docs"))

    def step(acc: Column, x: Column) -> Column:
        moved = _pivot(acc["carry"], x, level)
        return F.struct(F.concat(acc["done"], F.array(moved["done"])).alias("done"), moved["carry"].alias("carry"))

    start = F.struct(F.expr(f"cast(array() as array<{_DOC}>)").alias("done"), F.element_at("docs", 1).alias("carry"))
    folded = grouped.select("source", "bucket", F.aggregate(F.slice(F.col("docs"), F.lit(2), F.size("docs")), start, step).alias("f"))
    carry = F.col("f.carry")
    fractional = (carry["p"] > _EPS) & (carry["p"] < 1 - _EPS)
    every = F.concat(F.transform("f.done", lambda d: F.struct(d.alias("d"), F.lit(False).alias("open"))),
                     F.array(F.struct(carry.alias("d"), fractional.alias("open"))))
    out = folded.select("source", "bucket", F.explode(every).alias("e")).select("source", "bucket", "e.d.*", "e.open")
    settled = F.when(F.col("open") & F.lit(not top), F.col("p")).otherwise(F.round("p"))
    return out.withColumn("p", settled).withColumn("open", F.col("open") & F.lit(not top))


def mix(documents: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = WEIGHTS,
        share: float = SHARE, most: float = MOST, fan: int = FAN) -> DataFrame:
    """How often the mix takes each document: (doc_id, size, source, source_size, target, copies, taken).

    Randomness comes from hashes of the document, so reruns agree. Buckets hold ``fan`` documents in expectation and are
    numbered inside their source, so a source with a third of all rows is many buckets; each level of the tree divides
    the open documents by ``fan``. The last document of a source is rounded to the nearer integer. Null text: size 0,
    nothing taken. Rows without a doc_id take part like others. Repeated rows are documents of their own with equal ids.
    An empty table gives an empty table.
    """
    base = documents.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"),
        F.xxhash64(F.lit("mix"), F.col(doc_id), F.col(text)).alias("tie"))
    base = stage(base, "mix-sizes")
    targets = source_targets(base, weights, share, most)
    targets = stage(targets, "mix-targets")
    largest = targets.agg(F.max("n")).first()[0] or 0
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(most))).otherwise(0.0)
    rows = base.join(targets.select(F.col("source").alias("s"), "n", "source_size", "target"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rows = rows.withColumn("rate", rate).withColumn("whole", F.floor(F.col("rate") + _EPS))
    rows = rows.withColumn("p", F.when(F.col("rate") - F.col("whole") > _EPS, F.col("rate") - F.col("whole")).otherwise(0.0))
    chance = (F.col("size") > 0) & (F.col("p") > 0)
    opened = rows.where(chance).select(
        "source", F.pmod(F.xxhash64("tie"), F.ceil(F.col("n") / fan).cast("long")).alias("bucket"), "size", "tie", "doc_id", "p")
    settled, level, buckets = [], 0, -(-largest // fan)
    while True:
        top = buckets <= 1
        done = _fold(opened, level, top)
        done = done if top else stage(done, f"mix-level{level}")
        settled.append(done.where(~F.col("open")).select("source", "size", "tie", "doc_id", F.col("p").alias("extra")))
        if top:
            break
        opened = done.where("open").withColumn("bucket", F.floor(F.col("bucket") / fan).cast("long")).drop("open")
        level, buckets = level + 1, -(-buckets // fan)
    drawn = settled[0]
    for more in settled[1:]:
        drawn = drawn.unionByName(more)
    certain = rows.where(~chance).select("source", "size", "tie", "doc_id", F.lit(0.0).alias("extra"))
    out = drawn.unionByName(certain).join(
        targets.select(F.col("source").alias("s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    whole = F.floor(F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(most))).otherwise(0.0) + _EPS)
    return out.select(
        "doc_id", "size", "source", "source_size", "target", (whole + F.col("extra")).cast("long").alias("copies"),
    ).withColumn("taken", F.col("copies") * F.col("size"))


def take(documents: DataFrame, copies: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``documents`` as often as ``copies (doc_id, copies)`` says; repeated ids all take the largest number.

    Rows without an id are taken once.
    """
    unique = copies.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("copies").cast("int").alias("__copies")).withColumnRenamed("doc_id", "__id")
    joined = documents.join(unique, documents[doc_id] == F.col("__id"), "left")
    times = F.coalesce(F.col("__copies"), F.lit(1))
    return joined.where(times > 0).select(*[documents[c] for c in documents.columns], F.explode(F.array_repeat(F.lit(0), times)).alias("__turn")).drop("__turn")


@query("op5_mixing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
