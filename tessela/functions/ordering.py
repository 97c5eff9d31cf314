"""Positions, sessions and dense numbers that never gather one key, or the whole table, in one task.

A plain ``row_number() over (partition by key order by ts)`` puts a key that holds a third of the rows into one task.
Here rows are dealt out by ranges of (key, time, tiebreak), so that a hot key spreads over many ranges. Each range is
scanned once in its order while it is written; a table with at most two rows per range carries what a key has had in the
ranges before: its number of rows, its last time and its open session.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessela.session import materialize, ship


def _changes(column: pa.Array) -> np.ndarray:
    """Which entries differ from the one before; nulls equal each other, NaN too. One entry fewer than the column."""
    here, before = column.slice(1), column.slice(0, len(column) - 1)
    differs = pc.fill_null(pc.not_equal(here, before), False).to_numpy(zero_copy_only=False)
    if pa.types.is_floating(column.type):
        differs = differs & ~pc.and_(pc.fill_null(pc.is_nan(here), False), pc.fill_null(pc.is_nan(before), False)).to_numpy(zero_copy_only=False)
    if column.null_count:
        differs = differs | (here.is_null().to_numpy(zero_copy_only=False) != before.is_null().to_numpy(zero_copy_only=False))
    return differs


def _scanner(group: Sequence[str], gap: int | None):
    """Adds to sorted batches of one range: __head (the key is the range's first), __pos (row of the key in the range) and
    __no (pauses of at least ``gap`` microseconds before it, in the range)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, runs, pos, no = None, 0, 0, 0  # the row before, and where its key stands
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            known = batch.select([*group, "__us"])
            joined = pa.Table.from_batches([known] if last is None else [last, known]).combine_chunks()
            change = np.zeros(n, bool)
            for g in group:
                differs = _changes(joined.column(g).chunk(0))
                change[n - len(differs) :] |= differs
            if last is None:
                change[0] = True
            us = pc.fill_null(joined.column("__us"), 0).to_numpy()
            pause = np.zeros(n, bool)
            if gap is not None:
                pause[n - len(us) + 1 :] = np.diff(us) >= gap
            pause &= ~change
            starts = np.flatnonzero(change)
            own = np.cumsum(change)  # 0: still the key of the batch before
            first = np.concatenate([[0], starts])[own]
            place = np.arange(n) - first + 1 + np.where(own == 0, pos, 0)
            pauses = np.cumsum(pause)
            number = pauses - np.concatenate([[0], pauses[starts]])[own] + np.where(own == 0, no, 0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(runs + own <= 1), pa.array(place, pa.int64()), pa.array(number, pa.int64())],
                names=[*batch.schema.names, "__head", "__pos", "__no"])
            last, runs, pos, no = known.slice(n - 1), runs + int(own[-1]), int(place[-1]), int(number[-1])

    return run


def scan_by_key(df: DataFrame, group: Sequence[str], ts: str, tiebreak: Sequence[str], gap_seconds: float | None = None, descending: bool = False) -> DataFrame:
    """Add ``__position``, the 1-based position in the key by ``ts`` then ``tiebreak``, and ``__session``, the number of its
    session if a gap is given; both null without a key or time.

    Rows that agree in all of the order are told apart by where they were read, so they too spread over ranges.
    """
    spark = df.sparkSession
    ship(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = F.col(ts).isNotNull()
    for g in group:
        placed &= F.col(g).isNotNull()
    columns, key = df.columns, ["__placed", *group]  # rows without a place are keys of their own
    df = df.withColumn("__placed", placed)
    order = [*[F.col(k) for k in key], F.col(ts).desc() if descending else F.col(ts).asc(), *[F.col(c) for c in tiebreak], F.col("__tie")]
    rows = df.withColumn("__us", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn("__tie", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("__tie")
    rows = rows.withColumn("__range", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id())
    gap = None if gap_seconds is None else int(gap_seconds * 1_000_000)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", __head boolean, __pos long, __no long"
    scanned = materialize(rows.mapInArrow(_scanner(key, gap), schema), "scanned")
    # one row per range, then its first key and, where that is another one, its last: all that goes on into later ranges
    edge = F.struct(*key, "__us", "__head", "__pos", "__no")
    edges = scanned.groupBy("__range").agg(F.min_by(edge, "__row").alias("first"), F.max_by(edge, "__row").alias("last"))
    alone = F.col("last.__head")
    heads = edges.select("__range", F.lit(True).alias("__head"), *[F.col(f"first.{k}").alias(k) for k in key], F.col("first.__us").alias("first_us"),
                         F.when(alone, F.col("last.__us")).alias("last_us"), F.when(alone, F.col("last.__pos")).otherwise(0).alias("rows"),
                         F.when(alone, F.col("last.__no")).otherwise(0).alias("starts"))
    tails = edges.where(~alone).select("__range", F.lit(False).alias("__head"), *[F.col(f"last.{k}").alias(k) for k in key], F.lit(None).cast("long").alias("first_us"),
                                       F.col("last.__us").alias("last_us"), F.col("last.__pos").alias("rows"), F.col("last.__no").alias("starts"))
    along = Window.partitionBy(*key).orderBy("__range")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    opens = F.coalesce((F.col("first_us") - F.lag("last_us").over(along) >= F.lit(gap)).cast("int"), F.lit(1))
    carried = heads.unionByName(tails).withColumn("opens", opens).select(
        "__range", "__head", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("__before"),
        (F.coalesce(F.sum(F.col("opens") + F.col("starts")).over(before), F.lit(0)) + F.col("opens")).alias("__open"))
    # one row per range, of which there are as many as shuffle partitions; written, as readers of the result may be several
    carried = materialize(carried.where("__head").drop("__head"), "carried")
    found = scanned.join(F.broadcast(carried), "__range")
    position = F.col("__pos") + F.when(F.col("__head"), F.col("__before")).otherwise(0)
    session = F.col("__no") + F.when(F.col("__head"), F.col("__open")).otherwise(1)
    made = {"__position": F.when(F.col("__placed"), position).cast("long")}
    if gap is not None:
        made["__session"] = F.when(F.col("__placed"), session).cast("long")
    return found.withColumns(made).select(*[F.col(f"`{c}`") for c in columns], *made)


def position_in_group(df: DataFrame, group: Sequence[str], ts: str, tiebreak: Sequence[str], out: str, descending: bool = False) -> DataFrame:
    """Add the 1-based position of each row in its group by ``ts`` then ``tiebreak``; null keys or times get null."""
    placed = scan_by_key(df, group, ts, tiebreak, descending=descending)
    return placed.select(*[F.col(f"`{c}`") for c in df.columns if c != out], F.col("__position").alias(out))


def global_numbers(df: DataFrame, order: Sequence[str], out: str, first: int = 1) -> DataFrame:
    """Number all rows by ``order`` from ``first``: ranges of the order are tasks, a table of range sizes gives the offsets.

    No value of the order, and no group, meets in one task; the ranges are written once, so that both passes agree.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(df.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    # one row per range
    before = Window.partitionBy(F.lit(0)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy("__range").orderBy(*order)
    number = (F.row_number().over(inside) + F.col("__offset") + (first - 1)).cast("long")
    return ranged.join(F.broadcast(offsets), "__range").withColumn(out, number).drop("__range", "__offset")


def dense_numbers(df: DataFrame, column: str, out: str, buckets: int = 1024) -> DataFrame:
    """Number the distinct values of ``column`` from 0 without gaps; (value, number) rows.

    Values are spread over hash buckets and ranked inside them. Only the ``buckets`` counts meet in one task.
    """
    values = (
        df.select(column).where(F.col(column).isNotNull()).distinct()
        .withColumn("__bucket", F.pmod(F.xxhash64(column), F.lit(buckets)))
    )
    counts = values.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
    # one row per hash bucket: at most `buckets` rows share this constant key
    before = Window.partitionBy(F.lit(0)).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy("__bucket").orderBy(column)
    return (
        values.join(F.broadcast(offsets), "__bucket")
        .select(column, (F.col("__offset") + F.row_number().over(inside) - 1).cast("long").alias(out))
    )
