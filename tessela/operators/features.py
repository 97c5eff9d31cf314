"""Features of interactions, users, items, sessions and the user-item graph.

Entity features are one aggregate per entity key, combined map-side, and one join back per key. Positions and sessions
use time buckets (see ``functions.ordering``), so a user with a third of all rows does not end in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import BooleanType, NumericType, StringType

from tessela.functions.ordering import _changes, dense_numbers, position_in_group, scan_by_key
from tessela.roles import Roles
from tessela.session import materialize, ship


def _q(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def minmax_signal(df: DataFrame, roles: Roles, out: str = "signal_normalized") -> DataFrame:
    """Signal scaled to [0, 1]; without a numeric signal that varies there is no such column."""
    if roles.signal is None or not isinstance(df.schema[roles.signal].dataType, NumericType):
        return df
    bounds = df.agg(F.min(roles.signal).alias("lo"), F.max(roles.signal).alias("hi")).first()
    if bounds["lo"] is None or not bounds["hi"] > bounds["lo"]:
        return df
    low, high = float(bounds["lo"]), float(bounds["hi"])
    return df.withColumn(out, (F.col(roles.signal) - F.lit(low)) / F.lit(high - low))


def temporal_features(df: DataFrame, roles: Roles) -> DataFrame:
    """Calendar parts of the time; Monday is 1, and every minute from 9:00 to 17:59 is a business hour."""
    ts = F.col(roles.ts)
    if isinstance(df.schema[roles.ts].dataType, StringType):
        ts = F.to_timestamp(ts)
    hour, weekday = F.hour(ts), F.weekday(ts) + 1
    return df.withColumns({
        "hour_of_day": hour,
        "day_of_week": weekday,
        "day_of_month": F.dayofmonth(ts),
        "month": F.month(ts),
        "quarter": F.quarter(ts),
        "year": F.year(ts),
        "is_weekend": weekday > 5,
        "is_business_hours": (hour >= 9) & (hour <= 17),
    })


def elapsed_days(since: Column, as_of: Column) -> Column:
    """Whole days from one time to another, cut towards zero."""
    micros = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(since.cast("timestamp"))
    return (micros / F.lit(86_400 * 1_000_000)).cast("long")


def elapsed_seconds(since: Column, until: Column) -> Column:
    micros = F.unix_micros(until.cast("timestamp")) - F.unix_micros(since.cast("timestamp"))
    return F.floor(micros / F.lit(1_000_000)).cast("long")


def user_features(df: DataFrame, roles: Roles, as_of: str | None = None) -> DataFrame:
    """Per user: count, mean and sample deviation of the signal, last activity and, given ``as_of``, days since."""
    aggregates = [F.count(F.lit(1)).alias("user_interaction_count")]
    if roles.signal:
        aggregates += [F.avg(roles.signal).alias("user_signal_mean"), F.stddev_samp(roles.signal).alias("user_signal_std")]
    if roles.ts:
        aggregates.append(F.max(roles.ts).alias("user_last_activity"))
    result = df.groupBy(roles.user).agg(*aggregates)
    if roles.ts and as_of:
        result = result.withColumn("user_recency_days", elapsed_days(F.col("user_last_activity"), F.lit(as_of).cast("timestamp")))
    return result


def recency_days(df: DataFrame, roles: Roles, as_of: str) -> DataFrame:
    last = df.groupBy(roles.user).agg(F.max(roles.ts).alias("last"))
    return last.select(roles.user, elapsed_days(F.col("last"), F.lit(as_of).cast("timestamp")).alias("recency_days"))


def item_features(df: DataFrame, roles: Roles) -> DataFrame:
    aggregates = [F.count(F.lit(1)).alias("item_interaction_count")]
    if roles.signal:
        aggregates += [F.avg(roles.signal).alias("item_signal_mean"), F.stddev_samp(roles.signal).alias("item_signal_std")]
    return df.groupBy(roles.item).agg(*aggregates)


def join_back(df: DataFrame, entity_features: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Left join one row per entity to the facts: one join per entity key; adaptive execution splits a skewed fact key."""
    return df.join(entity_features, [key] if isinstance(key, str) else list(key), "left")


def pair_counts(df: DataFrame, roles: Roles, out: str = "user_item_interactions") -> DataFrame:
    return df.groupBy(roles.user, roles.item).agg(F.count(F.lit(1)).alias(out))


def pair_history(df: DataFrame, roles: Roles) -> DataFrame:
    """Rows of the same user and item in the whole table."""
    return join_back(df, pair_counts(df, roles), (roles.user, roles.item))


def pair_history_asof(df: DataFrame, roles: Roles, out: str = "user_item_history") -> DataFrame:
    """Earlier rows of the same user and item; nothing of the future leaks in."""
    placed = position_in_group(df, [roles.user, roles.item], roles.ts, roles.tiebreak, out)
    return placed.withColumn(out, F.col(out) - 1)


def session_key(roles: Roles) -> str:
    return roles.session or roles.user


def session_stats(df: DataFrame, roles: Roles) -> DataFrame:
    """Per session (else per user): whole seconds from first to last row, and the number of rows."""
    aggregates = [F.count(F.lit(1)).alias("session_length")]
    if roles.ts:
        aggregates.insert(0, elapsed_seconds(F.min(roles.ts), F.max(roles.ts)).alias("session_duration"))
    return df.groupBy(session_key(roles)).agg(*aggregates)


def session_position(df: DataFrame, roles: Roles, out: str = "session_position") -> DataFrame:
    return position_in_group(df, [session_key(roles)], roles.ts, roles.tiebreak, out)


def sessionize(df: DataFrame, roles: Roles, gap_seconds: int = 1800, out: str = "session_no") -> DataFrame:
    """Number the sessions of each user from 1; a pause of at least the gap starts a new one.

    Rows without a user or a time are in no session. A user's rows may lie in many ranges, see ``scan_by_key``.
    """
    found = scan_by_key(df, [roles.user], roles.ts, roles.tiebreak, gap_seconds)
    return found.select(*[F.col(f"`{c}`") for c in df.columns if c != out], F.col("__session").alias(out))


def sessions(df: DataFrame, roles: Roles, gap_seconds: int = 1800) -> DataFrame:
    """One row per user session with its start, end and number of rows."""
    return sessionize(df, roles, gap_seconds).groupBy(roles.user, "session_no").agg(
        F.min(roles.ts).alias("session_start"), F.max(roles.ts).alias("session_end"), F.count(F.lit(1)).alias("rows")
    )


def _numeric(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in exclude]


def synthesis_transforms(df: DataFrame, exclude: Sequence[str] = ()) -> dict[str, Column]:
    """Name to expression: ABSOLUTE(c) and 1 / c of numeric columns, then c1 * c2 of boolean pairs."""
    numeric = _numeric(df, exclude)
    flags = [f.name for f in df.schema.fields if isinstance(f.dataType, BooleanType)]
    made = {f"ABSOLUTE({c})": F.abs(_q(c)) for c in numeric}
    made |= {f"1 / {c}": F.try_divide(F.lit(1.0), _q(c)) for c in numeric}
    made |= {f"{a} * {b}": _q(a) & _q(b) for i, a in enumerate(flags) for b in flags[i + 1:]}
    return made


def synthesis_aggregates(df: DataFrame, key: str, parent: str, columns: Sequence[str]) -> DataFrame:
    """Per parent entity: COUNT, and MEAN, SUM, STD, MIN, MAX of each child column, in one aggregate."""
    aggregates = [F.count(F.lit(1)).alias(f"{parent}.COUNT")]
    for c in columns:
        aggregates += [
            F.avg(_q(c)).alias(f"{parent}.MEAN({c})"), F.sum(_q(c)).alias(f"{parent}.SUM({c})"),
            F.stddev_samp(_q(c)).alias(f"{parent}.STD({c})"), F.min(_q(c)).alias(f"{parent}.MIN({c})"),
            F.max(_q(c)).alias(f"{parent}.MAX({c})"),
        ]
    return df.groupBy(key).agg(*aggregates)


def deep_features(df: DataFrame, roles: Roles, depth: int = 2, max_new: int | None = None) -> DataFrame:
    """Transforms, parent aggregates and, at depth 2, parent aggregates of transforms; all, or the first ``max_new``.

    New columns are chosen before anything is computed, so those beyond a given limit cost nothing.
    """
    keys = [c for c in (roles.user, roles.item, roles.session) if c]
    transforms = synthesis_transforms(df, keys)
    children = _numeric(df, keys)
    numeric_transforms = [n for n in transforms if n.startswith(("ABSOLUTE(", "1 / "))] if depth > 1 else []
    wanted = list(transforms)
    parents = (("users", roles.user), ("items", roles.item))
    for parent, _ in parents:
        wanted.append(f"{parent}.COUNT")
        wanted += [f"{parent}.{fn}({c})" for c in (*children, *numeric_transforms)
                   for fn in ("MEAN", "SUM", "STD", "MIN", "MAX")]
    kept = wanted[:max_new]
    base = df.withColumns(transforms)
    result = df.select(*[_q(c) for c in df.columns], *[transforms[n].alias(n) for n in kept if n in transforms])
    for parent, key in parents:
        own = [n for n in kept if n.startswith(f"{parent}.")]
        if own:
            made = synthesis_aggregates(base, key, parent, [*children, *numeric_transforms])
            result = result.join(made.select(key, *[_q(n) for n in own]), key, "left")
    return result.select(*[_q(c) for c in (*df.columns, *kept)])


def cap_new_columns(df: DataFrame, original: Sequence[str], max_new: int) -> DataFrame:
    new = [c for c in df.columns if c not in original][:max_new]
    return df.select(*[_q(c) for c in df.columns if c in original], *[_q(c) for c in new])


def finalize_features(df: DataFrame, max_null_ratio: float = 0.5) -> DataFrame:
    """Drop columns with too many nulls, fill numbers with 0 and strings with UNKNOWN, then drop equal rows."""
    counted = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(_q(c)).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    n = counted["n"]
    kept = [c for i, c in enumerate(df.columns) if n == 0 or (n - counted[f"c{i}"]) / n < max_null_ratio]
    filled = []
    for c in kept:
        kind = df.schema[c].dataType
        if isinstance(kind, NumericType):
            filled.append(F.coalesce(_q(c), F.lit(0).cast(kind)).alias(c))
        elif isinstance(kind, StringType):
            filled.append(F.coalesce(_q(c), F.lit("UNKNOWN")).alias(c))
        else:
            filled.append(_q(c))
    return df.select(*filled).dropDuplicates()


def add_bias(df: DataFrame) -> DataFrame:
    return df.withColumn("bias", F.lit(1))


def feature_matrix(df: DataFrame, roles: Roles, as_of: str) -> DataFrame:
    """All fixed features in order: signal, time, user, item, pair, session."""
    rows = temporal_features(minmax_signal(df, roles), roles)
    rows = join_back(rows, user_features(df, roles, as_of), roles.user)
    rows = join_back(rows, item_features(df, roles), roles.item)
    rows = pair_history(rows, roles)
    rows = join_back(rows, session_stats(df, roles), session_key(roles))
    return session_position(rows, roles)


def graph_features(df: DataFrame, roles: Roles, side: str = "user") -> DataFrame:
    """Per node of one side: distinct neighbours, weight of its edges, and paths over a neighbour to other nodes.

    Paths are counted from neighbour degrees, so no pair of nodes is ever made.
    """
    node, other = (roles.user, roles.item) if side == "user" else (roles.item, roles.user)
    edges = df.groupBy(node, other).agg(F.sum(roles.signal).alias("w"))
    degrees = edges.groupBy(other).agg(F.count(F.lit(1)).alias("d"))
    return edges.join(degrees, other).groupBy(node).agg(
        F.count(F.lit(1)).alias("degree"),
        F.sum("w").alias("weighted_degree"),
        F.sum(F.col("d") - 1).alias("two_hop_paths"),
    )


def two_hop_exact(df: DataFrame, roles: Roles, seeds: DataFrame) -> DataFrame:
    """(user, reach): exactly how many users share an item with each seed, itself included.

    Work is the paths of the seeds; equal (seed, user) pairs are combined before the count.
    """
    edges = df.select(roles.user, roles.item).distinct()
    own = edges.join(seeds.select(roles.user).distinct(), roles.user).withColumnRenamed(roles.user, "__seed")
    reached = own.join(edges, roles.item).select("__seed", roles.user).distinct()
    return reached.groupBy(F.col("__seed").alias(roles.user)).agg(F.count(F.lit(1)).alias("reach"))


LIST_USERS = 1024  # users of one list; an item with more has several lists, or bitmaps
_FLAT_ROWS = 2_000


def _flat(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of a list column, null lists as empty ones."""
    column = batch.column(name)
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), lengths), column.flatten().to_numpy(zero_copy_only=False).astype(np.int64) & 0xFFFFFFFF


def _in_runs(rows: DataFrame, key: str, lists: str, out: str, kind: str, measure) -> DataFrame:
    """(key, out): ``measure`` of the sorted distinct values, all below 2 ** 32, in the lists of a key.

    Rows come sorted by key, and only the values of the key that is being read are kept between batches.
    """
    schema = T.StructType([rows.schema[key], T.StructField(out, T.LongType() if kind == "long" else T.DoubleType())])
    ship(rows.sparkSession)

    def close(keys: pa.Array, parts: Sequence[np.ndarray]) -> pa.RecordBatch:
        found = pa.array([measure(p) for p in parts], pa.int64() if kind == "long" else pa.float64())
        return pa.RecordBatch.from_arrays([keys, found], names=[key, out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = np.zeros(0, np.int64), None
        for whole in batches:
            for at in range(0, whole.num_rows, _FLAT_ROWS):
                batch = whole.slice(at, _FLAT_ROWS)
                keys = batch.column(0)
                if last is not None and _changes(pa.concat_arrays([last, keys.slice(0, 1)]))[0]:
                    yield close(last, [held])
                    held = held[:0]
                runs = np.concatenate([[0], np.cumsum(_changes(keys))]).astype(np.int64)
                row, value = _flat(batch, lists)
                pairs = np.unique(np.concatenate([held, (runs[row] << 32) | value]))
                cuts = np.searchsorted(pairs, np.arange(runs[-1] + 2) << 32)
                parts = [pairs[a:b] & 0xFFFFFFFF for a, b in zip(cuts, cuts[1:])]
                if len(parts) > 1:
                    yield close(keys.take(pa.array(np.searchsorted(runs, np.arange(runs[-1])))), parts[:-1])
                held, last = parts[-1], keys.slice(len(keys) - 1, 1)
        if last is not None:
            yield close(last, [held])

    return rows.select(key, lists).repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)


def two_hop_counts(df: DataFrame, roles: Roles) -> DataFrame:
    """(user, reach): exactly how many users share an item with each user, itself included, for all users.

    Users get dense numbers, and an item the list of its users, cut where it is longer than ``LIST_USERS``. A user is sent the lists of its items
    and counts the different numbers as they pass: no pair of users is ever a row, and work is the paths over an item. An item
    with more than one in 32 of all users is sent as bitmaps of 32,768 numbers instead; its users combine bitmaps, before and after
    the shuffle. Rows without a user or an item are no edges.
    """
    edges = materialize(df.select(roles.user, roles.item).where(F.col(roles.user).isNotNull() & F.col(roles.item).isNotNull()).distinct(), "edges")
    numbers = materialize(dense_numbers(edges, roles.user, "__number"), "user-numbers")
    users = numbers.count()
    numbered = materialize(edges.join(numbers, roles.user).select(roles.item, (F.col("__number") + 1).alias("__number")), "numbered")
    large = numbered.groupBy(roles.item).agg(F.count(F.lit(1)).alias("__d")).where(F.col("__d") > LIST_USERS)
    large = materialize(large, "large-items")
    lists = numbered.join(large, roles.item, "left_anti").groupBy(roles.item).agg(F.collect_list(F.col("__number").cast("int")).alias("__list")).select(
        F.explode("__list").alias("__number"), "__list")
    is_dense = F.col("__d") * 32 > users
    if large.where(~is_dense).count():
        long_ = numbered.join(large.where(~is_dense), roles.item)
        piece = F.pmod(F.xxhash64("__number"), F.ceil(F.col("__d") * 2 / LIST_USERS))
        pieces = long_.groupBy(roles.item, piece.alias("__piece")).agg(F.collect_list(F.col("__number").cast("int")).alias("__list"))
        lists = lists.unionByName(long_.select(roles.item, "__number").join(pieces, roles.item).select("__number", "__list"))
    if large.where(is_dense).count():
        hot = materialize(numbered.join(large.where(is_dense), roles.item, "left_semi"), "hot-edges")
        bit = [F.bitmap_construct_agg(F.bitmap_bit_position("__other")).alias("__users")]
        bucket = F.bitmap_bucket_number("__other").alias("__bucket")
        bitmaps = materialize(hot.withColumnRenamed("__number", "__other").groupBy(roles.item, bucket).agg(*bit), "item-users")
        hot_users = hot.select("__number").distinct()
        own = lists.join(hot_users, "__number").select("__number", F.explode("__list").alias("__other")).groupBy("__number", bucket).agg(*bit)
        both = hot.join(bitmaps, roles.item).select("__number", "__bucket", "__users").unionByName(own)
        dense = both.groupBy("__number", "__bucket").agg(F.bitmap_count(F.bitmap_or_agg("__users")).alias("__n")).groupBy("__number").agg(
            F.sum("__n").alias("reach"))
        lists = lists.join(hot_users, "__number", "left_anti")
        counted = _in_runs(lists, "__number", "__list", "reach", "long", len).unionByName(dense)
    else:
        counted = _in_runs(lists, "__number", "__list", "reach", "long", len)
    return counted.join(numbers.select(roles.user, (F.col("__number") + 1).alias("__number")), "__number").select(roles.user, "reach")


def two_hop_reach(df: DataFrame, roles: Roles, lg_k: int = 10) -> DataFrame:
    """Estimated number of distinct users, the user included, that share an item with the user.

    One sketch per item, the 2 ** ``lg_k`` smallest hashes of its users, is merged per user: work grows with the edges, not with the
    pairs of users. A small item's sketch is as short as its list of users, and a reach below 2 ** ``lg_k`` is exact but for equal hashes.
    The standard error above is 1 / sqrt(2 ** ``lg_k`` - 2).
    """
    size, space = 2 ** lg_k, float(1 << 32)

    def estimate(hashes: np.ndarray) -> int:
        # from 2 ** lg_k on, from the part of the hash space that the smallest of them fill
        used = len(hashes) if len(hashes) < size else (size - 1) * space / (hashes[size - 1] + 1.0)
        return round(-space * math.log1p(-min(used / space, 1 - 1 / space)))  # different users with one hash

    hashed = F.shiftrightunsigned(F.xxhash64(roles.user), 32)
    signed = F.when(F.col("__hash") < 1 << 31, F.col("__hash")).otherwise(F.col("__hash") - (1 << 32)).cast("int")  # four bytes
    edges = materialize(df.select(roles.user, roles.item).where(F.col(roles.item).isNotNull()).distinct(), "edges")
    smallest = Window.partitionBy(roles.item).orderBy("__hash")
    sketches = (
        edges.where(F.col(roles.user).isNotNull()).select(roles.item, hashed.alias("__hash")).distinct()
        .withColumn("__place", F.row_number().over(smallest)).where(F.col("__place") <= size)
        .groupBy(roles.item).agg(F.collect_list(signed).alias("__sketch"))
    )
    return _in_runs(edges.join(sketches, roles.item, "left"), roles.user, "__sketch", "two_hop_reach", "long", estimate)
