"""State with event timers: duplicates and late rows told apart, and the recency of users with an expiry.

Both processors see the watermark but keep it off their input rows, so Spark hands them late rows instead of dropping them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from tessela.session import ship

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EXPIRY_MS = 30 * 86_400_000


def _use_state(spark: SparkSession) -> None:
    """The state store that timers and value states need; a restarted query keeps the one it began with."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    ship(spark)


class Deduplicator(StatefulProcessor):
    """Per bucket of keys, the keys seen and the event time each is kept until; a timer at the next expiry lets go of them."""

    def __init__(self, columns: list[str], lateness_ms: int):
        self.columns, self.lateness_ms = columns, lateness_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "keys array<string>, until array<long>, timer long")

    def _load(self) -> tuple[dict[str, int], int | None]:
        if not self.seen.exists():
            return {}, None
        keys, until, timer = self.seen.get()
        return dict(zip(keys, until, strict=True)), timer

    def _store(self, held: dict[str, int], timer: int | None, watermark: int) -> None:
        held = {k: t for k, t in held.items() if t > watermark}
        if timer is not None and timer > watermark:
            self.handle.deleteTimer(timer)
        if not held:
            self.seen.clear()
            return
        timer = min(held.values())
        self.handle.registerTimer(timer)
        self.seen.update((list(held), list(held.values()), timer))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        held, timer = self._load()
        for part in rows:
            part.columns = self.columns  # names that are no Python names arrive under others
            late = part["__us"] <= watermark * 1000
            names = part["__key"]
            fresh = ~late & ~names.isin(held.keys())
            fresh &= ~names.where(fresh).duplicated() | ~fresh
            chosen = part[fresh]
            held.update(zip(chosen["__key"], (chosen["__us"] // 1000 + self.lateness_ms).tolist(), strict=True))
            yield part.assign(late=late)[late | fresh].drop(columns=["__key", "__bucket"])
        self._store(held, timer, watermark)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, timer = self._load()
        self._store(held, None if timer == expiredTimerInfo.getExpiryTimeInMs() else timer, timerValues.getCurrentWatermarkInMs())
        yield from ()

    def close(self) -> None:
        pass


def dedupe_with_late(stream: DataFrame, key: str = "event_id", ts: str = "ts", lateness_seconds: int = 3600, buckets: int = 1024) -> DataFrame:
    """Rows of the stream with a column ``late``: the first row of each key, and every row behind the watermark.

    A late row is one whose time is at or before (newest time of earlier batches - lateness); it is handed on, marked, and
    neither counts as a duplicate nor as the first of its key. A key is remembered until the watermark passes its time plus
    the lateness, as in ``dropDuplicatesWithinWatermark``. Rows without a time go by the epoch. Keys meet in ``buckets``
    hashed groups, each a vectorised step and one state; choose so many that a bucket's keys of the lateness fit a task.
    """
    _use_state(stream.sparkSession)
    payload = [f for f in stream.schema.fields if f.name != ts]
    rows = stream.withWatermark(ts, f"{lateness_seconds} seconds").select(
        *[f.name for f in payload], F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")), F.lit(0)).alias("__us"),
        F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("-")).alias("__key"))
    rows = rows.withColumn("__bucket", F.pmod(F.xxhash64("__key"), F.lit(buckets)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in payload) + ", __us long, late boolean"
    found = rows.groupBy("__bucket").transformWithStateInPandas(Deduplicator(rows.columns, lateness_seconds * 1000), schema, "append", "eventtime")
    return found.withColumn(ts, F.timestamp_micros("__us")).select(*stream.columns, "late")


class Recency(StatefulProcessor):
    """Per user the last time and the number of rows, until an event timer set ``expiry_ms`` after the last row."""

    def __init__(self, expiry_ms: int):
        self.expiry_ms = expiry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "last_us long, rows long, timer long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        last, count, timer = self.known.get() if self.known.exists() else (-(2**62), 0, None)
        for part in rows:
            last, count = max(last, int(part["last_us"].max())), count + int(part["rows"].sum())
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = max(last // 1000 + self.expiry_ms, timerValues.getCurrentWatermarkInMs() + 1)
        self.handle.registerTimer(timer)
        self.known.update((last, count, timer))
        yield pd.DataFrame({"user_id": [key[0]], "last_us": [last], "rows": [count], "expired": [False]})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.known.exists():
            return
        last, count, _ = self.known.get()
        self.known.clear()
        yield pd.DataFrame({"user_id": [key[0]], "last_us": [last], "rows": [count], "expired": [True]})

    def close(self) -> None:
        pass


def _partial_recency(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch.groupby("user_id", as_index=False, dropna=False).agg(last_us=("last_us", "max"), rows=("last_us", "size"))


def user_recency(stream: DataFrame, ts: str = "ts", lateness: str = "1 hour", expiry_ms: int = EXPIRY_MS) -> DataFrame:
    """Last time and number of rows per user, in update mode; a state leaves as ``expired`` once the watermark passes
    ``expiry_ms`` after its last row. Late rows count too. Rows without a user or time are not looked at.

    Arrow batches are pre-aggregated before the shuffle, so a hot user sends a few rows per batch to its state.
    """
    _use_state(stream.sparkSession)
    rows = stream.withWatermark(ts, lateness).where(F.col("user_id").isNotNull() & F.col(ts).isNotNull()).select(
        F.col("user_id").cast("long").alias("user_id"), F.unix_micros(F.col(ts).cast("timestamp")).alias("last_us"))
    partial = rows.mapInPandas(_partial_recency, "user_id long, last_us long, rows long")
    schema = "user_id long, last_us long, rows long, expired boolean"
    return partial.groupBy("user_id").transformWithStateInPandas(Recency(expiry_ms), schema, "update", "eventtime")
