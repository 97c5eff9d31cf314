"""Feedback as a stream: each operator takes a streaming DataFrame and equals its batch twin once the input is read."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessela.roles import SIGNAL_WEIGHTS
from tessela.session import scratch_path
from tessela.streaming.store import COMPACT_EVERY, StreamTable


def feedback_stream(
    spark: SparkSession, folder: str, schema: StructType | str, file_type: str = "parquet",
    max_files_per_trigger: int = 1000, glob: str | None = None,
) -> DataFrame:
    """New files of a folder with an explicit schema."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if file_type == "csv":
        reader = reader.option("header", True)
    return reader.format(file_type).load(folder)


def dedupe(stream: DataFrame, key: str = "event_id", ts: str = "ts", lateness: str = "1 hour") -> DataFrame:
    """One row per key within the lateness; rows behind the watermark leave and are counted in the query's progress.

    ``stateful.dedupe_with_late`` hands late rows on instead.
    """
    return stream.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([key])


def window_counts(
    stream: DataFrame, keys: Sequence[str], ts: str = "ts", width: str = "1 day", slide: str | None = None,
    lateness: str = "1 hour",
) -> DataFrame:
    """Counts per key and tumbling or sliding window."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    counted = stream.withWatermark(ts, lateness).groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("rows"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "rows")


def stream_sessions(stream: DataFrame, user: str = "user_id", ts: str = "ts", gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """Sessions of each user, closed by a pause of the gap; in append mode a session leaves once the watermark passes it."""
    grouped = stream.withWatermark(ts, lateness).groupBy(user, F.session_window(ts, gap).alias("w"))
    return grouped.agg(F.count(F.lit(1)).alias("rows")).select(
        user, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "rows")


def preference_delta(rows: DataFrame) -> DataFrame:
    """What the rows of one micro-batch add per user and item: weight, number of rows, last time; decay is for the reader."""
    weights = F.create_map(*[part for name, w, _ in SIGNAL_WEIGHTS for part in (F.lit(name), F.lit(float(w)))])
    known = rows.where(F.col("event_type").isin(*[w[0] for w in SIGNAL_WEIGHTS]))
    return known.groupBy("user_id", "item_id").agg(
        F.sum(weights[F.col("event_type")]).alias("preference"), F.count(F.lit(1)).alias("rows"), F.max("ts").alias("last_ts"))


def merge_preference(parts: DataFrame) -> DataFrame:
    """The sum of deltas."""
    return parts.groupBy("user_id", "item_id").agg(
        F.sum("preference").alias("preference"), F.sum("rows").alias("rows"), F.max("last_ts").alias("last_ts"))


def enrich(stream: DataFrame, items: DataFrame, key: str = "item_id") -> DataFrame:
    """Each event with the attributes of its item, also where the item is unknown."""
    return stream.join(items, key, "left")


def view_to_purchase(views: DataFrame, purchases: DataFrame, within: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """Purchases of a user and item at most ``within`` after a view; state older than that is dropped."""
    v = views.select(F.col("user_id").alias("v_user"), F.col("item_id").alias("v_item"), F.col("event_id").alias("view_id"),
                     F.col("ts").alias("view_ts")).withWatermark("view_ts", lateness)
    p = purchases.select("user_id", "item_id", F.col("event_id").alias("purchase_id"), F.col("ts").alias("purchase_ts"),
                         "value").withWatermark("purchase_ts", lateness)
    condition = (
        (F.col("v_user") == F.col("user_id")) & (F.col("v_item") == F.col("item_id"))
        & (F.col("purchase_ts") >= F.col("view_ts"))
        & (F.col("purchase_ts") <= F.col("view_ts") + F.expr(f"INTERVAL {within}"))
    )
    return v.join(p, condition).select("user_id", "item_id", "view_id", "purchase_id", "view_ts", "purchase_ts", "value")


def run_available(stream: DataFrame, name: str, output_mode: str, folder: str | None = None) -> tuple[DataFrame, list[dict]]:
    """Process all input that has arrived; (all rows written so far with their ``batch``, progress reports of this run).

    With a ``folder`` the next run goes on where this one stopped; without, the run is on its own, below the scratch folder.
    """
    table = StreamTable(stream.sparkSession, folder or scratch_path(stream.sparkSession, name))
    reports = table.run(stream, output_mode=output_mode)
    return table.read(), reports


def run_merged(
    stream: DataFrame, delta: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame], DataFrame], name: str,
    compact_every: int = COMPACT_EVERY, folder: str | None = None,
) -> DataFrame:
    """Process all input that has arrived into a table of deltas that ``merge`` sums; no streaming state is kept.

    With a ``folder`` the next run adds the input that is new by then, see ``StreamTable``.
    """
    table = StreamTable(stream.sparkSession, folder or scratch_path(stream.sparkSession, name), merge, compact_every)
    table.run(stream, delta)
    return table.read()


def latest(written: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The newest version of each key from a query in update mode."""
    values = [c for c in written.columns if c not in (*keys, "batch")]
    return written.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*keys, "v.*")
