"""Streaming queries: the events file is read as a stream, run until the input is used up, and equals its batch twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessela.plans.fixtures import K1, X2, event_columns, rounded, table
from tessela.plans.q_tables import EVENT_SCHEMA
from tessela.plans.registry import query
from tessela.session import scratch_path
from tessela.streaming import feedback as streams
from tessela.streaming import stateful


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_columns(streams.feedback_stream(spark, sf_dir, EVENT_SCHEMA, glob="events.parquet"))


@query("s1_feedback_stream", f"WITH {X2} SELECT event_id, user_id, item_id, event_type, value, epoch_us(ts) AS us FROM x2")
def s1(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "feedback")
    for _ in range(2):  # the second run goes on from the checkpoint and finds no new file
        rows, _ = streams.run_available(_events(spark, sf_dir), "feedback", "append", folder)
    return rows.withColumn("us", F.unix_micros("ts")).drop("batch", "ts")


@query("s2_dedupe", "SELECT event_type, count(*) AS rows, count(DISTINCT event_id) AS ids FROM events GROUP BY 1")
def s2(spark: SparkSession, sf_dir: str) -> DataFrame:
    twice = _events(spark, sf_dir).unionByName(_events(spark, sf_dir))
    rows, _ = streams.run_available(streams.dedupe(twice).select("event_id", "event_type"), "dedupe", "append")
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("event_id").alias("ids"))


@query("s2_late_rows", f"""
WITH {X2}, w AS (SELECT (epoch_us(max(ts)) // 1000 - 3600000) * 1000 AS w FROM x2 WHERE event_type <> 'purchase')
SELECT event_type, count(*) FILTER (WHERE NOT late) AS rows, count(*) FILTER (WHERE late) AS late_rows
FROM (SELECT event_type, event_type = 'purchase' AND epoch_us(ts) <= w AS late FROM x2, w) GROUP BY 1""")
def s2_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All other events arrive first, twice each; purchases come in a second run, most of them behind the watermark by then."""
    folder = scratch_path(spark, "late")
    events = event_columns(table(spark, sf_dir, "events"))
    others = events.where("event_type <> 'purchase'")
    for arrival in (others.unionByName(others), events.where("event_type = 'purchase'")):
        arrival.write.mode("append").parquet(f"{folder}/in")
        stream = streams.feedback_stream(spark, f"{folder}/in", events.schema, max_files_per_trigger=100_000)
        rows, _ = streams.run_available(stateful.dedupe_with_late(stream), "late", "append", f"{folder}/table")
    return rows.groupBy("event_type").agg(F.count_if(~F.col("late")).alias("rows"), F.count_if("late").alias("late_rows"))


def _windows(spark: SparkSession, sf_dir: str, slide: str | None, keys: tuple[str, ...]) -> DataFrame:
    counted = streams.window_counts(_events(spark, sf_dir), keys, slide=slide)
    rows, _ = streams.run_available(counted, "windows", "update")
    return streams.latest(rows, ("window_start", "window_end", *keys)).select(
        F.unix_seconds("window_start").alias("window_start"), F.unix_seconds("window_end").alias("window_end"), *keys, "rows")


@query("s3_tumbling_counts", f"""
WITH {X2} SELECT epoch(date_trunc('day', ts))::BIGINT AS window_start, epoch(date_trunc('day', ts))::BIGINT + 86400 AS window_end, item_id, event_type, count(*) AS rows
FROM x2 GROUP BY ALL""")
def s3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir, None, ("item_id", "event_type"))


@query("s3_sliding_counts", f"""
WITH {X2}, w AS (SELECT event_type, epoch(date_trunc('hour', ts))::BIGINT - 3600 * unnest(range(24)) AS window_start FROM x2)
SELECT window_start, window_start + 86400 AS window_end, event_type, count(*) AS rows FROM w GROUP BY ALL""")
def s3_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir, "1 hour", ("event_type",))


@query("s4_stream_sessions", f"""
WITH {X2}, l AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM x2),
  n AS (SELECT *, sum(CASE WHEN p IS NULL OR epoch_us(ts) - epoch_us(p) >= 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM l)
SELECT user_id, epoch_us(min(ts)) AS session_start, epoch_us(max(ts)) + 1800000000 AS session_end, count(*) AS rows FROM n GROUP BY user_id, s
HAVING epoch_us(max(ts)) + 1800000000 <= (SELECT epoch_ms(max(ts)) * 1000 - 3600000000 FROM x2)""")
def s4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = streams.run_available(streams.stream_sessions(_events(spark, sf_dir)), "sessions", "append")
    return rows.select(
        "user_id", F.unix_micros("session_start").alias("session_start"), F.unix_micros("session_end").alias("session_end"), "rows")


@query("s5_running_preference", f"""
WITH {K1} SELECT user_id, item_id, sum(w) AS preference, count(*) AS rows, epoch_us(max(ts)) AS last_us FROM k1 GROUP BY 1, 2""")
def s5(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "preference")
    for _ in range(2):
        rows = streams.run_merged(_events(spark, sf_dir), streams.preference_delta, streams.merge_preference, "preference", folder=folder)
    return rows.select(
        "user_id", "item_id", "preference", "rows", F.unix_micros("last_ts").alias("last_us"))


@query("s6_enrichment_join", f"""
WITH {X2} SELECT event_id, item_id, p_type AS category, p_brand AS brand FROM x2 LEFT JOIN part ON item_id = p_partkey""")
def s6(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item_id"), F.col("p_type").alias("category"), F.col("p_brand").alias("brand"))
    rows, _ = streams.run_available(
        streams.enrich(_events(spark, sf_dir), items).select("event_id", "item_id", "category", "brand"), "enriched", "append")
    return rows.drop("batch")


@query("s6_view_to_purchase", f"""
WITH {X2} SELECT v.event_id AS view_id, p.event_id AS purchase_id, p.user_id, p.item_id, round(p.value, 6) AS value FROM x2 v JOIN x2 p
  ON v.user_id = p.user_id AND v.item_id = p.item_id AND v.event_type = 'view' AND p.event_type = 'purchase'
  AND p.ts >= v.ts AND p.ts <= v.ts + INTERVAL 1 DAY""")
def s6_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = _events(spark, sf_dir).where(F.col("event_type") == "view")
    purchases = _events(spark, sf_dir).where(F.col("event_type") == "purchase")
    rows, _ = streams.run_available(streams.view_to_purchase(views, purchases, "1 day"), "view-to-purchase", "append")
    return rows.select("view_id", "purchase_id", "user_id", "item_id", rounded("value").alias("value"))


@query("s7_user_recency", f"""
WITH {X2} SELECT user_id, epoch_us(max(ts)) AS last_us, count(*) AS rows FROM x2 GROUP BY 1""")
def s7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = streams.run_available(stateful.user_recency(_events(spark, sf_dir)), "recency", "update")
    return streams.latest(rows.where(~F.col("expired")).drop("expired"), ("user_id",))
