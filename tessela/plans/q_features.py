"""Queries on features and training-set preparation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessela.operators import features, prep, specs
from tessela.plans.fixtures import (
    AS_OF,
    AS_OF_ORDERS,
    EVENT_ROLES,
    ORDER_ROLES,
    X1,
    X2,
    event_interactions,
    order_interactions,
    rounded,
)
from tessela.plans.registry import query
from tessela.session import materialize

ROW_KEY = ("session_id", "line_no", "item_id", "supplier_id", "amount")
_KEY = ", ".join(ROW_KEY)
_TIE = "session_id, line_no, item_id, supplier_id, signal, amount"


@query("e1_minmax_signal", f"""
WITH {X1} SELECT {_KEY}, round((signal - (SELECT min(signal) FROM x1)) / ((SELECT max(signal) FROM x1) - (SELECT min(signal) FROM x1)), 9) AS signal_normalized FROM x1""")
def e1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.minmax_signal(order_interactions(spark, sf_dir), ORDER_ROLES).select(
        *ROW_KEY, rounded("signal_normalized", 9).alias("signal_normalized"))


@query("e2_temporal_features", f"""
WITH {X2} SELECT event_id, hour(ts) AS hour_of_day, isodow(ts) AS day_of_week, day(ts) AS day_of_month, month(ts) AS month,
  quarter(ts) AS quarter, year(ts) AS year, isodow(ts) > 5 AS is_weekend, hour(ts) BETWEEN 9 AND 17 AS is_business_hours FROM x2""")
def e2(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = features.temporal_features(event_interactions(spark, sf_dir), EVENT_ROLES)
    parts = ("hour_of_day", "day_of_week", "day_of_month", "month", "quarter", "year")
    return made.select("event_id", *[F.col(c).cast("long").alias(c) for c in parts], "is_weekend", "is_business_hours")


_DAYS = f"((epoch_us(TIMESTAMP '{AS_OF_ORDERS}') - epoch_us(max(ts))) // 86400000000)::BIGINT"


@query("e3_user_features", f"""
WITH {X1} SELECT user_id, count(*) AS user_interaction_count, round(avg(signal), 6) AS user_signal_mean,
  round(stddev_samp(signal), 6) AS user_signal_std, epoch(max(ts))::BIGINT AS user_last_activity, {_DAYS} AS user_recency_days
FROM x1 GROUP BY 1""")
def e3(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = features.user_features(order_interactions(spark, sf_dir), ORDER_ROLES, AS_OF_ORDERS)
    return made.withColumns({
        "user_signal_mean": rounded("user_signal_mean"), "user_signal_std": rounded("user_signal_std"),
        "user_last_activity": F.unix_seconds("user_last_activity")})


@query("e4_recency_days", f"""
WITH {X2} SELECT user_id, ((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(max(ts))) // 86400000000)::BIGINT AS recency_days FROM x2 GROUP BY 1""")
def e4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.recency_days(event_interactions(spark, sf_dir), EVENT_ROLES, AS_OF)


@query("e5_item_features", f"""
WITH {X1} SELECT item_id, count(*) AS item_interaction_count, round(avg(signal), 6) AS item_signal_mean,
  round(stddev_samp(signal), 6) AS item_signal_std FROM x1 GROUP BY 1""")
def e5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.item_features(order_interactions(spark, sf_dir), ORDER_ROLES).withColumns({
        "item_signal_mean": rounded("item_signal_mean"), "item_signal_std": rounded("item_signal_std")})


@query("e6_join_back", f"""
WITH {X1}, u AS (SELECT user_id, count(*) AS user_interaction_count, avg(signal) AS m FROM x1 GROUP BY 1),
  i AS (SELECT item_id, count(*) AS item_interaction_count FROM x1 GROUP BY 1)
SELECT {_KEY}, user_interaction_count, round(m, 6) AS user_signal_mean, item_interaction_count
FROM x1 JOIN u USING (user_id) JOIN i USING (item_id)""")
def e6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_interactions(spark, sf_dir)
    joined = features.join_back(rows, features.user_features(rows, ORDER_ROLES), "user_id")
    joined = features.join_back(joined, features.item_features(rows, ORDER_ROLES), "item_id")
    return joined.select(*ROW_KEY, "user_interaction_count", rounded("user_signal_mean").alias("user_signal_mean"),
                         "item_interaction_count")


@query("e7_pair_history", f"""
WITH {X1} SELECT {_KEY}, count(*) OVER (PARTITION BY user_id, item_id) AS user_item_interactions FROM x1""")
def e7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.pair_history(order_interactions(spark, sf_dir), ORDER_ROLES).select(*ROW_KEY, "user_item_interactions")


@query("e7b_pair_history_asof", f"""
WITH {X1} SELECT {_KEY}, count(*) OVER (PARTITION BY user_id, item_id ORDER BY ts, {_TIE} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
  AS user_item_history FROM x1""")
def e7b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.pair_history_asof(order_interactions(spark, sf_dir), ORDER_ROLES).select(*ROW_KEY, "user_item_history")


@query("e8_session_stats", f"""
WITH {X2} SELECT user_id, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 AS session_duration, count(*) AS session_length
FROM x2 GROUP BY 1""")
def e8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.session_stats(event_interactions(spark, sf_dir), EVENT_ROLES)


@query("e9_session_position", f"""
WITH {X1} SELECT {_KEY}, row_number() OVER (PARTITION BY session_id ORDER BY ts, {_TIE}) AS session_position FROM x1""")
def e9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.session_position(order_interactions(spark, sf_dir), ORDER_ROLES).select(*ROW_KEY, "session_position")


_SESSIONS = f"""{X2}, l AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM x2),
  n AS (SELECT *, sum(CASE WHEN p IS NULL OR epoch_us(ts) - epoch_us(p) >= 1800000000 THEN 1 ELSE 0 END)
        OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session_no FROM l)"""


@query("e10_sessionize", f"WITH {_SESSIONS} SELECT event_id, user_id, session_no FROM n")
def e10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.sessionize(event_interactions(spark, sf_dir), EVENT_ROLES).select("event_id", "user_id", "session_no")


@query("e11_synthesis_transforms", f"""
WITH {X1} SELECT {_KEY}, abs(signal) AS "ABSOLUTE(signal)", abs(price) AS "ABSOLUTE(price)",
  round(CASE WHEN signal <> 0 THEN 1 / signal END, 9) AS "1 / signal", round(CASE WHEN price <> 0 THEN 1 / price END, 9) AS "1 / price",
  (signal > 25) AND (price > 1000) AS "bulk * costly" FROM x1""")
def e11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_interactions(spark, sf_dir).withColumns({"bulk": F.col("signal") > 25, "costly": F.col("price") > 1000})
    made = features.synthesis_transforms(rows, ("user_id", "item_id", "session_id", "line_no", "supplier_id", "amount"))
    return rows.select(*ROW_KEY, *[(rounded(e, 9) if n.startswith("1 /") else e).alias(n) for n, e in made.items()])


def _aggregates_sql(key: str, parent: str, columns: tuple[tuple[str, str], ...]) -> str:
    parts = [f'count(*) AS "{parent}.COUNT"']
    for name, expression in columns:
        parts += [f'round(avg({expression}), 6) AS "{parent}.MEAN({name})"', f'round(sum({expression}), 4) AS "{parent}.SUM({name})"',
                  f'round(stddev_samp({expression}), 6) AS "{parent}.STD({name})"', f'round(min({expression}), 9) AS "{parent}.MIN({name})"',
                  f'round(max({expression}), 9) AS "{parent}.MAX({name})"']
    return f"SELECT {key}, " + ", ".join(parts) + f" FROM x1 GROUP BY {key}"


def _round_aggregates(df: DataFrame, key: str) -> DataFrame:
    digits = {"MEAN": 6, "SUM": 4, "STD": 6, "MIN": 9, "MAX": 9}
    columns = []
    for c in df.columns:
        kind = c.split(".", 1)[-1].split("(", 1)[0]
        columns.append(rounded(F.col(f"`{c}`"), digits[kind]).alias(c) if kind in digits else F.col(f"`{c}`"))
    return df.select(*columns)


@query("e12_synthesis_aggregates", f"WITH {X1} " + _aggregates_sql("user_id", "users", (("signal", "signal"), ("price", "price"))))
def e12(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = features.synthesis_aggregates(order_interactions(spark, sf_dir), "user_id", "users", ("signal", "price"))
    return _round_aggregates(made, "user_id")


@query("e13_synthesis_depth2", f"WITH {X1} " + _aggregates_sql(
    "item_id", "items", (("ABSOLUTE(signal)", "abs(signal)"), ("1 / signal", "CASE WHEN signal <> 0 THEN 1 / signal END"))))
def e13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_interactions(spark, sf_dir).select("item_id", "signal")
    base = rows.withColumns(features.synthesis_transforms(rows, ("item_id",)))
    return _round_aggregates(
        features.synthesis_aggregates(base, "item_id", "items", ("ABSOLUTE(signal)", "1 / signal")), "item_id")


@query("e14_capped_synthesis", f"""
WITH {X1}, u AS (SELECT user_id, count(*) AS n, avg(signal) AS m, sum(signal) AS s FROM x1 GROUP BY 1)
SELECT user_id, item_id, session_id, signal, price, abs(signal) AS "ABSOLUTE(signal)", abs(price) AS "ABSOLUTE(price)",
  round(CASE WHEN signal <> 0 THEN 1 / signal END, 9) AS "1 / signal", round(CASE WHEN price <> 0 THEN 1 / price END, 9) AS "1 / price",
  n AS "users.COUNT", round(m, 6) AS "users.MEAN(signal)", s AS "users.SUM(signal)" FROM x1 JOIN u USING (user_id)""")
def e14(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_interactions(spark, sf_dir).select("user_id", "item_id", "session_id", "signal", "price")
    made = features.deep_features(rows, ORDER_ROLES, depth=2, max_new=7)
    return made.select(*[
        rounded(F.col(f"`{c}`"), 9).alias(c) if c.startswith("1 /") else
        rounded(F.col(f"`{c}`")).alias(c) if "MEAN" in c else F.col(f"`{c}`") for c in made.columns])


@query("e15_finalize_features", f"""
WITH {X1} SELECT DISTINCT user_id, coalesce(nullif(signal, 7), 0) AS signal, coalesce(nullif(segment, 'BUILDING'), 'UNKNOWN') AS segment
FROM x1""")
def e15(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_interactions(spark, sf_dir).select(
        "user_id", F.nullif("signal", F.lit(7.0)).alias("signal"), F.nullif("segment", F.lit("BUILDING")).alias("segment"),
        F.when(F.col("price") < 950, F.col("brand")).alias("mostly_null"))
    return features.finalize_features(rows)


_SPEC_DAYS = f"(epoch_us(TIMESTAMP '{AS_OF_ORDERS}') - epoch_us({{}}(ts))) // 86400000000"
_BY_USER = f"""u AS (SELECT user_id, count(*) AS user_interaction_count, sum(signal * price) AS user_engagement_score,
    ({_SPEC_DAYS.format('max')})::BIGINT AS user_last_activity_days, avg(signal) AS user_mean_signal, stddev_samp(signal) AS user_signal_std FROM x1 GROUP BY 1)"""
_BY_ITEM = f"""i AS (SELECT item_id, count(*) AS item_interaction_count, avg(signal) AS item_avg_signal,
    ({_SPEC_DAYS.format('min')})::BIGINT AS item_age_days, var_samp(signal) AS item_signal_variance FROM x1 GROUP BY 1)"""


@query("e16_features_from_specs", f"""
WITH {X1}, {_BY_USER}, {_BY_ITEM}, b AS (SELECT min(signal) AS lo, max(signal) AS hi FROM x1),
  s AS (SELECT session_id, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 AS session_length FROM x1 GROUP BY 1)
SELECT {", ".join("x1." + c for c in ROW_KEY)}, user_interaction_count, round(user_engagement_score, 2) AS user_engagement_score, user_last_activity_days,
  item_interaction_count, round(item_avg_signal, 6) AS item_avg_signal, item_age_days,
  count(*) OVER (PARTITION BY user_id, item_id ORDER BY ts, {_TIE} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS user_item_interaction_history,
  round((signal - lo) / (hi - lo), 9) AS interaction_signal_strength, hour(ts) AS interaction_hour, isodow(ts) AS interaction_day_of_week,
  isodow(ts) > 5 AS interaction_is_weekend, session_length, row_number() OVER (PARTITION BY session_id ORDER BY ts, {_TIE}) AS session_position,
  round(user_mean_signal, 6) AS user_mean_signal, round(user_signal_std, 6) AS user_signal_std, round(item_signal_variance, 6) AS item_signal_variance
FROM x1 JOIN u USING (user_id) JOIN i USING (item_id) JOIN s USING (session_id) CROSS JOIN b""".replace(
    "x1.session_id,", "session_id,", 1).replace("x1.item_id,", "item_id,", 1))
def e16(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = specs.default_specs(ORDER_ROLES, weight="price")
    # only what is measured, ordered by or returned is written and dealt by the scans and joins
    used = dict.fromkeys([*ROW_KEY, "user_id", "item_id", "signal", "ts", "price", *ORDER_ROLES.tiebreak])
    made = specs.features_from_specs(order_interactions(spark, sf_dir).select(*used), ORDER_ROLES, wanted, AS_OF_ORDERS)
    digits = {"user_engagement_score": 2, "interaction_signal_strength": 9, "item_avg_signal": 6, "user_mean_signal": 6,
              "user_signal_std": 6, "item_signal_variance": 6}
    made = made.withColumns({c: F.col(c).cast("long") for c in ("interaction_hour", "interaction_day_of_week")})
    return made.select(*ROW_KEY, *[
        rounded(s.name, digits[s.name]).alias(s.name) if s.name in digits else F.col(s.name) for s in wanted])


def _picked(spark: SparkSession, sf_dir: str, names: tuple[str, ...], weight: str | None = "price") -> DataFrame:
    wanted = [s for s in specs.default_specs(ORDER_ROLES, weight) if s.name in names]
    return specs.features_from_specs(order_interactions(spark, sf_dir), ORDER_ROLES, wanted, AS_OF_ORDERS)


def _entities(spark: SparkSession, sf_dir: str, key: str, names: tuple[str, ...]) -> DataFrame:
    wanted = [s for s in specs.default_specs(ORDER_ROLES, "price") if s.name in names]
    return specs.entity_features(order_interactions(spark, sf_dir), wanted, key, AS_OF_ORDERS)


@query("e17_engagement_score", f"""
WITH {X1} SELECT user_id, round(sum(signal * price), 2) AS user_engagement_score FROM x1 GROUP BY 1""")
def e17(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _entities(spark, sf_dir, "user_id", ("user_engagement_score",))
    return made.select("user_id", rounded("user_engagement_score", 2).alias("user_engagement_score"))


@query("e18_item_age_days", f"""
WITH {X1}, {_BY_ITEM} SELECT item_id, item_age_days FROM i""")
def e18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entities(spark, sf_dir, "item_id", ("item_age_days",))


@query("e19_signal_spread", f"""
WITH {X1}, {_BY_USER}, {_BY_ITEM} SELECT DISTINCT user_id, item_id, round(user_mean_signal, 6) AS user_mean_signal,
  round(user_signal_std, 6) AS user_signal_std, round(item_signal_variance, 6) AS item_signal_variance
FROM x1 JOIN u USING (user_id) JOIN i USING (item_id)""")
def e19(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = _entities(spark, sf_dir, "user_id", names := ("user_mean_signal", "user_signal_std"))
    items = _entities(spark, sf_dir, "item_id", ("item_signal_variance",))
    pairs = order_interactions(spark, sf_dir).select("user_id", "item_id").distinct()
    made = pairs.join(users, "user_id").join(items, "item_id")
    return made.select("user_id", "item_id", *[rounded(n).alias(n) for n in (*names, "item_signal_variance")])


@query("e20_time_specs", f"""
WITH {X1} SELECT {_KEY}, hour(ts) AS interaction_hour, isodow(ts) AS interaction_day_of_week, isodow(ts) > 5 AS interaction_is_weekend,
  row_number() OVER (PARTITION BY session_id ORDER BY ts, {_TIE}) AS session_position FROM x1""")
def e20(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("interaction_hour", "interaction_day_of_week", "interaction_is_weekend", "session_position")
    made = _picked(spark, sf_dir, names).select(*ROW_KEY, *names)
    return made.withColumns({c: F.col(c).cast("long") for c in names[:2]})


@query("e21_bias", f"WITH {X2} SELECT event_id, 1 AS bias FROM x2")
def e21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.add_bias(event_interactions(spark, sf_dir)).select("event_id", "bias")


@query("e22_graph_features", f"""
WITH {X1}, e AS (SELECT user_id, item_id, sum(signal) AS w FROM x1 GROUP BY 1, 2), d AS (SELECT item_id, count(*) AS d FROM e GROUP BY 1)
SELECT user_id, count(*) AS degree, sum(w) AS weighted_degree, sum(d - 1)::BIGINT AS two_hop_paths FROM e JOIN d USING (item_id) GROUP BY 1""")
def e22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.graph_features(order_interactions(spark, sf_dir), ORDER_ROLES)


_REACH = f"""{X1}, e AS (SELECT DISTINCT user_id, item_id FROM x1),
  r AS (SELECT a.user_id, count(DISTINCT b.user_id) AS reach FROM e a JOIN e b USING (item_id) GROUP BY 1)"""


@query("e22_two_hop_reach", f"WITH {_REACH} SELECT user_id, reach AS two_hop_reach FROM r")
def e22_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.two_hop_counts(order_interactions(spark, sf_dir), ORDER_ROLES).withColumnRenamed("reach", "two_hop_reach")


@query("e22_two_hop_sketch", f"WITH {_REACH} SELECT user_id, reach, TRUE AS within_a_tenth FROM r")
def e22_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The estimate of every user against its exact reach: six standard errors of a sketch of 2 ** 12 registers are a tenth."""
    rows = materialize(order_interactions(spark, sf_dir).select("user_id", "item_id").distinct(), "interactions")  # asked for twice
    both = features.two_hop_counts(rows, ORDER_ROLES).join(features.two_hop_reach(rows, ORDER_ROLES, lg_k=12), "user_id")
    return both.select("user_id", "reach", (F.abs(F.col("two_hop_reach") / F.col("reach") - 1) < 0.1).alias("within_a_tenth"))


@query("f1_label", f"WITH {X2} SELECT event_id, CASE WHEN value > 100 THEN 1.0::DOUBLE ELSE 0.0 END AS label FROM x2")
def f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_interactions(spark, sf_dir).select("event_id", (F.col("value") - 100).alias("rating"))
    return prep.with_label(rows).select("event_id", "label")


def _index_sql(column: str) -> str:
    return f"""(SELECT {column}, row_number() OVER (ORDER BY f, {column}) AS {column}_index FROM
      (SELECT {column}, min(ts) AS f FROM n WHERE {column} IS NOT NULL GROUP BY 1))"""


@query("f2_category_index", f"""
WITH {X1}, n AS (SELECT {_KEY}, ts, brand, nullif(segment, 'BUILDING') AS segment FROM x1)
SELECT {_KEY}, brand_index, coalesce(segment_index, 0) AS segment_index FROM n LEFT JOIN {_index_sql('brand')} USING (brand)
  LEFT JOIN {_index_sql('segment')} USING (segment)""")
def f2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_interactions(spark, sf_dir).select(*ROW_KEY, "ts", "brand", F.nullif("segment", F.lit("BUILDING")).alias("segment"))
    return prep.index_categories(rows, ("brand", "segment"), "ts").select(*ROW_KEY, "brand_index", "segment_index")


@query("f3_dense_vector", f"""
WITH {X1} SELECT {_KEY}, round((coalesce(nullif(signal, 7), 0)::FLOAT::DOUBLE + price::FLOAT::DOUBLE), 4) AS total FROM x1""")
def f3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_interactions(spark, sf_dir).withColumn("signal", F.nullif("signal", F.lit(7.0)))
    vector = prep.dense_vector(("signal", "price")).cast("array<double>")
    return rows.select(*ROW_KEY, vector.alias("v")).select(*ROW_KEY, rounded(F.col("v")[0] + F.col("v")[1], 4).alias("total"))


@query("f4_preference_pairs", f"""
WITH {X1}, s AS (SELECT *, signal > (SELECT quantile_cont(signal, 0.5) FROM x1) AS p FROM x1),
  r AS (SELECT *, row_number() OVER (PARTITION BY user_id, p ORDER BY ts DESC, item_id, session_id, line_no, supplier_id, signal, amount) AS pair_no FROM s)
SELECT a.user_id, a.pair_no, a.item_id AS pos_item, b.item_id AS neg_item, a.signal AS pos_signal, b.signal AS neg_signal
FROM r a JOIN r b ON a.user_id = b.user_id AND a.pair_no = b.pair_no WHERE a.p AND NOT b.p""")
def f4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.preference_pairs(order_interactions(spark, sf_dir), ORDER_ROLES)


@query("f5_listwise_groups", f"""
WITH {X1}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, {_TIE}) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM x1)
SELECT user_id, {_KEY}, (rn - 1) // 10 AS list_no, (rn - 1) % 10 + 1 AS list_pos FROM r WHERE ((rn - 1) // 10 + 1) * 10 <= n""")
def f5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.listwise_groups(order_interactions(spark, sf_dir), ORDER_ROLES).select("user_id", *ROW_KEY, "list_no", "list_pos")


@query("f6_temporal_split", f"""
WITH {X2}, q AS (SELECT quantile_cont(epoch_us(ts)::DOUBLE, 0.7) AS a, quantile_cont(epoch_us(ts)::DOUBLE, 0.85) AS b FROM x2)
SELECT event_id, CASE WHEN epoch_us(ts) <= a THEN 'train' WHEN epoch_us(ts) <= b THEN 'validation' ELSE 'test' END AS split FROM x2, q""")
def f6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.temporal_split(event_interactions(spark, sf_dir), EVENT_ROLES).select("event_id", "split")


def _draw_sql(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 8))::BIGINT"


@query("f7_negative_samples", f"""
WITH {X2}, p AS (SELECT DISTINCT user_id, item_id FROM x2),
  i AS MATERIALIZED (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS number FROM (SELECT DISTINCT item_id FROM x2)),
  s AS MATERIALIZED (SELECT user_id, number, number - row_number() OVER (PARTITION BY user_id ORDER BY number) + 1 AS key FROM p JOIN i USING (item_id)),
  h AS (SELECT user_id, count(*) AS n FROM s GROUP BY 1),
  d AS MATERIALIZED (SELECT p.user_id, p.item_id, draw, {_draw_sql("p.user_id || '|' || p.item_id || '|n' || draw")} % ((SELECT count(*) FROM i) - n) AS r
    FROM p JOIN h USING (user_id) CROSS JOIN (SELECT unnest(range(1, 5)) AS draw) WHERE n < (SELECT count(*) FROM i)),
  k AS (SELECT d.user_id, d.item_id, draw, r, count(s.key) AS k FROM d LEFT JOIN s ON s.user_id = d.user_id AND s.key <= d.r GROUP BY ALL)
SELECT user_id, k.item_id, draw, i.item_id AS negative_item FROM k JOIN i ON i.number = r + k.k""")
def f7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.negative_samples(event_interactions(spark, sf_dir), EVENT_ROLES, ratio=4).withColumn(
        "draw", F.col("draw").cast("long"))


@query("f8_positive_pairs", f"""
WITH {X1}, u AS (SELECT user_id, avg(signal) AS um FROM x1 GROUP BY 1), i AS (SELECT item_id, avg(signal) AS im FROM x1 GROUP BY 1)
SELECT {_KEY}, user_id, round(um, 6) AS user_signal_mean, round(im, 6) AS item_signal_mean FROM x1 JOIN u USING (user_id) JOIN i USING (item_id)""")
def f8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_interactions(spark, sf_dir)
    pairs = prep.positive_pairs(
        rows, ORDER_ROLES, features.user_features(rows, ORDER_ROLES), features.item_features(rows, ORDER_ROLES))
    return pairs.select(*ROW_KEY, "user_id", rounded("user_signal_mean").alias("user_signal_mean"),
                        rounded("item_signal_mean").alias("item_signal_mean"))
