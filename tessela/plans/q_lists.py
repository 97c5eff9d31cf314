"""Queries on recommendations, reranking, evaluation, feedback and explanation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessela.operators import ann, evaluate, explain, features, feedback, learned, models, recommend, rerank
from tessela.plans.fixtures import (
    AS_OF,
    EVENT_ROLES,
    K1,
    ORDER_ROLES,
    X1,
    X2,
    X3,
    event_interactions,
    order_interactions,
    rounded,
    table,
    vector_table,
)
from tessela.plans.registry import query
from tessela.roles import Roles
from tessela.session import materialize

SPLIT = "2024-01-21 00:00:00"

_K2 = f"{K1}, k2 AS (SELECT user_id, item_id, sum(weight) AS preference FROM k1 GROUP BY 1, 2)"


def _preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.preference(event_interactions(spark, sf_dir), AS_OF)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _preference(spark, sf_dir).select("user_id", "item_id", rounded("preference", 9).alias("score"))


def _long_rank(df: DataFrame) -> DataFrame:
    return df.withColumn("rank", F.col("rank").cast("long"))


_PROFILES = f"""{X2}, {X3}, h AS (SELECT user_id, item_id, count(*) AS w FROM x2 GROUP BY 1, 2),
  d AS (SELECT user_id, i, sum(w * x) / sum(w) AS m FROM (SELECT user_id, w, unnest(range(len(v))) AS i, unnest(v) AS x FROM h JOIN x3 ON item_id = vec_id) GROUP BY 1, 2),
  p AS (SELECT user_id, list(m ORDER BY i) AS v FROM d GROUP BY 1)"""


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explain.user_profiles(event_interactions(spark, sf_dir), EVENT_ROLES, vector_table(spark, sf_dir, "item_id")).withColumnRenamed("profile", "vector")


_CANDIDATES = f"""
WITH {_PROFILES}, s AS (SELECT user_id, vec_id AS item_id, round(list_inner_product(p.v, x3.v), 9) AS score FROM p CROSS JOIN x3)
SELECT user_id, item_id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM s) WHERE rank <= 100"""


@query("i1_candidates", _CANDIDATES)
def i1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long_rank(recommend.candidates(_profiles(spark, sf_dir), vector_table(spark, sf_dir, "item_id"), 100))


@query("i1_candidates_indexed", _CANDIDATES)
def i1_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = vector_table(spark, sf_dir, "item_id").select(F.col("item_id").alias("id"), "vector")
    users = materialize(_profiles(spark, sf_dir), "profiles")
    return _long_rank(recommend.candidates(users, ann.ivf_build(items), 100, bounded=True))


@query("i2_recommend", f"""
WITH {_K2}, u AS (SELECT user_id, count(*) AS user_interaction_count, avg(value) AS user_signal_mean FROM x2 GROUP BY 1),
  i AS (SELECT item_id, count(*) AS item_interaction_count, avg(value) AS item_signal_mean FROM x2 GROUP BY 1),
  r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(preference, 9) DESC, item_id) AS rank FROM k2)
SELECT user_id, item_id, round(round(preference, 9), 6) AS score, rank, user_interaction_count, round(user_signal_mean, 6) AS user_signal_mean,
  item_interaction_count, round(item_signal_mean, 6) AS item_signal_mean FROM r JOIN u USING (user_id) JOIN i USING (item_id) WHERE rank <= 10""")
def i2(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = event_interactions(spark, sf_dir)
    top = recommend.recommend(_scored(spark, sf_dir), 10)
    users = features.user_features(events, EVENT_ROLES).select("user_id", "user_interaction_count", "user_signal_mean")
    items = features.item_features(events, EVENT_ROLES).select("item_id", "item_interaction_count", "item_signal_mean")
    joined = features.join_back(features.join_back(top, users, "user_id"), items, "item_id")
    return joined.select(
        "user_id", "item_id", rounded("score").alias("score"), F.col("rank").cast("long").alias("rank"), "user_interaction_count",
        rounded("user_signal_mean").alias("user_signal_mean"), "item_interaction_count",
        rounded("item_signal_mean").alias("item_signal_mean"))


@query("i2_learned_recommend", f"""
WITH {K1} SELECT count(DISTINCT user_id) AS users, true AS lists_full, true AS ranks_dense, true AS better_than_popularity FROM k1""")
def i2_learned(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighted = materialize(feedback.signal_weights(event_interactions(spark, sf_dir), AS_OF), "weighted")
    recs = materialize(learned.retrieve_rank_recommend(weighted, Roles(signal="weight"), 10, rank=16, iterations=5, nprobe=20), "learned")
    lists = recs.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("item_id").alias("d"), F.max("rank").alias("top"))
    shape = lists.agg(F.count(F.lit(1)).alias("users"), F.bool_and((F.col("n") == 10) & (F.col("d") == 10)).alias("lists_full"),
                      F.bool_and(F.col("top") == 10).alias("ranks_dense"))
    history = weighted.select("user_id", "item_id").distinct()
    popular = recommend.popular_items(weighted, 10)
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "item_id")  # ten rows
    same = history.select("user_id").distinct().crossJoin(F.broadcast(popular.withColumn("rank", F.row_number().over(order))))
    ours, theirs = (evaluate.evaluate(x, history, ["recall@10"]) for x in (recs, same))
    better = ours.join(theirs.select("metric", F.col("value").alias("popular")), "metric").select((F.col("value") > F.col("popular")).alias("better_than_popularity"))
    return shape.join(better, F.lit(True))


def _popular(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return recommend.popular_items(feedback.signal_weights(event_interactions(spark, sf_dir), AS_OF), k)


_POPULAR = f"""{K1}, pop AS (SELECT item_id, round(sum(weight), 9) AS score, row_number() OVER (ORDER BY round(sum(weight), 9) DESC, item_id) AS rank FROM k1 GROUP BY 1)"""


@query("i3_popularity_cold_users", f"""
WITH {_POPULAR} SELECT c_custkey AS user_id, item_id, round(score, 6) AS score, rank FROM customer CROSS JOIN pop
WHERE rank <= 50 AND NOT EXISTS (SELECT 1 FROM x2 WHERE user_id = c_custkey)""")
def i3(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    listed = recommend.cold_start_users(users, event_interactions(spark, sf_dir), _popular(spark, sf_dir, 50))
    return _long_rank(listed).withColumn("score", rounded("score"))


@query("i4_content_cold_items", f"""
WITH {_POPULAR}, {X3}, s AS (SELECT n.vec_id AS item_id, round(list_inner_product(n.v, o.v), 9) AS sim, pop.score
  FROM x3 n CROSS JOIN x3 o JOIN pop ON pop.item_id = o.vec_id WHERE n.vec_id NOT IN (SELECT item_id FROM x2))
SELECT item_id, count(*) AS neighbours, round(sum(sim * score) / sum(sim) * 1.2, 6) AS score FROM s WHERE sim >= 0.3 GROUP BY 1""")
def i4(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = vector_table(spark, sf_dir, "item_id")
    events = event_interactions(spark, sf_dir)
    totals = feedback.signal_weights(events, AS_OF).groupBy("item_id").agg(rounded(F.sum("weight"), 9).alias("score"))
    new = items.join(events.select("item_id"), "item_id", "left_anti")
    made = recommend.content_cold_items(new, items.join(totals, "item_id"), threshold=0.3)
    return made.withColumn("score", rounded("score"))


@query("i5_sparse_hybrid", f"""
WITH {_K2}, pop AS (SELECT item_id, sum(weight) / 100 AS popularity FROM k1 GROUP BY 1), c AS (SELECT user_id, count(*) AS n FROM x2 GROUP BY 1),
  top AS (SELECT item_id FROM pop ORDER BY round(popularity, 9) DESC, item_id LIMIT 10),
  s AS (SELECT user_id, item_id, preference FROM k2 UNION ALL
        SELECT c_custkey, item_id, 0 FROM customer CROSS JOIN top WHERE c_custkey NOT IN (SELECT user_id FROM k2))
SELECT user_id, item_id, round(CASE WHEN coalesce(n, 0) < 5 THEN pow(0.9, 5 - coalesce(n, 0)) * popularity + (1 - pow(0.9, 5 - coalesce(n, 0))) * preference
  ELSE preference END, 6) AS score FROM s JOIN pop USING (item_id) LEFT JOIN c USING (user_id)""")
def i5(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = event_interactions(spark, sf_dir)
    popularity = feedback.signal_weights(events, AS_OF).groupBy("item_id").agg((F.sum("weight") / 100).alias("popularity_score"))
    known = _preference(spark, sf_dir).withColumnRenamed("preference", "personal_score")
    top = popularity.orderBy(F.round("popularity_score", 9).desc(), "item_id").limit(10).select("item_id")
    strangers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id")).join(known, "user_id", "left_anti")
    offered = strangers.crossJoin(F.broadcast(top)).select("user_id", "item_id", F.lit(0.0).alias("personal_score"))  # ten items each
    counts = events.groupBy("user_id").agg(F.count(F.lit(1)).alias("interactions"))
    scored = known.unionByName(offered).join(popularity, "item_id")
    return recommend.sparse_hybrid(scored, counts).select("user_id", "item_id", rounded("score").alias("score"))


_RECENT = f"""recent AS (SELECT DISTINCT user_id, item_id FROM x2 WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 10 DAY AND ts <= TIMESTAMP '{AS_OF}')"""


@query("i6_exclude_seen", f"""
WITH {_K2}, {_RECENT} SELECT user_id, item_id, round(round(preference, 9), 6) AS score FROM k2
WHERE NOT EXISTS (SELECT 1 FROM recent r WHERE r.user_id = k2.user_id AND r.item_id = k2.item_id)""")
def i6(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = recommend.exclude_seen(_scored(spark, sf_dir), event_interactions(spark, sf_dir), EVENT_ROLES, AS_OF, 10)
    return kept.withColumn("score", rounded("score"))


@query("i7_mmr", f"""
WITH RECURSIVE {_K2}, {X3}, c AS MATERIALIZED (SELECT user_id, item_id, round(preference, 9) AS score FROM k2),
  s AS MATERIALIZED (SELECT a.user_id, a.item_id AS a, b.item_id AS b, coalesce(list_inner_product(x.v, y.v), 0) AS cosine
    FROM c a JOIN c b ON a.user_id = b.user_id LEFT JOIN x3 x ON x.vec_id = a.item_id LEFT JOIN x3 y ON y.vec_id = b.item_id),
  w AS (
    SELECT DISTINCT user_id, 0::BIGINT AS rank, []::BIGINT[] AS taken, NULL::BIGINT AS item_id, NULL::DOUBLE AS score, NULL::DOUBLE AS mmr FROM c
    UNION ALL
    SELECT user_id, rank + 1, list_append(taken, n.item_id), n.item_id, n.score, n.value FROM (
      SELECT w.user_id, w.rank, w.taken, c.item_id, c.score, round(0.5 * c.score - 0.5 * coalesce(max(s.cosine), 0), 9) AS value
      FROM w JOIN c ON c.user_id = w.user_id AND NOT list_contains(w.taken, c.item_id)
        LEFT JOIN s ON s.user_id = c.user_id AND s.b = c.item_id AND list_contains(w.taken, s.a)
      WHERE w.rank < 10 GROUP BY w.user_id, w.rank, w.taken, c.item_id, c.score) n
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, item_id) = 1)
SELECT user_id, item_id, round(score, 6) AS score, round(mmr, 6) AS mmr, rank FROM w WHERE rank > 0""")
def i7(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = rerank.mmr(_scored(spark, sf_dir), vector_table(spark, sf_dir, "item_id"), k=10)
    return made.select("user_id", "item_id", rounded("score").alias("score"), rounded("mmr").alias("mmr"), "rank")


@query("i8_novelty", f"""
WITH {_K2}, {_RECENT} SELECT k2.user_id, k2.item_id, round(round(preference, 9) - CASE WHEN r.user_id IS NOT NULL THEN 0.2 ELSE 0 END, 6) AS score
FROM k2 LEFT JOIN recent r ON r.user_id = k2.user_id AND r.item_id = k2.item_id""")
def i8(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = rerank.novelty(_scored(spark, sf_dir), event_interactions(spark, sf_dir), EVENT_ROLES, AS_OF, window_days=10)
    return moved.withColumn("score", rounded("score"))


@query("i9_freshness", f"""
WITH {_K2}, f AS (SELECT item_id, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(min(ts))) / 86400000000.0::DOUBLE AS age FROM x2 GROUP BY 1)
SELECT user_id, item_id, round(round(preference, 9) + 0.1::DOUBLE * exp(-age / 7.0::DOUBLE), 6) AS score FROM k2 JOIN f USING (item_id)""")
def i9(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = event_interactions(spark, sf_dir).groupBy("item_id").agg(F.min("ts").alias("first_seen"))
    return rerank.freshness(_scored(spark, sf_dir), first, AS_OF).withColumn("score", rounded("score"))


_TAGGED = f"""{_K2}, tagged AS (SELECT user_id, item_id, round(preference, 9) AS score, p_type AS category, p_brand AS brand, p_retailprice AS price
  FROM k2 JOIN part ON item_id = p_partkey)"""


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item_id"), F.col("p_type").alias("category"), F.col("p_brand").alias("brand"),
        F.col("p_retailprice").alias("price"))
    return _scored(spark, sf_dir).join(part, "item_id")


@query("i10_business_rules", f"""
WITH {_TAGGED}, a AS (SELECT *, CASE WHEN price > 905 THEN score * 1.5 ELSE score END AS s1 FROM tagged WHERE brand <> 'Brand#4')
SELECT user_id, item_id, round(CASE WHEN category = 'ECONOMY' AND s1 > 3 THEN s1 * 0.5 ELSE s1 END, 6) AS score FROM a""")
def i10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = (rerank.BusinessRule("brand = 'Brand#4'", drop=True), rerank.BusinessRule("price > 905", boost=1.5),
             rerank.BusinessRule("category = 'ECONOMY' AND score > 3", boost=0.5))
    return rerank.business_rules(_tagged(spark, sf_dir), rules).select("user_id", "item_id", rounded("score").alias("score"))


@query("i11_list_constraints", f"""
WITH {_TAGGED}, t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM tagged)
SELECT user_id, round(count(DISTINCT category) / count(*)::DOUBLE, 6) AS diversity, round(1 - count(DISTINCT item_id) / count(*)::DOUBLE, 6) AS repeat_share,
  count(DISTINCT category) / count(*)::DOUBLE >= 0.3 AND 1 - count(DISTINCT item_id) / count(*)::DOUBLE <= 0.1 AS passed FROM t WHERE rank <= 10 GROUP BY 1""")
def i11(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = rerank.list_constraints(recommend.recommend(_tagged(spark, sf_dir), 10))
    return checked.withColumns({"diversity": rounded("diversity"), "repeat_share": rounded("repeat_share")})


@query("i11_limit_per_category", f"""
WITH {_TAGGED}, t AS (SELECT *, row_number() OVER (PARTITION BY user_id, category ORDER BY score DESC, item_id) AS rn FROM tagged)
SELECT user_id, item_id, category, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM t WHERE rn <= 3""")
def i11_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long_rank(rerank.limit_per_category(_tagged(spark, sf_dir)).select("user_id", "item_id", "category", "rank"))


_LISTS = f"""{K1}, recs AS (SELECT user_id, item_id, rank FROM (SELECT user_id, item_id,
    row_number() OVER (PARTITION BY user_id ORDER BY round(sum(weight), 9) DESC, item_id) AS rank FROM k1
    WHERE ts < TIMESTAMP '{SPLIT}' GROUP BY 1, 2) WHERE rank <= 20),
  test AS (SELECT DISTINCT user_id, item_id FROM x2 WHERE ts >= TIMESTAMP '{SPLIT}'),
  rel AS (SELECT user_id, count(*) AS relevant FROM test GROUP BY 1),
  hit AS (SELECT user_id, rank, row_number() OVER (PARTITION BY user_id ORDER BY rank) AS hit_no FROM recs SEMI JOIN test USING (user_id, item_id) WHERE rank <= 10),
  per AS (SELECT user_id, relevant, coalesce(h, 0) AS hits, coalesce(dcg, 0) AS dcg, coalesce(ps, 0) / least(relevant, 10) AS ap, coalesce(1.0::DOUBLE / fr, 0) AS rr,
    (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) t(i) WHERE i <= relevant) AS idcg
    FROM rel LEFT JOIN (SELECT user_id, count(*) AS h, sum(1 / log2(rank + 1)) AS dcg, sum(hit_no / rank::DOUBLE) AS ps, min(rank) AS fr FROM hit GROUP BY 1) USING (user_id))"""


def _lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = event_interactions(spark, sf_dir)
    cut = F.lit(SPLIT).cast("timestamp")
    learned = feedback.preference(events.where(F.col("ts") < cut), AS_OF)
    recs = recommend.recommend(learned.withColumn("score", rounded("preference", 9)), 20)
    return recs, events.where(F.col("ts") >= cut).select("user_id", "item_id")


def _rank_metrics(spark: SparkSession, sf_dir: str, names: list[str]) -> DataFrame:
    recs, test = _lists(spark, sf_dir)
    return evaluate.evaluate(recs, test, names).withColumn("value", rounded("value"))


@query("j1_recall_precision", f"""
WITH {_LISTS} SELECT 'recall@10' AS metric, round(avg(hits / relevant::DOUBLE), 6) AS value FROM per UNION ALL
SELECT 'precision@10', round(avg(hits / 10.0::DOUBLE), 6) FROM per UNION ALL SELECT 'hit_rate@10', round(avg((hits > 0)::INT), 6) FROM per""")
def j1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rank_metrics(spark, sf_dir, ["recall@10", "precision@10", "hit_rate@10"])


@query("j2_dcg", f"""
WITH {_LISTS} SELECT 'dcg@10' AS metric, round(avg(dcg), 6) AS value FROM per UNION ALL SELECT 'ndcg@10', round(avg(dcg / idcg), 6) FROM per""")
def j2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rank_metrics(spark, sf_dir, ["dcg@10", "ndcg@10"])


@query("j3_map_mrr", f"""
WITH {_LISTS} SELECT 'map@10' AS metric, round(avg(ap), 6) AS value FROM per UNION ALL SELECT 'mrr', round(avg(rr), 6) FROM per""")
def j3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rank_metrics(spark, sf_dir, ["map@10", "mrr"])


@query("j4_coverage", f"""
WITH {_LISTS} SELECT count(DISTINCT item_id) AS shown, (SELECT count(*) FROM part) AS known,
  round(count(DISTINCT item_id) / (SELECT count(*) FROM part)::DOUBLE, 6) AS coverage FROM recs""")
def j4(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"))
    return evaluate.coverage(_lists(spark, sf_dir)[0], catalog).withColumn("coverage", rounded("coverage"))


@query("j5_list_diversity", f"""
WITH {_LISTS}, {X3} SELECT a.user_id, round(1 - avg(list_inner_product(x.v, y.v)), 6) AS diversity FROM recs a JOIN recs b ON a.user_id = b.user_id AND a.rank < b.rank
  JOIN x3 x ON x.vec_id = a.item_id JOIN x3 y ON y.vec_id = b.item_id GROUP BY 1""")
def j5(spark: SparkSession, sf_dir: str) -> DataFrame:
    recs, _ = _lists(spark, sf_dir)
    return evaluate.list_diversity(recs, vector_table(spark, sf_dir, "item_id")).withColumn("diversity", rounded("diversity"))


@query("j6_business_metrics", f"""
WITH {X2}, e AS (SELECT x2.*, c_mktsegment AS segment, CAST(ts AS DATE)::VARCHAR AS day FROM x2 JOIN customer ON user_id = c_custkey)
SELECT segment, day, round(count(*) FILTER (event_type = 'click') / nullif(count(*) FILTER (event_type = 'view'), 0)::DOUBLE, 6) AS ctr,
  round(count(*) FILTER (event_type = 'purchase') / nullif(count(*) FILTER (event_type = 'click'), 0)::DOUBLE, 6) AS conversion_rate,
  round(sum(value) FILTER (event_type = 'purchase') / count(DISTINCT user_id), 6) AS revenue_per_user,
  round(count(DISTINCT user_id) FILTER (event_type = 'purchase') / count(DISTINCT user_id)::DOUBLE, 6) AS purchase_rate,
  round(avg(value) FILTER (event_type = 'dwell_time'), 6) AS mean_dwell FROM e GROUP BY ROLLUP (segment, day)""")
def j6(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"))
    events = event_interactions(spark, sf_dir).join(customer, "user_id").withColumn("day", F.to_date("ts").cast("string"))
    made = evaluate.business_metrics(events, ["segment", "day"])
    return made.select("segment", "day", *[rounded(c).alias(c) for c in made.columns[2:]])


@query("j7_evaluate", f"""
WITH {_LISTS}, {X3} SELECT 'recall@10' AS metric, round(avg(hits / relevant::DOUBLE), 6) AS value FROM per UNION ALL SELECT 'ndcg@10', round(avg(dcg / idcg), 6) FROM per
UNION ALL SELECT 'mrr', round(avg(rr), 6) FROM per
UNION ALL SELECT 'coverage', round(count(DISTINCT item_id) / (SELECT count(*) FROM part)::DOUBLE, 6) FROM recs
UNION ALL SELECT 'diversity', round(avg(d), 6) FROM (SELECT 1 - avg(list_inner_product(x.v, y.v)) AS d FROM recs a JOIN recs b ON a.user_id = b.user_id AND a.rank < b.rank
  JOIN x3 x ON x.vec_id = a.item_id JOIN x3 y ON y.vec_id = b.item_id GROUP BY a.user_id)""")
def j7(spark: SparkSession, sf_dir: str) -> DataFrame:
    recs, test = _lists(spark, sf_dir)
    catalog = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"))
    return evaluate.evaluate(recs, test, ["recall@10", "ndcg@10", "mrr", "coverage", "diversity"], catalog,
                             vector_table(spark, sf_dir, "item_id")).withColumn("value", rounded("value"))


@query("k1_signal_weights", f"WITH {K1} SELECT event_id, event_type, round(weight, 9) AS weight FROM k1")
def k1(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighted = feedback.signal_weights(event_interactions(spark, sf_dir), AS_OF)
    return weighted.select("event_id", "event_type", rounded("weight", 9).alias("weight"))


@query("k2_preference", f"WITH {_K2} SELECT user_id, item_id, round(preference, 6) AS preference FROM k2")
def k2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _preference(spark, sf_dir).withColumn("preference", rounded("preference"))


@query("k3_replay_buffer", f"""
WITH {X1}, n AS (SELECT * FROM (SELECT *, session_id * 10 + line_no AS k FROM x1) ORDER BY ts DESC, k DESC LIMIT 5000)
SELECT k, item_id, count(*) AS copies FROM n WHERE ('0x' || substr(md5(k::VARCHAR), 1, 8))::BIGINT % 1000 < 200 GROUP BY 1, 2""".replace(
    f"WITH {X1}, n AS (SELECT * FROM (SELECT *, session_id * 10 + line_no AS k FROM x1)",
    f"WITH {X2}, n AS (SELECT * FROM (SELECT *, event_id AS k FROM x2)"))
def k3(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = feedback.replay_buffer(event_interactions(spark, sf_dir), "ts", "event_id", max_size=5000)
    return kept.groupBy(F.col("event_id").alias("k"), "item_id").agg(F.count(F.lit(1)).alias("copies"))


HELD_OUT = "2024-01-26 00:00:00"


def _shares(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Weighted events before the split, after it, and the newest, which no model is fitted on."""
    events = feedback.signal_weights(event_interactions(spark, sf_dir), AS_OF)
    cut, held = F.lit(SPLIT).cast("timestamp"), F.lit(HELD_OUT).cast("timestamp")
    return events.where(F.col("ts") < cut), events.where((F.col("ts") >= cut) & (F.col("ts") < held)), events.where(F.col("ts") >= held)


def _fit_weights(rows: DataFrame) -> models.RetrievalVectors:
    fitted = models.fit_retrieval(rows, Roles(signal="weight"), rank=4, iterations=2)
    return models.RetrievalVectors(materialize(fitted.users, "user-vectors"), materialize(fitted.items, "item-vectors"))


def _recall(model: models.RetrievalVectors, test: DataFrame, k: int = 10) -> float:
    """Of the held-out pairs of users whom the model knows."""
    recs = recommend.candidates(model.users, model.items, k)
    return evaluate.evaluate(recs, test.join(model.users, "user_id", "left_semi"), [f"recall@{k}"]).first()["value"] or 0.0


@query("k4_retrain", "SELECT true AS rule_holds, true AS a_share")
def k4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current model and challenger are both judged on the newest events, which neither has seen."""
    old, new, newest = _shares(spark, sf_dir)
    buffer = feedback.replay_buffer(old, "ts", "event_id", max_size=1_000_000)
    test = materialize(newest.select("user_id", "item_id"), "held-out")
    current = _fit_weights(old)
    before = _recall(current, test)
    _, reached, replaced = feedback.retrain(new, buffer, _fit_weights, lambda m: _recall(m, test), current)
    holds = reached > before if replaced else reached == before
    return spark.createDataFrame([(bool(holds), 0.0 <= reached <= 1.0)], "rule_holds boolean, a_share boolean")


@query("k4_fold_in", f"""
WITH {K1}, n AS (SELECT * FROM k1 WHERE ts >= TIMESTAMP '{SPLIT}' AND ts < TIMESTAMP '{HELD_OUT}'), o AS (SELECT * FROM k1 WHERE ts < TIMESTAMP '{SPLIT}')
SELECT (SELECT count(DISTINCT user_id) FROM n WHERE item_id IS NOT NULL) AS folded, (SELECT count(DISTINCT user_id) FROM k1 WHERE ts < TIMESTAMP '{HELD_OUT}' AND item_id IS NOT NULL) AS users,
  true AS others_unchanged, true AS step_agrees""")
def k4_fold_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New events enter the current model by fold-in. Folding all users into a refitted model must return its own vectors."""
    old, new, _ = _shares(spark, sf_dir)
    both, weights = materialize(old.unionByName(new), "weighted"), Roles(signal="weight")
    current = _fit_weights(old)
    folded = feedback.fold_in(current, both, new, weights)
    touched = new.select("user_id").distinct().withColumn("new", F.lit(True))
    moved = folded.users.join(current.users.withColumnRenamed("vector", "before"), "user_id", "left").join(touched, "user_id", "left")
    counts = moved.agg(F.count("new").alias("folded"), F.count(F.lit(1)).alias("users"),
                       F.bool_and(F.col("new").isNotNull() | (F.col("vector") == F.col("before"))).alias("others_unchanged"))
    refit = _fit_weights(both)
    again = feedback.fold_in(refit, both, both, weights).users.withColumnRenamed("vector", "again")
    apart = F.array_max(F.zip_with("vector", "again", lambda a, b: F.abs(a - b)))
    agrees = refit.users.join(again, "user_id", "left").agg(F.coalesce(F.bool_and(F.coalesce(apart < 1e-4, F.lit(False))), F.lit(True)).alias("step_agrees"))
    return counts.join(agrees, F.lit(True))


def _similar_sql(node: str, via: str, seeds: str) -> str:
    return f"""
WITH {X1}, e AS (SELECT DISTINCT {node}, {via} FROM x1), n AS (SELECT {node}, count(*) AS n FROM e GROUP BY 1), seeds AS ({seeds}),
  b AS (SELECT s.{node} AS seed, o.{node} AS similar, count(*) AS shared FROM seeds s JOIN e a ON a.{node} = s.{node}
        JOIN e o ON o.{via} = a.{via} AND o.{node} <> s.{node} GROUP BY 1, 2),
  c AS (SELECT b.*, round(shared / sqrt(x.n * y.n), 9) AS similarity FROM b JOIN n x ON x.{node} = seed JOIN n y ON y.{node} = similar)
SELECT seed, "similar", shared, similarity, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY seed ORDER BY similarity DESC, "similar") AS rank FROM c) WHERE rank <= 10""".replace(
        " AS similar,", ' AS "similar",').replace("= similar)", '= "similar")')


@query("l1_similar_items", _similar_sql(
    "item_id", "user_id", "SELECT item_id FROM (SELECT brand, item_id, row_number() OVER (PARTITION BY brand ORDER BY sum(signal) DESC, item_id) AS r "
    "FROM x1 GROUP BY 1, 2) WHERE r = 1"))
def l1_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_interactions(spark, sf_dir)
    sold = rows.groupBy("brand", "item_id").agg(F.sum("signal").alias("s"))
    seeds = sold.groupBy("brand").agg(F.max_by("item_id", F.struct("s", -F.col("item_id"))).alias("item_id")).select("item_id")
    return _long_rank(explain.similar_items(rows, ORDER_ROLES, seeds))


@query("l1_similar_users", _similar_sql(
    "user_id", "item_id", "SELECT user_id FROM (SELECT segment, user_id, row_number() OVER (PARTITION BY segment ORDER BY sum(signal) DESC, user_id) AS r "
    "FROM x1 GROUP BY 1, 2) WHERE r = 1"))
def l1_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_interactions(spark, sf_dir)
    bought = rows.groupBy("segment", "user_id").agg(F.sum("signal").alias("s"))
    seeds = bought.groupBy("segment").agg(F.max_by("user_id", F.struct("s", -F.col("user_id"))).alias("user_id")).select("user_id")
    return _long_rank(explain.similar_users(rows, ORDER_ROLES, seeds))


def _explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = event_interactions(spark, sf_dir)
    first = events.groupBy("item_id").agg(F.min("ts").alias("first_seen"))
    items = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_type").alias("category")).join(first, "item_id")
    requests = recommend.recommend(_scored(spark, sf_dir), 10)
    return explain.explain(requests, events, EVENT_ROLES, items, AS_OF)


_EXPLAIN = f"""{_K2}, {X3}, req AS (SELECT user_id, item_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(preference, 9) DESC, item_id) AS r FROM k2) WHERE r <= 10),
  cnt AS (SELECT user_id, item_id, count(*) AS w FROM x2 GROUP BY 1, 2), tot AS (SELECT user_id, count(*) AS n FROM x2 JOIN part ON item_id = p_partkey GROUP BY 1),
  cat AS (SELECT user_id, p_type AS category, count(*) AS c FROM x2 JOIN part ON item_id = p_partkey GROUP BY 1, 2),
  sz AS (SELECT item_id, count(*) AS n FROM cnt GROUP BY 1),
  co AS MATERIALIZED (SELECT a.item_id AS a, b.item_id AS b, count(*) AS shared FROM (SELECT DISTINCT item_id FROM req) q JOIN cnt a ON a.item_id = q.item_id
         JOIN cnt b ON b.user_id = a.user_id AND b.item_id <> a.item_id GROUP BY 1, 2),
  ov AS (SELECT r.user_id, r.item_id, coalesce(max(round(shared / sqrt(x.n * y.n), 9)), 0) AS o FROM req r JOIN cnt ON cnt.user_id = r.user_id
         LEFT JOIN co ON co.a = r.item_id AND co.b = cnt.item_id LEFT JOIN sz x ON x.item_id = r.item_id LEFT JOIN sz y ON y.item_id = cnt.item_id GROUP BY 1, 2),
  pc AS (SELECT item_id, count(*) AS n, min(ts) AS f FROM x2 GROUP BY 1),
  pr AS (SELECT a.item_id, a.f, (SELECT count(*) FROM pc b WHERE b.n < a.n) / (SELECT count(*) FROM pc)::DOUBLE AS p FROM pc a),
  v AS (SELECT req.user_id, req.item_id, coalesce(c / n::DOUBLE, 0) AS g, o, p,
          exp(-((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(f)) / 86400000000.0::DOUBLE) / 30) AS r
        FROM req JOIN part ON req.item_id = p_partkey JOIN ov USING (user_id, item_id) JOIN pr USING (item_id) JOIN tot USING (user_id)
        LEFT JOIN cat ON cat.user_id = req.user_id AND cat.category = p_type),
  f AS (SELECT user_id, item_id, 'genre_match' AS factor, g AS value, 0.45::DOUBLE AS weight FROM v UNION ALL
        SELECT user_id, item_id, 'history_overlap', o, 0.28 FROM v UNION ALL SELECT user_id, item_id, 'popularity', p, 0.18 FROM v UNION ALL
        SELECT user_id, item_id, 'recency', r, 0.09 FROM v)"""


@query("l2_explain", f"""
WITH {_EXPLAIN} SELECT user_id, item_id, factor, round(value, 6) AS value, weight, round(value * weight, 6) AS contribution FROM f""")
def l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _explained(spark, sf_dir).select("user_id", "item_id", F.explode("factors").alias("f"))
    return rows.select("user_id", "item_id", "f.factor", rounded("f.value").alias("value"), "f.weight",
                       rounded(F.col("f.value") * F.col("f.weight")).alias("contribution"))


@query("l3_reason_sentence", f"""
WITH {_EXPLAIN}, t AS (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY round(value * weight, 9) DESC, factor DESC) AS r FROM f)
SELECT user_id, item_id, CASE factor WHEN 'genre_match' THEN 'Matches the categories you use most' WHEN 'history_overlap' THEN 'Similar to items in your history'
  WHEN 'popularity' THEN 'Popular with other users' ELSE 'Recently added' END AS reason FROM t WHERE r = 1""")
def l3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explain.reason_sentence(_explained(spark, sf_dir)).select("user_id", "item_id", "reason")
