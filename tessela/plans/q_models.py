"""Queries on models, losses and nearest neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessela.functions import vectors
from tessela.operators import ann, evaluate, losses, models, prep, probing, recommend
from tessela.operators.feedback import preference, signal_weights
from tessela.plans.fixtures import (
    AS_OF,
    K1,
    ORDER_ROLES,
    X1,
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


@query("g1_fit_retrieval", f"""
WITH {K1} SELECT count(DISTINCT user_id) AS users, count(DISTINCT item_id) AS items, true AS all_of_rank, true AS better_than_popularity FROM k1""")
def g1(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighted = signal_weights(event_interactions(spark, sf_dir), AS_OF)
    fitted = models.fit_retrieval(weighted, Roles(signal="weight"), rank=8, iterations=5)
    users, items = materialize(fitted.users, "users"), materialize(fitted.items, "items")
    history = weighted.select("user_id", "item_id").distinct()
    popular = weighted.groupBy("item_id").agg(F.sum("weight").alias("score")).orderBy(F.desc("score"), "item_id").limit(10)
    shown = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "item_id"))  # ten rows
    lists = history.select("user_id").distinct().crossJoin(F.broadcast(popular.withColumn("rank", shown)))
    ours, theirs = (evaluate.evaluate(x, history, ["recall@10"]) for x in (recommend.candidates(users, items, 10), lists))
    sizes = users.agg(F.count_distinct("user_id").alias("users"), F.bool_and(F.size("vector") == 8).alias("u")).join(
        items.agg(F.count_distinct("item_id").alias("items"), F.bool_and(F.size("vector") == 8).alias("i")), F.lit(True))
    better = ours.join(theirs.select("metric", F.col("value").alias("popular")), "metric").select(
        (F.col("value") > F.col("popular")).alias("better_than_popularity"))
    return sizes.join(better, F.lit(True)).select("users", "items", (F.col("u") & F.col("i")).alias("all_of_rank"), "better_than_popularity")


@query("g2_l2_normalize", f"""
WITH {X3} SELECT vec_id, round(list_sum(v), 6) AS total, round(list_inner_product(v, v), 6) AS squared FROM x3""")
def g2(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vector")
    return vector_table(spark, sf_dir, "vec_id").select(
        "vec_id", rounded(F.aggregate(v, F.lit(0.0), lambda a, x: a + x)).alias("total"),
        rounded(vectors.dot(v, v)).alias("squared"))


def _featured_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preference pairs with a feature array of the positive and of the negative item."""
    rows = order_interactions(spark, sf_dir)
    items = rows.groupBy("item_id").agg(
        F.array(F.avg("signal") / 25.0, F.count(F.lit(1)) / 30.0, F.max("price") / 1000.0).alias("f"))
    pairs = prep.preference_pairs(rows, ORDER_ROLES)
    positive = items.select(F.col("item_id").alias("pos_item"), F.col("f").alias("pos_features"))
    negative = items.select(F.col("item_id").alias("neg_item"), F.col("f").alias("neg_features"))
    return pairs.join(positive, "pos_item").join(negative, "neg_item")


def _ranker(spark: SparkSession, sf_dir: str, loss: str) -> DataFrame:
    pairs = materialize(_featured_pairs(spark, sf_dir), "pairs")
    model = models.fit_ranker(pairs, loss=loss, iterations=10)
    scored = pairs.select(
        models.linear_score(F.col("pos_features"), model).alias("pos_score"),
        models.linear_score(F.col("neg_features"), model).alias("neg_score"))
    made = losses.pairwise_losses(scored)
    worst = 0.6931471805599453 if loss == "bpr" else 1.0  # equal scores
    return made.select((F.col(f"{loss}_loss") < worst).alias("better_than_constant"), (F.col("pairwise_accuracy") > 0.5).alias("more_right_than_wrong"))


_RANKED = "SELECT true AS better_than_constant, true AS more_right_than_wrong"


@query("g3_fit_ranker_bpr", _RANKED)
def g3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranker(spark, sf_dir, "bpr")


@query("g4_fit_ranker_hinge", _RANKED)
def g4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranker(spark, sf_dir, "hinge")


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_interactions(spark, sf_dir).select(
        "user_id", "item_id", "brand", "segment", (F.col("price") / 1000).alias("price"), (F.col("signal") / 50).alias("signal"),
        (F.col("signal") > 25).cast("double").alias("label"))


def _against_rate(scored: DataFrame) -> DataFrame:
    """Is the cross-entropy below that of always predicting the share of positives, and the accuracy above one half."""
    rate = scored.agg(F.avg("label").alias("r"))
    entropy = -(F.col("r") * F.log("r") + (1 - F.col("r")) * F.log(1 - F.col("r")))
    return losses.binary_losses(scored).join(rate, F.lit(True)).select(
        (F.col("bce") < entropy).alias("better_than_constant"), (F.col("accuracy") > 0.5).alias("more_right_than_wrong"))


@query("g5_fit_ctr", _RANKED)
def g5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialize(_labelled(spark, sf_dir).withColumn("label", (F.col("price") > 0.95).cast("double")), "rows")
    model = models.fit_ctr(rows, ("price",), ("brand", "segment"), factor_size=4, iterations=60, hash_bits=12)
    return _against_rate(models.score(rows, model, "probability"))


@query("g6_fit_mlp", _RANKED)
def g6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialize(_labelled(spark, sf_dir), "rows")
    model = models.fit_mlp(rows, ("price", "signal"), hidden=(8, 4), iterations=40)
    return _against_rate(models.score(rows, model, "probability"))


_K2 = f"""{K1}, k2 AS (SELECT user_id, item_id, sum(weight) AS preference FROM k1 GROUP BY 1, 2)"""


@query("g7_rank_items", f"""
WITH {_K2} SELECT user_id, item_id, score, rank FROM (
  SELECT user_id, item_id, round(preference, 6) AS score,
    row_number() OVER (PARTITION BY user_id ORDER BY round(preference, 6) DESC, item_id) AS rank FROM k2) WHERE rank <= 5""")
def g7(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = preference(event_interactions(spark, sf_dir), AS_OF).select(
        "user_id", "item_id", rounded("preference").alias("score"))
    return models.rank_items(scored, "user_id", "item_id", 5).withColumn("rank", F.col("rank").cast("long"))


_TIE = "session_id, line_no, item_id, supplier_id, signal, amount"
_PAIRS = f"""{X1}, side AS (SELECT *, signal > (SELECT quantile_cont(signal, 0.5) FROM x1) AS p FROM x1),
  r AS (SELECT *, row_number() OVER (PARTITION BY user_id, p ORDER BY ts DESC, item_id, session_id, line_no, supplier_id, signal, amount) AS n FROM side),
  pairs AS (SELECT a.signal * a.price / 10000 - b.signal * b.price / 20000 AS gap FROM r a JOIN r b ON a.user_id = b.user_id AND a.n = b.n WHERE a.p AND NOT b.p)"""


@query("g8_pairwise_losses", f"""
WITH {_PAIRS} SELECT round(avg(ln(1 + exp(-abs(gap))) + greatest(-gap, 0)), 6) AS bpr_loss, round(avg(greatest(0, 1 - gap)), 6) AS hinge_loss,
  round(avg((gap > 0)::INT), 6) AS pairwise_accuracy FROM pairs""")
def g8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_interactions(spark, sf_dir)
    pairs = prep.preference_pairs(rows, ORDER_ROLES)
    price = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    positive = price.select(F.col("p_partkey").alias("pos_item"), F.col("p_retailprice").alias("pos_price"))
    negative = price.select(F.col("p_partkey").alias("neg_item"), F.col("p_retailprice").alias("neg_price"))
    scored = pairs.join(positive, "pos_item").join(negative, "neg_item").select(
        (F.col("pos_signal") * F.col("pos_price") / 10000).alias("pos_score"),
        (F.col("neg_signal") * F.col("neg_price") / 20000).alias("neg_score"))
    return losses.pairwise_losses(scored).select(
        *[rounded(c).alias(c) for c in ("bpr_loss", "hinge_loss", "pairwise_accuracy")])


_LISTS = f"""{X1}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, {_TIE}) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM x1),
  lists AS (SELECT user_id || ':' || ((rn - 1) // 10) AS list_id, signal / 10 AS score, (price > 1000)::INT::DOUBLE AS label FROM r
            WHERE ((rn - 1) // 10 + 1) * 10 <= n)"""


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.listwise_groups(order_interactions(spark, sf_dir), ORDER_ROLES).select(
        F.concat_ws(":", F.col("user_id").cast("string"), F.col("list_no").cast("string")).alias("list_id"),
        (F.col("signal") / 10).alias("score"), (F.col("price") > 1000).cast("double").alias("label"))


@query("g10_softmax_loss", f"""
WITH {_LISTS}, z AS (SELECT *, ln(sum(exp(score)) OVER (PARTITION BY list_id)) AS lse FROM lists)
SELECT list_id, round(sum(label * (lse - score)), 6) AS loss FROM z GROUP BY 1""")
def g10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return losses.softmax_loss(_lists(spark, sf_dir)).select("list_id", rounded("loss").alias("loss"))


@query("g10_softmax_mean", f"""
WITH {_LISTS}, z AS (SELECT *, ln(sum(exp(score)) OVER (PARTITION BY list_id)) AS lse FROM lists), l AS (SELECT sum(label * (lse - score)) AS loss FROM z GROUP BY list_id)
SELECT round(avg(loss), 6) AS loss FROM l""")
def g10_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return losses.mean_loss(losses.softmax_loss(_lists(spark, sf_dir))).select(rounded("loss").alias("loss"))


@query("g11_listnet_mean", f"""
WITH {_LISTS}, z AS (SELECT *, ln(sum(exp(score)) OVER (PARTITION BY list_id)) AS lse, exp(label) / sum(exp(label)) OVER (PARTITION BY list_id) AS t FROM lists),
  l AS (SELECT sum(t * (lse - score)) AS loss FROM z GROUP BY list_id)
SELECT round(avg(loss), 6) AS loss FROM l""")
def g11_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return losses.mean_loss(losses.listnet_loss(_lists(spark, sf_dir))).select(rounded("loss").alias("loss"))


@query("g11_listnet_loss", f"""
WITH {_LISTS}, z AS (SELECT *, ln(sum(exp(score)) OVER (PARTITION BY list_id)) AS lse, exp(label) / sum(exp(label)) OVER (PARTITION BY list_id) AS t FROM lists)
SELECT list_id, round(sum(t * (lse - score)), 6) AS loss FROM z GROUP BY 1""")
def g11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return losses.listnet_loss(_lists(spark, sf_dir)).select("list_id", rounded("loss").alias("loss"))


@query("g12_binary_losses", f"""
WITH {X1}, s AS (SELECT (price > 1000)::INT::DOUBLE AS y, signal / 50 AS p FROM x1)
SELECT round(avg(-(y * (CASE WHEN p > 0 THEN greatest(ln(p), -100) ELSE -100 END) + (1 - y) * (CASE WHEN p < 1 THEN greatest(ln(1 - p), -100) ELSE -100 END))), 6) AS bce,
  round(avg(((p > 0.5)::INT = y)::INT), 6) AS accuracy FROM s""")
def g12(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = order_interactions(spark, sf_dir).select(
        (F.col("price") > 1000).cast("double").alias("label"), (F.col("signal") / 50).alias("probability"))
    return losses.binary_losses(scored).select(rounded("bce").alias("bce"), rounded("accuracy").alias("accuracy"))


@query("g14_in_batch_metrics", f"""
WITH {X3}, b AS (SELECT vec_id // 50 AS batch, vec_id, v, list_transform(list_zip(v, list_reverse(v)), lambda x: x[1] + 0.3 * x[2]) AS w FROM x3),
  m AS (SELECT a.batch, a.vec_id AS r, c.vec_id AS k, list_inner_product(a.v, c.w) AS s FROM b a JOIN b c ON a.batch = c.batch),
  d AS (SELECT batch, r, s FROM m WHERE r = k),
  l AS (SELECT m.batch, m.r, ln(sum(exp(m.s / 0.07))) AS lse FROM m GROUP BY 1, 2),
  t AS (SELECT m.batch, m.k, ln(sum(exp(m.s / 0.07))) AS lse FROM m GROUP BY 1, 2),
  n AS (SELECT m.batch, m.r, count(*) FILTER (m.s > d.s) AS better FROM m JOIN d ON m.batch = d.batch AND m.r = d.r GROUP BY 1, 2)
SELECT d.batch, count(*) AS rows, round((avg(l.lse - d.s / 0.07) + avg(t.lse - d.s / 0.07)) / 2, 6) AS loss,
  round(avg((n.better < 10)::INT), 6) AS recall
FROM d JOIN l ON d.batch = l.batch AND d.r = l.r JOIN t ON d.batch = t.batch AND d.r = t.k JOIN n ON d.batch = n.batch AND d.r = n.r GROUP BY 1""")
def g14(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = F.zip_with("vector", F.reverse("vector"), lambda a, b: a + 0.3 * b)
    rows = vector_table(spark, sf_dir, "vec_id").select(
        F.floor(F.col("vec_id") / 50).cast("long").alias("batch"), "vec_id", F.col("vector").alias("u"), mixed.alias("v"))
    return losses.in_batch_metrics(rows, "batch", "vec_id", "u", "v").select(
        "batch", "rows", rounded("loss").alias("loss"), rounded("recall").alias("recall"))


@query("g16_tune_ranker", "SELECT 2 AS tried, true AS best_is_kept, true AS better_than_chance")
def g16(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = models.pair_differences(_featured_pairs(spark, sf_dir), "pos_features", "neg_features")
    rows = materialize(rows, "differences")
    tuned = models.tune_ranker(rows, (0.01, 0.1))
    results = [(float(p[tuned.bestModel.getParam("regParam")]), float(m))
               for p, m in zip(tuned.getEstimatorParamMaps(), tuned.validationMetrics)]
    kept, best = float(tuned.bestModel.getRegParam()), max(results, key=lambda r: r[1])
    return spark.createDataFrame([(len(results), kept == best[0], best[1] > 0.5)], "tried int, best_is_kept boolean, better_than_chance boolean")


@query("g16_early_stop", "SELECT true AS stops_in_time, true AS keeps_the_best, true AS no_iteration_twice, true AS better_than_chance")
def g16_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialize(models.pair_differences(_featured_pairs(spark, sf_dir), "pos_features", "neg_features"), "differences")
    ladder = (1, 2, 4, 8, 16, 32, 64)
    stopped = models.fit_until_flat(rows, ladder, patience=3, min_delta=1e-4)
    best = max(v for _, v in stopped.history)
    since = len(stopped.history) - 1 - [v for _, v in stopped.history].index(stopped.metric)
    return spark.createDataFrame(
        [(len(stopped.history) == len(ladder) or since <= 3, abs(stopped.metric - best) < 1e-4, stopped.iterations == stopped.history[-1][0], best > 0.5)],
        "stops_in_time boolean, keeps_the_best boolean, no_iteration_twice boolean, better_than_chance boolean")


@query("h1_features_to_vectors", """
WITH r AS (SELECT p_partkey AS id, [p_size::DOUBLE, p_retailprice, 0.0, 0.0]::DOUBLE[] AS v FROM part), n AS (SELECT *, sqrt(list_inner_product(v, v)) AS l FROM r)
SELECT id, round(v[1] / l, 6) AS first, round(v[2] / l, 6) AS second, len(v) AS dims FROM n""")
def h1(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), "p_name", "p_size", "p_retailprice")
    return ann.features_to_vectors(items, 4).select(
        "id", rounded(F.col("vector")[0]).alias("first"), rounded(F.col("vector")[1]).alias("second"),
        F.size("vector").cast("long").alias("dims"))


def _knn_sql(condition: str, k: int = 10) -> str:
    return f"""
WITH {X3}, s AS (SELECT q.vec_id AS query_id, b.vec_id AS id, round(list_inner_product(q.v, b.v), 9) AS score
  FROM x3 q JOIN x3 b ON q.vec_id <> b.vec_id WHERE {condition})
SELECT query_id, id, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= {k}"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return vector_table(spark, sf_dir, "query_id"), vector_table(spark, sf_dir, "id")


def _shown(found: DataFrame) -> DataFrame:
    return found.select("query_id", "id", rounded("score").alias("score"), F.col("rank").cast("long").alias("rank"))


@query("h2_knn_exact", _knn_sql("true"))
def h2(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, base = _sides(spark, sf_dir)
    return _shown(ann.knn_exact(queries, base, 10, exclude_self=True))


@query("h2_knn_blocked", _knn_sql("true"))
def h2_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, base = _sides(spark, sf_dir)
    return _shown(ann.knn_exact(queries, base, 10, exclude_self=True, block_rows=128))


def _index(base: DataFrame) -> ann.IvfIndex:
    return ann.ivf_build(base.select("id", "vector"))


def _checked(found: DataFrame, queries: DataFrame, base: DataFrame, least: float) -> DataFrame:
    """Is the recall at ten reached, is every score the exact one, how many queries were answered."""
    exact = materialize(ann.knn_exact(queries, base, 10, exclude_self=True), "exact")
    found = materialize(found.select("query_id", "id", "score"), "found")
    recall = ann.search_recall(exact, found).select((F.col("recall") >= least).alias("recall_reached"))
    pairs = found.join(queries.select("query_id", F.col("vector").alias("q")), "query_id").join(base.select("id", F.col("vector").alias("b")), "id")
    scores = pairs.agg(
        F.bool_and(F.abs(F.col("score") - vectors.dot(F.col("q"), F.col("b"))) < 1e-8).alias("scores_exact"),
        F.count_distinct("query_id").alias("queries"), F.bool_and(F.col("query_id") != F.col("id")).alias("never_itself"))
    return recall.join(scores, F.lit(True))


_CHECKED = "SELECT true AS recall_reached, true AS scores_exact, (SELECT count(*) FROM embeddings) AS queries, true AS never_itself"


@query("h3_ivf_build", """
SELECT count(*) AS vectors, count(DISTINCT vec_id) AS ids, round(sqrt(count(*)))::BIGINT AS cells, true AS no_cell_empty FROM embeddings""")
def h3(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _index(_sides(spark, sf_dir)[1])
    return index.table.agg(F.count(F.lit(1)).alias("vectors"), F.count_distinct("id").alias("ids"), F.lit(index.nlist).cast("long").alias("cells"),
                           (F.count_distinct("cell") == index.nlist).alias("no_cell_empty"))


@query("h4_ivf_search", _CHECKED)
def h4(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, base = _sides(spark, sf_dir)
    index = _index(base)
    return _checked(ann.ivf_search(queries, index, 10, nprobe=max(1, index.nlist // 2), exclude_self=True), queries, base, 0.7)


@query("h4_ivf_all_cells", _knn_sql("true"))
def h4_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, base = _sides(spark, sf_dir)
    index = _index(base)
    return _shown(ann.ivf_search(queries, index, 10, nprobe=index.nlist, exclude_self=True, block_rows=256))


@query("h4_ivf_bounded", _knn_sql("true"))
def h4_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, base = _sides(spark, sf_dir)
    return _shown(probing.ivf_search_bounded(queries, _index(base), 10, exclude_self=True).found)


@query("h5_pq_search", _CHECKED)
def h5(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, base = _sides(spark, sf_dir)
    index = ann.pq_build(base.select("id", "vector"), dim=64, m=8, nbits=4)
    found = ann.pq_search(queries, index, 10, nprobe=max(1, len(index.centroids) * 3 // 4), exclude_self=True, refine=base, factor=10)
    return _checked(found, queries, base, 0.7)


@query("h6_knn_lsh", f"SELECT *, true AS fewer_pairs FROM ({_CHECKED})")
def h6(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, base = _sides(spark, sf_dir)
    share = ann.candidate_share(*ann.lsh_cells(queries, base, 1.0, 8, 4, 7))
    checked = _checked(ann.knn_lsh(queries, base, 10, exclude_self=True), queries, base, 0.5)
    return checked.join(share.select((F.col("share") < 0.75).alias("fewer_pairs")), F.lit(True))


@query("h5_pq_rotated", f"SELECT *, true AS error_never_rises FROM ({_CHECKED})")
def h5_rotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, base = _sides(spark, sf_dir)
    index = ann.pq_build(base.select("id", "vector"), dim=64, m=16, nbits=4, rotation_rounds=3)
    found = ann.pq_search(queries, index, 10, nprobe=max(1, -(-len(index.centroids) * 19 // 20)), exclude_self=True, refine=base, factor=10)
    falls = all(b <= a + 1e-9 for a, b in zip(index.errors, index.errors[1:]))
    return _checked(found, queries, base, 0.9).withColumn("error_never_rises", F.lit(falls))


@query("h6_multiprobe", f"SELECT *, true AS fewer_pairs FROM ({_CHECKED})")
def h6_multiprobe(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, base = _sides(spark, sf_dir)
    hashes = ann.HashTables(64, tables=8, width=6)
    share = ann.multiprobe_share(queries, base, hashes, 10)
    checked = _checked(ann.knn_multiprobe(queries, base, hashes, 10, 10, exclude_self=True), queries, base, 0.9)
    return checked.join(share.select((F.col("share") < 0.8).alias("fewer_pairs")), F.lit(True))


@query("h7_knn_filtered", _knn_sql("b.label < 5"))
def h7(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, base = _sides(spark, sf_dir)
    return _shown(ann.knn_filtered(queries, base, F.col("label") < 5, 10, exclude_self=True))


@query("h8_index_self_check", "SELECT 10 * least(5, count(*)) AS expected, true AS consistent, true AS recall_reached FROM embeddings")
def h8(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded = lambda q, index, k: probing.ivf_search_bounded(q, index, k).found
    checked = ann.index_self_check(_index(_sides(spark, sf_dir)[1]), 10, search=bounded)
    return checked.select("expected", (F.col("found") == F.round(F.col("recall") * F.col("expected"))).alias("consistent"),
                          (F.col("recall") >= 1.0).alias("recall_reached"))
