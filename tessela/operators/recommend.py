"""Candidates, top-k recommendations, and what to show for cold users and items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessela.functions import vectors
from tessela.operators.ann import IvfIndex, ivf_search, knn_exact
from tessela.operators.probing import ivf_search_bounded, similar_above_pruned
from tessela.roles import Roles


def candidates(users: DataFrame, items: DataFrame | IvfIndex, k: int = 100, nprobe: int | None = None,
               bounded: bool = False) -> DataFrame:
    """(user_id, item_id, score, rank): the k items with the largest inner product for each user vector.

    Items as a table are searched exactly, items as an index approximately in ``nprobe`` cells, or exactly in the cells that can
    matter if ``bounded``.
    """
    queries = users.select(F.col("user_id").alias("query_id"), "vector")
    if isinstance(items, IvfIndex):
        found = ivf_search_bounded(queries, items, k).found if bounded else ivf_search(queries, items, k, nprobe)
    else:
        found = knn_exact(queries, items.select(F.col("item_id").alias("id"), "vector"), k)
    return found.select(F.col("query_id").alias("user_id"), F.col("id").alias("item_id"), "score", "rank")


def recommend(scored: DataFrame, k: int = 10, score: str = "score") -> DataFrame:
    """The k best candidates of each user with ranks from 1, ties by item."""
    order = Window.partitionBy("user_id").orderBy(F.col(score).desc(), "item_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def popular_items(weighted: DataFrame, k: int = 50) -> DataFrame:
    """The k items with the largest summed weight; a bounded top-k without a sort of all items."""
    totals = weighted.groupBy("item_id").agg(F.round(F.sum("weight"), 9).alias("score"))
    return totals.orderBy(F.col("score").desc(), "item_id").limit(k)


def cold_start_users(users: DataFrame, history: DataFrame, popular: DataFrame) -> DataFrame:
    """The popular list for every user without history. The list has at most its k rows and enters as one array."""
    new = users.select("user_id").join(history.select("user_id"), "user_id", "left_anti")
    ordered = popular.groupBy().agg(
        F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("o"), "item_id", "score"))).alias("list")
    ).scalar()
    listed = new.select("user_id", F.posexplode(ordered).alias("pos", "p"))
    return listed.select("user_id", F.col("p.item_id").alias("item_id"), F.col("p.score").alias("score"),
                         (F.col("pos") + 1).alias("rank"))


def content_cold_items(
    new_items: DataFrame, known_items: DataFrame, threshold: float = 0.7, boost: float = 1.2
) -> DataFrame:
    """Score of a new item: similarity-weighted mean of its near known items, times the boost.

    ``new_items`` (item_id, vector), ``known_items`` (item_id, vector, score). Items without a near neighbour leave.
    """
    unit = vectors.l2_normalize(F.col("vector"))
    sums = similar_above_pruned(
        new_items.select(F.col("item_id").alias("query_id"), unit.alias("vector")),
        known_items.select(F.col("item_id").alias("id"), unit.alias("vector"), F.col("score").alias("value")),
        threshold,
    )
    return sums.where(F.col("neighbours") > 0).select(
        F.col("query_id").alias("item_id"), "neighbours",
        (F.col("weighted_sum") / F.col("similarity_sum") * boost).alias("score"),
    )


def sparse_hybrid(
    scored: DataFrame, history_counts: DataFrame, min_interactions: int = 5, decay: float = 0.9
) -> DataFrame:
    """Blend personal and popular scores for users with few interactions.

    With n < ``min_interactions`` rows of history the popularity score weighs decay^(min - n) and the personal score the
    rest; users with enough history keep their personal score.
    """
    n = F.coalesce(F.col("interactions"), F.lit(0))
    popular = F.pow(F.lit(decay), F.lit(min_interactions) - n)
    blended = popular * F.col("popularity_score") + (1 - popular) * F.col("personal_score")
    joined = scored.join(history_counts.select("user_id", "interactions"), "user_id", "left")
    return joined.withColumn(
        "score", F.when(n < min_interactions, blended).otherwise(F.col("personal_score"))
    ).drop("interactions")


def recent_pairs(history: DataFrame, roles: Roles, as_of: str, window_days: int) -> DataFrame:
    """Distinct (user_id, item_id) of the last days before ``as_of``."""
    end = F.lit(as_of).cast("timestamp")
    start = end - F.make_dt_interval(F.lit(window_days))
    ts = F.col(roles.ts).cast("timestamp")
    return history.where((ts >= start) & (ts <= end)).select(
        F.col(roles.user).alias("user_id"), F.col(roles.item).alias("item_id")).distinct()


def exclude_seen(recs: DataFrame, history: DataFrame, roles: Roles, as_of: str, window_days: int = 30) -> DataFrame:
    return recs.join(recent_pairs(history, roles, as_of, window_days), ["user_id", "item_id"], "left_anti")


def days_before(ts: Column, as_of: str) -> Column:
    """Days from a time to ``as_of``, with fractions."""
    return (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / F.lit(86_400_000_000.0)
