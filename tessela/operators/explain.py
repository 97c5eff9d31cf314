"""Why was an item recommended: similar items and users, and weighted factors."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessela.functions import vectors
from tessela.operators.recommend import days_before
from tessela.roles import Roles

# Factors with their weights and the sentence that each gives.
FACTORS = (
    ("genre_match", 0.45, "Matches the categories you use most"),
    ("history_overlap", 0.28, "Similar to items in your history"),
    ("popularity", 0.18, "Popular with other users"),
    ("recency", 0.09, "Recently added"),
)


def _similar(pairs: DataFrame, node: str, via: str, seeds: DataFrame, k: int | None, seeds_per_slice: int) -> DataFrame:
    """Cosine of co-occurrence between each seed and every node that shares a ``via`` with it.

    A ``via`` carries the list of its seeds, cut into slices of bounded length, to its rows. Work is rows times seeds of
    the row: no pairs of a hot ``via`` are made, and counts combine map-side before they are shuffled.
    """
    edges = pairs.select(node, via).distinct()
    sizes = edges.groupBy(node).agg(F.count(F.lit(1)).alias("n"))
    wanted = seeds.select(F.col(node).alias("seed")).distinct()
    total = wanted.count()
    slices = max(1, -(-total // seeds_per_slice))
    touched = edges.join(wanted, F.col(node) == F.col("seed")).select(via, "seed")
    lists = touched.groupBy(via, F.pmod(F.xxhash64("seed"), F.lit(slices)).alias("slice")).agg(
        F.collect_list("seed").alias("seeds"))
    counted = edges.join(lists, via).select(node, F.explode("seeds").alias("seed")).where(
        F.col(node) != F.col("seed")).groupBy("seed", node).agg(F.count(F.lit(1)).alias("shared"))
    seed_sizes = sizes.select(F.col(node).alias("seed"), F.col("n").alias("seed_n"))
    scored = counted.join(sizes, node).join(seed_sizes, "seed").withColumn(
        "similarity", F.round(F.col("shared") / F.sqrt(F.col("n") * F.col("seed_n")), 9))
    if k is None:
        return scored.select("seed", F.col(node).alias("similar"), "shared", "similarity")
    order = Window.partitionBy("seed").orderBy(F.col("similarity").desc(), node)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "seed", F.col(node).alias("similar"), "shared", "similarity", "rank")


def similar_items(df: DataFrame, roles: Roles, seeds: DataFrame, k: int = 10, seeds_per_slice: int = 10_000) -> DataFrame:
    """The k items most often used by the users of each seed item."""
    return _similar(df, roles.item, roles.user, seeds, k, seeds_per_slice)


def similar_users(df: DataFrame, roles: Roles, seeds: DataFrame, k: int = 10, seeds_per_slice: int = 10_000) -> DataFrame:
    """The k users who share the most items with each seed user."""
    return _similar(df, roles.user, roles.item, seeds, k, seeds_per_slice)


def popularity_percentile(df: DataFrame, item: str) -> DataFrame:
    """(item, percentile): share of items with fewer rows.

    The running count goes over distinct row counts, of which N rows allow at most sqrt(2N).
    """
    counts = df.groupBy(item).agg(F.count(F.lit(1)).alias("n"))
    histogram = counts.groupBy("n").agg(F.count(F.lit(1)).alias("items"))
    one = Window.partitionBy(F.lit(0))
    below = F.coalesce(F.sum("items").over(one.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    share = histogram.select("n", (below / F.sum("items").over(one)).alias("percentile"))
    return counts.join(share, "n").select(item, "percentile")


def user_profiles(df: DataFrame, roles: Roles, item_vectors: DataFrame) -> DataFrame:
    """(user, profile): mean of the unit vectors of the user's rows, summed inside the JVM with map-side combine."""
    unit = item_vectors.select("item_id", array_to_vector(vectors.l2_normalize(F.col("vector"))).alias("unit"))
    counted = df.groupBy(roles.user, roles.item).agg(F.count(F.lit(1)).cast("double").alias("w"))
    rows = counted.join(unit, counted[roles.item] == unit["item_id"])
    return rows.groupBy(roles.user).agg(
        vector_to_array(Summarizer.mean(F.col("unit"), F.col("w"))).alias("profile"))


def explain(
    requests: DataFrame, df: DataFrame, roles: Roles, item_table: DataFrame, as_of: str, recency_days: float = 30.0,
    seeds_per_slice: int = 10_000,
) -> DataFrame:
    """Factors of each asked (user_id, item_id), largest contribution first.

    genre_match is the share of the user's rows in the item's category, history_overlap the largest
    co-occurrence cosine of the item with another item of the user, popularity the item's percentile and recency
    exp(-age / days). ``item_table`` has item_id, category and first_seen. The overlap is asked for the requested items
    only and meets the histories of the requesting users only; the other factors are aggregates per user, item or both.
    """
    item_table = item_table.select("item_id", "category", "first_seen")
    history = df.select(F.col(roles.user).alias("user_id"), F.col(roles.item).alias("item_id"))
    tagged = history.join(item_table.select("item_id", "category"), "item_id")
    by_category = tagged.groupBy("user_id", "category").agg(F.count(F.lit(1)).alias("in_category"))
    totals = history.groupBy("user_id").agg(F.count(F.lit(1)).alias("rows"))
    near = _similar(history, "item_id", "user_id", requests.select("item_id"), None, seeds_per_slice)
    own = history.distinct().withColumnRenamed("item_id", "similar")
    overlap = requests.select("user_id", F.col("item_id").alias("seed")).join(own, "user_id").join(near, ["seed", "similar"]).groupBy(
        "user_id", F.col("seed").alias("item_id")).agg(F.max("similarity").alias("overlap"))
    popularity = popularity_percentile(df, roles.item).withColumnRenamed(roles.item, "item_id")
    joined = (
        requests.select("user_id", "item_id")
        .join(item_table, "item_id", "left").join(popularity, "item_id", "left")
        .join(totals, "user_id", "left").join(overlap, ["user_id", "item_id"], "left")
        .join(by_category, ["user_id", "category"], "left")
    )
    values = {
        "genre_match": F.try_divide(F.col("in_category"), F.col("rows")),
        "history_overlap": F.col("overlap"),
        "popularity": F.col("percentile"),
        "recency": F.exp(-F.greatest(days_before(F.col("first_seen"), as_of), F.lit(0.0)) / F.lit(recency_days)),
    }
    entries = []
    for name, weight, _ in FACTORS:
        value = F.coalesce(values[name], F.lit(0.0))
        entries.append(F.struct(
            F.round(value * weight, 9).alias("contribution"), F.lit(name).alias("factor"), value.alias("value"),
            F.lit(weight).alias("weight")))
    return joined.select("user_id", "item_id", F.sort_array(F.array(*entries), asc=False).alias("factors"))


def reason_sentence(explained: DataFrame) -> DataFrame:
    """The sentence of the strongest factor."""
    sentences = F.create_map(*[part for name, _, text in FACTORS for part in (F.lit(name), F.lit(text))])
    return explained.withColumn("reason", sentences[F.col("factors")[0]["factor"]])
