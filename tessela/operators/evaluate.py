"""Evaluation of recommendation lists (user_id, item_id, rank) against a test set (user_id, item_id)."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessela.functions import vectors
from tessela.session import materialize


def user_hits(recs: DataFrame, test: DataFrame, k: int) -> DataFrame:
    """Per user with test items: relevant, hits, dcg, ideal dcg, average precision and reciprocal rank at k.

    One row per relevant item joins the list; a list has at most k rows, so its running sum is bounded.
    """
    wanted = test.select("user_id", "item_id").distinct()
    relevant = wanted.groupBy("user_id").agg(F.count(F.lit(1)).alias("relevant"))
    found = recs.where(F.col("rank") <= k).join(wanted, ["user_id", "item_id"], "left_semi").select("user_id", "rank")
    order = Window.partitionBy("user_id").orderBy("rank")
    ranked = found.withColumn("hit_no", F.row_number().over(order))
    per_user = ranked.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("hits"),
        F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"),
        F.sum(F.col("hit_no") / F.col("rank")).alias("precision_sum"),
        F.min("rank").alias("first_rank"),
    )
    zero = F.lit(0.0)
    ideal_length = F.least(F.col("relevant"), F.lit(k))
    ideal = F.aggregate(
        F.sequence(F.lit(1).cast("long"), ideal_length), zero, lambda acc, i: acc + 1 / F.log2(i + 1))
    return relevant.join(per_user, "user_id", "left").select(
        "user_id", "relevant", F.coalesce("hits", F.lit(0)).alias("hits"),
        F.coalesce("dcg", zero).alias("dcg"), ideal.alias("ideal_dcg"),
        (F.coalesce("precision_sum", zero) / ideal_length).alias("average_precision"),
        F.coalesce(1 / F.col("first_rank"), zero).alias("reciprocal_rank"),
    )


def _metric(name: str, k: int) -> Column:
    return {
        "recall": F.avg(F.col("hits") / F.col("relevant")),
        "precision": F.avg(F.col("hits") / F.lit(k)),
        "hit_rate": F.avg((F.col("hits") > 0).cast("double")),
        "dcg": F.avg("dcg"),
        "ndcg": F.avg(F.col("dcg") / F.col("ideal_dcg")),
        "map": F.avg("average_precision"),
        "mrr": F.avg("reciprocal_rank"),
    }[name]


RANK_METRICS = ("recall", "precision", "hit_rate", "dcg", "ndcg", "map", "mrr")


def coverage(recs: DataFrame, catalog: DataFrame) -> DataFrame:
    """Distinct recommended items over distinct items of the catalogue."""
    shown = recs.agg(F.count_distinct("item_id").alias("shown"))
    known = catalog.agg(F.count_distinct("item_id").alias("known")).scalar()
    return shown.select("shown", known.alias("known"), F.try_divide("shown", known).alias("coverage"))


def list_diversity(recs: DataFrame, item_vectors: DataFrame) -> DataFrame:
    """Per user: 1 - mean cosine over the pairs of the list; null for a single item.

    An item without a vector counts as one that is like no other. With unit vectors the sum over pairs is (|sum of vectors|^2 - sum of |vector|^2) / 2, so no pair is made.
    """
    unit = item_vectors.select("item_id", vectors.l2_normalize(F.col("vector")).alias("unit"))
    rows = recs.select("user_id", "item_id").join(unit, "item_id").select(
        "user_id", array_to_vector("unit").alias("v"), vectors.dot(F.col("unit"), F.col("unit")).alias("own"))
    sums = rows.groupBy("user_id").agg(F.sum("own").alias("own"), vector_to_array(Summarizer.sum(F.col("v"))).alias("total"))
    sizes = recs.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    mean = (vectors.dot(F.col("total"), F.col("total")) - F.col("own")) / (n * (n - 1))
    return sizes.join(sums, "user_id", "left").select("user_id", F.when(n > 1, 1 - F.coalesce(mean, F.lit(0.0))).alias("diversity"))


def business_metrics(events: DataFrame, by: list[str] | None = None) -> DataFrame:
    """ctr, conversion rate, revenue per user, purchase rate and mean dwell, in total and rolled up by ``by``."""
    kind = F.col("event_type")
    clicks, views = F.count_if(kind == "click"), F.count_if(kind == "view")
    purchases = F.count_if(kind == "purchase")
    users = F.count_distinct("user_id")
    metrics = [
        F.try_divide(clicks, views).alias("ctr"),
        F.try_divide(purchases, clicks).alias("conversion_rate"),
        F.try_divide(F.sum(F.when(kind == "purchase", F.col("value"))), users).alias("revenue_per_user"),
        F.try_divide(F.count_distinct(F.when(kind == "purchase", F.col("user_id"))), users).alias("purchase_rate"),
        F.avg(F.when(kind == "dwell_time", F.col("value"))).alias("mean_dwell"),
    ]
    return events.rollup(*by).agg(*metrics) if by else events.agg(*metrics)


def evaluate(
    recs: DataFrame, test: DataFrame, metrics: list[str], catalog: DataFrame | None = None,
    item_vectors: DataFrame | None = None,
) -> DataFrame:
    """(metric, value), one row per asked metric such as ``recall@10``, ``mrr``, ``coverage`` or ``diversity``.

    Metrics with the same cut-off share one pass over the lists.
    """
    by_k: dict[int, list[tuple[str, str]]] = {}
    parts = []
    if len(metrics) > 1:
        # every part looks at the lists
        recs = materialize(recs, "lists")
    for asked in metrics:
        name, _, cut = asked.partition("@")
        if name == "coverage":
            if catalog is None:
                raise ValueError("coverage needs the catalogue")
            parts.append(coverage(recs, catalog).select(F.lit(asked).alias("metric"), F.col("coverage").alias("value")))
        elif name == "diversity":
            if item_vectors is None:
                raise ValueError("diversity needs item vectors")
            parts.append(list_diversity(recs, item_vectors).agg(F.avg("diversity").alias("value")).select(
                F.lit(asked).alias("metric"), "value"))
        elif name in RANK_METRICS:
            by_k.setdefault(int(cut) if cut else 10, []).append((asked, name))
        else:
            raise ValueError(f"unknown metric {asked!r}")
    for k, wanted in by_k.items():
        wide = user_hits(recs, test, k).agg(*[_metric(name, k).alias(asked) for asked, name in wanted])
        rows = F.array(*[F.struct(F.lit(a).alias("metric"), F.col(f"`{a}`").alias("value")) for a, _ in wanted])
        parts.append(wide.select(F.explode(rows).alias("r")).select("r.*"))
    return reduce(DataFrame.unionByName, parts)
