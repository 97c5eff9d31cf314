"""From mapped columns to ranked lists: roles, retrieval, index, candidates, features, model score, top k."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessela.functions import vectors
from tessela.operators import ann, features, models, prep, recommend
from tessela.roles import Roles
from tessela.session import materialize

# Which mapped roles can fill each role of the feature and model operators, in order of preference.
ROLE_SOURCES = {
    "user": ("USER_ID",),
    "item": ("ITEM_ID",),
    "signal": ("ENGAGEMENT_SIGNAL", "RATING", "PURCHASE", "CLICK", "VIEW", "INTERACTION_EVENT"),
    "ts": ("TEMPORAL_FEATURE", "TEMPORAL"),
    "session": ("SESSION_ID", "SESSION"),
}

RANKING_FEATURES = ("retrieval", "user_interaction_count", "user_signal_mean", "item_interaction_count", "item_signal_mean")


def roles_from_mapping(mapped: DataFrame, tiebreak: tuple[str, ...] = ()) -> Roles:
    """The roles of a table from its mapped columns (column, role, confidence).

    The most confident column of a role counts, ties by name. One row per role reaches the driver. A user, an item and a
    signal are required; time and session may be missing.
    """
    best = mapped.where(F.col("column").isNotNull()).groupBy("role").agg(
        F.min_by("column", F.struct(-F.col("confidence"), F.col("column"))).alias("column"))
    known = {r["role"]: r["column"] for r in best.where(F.col("role").isin(*[x for s in ROLE_SOURCES.values() for x in s])).collect()}
    chosen = {name: next((known[s] for s in sources if s in known), None) for name, sources in ROLE_SOURCES.items()}
    if missing := [n for n in ("user", "item", "signal") if chosen[n] is None]:
        raise ValueError(f"no mapped column for {', '.join(missing)}")
    return Roles(**chosen, tiebreak=tiebreak)


def with_ranking_features(pairs: DataFrame, events: DataFrame, roles: Roles, fitted: models.RetrievalVectors) -> DataFrame:
    """(user, item) pairs with the product of their vectors and the features of both sides; unknown sides get zeros."""
    users = features.user_features(events, roles).select(roles.user, "user_interaction_count", "user_signal_mean")
    items = features.item_features(events, roles).select(roles.item, "item_interaction_count", "item_signal_mean")
    u, i = fitted.users.withColumnRenamed("vector", "__u"), fitted.items.withColumnRenamed("vector", "__i")
    joined = pairs.join(u, roles.user, "left").join(i, roles.item, "left").join(users, roles.user, "left").join(items, roles.item, "left")
    rows = joined.withColumn("retrieval", vectors.dot(F.col("__u"), F.col("__i"))).drop("__u", "__i")
    return rows.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in RANKING_FEATURES})


def retrieve_rank_recommend(
    events: DataFrame, roles: Roles, k: int = 10, pool: int = 100, rank: int = 32, iterations: int = 8, ratio: int = 4,
    nprobe: int | None = None,
) -> DataFrame:
    """(user, item, score, rank): candidates of each user from an index, scored by a model that was fitted on its features.

    Vectors of users and items come from factorization, candidates from the probed cells of a written index. The model
    learns interacted pairs against drawn unseen items, and its probability orders the candidates; ties go by item.
    """
    fitted = models.fit_retrieval(events, roles, rank=rank, iterations=iterations)
    fitted = models.RetrievalVectors(materialize(fitted.users, "user-vectors"), materialize(fitted.items, "item-vectors"))
    index = ann.ivf_build(fitted.items.select(F.col(roles.item).alias("id"), "vector"))
    found = recommend.candidates(fitted.users.withColumnRenamed(roles.user, "user_id"), index, pool, nprobe)
    found = found.select(F.col("user_id").alias(roles.user), F.col("item_id").alias(roles.item))
    taken = events.select(roles.user, roles.item).distinct().withColumn("label", F.lit(1.0))
    drawn = prep.negative_samples(events, roles, ratio).select(roles.user, F.col("negative_item").alias(roles.item), F.lit(0.0).alias("label"))
    examples = materialize(with_ranking_features(taken.unionByName(drawn), events, roles, fitted), "ranking-examples")
    model = Pipeline(stages=[
        VectorAssembler(inputCols=list(RANKING_FEATURES), outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="features"),
        LogisticRegression(maxIter=30, regParam=0.001),
    ]).fit(examples)
    scored = models.score(with_ranking_features(found, events, roles, fitted), model).withColumnRenamed(roles.user, "user_id").withColumnRenamed(roles.item, "item_id")
    return recommend.recommend(scored.select("user_id", "item_id", "score"), k)
