"""Business meaning of mapped columns: classes, entity graph, feature catalog, review and corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessela.roles import ENTITY_GROUPS, FINE_ROLES
from tessela.session import materialize

# Bucket of each of the eight column roles.
ROLE_BUCKETS = {
    "USER_ID": "IDENTITY",
    "ITEM_ID": "IDENTITY",
    "INTERACTION_SIGNAL": "SIGNAL",
    "ITEM_FEATURE": "FEATURE",
    "USER_FEATURE": "FEATURE",
    "TEMPORAL": "TEMPORAL",
    "SESSION": "SESSION",
    "CONTEXTUAL": "CONTEXTUAL",
}
BUCKETS = ("IDENTITY", "SIGNAL", "FEATURE", "EVENT", "SESSION", "TEMPORAL", "CONTEXTUAL")

# Parts of dtype or name that call for a kind of processing.
HINTS = (
    ("categorical_features", "dtype", ("str", "utf8", "string", "object", "category")),
    ("numerical_features", "dtype", ("int", "float", "double")),
    ("temporal_features", "column", ("date", "time", "timestamp")),
    ("embedding_candidates", "column", ("title", "description", "text", "content", "name")),
)


def _lookup(pairs: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(part) for pair in pairs.items() for part in pair])[key]


def classify(mappings: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    """Class and side of each fine role; unknown roles are features of an unknown side."""
    classes = {role: cls for role, cls, _ in FINE_ROLES}
    sides = {role: side for role, _, side in FINE_ROLES}
    return (
        mappings.withColumn("classification", F.coalesce(_lookup(classes, F.col("role")), F.lit("FEATURE")))
        .withColumn("side", F.coalesce(_lookup(sides, F.col("role")), F.lit("unknown")))
        .withColumn("is_ambiguous", F.col("confidence") < min_confidence)
    )


def identities(classified: DataFrame) -> DataFrame:
    return classified.where(F.col("classification") == "IDENTITY")


def signals(classified: DataFrame) -> DataFrame:
    return classified.where(F.col("classification") == "SIGNAL")


def features(classified: DataFrame) -> DataFrame:
    return classified.where(F.col("classification") == "FEATURE")


def ambiguous(classified: DataFrame) -> DataFrame:
    return classified.where(F.col("is_ambiguous"))


def role_buckets(mappings: DataFrame) -> DataFrame:
    return mappings.withColumn("bucket", _lookup(ROLE_BUCKETS, F.col("role"))).where(F.col("bucket").isNotNull())


def bucket_counts(mappings: DataFrame) -> DataFrame:
    """One row per bucket, with 0 where it is empty."""
    counted = role_buckets(mappings).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    known = counted.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("bucket", "n"))).alias("known"))
    every = known.select("known", F.explode(F.array(*[F.lit(b) for b in BUCKETS])).alias("bucket"))
    return every.select("bucket", F.coalesce(F.col("known")[F.col("bucket")], F.lit(0)).alias("columns"))


def graph_nodes(mappings: DataFrame) -> DataFrame:
    """(column, dataset_ord, pos, node_type, is_primary): the first user and the first item column are primary.

    The typed columns are written once: readers ask for them again and again, and a catalog may cost more than a table.
    """
    role = F.col("role")
    kind = F
    for name, roles in ENTITY_GROUPS.items():
        kind = kind.when(role.isin(*roles), name)
    typed = materialize(mappings.select("column", "dataset_ord", "pos", kind.otherwise("feature").alias("node_type")), "nodes")
    first = typed.where(F.col("node_type").isin("user", "item")).groupBy("node_type").agg(
        F.min(F.struct("dataset_ord", "pos")).alias("place")
    )
    # one row for user and one for item
    return typed.join(F.broadcast(first), "node_type", "left").select(
        "column", "dataset_ord", "pos", "node_type",
        F.coalesce(F.struct("dataset_ord", "pos") == F.col("place"), F.lit(False)).alias("is_primary"),
    )


def graph_edges(nodes: DataFrame) -> DataFrame:
    """user -> item per interaction, user -> session, and owner -> feature where the name hints at the owner."""
    def primary(kind: str) -> Column:
        return F.min(F.when(F.col("node_type") == kind, F.col("column"))).alias(kind)

    # one row
    primaries = nodes.where("is_primary").agg(primary("user"), primary("item"))
    lower = F.lower("column")
    named = nodes.join(F.broadcast(primaries)).select(
        "column", "node_type", "user", "item",
        lower.rlike("user|customer|member").alias("of_user"), lower.rlike("item|product|content").alias("of_item"),
    )
    both = F.col("user").isNotNull() & F.col("item").isNotNull()
    kind, column = F.col("node_type"), F.col("column")
    none = F.lit(None).cast("string")

    def edge(source: Column, target: Column, via: Column, label: str) -> Column:
        return F.struct(source.alias("source"), target.alias("target"), via.alias("via"), F.lit(label).alias("type"))

    found = (
        F.when((kind == "interaction") & both, edge(F.col("user"), F.col("item"), column, "interaction"))
        .when((kind == "session") & both, edge(F.col("user"), column, none, "belongs_to"))
        .when((kind == "feature") & F.col("of_user"), edge(F.col("user"), column, none, "has_feature"))
        .when((kind == "feature") & F.col("of_item"), edge(F.col("item"), column, none, "has_feature"))
    )
    return named.select(found.alias("e")).where(F.col("e").isNotNull()).select("e.*")


def graph_summary(nodes: DataFrame) -> DataFrame:
    kinds = ("user", "item", "interaction", "session", "feature")
    return nodes.agg(
        F.count(F.lit(1)).alias("total_nodes"),
        *[F.count_if(F.col("node_type") == k).alias(f"{k}_count") for k in kinds],
    )


def feature_catalog(classified: DataFrame) -> DataFrame:
    """The catalog section of each column: by side, with signals as target variables and unknown sides under item."""
    side = F.col("side")
    section = (
        F.when(side == "user", "user_features")
        .when((side == "interaction") & (F.col("classification") == "SIGNAL"), "target_variables")
        .when(side == "interaction", "interaction_features")
        .when(side == "context", "context_features")
        .otherwise("item_features")
    )
    return classified.withColumn("section", section)


def catalog_counts(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("section").agg(F.count(F.lit(1)).alias("features"))


def processing_hints(catalog: DataFrame) -> DataFrame:
    """(hint, column): how user, item and context features call to be processed, from dtype and name."""
    own = catalog.where(F.col("section").isin("user_features", "item_features", "context_features"))
    hits = F.array_compact(F.array(*[
        F.when(F.lower(F.col(source)).rlike("|".join(parts)), F.lit(hint)) for hint, source, parts in HINTS
    ]))
    return own.select(F.explode(hits).alias("hint"), "dataset", "column")


def minimum_requirements(classified: DataFrame) -> DataFrame:
    """Is there a user id, an item id and a signal? An id role itself never counts as the signal."""
    role = F.col("role")
    checks = classified.agg(
        F.coalesce(F.bool_or(role == "USER_ID"), F.lit(False)).alias("has_user_id"),
        F.coalesce(F.bool_or(role == "ITEM_ID"), F.lit(False)).alias("has_item_id"),
        F.coalesce(F.bool_or(F.col("classification") == "SIGNAL"), F.lit(False)).alias("has_interaction"),
    )
    return checks.withColumn("is_valid", F.col("has_user_id") & F.col("has_item_id") & F.col("has_interaction"))


# The messages of the catalog check.
NO_USERS = "No user features detected"
NO_ITEMS = "No item features detected"
NO_TARGETS = "No target variables (interaction signals) detected"
REPEATED = "Duplicate feature name: "


def validate_catalog(catalog: DataFrame) -> DataFrame:
    """(level, message) rows: missing sections, and names that occur more than once outside the targets."""
    counts = catalog.agg(
        F.count_if(F.col("section") == "user_features").alias("users"),
        F.count_if(F.col("section") == "item_features").alias("items"),
        F.count_if(F.col("section") == "target_variables").alias("targets"),
    )
    found = F.array_compact(F.array(
        F.when(F.col("users") == 0, F.struct(F.lit("warning").alias("level"), F.lit(NO_USERS).alias("message"))),
        F.when(F.col("items") == 0, F.struct(F.lit("warning").alias("level"), F.lit(NO_ITEMS).alias("message"))),
        F.when(F.col("targets") == 0, F.struct(
            F.lit("issue").alias("level"),
            F.lit(NO_TARGETS).alias("message"))),
    ))
    sections = counts.select(F.explode(found).alias("f")).select("f.*")
    repeated = (
        catalog.where(F.col("section") != "target_variables").groupBy("column").agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
        .select(F.lit("warning").alias("level"), F.concat(F.lit(REPEATED), "column").alias("message"))
    )
    return sections.unionByName(repeated)


def entity_mapping(resolved: DataFrame, corrected: DataFrame | None = None) -> DataFrame:
    """(entity, dataset, column): the first user, item and signal column, and all temporal, session, contextual ones.

    The columns of these roles are written once, so that what gave them their roles is not done for each of the two parts.
    """
    source = corrected if corrected is not None else resolved
    place = F.struct("dataset_ord", "pos")
    single = {"USER_ID": "user_id", "ITEM_ID": "item_id", "INTERACTION_SIGNAL": "interaction_signal"}
    many = {"TEMPORAL": "temporal", "SESSION": "session", "CONTEXTUAL": "contextual"}
    source = materialize(source.where(F.col("role").isin(*single, *many)).select("role", "dataset", "column", "dataset_ord", "pos"), "entities")
    firsts = source.where(F.col("role").isin(*single)).groupBy("role").agg(
        F.min_by(F.struct("dataset", "column"), place).alias("c")
    ).select(_lookup(single, F.col("role")).alias("entity"), "c.dataset", "c.column")
    lists = source.where(F.col("role").isin(*many)).select(_lookup(many, F.col("role")).alias("entity"), "dataset", "column")
    return firsts.unionByName(lists)


def review_status(mappings: DataFrame, min_confidence: float = 0.5, accept: float = 0.9) -> DataFrame:
    """Columns below the minimum are skipped, very confident ones accepted, the rest wait for review."""
    c = F.col("confidence")
    return mappings.withColumn(
        "review", F.when(c < min_confidence, "skipped").when(c >= accept, "auto_accepted").otherwise("needs_review")
    )


def review_queue(classified: DataFrame, threshold: float = 0.8) -> DataFrame:
    return classified.where(F.col("is_ambiguous") | (F.col("confidence") < threshold))


def apply_corrections(mappings: DataFrame, corrections: DataFrame) -> DataFrame:
    """Replace corrected roles with confidence 1; corrections are keyed by dataset and column."""
    fixes = corrections.select("dataset", "column", "corrected_role")
    joined = mappings.join(fixes, ["dataset", "column"], "left")
    hit = F.col("corrected_role").isNotNull()
    return (
        joined.withColumn("role", F.coalesce("corrected_role", "role"))
        .withColumn("confidence", F.when(hit, F.lit(1.0)).otherwise(F.col("confidence")))
        .withColumn("corrected", hit)
        .drop("corrected_role")
    )


def correction_summary(corrected: DataFrame) -> DataFrame:
    n, fixed = F.count(F.lit(1)), F.count_if(F.col("corrected"))
    return corrected.agg(
        n.alias("total"), fixed.alias("corrected"),
        F.when(n > 0, fixed / n).otherwise(F.lit(0.0)).alias("correction_rate"),
    )
