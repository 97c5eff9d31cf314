"""Name-based column types, schema fingerprints, drift and rule checks over column catalogs."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessela.functions import vectors
from tessela.roles import DOMAIN_SCHEMAS

# Name parts per type, the first group that matches wins.
FIRST_MATCH_TYPES = (
    ("USER_ID", ("user", "uid", "customer", "client", "account")),
    ("ITEM_ID", ("item", "product", "article", "document", "video", "movie", "song")),
    ("INTERACTION_SIGNAL", ("click", "view", "purchase", "rating", "score", "engagement")),
    ("TEMPORAL", ("time", "date", "timestamp", "created", "updated")),
    ("SESSION", ("session", "visit", "context")),
)

# Name parts and confidence per candidate type, the last group that matches names the type.
LAST_MATCH_TYPES = (
    ("USER_ID", 0.8, ("user", "uid", "customer", "member", "account")),
    ("ITEM_ID", 0.8, ("item", "product", "article", "document", "content", "movie", "book")),
    ("INTERACTION", 0.7, ("click", "view", "purchase", "rating", "score", "interaction")),
    ("TEMPORAL", 0.6, ("time", "date", "timestamp", "created", "updated")),
)

# Name parts per kind of content, the first group that matches wins.
CONTENT_TYPES = (
    ("IDENTIFIER", ("id", "uid", "uuid", "_id")),
    ("TEMPORAL", ("date", "time", "timestamp", "created", "updated")),
    ("NUMERIC_METRIC", ("score", "rating", "price", "amount", "count")),
    ("CATEGORICAL", ("category", "type", "status", "name")),
    ("TEXT", ("description", "text", "content", "title")),
    ("BOOLEAN", ("is_", "has_", "flag", "bool")),
)

NUMERIC_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double")

# Default validation rules.
VALIDATION_RULES = {
    "min_rows": 100,
    "max_null_percentage": 50.0,
    "require_user_id": True,
    "require_item_id": True,
}


def has_any(name: Column, parts: tuple[str, ...]) -> Column:
    return F.lower(name).rlike("|".join(parts))


def first_match_type(name: Column) -> Column:
    chain = F
    for kind, parts in FIRST_MATCH_TYPES:
        chain = chain.when(has_any(name, parts), kind)
    return chain


def semantic_types(catalog: DataFrame) -> DataFrame:
    return catalog.withColumn("semantic_type", first_match_type(F.col("column")))


def semantic_candidates(catalog: DataFrame) -> DataFrame:
    """Candidate type is the last group hit, confidence the highest of all groups hit; columns without a hit leave."""
    name = F.col("column")
    chain = F
    for kind, _, parts in reversed(LAST_MATCH_TYPES):
        chain = chain.when(has_any(name, parts), kind)
    seen = [F.when(has_any(name, parts), F.lit(score)).otherwise(F.lit(0.5)) for _, score, parts in LAST_MATCH_TYPES]
    return (
        catalog.withColumn("candidate_type", chain)
        .where(F.col("candidate_type").isNotNull())
        .withColumn("confidence", F.greatest(*seen))
    )


def content_types(profile: DataFrame) -> DataFrame:
    """Type by name, then by dtype and the share of distinct values; input has column, dtype, unique_count, num_rows."""
    name, dtype = F.col("column"), F.col("dtype")
    ratio = F.when(F.col("num_rows") > 0, F.col("unique_count") / F.col("num_rows")).otherwise(F.lit(0.0))
    chain = F
    for kind, parts in CONTENT_TYPES:
        chain = chain.when(has_any(name, parts), kind)
    numeric = dtype.isin(*NUMERIC_TYPES) | dtype.startswith("decimal")
    return profile.withColumn(
        "content_type",
        chain.when(numeric & (ratio < 0.1), "CATEGORICAL_NUMERIC")
        .when(numeric, "NUMERIC")
        .when(dtype == "string", "TEXT")
        .when(dtype == "boolean", "BOOLEAN")
        .otherwise("UNKNOWN"),
    )


def schema_fingerprint(catalog: DataFrame) -> DataFrame:
    """One fingerprint per dataset: sha256 of the sorted ``name:dtype`` list.

    The list of one dataset meets in one row, as the hash needs it; its length is the width of a table.
    """
    line = F.concat_ws(":", "column", "dtype")
    grouped = catalog.groupBy("dataset").agg(
        F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "|"), 256).alias("fingerprint"),
        F.count(F.lit(1)).alias("column_count"),
    )
    return grouped.select("dataset", "fingerprint", F.substring("fingerprint", 1, 32).alias("schema_hash"), "column_count")


def schema_drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """Columns added, removed or retyped between two catalogs."""
    before = old.select("dataset", "column", F.col("dtype").alias("old_dtype"))
    after = new.select("dataset", "column", F.col("dtype").alias("new_dtype"))
    both = before.join(after, ["dataset", "column"], "full_outer")
    change = (
        F.when(F.col("old_dtype").isNull(), "added")
        .when(F.col("new_dtype").isNull(), "removed")
        .when(F.col("old_dtype") != F.col("new_dtype"), "retyped")
    )
    return both.withColumn("change", change).where(F.col("change").isNotNull())


def _mean_vectors(df: DataFrame, vector: str, label: str | None) -> DataFrame:
    """(label, mean vector) and the overall mean under the label ``all``; vectors are summed in the JVM, map-side first."""
    rows = df.select(
        (F.col(label).cast("string") if label else F.lit("all")).alias("label"),
        array_to_vector(vectors.as_doubles(F.col(vector))).alias("v"),
    )
    means = rows.groupBy("label").agg(Summarizer.mean(F.col("v")).alias("m"), F.count(F.lit(1)).cast("double").alias("n"))
    if label:
        overall = means.groupBy().agg(Summarizer.mean(F.col("m"), F.col("n")).alias("m")).select(F.lit("all").alias("label"), "m")
        means = means.select("label", "m").unionByName(overall)
    return means.select("label", vector_to_array("m").alias("mean"))


def embedding_drift(
    old: DataFrame, new: DataFrame, vector: str = "embedding", label: str | None = None, threshold: float = 0.1
) -> DataFrame:
    """1 - cosine of the mean vectors, overall and per label; flagged above the threshold."""
    before = _mean_vectors(old, vector, label).withColumnRenamed("mean", "old_mean")
    after = _mean_vectors(new, vector, label).withColumnRenamed("mean", "new_mean")
    drift = before.join(after, "label").withColumn("drift", 1 - vectors.cosine(F.col("old_mean"), F.col("new_mean")))
    return drift.select("label", "drift", (F.col("drift") > threshold).alias("drifted"))


def validate(catalog: DataFrame, quality: DataFrame, rules: dict | None = None) -> DataFrame:
    """Issue rows per dataset. ``quality`` has dataset, num_rows and null_pct; ``catalog`` has dataset and column."""
    active = {**VALIDATION_RULES, **(rules or {})}
    name = F.col("column")
    named = catalog.groupBy("dataset").agg(
        F.bool_or(has_any(name, ("user", "uid"))).alias("has_user"),
        F.bool_or(has_any(name, ("item", "product"))).alias("has_item"),
        F.bool_or(has_any(name, ("click", "view", "purchase", "rating", "score"))).alias("has_signal"),
    )
    issues = [
        ("ERROR", "INSUFFICIENT_ROWS", F.col("num_rows") < active["min_rows"]),
        ("WARNING", "HIGH_NULL_PERCENTAGE", F.col("null_pct") > active["max_null_percentage"]),
        ("WARNING", "NO_USER_ID", F.lit(active["require_user_id"]) & ~F.col("has_user")),
        ("WARNING", "NO_ITEM_ID", F.lit(active["require_item_id"]) & ~F.col("has_item")),
        ("INFO", "NO_INTERACTION_SIGNAL", ~F.col("has_signal")),
    ]
    found = F.array_compact(
        F.array(*[F.when(hit, F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"))) for level, code, hit in issues])
    )
    return quality.join(named, "dataset").select("dataset", F.explode(found).alias("i")).select("dataset", "i.level", "i.code")


def dataset_validity(quality: DataFrame, issues: DataFrame) -> DataFrame:
    """A dataset is valid when none of its issues is an error."""
    errors = issues.groupBy("dataset").agg(
        F.count_if(F.col("level") == "ERROR").alias("errors"), F.count(F.lit(1)).alias("issues")
    )
    return quality.select("dataset").join(errors, "dataset", "left").select(
        "dataset",
        (F.coalesce("errors", F.lit(0)) == 0).alias("is_valid"),
        F.coalesce("issues", F.lit(0)).alias("issue_count"),
    )


def domain_checks(
    df: DataFrame,
    id_column: str,
    ts: str | None,
    positive: tuple[str, ...] = ("price", "quantity", "rating"),
    min_rows: int = 1000,
    max_null_ratio: float = 0.5,
) -> DataFrame:
    """(check_name, failures, passed): row count, null share, unique ids, timestamps, positive values."""
    present = [c for c in positive if c in df.columns]
    nulls = sum((F.col(c).isNull().cast("long") for c in df.columns), F.lit(0))
    wide = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(nulls).alias("nulls"),
        (F.count(id_column) - F.count_distinct(id_column)).alias("repeats"),
        (F.count_if(F.col(ts).isNull()) if ts else F.count(F.lit(1))).alias("no_ts"),
        *[F.count_if(F.col(c) <= 0).alias(f"bad_{c}") for c in present],
    )
    ratio = F.col("nulls") / (F.col("n") * len(df.columns))
    checks = [
        ("min_rows", F.greatest(F.lit(min_rows) - F.col("n"), F.lit(0))),
        ("max_null_ratio", F.when(ratio > max_null_ratio, F.col("nulls")).otherwise(F.lit(0))),
        ("unique_ids", F.col("repeats")),
        ("timestamps", F.col("no_ts")),
        *[(f"positive_{c}", F.col(f"bad_{c}")) for c in present],
    ]
    rows = F.array(*[F.struct(F.lit(n).alias("check_name"), v.cast("long").alias("failures")) for n, v in checks])
    return wide.select(F.explode(rows).alias("r")).select("r.*", (F.col("r.failures") == 0).alias("passed"))


def schema_conformance(catalog: DataFrame, domain: str) -> DataFrame:
    """Per dataset and column of the domain: required or not, present or not."""
    required, optional = DOMAIN_SCHEMAS[domain]
    wanted = F.array(*[
        F.struct(F.lit(c).alias("wanted"), F.lit(c in required).alias("required")) for c in (*required, *optional)
    ])
    have = catalog.where(F.col("column").isin(*required, *optional)).select("dataset", F.col("column").alias("wanted")).distinct()
    asked = catalog.select("dataset").distinct().select("dataset", F.explode(wanted).alias("w")).select("dataset", "w.*")
    return asked.join(have.withColumn("present", F.lit(True)), ["dataset", "wanted"], "left").select(
        "dataset", "wanted", "required", F.coalesce("present", F.lit(False)).alias("present")
    )
