"""A training corpus out of raw documents: language, near duplicates, personal data, source mix, packed batches.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet and reads back for the
next one. All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessela.functions.ordering import global_numbers
from tessela.llm import langid, mixing, packing, pii, sigtree
from tessela.llm.common import stage, table, word_count

SHINGLE_WORDS, PERCENT = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; texts without a letter, null and empty ones go.

    The model learns from the labelled rows of ``docs``. Texts in several languages stay; repeated rows are judged alike.
    """
    found = langid.identify(docs, langid.train(docs))
    return found.where(F.col("lang_pred") != langid.UNKNOWN).select(*docs.columns)


def _free_keys(docs: DataFrame, count: int) -> int:
    """The first of ``count`` consecutive numbers that are no doc_id."""
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    if high + count < 1 << 63:
        return high + 1
    if low - count >= -(1 << 63):
        return low - count
    starts = (k << 56 for k in range(-127, 127))
    return next(a for a in starts if docs.where(F.col("doc_id").between(a, a + count - 1)).isEmpty())


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by five-word shingles at 0.8 or more.

    Different texts under one id are documents of their own; equal texts under one id are one, of which the least row
    stays. Rows without an id are no duplicates and stay.
    """
    named = docs.where("doc_id IS NOT NULL").withColumn("doc_id", F.col("doc_id").cast("long"))
    digest = F.md5(F.coalesce(F.concat(F.lit("="), "text"), F.lit("-")).cast("binary"))
    digests = named.select("doc_id", digest.alias("digest"))
    repeated = digests.groupBy("doc_id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).where("x < y").select("doc_id")
    several = digests.join(repeated, "doc_id").distinct()
    several = stage(global_numbers(several, ["doc_id", "digest"], "key", first=0), "repeated-ids")
    count = several.count()
    if count:
        # ids with several texts, and only those, get a key per text
        several = several.withColumn("key", F.col("key") + _free_keys(named, count))
        named = named.withColumn("digest", digest).join(several, ["doc_id", "digest"], "left").drop("digest")
        named = named.withColumn("key", F.coalesce("key", "doc_id"))
    else:
        named = named.withColumn("key", F.col("doc_id"))
    classes = sigtree.near_classes(named, SHINGLE_WORDS, PERCENT, doc_id="key").where("doc_id IS NOT NULL").withColumnRenamed("doc_id", "key")
    if count:
        real = classes.join(several.select("key", F.col("doc_id").alias("real")), "key", "left").withColumn("real", F.coalesce("real", "key"))
        kept = real.groupBy("component_id").agg(F.min(F.struct("real", "key")).alias("least")).select("least.key")
    else:
        kept = classes.where("key = component_id").select("key")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    one = named.join(kept, "key").groupBy("key").agg(F.min(F.struct("text", "doc_id", *others)).alias("row"))
    return one.select("row.*").select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text."""
    clean = pii.find(docs, redact=True).drop("pii_spans")
    return clean.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long"))) if "n_chars" in docs.columns else clean


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source mix takes them: not at all, once or twice."""
    copies = stage(mixing.mix(docs).select("doc_id", "copies"), "mix-copies")
    return mixing.take(docs, copies)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document goes: doc_id, n_tokens (words and an end mark), bucket, bucket_len, batch_id, slot, padding."""
    rows = docs.select("doc_id", (word_count(F.col("text")) + 1).alias("words"))
    return packing.pack(rows, F.col("words")).drop("words")


STAGES = [
    ("language_id", language),
    ("jaccard_join", near_duplicates),
    ("pii", personal_data),
    ("mixing", source_mix),
    ("packing", packed),
]

ORACLE_SQL = None  # the language model, the draws of the mix and the dynamic program are not SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
