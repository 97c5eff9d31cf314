"""Interaction tables, vectors and column catalogs derived from the given tables, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessela.functions import vectors
from tessela.roles import COLUMN_ROLES, FINE_ROLES, Roles

AS_OF = "2024-02-01 00:00:00"
AS_OF_ORDERS = "2001-09-01 00:00:00"

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)

TIEBREAK = ("session_id", "line_no", "item_id", "supplier_id", "signal", "amount")
ORDER_ROLES = Roles(session="session_id", tiebreak=TIEBREAK)
EVENT_ROLES = Roles(signal="value", tiebreak=("event_id",))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def order_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases with session and attributes: user, item, quantity, time."""
    lineitem, orders, part, customer = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "part", "customer"))
    return (
        lineitem.join(orders, lineitem.l_orderkey == orders.o_orderkey)
        .join(part, lineitem.l_partkey == part.p_partkey)
        .join(customer, orders.o_custkey == customer.c_custkey)
        .select(
            F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"), F.col("l_quantity").alias("signal"),
            F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("l_orderkey").alias("session_id"),
            F.col("p_type").alias("category"), F.col("p_brand").alias("brand"), F.col("p_name").alias("title"),
            F.col("p_retailprice").alias("price"), F.col("c_mktsegment").alias("segment"),
            F.col("l_linenumber").alias("line_no"), F.col("l_suppkey").alias("supplier_id"),
            F.col("l_extendedprice").alias("amount"),
        )
    )


X1 = """x1 AS (
  SELECT o_custkey AS user_id, l_partkey AS item_id, l_quantity AS signal, CAST(o_orderdate AS TIMESTAMP) AS ts,
         l_orderkey AS session_id, p_type AS category, p_brand AS brand, p_name AS title, p_retailprice AS price,
         c_mktsegment AS segment, l_linenumber AS line_no, l_suppkey AS supplier_id, l_extendedprice AS amount
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
                JOIN customer ON o_custkey = c_custkey)"""


def event_columns(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id", "user_id", F.get_json_object("props", "$.k").cast("long").alias("item_id"), "event_type", "value",
        F.col("ts").cast("timestamp").alias("ts"),
    )


def event_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Implicit feedback: clicks, views, purchases and events without weight."""
    return event_columns(table(spark, sf_dir, "events"))


X2 = """x2 AS (
  SELECT event_id, user_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS item_id, event_type, value,
         CAST(ts AS TIMESTAMP) AS ts FROM events)"""

K1 = f"""{X2}, wt(event_type, w, d) AS (VALUES ('click', 1.0::DOUBLE, 30.0::DOUBLE), ('view', 0.5, 14.0),
    ('purchase', 5.0, 90.0), ('rating', 2.0, 60.0), ('dwell_time', 1.5, 30.0)),
  k1 AS (SELECT x2.*, w, w * exp(-greatest((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts)) / 86400000000.0::DOUBLE, 0) / d) AS weight
         FROM x2 JOIN wt USING (event_type))"""


def vector_table(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    """(key, vector, label) with unit vectors in double precision."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias(key), vectors.l2_normalize(F.col("embedding")).alias("vector"), "label")


X3 = """x3 AS (
  SELECT vec_id, label, list_transform(e, lambda x: x / CASE WHEN n > 0 THEN n ELSE 1 END) AS v
  FROM (SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS n
        FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)))"""


def _dataset_words(spark: SparkSession, sf_dir: str, ids: DataFrame | None = None) -> DataFrame:
    """``document_words`` with the name of the document's dataset, of the documents in ``ids`` (doc_id) if given.

    Texts are dealt by dataset before they are cut into words, so that neither this nor a later grouping within a dataset shuffles words.
    They are dealt to as many tasks as the session asks for and never to fewer: a task holds many times the size of its texts in words.
    """
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = table(spark, sf_dir, "documents")
    if ids is not None:
        docs = docs.join(ids, "doc_id", "left_semi")
    docs = docs.select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("dataset"), "doc_id", "lang", "source", "text").repartition(tasks, "dataset")
    words = docs.select("dataset", "doc_id", "lang", "source", F.posexplode(
        F.regexp_extract_all("text", F.lit("[A-Za-z_]+"), 0)).alias("pos", "column"))
    return words.groupBy("dataset", "doc_id", "lang", "source", "column").agg(
        F.min("pos").alias("pos"), F.count(F.lit(1)).alias("n"))


def document_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, column, pos, n): the distinct words of a document, first position and number of uses."""
    return _dataset_words(spark, sf_dir).drop("dataset")


WORDS = """words AS (
  SELECT doc_id, lang, source, w AS "column", min(i)::INTEGER AS pos, count(*) AS n
  FROM (SELECT doc_id, lang, source, unnest(l) AS w, unnest(range(len(l))) AS i
        FROM (SELECT doc_id, lang, source, regexp_extract_all(text, '[A-Za-z_]+') AS l FROM documents))
  GROUP BY ALL)"""


def lake_catalog(spark: SparkSession, sf_dir: str, ids: DataFrame | None = None) -> DataFrame:
    """A lake of very many small datasets: every document, or every one in ``ids``, is one and its distinct words are the column names."""
    return _dataset_words(spark, sf_dir, ids).select(
        "dataset", F.col("doc_id").alias("dataset_ord"), "column", "pos",
        F.when(F.col("n") > 1, "bigint").otherwise("string").alias("dtype"), "n",
    )


LAKE = f"""{WORDS}, lake AS (
  SELECT 'doc_' || doc_id::VARCHAR AS dataset, doc_id AS dataset_ord, "column", pos,
         CASE WHEN n > 1 THEN 'bigint' ELSE 'string' END AS dtype, n FROM words)"""


def _values(rows: list[str]) -> str:
    return "(VALUES " + ", ".join(rows) + ")"


ROLE_ROWS = _values([
    f"('{r.role}', {i}, {r.priority}, [{', '.join(repr(s) for s in r.synonyms)}])" for i, r in enumerate(COLUMN_ROLES)
])

RULE_SCORES = f"""{LAKE}, roles(role, role_ord, priority, synonyms) AS {ROLE_ROWS},
  scored AS (
    SELECT lake.*, role, role_ord,
      CASE WHEN lower("column") = lower(role) THEN 1.0::DOUBLE
           ELSE coalesce(list_max(list_transform(list_filter(synonyms, lambda s: contains(lower("column"), s)), lambda s: len(s)))
                / len("column")::DOUBLE * 0.9::DOUBLE * (1.0::DOUBLE - (priority - 1) * 0.1::DOUBLE), 0) END AS rule_score
    FROM lake CROSS JOIN roles)"""


def hybrid_inputs(scored: DataFrame) -> DataFrame:
    """Give the scored pairs an embedding score and a second score, both made from the word counts."""
    n, size = F.col("n"), F.char_length("column")
    return scored.withColumns({
        "embedding_score": ((n * 7 + size + F.col("role_ord")) % 5) / 5.0,
        "second_score": ((n + size * 3 + F.col("role_ord") * 2) % 7) / 7.0,
    })


HYBRID = f"""{RULE_SCORES}, inputs AS (
    SELECT *, ((n * 7 + len("column") + role_ord) % 5) / 5.0::DOUBLE AS e,
           ((n + len("column") * 3 + role_ord * 2) % 7) / 7.0::DOUBLE AS s, rule_score AS r FROM scored),
  hybrid AS (
    SELECT *, CASE WHEN r > 0 AND e > 0 THEN 0.4::DOUBLE * r + 0.4::DOUBLE * e + 0.2::DOUBLE * s
                   WHEN r > 0 THEN 0.7::DOUBLE * r + 0.3::DOUBLE * s
                   WHEN e > 0 THEN 0.7::DOUBLE * e + 0.3::DOUBLE * s ELSE greatest(r, e, s) END AS score FROM inputs)"""


def fine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(column, role, role_ord, n_docs, embedding_score, confidence): every distinct word against the twenty fine roles.

    The score stands for the output of an embedding model; it comes from the word's document count, length and role.
    """
    words = document_words(spark, sf_dir).groupBy("column").agg(F.count(F.lit(1)).alias("n_docs"))
    roles = F.array(*[F.struct(F.lit(r[0]).alias("role"), F.lit(i).alias("role_ord")) for i, r in enumerate(FINE_ROLES)])
    score = ((F.col("n_docs") * 37 + F.char_length("column") * 11 + F.col("role_ord") * 53) % 101) / 100.0
    return words.withColumn("r", F.explode(roles)).select("column", "n_docs", "r.role", "r.role_ord").withColumn(
        "embedding_score", score).withColumn("confidence", F.col("embedding_score"))


FINE_ROWS = _values([f"('{r}', {i}, '{c}', '{s}')" for i, (r, c, s) in enumerate(FINE_ROLES)])

FINE_PAIRS = f"""{WORDS}, fine(role, role_ord, classification, side) AS {FINE_ROWS},
  pairs AS (
    SELECT "column", n_docs, role, role_ord,
           ((n_docs * 37 + len("column") * 11 + role_ord * 53) % 101) / 100.0::DOUBLE AS confidence
    FROM (SELECT "column", count(*) AS n_docs FROM words GROUP BY 1) CROSS JOIN fine)"""


def mapped_lake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each lake column with one fine role and a confidence, as the mapping stage leaves it."""
    names = [r[0] for r in FINE_ROLES] + ["FREE_TEXT"]
    pick = (F.col("n") * 5 + F.char_length("column") * 3 + F.col("pos")) % len(names)
    confidence = ((F.col("n") * 13 + F.char_length("column") * 7 + F.col("pos") * 3) % 101) / 100.0
    return lake_catalog(spark, sf_dir).select(
        "dataset", "dataset_ord", "column", "pos", "dtype",
        F.element_at(F.array(*[F.lit(n) for n in names]), (pick + 1).cast("int")).alias("role"),
        confidence.alias("confidence"),
    )


_FINE_NAMES = ", ".join(f"'{r[0]}'" for r in FINE_ROLES) + ", 'FREE_TEXT'"

MAPPED = f"""{LAKE}, fine(role, role_ord, classification, side) AS {FINE_ROWS}, mapped AS (
  SELECT dataset, dataset_ord, "column", pos, dtype,
         ([{_FINE_NAMES}])[((n * 5 + len("column") * 3 + pos) % {len(FINE_ROLES) + 1} + 1)::INTEGER] AS role,
         ((n * 13 + len("column") * 7 + pos * 3) % 101) / 100.0::DOUBLE AS confidence FROM lake),
  classified AS (
    SELECT m.*, coalesce(f.classification, 'FEATURE') AS classification, coalesce(f.side, 'unknown') AS side,
           confidence < 0.5 AS is_ambiguous
    FROM mapped m LEFT JOIN fine f ON m.role = f.role)"""


def rounded(column: Column | str, digits: int = 6) -> Column:
    return F.round(column, digits)
