"""Queries on sources, sinks, profiles, schemas and drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessela.operators import profile, schema
from tessela.plans.fixtures import (
    LAKE,
    TABLES,
    WORDS,
    X1,
    X2,
    document_words,
    event_columns,
    lake_catalog,
    order_interactions,
    rounded,
    table,
)
from tessela.plans.registry import query
from tessela.session import scratch_path
from tessela.sources import readers, sinks

EVENT_SCHEMA = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


@query("a1_csv_scan", """
SELECT o_orderstatus, count(*) AS order_count, count(DISTINCT o_custkey) AS customers, round(sum(o_totalprice), 2) AS total
FROM orders GROUP BY 1""")
def a1(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "orders-csv")
    table(spark, sf_dir, "orders").write.option("header", True).csv(path)
    orders = readers.read_table(
        spark, path, "csv",
        schema="o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate TIMESTAMP, o_orderpriority STRING",
    )
    return orders.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("order_count"), F.count_distinct("o_custkey").alias("customers"),
        rounded(F.sum("o_totalprice"), 2).alias("total"))


@query("a2_json_scan", """
SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS conversations_seen, sum(len(text))::BIGINT AS characters
FROM conversations GROUP BY 1""")
def a2(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "conversations-json")
    sinks.write_json_documents(table(spark, sf_dir, "conversations"), path)
    rows = readers.read_table(spark, path, "json", schema="conv_id BIGINT, turn BIGINT, role STRING, text STRING")
    return rows.groupBy("role").agg(
        F.count(F.lit(1)).alias("turns"), F.count_distinct("conv_id").alias("conversations_seen"),
        F.sum(F.char_length("text")).alias("characters"))


@query("a3_jsonl_scan", f"""
WITH {X2} SELECT item_id, event_type, count(*) AS n, round(sum(value), 4) AS total FROM x2 GROUP BY 1, 2""")
def a3(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "events-jsonl")
    table(spark, sf_dir, "events").write.json(path)
    rows = event_columns(readers.read_table(spark, path, "jsonl", schema=EVENT_SCHEMA))
    return rows.groupBy("item_id", "event_type").agg(
        F.count(F.lit(1)).alias("n"), rounded(F.sum("value"), 4).alias("total"))


@query("a4_parquet_scan", """
SELECT l_returnflag, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1998-01-01 00:00:00' AND l_discount >= 0.05 GROUP BY 1""")
def a4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = readers.read_table(spark, f"{sf_dir}/lineitem.parquet", "parquet")
    kept = rows.where((F.col("l_shipdate") >= F.lit("1998-01-01 00:00:00").cast(rows.schema["l_shipdate"].dataType))
                      & (F.col("l_discount") >= 0.05))
    return kept.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), rounded(F.sum("l_extendedprice"), 2).alias("total"))


@query("a5_file_catalog", """
SELECT unnest(['region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events', 'documents', 'embeddings', 'pages', 'benchmark', 'labels',
  'conversations']) || '.parquet' AS file_name, 'parquet' AS file_type, true AS has_bytes""")
def a5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.file_catalog(spark, sf_dir, types=("parquet", "csv", "json", "jsonl")).select(
        "file_name", "file_type", (F.col("size_bytes") > 0).alias("has_bytes"))


@query("a6_landing", """
SELECT l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, round(sum(l_tax), 4) AS tax
FROM lineitem GROUP BY 1""")
def a6(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = readers.land(table(spark, sf_dir, "lineitem"), scratch_path(spark, "landing"), "lineitem.parquet")
    return spark.read.parquet(path).groupBy("l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("l_suppkey").alias("suppliers"),
        rounded(F.sum("l_tax"), 4).alias("tax"))


_SUMMARY = " UNION ALL ".join(
    f"SELECT '{t}' AS dataset, (SELECT count(*) FROM {t}) AS num_rows, "
    f"(SELECT count(*) FROM (DESCRIBE {t})) AS num_columns" for t in TABLES)


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.table_summary({t: table(spark, sf_dir, t) for t in TABLES})


@query("a7_ingest_manifest", f"""
SELECT count(*) AS total_files, sum(num_rows)::BIGINT AS total_rows, sum(num_columns)::BIGINT AS total_columns
FROM ({_SUMMARY})""")
def a7(spark: SparkSession, sf_dir: str) -> DataFrame:
    summaries = _summary(spark, sf_dir).withColumn("dataset", F.concat("dataset", F.lit(".parquet")))
    catalog = readers.file_catalog(spark, sf_dir, types=("parquet",))
    return readers.manifest_totals(readers.ingest_manifest(catalog, summaries, "landing"))


@query("a8_embedding_source", """
SELECT label, count(*) AS n, round(sum(list_sum(embedding::DOUBLE[])), 5) AS total, round(avg(embedding[1]::DOUBLE), 6) AS first_mean
FROM embeddings GROUP BY 1""")
def a8(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = table(spark, sf_dir, "embeddings")
    # the length of the arrays is part of the table's schema in the wide form
    dim = source.select(F.max(F.size("embedding")).alias("d")).first()["d"]
    wide = source.select(F.col("vec_id").alias("item_id"), *[F.col("embedding")[i].alias(f"dim_{i}") for i in range(dim)])
    packed = readers.read_embeddings(wide, "item_id")
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return packed.join(source.select(F.col("vec_id").alias("item_id"), "label"), "item_id").groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), rounded(F.sum(total), 5).alias("total"),
        rounded(F.avg(F.col("embedding")[0].cast("double"))).alias("first_mean"))


@query("a9_matrix_sink", f"""
WITH {X2} SELECT CAST(ts AS DATE)::VARCHAR AS day, count(*) AS n, round(sum(value), 4) AS total FROM x2 GROUP BY 1""")
def a9(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "matrix")
    sinks.write_matrix(event_columns(table(spark, sf_dir, "events")), path, "ts")
    return spark.read.parquet(path).groupBy(F.col("event_date").cast("string").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), rounded(F.sum("value"), 4).alias("total"))


@query("a10_feedback_source", f"""
WITH {X2} SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, count(DISTINCT item_id) AS items FROM x2 GROUP BY 1""")
def a10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_columns(readers.read_table(spark, sf_dir, "parquet", schema=EVENT_SCHEMA, glob="events.parquet"))
    return rows.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), F.count_distinct("item_id").alias("items"))


@query("a11_report_sink", """
SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1""")
def a11(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "report")
    report = table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), rounded(F.avg("value")).alias("mean_value"))
    sinks.write_report(report, path)
    return readers.read_table(spark, path, "jsonl", schema="event_type STRING, n BIGINT, mean_value DOUBLE")


@query("a12_export", """
SELECT 'orders' AS artifact, count(*) AS n FROM orders UNION ALL SELECT 'indices/embeddings', count(*) FROM embeddings""")
def a12(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = sinks.export(
        {"orders": table(spark, sf_dir, "orders"), "indices/embeddings": table(spark, sf_dir, "embeddings"),
         "config/unused": table(spark, sf_dir, "region")},
        {}, scratch_path(spark, "export"), include=("tables", "indices"))
    parts = [spark.read.parquet(p).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("artifact"), "n")
             for n, p in written.items()]
    return parts[0].unionByName(parts[1])


def _profile_sql(source: str, columns: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{t}' AS dtype, count(*) AS num_rows, count(*) FILTER ({c} IS NULL) AS null_count,
        round(count(*) FILTER ({c} IS NULL) * 100.0::DOUBLE / count(*), 2) AS null_pct,
        count(DISTINCT {c}) + max(({c} IS NULL)::INT) AS unique_count FROM {source}""" for c, t in columns.items())


LINEITEM_TYPES = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double",
    "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": "string",
    "l_linestatus": "string", "l_shipdate": "timestamp_ntz",
}


@query("b1_profile_columns", _profile_sql(
    "(SELECT * REPLACE (nullif(l_linenumber, 7) AS l_linenumber, nullif(l_returnflag, 'R') AS l_returnflag) FROM lineitem)",
    LINEITEM_TYPES))
def b1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumns({
        "l_linenumber": F.nullif("l_linenumber", F.lit(7)), "l_returnflag": F.nullif("l_returnflag", F.lit("R"))})
    return profile.profile_columns(rows)


@query("b2_numeric_stats", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(avg({c}), 5) AS mean,
    round(stddev_samp({c}), 5) AS std FROM lineitem""" for c, t in LINEITEM_TYPES.items() if t in ("int", "bigint", "double")))
def b2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.numeric_stats(table(spark, sf_dir, "lineitem")).select(
        "column", "min", "max", rounded("mean", 5).alias("mean"), rounded("std", 5).alias("std"))


@query("b3_string_stats", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", round(avg(length({c})), 6) AS avg_length, max(length({c})) AS max_length FROM documents"""
    for c in ("text", "lang", "source")))
def b3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.string_stats(table(spark, sf_dir, "documents")).select(
        "column", rounded("avg_length").alias("avg_length"), "max_length")


_FLAGS = """(SELECT quality = 1 AS is_good, toxic = 1 AS is_toxic, CASE WHEN quality = 1 THEN toxic = 0 END AS is_clean FROM labels)"""


@query("b4_boolean_stats", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) FILTER ({c}) AS true_count, count(*) FILTER (NOT {c}) AS false_count FROM {_FLAGS}"""
    for c in ("is_good", "is_toxic", "is_clean")))
def b4(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, toxic = F.col("quality") == 1, F.col("toxic") == 1
    flags = table(spark, sf_dir, "labels").select(
        good.alias("is_good"), toxic.alias("is_toxic"), F.when(good, F.col("toxic") == 0).alias("is_clean"))
    return profile.boolean_stats(flags)


_NULLS = " + ".join(f"({c} IS NULL)::INT" for c in LINEITEM_TYPES)


@query("b5_table_quality", f"""
WITH t AS (SELECT * REPLACE (nullif(l_returnflag, 'R') AS l_returnflag, nullif(l_tax, 0) AS l_tax) FROM lineitem),
     g AS (SELECT *, count(*) AS n FROM t GROUP BY ALL)
SELECT sum(n)::BIGINT AS num_rows, (sum(n) * {len(LINEITEM_TYPES)})::BIGINT AS total_cells,
       sum(n * ({_NULLS}))::BIGINT AS null_cells,
       round(sum(n * ({_NULLS})) / (sum(n) * {len(LINEITEM_TYPES)})::DOUBLE * 100, 2) AS null_pct,
       sum(n - 1)::BIGINT AS duplicate_rows FROM g""")
def b5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumns({
        "l_returnflag": F.nullif("l_returnflag", F.lit("R")), "l_tax": F.nullif("l_tax", F.lit(0.0))})
    return profile.profile_quality(rows)


@query("b6_lake_summary", f"""
SELECT count(*) AS total_datasets, sum(num_rows)::BIGINT AS total_rows, sum(num_columns)::BIGINT AS total_columns
FROM ({_SUMMARY})""")
def b6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.lake_summary(_summary(spark, sf_dir))


def _any(parts: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(lower(\"column\"), '{p}')" for p in parts) + ")"


_B7 = "CASE " + " ".join(f"WHEN {_any(p)} THEN '{k}'" for k, p in schema.FIRST_MATCH_TYPES) + " END"
_B8 = "CASE " + " ".join(f"WHEN {_any(p)} THEN '{k}'" for k, _, p in reversed(schema.LAST_MATCH_TYPES)) + " END"
_B8_CONFIDENCE = "greatest(" + ", ".join(
    f"CASE WHEN {_any(p)} THEN {s}::DOUBLE ELSE 0.5 END" for _, s, p in schema.LAST_MATCH_TYPES) + ")"


@query("b7_semantic_type", f"""
WITH {LAKE} SELECT dataset, "column", {_B7} AS semantic_type FROM lake""")
def b7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema.semantic_types(lake_catalog(spark, sf_dir)).select("dataset", "column", "semantic_type")


@query("b8_semantic_candidates", f"""
WITH {LAKE} SELECT dataset, "column", {_B8} AS candidate_type, {_B8_CONFIDENCE} AS confidence FROM lake
WHERE {_B8} IS NOT NULL""")
def b8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema.semantic_candidates(lake_catalog(spark, sf_dir)).select(
        "dataset", "column", "candidate_type", "confidence")


_B9 = "CASE " + " ".join(f"WHEN {_any(p)} THEN '{k}'" for k, p in schema.CONTENT_TYPES) + """
  WHEN dtype IN ('int', 'bigint', 'double') AND unique_count / num_rows::DOUBLE < 0.1 THEN 'CATEGORICAL_NUMERIC'
  WHEN dtype IN ('int', 'bigint', 'double') THEN 'NUMERIC' WHEN dtype = 'string' THEN 'TEXT' ELSE 'UNKNOWN' END"""
CUSTOMER_TYPES = {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"}


@query("b9_content_type", f"""
SELECT "column", dtype, {_B9} AS content_type
FROM ({_profile_sql('lineitem', LINEITEM_TYPES)} UNION ALL {_profile_sql('customer', CUSTOMER_TYPES)})""")
def b9(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = profile.profile_columns(table(spark, sf_dir, "lineitem")).unionByName(
        profile.profile_columns(table(spark, sf_dir, "customer")))
    return schema.content_types(profiles).select("column", "dtype", "content_type")


@query("b10_schema_fingerprint", f"""
WITH {LAKE} SELECT dataset, sha256(string_agg("column" || ':' || dtype, '|' ORDER BY ("column" || ':' || dtype))) AS fingerprint,
  substr(sha256(string_agg("column" || ':' || dtype, '|' ORDER BY ("column" || ':' || dtype))), 1, 32) AS schema_hash,
  count(*) AS column_count FROM lake GROUP BY dataset""")
def b10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema.schema_fingerprint(lake_catalog(spark, sf_dir))


def _language_catalog(words: DataFrame) -> DataFrame:
    return words.groupBy(F.col("lang").alias("dataset"), "column").agg(
        F.when(F.max("n") > 1, "array<string>").otherwise("string").alias("dtype"))


_LANG = """SELECT lang AS dataset, "column", CASE WHEN max(n) > 1 THEN 'array<string>' ELSE 'string' END AS dtype FROM"""


@query("b11_schema_drift", f"""
WITH {WORDS}, old AS ({_LANG} (SELECT * FROM words WHERE doc_id IN (SELECT doc_id FROM labels)) GROUP BY 1, 2),
  new AS ({_LANG} words GROUP BY 1, 2)
SELECT dataset, "column", old.dtype AS old_dtype, new.dtype AS new_dtype,
  CASE WHEN old.dtype IS NULL THEN 'added' WHEN new.dtype IS NULL THEN 'removed' ELSE 'retyped' END AS change
FROM old FULL OUTER JOIN new USING (dataset, "column") WHERE old.dtype IS DISTINCT FROM new.dtype""")
def b11(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = document_words(spark, sf_dir)
    labelled = words.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    return schema.schema_drift(_language_catalog(labelled), _language_catalog(words))


@query("b12_embedding_drift", """
WITH e AS (SELECT label, embedding::DOUBLE[] AS o, list_transform(embedding::DOUBLE[], lambda x: x * (1 + label / 10.0::DOUBLE) + 0.01::DOUBLE * label) AS n FROM embeddings),
  d AS (SELECT label, unnest(range(len(o))) AS i, unnest(o) AS o, unnest(n) AS n FROM e),
  m AS (SELECT label::VARCHAR AS label, i, avg(o) AS o, avg(n) AS n FROM d GROUP BY 1, 2
        UNION ALL SELECT 'all', i, avg(o), avg(n) FROM d GROUP BY i),
  c AS (SELECT label, 1 - sum(o * n) / (sqrt(sum(o * o)) * sqrt(sum(n * n))) AS drift FROM m GROUP BY 1)
SELECT label, round(drift, 6) AS drift, drift > 0.01 AS drifted FROM c""")
def b12(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "embeddings")
    new = old.withColumn("embedding", F.transform(
        F.col("embedding").cast("array<double>"), lambda x: x * (1 + F.col("label") / 10.0) + 0.01 * F.col("label")))
    return schema.embedding_drift(old, new, label="label", threshold=0.01).withColumn("drift", rounded("drift"))


def _document_quality(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("dataset").agg(
        F.sum("n").alias("num_rows"), rounded((1 - F.count(F.lit(1)) / F.sum("n")) * 100, 2).alias("null_pct"))


@query("b13_validation", f"""
WITH {LAKE}, q AS (
  SELECT dataset, sum(n) AS num_rows, round((1 - count(*) / sum(n)::DOUBLE) * 100, 2) AS null_pct,
    bool_or({_any(('user', 'uid'))}) AS u, bool_or({_any(('item', 'product'))}) AS i,
    bool_or({_any(('click', 'view', 'purchase', 'rating', 'score'))}) AS s FROM lake GROUP BY 1)
SELECT dataset, 'ERROR' AS level, 'INSUFFICIENT_ROWS' AS code FROM q WHERE num_rows < 100
UNION ALL SELECT dataset, 'WARNING', 'HIGH_NULL_PERCENTAGE' FROM q WHERE null_pct > 50
UNION ALL SELECT dataset, 'WARNING', 'NO_USER_ID' FROM q WHERE NOT u
UNION ALL SELECT dataset, 'WARNING', 'NO_ITEM_ID' FROM q WHERE NOT i
UNION ALL SELECT dataset, 'INFO', 'NO_INTERACTION_SIGNAL' FROM q WHERE NOT s""")
def b13(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = lake_catalog(spark, sf_dir)
    return schema.validate(catalog, _document_quality(catalog))


@query("b13_validity", f"""
WITH {LAKE}, q AS (
  SELECT dataset, sum(n) AS num_rows, round((1 - count(*) / sum(n)::DOUBLE) * 100, 2) AS null_pct,
    bool_or({_any(('user', 'uid'))}) AS u, bool_or({_any(('item', 'product'))}) AS i,
    bool_or({_any(('click', 'view', 'purchase', 'rating', 'score'))}) AS s FROM lake GROUP BY 1)
SELECT dataset, num_rows >= 100 AS is_valid,
  ((num_rows < 100)::INT + (null_pct > 50)::INT + (NOT u)::INT + (NOT i)::INT + (NOT s)::INT)::BIGINT AS issue_count FROM q""")
def b13_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = lake_catalog(spark, sf_dir)
    quality = _document_quality(catalog)
    return schema.dataset_validity(quality, schema.validate(catalog, quality))


@query("b14_domain_checks", """
WITH t AS (SELECT l_orderkey, l_shipdate AS ts, l_extendedprice AS price, l_quantity AS quantity, nullif(l_tax, 0) AS tax FROM lineitem),
  a AS (SELECT count(*) AS n, count(*) - count(tax) AS nulls, count(*) - count(DISTINCT l_orderkey) AS repeats,
        count(*) - count(ts) AS no_ts, count(*) FILTER (price <= 0) AS bad_price, count(*) FILTER (quantity <= 0) AS bad_quantity FROM t),
  c AS (SELECT 'min_rows' AS check_name, greatest(100000 - n, 0) AS failures FROM a
    UNION ALL SELECT 'max_null_ratio', CASE WHEN nulls / (n * 5)::DOUBLE > 0.02 THEN nulls ELSE 0 END FROM a
    UNION ALL SELECT 'unique_ids', repeats FROM a UNION ALL SELECT 'timestamps', no_ts FROM a
    UNION ALL SELECT 'positive_price', bad_price FROM a UNION ALL SELECT 'positive_quantity', bad_quantity FROM a)
SELECT check_name, failures::BIGINT AS failures, failures = 0 AS passed FROM c""")
def b14(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.col("l_shipdate").alias("ts"), F.col("l_extendedprice").alias("price"),
        F.col("l_quantity").alias("quantity"), F.nullif("l_tax", F.lit(0.0)).alias("tax"))
    return schema.domain_checks(rows, "l_orderkey", "ts", min_rows=100_000, max_null_ratio=0.02)


def _domain_sql(domain: str) -> str:
    required, optional = schema.DOMAIN_SCHEMAS[domain]
    rows = ", ".join(f"('{c}', {str(c in required).lower()})" for c in (*required, *optional))
    return f"""
WITH {LAKE}, w(wanted, required) AS (VALUES {rows})
SELECT d.dataset, wanted, required, EXISTS (SELECT 1 FROM lake l WHERE l.dataset = d.dataset AND l."column" = wanted) AS present
FROM (SELECT DISTINCT dataset FROM lake) d CROSS JOIN w"""


def _domain_query(domain: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return schema.schema_conformance(lake_catalog(spark, sf_dir), domain)

    return run


for _domain in schema.DOMAIN_SCHEMAS:
    _name = "b15_schema_conformance" if _domain == "ecommerce" else f"b15_conformance_{_domain.lower()}"
    query(_name, _domain_sql(_domain))(_domain_query(_domain))


_X1_TYPES = {"user_id": "bigint", "item_id": "bigint", "signal": "double", "ts": "timestamp", "session_id": "bigint", "category": "string",
             "brand": "string", "title": "string", "price": "double", "segment": "string", "line_no": "int", "supplier_id": "bigint", "amount": "double"}


@query("b16_feature_stats", f"WITH {X1} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", '{t}' AS dtype, count(*) FILTER ({c} IS NULL) AS null_count, count(DISTINCT {c}) AS unique_count, """
    + (f"min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(avg({c}), 5) AS mean" if t in ("int", "bigint", "double")
       else "NULL::DOUBLE AS min, NULL::DOUBLE AS max, NULL::DOUBLE AS mean") + " FROM x1" for c, t in _X1_TYPES.items()))
def b16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.feature_stats(order_interactions(spark, sf_dir)).withColumn("mean", rounded("mean", 5))
