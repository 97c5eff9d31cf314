"""Queries on role inference and business meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessela.operators import mapping, meaning, schema
from tessela.operators.ann import cosine_topk
from tessela.operators.probing import topk_above
from tessela.plans.fixtures import (
    FINE_PAIRS,
    FINE_ROWS,
    HYBRID,
    LAKE,
    MAPPED,
    RULE_SCORES,
    WORDS,
    X3,
    fine_pairs,
    hybrid_inputs,
    lake_catalog,
    mapped_lake,
    rounded,
    table,
    vector_table,
)
from tessela.plans.registry import query
from tessela.roles import (
    BOOST_RULES,
    BOOST_SYNONYMS,
    CONTEXT_BOOSTS,
    EXCLUSION_PATTERNS,
    KEYWORD_SYNONYMS,
    REQUIRED_ROLES,
    ROLE_SYNONYM_KEY,
)
from tessela.session import materialize

LAKE_BOOSTS = (("ea", "CONTEXTUAL", 0.2), ("the", "ITEM_FEATURE", 0.15), ("re", "CONTEXTUAL", 0.1), ("os", "CONTEXTUAL", 0.7))


def _scored(spark: SparkSession, sf_dir: str, keep_zero: bool = False) -> DataFrame:
    return mapping.rule_score(lake_catalog(spark, sf_dir), keep_zero=keep_zero)


@query("c1_rule_score", f"""
WITH {RULE_SCORES} SELECT dataset, "column", role, round(rule_score, 9) AS rule_score FROM scored WHERE rule_score > 0""")
def c1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("dataset", "column", "role", rounded("rule_score", 9).alias("rule_score"))


_BOOST_SUM = " + ".join(
    f"CASE WHEN role = '{r}' AND contains(lower(\"column\"), '{p}') THEN {v}::DOUBLE ELSE 0 END" for p, r, v in LAKE_BOOSTS)


@query("c2_keyword_boost", f"""
WITH {RULE_SCORES} SELECT dataset, "column", role, round(least(1, rule_score + {_BOOST_SUM}), 9) AS rule_score
FROM scored WHERE rule_score + {_BOOST_SUM} > 0""")
def c2(spark: SparkSession, sf_dir: str) -> DataFrame:
    boosted = mapping.keyword_boost(_scored(spark, sf_dir, keep_zero=True), LAKE_BOOSTS)
    return boosted.where(F.col("rule_score") > 0).select(
        "dataset", "column", "role", rounded("rule_score", 9).alias("rule_score"))


_CENTROIDS = """c AS (SELECT label, list(m ORDER BY i) AS c FROM (
    SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(range(len(v))) AS i, unnest(v) AS x FROM x3) GROUP BY 1, 2) GROUP BY 1)"""


@query("c3_embedding_score", f"""
WITH {X3}, {_CENTROIDS} SELECT vec_id, 'label_' || c.label::VARCHAR AS role,
  round((list_inner_product(v, c) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(c, c))) + 1) / 2, 6) AS embedding_score
FROM x3 CROSS JOIN c""")
def c3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vector_table(spark, sf_dir, "vec_id")
    means = schema._mean_vectors(rows, "vector", "label").where(F.col("label") != "all")
    roles = means.select(F.concat(F.lit("label_"), "label").alias("role"), F.col("mean").alias("role_vector"))
    return mapping.embedding_score(rows.select("vec_id", "vector"), roles).select(
        "vec_id", "role", rounded("embedding_score").alias("embedding_score"))


@query("c4_hybrid_score", f"""
WITH {HYBRID} SELECT dataset, "column", role, round(score, 9) AS score FROM hybrid WHERE rule_score > 0""")
def c4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.hybrid_pairs(hybrid_inputs(_scored(spark, sf_dir))).select(
        "dataset", "column", "role", rounded("score", 9).alias("score"))


@query("c5_reason_text", f"""
WITH {HYBRID} SELECT dataset, "column", role, coalesce(nullif(concat_ws(', ',
    CASE WHEN r > 0.3 THEN 'rule-match:' || printf('%.2f', r) END, CASE WHEN e > 0.3 THEN 'semantic:' || printf('%.2f', e) END,
    CASE WHEN s > 0.3 THEN 'context:' || printf('%.2f', s) END), ''), 'low-confidence') AS reason
FROM hybrid WHERE rule_score > 0""")
def c5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.hybrid_pairs(hybrid_inputs(_scored(spark, sf_dir))).select("dataset", "column", "role", "reason")


@query("c6_top_roles", f"""
WITH {HYBRID} SELECT dataset, "column", role, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY dataset, "column" ORDER BY round(score, 9) DESC, role_ord) AS rank FROM hybrid)
WHERE rank <= 5""")
def c6(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = mapping.hybrid_pairs(hybrid_inputs(_scored(spark, sf_dir, keep_zero=True)))
    return mapping.top_roles(pairs.withColumn("score", rounded("score", 9)), 5).select(
        "dataset", "column", "role", F.col("rank").cast("long").alias("rank"))


_BEST = f"""{RULE_SCORES}, best AS (
  SELECT dataset, dataset_ord, "column", pos, role, 0.7::DOUBLE * rule_score AS confidence FROM (
    SELECT *, row_number() OVER (PARTITION BY dataset, "column" ORDER BY rule_score DESC, role_ord) AS rn FROM scored) WHERE rn = 1)"""


def _best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.map_columns(lake_catalog(spark, sf_dir)).select(
        "dataset", "dataset_ord", "column", "pos", "role", "confidence")


@query("c7_conflict_resolution", f"""
WITH {_BEST}, n AS (SELECT *,
    row_number() OVER (PARTITION BY role ORDER BY confidence DESC, dataset_ord, pos) AS g,
    row_number() OVER (PARTITION BY dataset, role ORDER BY confidence DESC, pos) AS l,
    first("column") OVER (PARTITION BY role ORDER BY confidence DESC, dataset_ord, pos) AS winner FROM best)
SELECT dataset, "column", role, round(confidence, 9) AS confidence,
  CASE WHEN role IN ('USER_ID', 'ITEM_ID') THEN CASE WHEN g = 1 THEN 'assigned' ELSE 'conflict_rejected' END
       WHEN l = 1 THEN 'assigned' ELSE 'duplicate' END AS status,
  CASE WHEN role IN ('USER_ID', 'ITEM_ID') AND g > 1 THEN winner END AS conflict_with FROM n""")
def c7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.resolve_conflicts_globally(_best(spark, sf_dir)).select(
        "dataset", "column", "role", rounded("confidence", 9).alias("confidence"), "status", "conflict_with")


_PATTERN_SQL = " + ".join(
    f"CASE WHEN role = '{r}' AND regexp_matches(\"column\", '(?i)^(?:{p})') THEN {v}::DOUBLE ELSE 0 END"
    for p, r, v in (*BOOST_RULES, ("th.*", "VIEW", 0.2), ("re", "CLICK", 0.15)))
LAKE_RULES = (*BOOST_RULES, ("th.*", "VIEW", 0.2), ("re", "CLICK", 0.15))


@query("c8_pattern_boost", f"""
WITH {FINE_PAIRS} SELECT "column", role, round({_PATTERN_SQL}, 9) AS boost FROM pairs WHERE {_PATTERN_SQL} > 0""")
def c8(spark: SparkSession, sf_dir: str) -> DataFrame:
    boosted = fine_pairs(spark, sf_dir).withColumn("boost", mapping.pattern_boost(F.col("column"), F.col("role"), LAKE_RULES))
    return boosted.where(F.col("boost") > 0).select("column", "role", rounded("boost", 9).alias("boost"))


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_SYNONYM_SQL = "CASE role " + " ".join(
    f"WHEN '{r}' THEN least(0.2::DOUBLE, 0.05::DOUBLE * len(list_filter({_list(BOOST_SYNONYMS[k])}, lambda s: contains(lower(\"column\"), s))))"
    for r, k in ROLE_SYNONYM_KEY.items()) + " ELSE 0 END + CASE WHEN role IN ('USER_ID', 'ITEM_ID') THEN 0.1::DOUBLE ELSE 0 END"


@query("c9_synonym_boost", f"""
WITH {FINE_PAIRS} SELECT role, round({_SYNONYM_SQL}, 9) AS boost, count(*) AS columns_hit, min("column") AS first_column
FROM pairs GROUP BY 1, 2""")
def c9(spark: SparkSession, sf_dir: str) -> DataFrame:
    boosted = fine_pairs(spark, sf_dir).withColumn(
        "boost", rounded(mapping.synonym_boost(F.col("column"), F.col("role")), 9))
    return boosted.groupBy("role", "boost").agg(F.count(F.lit(1)).alias("columns_hit"), F.min("column").alias("first_column"))


_ALL_SYNONYMS = _list(w for g in BOOST_SYNONYMS.values() for w in g)
_RULE_REASONS = "list_filter([" + ", ".join(
    f"CASE WHEN role = '{r}' AND regexp_matches(\"column\", '(?i)^(?:{p})') THEN 'rule:{p}' END" for p, r, _ in LAKE_RULES
) + "], lambda x: x IS NOT NULL)"
_REASONS = (f"array_to_string(list_concat({_RULE_REASONS}, list_transform(list_filter({_ALL_SYNONYMS}, "
            "lambda s: contains(lower(\"column\"), s)), lambda s: 'synonym:' || s)), ', ')")


@query("c10_boost_reasons", f"""
WITH {FINE_PAIRS} SELECT * FROM (SELECT "column", role, {_REASONS} AS reasons FROM pairs) WHERE reasons <> ''""")
def c10(spark: SparkSession, sf_dir: str) -> DataFrame:
    reasons = F.array_join(mapping.boost_reasons(F.col("column"), F.col("role"), LAKE_RULES), ", ")
    return fine_pairs(spark, sf_dir).select("column", "role", reasons.alias("reasons")).where(F.col("reasons") != "")


@query("c11_exclusion", f"""
WITH {LAKE} SELECT dataset, count(*) AS kept, min("column") AS first_column FROM lake
WHERE NOT regexp_matches("column", '(?i)^(?:{"|".join((*EXCLUSION_PATTERNS, "the.*"))})') GROUP BY 1""")
def c11(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = mapping.drop_excluded(lake_catalog(spark, sf_dir), (*EXCLUSION_PATTERNS, "the.*"))
    return kept.groupBy("dataset").agg(F.count(F.lit(1)).alias("kept"), F.min("column").alias("first_column"))


_CONTEXT_SQL = " + ".join(
    f"CASE WHEN dataset_type = '{k}' AND role = '{r}' AND contains(lower(\"column\"), '{p}') THEN 0.1::DOUBLE ELSE 0 END"
    for k, r, p in CONTEXT_BOOSTS)


@query("c12_context_boost", f"""
WITH {FINE_PAIRS}, t AS (SELECT *, CASE WHEN n_docs > 1 THEN 'ecommerce' ELSE 'media' END AS dataset_type FROM pairs)
SELECT dataset_type, role, count(*) AS n, round(sum({_CONTEXT_SQL}), 6) AS boost FROM t GROUP BY 1, 2""")
def c12(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = fine_pairs(spark, sf_dir).withColumn(
        "dataset_type", F.when(F.col("n_docs") > 1, "ecommerce").otherwise("media"))
    boost = mapping.context_boost(F.col("column"), F.col("role"), F.col("dataset_type"))
    return typed.groupBy("dataset_type", "role").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum(boost)).alias("boost"))


_TOTAL_BOOST = f"({_PATTERN_SQL} + {_SYNONYM_SQL})"


def _boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, role = F.col("column"), F.col("role")
    boost = mapping.pattern_boost(name, role, LAKE_RULES) + mapping.synonym_boost(name, role)
    return fine_pairs(spark, sf_dir).withColumn(
        "confidence", rounded(mapping.apply_boost(F.col("confidence"), boost), 9))


@query("c13_apply_boost", f"""
WITH {FINE_PAIRS} SELECT role, round(sum(c), 3) AS total, max(c) AS highest, count(*) FILTER (c >= 1) AS capped FROM (
  SELECT role, round(least(1, confidence * (1 + {_TOTAL_BOOST})), 9) AS c FROM pairs) GROUP BY 1""")
def c13(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("confidence")
    return _boosted(spark, sf_dir).groupBy("role").agg(
        rounded(F.sum(c), 3).alias("total"), F.max(c).alias("highest"), F.count_if(c >= 1).alias("capped"))


_SECOND = "((n_docs * 17 + len(\"column\") * 5 + role_ord * 29) % 103) / 103.0::DOUBLE"


def _with_second(spark: SparkSession, sf_dir: str) -> DataFrame:
    second = ((F.col("n_docs") * 17 + F.char_length("column") * 5 + F.col("role_ord") * 29) % 103) / 103.0
    return fine_pairs(spark, sf_dir).withColumn("second", second)


@query("c14_second_scorer", f"""
WITH {FINE_PAIRS}, p AS (SELECT *, {_SECOND} AS s FROM pairs),
  n AS (SELECT *, min(s) OVER (PARTITION BY role) AS lo, max(s) OVER (PARTITION BY role) AS hi FROM p)
SELECT role, round(sum(0.4::DOUBLE * confidence + 0.6::DOUBLE * s), 3) AS blended,
  round(sum(0.3::DOUBLE * confidence + 0.7::DOUBLE * s), 3) AS adjusted,
  round(sum(CASE WHEN hi = lo THEN 0.5 ELSE (s - lo) / (hi - lo) END), 3) AS normalized, count(*) FILTER (s >= 0.5) AS valid
FROM n GROUP BY 1""")
def c14(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = F.col("confidence"), F.col("second")
    return mapping.normalize_scores(_with_second(spark, sf_dir), "second", "role", "normalized").groupBy("role").agg(
        rounded(F.sum(mapping.blend_scores(c, s)), 3).alias("blended"),
        rounded(F.sum(mapping.adjusted_confidence(c, s)), 3).alias("adjusted"),
        rounded(F.sum("normalized"), 3).alias("normalized"), F.count_if(s >= 0.5).alias("valid"))


_BEST_FINE = f"""{FINE_PAIRS}, chosen AS (SELECT "column", role, confidence FROM (
    SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY confidence DESC, role_ord) AS rn FROM pairs WHERE confidence >= 0.5)
  WHERE rn = 1)"""


@query("c15_best_above", f"""WITH {_BEST_FINE} SELECT "column", role, confidence FROM chosen""")
def c15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.best_above(fine_pairs(spark, sf_dir)).select("column", "role", "confidence")


def _walk_sql(order: str, edges: str) -> str:
    """Again and again the first edge in order whose column and role are both free."""
    return f"""numbered AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY {order}) AS rn FROM {edges}),
  walk AS (
    SELECT []::VARCHAR[] AS cols, []::VARCHAR[] AS roles, NULL::VARCHAR AS c, NULL::VARCHAR AS r, NULL::DOUBLE AS f
    UNION ALL
    SELECT list_append(cols, e."column"), list_append(roles, e.role), e."column", e.role, e.confidence
    FROM (SELECT w.cols, w.roles, min(n.rn) AS rn FROM walk w JOIN numbered n
            ON NOT list_contains(w.cols, n."column") AND NOT list_contains(w.roles, n.role) GROUP BY 1, 2) JOIN numbered e USING (rn))
  SELECT c AS "column", r AS role, f AS confidence FROM walk WHERE c IS NOT NULL"""


@query("c16_assign_one_to_one", f"""
WITH RECURSIVE {FINE_PAIRS},
{_walk_sql('confidence DESC, "column", role', 'pairs')}""")
def c16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.assign_one_to_one(fine_pairs(spark, sf_dir))


@query("c16b_assign_by_column", f"""
WITH RECURSIVE {FINE_PAIRS}, b AS (SELECT *, max(confidence) OVER (PARTITION BY "column") AS best FROM pairs),
{_walk_sql('best DESC, "column", confidence DESC, role', 'b')}""")
def c16b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.assign_by_column(fine_pairs(spark, sf_dir))


@query("c17_best_per_role", f"""
WITH {_BEST_FINE}, w AS (SELECT *, first("column") OVER (PARTITION BY role ORDER BY confidence DESC, "column") AS winner FROM chosen)
SELECT "column", role, confidence, "column" = winner AS is_winner, CASE WHEN "column" <> winner THEN winner END AS lost_to FROM w""")
def c17(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = mapping.best_above(fine_pairs(spark, sf_dir)).select("column", "role", "confidence")
    return mapping.best_per_role(chosen)


@query("c18_missing_roles", f"""
WITH {WORDS}, pos AS (SELECT "column", CASE WHEN max(n) > 2 THEN 'ITEM_ID' ELSE 'PRICE' END AS role, 0.75::DOUBLE AS confidence FROM words GROUP BY 1)
SELECT "column", role, confidence, false AS missing_required FROM pos
UNION ALL SELECT NULL, r, 0.0::DOUBLE, true FROM (SELECT unnest({_list(REQUIRED_ROLES)}) AS r) WHERE r NOT IN (SELECT role FROM pos)""")
def c18(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = lake_catalog(spark, sf_dir).groupBy("column").agg(
        F.when(F.max("n") > 2, "ITEM_ID").otherwise("PRICE").alias("role"), F.lit(0.75).alias("confidence"))
    return mapping.add_missing_roles(lake)


@query("c19_global_confidence", f"""
WITH {_BEST_FINE}, o(role, i, c, s) AS {FINE_ROWS}
SELECT round(sum(confidence / (i + 1)) / sum(1.0::DOUBLE / (i + 1)), 6) AS global_confidence FROM chosen JOIN o USING (role)""")
def c19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.global_confidence(mapping.best_above(fine_pairs(spark, sf_dir))).select(
        rounded("global_confidence").alias("global_confidence"))


@query("c20_reasoning_text", f"""
WITH {FINE_PAIRS}, w AS (SELECT *, "column" = first("column") OVER (PARTITION BY role ORDER BY confidence DESC, "column") AS won FROM pairs)
SELECT role, concat_ws('; ', CASE WHEN confidence >= 0.8 THEN 'High semantic similarity' WHEN confidence >= 0.5 THEN 'Moderate semantic match'
    ELSE 'Low confidence - review recommended' END, CASE WHEN role_ord < 5 THEN 'High-priority role (' || role || ')' END,
    CASE WHEN won THEN 'Won conflict against other columns for ' || role END) AS summary, count(*) AS n FROM w GROUP BY 1, 2""")
def c20(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = mapping.best_per_role(fine_pairs(spark, sf_dir).select("column", "role", "confidence"))
    text = mapping.reasoning_summary(F.col("role"), F.col("confidence"), F.col("is_winner"))
    return marked.groupBy("role", text.alias("summary")).agg(F.count(F.lit(1)).alias("n"))


@query("c21_first_spelling", f"""
WITH {LAKE} SELECT lower("column") AS name, dataset, "column", dtype FROM (
  SELECT *, row_number() OVER (PARTITION BY lower("column") ORDER BY dataset_ord, pos) AS rn FROM lake) WHERE rn = 1""")
def c21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.first_spelling(lake_catalog(spark, sf_dir))


@query("c22_confidence_bands", f"""
WITH {MAPPED} SELECT count(*) FILTER (confidence >= 0.8) AS high, count(*) FILTER (confidence >= 0.5 AND confidence < 0.8) AS medium,
  count(*) FILTER (confidence < 0.5) AS low FROM mapped""")
def c22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.confidence_bands(mapped_lake(spark, sf_dir))


_EXPANDED = "list_concat([word], " + ", ".join(
    f"CASE WHEN contains('{k}', lower(word)) OR contains(lower(word), '{k}') THEN {_list(v)} ELSE []::VARCHAR[] END"
    for k, v in KEYWORD_SYNONYMS.items()) + ")"


@query("c23_synonym_expansion", f"""
WITH {WORDS}, d AS (SELECT DISTINCT "column" AS word FROM words)
SELECT word, unnest(range(len(l)))::INTEGER AS ord, unnest(l) AS synonym FROM (SELECT word, {_EXPANDED} AS l FROM d)""")
def c23(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = lake_catalog(spark, sf_dir).select(F.col("column").alias("word")).distinct()
    return mapping.expand_synonyms(words)


@query("c24_cosine_topk", f"""
WITH {X3}, {_CENTROIDS}, s AS (
  SELECT vec_id AS query_id, label AS id, round(list_inner_product(v, list_transform(c, lambda x: x / n)), 9) AS score
  FROM x3 CROSS JOIN (SELECT *, sqrt(list_inner_product(c, c)) AS n FROM c))
SELECT query_id, id, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 5""".replace(
    "x3 CROSS JOIN (SELECT *, sqrt", "(SELECT vec_id, label AS l, v FROM x3) CROSS JOIN (SELECT *, sqrt"))
def c24(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cosine_topk(*_rows_and_means(spark, sf_dir), 5).withColumns({"score": rounded("score"), "rank": F.col("rank").cast("long")})


def _rows_and_means(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = vector_table(spark, sf_dir, "vec_id")
    means = schema._mean_vectors(rows, "vector", "label").where(F.col("label") != "all")
    targets = means.select(F.col("label").try_cast("int").alias("id"), F.col("mean").alias("vector"))
    return rows.select(F.col("vec_id").alias("query_id"), "vector"), targets


@query("c24_cosine_matches", f"""
WITH {X3}, s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_inner_product(a.v, b.v), 9) AS score FROM x3 a JOIN x3 b ON a.vec_id <> b.vec_id)
SELECT query_id, id, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s WHERE score >= 0.4) WHERE rank <= 5""")
def c24_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vector_table(spark, sf_dir, "vec_id")
    queries, base = (rows.select(F.col("vec_id").alias(c), "vector") for c in ("query_id", "id"))
    return topk_above(queries, base, 0.4, 5, exclude_self=True).withColumns({"score": rounded("score"), "rank": F.col("rank").cast("long")})


@query("d1_role_class", f"""
WITH {MAPPED} SELECT dataset, "column", role, classification, side FROM classified""")
def d1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meaning.classify(mapped_lake(spark, sf_dir)).select("dataset", "column", "role", "classification", "side")


@query("d2_role_predicates", f"""
WITH {MAPPED} SELECT kind, count(*) AS n, count(DISTINCT "column") AS names FROM (
  SELECT 'identity' AS kind, "column" FROM classified WHERE classification = 'IDENTITY' UNION ALL
  SELECT 'signal', "column" FROM classified WHERE classification = 'SIGNAL' UNION ALL
  SELECT 'feature', "column" FROM classified WHERE classification = 'FEATURE' UNION ALL
  SELECT 'ambiguous', "column" FROM classified WHERE confidence < 0.5) GROUP BY 1""")
def d2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = meaning.classify(mapped_lake(spark, sf_dir))
    # the texts are read once; a name with like answers is one row with their number
    rows = materialize(rows.groupBy("column", "classification", "is_ambiguous").agg(F.count(F.lit(1)).alias("n")), "classes")
    kinds = {"identity": meaning.identities, "signal": meaning.signals, "feature": meaning.features, "ambiguous": meaning.ambiguous}
    parts = [pick(rows).select(F.lit(k).alias("kind"), "column", "n") for k, pick in kinds.items()]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union.groupBy("kind").agg(F.sum("n").alias("n"), F.count_distinct("column").alias("names"))


@query("d3_role_buckets", f"""
WITH {_BEST}, k(bucket) AS (VALUES ('IDENTITY'), ('SIGNAL'), ('FEATURE'), ('EVENT'), ('SESSION'), ('TEMPORAL'), ('CONTEXTUAL')),
  m(role, bucket) AS (VALUES {", ".join(f"('{r}', '{b}')" for r, b in meaning.ROLE_BUCKETS.items())})
SELECT k.bucket, count(best.role) AS columns FROM k LEFT JOIN m ON m.bucket = k.bucket LEFT JOIN best ON best.role = m.role GROUP BY 1""")
def d3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meaning.bucket_counts(_best(spark, sf_dir))


_NODES = f"""{MAPPED}, typed AS (SELECT *, CASE WHEN role IN ('USER_ID', 'USER_AGE', 'USER_GENDER', 'USER_LOCATION') THEN 'user'
    WHEN role IN ('ITEM_ID', 'ITEM_CATEGORY', 'ITEM_TITLE', 'ITEM_DESCRIPTION') THEN 'item'
    WHEN role IN ('CLICK', 'VIEW', 'PURCHASE', 'RATING', 'INTERACTION_EVENT', 'ENGAGEMENT_SIGNAL', 'IMPRESSION') THEN 'interaction'
    WHEN role = 'SESSION_ID' THEN 'session' ELSE 'feature' END AS kind FROM mapped),
  pu AS (SELECT "column" AS u FROM typed WHERE kind = 'user' ORDER BY dataset_ord, pos LIMIT 1),
  pi AS (SELECT "column" AS i FROM typed WHERE kind = 'item' ORDER BY dataset_ord, pos LIMIT 1)"""


@query("d4_entity_graph", f"""
WITH {_NODES}, e AS (
  SELECT u AS source, i AS target, "column" AS via, 'interaction' AS type FROM typed, pu, pi WHERE kind = 'interaction'
  UNION ALL SELECT u, "column", NULL, 'belongs_to' FROM typed, pu, pi WHERE kind = 'session'
  UNION ALL SELECT u, "column", NULL, 'has_feature' FROM typed, pu WHERE kind = 'feature' AND regexp_matches(lower("column"), 'user|customer|member')
  UNION ALL SELECT i, "column", NULL, 'has_feature' FROM typed, pi WHERE kind = 'feature' AND regexp_matches(lower("column"), 'item|product|content')
    AND NOT regexp_matches(lower("column"), 'user|customer|member'))
SELECT source, target, via, type, count(*) AS n FROM e GROUP BY ALL""")
def d4(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = meaning.graph_edges(meaning.graph_nodes(mapped_lake(spark, sf_dir)))
    return edges.groupBy("source", "target", "via", "type").agg(F.count(F.lit(1)).alias("n"))


@query("d4_graph_summary", f"""
WITH {_NODES} SELECT count(*) AS total_nodes, count(*) FILTER (kind = 'user') AS user_count, count(*) FILTER (kind = 'item') AS item_count,
  count(*) FILTER (kind = 'interaction') AS interaction_count, count(*) FILTER (kind = 'session') AS session_count,
  count(*) FILTER (kind = 'feature') AS feature_count FROM typed""")
def d4_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meaning.graph_summary(meaning.graph_nodes(mapped_lake(spark, sf_dir)))


_CATALOG = f"""{MAPPED}, cat AS (SELECT *, CASE WHEN side = 'user' THEN 'user_features'
    WHEN side = 'interaction' AND classification = 'SIGNAL' THEN 'target_variables' WHEN side = 'interaction' THEN 'interaction_features'
    WHEN side = 'context' THEN 'context_features' ELSE 'item_features' END AS section FROM classified)"""


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meaning.feature_catalog(meaning.classify(mapped_lake(spark, sf_dir)))


@query("d5_feature_catalog", f"WITH {_CATALOG} SELECT section, count(*) AS features FROM cat GROUP BY 1")
def d5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meaning.catalog_counts(_catalog(spark, sf_dir))


@query("d6_processing_hints", f"""
WITH {_CATALOG}, own AS (SELECT * FROM cat WHERE section IN ('user_features', 'item_features', 'context_features'))
SELECT 'categorical_features' AS hint, dataset, "column" FROM own WHERE regexp_matches(lower(dtype), 'str|utf8|string|object|category')
UNION ALL SELECT 'numerical_features', dataset, "column" FROM own WHERE regexp_matches(lower(dtype), 'int|float|double')
UNION ALL SELECT 'temporal_features', dataset, "column" FROM own WHERE regexp_matches(lower("column"), 'date|time|timestamp')
UNION ALL SELECT 'embedding_candidates', dataset, "column" FROM own WHERE regexp_matches(lower("column"), 'title|description|text|content|name')""")
def d6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meaning.processing_hints(_catalog(spark, sf_dir))


@query("d7_minimum_requirements", f"""
WITH {MAPPED} SELECT u AS has_user_id, i AS has_item_id, s AS has_interaction, u AND i AND s AS is_valid FROM (
  SELECT bool_or(role = 'USER_ID') AS u, bool_or(role = 'ITEM_ID') AS i, bool_or(classification = 'SIGNAL') AS s FROM classified)""")
def d7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meaning.minimum_requirements(meaning.classify(mapped_lake(spark, sf_dir)))


@query("d7_catalog_validation", f"""
WITH {_CATALOG} SELECT 'warning' AS level, 'Duplicate feature name: ' || "column" AS message FROM cat
WHERE section <> 'target_variables' GROUP BY "column" HAVING count(*) > 1""")
def d7_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meaning.validate_catalog(_catalog(spark, sf_dir))


_ENTITY = "CASE role WHEN 'USER_ID' THEN 'user_id' WHEN 'ITEM_ID' THEN 'item_id' WHEN 'INTERACTION_SIGNAL' THEN 'interaction_signal' END"


@query("d8_entity_mapping", f"""
WITH {_BEST}, f AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY dataset_ord, pos) AS rn FROM best)
SELECT {_ENTITY} AS entity, dataset, "column" FROM f WHERE role IN ('USER_ID', 'ITEM_ID', 'INTERACTION_SIGNAL') AND rn = 1
UNION ALL SELECT lower(role), dataset, "column" FROM f WHERE role IN ('TEMPORAL', 'SESSION', 'CONTEXTUAL')""")
def d8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meaning.entity_mapping(_best(spark, sf_dir))


@query("d9_review_queue", f"""
WITH {MAPPED} SELECT dataset, "column", role,
  CASE WHEN confidence < 0.5 THEN 'skipped' WHEN confidence >= 0.9 THEN 'auto_accepted' ELSE 'needs_review' END AS review
FROM classified WHERE is_ambiguous OR confidence < 0.95""")
def d9(spark: SparkSession, sf_dir: str) -> DataFrame:
    waiting = meaning.review_queue(meaning.classify(mapped_lake(spark, sf_dir)), 0.95)
    return meaning.review_status(waiting).select("dataset", "column", "role", "review")


_FIXES = """fixes AS (SELECT dataset, "column", 'PRICE' AS corrected_role FROM lake JOIN labels ON dataset_ord = labels.doc_id
  WHERE toxic = 1 AND n > 2)"""


@query("d10_corrections", f"""
WITH {MAPPED}, {_FIXES} SELECT dataset, "column", coalesce(corrected_role, role) AS role,
  CASE WHEN corrected_role IS NOT NULL THEN 1.0::DOUBLE ELSE confidence END AS confidence, corrected_role IS NOT NULL AS corrected
FROM mapped LEFT JOIN fixes USING (dataset, "column")""")
def d10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meaning.apply_corrections(mapped_lake(spark, sf_dir), _fixes(spark, sf_dir)).select(
        "dataset", "column", "role", "confidence", "corrected")


def _fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    # only texts that have corrections are cut into words
    toxic = table(spark, sf_dir, "labels").where(F.col("toxic") == 1).select("doc_id")
    return lake_catalog(spark, sf_dir, toxic).where(F.col("n") > 2).select(
        "dataset", "column", F.lit("PRICE").alias("corrected_role"))


@query("d10_correction_summary", f"""
WITH {MAPPED}, {_FIXES} SELECT count(*) AS total, count(corrected_role) AS corrected, round(count(corrected_role) / count(*)::DOUBLE, 9) AS correction_rate
FROM mapped LEFT JOIN fixes USING (dataset, "column")""")
def d10_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = meaning.apply_corrections(mapped_lake(spark, sf_dir), _fixes(spark, sf_dir))
    return meaning.correction_summary(fixed).withColumn("correction_rate", rounded("correction_rate", 9))
