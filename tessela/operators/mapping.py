"""Which role does a column play: scores from names, vectors and a second scorer, and the choice among them.

Role vocabularies and rule lists are small configuration, so they enter the plan as literal arrays: scoring a catalog of
any size is a projection without a join or a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessela.functions import vectors
from tessela.roles import (
    BOOST_RULES,
    BOOST_SYNONYMS,
    COLUMN_ROLES,
    CONTEXT_BOOSTS,
    EXCLUSION_PATTERNS,
    FINE_ROLES,
    KEYWORD_SYNONYMS,
    REQUIRED_ROLES,
    ROLE_SYNONYM_KEY,
    TOP_PRIORITY_ROLES,
    RoleSpec,
)
from tessela.session import materialize

ID_ROLES = ("USER_ID", "ITEM_ID")


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _longest_synonym(lower: Column, spec: RoleSpec) -> Column:
    """Length of the longest synonym inside the name, by one pattern per length; null without a hit."""
    chain = F
    for length in sorted({len(s) for s in spec.synonyms}, reverse=True):
        chain = chain.when(lower.rlike("|".join(s for s in spec.synonyms if len(s) == length)), F.lit(length))
    return chain


def _with_name_scores(catalog: DataFrame, roles: Sequence[RoleSpec]) -> tuple[DataFrame, list[str]]:
    """Add one score column per role: 1 on the role's own name; else the longest synonym's share of the name, weighed by
    the priority; 0 without a hit. One pattern over all words lets the many names without any hit pass quickly."""
    words = sorted({s for spec in roles for s in spec.synonyms} | {spec.role.lower() for spec in roles})
    named = catalog.withColumn("__lower", F.lower("column"))
    named = named.withColumn("__hit", F.col("__lower").rlike("|".join(words)))
    lower, scores = F.col("__lower"), {}
    for i, spec in enumerate(roles):
        priority = 1.0 - (spec.priority - 1) * 0.1
        share = _longest_synonym(lower, spec) / F.char_length(lower) * 0.9 * F.lit(priority)
        scores[f"__rule_{i}"] = (
            F.when(~F.col("__hit"), F.lit(0.0)).when(lower == spec.role.lower(), F.lit(1.0))
            .otherwise(F.coalesce(share, F.lit(0.0)))
        )
    return named.withColumns(scores), list(scores)


def rule_score(catalog: DataFrame, roles: Sequence[RoleSpec] = COLUMN_ROLES, keep_zero: bool = False) -> DataFrame:
    """(catalog columns, role, role_ord, rule_score); pairs without any hit leave unless ``keep_zero``."""
    scored, names = _with_name_scores(catalog, roles)
    if not keep_zero:
        scored = scored.where("__hit")
    entries = F.array(*[
        F.struct(F.lit(spec.role).alias("role"), F.lit(i).alias("role_ord"), F.col(name).alias("rule_score"))
        for i, (spec, name) in enumerate(zip(roles, names))
    ])
    pairs = scored.withColumn("__s", F.explode(entries)).select(*catalog.columns, "__s.*")
    return pairs if keep_zero else pairs.where(F.col("rule_score") > 0)


def keyword_boost(pairs: DataFrame, boosts: Sequence[tuple[str, str, float]]) -> DataFrame:
    """Add the value of every (pattern, role, value) whose pattern is inside the name; a score is at most 1."""
    lower, role = F.lower(F.col("column")), F.col("role")
    added = sum(
        (F.when((role == target) & F.contains(lower, F.lit(pattern.lower())), F.lit(value)).otherwise(F.lit(0.0))
         for pattern, target, value in boosts),
        F.lit(0.0),
    )
    return pairs.withColumn(
        "rule_score", F.when(added > 0, F.least(F.lit(1.0), F.col("rule_score") + added)).otherwise(F.col("rule_score"))
    )


def embedding_score(columns: DataFrame, role_vectors: DataFrame, max_roles: int = 1000) -> DataFrame:
    """Cosine of each column vector with each role vector, mapped to [0, 1].

    The role table is configuration; its size is checked before its vectors become one literal of the plan.
    """
    rows = role_vectors.select("role", "role_vector").orderBy("role").limit(max_roles + 1).collect()
    if len(rows) > max_roles:
        raise ValueError(f"more than {max_roles} roles")
    known = F.array(*[
        F.struct(F.lit(r["role"]).alias("role"), F.lit([float(x) for x in r["role_vector"]]).alias("v")) for r in rows
    ])
    exploded = columns.withColumn("__r", F.explode(known))
    return exploded.select(
        *[c for c in columns.columns if c != "vector"], F.col("__r.role").alias("role"),
        ((vectors.cosine(F.col("vector"), F.col("__r.v")) + 1) / 2).alias("embedding_score"),
    )


def hybrid_score(rule: Column, embedding: Column, second: Column) -> Column:
    return (
        F.when((rule > 0) & (embedding > 0), 0.4 * rule + 0.4 * embedding + 0.2 * second)
        .when(rule > 0, 0.7 * rule + 0.3 * second)
        .when(embedding > 0, 0.7 * embedding + 0.3 * second)
        .otherwise(F.greatest(rule, embedding, second))
    )


def reason_text(rule: Column, embedding: Column, second: Column) -> Column:
    """The parts above 0.3 with two decimals, else ``low-confidence``."""
    parts = [
        F.when(score > 0.3, F.concat(F.lit(label), F.format_number(score, 2)))
        for label, score in (("rule-match:", rule), ("semantic:", embedding), ("context:", second))
    ]
    text = F.concat_ws(", ", *parts)
    return F.when(text != "", text).otherwise(F.lit("low-confidence"))


def hybrid_pairs(pairs: DataFrame) -> DataFrame:
    """Add score and reason; missing score columns count as 0."""
    def part(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0.0)) if name in pairs.columns else F.lit(0.0)

    rule, embedding, second = part("rule_score"), part("embedding_score"), part("second_score")
    return pairs.withColumn("score", hybrid_score(rule, embedding, second)).withColumn(
        "reason", reason_text(rule, embedding, second)
    )


def top_roles(pairs: DataFrame, k: int = 5, keys: Sequence[str] = ("dataset", "column")) -> DataFrame:
    """The k best roles of each column, ties in declaration order. A group has at most one row per role."""
    best = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("role_ord"))
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def map_columns(catalog: DataFrame, roles: Sequence[RoleSpec] = COLUMN_ROLES, k: int = 5) -> DataFrame:
    """Name-only mapping in one projection: best role, confidence, the k best roles and the reasons, without a shuffle.

    Role and confidence do not depend on the list of all roles, which is only made for those who read it.
    """
    scored, names = _with_name_scores(catalog, roles)
    entries, ranks = [], []
    for i, spec in enumerate(roles):
        rule = F.col(names[i])
        rank = [hybrid_score(rule, F.lit(0.0), F.lit(0.0)).alias("score"), F.lit(-i).alias("order"), F.lit(spec.role).alias("role")]
        ranks.append(F.struct(*rank))
        entries.append(F.struct(*rank, reason_text(rule, F.lit(0.0), F.lit(0.0)).alias("reason")))
    # without a hit all scores are 0 and the first role comes first
    first = F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("order"), F.lit(roles[0].role).alias("role"))
    best = F.when(F.col("__hit"), F.array_max(F.array(*ranks))).when(~F.col("__hit"), first).otherwise(F.array_max(F.array(*ranks)))
    # the one-element explode keeps later filters on the role from being pushed below and repeating the whole scoring
    ranked = scored.withColumn("__best", F.explode(F.array(best))).withColumn("__all", F.sort_array(F.array(*entries), asc=False))
    return ranked.select(
        *catalog.columns,
        F.col("__best")["role"].alias("role"),
        F.col("__best")["score"].alias("confidence"),
        F.transform(
            F.slice("__all", 1, k), lambda e: F.struct(e["role"].alias("role"), e["score"].alias("score"))
        ).alias("top_matches"),
        F.map_from_entries(F.transform("__all", lambda e: F.struct(e["role"], e["reason"]))).alias("reasoning"),
    )


def resolve_conflicts_globally(best: DataFrame) -> DataFrame:
    """Status of each best match (dataset, dataset_ord, column, pos, role, confidence).

    User and item ids are unique over all datasets: the most confident column, earliest on ties, is assigned and the
    others are rejected with its name. Any other role is assigned once per dataset and a duplicate afterwards.
    The winners of the ids are one row per id role and no row is shuffled for them, so a role that covers a third of a huge
    catalog is no hot key. All others win within their dataset, in place where the catalog is dealt by dataset.
    """
    is_id = F.col("role").isin(*ID_ROLES)
    winner = F.max_by(F.struct("dataset", "column", "pos"), F.struct("confidence", -F.col("dataset_ord"), -F.col("pos")))
    ids = best.where(is_id).groupBy("role").agg(winner.alias("__all"))  # one row per id role
    placed = best.withColumn("__own", winner.over(Window.partitionBy("dataset", "role"))).join(F.broadcast(ids), "role", "left")
    placed = placed.withColumn("__w", F.when(is_id, F.col("__all")).otherwise(F.col("__own")))
    won = (F.col("dataset") == F.col("__w.dataset")) & (F.col("pos") == F.col("__w.pos"))
    return placed.where(F.col("role").isNotNull() & (is_id | F.col("dataset").isNotNull())).select(
        *best.columns,
        F.when(won, "assigned").when(is_id, "conflict_rejected").otherwise("duplicate").alias("status"),
        F.when(~won & is_id, F.col("__w.column")).alias("conflict_with"),
    )


def _starts_with_pattern(name: Column, pattern: str) -> Column:
    return name.rlike(f"(?i)^(?:{pattern})")


def pattern_boost(name: Column, role: Column, rules: Sequence[tuple[str, str, float]] = BOOST_RULES) -> Column:
    """Sum of the boosts of all rules for the role whose pattern matches at the start of the name."""
    return sum(
        (F.when((role == target) & _starts_with_pattern(name, pattern), F.lit(value)).otherwise(F.lit(0.0))
         for pattern, target, value in rules),
        F.lit(0.0),
    )


def synonym_boost(
    name: Column, role: Column, groups: dict = BOOST_SYNONYMS, keys: dict = ROLE_SYNONYM_KEY,
    top_roles_: Sequence[str] = TOP_PRIORITY_ROLES,
) -> Column:
    """0.05 for each synonym of the role inside the name, at most 0.2; 0.1 more for roles of first priority."""
    lower = F.lower(name)
    boost = F
    for target, key in keys.items():
        found = sum((F.contains(lower, F.lit(s)).cast("int") for s in groups[key]), F.lit(0))
        boost = boost.when(role == target, F.least(F.lit(0.2), found * F.lit(0.05)))
    boost = boost.otherwise(F.lit(0.0))
    return boost + F.when(role.isin(*top_roles_), F.lit(0.1)).otherwise(F.lit(0.0))


def boost_reasons(
    name: Column, role: Column, rules: Sequence[tuple[str, str, float]] = BOOST_RULES, groups: dict = BOOST_SYNONYMS
) -> Column:
    """``rule:<pattern>`` of the role's matching rules, then ``synonym:<word>`` of any group."""
    lower = F.lower(name)
    by_rule = F.array_compact(F.array(*[
        F.when((role == target) & _starts_with_pattern(name, pattern), F.lit(f"rule:{pattern}"))
        for pattern, target, _ in rules
    ]))
    by_word = F.array_compact(F.array(*[
        F.when(F.contains(lower, F.lit(word)), F.lit(f"synonym:{word}")) for group in groups.values() for word in group
    ]))
    return F.concat(by_rule, by_word)


def drop_excluded(catalog: DataFrame, patterns: Sequence[str] = EXCLUSION_PATTERNS) -> DataFrame:
    return catalog.where(~F.col("column").rlike("(?i)^(?:" + "|".join(patterns) + ")"))


def context_boost(name: Column, role: Column, dataset_type: Column) -> Column:
    return sum(
        (F.when((dataset_type == kind) & (role == target) & F.contains(F.lower(name), F.lit(part)), F.lit(0.1))
         .otherwise(F.lit(0.0)) for kind, target, part in CONTEXT_BOOSTS),
        F.lit(0.0),
    )


def apply_boost(confidence: Column, boost: Column) -> Column:
    return F.least(F.lit(1.0), confidence * (1 + boost))


def blend_scores(embedding: Column, second: Column) -> Column:
    return 0.4 * embedding + 0.6 * second


def adjusted_confidence(confidence: Column, second: Column) -> Column:
    return 0.3 * confidence + 0.7 * second


def normalize_scores(pairs: DataFrame, score: str, group: str, out: str) -> DataFrame:
    """Min-max inside each list, 0.5 where all scores are equal; bounds come from a combined aggregate, then a join."""
    bounds = pairs.groupBy(group).agg(F.min(score).alias("__lo"), F.max(score).alias("__hi"))
    width = F.col("__hi") - F.col("__lo")
    value = F.when(width == 0, F.lit(0.5)).otherwise((F.col(score) - F.col("__lo")) / width)
    return pairs.join(bounds, group, "left").withColumn(out, value).drop("__lo", "__hi")


def best_above(pairs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The most confident role of each column, if it reaches the threshold; ties in role order."""
    best = Window.partitionBy("column").orderBy(F.col("confidence").desc(), F.col("role_ord"))
    return (
        pairs.where(F.col("confidence") >= threshold)
        .withColumn("__rn", F.row_number().over(best)).where(F.col("__rn") == 1).drop("__rn")
    )


def _first_of_task(max_roles: int, turn: str):
    """Of the edges of a task, of each role those of its first ``max_roles`` columns by ``turn`` (falling) then name, one of each column.

    A task holds no more than these and one batch, whatever it reads.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, floor = None, {}
        for batch in batches:
            late = batch[turn] < batch["role"].map(floor).astype(float)
            batch = batch[~late]
            if batch.empty:
                continue
            edges = batch if kept is None else pd.concat([kept, batch], ignore_index=True)
            edges = edges.sort_values([turn, "column"], ascending=[False, True], kind="stable", na_position="first")
            groups = edges.drop_duplicates(["column", "role"]).groupby("role", dropna=False, sort=False)
            kept = groups.head(max_roles)
            if groups.ngroups > max_roles:
                raise ValueError("more roles than max_roles")
            last = groups[turn].nth(max_roles - 1)
            floor = dict(zip(kept.loc[last.index, "role"], last))
        if kept is not None:
            yield kept

    return run


def _first_edges_per_role(edges: DataFrame, turn: str, order: Sequence[Column], roles: int) -> DataFrame:
    """The first ``roles`` edges of each role by ``order``, which begins with the falling ``turn``: of each task first, then of all."""
    first = edges.mapInPandas(_first_of_task(roles, turn), edges.schema)
    single = first.groupBy("column", "role").agg(*[F.max(c).alias(c) for c in edges.columns if c not in ("column", "role")])
    rank = Window.partitionBy("role").orderBy(*order)
    return single.withColumn("__rn", F.row_number().over(rank)).where(F.col("__rn") <= roles).drop("__rn")


def _take_free(edges: Column, max_roles: int) -> Column:
    """Walk ordered edges, take one when its column and its role are both free."""
    roles = F.size(F.array_distinct(F.transform(edges, lambda e: e["role"])))
    edges = F.when(roles <= max_roles, edges).otherwise(F.raise_error(F.lit("more roles than max_roles")))
    start = F.filter(edges, lambda _: F.lit(False))
    return F.aggregate(
        edges, start,
        lambda taken, e: F.when(
            F.exists(taken, lambda t: (t["column"] == e["column"]) | (t["role"] == e["role"])), taken
        ).otherwise(F.array_append(taken, e)),
    )


def assign_one_to_one(pairs: DataFrame, max_roles: int = len(FINE_ROLES)) -> DataFrame:
    """Greedy 1:1 assignment: edges by confidence, each taken if its column and role are both unused.

    When a role finds its column, every better column has gone to another role, so the match lies among the role's
    ``max_roles`` best edges. The exact result therefore needs at most ``max_roles`` squared edges in one row.
    """
    # the best edge of a (column, role) stands for all: a name that stands in many datasets is one edge, not many
    edges = pairs.select("column", "role", "confidence", F.coalesce("confidence", F.lit(float("-inf"))).alias("turn"))
    kept = _first_edges_per_role(edges, "turn", [F.col("turn").desc(), F.col("column"), F.col("role")], max_roles)
    entry = F.struct((-F.col("confidence")).alias("order"), "column", "role", "confidence")
    walk = kept.groupBy().agg(F.sort_array(F.collect_list(entry)).alias("edges"))
    return walk.select(F.explode(_take_free(F.col("edges"), max_roles)).alias("e")).select("e.column", "e.role", "e.confidence")


def assign_by_column(pairs: DataFrame, max_roles: int = len(FINE_ROLES)) -> DataFrame:
    """Columns in order of their best confidence each take their best role still free, or none.

    A role is taken by one of the first ``max_roles`` columns that want it, since any earlier one went to another role. The pairs
    are written once; a column is then one row with its best confidence for each role, and no edge is joined or sorted by column.
    """
    pairs = materialize(pairs.select("column", "role", F.coalesce("confidence", F.lit(float("-inf"))).alias("confidence")), "role-pairs")
    roles = [r["role"] for r in pairs.select("role").distinct().limit(max_roles + 1).collect()]
    if len(roles) > max_roles:
        raise ValueError("more roles than max_roles")
    if not roles:
        return pairs.limit(0)
    own = [F.max(F.when(F.col("role").eqNullSafe(F.lit(r)), F.col("confidence"))) for r in roles]
    wide = pairs.groupBy("column").agg(F.max("confidence").alias("best"), F.array(*own).alias("own"))
    named = F.transform(F.col("own"), lambda c, i: F.struct(F.element_at(F.array(*[F.lit(r).cast("string") for r in roles]), i + 1).alias("role"), c.alias("c")))
    edges = wide.select("column", "best", F.explode(named).alias("e")).where("e.c IS NOT NULL").select("column", "e.role", F.col("e.c").alias("confidence"), "best")
    kept = _first_edges_per_role(edges, "best", [F.col("best").desc(), F.col("column"), F.col("role")], max_roles)
    kept = kept.withColumns({c: F.when(F.col(c) > float("-inf"), F.col(c)) for c in ("best", "confidence")})
    entry = F.struct(
        (-F.col("best")).alias("turn"), "column", (-F.col("confidence")).alias("order"), "role", "confidence"
    )
    walk = kept.groupBy().agg(F.sort_array(F.collect_list(entry)).alias("edges"))
    return walk.select(F.explode(_take_free(F.col("edges"), max_roles)).alias("e")).select("e.column", "e.role", "e.confidence")


def best_per_role(pairs: DataFrame) -> DataFrame:
    """Mark the most confident column of each role; the others carry ``lost_to``. Winners are one row per role."""
    winner = pairs.groupBy("role").agg(
        F.min_by("column", F.struct(-F.col("confidence"), F.col("column"))).alias("winner")
    )
    lost = F.col("column") != F.col("winner")
    return pairs.join(winner, "role").select(
        *pairs.columns, (~lost).alias("is_winner"), F.when(lost, F.col("winner")).alias("lost_to")
    )


def add_missing_roles(mappings: DataFrame, required: Sequence[str] = REQUIRED_ROLES) -> DataFrame:
    """(column, role, confidence, missing_required) with a row for each required role that nothing maps to."""
    present = mappings.groupBy().agg(
        F.collect_set(F.when(F.col("role").isin(*required), F.col("role"))).alias("present")
    )
    missing = present.select(F.explode(F.array_except(_strings(required), F.col("present"))).alias("role")).select(
        F.lit(None).cast("string").alias("column"), "role", F.lit(0.0).alias("confidence"),
        F.lit(True).alias("missing_required"),
    )
    return mappings.select("column", "role", "confidence", F.lit(False).alias("missing_required")).unionByName(missing)


def _priority_index(role: Column) -> Column:
    order = F.create_map(*[part for i, r in enumerate(FINE_ROLES) for part in (F.lit(r[0]), F.lit(i))])
    return F.coalesce(order[role], F.lit(len(FINE_ROLES)))


def global_confidence(mappings: DataFrame) -> DataFrame:
    """Mean confidence weighted by 1 / (1 + priority index); 0 without mappings."""
    weight = 1.0 / (_priority_index(F.col("role")) + 1)
    return mappings.agg(
        F.coalesce(F.sum(F.col("confidence") * weight) / F.sum(weight), F.lit(0.0)).alias("global_confidence")
    )


def reasoning_summary(role: Column, confidence: Column, won_conflict: Column) -> Column:
    # The texts of the summary
    level = (
        F.when(confidence >= 0.8, "High semantic similarity")
        .when(confidence >= 0.5, "Moderate semantic match")
        .otherwise("Low confidence - review recommended")
    )
    high = F.when(_priority_index(role) < 5, F.concat(F.lit("High-priority role ("), role, F.lit(")")))
    conflict = F.when(won_conflict, F.concat(F.lit("Won conflict against other columns for "), role))
    return F.concat_ws("; ", level, high, conflict)


def first_spelling(catalog: DataFrame) -> DataFrame:
    """One row per lower-case column name: the earliest by dataset order and position."""
    place = F.struct("dataset_ord", "pos")
    return catalog.groupBy(F.lower("column").alias("name")).agg(
        F.min_by(F.struct("dataset", "column", "dtype"), place).alias("f")
    ).select("name", "f.*")


def confidence_bands(mappings: DataFrame) -> DataFrame:
    c = F.col("confidence")
    return mappings.agg(
        F.count_if(c >= 0.8).alias("high"), F.count_if((c >= 0.5) & (c < 0.8)).alias("medium"),
        F.count_if(c < 0.5).alias("low"),
    )


def expand_synonyms(words: DataFrame, word: str = "word", groups: dict = KEYWORD_SYNONYMS) -> DataFrame:
    """(word, ord, synonym): the word itself, then the synonyms of every key that contains it or is inside it."""
    lower = F.lower(F.col(word))
    lists = [
        F.when(F.contains(F.lit(key), lower) | F.contains(lower, F.lit(key)), _strings(values))
        .otherwise(F.array().cast("array<string>"))
        for key, values in groups.items()
    ]
    return words.select(word, F.posexplode(F.concat(F.array(F.col(word)), *lists)).alias("ord", "synonym"))
