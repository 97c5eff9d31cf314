"""Role inference against known results and brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessela.operators import mapping, meaning, profile, schema
from tessela.plans import catalog
from tessela.roles import FINE_ROLES

SAMPLE = ("user_id", "item_id", "rating", "timestamp", "age", "gender", "category", "title")


def _catalog(spark, names, dataset="interactions"):
    rows = [(dataset, 0, n, i, "bigint") for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "dataset string, dataset_ord long, column string, pos int, dtype string")


def test_name_scores(spark):
    scores = {(r["column"], r["role"]): r["rule_score"] for r in mapping.rule_score(_catalog(spark, SAMPLE)).collect()}
    assert scores["rating", "INTERACTION_SIGNAL"] == pytest.approx(0.81)
    assert scores["timestamp", "TEMPORAL"] == pytest.approx(0.72)
    assert scores["age", "USER_FEATURE"] == pytest.approx(0.63)
    hits = {r["role"] for r in mapping.rule_score(_catalog(spark, ["page_views"])).collect()}
    assert hits == {"INTERACTION_SIGNAL", "USER_FEATURE"}


def test_mapping_and_conflicts_of_the_sample(spark):
    best = mapping.map_columns(_catalog(spark, SAMPLE))
    rows = {r["column"]: r for r in best.collect()}
    want = (0.7, 0.7, 0.567, 0.504, 0.441, 0.441, 0.441, 0.441)
    assert [rows[c]["confidence"] for c in SAMPLE] == pytest.approx(want)
    assert len(rows["age"]["top_matches"]) == 5
    resolved = mapping.resolve_conflicts_globally(best.select("dataset", "dataset_ord", "column", "pos", "role", "confidence"))
    status = {r["column"]: r["status"] for r in resolved.collect()}
    assert {c for c in SAMPLE if status[c] == "duplicate"} == {"gender", "title"}
    assert all(status[c] == "assigned" for c in SAMPLE if c not in ("gender", "title"))
    counts = {r["bucket"]: r["columns"] for r in meaning.bucket_counts(best).collect()}
    assert counts == {"IDENTITY": 2, "SIGNAL": 1, "FEATURE": 4, "EVENT": 0, "SESSION": 0, "TEMPORAL": 1, "CONTEXTUAL": 0}


def test_ids_are_unique_over_datasets(spark):
    both = _catalog(spark, ["user_no"], "a").unionByName(
        _catalog(spark, ["user"], "b").withColumn("dataset_ord", F.lit(1).cast("long")))
    best = mapping.map_columns(both).select("dataset", "dataset_ord", "column", "pos", "role", "confidence")
    rows = {r["dataset"]: r for r in mapping.resolve_conflicts_globally(best).collect()}
    assert rows["b"]["status"] == "assigned" and rows["b"]["conflict_with"] is None
    assert rows["a"]["status"] == "conflict_rejected" and rows["a"]["conflict_with"] == "user"


def _random_pairs(seed):
    rng = random.Random(seed)
    roles = [r[0] for r in FINE_ROLES[:5]]
    return [(f"c{c:02d}", r, rng.randrange(8) / 8) for c in range(40) for r in roles if rng.random() < 0.6]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_greedy_assignments_equal_the_serial_walk(spark, seed):
    pairs = _random_pairs(seed)
    df = spark.createDataFrame(pairs, "column string, role string, confidence double")

    columns, roles, edges = set(), set(), set()
    for c, r, v in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if c not in columns and r not in roles:
            columns.add(c), roles.add(r), edges.add((c, r))
    assert {(r["column"], r["role"]) for r in mapping.assign_one_to_one(df, 5).collect()} == edges

    best = {}
    for c, _, v in pairs:
        best[c] = max(best.get(c, 0), v)
    used, chosen = set(), set()
    for c in sorted(best, key=lambda c: (-best[c], c)):
        free = sorted(((-v, r) for cc, r, v in pairs if cc == c and r not in used))
        if free:
            used.add(free[0][1]), chosen.add((c, free[0][1]))
    assert {(r["column"], r["role"]) for r in mapping.assign_by_column(df, 5).collect()} == chosen


def test_assignment_refuses_too_many_roles(spark):
    df = spark.createDataFrame(_random_pairs(1), "column string, role string, confidence double")
    with pytest.raises(Exception, match="max_roles"):
        mapping.assign_one_to_one(df, 3).collect()


def test_candidates_take_the_last_group(spark):
    row = schema.semantic_candidates(_catalog(spark, ["user_rating"])).first()
    assert (row["candidate_type"], row["confidence"]) == ("INTERACTION", 0.8)


def test_first_match_and_content_types(spark):
    rows = {r["column"]: r["semantic_type"] for r in schema.semantic_types(_catalog(spark, ["user_rating", "cost", "visit_no"])).collect()}
    assert rows == {"user_rating": "USER_ID", "cost": None, "visit_no": "SESSION"}
    profiled = _catalog(spark, ["video", "width", "cost"]).withColumns({"unique_count": F.lit(5), "num_rows": F.lit(100)})
    kinds = {r["column"]: r["content_type"] for r in schema.content_types(profiled).collect()}
    assert kinds == {"video": "IDENTIFIER", "width": "IDENTIFIER", "cost": "CATEGORICAL_NUMERIC"}


def test_excluded_columns(spark):
    kept = mapping.drop_excluded(_catalog(spark, ["password_hash", "Email", "user_id"])).collect()
    assert [r["column"] for r in kept] == ["user_id"]


def test_missing_roles_of_an_empty_mapping(spark):
    empty = spark.createDataFrame([], "column string, role string, confidence double")
    made = mapping.add_missing_roles(empty).collect()
    assert {r["role"] for r in made} == {"USER_ID", "ITEM_ID", "INTERACTION_EVENT"} and all(r["missing_required"] for r in made)
    assert mapping.global_confidence(empty).first()[0] == 0.0


def test_profile_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "a int, b string, c boolean")
    rows = profile.profile_columns(empty).collect()
    assert [(r["null_count"], r["null_pct"], r["unique_count"]) for r in rows] == [(0, 0.0, 0)] * 3
    quality = profile.profile_quality(empty).first()
    assert (quality["num_rows"], quality["null_pct"], quality["duplicate_rows"]) == (0, 0.0, 0)
    assert profile.numeric_stats(empty.select("b")).count() == 0


def test_null_counts_as_a_value(spark):
    df = spark.createDataFrame([(1,), (None,), (None,), (2,)], "a int")
    row = profile.profile_columns(df).first()
    assert (row["unique_count"], row["null_count"], row["null_pct"]) == (3, 2, 50.0)
    assert profile.profile_quality(df).first()["duplicate_rows"] == profile.profile_quality(df, approx=True).first()["duplicate_rows"] == 1


def test_repeated_edges_do_not_hide_others(spark):
    rows = [("a", "R1", 0.9)] * 25 + [("a", "R2", 0.8)] * 25 + [("b", "R2", 0.5)]
    pairs = spark.createDataFrame(rows, "column string, role string, confidence double")
    for assign in (mapping.assign_one_to_one, mapping.assign_by_column):
        assert {(r["column"], r["role"]) for r in assign(pairs).collect()} == {("a", "R1"), ("b", "R2")}


def test_one_id_role_for_all_columns_is_no_hot_key(spark):
    """Neither the ids of the whole catalog nor the words of a dataset are shuffled by role."""
    rows = [(f"d{d}", d, f"c{p}", p, "USER_ID" if p < 9 else "PRICE", 0.5) for d in range(30) for p in range(12)]
    best = spark.createDataFrame(rows, "dataset string, dataset_ord long, column string, pos int, role string, confidence double")
    made = mapping.resolve_conflicts_globally(best.repartition("dataset"))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(dataset" in plan and "__scope" not in plan and plan.count("SortMergeJoin") == 0
    got = {(r["dataset"], r["column"]): (r["status"], r["conflict_with"]) for r in made.collect()}
    assert len(got) == len(rows) and got["d0", "c0"] == ("assigned", None) and got["d7", "c0"] == ("conflict_rejected", "c0")
    assert got["d7", "c9"] == ("assigned", None) and got["d7", "c10"] == ("duplicate", None)


def test_words_are_not_shuffled_after_texts(spark):
    made = catalog.QUERIES["c6_top_roles"](spark, "/root/testdata/sf0.001")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_a_task_keeps_only_the_first_edges_of_each_role():
    """However many edges a task reads, it hands on at most ``max_roles`` columns of each role."""
    import pandas as pd

    def batches():
        for at in range(50):
            yield pd.DataFrame({"column": [f"c{at * 100 + i:05d}" for i in range(100)] * 2, "role": ["A"] * 100 + ["B"] * 100,
                                "confidence": [(i * 7 % 100) / 100 for i in range(200)], "turn": [(i * 7 % 100) / 100 for i in range(200)]})

    every = pd.concat(list(batches())).sort_values(["turn", "column"], ascending=[False, True])
    wanted = {(r.column, r.role) for _, g in every.groupby("role") for r in g.head(3).itertuples()}
    got = pd.concat(list(mapping._first_of_task(3, "turn")(batches())))
    assert len(got) == 6 and {(r.column, r.role) for r in got.itertuples()} == wanted


def test_predicates_read_the_texts_once(spark, tmp_path, monkeypatch):
    from tessela.plans import q_roles

    rows = [(i, "a a b" if i % 2 else "b c c", "en", "s") for i in range(8)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    calls, whole = [], q_roles.mapped_lake(spark, str(tmp_path))
    monkeypatch.setattr(q_roles, "materialize", lambda df, name: calls.append(name) or df.cache())
    got = {r["kind"]: (r["n"], r["names"]) for r in q_roles.d2(spark, str(tmp_path)).collect()}
    classes = q_roles.meaning.classify(whole).collect()
    assert calls == ["classes"]
    assert got["ambiguous"] == (sum(r["is_ambiguous"] for r in classes), len({r["column"] for r in classes if r["is_ambiguous"]}))


def test_only_texts_with_corrections_are_cut_for_them(spark, tmp_path):
    from tessela.plans import fixtures, q_roles

    docs = [(1, "price price price name"), (2, "cost cost cost"), (2, "cost unit"), (3, "size size size"), (None, "other other other"), (4, None)]
    spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "'web' AS source").write.parquet(
        str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1), (1, 1), (2, 1), (3, 0), (4, 1), (None, 1)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    fixes = sorted(map(tuple, q_roles._fixes(spark, str(tmp_path)).collect()))
    assert fixes == [("doc_1", "price", "PRICE"), ("doc_2", "cost", "PRICE")]
    of = spark.createDataFrame([(2,)], "doc_id long")
    assert {r["dataset"] for r in fixtures.lake_catalog(spark, str(tmp_path), of).collect()} == {"doc_2"}
    summary = q_roles.d10_summary(spark, str(tmp_path)).first()
    assert (summary["total"], summary["corrected"]) == (6, 2)


def test_role_and_confidence_make_no_reasons(spark):
    """Reasons and lists of all roles are only made for those who read them."""
    best = mapping.map_columns(_catalog(spark, SAMPLE))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "rule-match" in plan(best) and "rule-match" not in plan(best.select("dataset", "column", "role", "confidence"))
    first = best.select("role", "confidence", F.col("top_matches")[0].alias("t")).collect()
    assert all((r["role"], r["confidence"]) == (r["t"]["role"], r["t"]["score"]) for r in first)


def test_a_catalog_is_made_once(spark, monkeypatch):
    """Entities and the graph read what costs more than a table from one that is written once."""
    from tessela.operators import meaning

    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(name):
        seen.add(1)
        return name

    best = mapping.map_columns(_catalog(spark, SAMPLE)).select("dataset", "dataset_ord", "column", "pos", "role", "confidence")
    rows = best.count()
    slow = lambda: best.withColumn("role", counted("role"))
    for made in (lambda: meaning.entity_mapping(slow()), lambda: meaning.graph_edges(meaning.graph_nodes(slow()))):
        before = seen.value
        made().collect()
        assert seen.value - before < 2 * rows  # a filter on the role asks for it once more
