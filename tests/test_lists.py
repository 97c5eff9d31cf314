"""Neighbours, losses, lists, sources and streams on small fixtures."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessela.operators import ann, evaluate, explain, feedback, learned, losses, models, recommend, rerank
from tessela.roles import Roles
from tessela.sources import readers, sinks
from tessela.streaming import feedback as streams


def _vectors(spark, n=120, dim=8, copies=60, seed=1):
    """Random unit vectors; the first ``copies`` are one and the same."""
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, dim))
    m[:copies] = m[0]
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    return m, spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, vector array<double>")


def _brute(m, k):
    scores = np.round(m @ m.T, 9)
    return {(q, int(i)) for q in range(len(m)) for i in sorted(range(len(m)), key=lambda i: (-scores[q, i], i))[:k]}


def test_knn_exact_and_ivf_with_a_hot_cell(spark):
    m, base = _vectors(spark)
    queries = base.withColumnRenamed("id", "query_id")
    exact = ann.knn_exact(queries, base, 5, block_rows=32)
    assert {(r["query_id"], r["id"]) for r in exact.collect()} == _brute(m, 5)
    index = ann.ivf_build(base, nlist=4)
    found = ann.ivf_search(queries, index, 5, nprobe=4, block_rows=16)
    assert {(r["query_id"], r["id"]) for r in found.collect()} == _brute(m, 5)


def test_nprobe_is_at_least_one():
    assert [ann.default_nprobe(n) for n in (1, 9, 50, 1024)] == [1, 1, 5, 10]


def test_zero_vector_scores_zero(spark):
    q = spark.createDataFrame([(1, [0.0, 0.0])], "query_id long, vector array<double>")
    b = spark.createDataFrame([(7, [1.0, 0.0])], "id long, vector array<double>")
    assert ann.cosine_topk(q, b, 1).first()["score"] == 0.0


def test_features_to_vectors_needs_numbers(spark):
    with pytest.raises(ValueError):
        ann.features_to_vectors(spark.sql("SELECT 1 AS item_id, 'x' AS t"), 4)


def test_losses_stay_finite(spark):
    pairs = spark.createDataFrame([(1000.0, -1000.0), (-1000.0, 1000.0)], "pos_score double, neg_score double")
    row = losses.pairwise_losses(pairs).first()
    assert (row["bpr_loss"], row["hinge_loss"], row["pairwise_accuracy"]) == (1000.0, 1000.5, 0.5)
    lists = spark.createDataFrame([("a", 1000.0, 1.0), ("a", -1000.0, 0.0)], "list_id string, score double, label double")
    assert losses.softmax_loss(lists).first()["loss"] == 0.0
    assert np.isfinite(losses.listnet_loss(lists).first()["loss"])


def test_mmr_by_hand(spark):
    recs = spark.createDataFrame([(1, 1, 1.0), (1, 2, 0.9), (1, 3, 0.5)], "user_id long, item_id long, score double")
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "item_id long, vector array<double>")
    rows = rerank.mmr(recs, items, k=3).orderBy("rank").collect()
    assert [(r["item_id"], r["mmr"]) for r in rows] == [(1, 0.5), (3, 0.25), (2, pytest.approx(-0.05))]


def test_metrics_on_edges(spark):
    recs = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 10, 1), (3, 10, 1)], "user_id long, item_id long, rank int")
    test = spark.createDataFrame([(1, 11), (1, 12), (2, 99)], "user_id long, item_id long")
    got = {r["metric"]: r["value"] for r in evaluate.evaluate(
        recs, test, ["recall@2", "precision@2", "hit_rate@2", "map@2", "mrr", "ndcg@2"]).collect()}
    gain = 1 / np.log2(3)
    assert got["recall@2"] == 0.25 and got["precision@2"] == 0.25 and got["hit_rate@2"] == 0.5
    assert got["map@2"] == 0.125 and got["mrr"] == 0.25
    assert got["ndcg@2"] == pytest.approx(gain / (1 + gain) / 2)
    with pytest.raises(ValueError):
        evaluate.evaluate(recs, test, ["magic@3"])


def test_diversity_equals_all_pairs(spark):
    m, base = _vectors(spark, 20, 6, copies=1)
    recs = spark.createDataFrame([(1, i) for i in range(9)] + [(2, 3)], "user_id long, item_id long")
    got = {r["user_id"]: r["diversity"] for r in evaluate.list_diversity(recs, base.withColumnRenamed("id", "item_id")).collect()}
    pairs = [m[i] @ m[j] for i in range(9) for j in range(i)]
    assert got[1] == pytest.approx(1 - np.mean(pairs)) and got[2] is None


def test_similar_items_in_slices(spark):
    rng = np.random.default_rng(2)
    pairs = {(int(u), int(i)) for u, i in zip(rng.integers(0, 15, 120), rng.integers(0, 12, 120))} | {(0, i) for i in range(12)}
    df = spark.createDataFrame(sorted(pairs), "user_id long, item_id long")
    seeds = df.select("item_id").distinct()
    users = {i: {u for u, j in pairs if j == i} for i in range(12)}
    got = explain.similar_items(df, Roles(), seeds, k=50, seeds_per_slice=5).collect()
    want = {(a, b): len(users[a] & users[b]) for a in users for b in users if a != b and users[a] & users[b]}
    assert {(r["seed"], r["similar"]): r["shared"] for r in got} == want


def test_business_rules_in_order(spark):
    recs = spark.createDataFrame([(1, 1, 2.0, "a"), (1, 2, 2.0, "b"), (1, 3, 2.0, None)], "user_id long, item_id long, score double, tag string")
    rules = [rerank.BusinessRule("tag = 'b'", drop=True), rerank.BusinessRule("tag = 'a'", boost=2.0), rerank.BusinessRule("score > 3", boost=10)]
    assert {r["item_id"]: r["score"] for r in rerank.business_rules(recs, rules).collect()} == {1: 40.0, 3: 2.0}


def test_sparse_users_lean_on_popularity(spark):
    scored = spark.createDataFrame([(1, 1, 1.0, 0.0), (2, 1, 1.0, 0.0), (3, 1, 1.0, 0.0)],
                                   "user_id long, item_id long, personal_score double, popularity_score double")
    counts = spark.createDataFrame([(2, 4), (3, 9)], "user_id long, interactions long")
    got = {r["user_id"]: r["score"] for r in recommend.sparse_hybrid(scored, counts).collect()}
    assert got == {1: pytest.approx(1 - 0.9 ** 5), 2: pytest.approx(1 - 0.9), 3: 1.0}


def test_retrain_keeps_the_better_model(spark):
    rows = spark.range(3)
    assert feedback.retrain(rows, rows, lambda df: df.count(), lambda m: -float(m), current=4) == (4, -4.0, False)
    assert feedback.retrain(rows, rows, lambda df: df.count(), float, current=4) == (6, 6.0, True)


def test_file_catalog_looks_into_unknown_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "sub" / "b.NDJSON").write_text('{"x": 1}\n')
    (tmp_path / "sub" / "c.dat").write_text('{"x": 1}')
    (tmp_path / "d.txt").write_text("x\ty\n")
    (tmp_path / "e.bin").write_text("nothing")
    (tmp_path / "f.raw").write_bytes(b"PAR1....")
    found = {r["file_name"]: r["file_type"] for r in readers.file_catalog(spark, str(tmp_path)).collect()}
    assert found == {"a.csv": "csv", "b.NDJSON": "jsonl", "c.dat": "json", "d.txt": "csv", "e.bin": None, "f.raw": "parquet"}
    assert readers.file_catalog(spark, str(tmp_path), types=("json",)).count() == 1


def test_csv_with_a_schema_fails_on_bad_values(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x\n1\noops\n")
    with pytest.raises(Exception):
        readers.read_table(spark, str(tmp_path / "a.csv"), "csv", schema="x INT").collect()


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.0, "a"), (2, None, "b")], "item_id long, d0 double, t string")
    sinks.write_json_documents(df.repartition(2), str(tmp_path / "j"))
    back = readers.read_table(spark, str(tmp_path / "j"), "json", schema="item_id long, d0 double, t string")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    stamped = df.withColumn("ts", F.lit("2024-03-01 10:00:00").cast("timestamp"))
    sinks.write_matrix(stamped, str(tmp_path / "m"), "ts")
    assert spark.read.parquet(str(tmp_path / "m")).where("event_date = '2024-03-01'").count() == 2
    with pytest.raises(ValueError):
        sinks.export({}, {}, str(tmp_path), include=("everything",))


def test_late_rows_leave_and_are_counted(spark, tmp_path):
    def put(name, rows):
        spark.createDataFrame(rows, "event_id long, s long").select("event_id", F.timestamp_seconds("s").alias("ts")).coalesce(
            1).write.mode("append").parquet(str(tmp_path / name))

    put("in", [(1, 1_700_000_000), (1, 1_700_000_000), (2, 1_700_100_000)])
    checkpoint, out = str(tmp_path / "ckpt"), str(tmp_path / "out")
    dropped = 0
    for rows in ([], [(3, 1_700_000_100), (4, 1_700_100_100), (2, 1_700_100_000)]):
        if rows:
            put("in", rows)
        stream = streams.feedback_stream(spark, str(tmp_path / "in"), "event_id long, ts timestamp")
        q = streams.dedupe(stream).writeStream.format("parquet").option("checkpointLocation", checkpoint).option(
            "path", out).trigger(availableNow=True).start()
        q.awaitTermination()
        for p in q.recentProgress:
            dropped += sum(s["numRowsDroppedByWatermark"] for s in json.loads(p.json)["stateOperators"])
    assert sorted(r["event_id"] for r in spark.read.parquet(out).collect()) == [1, 2, 4]
    assert dropped == 1


def test_roles_from_mapped_columns(spark):
    mapped = spark.createDataFrame(
        [("uid", "USER_ID", 0.9), ("cust", "USER_ID", 0.7), ("sku", "ITEM_ID", 0.8), ("stars", "RATING", 0.6), ("hits", "CLICK", 0.9), ("at", "TEMPORAL_FEATURE", 0.5),
         (None, "SESSION_ID", 0.0)], "column string, role string, confidence double")
    roles = learned.roles_from_mapping(mapped)
    assert (roles.user, roles.item, roles.signal, roles.ts, roles.session) == ("uid", "sku", "stars", "at", None)
    with pytest.raises(ValueError, match="item"):
        learned.roles_from_mapping(mapped.where("role <> 'ITEM_ID'"))


def test_a_list_keeps_items_without_a_vector(spark):
    recs = spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.8)], "user_id long, item_id long, score double")
    known = spark.createDataFrame([(10, [1.0, 0.0])], "item_id long, vector array<double>")
    assert {r["item_id"] for r in rerank.mmr(recs, known).collect()} == {10, 11}
    assert evaluate.list_diversity(recs, known).first()["diversity"] == 1.0


def test_an_index_survives_saving(spark, tmp_path):
    base = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)], "id long, vector array<double>")
    queries = base.limit(9).withColumnRenamed("id", "query_id")
    index = ann.ivf_build(base, nlist=4)
    index.save(str(tmp_path / "index"))
    back = ann.IvfIndex.load(spark, str(tmp_path / "index"))
    rows = lambda i: sorted(map(tuple, ann.ivf_search(queries, i, 3, nprobe=2).collect()))
    assert rows(index) == rows(back)


def test_deltas_are_merged_and_compacted(spark, tmp_path):
    rows = [(u, u % 3, "click" if u % 2 else "purchase", f"2024-01-0{1 + u % 7} 00:00:00") for u in range(40)]
    df = spark.createDataFrame(rows, "user_id long, item_id long, event_type string, ts string").withColumn("ts", F.to_timestamp("ts"))
    df.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = streams.feedback_stream(spark, str(tmp_path / "in"), df.schema, max_files_per_trigger=1)
    for every in (2, 100):
        got = streams.run_merged(stream, streams.preference_delta, streams.merge_preference, "merged", compact_every=every)
        want = streams.merge_preference(streams.preference_delta(df))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_windows_in_update_mode_keep_the_newest_count(spark, tmp_path):
    rows = [(u % 2, f"2024-01-01 00:{m:02d}:00") for u in range(3) for m in range(0, 60, 7)]
    df = spark.createDataFrame(rows, "user_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = streams.feedback_stream(spark, str(tmp_path / "in"), df.schema, max_files_per_trigger=1)
    counted = streams.window_counts(stream, ("user_id",), width="1 hour")
    written, _ = streams.run_available(counted, "windows", "update")
    got = streams.latest(written, ("window_start", "window_end", "user_id"))
    assert {r["user_id"]: r["rows"] for r in got.collect()} == {r["user_id"]: r["count"] for r in df.groupBy("user_id").count().collect()}


def _mmr_by_hand(rows, vectors, k, weight=0.5):
    """Greedy lists of plain Python: {user: [(item, value), ...]}."""
    unit = {i: np.array(v) / max(np.linalg.norm(v), 1e-300) for i, v in vectors.items()}
    made = {}
    for user in {r[0] for r in rows}:
        best = {}
        for _, item, score in (r for r in rows if r[0] == user):
            best[item] = max(best.get(item, -np.inf), score)
        taken = []
        while best and len(taken) < k:
            value = {i: round(weight * s - (1 - weight) * max([unit[i] @ unit[t] if i in unit and t in unit else 0.0 for t, _ in taken], default=0.0), 9) for i, s in best.items()}
            item = min(best, key=lambda i: (-value[i], i))
            taken.append((item, value[item]))
            del best[item]
        made[user] = taken
    return made


def test_mmr_equals_greedy_lists(spark):
    rng = np.random.default_rng(6)
    vectors = {i: rng.standard_normal(4).tolist() for i in range(25)} | {30: [0.0] * 4}
    rows = [(u, int(i), round(float(s), 2)) for u in (None, 1, 2, 3) for i, s in zip(rng.integers(0, 35, 22), rng.random(22), strict=True)]
    rows += [(4, 3, 0.5), (4, 3, 0.7), (4, 30, 0.7)]  # a repeated item, fewer candidates than rounds
    recs = spark.createDataFrame(rows, "user_id long, item_id long, score double")
    items = spark.createDataFrame(list(vectors.items()), "item_id long, vector array<double>")
    got = {}
    for r in rerank.mmr(recs, items, k=6).orderBy("rank").collect():
        got.setdefault(r["user_id"], []).append((r["item_id"], r["mmr"]))
        assert r["rank"] == len(got[r["user_id"]])
    want = _mmr_by_hand(rows, vectors, 6)
    assert {u: [i for i, _ in t] for u, t in got.items()} == {u: [i for i, _ in t] for u, t in want.items()}
    for user, taken in want.items():
        assert [v for _, v in got[user]] == pytest.approx([v for _, v in taken], abs=2e-9)
    assert rerank.mmr(recs.where("user_id > 9"), items).count() == 0


def test_mmr_of_a_very_long_list(spark):
    """A list of 200,000 candidates of one user is no group of any task."""
    items = spark.range(200_000).select(F.col("id").alias("item_id"), F.array((F.col("id") % 3).cast("double"), F.lit(1.0)).alias("vector"))
    recs = items.select(F.lit(1).alias("user_id"), "item_id", (F.col("item_id") / 200_000).alias("score"))
    made = rerank.mmr(recs, items, k=3)
    assert "FlatMapGroups" not in made._jdf.queryExecution().toString()
    rows = made.orderBy("rank").collect()
    assert rows[0]["item_id"] == 199_999 and len({r["item_id"] % 3 for r in rows}) > 1 and len(rows) == 3


@pytest.mark.parametrize("limit", [50_000, 7])
def test_fold_in_is_the_user_step_of_the_factorization(spark, limit, monkeypatch):
    """With the rows the model was fitted on, every user gets its own vector again; a heavy user is summed in parts."""
    rng = np.random.default_rng(2)
    rows = [(f"u{u}", int(i), float(w)) for u in range(40) for i, w in zip(rng.integers(0, 30, 30 if u == 3 else 6), rng.integers(1, 5, 30), strict=False)]
    df = spark.createDataFrame(rows, "user_id string, item_id long, weight double")
    roles = Roles(signal="weight")
    model = models.fit_retrieval(df, roles, rank=5, iterations=3)
    model = models.RetrievalVectors(model.users.cache(), model.items.cache())
    monkeypatch.setattr(feedback, "FOLD_ROWS", limit)
    before = {r["user_id"]: np.array(r["vector"]) for r in model.users.collect()}
    folded = feedback.fold_in(model, df, df.where("user_id <> 'u5'"), roles)
    after = {r["user_id"]: np.array(r["vector"]) for r in folded.users.collect()}
    assert set(after) == set(before) and max(np.abs(after[u] - before[u]).max() for u in before) < 1e-4
    # a new user, one whose items are unknown, and one whose taste has changed
    new = spark.createDataFrame([("new", 1, 4.0), ("new", 2, 1.0), ("odd", 999, 1.0), ("u5", 7, 50.0), (None, 1, 1.0)], df.schema)
    again = feedback.fold_in(model, df.unionByName(new), new, roles)
    users = {r["user_id"]: np.array(r["vector"]) for r in again.users.collect()}
    assert set(users) == set(before) | {"new"}
    assert (users["u6"] == before["u6"]).all() and np.abs(users["u5"] - before["u5"]).max() > 1e-3
    y = {r["item_id"]: np.array(r["vector"]) for r in model.items.collect()}
    gram = sum(np.outer(v, v) for v in y.values())
    left = gram + sum(10 * w * np.outer(y[i], y[i]) for i, w in ((1, 4.0), (2, 1.0))) + 0.05 * 2 * np.eye(5)
    assert users["new"] == pytest.approx(np.linalg.solve(left, sum((1 + 10 * w) * y[i] for i, w in ((1, 4.0), (2, 1.0)))), abs=1e-9)


def test_mmr_in_one_task_and_in_rounds_agree(spark, monkeypatch):
    """A list that one task can hold takes no rounds; cut by a small bound, some lists go in rounds and give the same."""
    rng = np.random.default_rng(12)
    items = spark.createDataFrame([(i % 30, rng.standard_normal(3).tolist()) for i in range(33)], "item_id long, vector array<double>")  # three items have two
    rows = [(u, int(i), round(float(s), 2)) for u in (None, 1, 2, 3, 4) for i, s in zip(rng.integers(0, 35, 8 * (u or 1)), rng.random(40))]
    recs = spark.createDataFrame([*rows, (1, None, 0.9), (2, 5, None)], "user_id long, item_id long, score double")
    written, write = [], rerank.materialize
    monkeypatch.setattr(rerank, "materialize", lambda df, name: written.append(name) or write(df, name))
    lists = lambda: sorted(map(str, rerank.mmr(recs, items, k=5).collect()))
    whole = lists()
    assert len(whole) > 20 and "mmr-taken" not in written
    monkeypatch.setattr(rerank, "LIST_ROWS", 16)
    assert lists() == whole and "mmr-taken" in written
