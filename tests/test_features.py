"""Positions, sessions, quantiles and features against brute force and on edges."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessela.functions import ordering
from tessela.functions.ordering import dense_numbers, position_in_group, scan_by_key
from tessela.functions.ordering import materialize as ordering_materialize
from tessela.functions.quantiles import exact_quantiles, kth_smallest
from tessela.operators import features, prep
from tessela.operators.feedback import replay_buffer
from tessela.plans import catalog
from tessela.plans.fixtures import order_interactions
from tessela.roles import Roles

SF_DIR = "/root/testdata/sf0.001"
ROLES = Roles(tiebreak=("row",))


def _interactions(spark, n=400, seed=3):
    """Half of the rows belong to one user, and times collide."""
    rng = random.Random(seed)
    rows = [
        (1 if rng.random() < 0.5 else rng.randrange(2, 9), rng.randrange(12), float(rng.randrange(1, 6)),
         1_700_000_000 + rng.randrange(60) * 4_000, i) for i in range(n)
    ]
    df = spark.createDataFrame(rows, "user_id long, item_id long, signal double, s long, row long")
    return rows, df.withColumn("ts", F.timestamp_seconds("s"))


@pytest.mark.parametrize("descending", [False, True])
def test_position_in_group(spark, descending):
    rows, df = _interactions(spark)
    got = {r["row"]: r["p"] for r in position_in_group(df, ["user_id"], "ts", ["row"], "p", descending).collect()}
    for user in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == user), key=lambda r: (-r[3] if descending else r[3], r[4]))
        assert [got[r[4]] for r in mine] == list(range(1, len(mine) + 1))


def test_position_is_null_without_time(spark):
    df = spark.sql("SELECT 1L AS user_id, CAST(NULL AS TIMESTAMP) AS ts, 0L AS row UNION ALL SELECT 1, TIMESTAMP '2024-01-01', 1")
    assert {r["row"]: r["p"] for r in position_in_group(df, ["user_id"], "ts", ["row"], "p").collect()} == {0: None, 1: 1}


def test_dense_numbers_have_no_gap(spark):
    df = spark.range(1000).select((F.col("id") * 7919).alias("k")).union(spark.range(10).select(F.col("id") * 7919))
    numbers = sorted(r["n"] for r in dense_numbers(df, "k", "n", buckets=16).collect())
    assert numbers == list(range(1000))


def test_exact_quantiles_from_ranges(spark):
    values = [random.Random(5).gauss(0, 1) for _ in range(5000)] + [0.25] * 2500
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert kth_smallest(df, F.col("v"), 1234) == sorted(values)[1234]
    got = exact_quantiles(df, F.col("v"), [0.0, 0.5, 0.7, 1.0])
    assert got == pytest.approx(np.quantile(values, [0.0, 0.5, 0.7, 1.0]))
    assert exact_quantiles(df.where("v > 100"), F.col("v"), [0.5]) == [None]


def test_sessionize_across_midnight(spark):
    rows, df = _interactions(spark, 600)
    got = {r["row"]: r["session_no"] for r in features.sessionize(df, ROLES, gap_seconds=4001).collect()}
    for user in {r[0] for r in rows}:
        number, last = 0, None
        for r in sorted((r for r in rows if r[0] == user), key=lambda r: (r[3], r[4])):
            number += last is None or r[3] - last >= 4001
            last = r[3]
            assert got[r[4]] == number


def test_business_hours_and_weekend(spark):
    stamps = ["2024-01-05 08:59:00", "2024-01-05 09:00:00", "2024-01-05 17:59:00", "2024-01-05 18:00:00",
              "2024-01-06 12:00:00", "2024-01-07 12:00:00", "2024-01-08 12:00:00"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(stamps)], "i int, ts string")
    rows = features.temporal_features(df, Roles()).orderBy("i").collect()
    assert [r["is_business_hours"] for r in rows[:4]] == [False, True, True, False]
    assert [r["day_of_week"] for r in rows[4:]] == [6, 7, 1]
    assert [r["is_weekend"] for r in rows[4:]] == [True, True, False]


def test_recency_counts_whole_days(spark):
    df = spark.sql("SELECT 1 AS user_id, TIMESTAMP '2024-01-31 23:59:59' AS ts")
    assert features.recency_days(df, Roles(), "2024-02-01 00:00:01").first()["recency_days"] == 0


def test_constant_signal_is_not_scaled(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 2.0)], "user_id int, signal double")
    assert "signal_normalized" not in features.minmax_signal(df, Roles()).columns


def test_single_row_user_has_no_deviation(spark):
    _, df = _interactions(spark, 1)
    assert features.user_features(df, ROLES).first()["user_signal_std"] is None


def test_finalize_keeps_below_half_nulls(spark):
    rows = [(None if i < 50 else 1, None if i < 49 else "x", i % 3 == 0) for i in range(100)]
    made = features.finalize_features(spark.createDataFrame(rows, "half int, less string, flag boolean"))
    assert made.columns == ["less", "flag"]
    assert {(r["less"], r["flag"]) for r in made.collect()} == {("UNKNOWN", True), ("UNKNOWN", False), ("x", True), ("x", False)}
    assert made.count() == 4


def test_deep_features_respect_the_limit(spark):
    _, df = _interactions(spark, 50)
    base = df.select("user_id", "item_id", "signal")
    assert len(features.deep_features(base, Roles(), max_new=5).columns) == 8
    assert "items.MAX(1 / signal)" in features.deep_features(base, Roles(), max_new=500).columns


def test_two_hop_reach_is_close(spark):
    rows, df = _interactions(spark, 300)
    users_of = {}
    for user, item, *_ in rows:
        users_of.setdefault(item, set()).add(user)
    for r in features.two_hop_reach(df, ROLES).collect():
        exact = set().union(*[u for u in users_of.values() if r["user_id"] in u])
        assert r["two_hop_reach"] == pytest.approx(len(exact), rel=0.1)


def test_two_hop_reach_is_near_the_exact_reach_of_seeds(spark):
    rng = random.Random(7)
    edges = [(int(300 * rng.random() ** 2), rng.randrange(400)) for _ in range(2000)]
    df = spark.createDataFrame([(u, i, 1.0) for u, i in edges], "user_id long, item_id long, signal double")
    distinct = set(edges)
    exact = {r["user_id"]: r["reach"] for r in features.two_hop_exact(df, ROLES, df.where("user_id % 5 = 0")).collect()}
    estimate = {r["user_id"]: r["two_hop_reach"] for r in features.two_hop_reach(df, ROLES, lg_k=12).collect()}
    assert set(estimate) == {u for u, _ in edges} and set(exact) == {u for u in estimate if u % 5 == 0}
    for user, reach in exact.items():
        assert reach == len({u for u, i in distinct if (user, i) in distinct})
        assert abs(estimate[user] - reach) <= 0.1 * reach


def test_two_hop_reach_query_has_every_user(spark):
    got = catalog.QUERIES["e22_two_hop_reach"](spark, SF_DIR)
    users = order_interactions(spark, SF_DIR).select("user_id").distinct()
    assert got.columns == ["user_id", "two_hop_reach"]
    assert got.count() == users.count() == got.join(users, "user_id").count()


def test_negatives_are_new_to_the_user(spark):
    rows, df = _interactions(spark, 60)
    seen = {(r[0], r[1]) for r in rows}
    made = prep.negative_samples(df, ROLES, ratio=4).collect()
    items = {r[1] for r in rows}
    open_pairs = [p for p in seen if {i for u, i in seen if u == p[0]} != items]
    assert len(made) == 4 * len(open_pairs) > 0
    assert not {(r["user_id"], r["negative_item"]) for r in made} & seen


def test_listwise_groups_are_full(spark):
    rows, df = _interactions(spark, 95)
    sizes = prep.listwise_groups(df, ROLES, 10).groupBy("user_id", "list_no").count().collect()
    assert all(r["count"] == 10 for r in sizes)
    users = [r[0] for r in rows]
    assert len(sizes) == sum(users.count(u) // 10 for u in set(users))


def test_replay_buffer_breaks_ties_by_key(spark):
    rows, df = _interactions(spark, 300)
    kept = {r["row"] for r in replay_buffer(df, "ts", "row", max_size=77, sample_ratio=1.0).collect()}
    assert kept == {r[4] for r in sorted(rows, key=lambda r: (r[3], r[4]))[-77:]}


def test_pick_label(spark):
    assert prep.pick_label(spark.sql("SELECT 1 AS a, 2 AS rating, 'x' AS s")) == "rating"
    assert prep.pick_label(spark.sql("SELECT 1 AS a, 2 AS b, 'x' AS s")) == "b"
    with pytest.raises(ValueError):
        prep.pick_label(spark.sql("SELECT 'x' AS s"))


def test_positions_with_null_keys_and_one_hot_day(spark):
    rows = [(1, "2024-01-01 10:00:00", i) for i in range(200)] + [(None, "2024-01-01 10:00:00", 900 + i) for i in range(90)] + [(2, None, 999)]
    df = spark.createDataFrame(rows, "u long, ts string, n long")
    got = {r["n"]: r["p"] for r in position_in_group(df, ["u"], "ts", ["n"], "p").collect()}
    assert got == {**{i: i + 1 for i in range(200)}, **{900 + i: None for i in range(90)}, 999: None}


def test_every_category_column_gets_an_index(spark):
    df = spark.createDataFrame([("x", f"2024-01-0{d} 00:00:00") for d in range(1, 4)], "v string, ts string")
    wide = df.select("ts", *[F.concat("v", F.lit(str(i)), "ts").alias(f"c{i}") for i in range(12)])
    made = prep.index_categories(wide, [f"c{i}" for i in range(12)], "ts")
    assert all({r[f"c{i}_index"] for r in made.collect()} == {1, 2, 3} for i in range(12))


@pytest.mark.parametrize("batch", [3, 10_000])
def test_a_hot_key_of_one_day_spreads_over_all_ranges(spark, batch, monkeypatch):
    """A third of the rows are one key on one day; keys and pauses also change exactly where a range or an Arrow batch ends."""
    rng = random.Random(8)
    rows = [(1, 1_700_000_000 + rng.randrange(400), k) for k in range(1500)]
    rows += [(rng.choice([None, 2, 3, 4]), rng.choice([None, 1_700_000_000 + rng.randrange(90) * 900]), 1500 + k) for k in range(2500)]
    rows += [(9, 1_700_000_000, 10**6)] * 500  # wholly equal rows
    df = spark.createDataFrame(rows, "user_id long, s long, row long").withColumn("ts", F.timestamp_seconds("s"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    written = []
    monkeypatch.setattr(ordering, "materialize", lambda frame, name: written.append(ordering_materialize(frame, name)) or written[-1])
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        found = scan_by_key(df, ["user_id"], "ts", ["row"], gap_seconds=1800).collect()
        parts = [r["n"] for r in written[0].groupBy("__range").agg(F.count(F.lit(1)).alias("n")).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(found) == len(rows) and len(parts) >= 12 and max(parts) < len(rows) / 5
    for user in {r[0] for r in rows}:
        mine = sorted((r for r in found if r["user_id"] == user and r["s"] is not None), key=lambda r: r["__position"] or 0)
        if user is None:
            assert all(r["__position"] is None and r["__session"] is None for r in mine)
            continue
        assert [r["__position"] for r in mine] == list(range(1, len(mine) + 1))
        assert [(r["s"], r["row"]) for r in mine] == sorted((r[1], r[2]) for r in rows if r[0] == user and r[1] is not None)
        number, last = 0, None
        for r in mine:
            number += last is None or r["s"] - last >= 1800
            last = r["s"]
            assert r["__session"] == number
    assert all(r["__position"] is None for r in found if r["s"] is None)


def test_exact_reach_by_bitmaps(spark):
    """Numbers of users beyond one bitmap, an item that all share, repeated edges, nulls."""
    rows = [(u, u % 7) for u in range(300)] + [(u, 1000 + u // 3) for u in range(300)] + [(5, 5), (5, None), (None, 3)]
    df = spark.createDataFrame(rows, "user_id long, item_id long")
    users = {}
    for u, i in rows:
        if u is not None and i is not None:
            users.setdefault(i, set()).add(u)
    got = {r["user_id"]: r["reach"] for r in features.two_hop_counts(df, ROLES).collect()}
    assert got == {u: len(set().union(*(m for m in users.values() if u in m))) for u in range(300)}
    many = spark.range(70_000).select(F.col("id").alias("user_id"), F.lit(1).alias("item_id"))
    assert features.two_hop_counts(many, ROLES).select("reach").distinct().collect() == [(70_000,)]
    assert features.two_hop_counts(df.where("user_id > 999"), ROLES).count() == 0


def test_reach_by_lists_pieces_and_bitmaps(spark, monkeypatch):
    """Items of few users, of several lists and of more than one in 32 users give the same as sets do."""
    monkeypatch.setattr(features, "LIST_USERS", 4)
    monkeypatch.setattr(features, "_FLAT_ROWS", 7)
    rows = [(u, u // 2) for u in range(400)] + [(u, 1000 + u % 40) for u in range(400)] + [(u, 2000) for u in range(0, 400, 9)]
    df = spark.createDataFrame(rows, "user_id long, item_id long")
    users = {}
    for u, i in rows:
        users.setdefault(i, set()).add(u)
    wanted = {u: len(set().union(*(m for m in users.values() if u in m))) for u in range(400)}
    assert {r["user_id"]: r["reach"] for r in features.two_hop_counts(df, ROLES).collect()} == wanted


def test_reach_of_small_items_sends_no_bitmaps(spark):
    """A bitmap takes 4 KB for each item and 32,768 users, however few the item has."""
    df = spark.range(3000).select(F.col("id").alias("user_id"), F.expr("id DIV 2").alias("item_id"))
    counts = features.two_hop_counts(df, ROLES)
    assert "bitmap" not in counts._jdf.queryExecution().toString()
    assert counts.select("reach").distinct().collect() == [(2,)]


def test_sketch_of_a_short_list_is_exact(spark):
    df = spark.range(600).select(F.col("id").alias("user_id"), F.lit(1).alias("item_id")).unionByName(
        spark.createDataFrame([(None, 1), (None, 7), (3, None)], "user_id long, item_id int"))
    got = {r["user_id"]: r["two_hop_reach"] for r in features.two_hop_reach(df, ROLES, lg_k=10).collect()}
    assert got == {u: 600 for u in [None, *range(600)]}
    many = spark.range(20_000).select(F.col("id").alias("user_id"), (F.col("id") % 2).alias("item_id"))
    assert all(abs(r[0] - 10_000) < 1_000 for r in features.two_hop_reach(many, ROLES, lg_k=12).select("two_hop_reach").distinct().collect())


def test_specs_query_carries_no_column_that_nothing_uses(spark, monkeypatch):
    from tessela.plans import q_features

    rows = spark.createDataFrame([], "user_id long, item_id long, signal double, ts timestamp, session_id long, category string, brand string, title string, "
                                     "price double, segment string, line_no int, supplier_id long, amount double")
    seen = []
    monkeypatch.setattr(q_features, "order_interactions", lambda *_: rows)
    monkeypatch.setattr(q_features.specs, "features_from_specs", lambda df, *_: seen.extend(df.columns) or 1 / 0)
    with pytest.raises(ZeroDivisionError):
        q_features.e16(spark, "nowhere")
    assert sorted(seen) == sorted(c for c in rows.columns if c not in ("category", "brand", "title", "segment"))
