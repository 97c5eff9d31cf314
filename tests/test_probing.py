"""Bounded probing, threshold joins by pivots, and models that go on, against brute force on small fixtures."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tessela.operators import ann, models, probing


def _table(spark, m):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, vector array<double>")


@pytest.fixture(scope="module")
def clusters(spark):
    """Eight tight clusters of unit vectors, one of them with 40 equal rows, and a zero vector."""
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(8, 12))
    m = np.repeat(centers / np.linalg.norm(centers, axis=1, keepdims=True), 25, axis=0)
    m = m + rng.normal(size=m.shape) * 0.03
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    m = np.vstack([m, np.repeat(m[:1], 40, axis=0), np.zeros((1, 12))])
    return m, _table(spark, m)


def test_bounded_probing_is_exact_and_leaves_cells_out(clusters):
    m, base = clusters
    found = probing.ivf_search_bounded(base.withColumnRenamed("id", "query_id"), ann.ivf_build(base, nlist=8), 5, exclude_self=True, first=1)
    scores = np.round(m @ m.T, 9)
    wanted = {(q, i, r + 1) for q in range(len(m))
              for r, i in enumerate(sorted((i for i in range(len(m)) if i != q), key=lambda i: (-scores[q, i], i))[:5])}
    assert {(r["query_id"], r["id"], r["rank"]) for r in found.found.collect()} == wanted
    assert 0 < found.share < 0.5


@pytest.mark.parametrize("threshold", [0.9, -0.2])
def test_pivots_lose_no_pair(spark, clusters, threshold):
    m, base = clusters
    queries = base.withColumnRenamed("id", "query_id")
    scores = np.round(m @ m.T, 9)
    got = probing.similar_above_pruned(queries, base.selectExpr("id", "vector", "CAST(id AS double) AS value"), threshold)
    counted = {r["query_id"]: r["neighbours"] for r in got.collect()}
    assert counted == {q: int(n) for q, n in enumerate((scores >= threshold).sum(axis=1)) if n}
    if threshold > 0.5:
        assert ann.candidate_share(*probing.pivot_cells(queries, base, threshold)).first()["share"] < 0.5


def test_pivots_without_vectors(spark):
    none = _table(spark, np.zeros((0, 2)))
    some = _table(spark, np.ones((2, 2))).withColumnRenamed("id", "query_id")
    assert probing.topk_above(some, none, 0.5).count() == 0


def test_a_ladder_goes_on_from_its_last_rung(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3))
    rows = [([float(v) for v in r], float(r @ [2.0, -1.0, 0.0] > 0)) for r in x]
    df = spark.createDataFrame(rows, "f array<double>, label double").select(array_to_vector("f").alias("features"), "label").cache()
    stopped = models.fit_until_flat(df, (1, 2, 3, 4, 5, 6, 7, 8), patience=2)
    assert stopped.iterations == stopped.history[-1][0] and stopped.metric > 0.97
    assert stopped.metric >= max(v for _, v in stopped.history) - 1e-4


def test_a_category_per_row_keeps_the_model_small(spark):
    rows = spark.range(500).selectExpr("CAST(id AS string) AS c", "id / 500 AS x", "CAST(id % 2 AS double) AS label")
    model = models.fit_ctr(rows, ("x",), ("c",), factor_size=2, iterations=2, hash_bits=6)
    assert model.stages[-1].linear.size == 64 and models.score(rows, model).where("score IS NULL").count() == 0


def test_probes_are_the_cheapest_cells():
    hashes = ann.HashTables(5, bucket_length=0.4, tables=2, width=3)
    x = np.random.default_rng(3).normal(size=(20, 5))
    at = (x @ hashes.projections).reshape(20, 2, 3)
    got = hashes.cells(x, 6)
    for row in range(20):
        for table in range(2):
            costs = {}
            for step in np.ndindex(3, 3, 3):
                delta = np.array([0, -1, 1])[list(step)]
                inside = at[row, table] - np.floor(at[row, table])
                cell = (np.floor(at[row, table]) + delta).astype(np.int64).astype(np.uint64) * hashes.factors[table]
                costs[int((cell.sum(dtype=np.uint64, initial=hashes.starts[table])).astype(np.int64))] = (
                    np.where(delta < 0, inside, np.where(delta > 0, 1 - inside, 0)) ** 2).sum()
            assert set(got[row, table].tolist()) == set(sorted(costs, key=costs.get)[:6])


def test_multiprobe_finds_more_than_the_own_cell(spark, clusters):
    m, base = clusters
    queries, hashes = base.withColumnRenamed("id", "query_id"), ann.HashTables(12, tables=2, width=8)
    exact = ann.knn_exact(queries, base, 10, exclude_self=True)
    recall, share = {}, {}
    for probes in (1, 6):
        found = ann.knn_multiprobe(queries, base, hashes, 10, probes, exclude_self=True)
        recall[probes] = ann.search_recall(exact, found).first()["recall"]
        cells, own = hashes.cells(m, probes), hashes.cells(m, 1)[:, :, 0]
        met = np.array([[any(own[b, t] in cells[q, t] for t in range(2)) for b in range(len(m))] for q in range(len(m))]).mean()
        share[probes] = ann.multiprobe_share(queries, base, hashes, probes, block_rows=50).first()["share"]
        assert abs(share[probes] - met) < 1e-12
    assert recall[6] > recall[1] and recall[6] >= 0.9 and share[6] <= 0.3


def test_a_learned_rotation_codes_correlated_parts_better(spark):
    rng = np.random.default_rng(11)
    m = rng.normal(size=(600, 8)) * np.array([4, 3, 2, 1, 0.1, 0.1, 0.1, 0.1])  # nearly all variance in the first half
    base = _table(spark, m)
    plain = ann.pq_build(base, 8, m=2, nbits=3, nlist=1)
    turned = ann.pq_build(base, 8, m=2, nbits=3, nlist=1, rotation_rounds=3)
    assert np.allclose(turned.rotation @ turned.rotation.T, np.eye(8), atol=1e-9)
    assert all(b <= a + 1e-9 for a, b in zip(turned.errors, turned.errors[1:]))

    def error(index):
        left = m - index.centroids[0]
        x = left @ index.rotation
        codes = ann._nearest_codes(x, index.codebooks)
        return ((x - index.codebooks[np.arange(2), codes].reshape(len(x), 8)) ** 2).sum() / len(x)

    assert error(turned) < 0.8 * error(plain)
    queries = base.withColumnRenamed("id", "query_id")
    exact = ann.knn_exact(queries, base, 10, exclude_self=True)
    recalls = [ann.search_recall(exact, ann.pq_search(queries, i, 10, exclude_self=True)).first()["recall"] for i in (plain, turned)]
    assert recalls[1] > recalls[0]


def test_small_tiles_and_many_cells_make_no_copies(spark, clusters):
    """A vector goes once to a block, however small the tiles are and however many of its cells a query visits."""
    m, base = clusters
    queries = base.withColumnRenamed("id", "query_id")
    q, b, _ = ann._grid(queries, base, 8)
    assert (q.count(), b.select("id").distinct().count()) == (len(m), len(m))
    index = ann.ivf_build(base, nlist=8)
    visits = queries.withColumn("cells", ann._nearest_set(F.col("vector"), index.centroids, 8))
    q, b, keys = ann._in_cell_blocks(visits, index.table, ann._cell_sizes(index.table, 8), 10_000)
    assert q.count() == len(m)
    rows = lambda found: sorted(map(tuple, found.select("query_id", "id", "rank").collect()))
    assert rows(ann.ivf_search(queries, index, 3, nprobe=8, block_rows=8)) == rows(ann.knn_exact(queries, base, 3))


def test_cells_in_many_groups_and_slices(spark, clusters, monkeypatch):
    m, base = clusters
    queries, index = base.withColumnRenamed("id", "query_id"), ann.ivf_build(base, nlist=8)
    monkeypatch.setattr(ann, "BLOCK_ROWS", 20)
    rows = lambda found: sorted(map(tuple, found.select("query_id", "id", "rank").collect()))
    wanted = rows(ann.knn_exact(queries, base, 3))
    assert len(wanted) == 3 * len(m) and rows(ann.ivf_search(queries, index, 3, nprobe=8, block_rows=7)) == wanted


def test_bounded_probing_takes_three_rounds(spark, monkeypatch):
    """Random directions, where no cell can be left out: the rounds do not grow with the cells."""
    m = np.random.default_rng(9).normal(size=(300, 12))
    base, written, write = _table(spark, m), [], probing.materialize
    monkeypatch.setattr(probing, "materialize", lambda df, name: written.append(name) or write(df, name))
    found = probing.ivf_search_bounded(base.withColumnRenamed("id", "query_id"), ann.ivf_build(base, nlist=30), 3, first=1, growth=2).found
    scores = np.round(m @ m.T, 9)
    assert {(r["query_id"], r["rank"], r["id"]) for r in found.collect()} == {
        (q, r + 1, i) for q in range(300) for r, i in enumerate(sorted(range(300), key=lambda i: (-scores[q, i], i))[:3])}
    assert written.count("bounded") <= 3


def test_tiles_hand_on_only_what_reaches_the_least_score():
    import pandas as pd

    rng = np.random.default_rng(4)
    m = np.vstack([rng.normal(size=(700, 6)), np.repeat(rng.normal(size=(1, 6)), 30, axis=0)])  # equal rows tie
    queries, base = pd.DataFrame({"query_id": np.arange(730), "vector": list(m)}), pd.DataFrame({"id": np.arange(730), "vector": list(m)})
    scores = np.round(m @ m.T, 9)
    least = np.where(np.arange(730) % 2, 3.0, -np.inf)
    got = ann._top_of_batches(queries, base["id"].to_numpy(), ann._inner_products(queries, base), 4, True, 50, least=least)
    wanted = {(q, i) for q in range(730) for i in sorted((i for i in range(730) if i != q and scores[q, i] >= least[q]), key=lambda i: (-scores[q, i], i))[:4]}
    assert set(zip(got["query_id"], got["id"])) == wanted


def test_a_gradient_of_blocks_is_that_of_the_rows(spark):
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(90, 3)), rng.integers(0, 2, 90)
    df = spark.createDataFrame([([float(v) for v in r], float(t)) for r, t in zip(x, y)], "x array<double>, label double").repartition(4)
    blocks, scale, at = models._blocks(df), np.array([1.0, 2.0, 0.5]), np.array([0.3, -0.2, 0.1])
    assert blocks.count() <= 4 and blocks.agg(F.sum("rows")).first()[0] == 90
    wanted = ((1 / (1 + np.exp(-(x @ (at / scale)))) - y) @ x) / scale / 90
    assert np.allclose(models._loss_gradient(blocks, scale, at), wanted, atol=1e-12)


def test_bounded_probing_hands_on_no_neighbours_between_rounds(spark, clusters, monkeypatch):
    """The first round gives one number per query, and neighbours are not written; blocks of many sizes and queries of one name change nothing."""
    m, base = clusters
    written, write = [], probing.materialize
    monkeypatch.setattr(probing, "materialize", lambda df, name: written.append(df.columns) or write(df, name))
    monkeypatch.setattr(ann, "BLOCK_ROWS", 20)
    monkeypatch.setattr(ann, "CODED_BLOCK_ROWS", 60)
    queries = base.withColumnRenamed("id", "query_id")
    found = probing.ivf_search_bounded(queries, ann.ivf_build(base, nlist=8), 5, exclude_self=True, first=1, block_rows=7).found
    rows = lambda df: sorted(map(tuple, df.select("query_id", "id", "rank").collect()))
    assert rows(found) == rows(ann.knn_exact(queries, base, 5, exclude_self=True)) and not any("id" in c for c in written)
    twice = queries.unionByName(queries.where("query_id < 9").withColumn("query_id", F.col("query_id") + 1))
    found = probing.ivf_search_bounded(twice, ann.ivf_build(base, nlist=8), 5, first=1).found
    scores = lambda df: sorted(map(tuple, df.select("query_id", "rank", "score").collect()))
    assert scores(found) == scores(ann.knn_exact(twice, base, 5))


def test_a_threshold_join_sends_a_query_once(spark, clusters, monkeypatch):
    """However many boxes a query can reach: at -0.2 that is nearly all."""
    m, base = clusters
    queries, sent, blocks = base.withColumnRenamed("id", "query_id"), [], ann._in_blocks
    monkeypatch.setattr(ann, "_in_blocks", lambda q, b, *rest: sent.append((q.count(), b.select("id").distinct().count())) or blocks(q, b, *rest))
    rows = lambda df: sorted(map(tuple, df.select("query_id", "id", "score").collect()))
    for threshold in (-0.2, 0.9):
        got, exact = probing.topk_above(queries, base, threshold, 5, exclude_self=True), ann.knn_exact(queries, base, 5, exclude_self=True)
        assert rows(got) == rows(exact.where(F.col("score") >= threshold))
    assert max(q for q, _ in sent) <= len(m)


def test_a_factorization_machine_takes_the_gradient_of_a_rows_own_places(spark):
    rows = [(c, d, x, float((c == "a") == (d == "b"))) for c in ("a", "b", None) for d in ("a", "b") for x in (0.5, None, -1.0)]
    df = spark.createDataFrame(rows, "c string, d string, x double, label double")
    rng = np.random.default_rng(1)
    machine = models.FactorizationMachine(["x"], ["c", "d"], 0.2, rng.normal(size=16), rng.normal(size=(16, 3)))
    got = df.select(machine.entries().alias("x"), "label").collect()
    x, y, w = np.array([r["x"] for r in got]), np.array([r["label"] for r in got]), machine.weights()

    def loss(weights):
        p = machine.with_weights(weights)._parts(x)[-1]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).sum()

    steps = np.eye(len(w)) * 1e-6
    assert np.allclose(machine.gradient(x, y), [(loss(w + s) - loss(w - s)) / 2e-6 for s in steps], atol=1e-5)
    # a null adds nothing: only the place of d, and of x where it is not null, take part
    assert all((v[0] == 0 if r[2] is None else v[0] == r[2]) and (v[2] == -1) == (r[0] is None) for v, r in zip(x, df.select("c", "d", "x").collect()))
    # only products of two categories tell these labels
    known = df.where("c IS NOT NULL").drop("x")
    fitted = models.fit_ctr(known, (), ("c", "d"), factor_size=3, iterations=150, hash_bits=8)
    assert fitted.transform(known).where("prediction <> label").count() == 0
    with pytest.raises(Exception, match="labels must be 0 or 1"):
        models.fit_ctr(known.withColumn("label", F.lit(None).cast("double")), (), ("c", "d"), factor_size=3, iterations=1, hash_bits=8)


def test_refined_candidates_grow_with_the_rows(spark, monkeypatch):
    """A code tells a share of the order, so a fixed number of candidates loses neighbours in a larger table."""
    m = np.random.default_rng(6).normal(size=(4000, 16))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    base = _table(spark, m)
    queries = base.where("id < 200").withColumnRenamed("id", "query_id")
    index = ann.pq_build(base, 16, m=8, nbits=3, nlist=4)
    monkeypatch.setattr(ann, "BLOCK_ROWS", 1500)
    found = ann.pq_search(queries, index, 10, nprobe=4, exclude_self=True, refine=base, factor=2)
    taken = [r["n"] for r in ann.pq_search(queries, index, 40, nprobe=4, exclude_self=True).groupBy("query_id").agg(F.count("id").alias("n")).collect()]
    exact = ann.knn_exact(queries, base, 10, exclude_self=True)
    best = exact.join(ann.pq_search(queries, index, 40, nprobe=4, exclude_self=True).select("query_id", "id"), ["query_id", "id"])
    twenty = ann.search_recall(exact, ann.pq_search(queries, index, 20, nprobe=4, exclude_self=True)).first()["recall"]
    got = ann.search_recall(exact, found).first()["recall"]
    assert set(taken) == {40} and abs(got - best.count() / 2000) < 1e-9 and got > twenty
    twice = ann._rescored(found.select("query_id", "id"), queries, base.unionByName(base), 40, 1000)
    assert twice.count() == 2 * found.count() == 4000


def test_the_length_of_a_vector_is_taken_once(spark):
    """Not once for each component, which made long vectors cost the square of their length."""
    from tessela.functions import vectors

    df = spark.range(1).select(F.array(*[F.lit(float(x)) for x in (3, 4)]).alias("v"))
    unit = df.select(vectors.l2_normalize(F.col("v")).alias("u"))
    plan = unit._jdf.queryExecution().analyzed().toString()
    assert "array_repeat(" in plan and unit.first()["u"] == [0.6, 0.8]
    odd = spark.createDataFrame([([0.0, 0.0],), (None,), ([],), ([None, 2.0],)], "v array<double>")
    assert [r["u"] for r in odd.select(vectors.l2_normalize(F.col("v")).alias("u")).collect()] == [[0.0, 0.0], None, [], [None, 2.0]]


def test_a_second_round_scores_what_enough_rows_reach(spark, clusters, monkeypatch):
    """Candidates stay in their blocks: what the rounds hand on is a few numbers and k rows of each query and block, and the neighbours are those of the codes."""
    m, base = clusters
    queries, sent, blocks = base.withColumnRenamed("id", "query_id"), [], ann._in_blocks
    index = ann.pq_build(base, m.shape[1], m=2, nbits=3, nlist=4)
    decoded = ann._decoded_products(index)
    flat = index.table.orderBy("id").toPandas()
    asked = queries.orderBy("query_id").toPandas()
    code = np.round(decoded(asked, flat)(slice(None), slice(None)), 9)
    exact, n = np.round(m @ m.T, 9), len(m)
    np.fill_diagonal(code, -np.inf)
    monkeypatch.setattr(ann, "_in_blocks", lambda q, b, keys, work, schema: sent.append(out := blocks(q, b, keys, work, schema)) or out)
    for coded_rows in (10_000, 60):
        monkeypatch.setattr(ann, "CODED_BLOCK_ROWS", coded_rows)
        monkeypatch.setattr(ann, "BLOCK_ROWS", coded_rows)
        sent.clear()
        got = ann.pq_search(queries, index, 3, nprobe=4, exclude_self=True, refine=base, factor=5)
        rows = {(r["query_id"], r["id"]) for r in got.collect()}
        ranked = -np.sort(-code, axis=1)[:, 14:15]
        wanted = {(q, i) for q in range(n) for i in sorted(np.flatnonzero(code[q] >= ranked[q] - 1e-6), key=lambda i: (-exact[q, i], i))[:3]}
        if coded_rows == 10_000:
            assert rows == wanted
        best = lambda pairs: sum(exact[q, i] for q, i in pairs)
        assert len(rows) == 3 * n and best(rows) >= best(wanted) - 1e-9
        assert max(out.groupBy("query_id").count().agg(F.max("count")).first()[0] for out in sent) <= 3 * max(1, -(-2 * n // coded_rows))


def test_meeting_pairs_are_counted_and_found_alike():
    import pandas as pd

    rng = np.random.default_rng(2)
    probed, own = rng.integers(0, 40, (90, 3, 4)), rng.integers(0, 60, (700, 3))
    meetings = ann._Meetings(pd.Series(list(probed.reshape(90, -1))), pd.Series(list(own)))
    wanted = np.array([[any(b[t] in q[t] for t in range(3)) for b in own] for q in probed])
    assert (meetings.of(slice(0, 90), slice(None)) == wanted).all()
    assert meetings.count(slice(0, 50)) + meetings.count(slice(50, 90)) == wanted.sum()
    row, column = np.nonzero(np.ones_like(wanted))
    assert (meetings.pairs(row, column) == wanted.ravel()).all()


def test_rough_products_lose_no_neighbour():
    import pandas as pd

    rng = np.random.default_rng(3)
    for scale in (1.0, 1e-9, 1e9, 1e200):
        m = rng.normal(size=(3000, 24)) * scale
        m[1500:] = m[:1500] * (1 + 1e-12 * rng.normal(size=(1500, 1)))  # nearly equal scores
        frame = pd.DataFrame({"query_id": np.arange(3000), "id": np.arange(3000), "vector": list(m)})
        products = ann._inner_products(frame.iloc[:60], frame)
        assert (products.rough is None) == (scale == 1e200)
        if products.rough is not None:
            off = np.abs(products.rough(slice(None), slice(None)) - products(slice(None), slice(None)))
            assert (off < products.slack[:, None]).all()
        got = ann._top_of_batches(frame.iloc[:60], np.arange(3000), products, 5, True, 256)
        scores = np.round(products(slice(None), slice(None)), 9)
        for q, part in got.groupby("query_id"):
            best = np.sort(np.delete(scores[q], q))[::-1][:5]
            assert np.allclose(part["score"].to_numpy(), best, rtol=1e-12, atol=1.1e-9)


def test_blocks_of_training_rows_are_bounded(spark):
    """A reader holds thousands of blocks at once, whatever the rows weigh together."""
    rows = spark.range(20_000, numPartitions=2).select(F.array(*[(F.col("id") % 7 + i).cast("double") for i in range(4)]).alias("x"), (F.col("id") % 2).cast("double").alias("label"))
    blocks = models._blocks(rows)
    most, n = blocks.agg(F.max(F.octet_length("x") + F.octet_length("y")), F.sum("rows")).first()
    assert most <= 1.25 * models.BLOCK_BYTES and n == 20_000
    assert models._summed(blocks, lambda x, y: np.array([y.sum(), x[:, 0].sum()])).tolist() == [10_000, sum(i % 7 for i in range(20_000)), 20_000]
