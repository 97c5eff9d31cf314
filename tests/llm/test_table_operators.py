"""Mixing, packing, token files, vectors and the pipeline against plain Python."""

from __future__ import annotations

import itertools
import math
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as driver
import corpus_pipeline
from tessela.llm import mixing, packing, rabitq, spann, tokens, vectors

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path(tokens.VOCABULARY)
SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- mixing ---------------------------------------------------------------------------------------------------------

def _targets(sizes: dict, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = total / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        target |= {s: 2.0 * sizes[s] for s in full}
        total -= sum(2 * sizes[s] for s in full)
        open_ -= full
    return target


def _checked_mix(documents):
    rows = mixing.mix(documents, fan=4).collect()
    sizes, taken, largest = {}, {}, {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        largest[r["source"]] = max(largest.get(r["source"], 0), r["size"])
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2
    want = _targets(sizes)
    for s in sizes:
        assert {(r["source_size"], round(r["target"], 4)) for r in rows if r["source"] == s} == {(sizes[s], round(want[s], 4))}
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6
    return rows


def test_mix_meets_its_targets(spark, edges, empty):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    rows = _checked_mix(documents)
    key = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["size"], r["taken"])
    again = mixing.mix(documents.repartition(7), fan=4).collect()
    assert sorted(map(key, rows)) == sorted(map(key, again))
    assert len(rows) == documents.count()
    assert len(_checked_mix(edges)) == edges.count()
    assert mixing.mix(empty).count() == 0


def test_a_step_keeps_the_weighted_sum_and_settles_one(spark):
    rng = np.random.default_rng(4)
    rows = [(k, int(a), int(b), float(p), float(q)) for k, (a, b, p, q) in enumerate(zip(rng.integers(1, 50, 300), rng.integers(1, 50, 300), rng.random(300), rng.random(300), strict=True))]
    df = spark.createDataFrame(rows, "k long, a long, b long, p double, q double")
    doc = lambda size, p, tie: F.struct(F.col(size).alias("size"), (F.col("k") * 2 + tie).alias("tie"), F.col("k").alias("doc_id"), F.col(p).alias("p"))
    for r in df.withColumn("m", mixing._pivot(doc("a", "p", 0), doc("b", "q", 1), 0)).collect():
        done, carry = r["m"]["done"], r["m"]["carry"]
        assert done["p"] in (0.0, 1.0) and -1e-9 <= carry["p"] <= 1 + 1e-9
        assert done["size"] * done["p"] + carry["size"] * carry["p"] == pytest.approx(r["a"] * r["p"] + r["b"] * r["q"])


def test_rows_are_taken_as_often_as_drawn(spark):
    documents = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (None, "d"), (2, "b")], "doc_id long, copies string")
    copies = spark.createDataFrame([(1, 0), (2, 2), (2, 2), (3, 1)], "doc_id long, copies long")
    got = sorted((r["doc_id"] or 0, r["copies"]) for r in mixing.take(documents, copies).collect())
    assert got == [(0, "d"), (2, "b"), (2, "b"), (2, "b"), (2, "b"), (3, "c")]


# ---- packing --------------------------------------------------------------------------------------------------------

@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(0, 60), st.integers(1, 9), min_size=1, max_size=8), st.integers(1, 4))
def test_ceilings_are_optimal(histogram, buckets):
    lengths = sorted(histogram)
    pad = lambda tops: sum(n * (min(t for t in tops if t >= x) - x) for x, n in histogram.items())
    best = min(pad((*c, lengths[-1])) for k in range(buckets) for c in itertools.combinations(lengths[:-1], min(k, len(lengths) - 1)))
    got = packing.best_ceilings(np.array(lengths), np.array([histogram[x] for x in lengths]), buckets)
    assert len(got) <= buckets and pad(got) == best


def test_batches_are_full_and_whole(spark, edges, empty, monkeypatch):
    monkeypatch.setattr(packing, "PART_ROWS", 10)
    words = edges.select("*", F.lit(7).alias("slot"), packing.word_count(F.col("text")).alias("words"))
    out = packing.pack(words, F.col("words"), buckets=4, budget=300).toPandas()
    assert len(out) == edges.count() and (out["padding"] >= 0).all()
    for (_, ceiling), part in out.groupby(["bucket", "bucket_len"]):
        capacity = max(1, 300 // max(1, ceiling))
        places = sorted(zip(part["batch_id"], part["slot"], strict=True))
        assert places == [divmod(k, capacity) for k in range(len(part))]
    assert packing.pack(empty.withColumn("words", F.lit(1)), F.col("words")).count() == 0


# ---- token files ----------------------------------------------------------------------------------------------------

@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 70_000)), max_size=1500), st.integers(0, 10**6))
def test_codes_give_back_any_position(ids, seed):
    ids = np.array(ids, np.uint32)
    codes = tokens.Codes.build(ids)
    at = np.random.default_rng(seed).permutation(len(ids))
    assert (codes.get(at) == ids[at]).all()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=["'", "s", "t", "r", "e", "l", "v", "d", " ", "\n", "\t", "a", "É", "1", "²", "!", "日", " ", "\x85", "\x1c"], max_size=14), min_size=1, max_size=5))
def test_pieces_encode_as_the_library_does(texts):
    encode = tokens.encoder(VOCABULARY)
    ids, sizes = encode.encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [encode.library.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_full_store_starts_anew():
    encode = tokens.PieceEncoder(VOCABULARY, cache=5)
    for text in ("one two three", "four five six", "one two seven", "one two three"):
        assert encode.encode([text])[0].tolist() == encode.library.encode(text, add_special_tokens=False).ids


def test_token_files_round_trip(spark, edges, empty, tmp_path):
    manifest = tokens.write_tokens(edges, f"file://{tmp_path}/t", VOCABULARY, shard_ids=2000)
    got = tokens.read_tokens(manifest).toPandas().sort_values("start", kind="stable")
    library = tokens.encoder(VOCABULARY).library
    rows = sorted(((r["doc_id"], r["text"] or "") for r in edges.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    start, sequence = 0, []
    for (doc, text), r in zip(rows, got.itertuples(), strict=True):
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        assert (doc if doc is not None else -1) == (r.doc_id if not math.isnan(r.doc_id) else -1) or doc == 2**62
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) and list(r.ids) == ids
        start, sequence = start + len(ids), sequence + ids
    assert manifest.count() > 3
    asked = spark.createDataFrame([(int(p),) for p in (0, 5, start // 2, start - 1, start, -1)], "position long")
    found = {r["position"]: r["id"] for r in tokens.token_at(manifest, asked).collect()}
    assert found == {p: sequence[p] for p in (0, 5, start // 2, start - 1)}
    assert tokens.read_tokens(tokens.write_tokens(empty, f"file://{tmp_path}/e", VOCABULARY)).count() == 0


# ---- vectors --------------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def cloud(spark):
    """Vectors with clusters, copies, ties, scaled copies and all that is not valid."""
    rng = np.random.default_rng(8)
    v = rng.normal(size=(700, 24))
    v[100:160] = v[100] + 0.12 * rng.normal(size=(60, 24))
    v[200:230] = v[200]
    v[230:240] = 3.0 * v[200]
    rows = [(k, [float(np.float32(x)) for x in u], 1, 2) for k, u in enumerate(v)]
    rows += [(1000, None, 1, 2), (1001, [0.0] * 24, 1, 2), (1002, [float("nan")] * 24, 1, 2), (1003, [float("inf")] + [1.0] * 23, 1, 2), (1004, [1.0] * 5, 1, 2),
             (1005, [], 1, 2), (1006, [None] + [1.0] * 23, 1, 2), (None, rows[0][1], 1, 2), (3, rows[3][1], 1, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rep long, copies long").repartition(4)
    return df, v.astype(np.float32).astype(np.float64)


def _unit(v):
    return v / np.sqrt((v * v).sum(1))[:, None]


@pytest.mark.parametrize("block", [1024, 8])
def test_links_are_those_of_all_pairs(cloud, monkeypatch, block):
    monkeypatch.setattr(rabitq, "BLOCK", block)
    df, v = cloud
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in rabitq.near_vectors(df.where("vec_id IS NOT NULL"), 0.95).dropDuplicates(["vec_id"]).collect()}
    s = _unit(v) @ _unit(v).T >= 0.95
    label = np.arange(len(v))
    for _ in range(60):
        label = np.array([label[s[i]].min() for i in range(len(v))])
    for k in range(len(v)):
        extra = 1 if k == 3 else 0  # this row stands twice in the table
        assert got[k] == (s[k].sum() - 1 + extra, label[k], bool(label[k] == k))
    assert all(got[k] == (0, k, True) for k in range(1000, 1007))
    assert s.sum() > 3000


@pytest.mark.parametrize("rank", [3, 8])
def test_links_near_a_subspace_equal_all_pairs(spark, rank):
    rng = np.random.default_rng(rank)
    v = rng.normal(size=(700, rank))
    v = np.concatenate([v, v + 0.25 * rng.normal(size=v.shape) * np.linalg.norm(v, axis=1, keepdims=True) / np.sqrt(rank)]) @ rng.normal(size=(rank, 64))
    s = _unit(v) @ _unit(v).T
    assert np.abs(s - 0.95).min() > 1e-9
    want = (s >= 0.95).sum(1) - 1
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in rabitq.near_vectors(df, 0.95).collect()}
    assert [got[k] for k in range(len(v))] == list(want)
    # the result does not depend on the number of cells
    rows = df.select(F.col("vec_id").alias("rep"), F.lit(1).cast("long").alias("copies"), F.col("embedding").alias("v"))
    found = rabitq.linked(rows, vectors.balanced_centroids(_unit(v), 64), 0.95).where("b IS NULL").groupBy("a").agg(F.sum("n").alias("n"))
    links = {r["a"]: r["n"] for r in found.collect()}
    assert [links.get(k, 0) for k in range(len(v))] == list(want)


def test_a_vector_goes_to_few_tiles(spark, monkeypatch):
    monkeypatch.setattr(rabitq, "BLOCK", 8)
    one = spark.range(700).select(F.col("id").alias("rep"), F.lit(0).alias("cell"), F.lit(0).alias("home"))
    copies = rabitq._tiles(one).where("NOT hosting").groupBy("rep").count().agg(F.count(F.lit(1)), F.max("count")).first()
    assert tuple(copies) == (700, 16)


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(3)
    x = _unit(rng.normal(size=(300, 64)))
    y = _unit(0.5 * x + 0.1 * rng.normal(size=x.shape))
    turn = rabitq.rotation(64)
    bits, factor = rabitq.encode(x, turn)
    true = (x * y).sum(1)
    error = np.diag(rabitq.estimates(bits, factor, y @ turn)) - true
    assert abs(error.mean()) < 0.02
    deviation = np.sqrt(1 - true**2) * np.sqrt(1 - factor**2) / (factor * np.sqrt(63))
    assert (np.abs(error) < rabitq.EPSILON * deviation).all()


def test_no_vectors(spark):
    none = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert rabitq.near_vectors(none, 0.95).collect() == [(1, 0, 1, True)]
    assert rabitq.near_vectors(none.limit(0), 0.95).count() == 0
    assert spann.knn(none, F.lit(True), 5).count() == 0


def test_every_length_of_vectors_is_compared(spark):
    rng = np.random.default_rng(21)
    rows = []
    for at, dim, n in ((0, 6, 40), (100, 9, 30), (200, 4, 1)):
        v = rng.normal(size=(n, dim))
        v[n // 2:] = v[: n - n // 2] * 2.0
        rows += [(at + k, [float(x) for x in u]) for k, u in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    cosine = {(a, b): float(_unit(np.array([x]))[0] @ _unit(np.array([y]))[0]) for a, x in rows for b, y in rows if a != b and len(x) == len(y)}
    linked = {a: {b for b, _ in rows if cosine.get((a, b), -1) >= 0.95} for a, _ in rows}
    got = {r["vec_id"]: r["n_links"] for r in rabitq.near_vectors(df, 0.95).collect()}
    assert got == {a: len(b) for a, b in linked.items()} and got[0] and got[100]
    found = spann.knn(df, F.lit(True), 3, ratio=2.0).toPandas()
    want = {(a, r + 1, b) for a, _ in rows for r, b in enumerate(sorted((b for b, _ in rows if (a, b) in cosine), key=lambda b: (-round(cosine[a, b], 12), b))[:3])}
    assert set(zip(found["query_id"], found["rank"], found["vec_id"])) == want


@pytest.mark.parametrize("block", [4096, 16])
def test_search_recall_scores_and_ties(cloud, monkeypatch, block):
    monkeypatch.setattr(spann, "BASE_BLOCK", block)
    df, v = cloud
    got = spann.knn(df, F.col("vec_id") % 7 == 0, 5, ratio=0.6).toPandas()
    u = _unit(v)
    hit = total = 0
    for q, part in got.groupby("query_id"):
        part = part.sort_values("rank")
        s = u @ u[q]
        s[q] = -9
        best = np.lexsort((np.arange(len(v)), -s.round(12)))[:5]
        hit, total = hit + len(set(best) & set(part["vec_id"])), total + 5
        assert np.abs(part["score"] - s[part["vec_id"]]).max() < 1e-12 and list(part["rank"]) == [1, 2, 3, 4, 5]
        if 200 <= q < 230:
            assert list(part["vec_id"])[0] == (200 if q != 200 else 201)
    assert set(got["query_id"]) == set(range(0, 700, 7)) and hit / total >= 0.9


def test_search_returns_all_when_there_are_few(spark):
    df = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(4)], "vec_id long, embedding array<float>")
    got = spann.knn(df, F.lit(True), 5)
    assert got.count() == 12 and got.agg(F.max("rank")).first()[0] == 3


def test_recall_on_the_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = driver.queries()["op3_nearest_neighbours"](spark, "/root/testdata/sf0.01").toPandas()
    table = df.toPandas().sort_values("vec_id")
    ids, u = table["vec_id"].to_numpy(), _unit(np.stack(table["embedding"]).astype(np.float64))
    hit = 0
    for q, part in got.groupby("query_id"):
        s = u @ u[ids == q][0]
        s[ids == q] = -9
        hit += len(set(ids[np.lexsort((ids, -s))[:5]]) & set(part["vec_id"]))
    assert hit / (5 * got["query_id"].nunique()) >= 0.9 and len(got) == 50


def test_graph_search_reaches_what_a_scan_finds():
    rng = np.random.default_rng(6)
    centroids = _unit(rng.normal(size=(300, 16)))
    q = _unit(rng.normal(size=(40, 16)))
    found = vectors.CentroidGraph(centroids).search(q, 0.2, 16)
    true = np.sqrt(2 - 2 * q @ centroids.T)
    want = true <= true.min(axis=1, keepdims=True) * 1.2
    assert np.isfinite(found)[want].mean() > 0.99 and np.abs(found - true)[np.isfinite(found)].max() < 1e-3


# ---- pipeline -------------------------------------------------------------------------------------------------------

def test_stages_do_what_their_operators_say(spark, edges):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "jaccard_join", "pii", "mixing", "packing"]
    docs = edges
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SF)
        assert docs.columns == columns, name
        docs = docs.cache()
        if name == "language_id":
            assert {r["doc_id"] for r in before.collect()} - {r["doc_id"] for r in docs.collect()} == {1, 2, 3, 16}
        elif name == "jaccard_join":
            ids = [r["doc_id"] for r in docs.collect()]
            assert len(ids) == len(set(ids)) and 8 not in ids and 7 in ids and None in ids and 9 not in ids
        elif name == "pii":
            assert docs.where("doc_id = 15").first()["text"].endswith("<IP>") and docs.count() == before.count()
        else:
            ours, theirs = docs.groupBy("doc_id").count().collect(), {r["doc_id"] for r in before.collect()}
            assert all(r["count"] <= 2 and r["doc_id"] in theirs for r in ours)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.count() == docs.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, edges.limit(0), SF).count() == 0


def test_different_texts_of_one_id_all_stay(spark):
    """No text goes because another has its id, nor because it resembles one that shares an id with a third."""
    rng = np.random.default_rng(1)
    text = lambda: " ".join(f"w{k}" for k in rng.integers(0, 10_000, 60))
    a, b, c, d = (text() for _ in range(4))
    fields = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, a, "en", "x", 1), (1, b, "en", "x", 1), (1, b, "en", "x", 1), (2, b + " tail", "en", "x", 1), (3, c, "en", "x", 1), (-4, c, "en", "x", 1),
            (5, None, "en", "x", None), (5, d, "en", "x", 1), (None, a, "en", "x", 1), (None, a, "en", "x", 1)]
    for extreme in ([], [((1 << 63) - 1, text(), "en", "x", 1)], [((1 << 63) - 1, text(), "en", "x", 1), (-(1 << 63), text(), "en", "x", 1)]):
        docs = spark.createDataFrame(rows + extreme, fields).repartition(3).cache()
        got = corpus_pipeline.near_duplicates(spark, docs, SF)
        assert got.columns == docs.columns
        want = [(1, a), (1, b), (-4, c), (5, None), (5, d), (None, a), (None, a)] + [(r[0], r[1]) for r in extreme]
        assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted(want, key=str)


def test_texts_of_several_languages_stay(spark):
    own = {"l1": "aba abba baba", "l2": "coco occo coc", "l3": "didi iddi did"}
    rows = [(k, own[x] + f" {own[x]}", x) for k, x in enumerate(own)] + [(10, " ".join(own.values()), None), (11, "12 34 !", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in corpus_pipeline.language(spark, docs, SF).collect()} == {0, 1, 2, 10}


def test_every_operator_is_registered():
    names = driver.queries()
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names
