"""Whitening, the Merkle manifest and best-fit packing against plain Python and NumPy."""

from __future__ import annotations

import bisect
import hashlib
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as driver
from tessela.llm import bestfit, merkle, whitening

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path(bestfit.VOCABULARY)
SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<double>, component int, n string"


# ---- whitening ------------------------------------------------------------------------------------------------------

def _matrices():
    rng = np.random.default_rng(0)
    orthonormal = np.linalg.qr(rng.standard_normal((200, 24)))[0]
    turn = np.linalg.qr(rng.standard_normal((24, 24)))[0]
    half = rng.standard_normal((60, 12))
    yield "random", rng.standard_normal((200, 24))
    yield "one column", rng.standard_normal((9, 1))
    yield "two columns", rng.standard_normal((9, 2))
    yield "graded", rng.standard_normal((200, 24)) * np.logspace(0, -7, 24)
    yield "graded upwards", rng.standard_normal((200, 24)) * np.logspace(-7, 0, 24)
    yield "equal values", orthonormal
    yield "clusters", orthonormal * np.repeat([4.0, 3, 2, 1], 6) @ turn
    yield "close values", orthonormal * (1 + 1e-10 * np.arange(24)) @ turn
    yield "repeated columns", np.hstack([half, half])
    yield "fewer rows", rng.standard_normal((5, 24))
    yield "blocks", np.kron(np.eye(4), rng.standard_normal((20, 6)))
    yield "zero", np.zeros((7, 5))
    yield "huge", 1e150 * rng.standard_normal((30, 10))


@pytest.mark.parametrize(("name", "a"), list(_matrices()), ids=[n for n, _ in _matrices()])
def test_solver_agrees_with_numpy(name, a):
    dim = a.shape[1]
    values, vectors = whitening.principal(np.linalg.qr(a, mode="r"), dim)
    want = np.zeros(dim)
    want[: min(a.shape)] = np.linalg.svd(a, compute_uv=False) ** 2
    top = max(want[0], 1e-300)
    assert np.abs(values - want).max() <= 1e-13 * top
    assert np.abs(vectors.T @ vectors - np.eye(dim)).max() <= 1e-12
    assert np.abs((a / np.sqrt(top)).T @ ((a / np.sqrt(top)) @ vectors) - vectors * (values / top)).max() <= 1e-12


def test_small_singular_values_keep_their_digits():
    """A bidiagonal matrix has its singular values to high relative accuracy, however small: 2**-k on the diagonal."""
    diagonal = 2.0 ** -np.arange(0, 60, 3)
    got = whitening.squared_singular_values(diagonal, np.full(len(diagonal) - 1, 0.0))
    assert got == pytest.approx(diagonal**2, rel=1e-15)
    n, x = 6, 1e-9  # product of all values is the determinant, whatever the couplings
    got = whitening.squared_singular_values(np.array([1.0] * (n - 1) + [x]), np.array([1.0] * (n - 1)))
    assert np.sqrt(got).prod() == pytest.approx(x, rel=1e-13)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-2, 2), min_size=5, max_size=5), min_size=1, max_size=12))
def test_solver_on_small_integer_matrices(rows):
    a = np.array(rows, float)
    values, vectors = whitening.principal(np.linalg.qr(a, mode="r"), 5)
    want = np.zeros(5)
    want[: min(a.shape)] = np.linalg.svd(a, compute_uv=False) ** 2
    assert np.abs(values - want).max() < 1e-11 and np.abs(vectors.T @ vectors - np.eye(5)).max() < 1e-11
    assert np.abs(a.T @ (a @ vectors) - vectors * values).max() < 1e-10


def _whitened(vectors: np.ndarray, k: int):
    x = np.floor(64 * vectors).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    y = (n * x - s) / n
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1], u[:, ::-1][:, :k]
    return y @ u / np.sqrt(e[:k]), e[:k] / e.sum(), ((n * x - s) ** 2).sum(axis=1)


def test_whitening_equals_numpy(spark):
    embeddings = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = whitening.whiten(embeddings.repartition(7)).toPandas().sort_values(["vec_id", "component"])
    rows = embeddings.orderBy("vec_id").toPandas()
    w, explained, deviation = _whitened(np.stack(rows["embedding"].to_numpy()).astype(float), 32)
    ours = got["whitened"].to_numpy().reshape(-1, 32)
    assert np.abs(ours * np.sign((ours * w).sum(axis=0)) - w).max() < 1e-8
    assert got["explained"].to_numpy()[:32] == pytest.approx(explained, rel=1e-9)
    assert (got["deviation"].to_numpy().reshape(-1, 32) == deviation[:, None]).all()
    assert set(got["n"]) == {len(rows)} and got["identity_error"].max() < 1e-10 and got["identity_error"].nunique() == 1
    assert (got["component"].to_numpy().reshape(-1, 32) == np.arange(1, 33)).all()


def test_whitening_of_awkward_vectors(spark):
    rng = np.random.default_rng(5)
    three = [rng.standard_normal(3).tolist() for _ in range(40)]
    two = [[float(k), 2.0] for k in range(10)]
    rows = [(k, v, 1, "x") for k, v in enumerate(three)] + [(100 + k, v, 1, "x") for k, v in enumerate(two)]
    rows += [(None, [0.0, 0.0, 0.0], 1, "x"), (7, three[7], 2, "again"), (200, None, 1, "x"), (201, [], 1, "x"), (202, [1.0, None, 2.0], 1, "x"),
             (203, [1.0, float("nan"), 2.0], 1, "x"), (204, [1.0, float("inf"), 2.0], 1, "x")]
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS).repartition(5)).toPandas()
    assert len(got) == 42 * 3 + 10 * 2
    w, _, deviation = _whitened(np.array([*three, [0.0, 0.0, 0.0], three[7]]), 3)
    null = got[got["vec_id"].isna()].sort_values("component")
    assert np.abs(null["whitened"].to_numpy()) == pytest.approx(np.abs(w[40]), rel=1e-9) and set(null["deviation"]) == {deviation[40]}
    assert set(got[got["vec_id"].isin(range(40)) | got["vec_id"].isna()]["n"]) == {42}
    flat = got[(got["vec_id"] >= 100) & (got["component"] == 2)]  # the second of the two lengths does not vary
    assert flat["whitened"].isna().all() and set(flat["explained"]) == {0.0} and set(flat["n"]) == {10}
    assert got["identity_error"].max() < 1e-10
    none = whitening.whiten(spark.createDataFrame([(1, None, 1, "x")], VECTORS))
    assert none.count() == 0 and none.columns[0] == "vec_id"
    single = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 1, "x")], VECTORS)).toPandas()
    assert len(single) == 2 and single["whitened"].isna().all() and single["explained"].isna().all() and set(single["deviation"]) == {0}
    huge = whitening.whiten(spark.createDataFrame([(k, [1e300 * k, 1.0 * k], 1, "x") for k in range(4)], VECTORS)).toPandas()
    assert len(huge) == 8 and huge["deviation"].isna().any()


# ---- Merkle manifest ------------------------------------------------------------------------------------------------

def _h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _levels(nodes):
    rows = [nodes]
    while len(rows[-1]) > 1:
        rows.append([_h("".join(rows[-1][a : a + 8])) for a in range(0, len(rows[-1]), 8)])
    return rows


def _path(rows, at):
    path = []
    for level in rows[:-1]:
        run = level[at - at % 8 : at - at % 8 + 8]
        path.append((at % 8, run[: at % 8] + run[at % 8 + 1 :]))
        at //= 8
    return path


def _lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def _manifest(rows):
    """Brute force over (doc_id, source, lang, n_chars, text) tuples: result rows as the query returns them."""
    def leaf(r, text):
        return _h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*r[:4], text)))

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r, r[4]), r))
    keys = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    trees = {k: _levels([x[2] for x in sorted(groups[k], key=lambda x: x[:3])]) for k in keys}
    top = _levels([trees[k][-1][0] for k in keys])
    out = []
    for number, k in enumerate(keys):
        for at, (_, _, digest, r) in enumerate(sorted(groups[k], key=lambda x: x[:3])):
            path = _path(trees[k], at) + _path(top, number)
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None
            now = leaf(r, _lower(r[4])) if tampered else digest
            for place, others in path:
                now = _h("".join([*others[:place], now, *others[place:]]))
            proof = _h("".join("".join(others) for _, others in path))
            out.append((r[0], digest, trees[k][-1][0], top[-1][0], proof, now, now == top[-1][0]))
    return sorted(out, key=str)


def _verified(documents):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lowered = F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    digest = merkle.row_digest(*[lowered if f == "text" else F.col(f) for f in merkle.FIELDS])
    return merkle.verify(merkle.build(documents, changed=F.when(tampered, digest)))


def test_manifest_equals_brute_force_and_sql(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    want = _manifest([tuple(r) for r in documents.select(*merkle.FIELDS).collect()])
    ours = sorted((tuple(r) for r in driver.queries()["op12_merkle_manifest"](spark, SF).collect()), key=str)
    assert ours == want and any(not r[-1] for r in want) and any(r[-1] for r in want)
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert sorted(connection.sql(driver.oracle_sql()["op12_merkle_manifest"]).fetchall(), key=str) == want


def test_manifest_of_awkward_rows(spark, edges, empty):
    for documents in (edges, edges.where("doc_id = 5"), edges.where("doc_id IS NULL")):
        assert sorted((tuple(r) for r in _verified(documents).collect()), key=str) == _manifest([tuple(r) for r in documents.select(*merkle.FIELDS).collect()])
    nothing = merkle.build(empty)
    assert nothing.root is None and merkle.verify(nothing).count() == 0 and merkle.proofs(nothing).count() == 0


@pytest.mark.parametrize("count", [512, 513, 1400])
def test_trees_across_written_levels(spark, count):
    """Heights 3 and 4 with a hot language, many equal rows, and groups of one row."""
    rows = [(k // 3, "s", "en" if k % 10 else "l" + str(k), k % 4, f"Text {k // 2}") for k in range(count)] + [(1, "s", "de", 1, "Same")] * 70
    documents = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(6)
    manifest = merkle.build(documents)
    written = {r[0] for r in manifest.nodes().select("height").distinct().collect()}
    assert written <= {0, 3, 6}  # nothing between the checkpoints is stored
    assert sorted((tuple(r) for r in _verified(documents).collect()), key=str) == _manifest(rows)
    paths = merkle.proofs(manifest).collect()
    assert len(paths) == len(rows)
    assert {merkle.fold(r["leaf"], [s.asDict() for s in r["path"]]) for r in paths} == {manifest.root}


def test_columns_beyond_the_fields_do_not_matter(spark, edges):
    plain = merkle.build(edges.select(*merkle.FIELDS))
    assert merkle.build(edges.withColumn("digest", F.lit("x")).withColumn("left", F.lit(1)).withColumn("pos", F.lit(2))).root == plain.root


# ---- best-fit packing -----------------------------------------------------------------------------------------------

def _best_fit(lengths, capacity):
    rooms, used = [], 0
    for length in sorted(lengths, reverse=True):
        at = bisect.bisect_left(rooms, length)
        if at < len(rooms):
            room = rooms.pop(at)
        else:
            room, used = capacity, used + 1
        if room > length:
            bisect.insort(rooms, room - length)
    return used


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 60).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=200))))
def test_plan_is_best_fit_decreasing(case):
    capacity, lengths = case
    histogram = {k: lengths.count(k) for k in set(lengths)}
    taken, content = set(), {}
    for length, rank, count, each, first, offset in bestfit.plan(histogram, capacity):
        for k in range(count * each):
            taken.add((length, rank + k))
            content.setdefault(first + k // each, []).append((offset + k % each * length, length))
    assert taken == {(k, r) for k, n in histogram.items() for r in range(n)}
    for row in content.values():
        at = 0
        for offset, length in sorted(row):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(content) == list(range(_best_fit(lengths, capacity)))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40), st.lists(st.sampled_from(["a", "S", "'re", "é", "é", "İ", "Σ", "1", "²", "\x85", " ", " ", "\t", "日", "힣", "<|endoftext|>", "!"]), max_size=20).map("".join)), max_size=20))
def test_word_encoder_equals_the_library(texts):
    encoder = bestfit.encoder(VOCABULARY)
    texts = [t if t is None else t.encode("utf-8", "ignore").decode() for t in texts]
    ids, sizes = encoder.encode(pa.array(texts, pa.string()))
    want = [e.ids for e in encoder.library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_word_encoder_starts_anew_when_full():
    small, texts = bestfit.WordEncoder(VOCABULARY, cache=8), [f"word{k} of{k % 5} the" for k in range(50)]
    for _ in range(2):
        ids, sizes = small.encode(pa.array(texts))
        assert ids.tolist() == [i for e in small.library.encode_batch(texts, add_special_tokens=False) for i in e.ids]


def _packed(documents, capacity):
    rows = bestfit.pack(documents, VOCABULARY, capacity, with_ids=True).collect()
    library = bestfit.encoder(VOCABULARY).library
    want = sorted((d["doc_id"] is not None, d["doc_id"] or 0, tuple([*library.encode(d["text"] or "", add_special_tokens=False).ids, 1])) for d in documents.collect())
    by_sequence, by_document = {}, {}
    for r in rows:
        assert r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_document.setdefault(r["doc_id"], []).append(r)
    for content in by_sequence.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    lengths = [n for _, _, ids in want for n in [capacity] * (len(ids) // capacity) + [len(ids) % capacity] if n]
    assert len(rows) == len(lengths) and len(by_sequence) == _best_fit(lengths, capacity)
    for _, doc_id, ids in want:
        mine = by_document.get(doc_id) or by_document[None]
        if len({len(x[2]) for x in want if x[1] == doc_id}) == 1 and sum(x[1] == doc_id for x in want) == 1:
            mine = sorted(mine, key=lambda r: r["piece"])
            assert [i for r in mine for i in r["ids"]] == list(ids)
            assert [r["start"] for r in mine] == [k * capacity for k in range(len(mine))]
            assert [r["piece"] for r in mine] == list(range(len(mine)))
    return rows


def test_packing_equals_brute_force(spark, edges, empty):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    _packed(documents.select("doc_id", "text"), 4096)
    _packed(documents.select("doc_id", "text").repartition(5), 300)
    _packed(edges, 64)
    assert bestfit.pack(empty, VOCABULARY).count() == 0
    a, b = ([tuple(r) for r in bestfit.pack(documents, VOCABULARY).orderBy("doc_id", "piece").collect()] for _ in range(2))
    assert a == b
    sequences = bestfit.sequences(bestfit.pack(documents, VOCABULARY, with_ids=True))
    assert sequences.agg(F.sum(F.size("ids"))).first()[0] == sum(r[3] for r in a) and sequences.agg(F.max(F.size("ids"))).first()[0] <= 4096


def test_one_length_and_one_document_for_all(spark):
    """Equal rows, also without an id, take slots of their own; a run of slots is longer than a block."""
    rows = spark.range(40_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same text").alias("text"))
    got = bestfit.pack(rows, VOCABULARY, 10)
    assert got.select("sequence_id", "offset").distinct().count() == 40_000
    assert got.agg(F.max("sequence_id")).first()[0] + 1 == -(-40_000 // 3)
