"""Personal data, archives, language, substring dedup and Jaccard join against plain Python and SQL."""

from __future__ import annotations

import hashlib
import itertools
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessela.llm import common, langid, pii, sigtree, substring, warc

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- words ----------------------------------------------------------------------------------------------------------

@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=" \t\n\x0b\x0cabé日 '", max_size=30)), max_size=8))
def test_word_spans_and_hashes_are_those_of_the_pattern(texts):
    data, offsets = common.text_bytes(pa.array(texts, pa.string()))
    starts, ends, per = common.word_spans(data, offsets)
    want = [WORD.findall(t or "") for t in texts]
    assert per.tolist() == [len(w) for w in want]
    words = [bytes(data[a:b]).decode() for a, b in zip(starts, ends, strict=True)]
    assert words == [w for ws in want for w in ws]
    hashes = common.span_hashes(data, starts, ends, block=7)
    seen = {}
    for w, h in zip(words, hashes.tolist(), strict=True):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_components_of_a_chain_a_hub_and_loops(spark):
    pairs = [(i, i + 1) for i in range(0, 60)] + [(1000, i) for i in range(1001, 1400)] + [(5000, 5000), (7, 3)]
    got = {r["id"]: r["component"] for r in common.components(spark.createDataFrame(pairs, "a long, b long").repartition(5)).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 1000 for i in range(1000, 1400)}}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- personal data --------------------------------------------------------------------------------------------------

# The base patterns of the contract
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _base_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or "", re.ASCII):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 14 <= len(digits) <= 19 and sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0,
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((m.start(), rank, kind, m.end()))
    return [(k, s, e) for s, _, k, e in sorted(out)]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a@.-+0123456789 ()%é\n", max_size=60))
def test_base_spans_equal_the_plain_patterns(text):
    assert [s[:3] for s in pii.spans_of(text) if s[0] in pii.BASE_KINDS] == _base_spans(text)


def test_base_spans_over_a_table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    found = pii.find(rows).collect()
    assert len(found) == rows.count()
    for r in found:
        got = [(s["kind"], s["start"], s["end"]) for s in r["pii_spans"]]
        assert [s for s in got if s[0] in pii.BASE_KINDS] == _base_spans(r["text"])


def test_checksums_context_and_redaction():
    text = "IBAN DE89 3704 0044 0532 0130 00 and DE89370400440532013001; my ssn is 123-45-6789 but order 123-45-6780 x"
    kinds = [(k, text[s:e]) for k, s, e, _ in pii.spans_of(text)]
    assert ("iban", "DE89 3704 0044 0532 0130 00") in kinds and ("ssn", "123-45-6789") in kinds
    assert not any("013001" in t for k, t in kinds if k == "iban")
    assert pii.redacted("write a@b.co now", pii.spans_of("write a@b.co now")) == "write <EMAIL> now"
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765433")
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_uniform_long_texts_are_quick():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "1." * 150_000, "a@" * 150_000, "+1" * 100_000, "A1 " * 100_000, "+1" + " " * 200_000):
        pii.spans_of(text)


def test_pii_edges(edges, empty):
    out = pii.find(edges, redact=True)
    assert out.columns == [*edges.columns, "pii_spans"] and out.count() == edges.count()
    row = out.where("doc_id = 15").first()
    assert row["text"] == "mail <EMAIL> or <PHONE>, <CARD>, <IP>"
    assert out.where("text IS NULL").first()["pii_spans"] == []
    assert pii.find(empty).count() == 0


# ---- archives -------------------------------------------------------------------------------------------------------

def test_archives_round_trip(spark, tmp_path):
    big = "x" * 100
    rows = [(1, "u", None), (2, "u", ""), (3, None, big), (4, "u\r\nX: y", big), (5, "u", big[:99]), (6, "u", big[:99]), (7, "u", "é" * 50), (8, "u", "é" * 50),
            (9, "u", "a\r\n\r\nWARC/1.1\r\nb" * 20), (9, "u", "a\r\n\r\nWARC/1.1\r\nb" * 20), (None, "u", big), (10, "u", "y" * 3_000_000)]
    index = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), f"file://{tmp_path}/w")
    got = warc.read_records(index).toPandas()
    assert len(got) == len(rows)
    by = got.dropna(subset=["page_id"]).set_index("page_id")
    assert by.loc[4, "refers_to"] == 3 and by.loc[4, "record_type"] == "revisit" and by.loc[8, "refers_to"] == 7
    assert (by.drop(index=[4, 8])["record_type"] == "response").all()
    for page, _, html in rows:
        if page in (1, 2, 3, 5, 6, 7, 10):
            payload = (html or "").encode()
            assert by.loc[page, "payload"] == payload and by.loc[page, "payload_digest"] == hashlib.sha256(payload).hexdigest()
            assert by.loc[page, "payload_bytes"] == len(payload)
    files = sorted(Path(f"{tmp_path}/w/members").glob("*.warc.gz"))
    assert files and all(Path(f"{f}.idx").exists() for f in files) and not Path(f"{tmp_path}/w/raw").exists()


def test_a_cut_archive_is_an_error():
    with pytest.raises((ValueError, StopIteration, RuntimeError)):
        list(warc.records_of(iter([b"WARC/1.1\r\nContent-Length: 50\r\n\r\nabc"])))


def test_no_pages_no_records(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_records(warc.archive(none, f"file://{tmp_path}/e")).count() == 0


# ---- language -------------------------------------------------------------------------------------------------------

def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(5)
    for _ in range(60):
        per = rng.integers(0, 6, size=4)
        scores = rng.normal(size=(int(per.sum()), 3)).astype(np.float32)
        labels = langid.viterbi(scores, per, 0.8)
        at = 0
        for n in per.tolist():
            part = scores[at : at + n].astype(float)
            value = lambda path: sum(part[i, k] for i, k in enumerate(path)) - 0.8 * sum(a != b for a, b in itertools.pairwise(path))  # noqa: B023, E731
            if n:
                assert value(labels[at : at + n].tolist()) == pytest.approx(max(map(value, itertools.product(range(3), repeat=n))))
            at += n


def test_held_out_accuracy_and_mixed_spans(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(documents.where(~langid.held_out()))
    assert model.languages == ["de", "en", "es", "fr"]
    found = langid.identify(documents.where(langid.held_out() & (F.length("text") > 100)), model)
    assert found.where("lang = lang_pred").count() / found.count() > 0.97
    parts = [documents.where(f"lang = '{x}' AND n_chars > 800").first()["text"][:600] for x in ("en", "de")]
    mixed = spark.createDataFrame([(1, "\n".join(parts))], "id int, text string")
    spans = langid.identify(mixed, model, spans=True).first()["lang_spans"]
    assert [s["lang"] for s in spans] == ["en", "de"] and abs(spans[1]["start"] - 601) < 40


def test_a_rare_language_is_learned(spark):
    """20 rows among 20,000; nulls as ids do not decide who is drawn, and the sample of the large one is bounded."""
    rows = [(k if k % 2 else None, f"aba abba baba {k}", "big") for k in range(20_000)] + [(30_000 + k, f"coco occo {k}", "rare") for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df, max_rows=200)
    assert model.languages == ["big", "rare"]
    found = {r["text"]: r["lang_pred"] for r in langid.identify(spark.createDataFrame([(1, "occo coco"), (2, "abba aba")], "doc_id long, text string"), model).collect()}
    assert found == {"occo coco": "rare", "abba aba": "big"}



def test_language_edges(edges, empty):
    model = langid.train(edges)
    out = langid.identify(edges, model, spans=True)
    assert out.columns == [*edges.columns, "lang_pred", "score", "lang_spans"] and out.count() == edges.count()
    rows = {r["doc_id"]: r for r in out.collect()}
    for k in (1, 2, 3, 16):
        assert rows[k]["lang_pred"] == "und" and rows[k]["score"] == 0 and rows[k]["lang_spans"] == []
    assert rows[14]["lang_pred"] in ("en", "de") and 0 < rows[14]["score"] <= 1
    assert langid.train(empty).languages == []
    assert langid.identify(edges, langid.train(empty)).where("lang_pred <> 'und'").count() == 0


def test_script_narrows_the_candidates(spark):
    rows = [(1, "привет мир как дела", "ru"), (2, "hello world how are you", "en")]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = langid.identify(spark.createDataFrame([("щщ ъъ",), ("zzz qq",)], "text string"), model).collect()
    assert {r["text"]: r["lang_pred"] for r in got} == {"щщ ъъ": "ru", "zzz qq": "en"}


# ---- substring dedup ------------------------------------------------------------------------------------------------

def _strip(rows, window):
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[k : k + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = {k + j for k in range(len(w) - window + 1) if i is not None and first[tuple(w[k : k + window])] < i for j in range(window)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("group_rows", [100_000, 0])
def test_repeats_are_those_of_brute_force(edges, monkeypatch, group_rows):
    monkeypatch.setattr(substring, "GROUP_ROWS", group_rows)
    got = substring.remove_repeats(edges).select("doc_id", "n_words", "n_removed", "sha").collect()
    assert sorted((tuple(r) for r in got), key=str) == _strip([(r["doc_id"], r["text"]) for r in edges.collect()], 13)


def test_repeats_with_another_window_and_no_rows(edges, empty):
    got = substring.remove_repeats(edges, window=8).select("doc_id", "n_words", "n_removed", "sha").collect()
    assert sorted((tuple(r) for r in got), key=str) == _strip([(r["doc_id"], r["text"]) for r in edges.collect()], 8)
    assert substring.remove_repeats(empty).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), min_size=0, max_size=30), min_size=1, max_size=6))
def test_equal_windows_have_equal_anchors(texts):
    t = substring.Texts(pa.array([" ".join(x) for x in texts], pa.string()))
    places, hashes = t.anchors(7)
    anchors = dict(zip(places.tolist(), hashes.tolist(), strict=True))
    of_window = {}
    for first, count in zip(t.first.tolist(), t.count.tolist(), strict=True):
        for s in range(first, first + count - 6):
            inside = {(p - s, h) for p, h in anchors.items() if s <= p <= s + 2}
            assert inside
            best = min(inside, key=lambda x: (x[1], x[0]))
            key = tuple(t.words[s : s + 7].tolist())
            assert of_window.setdefault(key, best) == best


# ---- Jaccard join ---------------------------------------------------------------------------------------------------

def _classes(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        if i is not None:
            sets.setdefault(i, set())
            sets[i] |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        same = len(sets[a] & sets[b])
        if same and 100 * same >= percent * (len(sets[a]) + len(sets[b]) - same):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("n", "percent", "blocks"), [(4, 85, None), (5, 80, 4)])
def test_classes_are_those_of_brute_force(edges, monkeypatch, n, percent, blocks):
    if blocks:  # many tiles in every bucket and family
        monkeypatch.setattr(sigtree, "BUCKET_BLOCK", blocks)
        monkeypatch.setattr(sigtree, "FAMILY_DOCS", blocks)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in sigtree.near_classes(edges, n, percent).where("doc_id IS NOT NULL").collect()}
    want = _classes([(r["doc_id"], r["text"]) for r in edges.collect()], n, percent)
    assert got == want
    assert len({c for _, c in want.values()}) < len(want) - 20


def test_all_links_and_no_rows(edges, empty):
    links, members = sigtree.jaccard_join(edges, 4, 85, forest=False)
    reps = {r["rep"] for r in members.where("rep IS NOT NULL").collect()}
    texts = {r["doc_id"]: sigtree.shingle_sets(pa.array([r["text"]]), 4)[0] for r in edges.collect() if r["doc_id"] in reps}
    want = set()
    for a, b in itertools.combinations(sorted(reps), 2):
        same = len(np.intersect1d(texts[a], texts[b]))
        if same and 100 * same >= 85 * (len(texts[a]) + len(texts[b]) - same):
            want.add((a, b))
    assert {tuple(sorted((r["a"], r["b"]))) for r in links.collect()} == want and len(want) > 100
    assert sigtree.near_classes(empty, 4, 85).count() == 0


def test_tree_walk_finds_every_pair():
    rng = np.random.default_rng(2)
    base = [rng.integers(0, 2**63, size=rng.integers(20, 60)).astype(np.uint64) for _ in range(12)]
    sets = [np.unique(np.where(rng.random(len(b)) < 0.06, rng.integers(0, 2**63, size=len(b)).astype(np.uint64), b)) for b in base for _ in range(25)]
    sizes, bits = np.array([len(s) for s in sets]), np.stack([sigtree.bitmap(s) for s in sets])
    passes = lambda i, j: 100 * (c := len(np.intersect1d(sets[i], sets[j]))) >= 85 * (len(sets[i]) + len(sets[j]) - c)
    want = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if passes(i, j)}
    got = {tuple(sorted(x)) for x in sigtree.tree_links(sizes, bits, 85, passes, forest=False)}
    assert got == want and want
    side = np.arange(len(sets)) % 2
    got = {tuple(sorted(x)) for x in sigtree.tree_links(sizes, bits, 85, passes, side=side, forest=False)}
    assert got == {(i, j) for i, j in want if side[i] != side[j]}
    forest = common.Disjoint(len(sets))
    for i, j in sigtree.tree_links(sizes, bits, 85, passes):
        assert forest.union(i, j)
    assert all(forest.find(i) == forest.find(j) for i, j in want)
