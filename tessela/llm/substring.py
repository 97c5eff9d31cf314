"""Removal of repeated passages with prefix-partitioned, sparse suffix trees.

A window is ``window`` words. Every window holds GRAM-word runs, and the run of the smallest hash is its anchor, so two
equal windows have the same anchor at the same place. Only suffixes at anchors are kept (about one word in five), each
with the words to its left: a sparse suffix tree loses no repeat of a whole window.

1. Equal word sequences are one class; only the smallest id of a class goes on, all else in it is a copy.
2. Anchors that occur in one class only are no repeats. The number of occurrences of the others is known from here on.
3. The anchor is the prefix that deals suffixes to groups of bounded size. A group's subtree is built level by level: a
   level names the paths of one more word, to the right and to the left. A path of ``window`` words that several suffixes
   share is a deep inner node, and all but the smallest document of the node repeat it. A prefix with more than
   GROUP_ROWS suffixes is lengthened to whole windows, whose smallest document is a combined aggregate.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessela.llm.common import _SPACE, arrow_map, gram_hashes, mix, span_hashes, spread, stage, table, text_bytes, text_slices, word_spans
from tessela.llm.registry import query

WINDOW, GRAM = 13, 5
GROUP_ROWS = 100_000
CHUNK_ROWS = 100_000
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


class Texts:
    """The words of a slice of texts: byte spans, hashes, and each text's first word and number of words."""

    def __init__(self, texts: pa.Array):
        self.data, self.offsets = text_bytes(texts)
        self.starts, self.ends, self.count = word_spans(self.data, self.offsets)
        self.words = span_hashes(self.data, self.starts, self.ends)
        self.first = np.cumsum(self.count) - self.count

    def names(self) -> tuple[np.ndarray, np.ndarray]:
        """A 128-bit name of the word sequence of each text."""
        place = np.arange(len(self.words), dtype=np.uint64) - np.repeat(self.first, self.count).astype(np.uint64)
        out = []
        for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            h = mix(self.words ^ mix(place * np.uint64(2) + np.uint64(salt)))
            total = np.zeros(len(self.words) + 1, np.uint64)
            np.cumsum(h, out=total[1:])
            out.append(mix(total[self.first + self.count] - total[self.first] + self.count.astype(np.uint64)).view(np.int64))
        return out[0], out[1]

    def window_anchors(self, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, anchor's word, anchor's hash) of every window that lies inside one text, ascending."""
        grams = gram_hashes(self.words, GRAM)
        n = len(self.words) - window + 1
        if n <= 0:
            none = np.empty(0, np.int64)
            return none, none, np.empty(0, np.uint64)
        best, at = grams[:n].copy(), np.zeros(n, np.int64)
        for j in range(1, window - GRAM + 1):
            smaller = grams[j : j + n] < best
            np.copyto(best, grams[j : j + n], where=smaller)
            at[smaller] = j
        whole = np.zeros(len(self.words) + 1, np.int32)
        long = self.count >= window
        np.add.at(whole, self.first[long], 1)
        np.add.at(whole, (self.first + self.count - window + 1)[long], -1)
        inside = np.flatnonzero(np.cumsum(whole)[:n] > 0)
        return inside, inside + at[inside], best[inside]

    def anchors(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """(word index, hash) of the anchors of all windows, each place once, ascending."""
        _, places, hashes = self.window_anchors(window)
        fresh = np.ones(len(places), bool)
        fresh[1:] = places[1:] != places[:-1]
        return places[fresh], hashes[fresh]

    def normal(self, drop: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all texts with the words joined by one space, and each text's offsets; ``drop`` leaves words out."""
        word = ~_SPACE[self.data]
        if drop is not None and drop.any():
            edge = np.zeros(len(self.data) + 1, np.int32)
            np.add.at(edge, self.starts[drop], 1)
            np.add.at(edge, self.ends[drop], -1)
            word &= np.cumsum(edge)[:-1] == 0
        space = np.zeros(len(word), bool)
        space[1:] = word[:-1] & ~word[1:]
        begin = self.offsets[:-1]
        space[begin[begin < len(word)]] = False
        keep = word | space
        out = np.where(space, np.uint8(32), self.data)[keep]
        sizes = np.concatenate([[0], np.cumsum(keep)])
        return out, sizes[self.offsets]


def _sha(data: np.ndarray, a: int, b: int) -> str:
    return hashlib.sha256(data[a:b].tobytes().rstrip(b" ")).hexdigest()


def describe(documents: DataFrame, window: int) -> DataFrame:
    """(doc_id, n_words, lo, hi, sha, anchors, times) of every row: size, name of the word sequence, digest, anchor hashes.

    A text that repeats an anchor holds it once, with the number of times.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text", 1 << 20):
                t = Texts(part.column("text"))
                lo, hi = t.names()
                places, hashes = t.anchors(window)
                data, at = t.normal()
                owner = np.searchsorted(t.first + t.count, places, side="right")
                order = np.lexsort((hashes, owner))
                owner, hashes = owner[order], hashes[order]
                fresh = np.ones(len(owner), bool)
                fresh[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
                some = np.flatnonzero(fresh)
                cut = pa.array(np.searchsorted(owner[some], np.arange(len(t.count) + 1)), pa.int32())
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "n_words": t.count.astype(np.int64), "lo": lo, "hi": hi,
                    "sha": [_sha(data, a, b) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)],
                    "anchors": pa.ListArray.from_arrays(cut, pa.array(hashes[some].view(np.int64))),
                    "times": pa.ListArray.from_arrays(cut, pa.array(np.diff(np.append(some, len(owner))), pa.int32())),
                })

    return arrow_map(documents, run, "doc_id long, n_words long, lo long, hi long, sha string, anchors array<long>, times array<int>")


def repeated_anchors(described: DataFrame) -> DataFrame:
    """Step 2: (doc_id, lo, shared, hot): of each class's smallest document, the anchors other classes have too."""
    reps = described.where(F.col("doc_id").isNotNull() & (F.size("anchors") > 0)).groupBy("lo", "hi", "n_words").agg(
        F.min("doc_id").alias("doc_id"), F.first(F.arrays_zip("anchors", "times")).alias("anchors"))
    rows = spread(reps.select("doc_id", "lo", F.explode("anchors").alias("a")).select("doc_id", "lo", "a.*").withColumnRenamed("anchors", "h"), "h")
    counts = rows.groupBy("h").agg(F.min("lo").alias("x"), F.max("lo").alias("y"), F.sum("times").alias("n")).where("x < y")
    shared = rows.join(counts.select("h", "n"), "h")
    return shared.groupBy("doc_id", "lo").agg(
        F.collect_list(F.when(F.col("n") <= GROUP_ROWS, F.col("h"))).alias("shared"), F.collect_list(F.when(F.col("n") > GROUP_ROWS, F.col("h"))).alias("hot"))


def _named(batch: pa.RecordBatch, column: str, t: Texts, places: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text of each place, whether its text's list ``column`` names the hash)."""
    owner = np.searchsorted(t.first + t.count, places, side="right")
    lists = batch.column(column)
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    wanted = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    row = np.repeat(np.arange(len(lists)), sizes).astype(np.uint64)
    salt = lambda r, h: mix(h + mix(r.astype(np.uint64) + np.uint64(11)))
    return owner, np.isin(salt(owner, hashes), salt(row, wanted)) & (t.names()[0] == batch.column("lo").to_numpy())[owner]


def suffixes(texts: DataFrame, window: int) -> DataFrame:
    """Step 3, rows (h, doc_id, lo, place, left, words): an anchor and up to ``window - GRAM`` words on both sides."""
    side = window - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text", 1 << 20):
                t = Texts(part.column("text"))
                place, h = t.anchors(window)
                row, named = _named(part, "shared", t, place, h)
                row, place, h = row[named], place[named], h[named]
                if not len(row):
                    continue
                data, at = t.normal()
                # byte offsets of the words in the normal form: one space after each but the last of a text
                size = t.ends - t.starts + 1
                begin = np.cumsum(size) - size
                owner = np.repeat(np.arange(len(t.count)), t.count)
                begin += (at[:-1] - begin[np.minimum(t.first, len(begin) - 1)])[owner]
                end = begin + size - 1
                low = np.maximum(place - side, t.first[row])
                high = np.minimum(place + GRAM + side, (t.first + t.count)[row]) - 1
                blob = data.tobytes()
                yield pa.RecordBatch.from_pydict({
                    "h": h.view(np.int64), "doc_id": part.column("doc_id").to_numpy()[row], "lo": part.column("lo").to_numpy()[row],
                    "place": (place - t.first[row]).astype(np.int32), "left": (place - low).astype(np.int32),
                    "words": pa.array([blob[a:b] for a, b in zip(begin[low].tolist(), end[high].tolist(), strict=True)], pa.binary()),
                })

    return arrow_map(texts, run, "h long, doc_id long, lo long, place int, left int, words binary")


def _renamed(names: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Names of the paths one word longer: equal exactly where the path and its new word are equal."""
    return np.unique(names * (int(more.max()) + 1) + more, return_inverse=True)[1]


def subtree_marks(h: np.ndarray, doc: np.ndarray, left: np.ndarray, words: pa.Array, window: int) -> np.ndarray:
    """A bit o per suffix: the window that begins o words left of the anchor also begins in a smaller document.

    Whole groups of equal ``h``; the groups are subtrees side by side.
    """
    side, width = window - GRAM, 2 * (window - GRAM) + GRAM
    data, offsets = text_bytes(words.cast(pa.string()))
    starts, ends, count = word_spans(data, offsets)
    codes = np.unique(span_hashes(data, starts, ends), return_inverse=True)[1] + 1  # 0: no word there
    grid = np.zeros((len(h), width), np.int64)
    row = np.repeat(np.arange(len(h)), count)
    column = np.arange(len(codes)) - np.repeat(np.cumsum(count) - count, count) + (side - left)[row]
    grid[row, column] = codes
    root = np.unique(h, return_inverse=True)[1]
    for k in range(GRAM):
        root = _renamed(root, grid[:, side + k])
    right = [root]
    for k in range(side):
        right.append(_renamed(right[-1], grid[:, side + GRAM + k]))
    marks, path = np.zeros(len(h), np.int64), root
    for o in range(side + 1):
        if o:
            path = _renamed(path, grid[:, side - o])
        whole = np.flatnonzero((left >= o) & (grid[:, side + GRAM + side - o - 1] > 0 if o < side else True))
        if not len(whole):
            continue
        node = np.unique(path[whole] * (int(right[side - o].max()) + 1) + right[side - o][whole], return_inverse=True)[1]
        smallest = np.full(int(node.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(smallest, node, doc[whole])
        marks[whole] |= (doc[whole] > smallest[node]).astype(np.int64) << o
    return marks


def group_marks(rows: DataFrame, window: int) -> DataFrame:
    """(doc_id, lo, place, marks) of all suffixes with a mark; rows come in whole groups of equal prefix."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < CHUNK_ROWS:
                continue
            all_ = pa.Table.from_batches(held)
            keys = all_.column("h").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                yield all_.slice(0, cut)
            held = all_.slice(cut).to_batches()
            size = all_.num_rows - cut
        if size:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            h, doc, lo, place, left = (part.column(c).to_numpy() for c in ("h", "doc_id", "lo", "place", "left"))
            marks = subtree_marks(h, doc, left, part.column("words").combine_chunks(), window)
            some = np.flatnonzero(marks)
            yield pa.RecordBatch.from_pydict({"doc_id": doc[some], "lo": lo[some], "place": place[some], "marks": marks[some]})

    dealt = spread(rows, "h").sortWithinPartitions("h")
    return arrow_map(dealt, run, "doc_id long, lo long, place int, marks long")


def window_marks(texts: DataFrame, window: int) -> DataFrame:
    """The same marks for anchors with very many suffixes: prefixes as long as the window, by combined minima."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text", 1 << 20):
                t = Texts(part.column("text"))
                begin, place, h = t.window_anchors(window)
                row, named = _named(part, "hot", t, place, h)
                row, begin = row[named], begin[named]
                one, two = gram_hashes(t.words, window), gram_hashes(t.words, window, salt=1)
                yield pa.RecordBatch.from_pydict({
                    "x": one[begin].view(np.int64), "y": two[begin].view(np.int64), "doc_id": part.column("doc_id").to_numpy()[row],
                    "lo": part.column("lo").to_numpy()[row], "place": (begin - t.first[row]).astype(np.int32), "marks": np.ones(len(row), np.int64),
                })

    rows = stage(arrow_map(texts, run, "x long, y long, doc_id long, lo long, place int, marks long"), "repeat-windows")
    least = rows.groupBy("x", "y").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    return rows.join(least, ["x", "y"]).where("doc_id > least").select("doc_id", "lo", "place", "marks")


def _with_texts(documents: DataFrame, keyed: DataFrame) -> DataFrame:
    return documents.select("doc_id", "text").join(keyed, "doc_id")


def find_repeats(documents: DataFrame, described: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, lo, windows): for each class's smallest document, the first words of windows that a smaller id also has."""
    anchors = stage(repeated_anchors(described), "repeat-anchors")
    texts = _with_texts(documents, anchors)
    marks = stage(group_marks(suffixes(texts, window), window), "repeat-marks")
    hot = anchors.where(F.size("hot") > 0)
    if not hot.isEmpty():
        marks = marks.unionByName(stage(window_marks(_with_texts(documents, hot), window), "repeat-marks-hot"))
    bits = F.filter(F.sequence(F.lit(0), F.lit(window - GRAM)), lambda o: F.call_function("getbit", F.col("marks"), o) == 1)
    begins = F.transform(bits, lambda o: F.col("place") - o)
    return marks.select("doc_id", "lo", begins.alias("w")).groupBy("doc_id", "lo").agg(F.flatten(F.collect_list("w")).alias("windows"))


def stripped(documents: DataFrame, repeats: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, lo, n_removed, kept) of the documents of ``repeats``: what is left, words joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text", 1 << 20):
                t = Texts(part.column("text"))
                mine = t.names()[0] == part.column("lo").to_numpy()
                lists = part.column("windows")
                sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(len(lists)), sizes)
                begin = lists.flatten().to_numpy(zero_copy_only=False) + t.first[row]
                begin = begin[mine[row]]
                edge = np.zeros(len(t.words) + 1, np.int64)
                np.add.at(edge, begin, 1)
                np.add.at(edge, begin + window, -1)
                drop = np.cumsum(edge)[:-1] > 0
                data, at = t.normal(drop)
                total = np.concatenate([[0], np.cumsum(drop)])
                removed = total[t.first + t.count] - total[t.first]
                blob = data.tobytes()
                kept = [blob[a:b].rstrip(b" ") for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "lo": part.column("lo"), "n_removed": removed, "kept": pa.array(kept, pa.binary()).cast(pa.string()),
                }).filter(pa.array(mine))

    return arrow_map(_with_texts(documents, repeats), run, "doc_id long, lo long, n_removed long, kept string")


def remove_repeats(documents: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept, sha): every row's words without those in a window that a smaller id also has.

    ``kept`` is the remaining text where words were removed and null where none were; ``sha`` is its digest in any case.
    Null and empty texts have no words. Rows without an id lose nothing and are no source. Repeated rows get equal
    results; rows of equal id and different texts are judged one by one and never against each other.
    """
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    described = stage(describe(rows, window), "repeat-texts")
    repeats = find_repeats(rows, described, window)
    partial = stripped(rows, repeats, window).groupBy("doc_id", "lo").agg(F.first("n_removed").alias("n_removed"), F.first("kept").alias("kept"))
    classes = described.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= window)).groupBy("lo", "hi").agg(F.min("doc_id").alias("rep"))
    joined = described.drop("anchors", "times").join(classes, ["lo", "hi"], "left").join(partial, ["doc_id", "lo"], "left")
    copy = F.coalesce(F.col("rep") < F.col("doc_id"), F.lit(False))
    kept = F.when(copy, F.lit("")).otherwise(F.col("kept"))
    return joined.select(
        "doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        kept.alias("kept"), F.when(kept.isNull(), F.col("sha")).otherwise(F.sha2(kept, 256)).alias("sha"))


_OP9 = r"""
WITH w AS MATERIALIZED (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
v AS MATERIALIZED (SELECT doc_id, i, array_to_string(ws[i:i+12], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
m AS MATERIALIZED (SELECT win, min(doc_id) AS least FROM v GROUP BY 1),
c AS MATERIALIZED (SELECT DISTINCT doc_id, i + k AS p FROM (SELECT doc_id, i FROM v JOIN m USING (win) WHERE doc_id > least), range(0, 13) AS t(k)),
x AS MATERIALIZED (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM w),
k AS (SELECT x.doc_id, string_agg(x.ws[x.p], ' ' ORDER BY x.p) FILTER (c.p IS NULL) AS kept, count(c.p) AS n_removed FROM x LEFT JOIN c ON c.doc_id = x.doc_id AND c.p = x.p GROUP BY 1)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)"""


@query("op9_substring_dedup", _OP9)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.col("sha").alias("kept_sha256"))
