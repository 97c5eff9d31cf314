"""Language of texts and of spans in mixed texts: scripts narrow the candidates, Viterbi labels the words.

A word is a run of letters. Its score in each language is the summed log probability of its character trigrams, whose
counts are learned from labelled rows. Languages that never use the word's script are no candidates. A path over the
words of a whole text may switch language at a fixed penalty; the best path labels every word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessela.llm.common import arrow_map, table, text_slices
from tessela.llm.registry import query

# First code points of the ranges of scripts; 0 stands for all that is not listed
SCRIPTS = (
    (0x0000, "other"), (0x0041, "latin"), (0x0250, "other"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"),
    (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "other"),
    (0x0B80, "tamil"), (0x0C00, "other"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"),
    (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xFF21, "latin"), (0xFF5B, "other"),
)
SCRIPT_NAMES = tuple(sorted({name for _, name in SCRIPTS}))

BUCKETS = 1 << 16
UNKNOWN = "und"
TRAIN_ROWS = 12_000  # of each language
SWITCH = 12.0
EXCLUDED = -1000.0
SCRIPT_SHARE = 0.001
_UNICODE = 0x110000

_tables: dict[str, np.ndarray] = {}


def _unicode_tables() -> dict[str, np.ndarray]:
    """Per code point: is it a letter, its lower case, its script; made once in each worker."""
    if not _tables:
        _tables["letter"] = np.fromiter((chr(c).isalpha() for c in range(_UNICODE)), bool, _UNICODE)
        lower = np.arange(_UNICODE, dtype=np.uint32)
        for c in np.flatnonzero(np.fromiter((chr(c).isupper() or chr(c).istitle() for c in range(_UNICODE)), bool, _UNICODE)):
            low = chr(c).lower()
            if len(low) == 1:
                lower[c] = ord(low)
        _tables["lower"] = lower
        starts = [s for s, _ in SCRIPTS] + [_UNICODE]
        _tables["script"] = np.repeat(np.array([SCRIPT_NAMES.index(n) for _, n in SCRIPTS], np.int8), np.diff(starts))
    return _tables


@dataclass
class Words:
    """All words of some texts: where they stand, whose they are, and the trigram buckets of their letters."""

    start: np.ndarray  # code points in the text, per word
    end: np.ndarray
    per_text: np.ndarray  # number of words of each text
    letters: np.ndarray  # index of each word's first trigram
    grams: np.ndarray  # bucket of the trigram around each letter
    script: np.ndarray  # of each word's first letter


def words_of(texts: list[str | None]) -> Words:
    t = _unicode_tables()
    texts = [x or "" for x in texts]
    points = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in texts], out=at[1:])
    letter = t["letter"][points]
    low = np.where(letter, t["lower"][points], 0).astype(np.uint64)
    index = np.flatnonzero(letter)
    if not len(index):
        none = np.empty(0, np.int64)
        return Words(none, none, np.zeros(len(texts), np.int64), none, none, np.empty(0, np.int8))
    before = np.where(index > 0, low[index - 1], 0)
    h = before * np.uint64(0x9E3779B97F4A7C15) + low[index] * np.uint64(0xC2B2AE3D27D4EB4F) + low[index + 1] * np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(29)
    grams = ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(48)).astype(np.int64) % BUCKETS
    first = np.flatnonzero(np.diff(index, prepend=-2) != 1)
    starts = index[first]
    ends = index[np.append(first[1:], len(index)) - 1] + 1
    owner = np.searchsorted(at, starts, side="right") - 1
    return Words(starts - at[owner], ends - at[owner], np.bincount(owner, minlength=len(texts)), first, grams, t["script"][points[starts]])


@dataclass
class Model:
    """Log probabilities by trigram bucket and language, and which scripts each language uses. Size: BUCKETS x languages."""

    languages: list[str]
    weights: np.ndarray
    scripts: np.ndarray  # script x language: may the language use it

    def word_scores(self, words: Words) -> np.ndarray:
        if not len(words.letters):
            return np.empty((0, len(self.languages)), np.float32)
        scores = np.add.reduceat(self.weights[words.grams], words.letters, axis=0)
        scores[~self.scripts[words.script]] += EXCLUDED
        return scores


def train(rows: DataFrame, text: str = "text", lang: str = "lang", max_rows: int = TRAIN_ROWS, key: str = "doc_id", smooth: float = 0.5) -> Model:
    """Count the trigrams of each language over a sample of labelled rows.

    The sample holds ``max_rows`` rows of each language in expectation, whole texts, chosen by a hash of key and text; a
    language with fewer rows is used whole, so that a rare one is learned however large the others are. What reaches the
    driver is one count per language, then one per bucket and language, whatever the number of rows. Rows without a text
    or label are no examples. Without examples the model knows no language.
    """
    rows = rows.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    limits = [(r["lang"], (max_rows << 53) // r["n"]) for r in rows.groupBy(F.col(lang).alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect() if r["n"] > max_rows]
    chosen = rows
    if limits:
        limit = F.create_map(*[F.lit(x) for pair in limits for x in pair])[F.col(lang)]
        draw = F.shiftrightunsigned(F.xxhash64(F.lit("langid"), F.col(key), F.col(text)), 11)
        chosen = rows.where(limit.isNull() | (draw < limit))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in text_slices(batch, "text"):
                labels, texts = part.column("lang").to_pylist(), part.column("text").to_pylist()
                for label in set(labels):
                    words = words_of([t for t, x in zip(texts, labels, strict=True) if x == label])
                    total = counts.setdefault(label, np.zeros(BUCKETS + len(SCRIPT_NAMES), np.int64))
                    total[:BUCKETS] += np.bincount(words.grams, minlength=BUCKETS)
                    total[BUCKETS:] += np.bincount(words.script, weights=words.end - words.start, minlength=len(SCRIPT_NAMES)).astype(np.int64)
        for label, total in counts.items():
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"lang": [label] * len(some), "slot": some, "n": total[some]})

    counted = arrow_map(chosen.select(F.col(lang).alias("lang"), F.col(text).alias("text")), run, "lang string, slot long, n long")
    sums = counted.groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(sums["lang"].unique())
    table_ = np.zeros((BUCKETS + len(SCRIPT_NAMES), len(languages)))
    if len(languages):
        table_[sums["slot"], [languages.index(x) for x in sums["lang"]]] = sums["n"]
    grams, scripts = table_[:BUCKETS], table_[BUCKETS:]
    weights = np.log((grams + smooth) / (grams.sum(0) + smooth * BUCKETS))
    allowed = scripts > SCRIPT_SHARE * np.maximum(scripts.sum(0), 1)
    allowed |= ~allowed.any(axis=1, keepdims=True)
    return Model(languages, weights.astype(np.float32), allowed)


def viterbi(scores: np.ndarray, per_text: np.ndarray, penalty: float) -> np.ndarray:
    """The label of each word on the best path of its text; the texts walk in step, longest first.

    Ties stay in the language of the word before, else go to the first language.
    """
    n, k = scores.shape
    labels = np.zeros(n, np.int8 if k < 128 else np.int32)
    if not n or k < 2:
        return labels
    order = np.argsort(-per_text, kind="stable")
    lengths = per_text[order]
    base = (np.cumsum(per_text) - per_text)[order]
    steps = int(lengths[0])
    active = len(lengths) - np.searchsorted(lengths[::-1], np.arange(steps), side="right")
    came = np.empty((n, k), np.int8 if k < 128 else np.int32)
    state = scores[base[: active[0]]].astype(np.float64)
    own = np.arange(k)
    final = np.zeros(len(lengths), np.int64)
    for t in range(1, steps + 1):
        now = active[t] if t < steps else 0
        if now < len(state):
            final[now : len(state)] = state[now:].argmax(1)
            state = state[:now]
        if not now:
            break
        best = state.argmax(1)
        switched = state[np.arange(now), best] - penalty
        at = base[:now] + t
        move = switched[:, None] > state
        came[at] = np.where(move, best[:, None], own)
        state = np.where(move, switched[:, None], state) + scores[at]
    current = final.copy()
    for t in range(steps - 1, -1, -1):
        now = active[t]
        at = base[:now] + t
        labels[at] = current[:now]
        if t:
            current[:now] = came[at, current[:now]]
    return labels


def identify(df: DataFrame, model: Model, text: str = "text", penalty: float = SWITCH, spans: bool = False) -> DataFrame:
    """Add lang_pred and score, and with ``spans`` the list lang_spans of (start, end, lang) in code points.

    lang_pred is the language with the most letters on the best path (ties: the first by name), score its share of the
    letters. Null texts and texts without a letter are ``und`` with score 0. One pass without a shuffle, whole texts;
    repeated rows get equal results; columns of these names are replaced, all others pass through.
    """
    df = df.drop("lang_pred", "score", "lang_spans")
    place = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _labelled(batch, text, model, penalty, spans)

    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema.fields)
    more = ", lang_spans array<struct<start:int,end:int,lang:string>>" if spans else ""
    return arrow_map(df, run, f"{fields}, lang_pred string, score double{more}")


def _labelled(batch: pa.RecordBatch, text: str, model: Model, penalty: float, spans: bool) -> pa.RecordBatch:
    """Scores slice by slice, one walk over all texts of the batch."""
    k, kept = len(model.languages), []
    for part in text_slices(batch, text):
        words = words_of(part.column(text).to_pylist())
        kept.append((words.per_text, words.start.astype(np.int32), words.end.astype(np.int32), model.word_scores(words)))
    per_text, starts, ends, scores = (np.concatenate(x) for x in zip(*kept, strict=True))
    labels = viterbi(scores, per_text, penalty) if k else np.zeros(len(starts), np.int64)
    rows = batch.num_rows
    owner = np.repeat(np.arange(rows), per_text)
    letters = np.bincount(owner * max(k, 1) + labels, weights=ends - starts, minlength=rows * max(k, 1)).reshape(rows, max(k, 1))
    total, best = letters.sum(1), letters.argmax(1)
    known = (total > 0) & (k > 0)
    columns = [
        pa.array([model.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), known.tolist(), strict=True)], pa.string()),
        pa.array(np.where(known, letters.max(1) / np.maximum(total, 1), 0.0)),
    ]
    names = ["lang_pred", "score"]
    if spans:
        first = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.diff(labels, prepend=-1) != 0)) if k else np.empty(0, np.int64)
        found: list[list[dict]] = [[] for _ in range(rows)]
        for a, b in zip(first.tolist(), [*(first[1:] - 1).tolist(), len(owner) - 1], strict=False):
            found[owner[a]].append({"start": int(starts[a]), "end": int(ends[b]), "lang": model.languages[labels[a]]})
        columns.append(pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))))
        names.append("lang_spans")
    return pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *names])


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document takes no part in learning."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


@query("op4_language_id")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = train(documents.where(~held_out()))
    found = identify(documents.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
