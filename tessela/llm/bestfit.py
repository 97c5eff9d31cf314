"""Best-fit packing into sequences of a fixed number of tokens, planned on the histogram of lengths.

Best fit decreasing over documents would need all of them in one place. Here the driver sees how many pieces have each
length, at most as many numbers as a sequence has tokens, and packs counts: a class of equal sequences takes the next
length together. The plan says which ranks of a length go to which sequences. Every piece gets its rank within its length
from where it was written, and takes the planned slot of that length and rank by a join with one row on either side.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessela.llm.common import arrow_map, mix, span_hashes, stage, table, text_bytes, text_slices, word_spans
from tessela.llm.registry import query

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
CAPACITY = 4096
CACHE_WORDS = 1 << 20
SLOT_BLOCK = 1 << 14


# ---- encoding -------------------------------------------------------------------------------------------------------

class WordEncoder:
    """Encodes texts with a tokenizer that never looks beyond white space, each distinct word once.

    Texts are cut at ASCII white space, which no token of the vocabulary spans, and composition and lower-casing do not
    reach across. A word is looked up by its hash of 63 bits; only new ones are given to the library. The store is bounded and
    starts anew when full. Special-token strings in a text are ordinary text.
    """

    MAP_BITS = 20

    def __init__(self, path: str, cache: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.cache = cache
        self._reset()

    def _reset(self) -> None:
        self.known, self.slots = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.map, self.of_slot = np.zeros(1 << self.MAP_BITS, np.int32), np.zeros(1, np.uint64)
        self.starts, self.ids = np.zeros(2, np.int64), np.empty(0, np.uint32)  # slot 0 is no word

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, number of ids of each text); null is empty."""
        data, offsets = text_bytes(texts)
        starts, ends, words = word_spans(data, offsets)
        slot = self._slots(data, starts, ends, mix(span_hashes(data, starts, ends) | np.uint64(1)))
        sizes = self.starts[slot + 1] - self.starts[slot]
        before = np.cumsum(sizes) - sizes
        index = np.arange(int(sizes.sum())) + np.repeat(self.starts[slot] - before, sizes)
        total, last = np.concatenate([[0], np.cumsum(sizes)]), np.concatenate([[0], np.cumsum(words)])
        return self.ids[index], np.diff(total[last])

    def _slots(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The number of each word in the store: through a direct-mapped table, what that misses through the sorted hashes."""
        cell = (hashes >> np.uint64(64 - self.MAP_BITS)).astype(np.int64)
        slot = self.map[cell].astype(np.int64)
        missed = np.flatnonzero(self.of_slot[slot] != hashes)
        if not len(missed):
            return slot
        wanted, first, back = np.unique(hashes[missed], return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, wanted)
        old = at < len(self.known)
        old[old] = self.known[at[old]] == wanted[old]
        if len(self.known) and len(self.known) + int((~old).sum()) > self.cache:
            self._reset()
            return self._slots(data, starts, ends, hashes)
        found = np.empty(len(wanted), np.int64)
        found[old] = self.slots[at[old]]
        if not old.all():
            new = np.flatnonzero(~old)
            where = missed[first[new]]
            texts = [data[a:b].tobytes().decode() for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)]
            encoded = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
            sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
            found[new] = np.arange(len(new)) + len(self.of_slot)
            self.ids = np.concatenate([self.ids, np.fromiter((i for e in encoded for i in e), np.uint32, int(sizes.sum()))])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
            self.of_slot = np.concatenate([self.of_slot, wanted[new]])
            self.known, self.slots = np.insert(self.known, at[new], wanted[new]), np.insert(self.slots, at[new], found[new])
        slot[missed] = found[back]
        self.map[cell[missed]] = slot[missed]
        return slot


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def pieces(documents: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int | None = END_ID, doc_id: str = "doc_id", text: str = "text",
           with_ids: bool = False) -> DataFrame:
    """Written table of the pieces of all documents: task, doc_id, piece, start, length, ids_crc32, rank (and ids).

    A document is its ids and the end id; null texts are empty. Only a document longer than ``capacity`` is cut, into
    pieces of ``capacity`` and a rest. ``rank`` counts the pieces of the same length that the task has written before.
    """
    schema = "task int, doc_id long, piece int, start long, length int, ids_crc32 long, rank long" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, seen = encoder(vocabulary), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for part in text_slices(batch, "text", 1 << 20):
                ids, sizes = encode.encode(part.column("text"))
                if end_id is not None:
                    ids, sizes = np.insert(ids, np.cumsum(sizes), end_id), sizes + 1
                ids = ids.astype("<u4")
                count = np.maximum(1, -(-sizes // capacity))
                owner = np.repeat(np.arange(len(sizes)), count)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                length = np.minimum(sizes[owner] - start, capacity)
                at = np.concatenate([[0], np.cumsum(length)])
                # the rank within the batch is the place in a stable sort by length
                order = np.argsort(length, kind="stable")
                runs = np.bincount(length, minlength=capacity + 1)
                rank = np.empty(len(length), np.int64)
                rank[order] = np.arange(len(length)) - np.repeat(np.cumsum(runs) - runs, runs)
                rank += seen[length]
                seen += runs
                columns = {
                    "task": pa.array(np.full(len(owner), task), pa.int32()), "doc_id": part.column("doc_id").take(pa.array(owner)),
                    "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int32()),
                    "ids_crc32": pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.int64()),
                    "rank": pa.array(rank, pa.int64()),
                }
                if with_ids:
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_pydict(columns)

    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return stage(arrow_map(rows, run, schema), "pieces")


# ---- planning -------------------------------------------------------------------------------------------------------

def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit decreasing over counts: rows (length, first_rank, sequences, each, first_sequence, offset).

    Sequences ``first_sequence`` and on take ``each`` pieces of ``length`` apiece from ``offset``, in order of rank from
    ``first_rank``. Sequences with the same room are interchangeable, so the open ones are runs of equal room; a length
    takes the tightest room it fits, whole runs at a time. Work and result grow with the number of lengths, not of pieces.
    """
    rows: list[tuple[int, int, int, int, int, int]] = []
    runs: dict[int, list[tuple[int, int]]] = {}  # room: runs (first sequence, count)
    rooms: list[int] = []  # the rooms that have runs, ascending
    sequences = 0

    def add(room: int, first: int, count: int) -> None:
        if room <= 0:
            return
        if room not in runs:
            runs[room] = []
            rooms.insert(int(np.searchsorted(rooms, room)), room)
        runs[room].append((first, count))

    for length in sorted((k for k, n in histogram.items() if n and k > 0), reverse=True):
        rank, left = 0, histogram[length]
        while left:
            at = int(np.searchsorted(rooms, length))
            if at < len(rooms):
                room = rooms[at]
                first, count = runs[room].pop()
                if not runs[room]:
                    del runs[room], rooms[at]
            else:
                room, first, count = capacity, sequences, -(-left // (capacity // length))
                sequences += count
            # one piece more leaves the least room there is, until the sequence is full for this length
            each = room // length
            whole = min(count, left // each)
            if whole:
                rows.append((length, rank, whole, each, first, capacity - room))
                add(room - each * length, first, whole)
                rank, left = rank + whole * each, left - whole * each
            if whole < count:
                if left and left < each:
                    rows.append((length, rank, 1, left, first + whole, capacity - room))
                    add(room - left * length, first + whole, 1)
                    rank, left, whole = rank + left, 0, whole + 1
                if whole < count:
                    add(room, first + whole, count - whole)
    return rows


def slots(spark: SparkSession, rows: list[tuple[int, int, int, int, int, int]]) -> DataFrame:
    """The plan as one row per slot: length, rank, sequence_id, offset. Long runs are dealt out in blocks before they expand."""
    planned = spark.createDataFrame(rows or [(0, 0, 0, 1, 0, 0)], "length int, first_rank long, sequences long, each int, first_sequence long, offset int")
    planned = planned.where("sequences > 0").withColumn("slots", F.col("sequences") * F.col("each"))
    blocks = planned.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / SLOT_BLOCK))))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = blocks.repartition(n, "length", "first_rank", "block")
    k = F.explode(F.sequence(F.col("block") * SLOT_BLOCK, F.least(F.col("slots"), (F.col("block") + 1) * SLOT_BLOCK) - 1)).alias("k")
    return blocks.select("*", k).select(
        "length", (F.col("first_rank") + F.col("k")).alias("rank"), (F.col("first_sequence") + F.floor(F.col("k") / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("offset") + (F.col("k") % F.col("each")) * F.col("length")).cast("long").alias("offset"))


def pack(documents: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int | None = END_ID, doc_id: str = "doc_id", text: str = "text",
         with_ids: bool = False) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens: one row per piece.

    Columns doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids if asked for; ``start`` counts the
    document's ids before the piece, ``offset`` is its place in the sequence. Null and empty texts are the end id alone;
    without an end id a document of no ids has no piece. Rows of equal or null id are packed like others. Further
    columns are ignored; an empty table gives no rows. Documents over ``capacity`` are the only ones cut.
    """
    spark = documents.sparkSession
    cut = pieces(documents, vocabulary, capacity, end_id, doc_id, text, with_ids).where("length > 0")
    counts = stage(cut.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    # one number per length, and lengths end at the capacity
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    # one row per task and length
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cut.join(offsets, ["task", "length"]).withColumn("rank", F.col("rank") + F.col("base")).drop("task", "base")
    packed = ranked.join(slots(spark, plan(histogram, capacity)), ["length", "rank"])
    return packed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else []))


def sequences(packed: DataFrame) -> DataFrame:
    """The token ids of each sequence, of pieces that carry ``ids``: rows (sequence_id, ids). A sequence is of bounded size."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


@query("op13_best_fit_packing")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
