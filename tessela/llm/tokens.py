"""Token files with directly addressable codes: any token of any document without decoding a block.

An id is split into chunks of a few bits, lowest first. Level k holds the k-th chunk of the ids that have one, and a bitmap
says which of them go on to the next level; a directory of ranks (set bits before every block of 512) turns a position in
one level into the position in the next. The chunk widths of a file are chosen from the bit lengths of its own ids.
"""

from __future__ import annotations

import json
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessela.llm.common import arrow_map, file_system, mix, open_output, span_hashes, stage, table, text_slices
from tessela.llm.registry import query
from tessela.session import scratch_path

MAGIC = b"DACT0001"
SHARD_IDS = 2 << 20
RANK_BLOCK = 512
LEVELS = 3
END_ID = 2
CACHE_PIECES = 4_000_000
VOCABULARY = "byte_bpe_50k.json"


# ---- codes ----------------------------------------------------------------------------------------------------------

def chunk_widths(ids: np.ndarray, levels: int = LEVELS) -> list[int]:
    """The widths of at most ``levels`` chunks with the fewest bits for these ids."""
    bits = np.maximum(1, np.ceil(np.log2(ids.astype(np.float64) + 1)).astype(np.int64)) if len(ids) else np.ones(1, np.int64)
    longest = int(bits.max())
    above = np.concatenate([np.cumsum(np.bincount(bits, minlength=longest + 1)[::-1])[::-1], [0]])  # ids of at least b bits
    best: dict[tuple[int, int], tuple[float, list[int]]] = {}

    def solve(done: int, left: int) -> tuple[float, list[int]]:
        if done >= longest:
            return 0.0, []
        if (done, left) not in best:
            here = float(above[done + 1]) if done else float(len(ids))
            options = []
            for width in range(1, longest - done + 1):
                last = done + width >= longest
                if not last and left == 1:
                    continue
                cost, rest = solve(done + width, left - 1)
                options.append((here * (width + (not last)) + cost, [width, *rest]))
            best[done, left] = min(options)
        return best[done, left]

    return solve(0, levels)[1]


def _pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    out, step = [], 1 << 17
    for at in range(0, len(values), step):
        part = values[at : at + step]
        out.append(np.packbits(((part[:, None] >> np.arange(width, dtype=np.uint32)) & 1).astype(np.uint8).ravel(), bitorder="little"))
    return np.concatenate(out) if out else np.empty(0, np.uint8)


def _unpack_bits(data: np.ndarray, width: int, positions: np.ndarray) -> np.ndarray:
    """The ``width``-bit values at ``positions``; reads the bytes around each of them only."""
    bit = positions.astype(np.int64) * width
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    byte, shift = bit >> 3, (bit & 7).astype(np.uint64)
    word = np.zeros(len(positions), np.uint64)
    for k in range((width + 14) // 8):
        word |= padded[byte + k].astype(np.uint64) << np.uint64(8 * k)
    return (word >> shift) & np.uint64((1 << width) - 1)


class Level:
    """Chunks of one width, the bitmap of those that go on, and its rank directory."""

    def __init__(self, width: int, codes: np.ndarray, more: np.ndarray | None, ranks: np.ndarray | None):
        self.width, self.codes, self.more, self.ranks = width, codes, more, ranks

    @classmethod
    def build(cls, values: np.ndarray, width: int, more: np.ndarray | None) -> Level:
        ranks = None
        if more is not None:
            per = np.add.reduceat(more, np.arange(0, len(more), RANK_BLOCK), dtype=np.int64) if len(more) else np.empty(0, np.int64)
            ranks = (np.cumsum(per) - per).astype(np.uint32)
            more = np.packbits(more, bitorder="little")
        return cls(width, _pack_bits(values & np.uint32((1 << width) - 1), width), more, ranks)

    def goes_on(self, at: np.ndarray) -> np.ndarray:
        return (self.more[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each position: the directory, then whole bytes of the block, then the last byte's head."""
        block = at // RANK_BLOCK
        table_ = np.concatenate([[0], np.cumsum(np.bitwise_count(self.more).astype(np.int64))])
        byte = at >> 3
        inside = table_[byte] - table_[block * (RANK_BLOCK // 8)]
        head = np.bitwise_count(self.more[byte] & ((1 << (at & 7)) - 1).astype(np.uint8))
        return self.ranks[block].astype(np.int64) + inside + head


class Codes:
    """A sequence of ids as chunk levels; ``get`` takes any positions."""

    def __init__(self, n: int, levels: list[Level]):
        self.n, self.levels = n, levels

    @classmethod
    def build(cls, ids: np.ndarray) -> Codes:
        rest, levels = ids.astype(np.uint32), []
        widths = chunk_widths(ids)
        for k, width in enumerate(widths):
            more = (rest >> np.uint32(width) > 0).astype(np.uint8) if k + 1 < len(widths) else None
            levels.append(Level.build(rest, width, more))
            if more is not None:
                rest = (rest >> np.uint32(width))[more == 1]
        return cls(len(ids), levels)

    def get(self, positions: np.ndarray) -> np.ndarray:
        out = np.zeros(len(positions), np.uint32)
        at, where, shift = positions.astype(np.int64), np.arange(len(positions)), 0
        for level in self.levels:
            out[where] |= (_unpack_bits(level.codes, level.width, at) << np.uint64(shift)).astype(np.uint32)
            if level.more is None:
                break
            on = level.goes_on(at)
            at, where, shift = level.rank(at[on]), where[on], shift + level.width
        return out


def write_shard(uri: str, doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> None:
    """One file: a header with the sizes of all arrays, document ids and lengths, then the levels."""
    codes = Codes.build(ids)
    null = np.array([d is None for d in doc_ids], np.uint8)
    arrays = [null, np.array([d or 0 for d in doc_ids], np.int64), lengths.astype(np.int64)]
    for level in codes.levels:
        arrays += [level.codes] + ([] if level.more is None else [level.more, level.ranks])
    head = json.dumps({
        "ids": len(ids), "levels": [[x.width, x.more is not None] for x in codes.levels], "arrays": [[a.dtype.str, len(a)] for a in arrays],
    }).encode()
    with open_output(uri) as out:
        out.write(MAGIC + len(head).to_bytes(8, "little") + head)
        for a in arrays:
            out.write(a.astype(a.dtype.newbyteorder("<")).tobytes())


def read_shard(uri: str) -> tuple[list[int | None], np.ndarray, Codes]:
    """(document ids, lengths, codes) of one file."""
    where, path = file_system(uri)
    with where.open_input_stream(path, compression=None) as f:
        data = f.read()
    if data[:8] != MAGIC:
        raise ValueError(f"{uri} is not a token file")
    at = 16 + int.from_bytes(data[8:16], "little")
    head, arrays = json.loads(data[16:at]), []
    for kind, n in head["arrays"]:
        arrays.append(np.frombuffer(data, np.dtype(kind), n, at))
        at += arrays[-1].nbytes
    null, docs, lengths, *rest = arrays
    levels, k = [], 0
    for width, more in head["levels"]:
        levels.append(Level(width, rest[k], rest[k + 1] if more else None, rest[k + 2] if more else None))
        k += 3 if more else 1
    return [None if x else d for x, d in zip(null.tolist(), docs.tolist(), strict=True)], lengths, Codes(head["ids"], levels)


# ---- encoding -------------------------------------------------------------------------------------------------------

class PieceEncoder:
    """Encodes texts with a byte-level BPE, each distinct piece once.

    The tokenizer first cuts a text into pieces (letters, digits, other signs, white space, each with at most one leading
    space) and then merges inside a piece only. Pieces are found with array operations, looked up by hash, and only new
    ones are given to the library. Texts with characters beyond Latin letters and common signs go to the library whole,
    since its character tables may be of another Unicode version. The store of known pieces is bounded and starts anew
    when full. Equal hashes count as equal pieces (64 bits and the length).
    """

    SAFE = 0x250
    # Signs beyond SAFE that belong to no letter, digit or space class
    SIGNS = "‐‑‒–—―‘’‚“”„†‡•…‰‹›€™"

    MAP_BITS = 22

    def __init__(self, path: str, cache: int = CACHE_PIECES):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.cache = cache
        limit = max(self.SAFE, max(map(ord, self.SIGNS)) + 1)
        self.kind = np.full(limit + 1, 9, np.uint8)  # 0 letter, 1 digit, 2 other, 3 space, 9 not handled here
        for c in [*range(self.SAFE), *map(ord, self.SIGNS)]:
            category = unicodedata.category(chr(c))
            self.kind[c] = {"L": 0, "N": 1}.get(category[0], 3 if chr(c).isspace() and not 0x1C <= c <= 0x1F else 2)
        self.limit = limit
        self._reset()

    def _reset(self) -> None:
        self.hashes, self.slots = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.map, self.slot_hash = np.full(1 << self.MAP_BITS, -1, np.int32), np.zeros(1, np.uint64)
        self.starts, self.ids = np.zeros(1, np.int64), np.empty(0, np.uint16 if self.library.get_vocab_size() < 1 << 16 else np.uint32)

    def _pieces(self, points: np.ndarray, kind: np.ndarray, ends_text: np.ndarray) -> np.ndarray:
        """Which code points begin a piece."""
        n = len(points)
        change = np.ones(n, bool)
        change[1:] = kind[1:] != kind[:-1]
        change[ends_text[ends_text < n]] = True
        space = kind == 3
        begins = change.copy()
        # the last space of a run joins what follows it if it is a plain space, else stands alone; at the end of a text it stays
        after = np.flatnonzero(change & ~space)
        after = after[(after > 0)]
        at_start = np.zeros(n + 1, bool)
        at_start[ends_text] = True
        after = after[~at_start[after] & space[after - 1]]
        begins[after - 1] = True
        plain = after[points[after - 1] == 0x20]
        begins[plain] = False
        # contractions: an apostrophe that begins a piece and is followed by s, t, m, d, re, ve or ll
        mark = np.flatnonzero((points == 0x27) & begins)
        if len(mark):
            ahead = np.full((len(mark), 2), 0, np.uint32)
            room = np.searchsorted(ends_text, mark, side="right")
            stop = ends_text[room]
            for k in (1, 2):
                ok = mark + k < stop
                ahead[ok, k - 1] = points[mark[ok] + k]
            one = np.isin(ahead[:, 0], [ord(c) for c in "stmd"])
            two = np.zeros(len(mark), bool)
            for pair in ("re", "ve", "ll"):
                two |= (ahead[:, 0] == ord(pair[0])) & (ahead[:, 1] == ord(pair[1]))
            for which, size in ((one, 2), (two & ~one, 3)):
                for i in mark[which].tolist():
                    begins[i + 1 : i + size] = False
                    if i + size < n and not at_start[i + size]:
                        # what follows is cut as if the text began here; letters that go on are a piece of their own
                        if not (space[i + size] and not begins[i + size]):
                            begins[i + size] = True
        return begins

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, number of ids of each text)."""
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        kind = self.kind[np.minimum(points, self.limit)]
        odd_points = np.flatnonzero(kind == 9)
        odd = np.unique(np.searchsorted(ends, odd_points, side="right")) if len(odd_points) else np.empty(0, np.int64)
        if len(odd):
            return self._mixed(texts, odd)
        if not len(points):
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        starts = np.flatnonzero(self._pieces(points, kind, ends))
        stops = np.append(starts[1:], len(points))
        slot = self._slots(joined, points, starts, stops)
        sizes = self.starts[slot + 1] - self.starts[slot]
        offsets = np.cumsum(sizes) - sizes
        index = np.arange(int(sizes.sum())) + np.repeat(self.starts[slot] - offsets, sizes)
        per_text = np.bincount(np.searchsorted(ends, starts, side="right"), weights=sizes, minlength=len(texts)).astype(np.int64)
        return self.ids[index].astype(np.uint32), per_text

    def _mixed(self, texts: list[str], odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        whole = {int(i): np.array(e.ids, np.uint32) for i, e in zip(odd, self.library.encode_batch_fast([texts[i] for i in odd], add_special_tokens=False), strict=True)}
        plain = [i for i in range(len(texts)) if i not in whole]
        ids, sizes = self.encode([texts[i] for i in plain])
        parts = dict(zip(plain, np.split(ids, np.cumsum(sizes)[:-1]), strict=True)) if plain else {}
        every = [whole.get(i, parts.get(i)) for i in range(len(texts))]
        return np.concatenate(every), np.array([len(x) for x in every], np.int64)

    def _slots(self, joined: str, points: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """The store's number of each piece: first through a direct-mapped table, what it misses through the sorted hashes."""
        # a span hash over code points: two bytes hold every one that comes here
        flat = points.astype("<u2").view(np.uint8)
        hashes = mix(span_hashes(flat, starts * 2, stops * 2))
        cell = (hashes >> np.uint64(64 - self.MAP_BITS)).astype(np.int64)
        slot = self.map[cell]
        missed = np.flatnonzero(self.slot_hash[slot] != hashes)
        if not len(missed):
            return slot
        wanted, first, back = np.unique(hashes[missed], return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, wanted)
        known = at < len(self.hashes)
        known[known] = self.hashes[at[known]] == wanted[known]
        found = np.empty(len(wanted), np.int64)
        found[known] = self.slots[at[known]]
        new = ~known
        if new.any():
            if len(self.hashes) + int(new.sum()) > self.cache and len(self.hashes):
                self._reset()
                return self._slots(joined, points, starts, stops)
            where = missed[first[new]]
            pieces = [joined[a:b] for a, b in zip(starts[where].tolist(), stops[where].tolist(), strict=True)]
            encoded = [e.ids for e in self.library.encode_batch_fast(pieces, add_special_tokens=False)]
            sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
            flat_ids = np.fromiter((i for e in encoded for i in e), self.ids.dtype, int(sizes.sum()))
            found[new] = np.arange(len(where)) + len(self.starts) - 1
            self.ids = np.concatenate([self.ids, flat_ids])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
            self.slot_hash = np.concatenate([self.slot_hash[:-1], wanted[new], self.slot_hash[-1:]])
            self.hashes, self.slots = np.insert(self.hashes, at[new], wanted[new]), np.insert(self.slots, at[new], found[new])
        slot[missed] = found[back]
        self.map[cell[missed]] = slot[missed]
        return slot


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


# ---- tables ---------------------------------------------------------------------------------------------------------

def write_tokens(documents: DataFrame, folder: str, vocabulary: str, doc_id: str = "doc_id", text: str = "text", end_id: int | None = END_ID,
                 shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode every text and write token files in ascending ``doc_id`` order; the manifest (shard, start, docs, ids).

    Null texts are empty; rows without an id come first; rows of equal id follow each other by text. Ranges of ids are
    tasks, files hold ``shard_ids`` ids in about. ``start`` counts the ids before a file: sums per task, then of the tasks.
    """
    spark = documents.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ordered = ordered.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, held, docs, lengths, size, seq = encoder(vocabulary), [], [], [], 0, 0
        task = TaskContext.get().partitionId()

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(held) if held else np.empty(0, np.uint32)
            uri = f"{folder}/{task:06d}-{seq:06d}-{uuid.uuid4().hex}.dact"
            write_shard(uri, docs, np.array(lengths, np.int64), ids)
            row = {"task": [task], "seq": [seq], "shard": [uri], "docs": pa.array([len(docs)], pa.int64()), "ids": pa.array([len(ids)], pa.int64())}
            return pa.RecordBatch.from_pydict(row | {"task": pa.array([task], pa.int32()), "seq": pa.array([seq], pa.int32())})

        for batch in batches:
            for part in text_slices(batch, "text", 1 << 20):
                ids, sizes = encode.encode(part.column("text").to_pylist())
                if end_id is not None:
                    ids = np.insert(ids, np.cumsum(sizes), end_id)
                    sizes = sizes + 1
                held.append(ids)
                docs += part.column("doc_id").to_pylist()
                lengths += sizes.tolist()
                size += len(ids)
                if size >= shard_ids:
                    yield flush()
                    held, docs, lengths, size, seq = [], [], [], 0, seq + 1
        if docs:
            yield flush()

    shards = stage(arrow_map(ordered, run, "task int, seq int, shard string, docs long, ids long"), "token-shards")
    # one row per task, then one row per file of a task
    tasks = shards.groupBy("task").agg(F.sum("ids").alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = tasks.select("task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("task").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("base") + F.coalesce(F.sum("ids").over(inside), F.lit(0))
    return shards.join(tasks, "task").select("shard", start.cast("long").alias("start"), "docs", "ids")


def read_tokens(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """Read token files back: doc_id, start, n_tokens, ids_crc32, and the ids themselves if asked for."""
    n = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, start in zip(batch.column("shard").to_pylist(), batch.column("start").to_pylist(), strict=True):
                docs, lengths, codes = read_shard(shard)
                at = np.concatenate([[0], np.cumsum(lengths)])
                ids = np.concatenate([codes.get(np.arange(a, min(a + (1 << 18), codes.n))) for a in range(0, codes.n, 1 << 18)] or [np.empty(0, np.uint32)])
                flat = ids.astype("<u4")
                columns = {
                    "doc_id": pa.array(docs, pa.int64()), "start": start + at[:-1], "n_tokens": lengths,
                    "ids_crc32": pa.array([zlib.crc32(flat[a:b].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.int64()),
                }
                if with_ids:
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return arrow_map(manifest.repartition(n, "shard"), run, schema)


def token_at(manifest: DataFrame, positions: DataFrame) -> DataFrame:
    """The token at each position of the whole sequence: (position, id), through the codes of the one file that has it.

    ``positions (position)`` are dealt to files by a range join on blocks; a position outside the sequence has no row.
    """
    block = SHARD_IDS
    files = manifest.withColumn("__block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.greatest(F.col("ids"), F.lit(1)) - 1) / block))))
    asked = positions.select("position", F.floor(F.col("position") / block).alias("__block"))
    hits = asked.join(files, "__block").where("position >= start AND position < start + ids").select("shard", "position", (F.col("position") - F.col("start")).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, at, position = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "at", "position"))
            for one in dict.fromkeys(shard):
                mine = shard == one
                yield pa.RecordBatch.from_pydict({"position": position[mine], "id": read_shard(one)[2].get(at[mine]).astype(np.int64)})

    return arrow_map(hits.repartition("shard").sortWithinPartitions("shard"), run, "position long, id long")


@query("op7_token_codes")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    documents = table(spark, sf_dir, "documents")
    manifest = write_tokens(documents, scratch_path(spark, "tokens"), public_tokenizers.path(VOCABULARY))
    return read_tokens(manifest, with_ids=False)
