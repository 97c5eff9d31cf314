"""WARC archives: written as one gzip stream each, then normalised to one gzip member per record with an offset index.

A whole-file stream can only be read from its start. The normaliser inflates it once, cuts it into records, and writes
every record as a member of its own, so that any record is one seek and one inflate away. Files are written by tasks
through ``pyarrow.fs`` (any store it knows) under names of their own; a file counts only if its row is in the manifest
that Spark commits, so what a lost or repeated task left behind is never read.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessela.llm.common import arrow_map, drop_folder, file_system, open_output, stage, table
from tessela.llm.registry import query
from tessela.session import scratch_path

MIN_REVISIT_BYTES = 100
CHUNK = 1 << 20
MEMBERS_PER_READ = 2048
_DATE = "2024-01-01T00:00:00Z"


def plan_records(pages: DataFrame, page_id: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """Rows (page_id, url, payload, payload_bytes, payload_digest, refers_to): which record each page becomes.

    Of equal payloads of ``MIN_REVISIT_BYTES`` or more, the smallest page_id is the response and the others refer to it.
    Minima are combined before the shuffle and only digests that occur twice are joined back, so a payload that a third
    of the pages share is no hot group. A null payload is empty. A page without an id is a response. Pages that repeat
    the id and payload of the response are responses too.
    """
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "utf-8")
    rows = pages.select(
        F.col(page_id).alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"), payload.alias("payload"),
        F.length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_digest"),
    )
    large = rows.where((F.col("payload_bytes") >= MIN_REVISIT_BYTES) & F.col("page_id").isNotNull())
    first = (
        large.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
        .where("first < last").select("payload_digest", "first")
    )
    refers = F.when((F.col("payload_bytes") >= MIN_REVISIT_BYTES) & (F.col("page_id") > F.col("first")), F.col("first"))
    return rows.join(first, "payload_digest", "left").select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest", refers.alias("refers_to"))


def _record(row: dict) -> bytes:
    revisit = row["refers_to"] is not None
    body = b"" if revisit else row["payload"]
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>",
        f"WARC-Date: {_DATE}", "WARC-Target-URI: " + " ".join(row["url"].split()),
        f"WARC-Payload-Digest: sha256:{row['payload_digest']}", f"X-Payload-Length: {row['payload_bytes']}",
        f"X-Page-Id: {'' if row['page_id'] is None else row['page_id']}",
    ]
    if revisit:
        head += [f"X-Refers-To-Page: {row['refers_to']}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: text/html", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def write_monolithic(records: DataFrame, folder: str, file_bytes: int = 256 << 20) -> DataFrame:
    """Write records to archives that are one gzip stream each; rows (archive, records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = (row for batch in batches for i in range(batch.num_rows) for row in batch.slice(i, 1).to_pylist())
        row = next(batches, None)
        while row is not None:
            path, n, size, deflate = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0, zlib.compressobj(1, zlib.DEFLATED, 31)
            with open_output(path) as out:
                while row is not None and size < file_bytes:
                    out.write(deflate.compress(data := _record(row)))
                    n, size, row = n + 1, size + len(data), next(batches, None)
                out.write(deflate.flush())
            yield pa.RecordBatch.from_pydict({"archive": [path], "records": pa.array([n], pa.int64())})

    return arrow_map(records, run, "archive string, records long")


def _inflated(path: str) -> Iterator[bytes]:
    where, name = file_system(path)
    with where.open_input_stream(name, compression=None) as source:
        inflate = zlib.decompressobj(31)
        while data := source.read(CHUNK):
            while data:
                yield inflate.decompress(data)
                data = inflate.unused_data
                if inflate.eof:
                    inflate = zlib.decompressobj(31)
        yield inflate.flush()


def records_of(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records out of an inflated stream, cut by their Content-Length; holds one record and one chunk."""
    held = bytearray()
    more = True
    while True:
        end = held.find(b"\r\n\r\n")
        if end >= 0:
            head = bytes(held[:end]).decode().split("\r\n")
            length = int(next(h for h in head if h.lower().startswith("content-length:")).split(":")[1])
            whole = end + 4 + length + 4
            while len(held) < whole:
                held += next(chunks)
            yield bytes(held[:whole])
            del held[:whole]
            continue
        if not more:
            break
        data = next(chunks, None)
        more = data is not None
        held += data or b""
    if held.strip():
        raise ValueError("an archive ends inside a record")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite each archive record by record; rows (archive, sidecar, first, records), one per MEMBERS_PER_READ records.

    The sidecar next to an archive holds one line per record: offset, length, type. A task holds one record at a time.
    """
    n = max(1, int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                offset, index = 0, []
                with open_output(path) as out, open_output(f"{path}.idx") as side:
                    for record in records_of(_inflated(raw)):
                        deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = deflate.compress(record) + deflate.flush()
                        out.write(member)
                        kind = record[: record.index(b"\r\n\r\n")].split(b"WARC-Type: ")[1].split(b"\r\n")[0].decode()
                        side.write(json.dumps([offset, len(member), kind]).encode() + b"\n")
                        offset += len(member)
                        index.append(None)
                firsts = list(range(0, len(index), MEMBERS_PER_READ))
                yield pa.RecordBatch.from_pydict({
                    "archive": [path] * len(firsts), "sidecar": [f"{path}.idx"] * len(firsts), "first": pa.array(firsts, pa.int64()),
                    "records": pa.array([min(MEMBERS_PER_READ, len(index) - f) for f in firsts], pa.int64()),
                })

    return arrow_map(archives.repartition(n, "archive"), run, "archive string, sidecar string, first long, records long")


def read_records(index: DataFrame) -> DataFrame:
    """Read records through their offsets: page_id, url, record_type, payload, payload_bytes, payload_digest, refers_to.

    A response's length and digest come from the payload that was read and are checked against its header; a revisit's
    from its header, its payload is null.
    """
    n = max(1, int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for job in batch.to_pylist():
                where, path = file_system(job["archive"])
                _, side = file_system(job["sidecar"])
                with where.open_input_stream(side, compression=None) as f:
                    lines = f.read().splitlines()[job["first"] : job["first"] + job["records"]]
                rows, held = [], 0
                with where.open_input_file(path) as f:
                    for offset, length, kind in map(json.loads, lines):
                        rows.append(_parsed(zlib.decompress(f.read_at(length, offset), 31), kind))
                        held += len(rows[-1]["payload"] or b"")
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=_READ)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_READ)

    schema = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"
    return arrow_map(index.repartition(n, "archive", "first"), run, schema)


_READ = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()),
])


def _parsed(record: bytes, kind: str) -> dict:
    end = record.index(b"\r\n\r\n")
    head = dict(line.split(": ", 1) for line in record[:end].decode().split("\r\n")[1:] if ": " in line)
    body = record[end + 4 : end + 4 + int(head["Content-Length"])]
    digest, size = head["WARC-Payload-Digest"].removeprefix("sha256:"), int(head["X-Payload-Length"])
    response = head["WARC-Type"] == "response"
    if head["WARC-Type"] != kind or (response and (hashlib.sha256(body).hexdigest() != digest or len(body) != size)):
        raise ValueError(f"record of page {head.get('X-Page-Id')} does not agree with its header")
    return {
        "page_id": int(head["X-Page-Id"]) if head.get("X-Page-Id") else None, "url": head.get("WARC-Target-URI", ""),
        "record_type": kind, "payload": body if response else None, "payload_bytes": size, "payload_digest": digest,
        "refers_to": int(head["X-Refers-To-Page"]) if "X-Refers-To-Page" in head else None,
    }


def archive(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``pages`` (page_id, url, html) below ``folder`` and return the index of the normalised archives.

    Every row becomes one record, repeated rows too. The whole-file streams are deleted once they are normalised.
    """
    spark = pages.sparkSession
    raw = stage(write_monolithic(plan_records(pages), f"{folder}/raw"), "warc-raw")
    index = stage(normalise(raw, f"{folder}/members"), "warc-index")
    drop_folder(spark, f"{folder}/raw")
    return index


@query("op2_warc", """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = archive(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    return read_records(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
