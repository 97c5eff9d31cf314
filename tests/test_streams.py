"""Streams that stop and go on: named checkpoints, committed versions, late rows, timers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessela.streaming import feedback as streams
from tessela.streaming import stateful
from tessela.streaming.store import StreamTable

EVENTS = "event_id long, user_id long, item_id long, event_type string, ts timestamp"


def _put(spark, folder, rows, name=None):
    df = spark.createDataFrame(rows, "event_id long, user_id long, item_id long, event_type string, s long")
    df = df.select("event_id", "user_id", "item_id", "event_type", F.timestamp_seconds("s").alias("ts")).coalesce(1)
    df.write.mode("append").parquet(str(folder))
    return df


def _events(first, n, at=1_700_000_000):
    return [(k, k % 4, k % 3, ("click", "purchase", "view")[k % 3], at + 60 * k) for k in range(first, first + n)]


def test_a_stream_goes_on_with_new_files_only(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "table")
    for k in range(3):
        _put(spark, source, _events(10 * k, 10))
    stream = lambda: streams.feedback_stream(spark, str(source), EVENTS, max_files_per_trigger=2)
    first = StreamTable(spark, target).run(stream())
    assert sum(p["numInputRows"] for p in first) == 30
    _put(spark, source, _events(30, 7))
    _put(spark, source, _events(37, 5))
    again = StreamTable(spark, target)  # nothing is kept in this object but the folder's name
    assert sum(p["numInputRows"] for p in again.run(stream())) == 12
    rows = again.read().collect()
    assert sorted(r["event_id"] for r in rows) == list(range(42)) and len({r["batch"] for r in rows}) == 3
    assert sum(p["numInputRows"] for p in StreamTable(spark, target).run(stream())) == 0
    assert StreamTable(spark, target).read().count() == 42


@pytest.mark.parametrize("every", [1, 2, 100])
def test_running_preference_goes_on_and_equals_its_batch_twin(spark, tmp_path, every):
    source, target = tmp_path / "in", str(tmp_path / "table")
    stream = lambda: streams.feedback_stream(spark, str(source), EVENTS, max_files_per_trigger=1)
    for part in range(3):
        _put(spark, source, _events(20 * part, 15))
        _put(spark, source, _events(20 * part + 15, 5))
        got = streams.run_merged(stream(), streams.preference_delta, streams.merge_preference, "p", compact_every=every, folder=target)
        want = streams.merge_preference(streams.preference_delta(spark.read.schema(EVENTS).parquet(str(source))))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    table = StreamTable(spark, target, streams.merge_preference)
    assert len(table.versions()) <= 2  # old versions are swept
    fs, path = table._path("parts")
    assert fs.listStatus(path).__len__() <= {1: 3, 2: 5, 100: 6}[every]


def test_a_batch_repeated_after_a_crash_counts_once(spark, tmp_path, monkeypatch):
    """The driver dies after the part is written but before its version is, and once more after the version."""
    source, target = tmp_path / "in", str(tmp_path / "table")
    stream = lambda: streams.feedback_stream(spark, str(source), EVENTS, max_files_per_trigger=1)
    _put(spark, source, _events(0, 10))
    StreamTable(spark, target).run(stream())
    _put(spark, source, _events(10, 10))

    def dies(self, version):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(StreamTable, "_commit", dies)
        with pytest.raises(Exception, match="lost"):
            StreamTable(spark, target).run(stream())
    assert StreamTable(spark, target).read().count() == 10  # half a batch is never seen
    commit = StreamTable._commit
    with monkeypatch.context() as m:
        m.setattr(StreamTable, "_commit", lambda self, version: (commit(self, version), dies(self, version)))
        with pytest.raises(Exception, match="lost"):
            StreamTable(spark, target).run(stream())
    assert StreamTable(spark, target).read().count() == 20
    StreamTable(spark, target).run(stream())
    assert sorted(r["event_id"] for r in StreamTable(spark, target).read().collect()) == list(range(20))


def test_an_empty_input_gives_an_empty_table(spark, tmp_path):
    (tmp_path / "in").mkdir()
    table = StreamTable(spark, str(tmp_path / "table"))
    with pytest.raises(ValueError, match="no batch"):
        table.read()
    table.run(streams.feedback_stream(spark, str(tmp_path / "in"), EVENTS))
    assert table.read().count() == 0 and "batch" in table.read().columns


def test_late_rows_are_handed_on(spark, tmp_path):
    """Duplicates inside a batch and across batches, late rows, keys that expire, a null key; the watermark outlives the run."""
    source, target, hour = tmp_path / "in", str(tmp_path / "table"), 3600
    at = 1_700_000_000
    run = lambda: streams.run_available(stateful.dedupe_with_late(
        streams.feedback_stream(spark, str(source), EVENTS), buckets=3), "late", "append", target)[0]
    _put(spark, source, [(1, 1, 1, "a", at), (1, 1, 1, "a", at), (2, 1, 1, "a", at + 10), (None, 1, 1, "n", at), (None, 1, 1, "n", at)])
    run()
    # within the lateness: 1 again is a duplicate, 3 is new; the watermark is at - hour + 10
    _put(spark, source, [(1, 1, 1, "b", at + 20), (3, 1, 1, "b", at - hour + 11), (4, 1, 1, "late", at - hour + 10), (4, 1, 1, "late", at - hour + 10)])
    run()
    _put(spark, source, [(9, 1, 1, "c", at + 3 * hour)])
    run()
    # 1 has expired, its late copy is no duplicate; 9 is one
    _put(spark, source, [(1, 1, 1, "d", at + 3 * hour), (1, 1, 1, "late", at), (9, 1, 1, "d", at + 3 * hour)])
    rows = run().collect()
    assert sorted((r["event_id"] or -1, r["event_type"]) for r in rows if not r["late"]) == [(-1, "n"), (1, "a"), (1, "d"), (2, "a"), (3, "b"), (9, "c")]
    assert sorted((r["event_id"], r["event_type"], r["ts"].timestamp()) for r in rows if r["late"]) == [
        (1, "late", at), (4, "late", at - hour + 10), (4, "late", at - hour + 10)]


def test_recency_expires_by_event_time(spark, tmp_path):
    source, target, day = tmp_path / "in", str(tmp_path / "table"), 86_400
    at = 1_700_000_000
    run = lambda: streams.run_available(stateful.user_recency(
        streams.feedback_stream(spark, str(source), EVENTS), expiry_ms=2 * day * 1000), "recency", "update", target)[0]
    _put(spark, source, [(k, k % 2, 1, "a", at + k) for k in range(10)] + [(99, None, 1, "a", at)])
    run()
    _put(spark, source, [(20, 1, 1, "a", at + day), (21, 1, 1, "late", at - day)])  # the late row counts
    run()
    _put(spark, source, [(30, 7, 1, "a", at + 10 * day)])
    run()
    _put(spark, source, [(31, 0, 1, "a", at + 10 * day)])
    rows = [(r["user_id"], r["last_us"] // 1_000_000, r["rows"], r["expired"]) for r in run().collect()]
    assert sorted(r for r in rows if r[3]) == [(0, at + 8, 5, True), (1, at + day, 7, True)]
    assert sorted(r for r in rows if not r[3]) == sorted([
        (0, at + 8, 5, False), (1, at + 9, 5, False), (1, at + day, 7, False), (7, at + 10 * day, 1, False), (0, at + 10 * day, 1, False)])
