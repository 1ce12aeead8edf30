"""Streams: exactly one result per song however late, keyed state with time-outs, merges that survive a crash."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from resona.sources import keyed
from resona.streaming import status

SCHEMA = "song_id long, seq long, ts string, processing_status string"


def saved(spark, folder, *batches):
    """A stream that reads each batch of events as one micro-batch."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).select("song_id", "seq", F.to_timestamp("ts").alias("status_ts"), "processing_status").coalesce(1).write.parquet(f"{folder}/{k}")
    return spark.readStream.schema("song_id long, seq long, status_ts timestamp, processing_status string").option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def test_one_result_per_song_two_hours_later(spark, tmp_path):
    first = [(1, 1, "2024-01-01 00:00:00", "pending"), (1, 2, "2024-01-01 00:00:01", "pending"), (2, 3, "2024-01-01 00:01:00", "pending"), (None, 9, "2024-01-01 00:01:00", "pending")]
    late = [(1, 4, "2024-01-01 02:30:00", "pending"), (3, 5, "2024-01-01 02:31:00", "pending")]
    run = lambda: status.once_in_results(saved_stream, f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination(120)
    saved_stream = saved(spark, f"{tmp_path}/in", first, late)
    run()
    got = lambda: sorted((r.song_id, r.seq) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got() == [(1, 1), (2, 3), (3, 5)]
    # the last batch was written, but not noted as done: it comes again and gives the same
    newest = max((p for p in (tmp_path / "c/commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    newest.unlink()
    (newest.parent / f".{newest.name}.crc").unlink(missing_ok=True)
    run()
    assert got() == [(1, 1), (2, 3), (3, 5)]


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, before)


def test_steps_and_time_outs(spark, tmp_path, rocks):
    from resona.plans import registry  # noqa: F401
    from resona.plans.relations import st5_processing_seconds

    day = lambda t: f"2024-01-01 {t}"
    one = [(1, 1, day("00:00:00"), "pending"), (1, 3, day("00:05:00"), "completed"), (2, 4, day("00:01:00.5"), "pending"), (3, 5, day("00:02:00"), "failed")]
    two = [(1, 2, day("00:02:00"), "processing"), (2, 6, day("00:01:00.5"), "processing"), (4, 7, day("00:06:00"), "processing")]  # an event that comes late
    end = [(99, 100, day("09:00:00"), "completed")]
    last = [(99, 101, day("20:00:00"), "completed")]
    stream = saved(spark, f"{tmp_path}/in", one, two, end, last)
    query = status.step_seconds(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(150)
    rows = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    events = spark.createDataFrame(one + two + end, SCHEMA).select("song_id", "seq", F.to_timestamp("ts").alias("status_ts"), "processing_status")
    want = {tuple(r) for r in st5_processing_seconds.__wrapped__(events).collect()} if hasattr(st5_processing_seconds, "__wrapped__") else {tuple(r) for r in st5_processing_seconds(events).collect()}
    assert {r for r in rows if r[2] != "timed_out"} == want
    assert {r for r in rows if r[2] == "timed_out"} == {(2, 6, "timed_out", 3600), (4, 7, "timed_out", 3600)}


def test_merge_by_key_rewrites_touched_buckets(spark, tmp_path, monkeypatch):
    frame = lambda rows: spark.createDataFrame(rows, "id long, at long, name string")
    path = f"{tmp_path}/table"
    assert keyed.keyed_table(spark, path) is None
    keyed.merge_by_key(frame([(i, 1, f"a{i}") for i in range(40)] + [(None, 1, "x"), (3, 0, "old")]), path, "id", ["at"], buckets=8)
    files = lambda: {p.name for p in Path(path, "data").rglob("*.parquet")}
    live = lambda: {Path(f).name for f in keyed.keyed_table(spark, path).inputFiles()}
    before = live()
    assert keyed.merge_by_key(frame([(3, 2, "b3"), (3, 1, "late"), (41, 2, "b41")]), path, "id", ["at"]) == 2
    rows = {r.id: r.name for r in keyed.keyed_table(spark, path).collect()}
    assert rows == {i: f"a{i}" for i in range(40)} | {3: "b3", 41: "b41"}
    assert len(before & live()) >= len(before) - 2 and len(before - live()) >= 1
    assert keyed.merge_by_key(frame([]), path, "id", ["at"]) == 2
    # a crash between the buckets and the manifest leaves the old table; the next merge takes the version's place
    from pyspark.sql.readwriter import DataFrameWriter

    write = DataFrameWriter.parquet

    def broken(self, path, *a, **k):
        if "manifests" in path:
            raise OSError("lost")
        return write(self, path, *a, **k)

    monkeypatch.setattr(DataFrameWriter, "parquet", broken)
    with pytest.raises(OSError):
        keyed.merge_by_key(frame([(3, 9, "never")]), path, "id", ["at"])
    monkeypatch.undo()
    assert {r.id: r.name for r in keyed.keyed_table(spark, path).collect()} == rows and files() > live()
    keyed.merge_by_key(frame([(5, 9, "z5")]), path, "id", ["at"])
    assert {r.id: r.name for r in keyed.keyed_table(spark, path).collect()} == rows | {5: "z5"}


def test_stream_merges_into_the_keyed_table(spark, tmp_path):
    stream = saved(spark, f"{tmp_path}/in", [(1, 1, "2024-01-01 00:00:00", "pending"), (2, 2, "2024-01-01 00:00:00", "pending")], [(1, 3, "2024-01-01 00:09:00", "completed")])
    status.merge_batches(stream, f"{tmp_path}/t", f"{tmp_path}/c", "song_id", ["status_ts", "seq"], buckets=4).awaitTermination(120)
    assert {(r.song_id, r.processing_status) for r in keyed.keyed_table(spark, f"{tmp_path}/t").collect()} == {(1, "completed"), (2, "pending")}
