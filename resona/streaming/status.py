"""Structured Streaming jobs for the life of a song: latest status, exactly-once analysis, batch upserts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from resona.operators.insights import song_insights
from resona.operators.tables import first_per_key
from resona.sources.keyed import merge_by_key

# Progress by status.
PROGRESS = {"pending": 10, "processing": 60, "completed": 100, "failed": 0}


def progress(status: Column) -> Column:
    mapping = F.create_map(*[F.lit(x) for pair in PROGRESS.items() for x in pair])
    return F.coalesce(mapping[status], F.lit(0))


def latest_status(events: DataFrame) -> DataFrame:
    """Newest status per song by (status_ts, seq). Batch or stream (complete or update mode)."""
    return events.groupBy("song_id").agg(F.max(F.struct("status_ts", "seq", "processing_status")).alias("last")).select(
        "song_id", F.col("last.status_ts").alias("status_ts"), F.col("last.seq").alias("seq"), F.col("last.processing_status").alias("status"), progress(F.col("last.processing_status")).alias("progress"))


def once_per_song(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """One event per song within the watermark."""
    return events.withWatermark("status_ts", delay).dropDuplicatesWithinWatermark(["song_id"])


def upsert_batches(stream: DataFrame, path: str, checkpoint: str, key: str, order: list[str]):
    """Start a query that appends every micro-batch under its own batch folder, so a replayed batch overwrites itself."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _saved(spark: SparkSession, path: str) -> DataFrame | None:
    """The batches saved under ``path``; None before the first."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.option("basePath", path).parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def once_in_results(events: DataFrame, path: str, checkpoint: str, key: str = "song_id", order: tuple[str, ...] = ("status_ts", "seq"), analyse: Callable[[DataFrame], DataFrame] | None = None):
    """Start a query that saves one result per key, however late a repeat comes: what is new is told from the results themselves.

    A micro-batch keeps the first event of each key and drops keys that an earlier batch's results hold. It
    writes its own batch folder, and a replayed batch leaves its own folder out of the comparison, so a
    restart after a crash between the write and the checkpoint gives the same rows. No state grows with the keys.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        fresh = first_per_key(batch.where(F.col(key).isNotNull()), [key], list(order))
        saved = _saved(batch.sparkSession, path)
        if saved is not None:
            fresh = fresh.join(saved.where(F.col("batch") != batch_id).select(key), key, "left_anti")
        (analyse(fresh) if analyse else fresh).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return events.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_batches(stream: DataFrame, path: str, checkpoint: str, key: str, order: list[str], buckets: int = 64):
    """Start a query that merges every micro-batch into the keyed table at ``path``; a replayed batch changes nothing."""
    return stream.writeStream.foreachBatch(lambda batch, _: merge_by_key(batch, path, key, order, buckets)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _step_timer(limit_ms: int):
    """A processor that tells how long each status of a song took to come, and which songs never came to an end."""
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    class StepTimer(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.waiting = handle.getListState("waiting", "ms long, micros long, seq long, status string")
            self.last = handle.getValueState("last", "micros long, seq long, status string")

        def handleInputRows(self, key, rows, timerValues):
            """Rows wait until the watermark has passed them, so they are told in the order of their times."""
            for frame in rows:
                micros = (frame["status_ts"].astype("datetime64[us]")).astype("int64")
                for m, seq, status in zip(micros, frame["seq"], frame["processing_status"], strict=True):
                    self.waiting.appendValue((int(m // 1000), int(m), int(seq), status))
                    self.handle.registerTimer(int(m // 1000) + 1)
            return iter([])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            now = expiredTimerInfo.getExpiryTimeInMs()
            held = sorted(self.waiting.get(), key=lambda r: (r[1], r[2]))
            due, rest = [r for r in held if r[0] < now], [r for r in held if r[0] >= now]
            last = self.last.get() if self.last.exists() else None
            out = []
            for _, micros, seq, status in due:
                out.append((key[0], seq, status, None if last is None else micros // 1_000_000 - last[0] // 1_000_000))
                last = (micros, seq, status)
            if last is not None and not due and last[2] in ("pending", "processing") and last[0] // 1000 + limit_ms <= now:
                out.append((key[0], last[1], "timed_out", limit_ms // 1000))
                last = (last[0], last[1], "timed_out")
            if due:
                self.waiting.put(rest) if rest else self.waiting.clear()
                if last[2] in ("pending", "processing"):
                    self.handle.registerTimer(last[0] // 1000 + limit_ms)
            if last is not None:
                self.last.update(last)
            if out:
                yield pd.DataFrame(out, columns=["song_id", "seq", "processing_status", "seconds"]).astype({"seconds": "Int64"})

        def close(self) -> None:
            pass

    return StepTimer()


def step_seconds(events: DataFrame, delay: str = "10 minutes", limit_seconds: int = 3600) -> DataFrame:
    """Stream of (song_id, seq, processing_status, seconds since the song's status before), in the order of time even where events come late.

    State is kept per song: its last status and the events that the watermark hasn't passed yet. A song whose last status
    is no end gets one more row, ``timed_out``, when the watermark is ``limit_seconds`` past it. Needs the
    RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    timed = events.withWatermark("status_ts", delay).select("song_id", "seq", "status_ts", "processing_status")
    schema = f"song_id {events.schema['song_id'].dataType.simpleString()}, seq long, processing_status string, seconds long"
    return timed.groupBy("song_id").transformWithStateInPandas(_step_timer(limit_seconds * 1000), schema, outputMode="Append", timeMode="EventTime")


def current(table: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The newest row per key of an append-only table."""
    others = [c for c in table.columns if c != key]
    return table.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("row")).select(key, "row.*")


def analyze_uploads(songs: DataFrame, analysis: str, failures: str, checkpoint: str):
    """Start a query that scores each new song; songs without features go to the failures table as 'failed'."""
    def score(batch: DataFrame, batch_id: int) -> None:
        ready = F.col("energy").isNotNull() & F.col("danceability").isNotNull()
        song_insights(batch.where(ready)).write.mode("overwrite").parquet(f"{analysis}/batch={batch_id}")
        batch.where(~ready).select("rec_id", F.lit("failed").alias("processing_status")).write.mode("overwrite").parquet(f"{failures}/batch={batch_id}")

    return songs.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def batch_results(stream: DataFrame, path: str, checkpoint: str):
    """Start a query that saves every micro-batch's analysis under its own batch folder; a replayed batch overwrites itself."""
    def save(batch: DataFrame, batch_id: int) -> None:
        song_insights(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def combined(spark: SparkSession, path: str, final: str) -> DataFrame:
    """All saved batches as one table, written to ``final``: the newest batch of each song counts."""
    saved = spark.read.option("basePath", path).parquet(path)
    current(saved, "rec_id", ["batch"]).drop("batch").write.mode("overwrite").parquet(final)
    return spark.read.parquet(final)
