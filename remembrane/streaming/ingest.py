"""Structured Streaming: ingest exactly once, windows, sessions, snapshots in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_table(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def ingest_once(events: DataFrame, identity: str, event_time: str, delay: str = "1 day") -> DataFrame:
    """The first event of each identity; state is kept for the delay after an event's time."""
    return events.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([identity])


def window_counts(events: DataFrame, event_time: str, size: str, group: str, delay: str = "1 hour", slide: str | None = None) -> DataFrame:
    """window_start, group, n: events in windows; late ones count until the watermark passes."""
    w = F.window(event_time, size, slide) if slide else F.window(event_time, size)
    return events.withWatermark(event_time, delay).groupBy(w.alias("w"), group).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), group, "n")


def sessions(events: DataFrame, event_time: str, gap: str, group: str, delay: str = "1 hour") -> DataFrame:
    """session_start, session_end, group, n: runs of a group's events with less than a gap between."""
    s = F.session_window(event_time, gap)
    out = events.withWatermark(event_time, delay).groupBy(s.alias("s"), group).agg(F.count("*").alias("n"))
    return out.select(F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), group, "n")


def run_available(stream: DataFrame, target: str, checkpoint: str, mode: str = "append") -> None:
    """Process all that is there into a table of files, with exactly-once commits by the checkpoint."""
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", target).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def run_each_batch(stream: DataFrame, apply, checkpoint: str, mode: str = "append") -> None:
    """apply(batch, number) for each micro-batch; a number is seen again after a failure, so apply must be idempotent."""
    stream.writeStream.outputMode(mode).foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def reconcile_snapshots(spark: SparkSession, folder: str, memory, checkpoint: str) -> None:
    """Snapshot files that arrive in a folder, applied to a memory in order of their observation times.

    One seen again after a failure changes nothing: its items are equal to the open versions by then, or it is late.
    """
    from ..schemas import SNAPSHOT
    from ..sources.observations import snapshot_items

    def apply(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        for head in batch.select("source", "scope", "snapshotId", "observedAt").orderBy("observedAt", "snapshotId").collect():
            own = batch.where((F.col("snapshotId") == head["snapshotId"]) & (F.col("source") == head["source"]) & (F.col("scope") == head["scope"]))
            memory.reconcile(snapshot_items(own), head["source"], head["scope"], head["snapshotId"], head["observedAt"])
        batch.unpersist()

    stream = spark.readStream.schema(SNAPSHOT).option("multiLine", "true").json(folder)
    run_each_batch(stream, apply, checkpoint)
