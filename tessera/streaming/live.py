"""Structured Streaming: settled file changes, session windows, delayed outcomes, appended telemetry, index refresh."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def file_changes(spark: SparkSession, root: str, pattern: str = "*.py") -> DataFrame:
    """(path, content, ts): a stream of the files that appear below ``root``. A stream of files takes each name once, so changes are
    published under new names; a tree that is edited in place is compared by hash instead (``history.stale_files``)."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    raw = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root)
    return raw.select("path", "content", F.col("modificationTime").alias("ts"))


def settled(changes: DataFrame, silence: str = "300 milliseconds", late: str = "5 seconds") -> DataFrame:
    """(path, changed_at, events): a path settles after a silence. changes: (path, ts timestamp)."""
    w = changes.withWatermark("ts", late).groupBy("path", F.session_window("ts", silence))
    return w.agg(F.max("ts").alias("changed_at"), F.count(F.lit(1)).alias("events")).drop("session_window")


def sessions(events: DataFrame, *, key: str, idle: str = "2 hours") -> DataFrame:
    """Sessions that end after ``idle``; rows later than that behind the watermark are dropped."""
    w = events.withWatermark("ts", idle).groupBy(key, F.session_window("ts", idle).alias("w"))
    return w.agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def outcomes(retrievals: DataFrame, changes: DataFrame, *, on: str, within: str = "30 minutes") -> DataFrame:
    """Stream-stream interval join; retrievals without a change in time come out with nulls once the watermark passes.
    retrievals: (log_id, on, retrieved_at); changes: (on, changed_at)."""
    r = retrievals.withWatermark("retrieved_at", within).alias("r")
    c = changes.withWatermark("changed_at", within).alias("c")
    return r.join(c, F.expr(f"r.{on} = c.{on} AND c.changed_at >= r.retrieved_at AND c.changed_at <= r.retrieved_at + INTERVAL {within}"), "leftOuter").select("r.*", "c.changed_at")


def append_json(rows: DataFrame, path: str, checkpoint: str, *by: str) -> StreamingQuery:
    """Appends a stream as JSON lines, a folder per key."""
    return rows.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).partitionBy(*by).outputMode("append").trigger(availableNow=True).start()


def refresh(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = "500 milliseconds") -> StreamingQuery:
    """Runs ``apply`` on the last content of each path of a micro-batch. changes: (path, content, ts)."""

    def once(batch: DataFrame, number: int) -> None:
        last = batch.groupBy("path").agg(F.max_by("content", "ts").alias("content"), F.max("ts").alias("changed_at"))
        if not last.isEmpty():
            apply(last, number)

    writer = changes.writeStream.foreachBatch(once).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
