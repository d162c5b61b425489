"""The banded counts of events as a stream: late rows are taken up to a watermark, windows are written when they are closed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, files_at_once: int = 64) -> DataFrame:
    """New Parquet files below ``folder`` as a stream, with the schema of those that are there."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def windowed_counts(events: DataFrame, stamp: str, key: str, value: str, window: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Count and sum of each key and tumbling window; rows later than ``late`` are left out once their window is closed."""
    at = F.col(stamp).cast("timestamp")
    out = events.withColumn("_at", at).withWatermark("_at", late).groupBy(F.window("_at", window).alias("w"), key)
    return out.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), key, "n", "total")


def run_once(counts: DataFrame, folder: str, checkpoint: str) -> None:
    """Takes what has arrived, appends the closed windows to ``folder``, and stops; the next call goes on from the checkpoint."""
    counts.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def session_counts(events: DataFrame, stamp: str, key: str, value: str, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """Count and sum of each session of a key: events that follow each other within ``gap``.

    On a stream with ``late``, state is kept by key until the watermark has
    passed a session's end, then the session is written once; rows that come later are dropped
    and counted (:func:`run_told`).  On a table, all sessions.
    """
    rows = events.withColumn("session_at", F.col(stamp).cast("timestamp"))
    if late is not None:
        rows = rows.withWatermark("session_at", late)
    out = rows.groupBy(F.session_window("session_at", gap).alias("session"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(key, F.col("session.start").alias("session_start"), F.col("session.end").alias("session_end"), "n", "total")


def without_repeats(events: DataFrame, stamp: str, keys: list[str], late: str) -> DataFrame:
    """A stream's first row of each of ``keys``; a key is remembered for ``late`` after its first row's time, so the state does not grow with the stream."""
    return events.withColumn("seen_at", F.col(stamp).cast("timestamp")).withWatermark("seen_at", late).dropDuplicatesWithinWatermark(keys).drop("seen_at")


def run_told(frame: DataFrame, folder: str, checkpoint: str) -> dict[str, int]:
    """As :func:`run_once`; tells how many rows were read, written late (and so dropped), and are still in state."""
    query = frame.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    steps = query.recentProgress
    states = [s for p in steps for s in p.stateOperators]
    kept = steps[-1].stateOperators if steps else []
    return {"read": sum(p.numInputRows for p in steps), "late": sum(s.numRowsDroppedByWatermark for s in states), "in_state": sum(s.numRowsTotal for s in kept)}
