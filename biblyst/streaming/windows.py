"""Streaming forms of the event operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    """Parquet files of a folder as a stream; ``ts`` becomes a timestamp with zone, as watermarks need."""
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, user_id, n): tumbling windows; events later than ``late`` are dropped."""
    n = events.withWatermark("ts", late).groupBy(F.window("ts", window), "user_id").agg(F.count("*").alias("n"))
    return n.select(F.col("window.start").alias("start"), "user_id", "n")


def accepted(events: DataFrame, window: str, limit: int, late: str) -> DataFrame:
    """Windows in which a user stays within the limit."""
    return windowed_counts(events, window, late).withColumn("accepted", F.col("n") <= limit)


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(start, end, user_id, n): sessions that end after a pause."""
    n = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return n.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")


def timeouts(runs: DataFrame, hours: int, late: str = "1 hour") -> DataFrame:
    """(run_id, status): runs (run_id, ts, type) that ended, or were given up ``hours`` after their last event."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"run_id": [key[0]], "status": ["error"]})
            return
        last, done = state.get if state.exists else (0, False)
        for pdf in batches:
            last = max(last, int(pdf["ts"].max().timestamp() * 1000))
            done = done or bool((pdf["type"] == "done").any())
        if done:
            if state.exists:
                state.remove()
            yield pd.DataFrame({"run_id": [key[0]], "status": ["done"]})
            return
        state.update((last, done))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + hours * 3_600_000)
        yield pd.DataFrame({"run_id": pd.Series([], dtype="int64"), "status": pd.Series([], dtype="object")})

    marked = runs.withWatermark("ts", late)
    return marked.groupBy("run_id").applyInPandasWithState(step, "run_id long, status string", "last long, done boolean", "append", "EventTimeTimeout")


def run_to_table(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Write what is there now and return."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
