"""The event log as a stream: files that arrive, windows, sessions, and state beyond them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """Parquet files of events, a few at a time, with an event time that watermarks accept."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", "*.parquet").parquet(path)
    return raw.withColumn("at", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    timed = events.withWatermark("at", late) if events.isStreaming else events
    return timed.groupBy(F.window("at", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    timed = events.withWatermark("at", late) if events.isStreaming else events
    return timed.groupBy(F.session_window("at", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), "user_id", "n")


def deduplicated(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """First event of each key; the state of a stream is bounded by the watermark."""
    return events.withWatermark("at", late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def tailed(events: DataFrame, last: int) -> DataFrame:
    """Each job's events until ``last`` ones have passed, kept in state across batches (admission by count)."""

    def step(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else 0
        for part in parts:
            part = part.sort_values(["at", "event_id"])
            part = part.assign(position=range(seen + 1, seen + len(part) + 1))
            seen += len(part)
            yield part[part.position <= last][["user_id", "event_id", "position"]]
        state.update((seen,))

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, position long", "seen long", "append", "NoTimeout")


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there into a memory table; for tests and small replays."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
