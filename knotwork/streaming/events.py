"""Bursts of events as sessions, and the state of files kept by a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """A stream of Parquet event files with ``ts`` as an event time (a time zone is needed for watermarks)."""
    return spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def sessions(events: DataFrame, gap: str = "500 milliseconds", key: str = "user_id", watermark: str | None = None) -> DataFrame:
    """(key, started, ended, events): bursts separated by at least ``gap`` of quiet; works on tables and streams."""
    rows = events.withWatermark("ts", watermark) if watermark else events
    grouped = rows.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("events"))
    return grouped.select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "events")


def tumbling(events: DataFrame, width: str = "1 hour", slide: str | None = None, key: str = "event_type", watermark: str | None = None) -> DataFrame:
    """(started, key, events, total) per tumbling or sliding window; late rows within the watermark count."""
    rows = events.withWatermark("ts", watermark) if watermark else events
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return rows.groupBy(w.alias("w"), key).agg(F.count("*").alias("events"), F.sum("value").alias("total")).select(F.col("w.start").alias("started"), key, "events", "total")


def run_available(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there into an in-memory table and stop; for tests and hooks that run once."""
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def keyed_state(events: DataFrame, key: str = "user_id") -> DataFrame:
    """(key, seen, last_type): how many events of each key a stream has seen, and the latest type, as they change."""

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, last, at = state.get if state.exists else (0, None, 0)
        for pdf in frames:
            seen += len(pdf)
            times = pdf["ts"].astype("int64")
            if len(pdf) and int(times.max()) >= at:
                at = int(times.max())
                last = pdf.loc[times.idxmax(), "event_type"]
        state.update((seen, last, at))
        yield pd.DataFrame({key: [k[0]], "seen": [seen], "last_type": [last]})

    return events.select(key, "ts", "event_type").groupBy(key).applyInPandasWithState(
        update, f"{key} bigint, seen bigint, last_type string", "seen bigint, last_type string, at bigint", "update", GroupStateTimeout.NoTimeout)


def watch(stream: DataFrame, update: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Call ``update(dirty roots, batch number)`` for each batch of change events (root, path, ts).

    Roots that changed several times in a batch are given once. Errors of one batch are logged by Spark and end
    the query; started again from its checkpoint it resumes with that batch.
    """
    trigger = {"processingTime": every} if every else {"availableNow": True}

    def each(batch: DataFrame, number: int) -> None:
        dirty = batch.select("root").distinct()
        if not dirty.isEmpty():
            update(dirty, number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**trigger).start()
