"""Streams. The engine's facts are batches; these are extras: windowed counts, and publishing snapshots as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomgraph.operators.tables import write_snapshot


def timed_stream(events: DataFrame, late: str) -> DataFrame:
    """A stream with its watermark, which asks for a timestamp with a time zone; a batch as it is."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Counts by type and hour; on a stream, events later than the watermark are left out."""
    timed = timed_stream(events, late)
    return timed.groupBy(F.window("ts", "1 hour").start.alias("hour"), "event_type").agg(F.count("*").alias("n")).select("event_type", "hour", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Events of a user without a gap, as sessions."""
    timed = timed_stream(events, late)
    window = F.session_window("ts", gap)
    return timed.groupBy(window.alias("session"), "user_id").agg(F.count("*").alias("n")).select("user_id", "session.start", "session.end", "n")


def publish_stream(facts: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch replaces the snapshots that it holds; a batch that runs again writes the same."""
    return facts.writeStream.foreachBatch(lambda batch, _: write_snapshot(batch, target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
