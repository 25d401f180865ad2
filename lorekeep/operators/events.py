"""Bounded event history per stream, and replay after a known event."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_EVENTS = 100


def last_n(events: DataFrame, n: int = MAX_EVENTS, stream: str = "stream_id", seq: str = "seq") -> DataFrame:
    """Newest ``n`` events of each stream. Spark limits each map task's share of a stream to ``n``
    before the shuffle, so a stream with most of the rows stays cheap."""
    newest = Window.partitionBy(stream).orderBy(F.desc(seq))
    return events.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") <= n).drop("_rank")


def replay(retained: DataFrame, lookups: DataFrame) -> DataFrame:
    """Events after each looked-up one, of the same stream: last_event_id, stream_id, event_id, seq.

    ``retained`` holds at most ``n`` events per stream, which bounds what one lookup returns.
    Unknown and evicted ids return nothing.
    """
    known = lookups.select(F.col("event_id").alias("last_event_id")).distinct()
    at = retained.select(F.col("event_id").alias("last_event_id"), "stream_id", F.col("seq").alias("_after"))
    found = known.join(at, "last_event_id")
    later = found.join(retained.select("stream_id", "event_id", "seq"), "stream_id").filter(F.col("seq") > F.col("_after"))
    return later.select("last_event_id", "stream_id", "event_id", "seq")


def replay_streams(retained: DataFrame, lookups: DataFrame) -> DataFrame:
    """Stream of each looked-up id (null when unknown or evicted) and how many events follow it."""
    follow = F.row_number().over(Window.partitionBy("stream_id").orderBy(F.desc("seq"))) - 1
    at = retained.select(F.col("event_id").alias("last_event_id"), "stream_id", follow.alias("n_after"))
    asked = lookups.select(F.col("event_id").alias("last_event_id")).distinct()
    return asked.join(at, "last_event_id", "left").select(
        "last_event_id", "stream_id", F.coalesce("n_after", F.lit(0)).cast("bigint").alias("n_after")
    )
