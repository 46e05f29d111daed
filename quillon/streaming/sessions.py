"""Streaming sessions, an addition to the batch operators: late events within a watermark, duplicates dropped, sessions by gap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.guards import require_columns, require_positive


def session_counts(events: DataFrame, gap_minutes: int = 30, watermark: str = "1 hour") -> DataFrame:
    """visitorid, start_ms, last_ms and events of each session of a stream (or table) of timestamp (ms), visitorid, event, itemid.

    A session ends when the gap passes without an event of the visitor; an event exactly a gap later still belongs to it, so the
    window is a millisecond longer than the gap. Exact repeats inside the watermark count once; events later than it are dropped.
    """
    require_columns(events.columns, ["timestamp", "visitorid", "event", "itemid"], "events")
    require_positive(gap_minutes=gap_minutes)
    timed = events.withColumn("time", F.timestamp_millis("timestamp")).withWatermark("time", watermark)
    names = ["timestamp", "visitorid", "event", "itemid"]
    once = timed.dropDuplicatesWithinWatermark([*names, "time"]) if events.isStreaming else timed.dropDuplicates(names)
    window = F.session_window("time", f"{gap_minutes * 60_000 + 1} milliseconds")
    counted = once.groupBy("visitorid", window.alias("session")).agg(F.min("timestamp").alias("start_ms"), F.max("timestamp").alias("last_ms"), F.count("*").alias("events"))
    return counted.drop("session")
