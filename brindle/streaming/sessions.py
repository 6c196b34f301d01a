"""The same sessions over a stream: merging ``session_window`` state with a watermark for late events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stream_sessions(events: DataFrame, key: Column, time: Column, event_id: Column, gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """Sessions of a streaming ``events``: ``key, start_time, end_time, n_events``, emitted once the watermark passed.

    An event that arrives within ``lateness`` still merges into its session, joining two sessions if it bridges them;
    a redelivered event (same id) within the watermark counts once. A pause of exactly ``gap`` doesn't end a session,
    as Spark merges session windows that touch.
    """
    rows = events.select(key.alias("key"), time.cast("timestamp").alias("t"), event_id.alias("id"))
    rows = rows.filter("key is not null and t is not null").withWatermark("t", lateness).dropDuplicatesWithinWatermark(["key", "id"])
    out = rows.groupBy("key", F.session_window("t", gap)).agg(F.min("t").alias("start_time"), F.max("t").alias("end_time"), F.count(F.lit(1)).alias("n_events"))
    return out.select("key", "start_time", "end_time", "n_events")
