"""Grouping events into sessions separated by pauses, by merging interval states.

Every event opens the interval ``[t, t + gap]``; intervals of one key that touch are one session. The merge runs in
two levels, so that a key with a third of all events is spread over the cluster:

1. repeats of an event in one key *and one slice of time* are dropped, then the intervals of the events are merged as
   ``session_window`` state into partial sessions. A slice of ``slice`` length holds at most ``slice / gap + 1`` of them,
   however many events it has;
2. the few partial sessions of a key are merged as intervals in order of time.

Both levels follow one shuffle each; they sort on disk if they must and hold no group in memory. In batch all events are
there, so none is late; ``streaming.sessions`` merges the same intervals under a watermark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brindle.functions.text import normal_key
from brindle.sources.tables import micros


def event_time_us(timestamp: str = "timestamp", seconds: str = "timestamp_unix") -> Column:
    """Microseconds of ``timestamp``, else of ``seconds`` read to whole milliseconds; null if neither is usable."""
    s = F.col(seconds)
    usable = s.isNotNull() & ~F.isnan(s) & (F.abs(s) < 9e9)
    return F.coalesce(micros(timestamp), F.when(usable, F.round(s * 1000).cast("bigint") * 1000))


def sessionize(
    events: DataFrame,
    key: Column,
    time_us: Column,
    event_id: Column,
    event_type: Column | None = None,
    gap_us: int = 30 * 60 * 1_000_000,
    slice_us: int = 60 * 60 * 1_000_000,
) -> DataFrame:
    """One row per session: ``key, start_us, end_us, duration_us, n_events`` and, with ``event_type``, ``by_type`` MAP.

    A pause longer than ``gap_us`` starts a new session; one of exactly ``gap_us`` doesn't. Rows without key or time
    don't count. Rows of one key and time that repeat an ``event_id`` count once (they may differ in other columns,
    such as the time of arrival); rows without id count one by one. Order of arrival doesn't matter, so late rows are
    merged like any other. Empty input gives no rows; further columns of ``events`` are ignored, whatever their names.
    Types are counted as ``unknown`` where null.
    """
    if gap_us <= 0 or slice_us <= 0:
        raise ValueError("gap and slice must be positive")
    cols = [key.alias("key"), time_us.alias("t"), event_id.alias("id")]
    if event_type is not None:
        cols.append(F.coalesce(event_type, F.lit("unknown")).alias("kind"))
    rows = events.select(*cols).filter("key is not null and t is not null").withColumn("slice", F.expr(f"t div {slice_us}"))

    # laid out once: repeats and intervals both need all rows of a key and slice together
    rows = rows.repartition("key", "slice")
    again = F.when(F.col("id").isNull(), F.count(F.lit(1))).otherwise(1)
    kinds, apart = ([F.min("kind").alias("kind")], [F.when(F.col("id").isNull(), F.col("kind")).alias("apart")]) if event_type is not None else ([], [])
    rows = rows.groupBy("key", "slice", "t", "id", *apart).agg(again.alias("n"), *kinds).withColumn("at", F.timestamp_micros("t"))
    by = ["key", "slice"] + (["kind"] if event_type is not None else [])
    parts = rows.groupBy(*by, F.session_window("at", f"{gap_us} microseconds")).agg(F.min("t").alias("s"), F.max("t").alias("e"), F.sum("n").alias("n"))

    # Parts of several types may overlap, hence the running end instead of the previous one.
    along = W.partitionBy("key").orderBy("s", "e")
    before = along.rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("new", F.coalesce((F.col("s") - F.max("e").over(before) > gap_us).cast("int"), F.lit(0)))
    parts = parts.withColumn("session", F.sum("new").over(along.rowsBetween(W.unboundedPreceding, 0)))
    if event_type is None:
        out = parts.groupBy("key", "session").agg(F.min("s").alias("start_us"), F.max("e").alias("end_us"), F.sum("n").alias("n_events"))
        extra = []
    else:
        kinds = parts.groupBy("key", "session", "kind").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.sum("n").alias("n"))
        out = kinds.groupBy("key", "session").agg(
            F.min("s").alias("start_us"), F.max("e").alias("end_us"), F.sum("n").alias("n_events"),
            F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "n")))).alias("by_type"),
        )
        extra = ["by_type"]
    return out.select("key", "start_us", "end_us", (F.col("end_us") - F.col("start_us")).alias("duration_us"), "n_events", *extra)


def audit_sessions(audit_events: DataFrame, by_type: bool = True, gap_us: int = 30 * 60 * 1_000_000) -> DataFrame:
    """Sessions of ``actor_id`` in audit events; ids and types are read without outer blanks and in lower case."""
    return sessionize(
        audit_events, normal_key("actor_id"), event_time_us(), F.col("event_id"),
        normal_key("event_type") if by_type else None, gap_us,
    ).withColumnRenamed("key", "actor_id")
