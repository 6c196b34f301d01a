"""Queries on activity sessions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions.text import normal_key
from brindle.operators.sessionize import audit_sessions, event_time_us
from brindle.plans.logs import LATENESS, _as_folder, _scratch
from brindle.sources.tables import table
from brindle.streaming.events import CLOSING, closed_stream
from brindle.streaming.sessions import stream_sessions


def p3_found(spark, d):
    found = audit_sessions(table(spark, d, "audit_events"), by_type=False)
    return found.select("actor_id", "start_us", "end_us", F.col("n_events").cast("bigint").alias("n_events"))


def p3_sessions(spark, d):
    """Every session with the number of events of each type, as text ``type=n`` in order of type."""
    s = audit_sessions(table(spark, d, "audit_events"))
    kinds = F.array_join(F.transform(F.map_entries("by_type"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",")
    return s.select("actor_id", "start_us", "end_us", "duration_us", F.col("n_events").cast("bigint").alias("n_events"), kinds.alias("by_type"))


def p3_stream(spark, d):
    """The sessions of ``p3_found`` by a stream over the whole table, with the watermark that its late events need."""
    events = spark.readStream.schema(table(spark, d, "audit_events").schema).parquet(_as_folder(spark, d, "audit_events"))
    events = events.withColumn("t", F.timestamp_micros(event_time_us()))
    # the closing row, which has nothing but a time, needs a key to reach the watermark; its session is never emitted
    key = F.coalesce(normal_key("actor_id"), F.when(F.col("t") >= F.lit(CLOSING).cast("timestamp"), F.lit("")))
    found = closed_stream(spark, events, "t", _scratch(spark, "sessions"), lambda e: stream_sessions(e, key, F.col("t"), F.col("event_id"), lateness=LATENESS))
    return found.select(F.col("key").alias("actor_id"), F.unix_micros("start_time").alias("start_us"), F.unix_micros("end_time").alias("end_us"), "n_events")


_BLANKS = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_MARKED = f"""
WITH e AS (
  SELECT DISTINCT event_id,
    lower(regexp_replace(actor_id, '^{_BLANKS}|{_BLANKS}$', '', 'g')) AS actor_id,
    coalesce(nullif(lower(regexp_replace(event_type, '^{_BLANKS}|{_BLANKS}$', '', 'g')), ''), 'unknown') AS kind,
    coalesce(epoch_us("timestamp"), CAST(round(timestamp_unix * 1000) AS BIGINT) * 1000) AS t
  FROM audit_events),
l AS (SELECT *, t - lag(t) OVER w AS pause FROM e WHERE actor_id <> '' AND t IS NOT NULL WINDOW w AS (PARTITION BY actor_id ORDER BY t)),
m AS (SELECT *, sum(CASE WHEN pause > 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY actor_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM l)
"""

QUERIES = {"p3_found": p3_found, "p3_sessions": p3_sessions, "p3_stream": p3_stream}
SQL = {
    "p3_found": _MARKED + "SELECT actor_id, min(t) AS start_us, max(t) AS end_us, count(*) AS n_events FROM m GROUP BY actor_id, s",
    "p3_sessions": _MARKED + """, k AS (SELECT actor_id, s, kind, min(t) AS a, max(t) AS b, count(*) AS n FROM m GROUP BY ALL)
SELECT actor_id, min(a) AS start_us, max(b) AS end_us, max(b) - min(a) AS duration_us, CAST(sum(n) AS BIGINT) AS n_events,
  string_agg(kind || '=' || n, ',' ORDER BY kind) AS by_type FROM k GROUP BY actor_id, s""",
}
SQL["p3_stream"] = SQL["p3_found"]
