"""Queries on audit logs, request limits, job tables and streams, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from brindle.operators.audit import clean_events, export_lines, histogram, matching, newest_per, retained, rollup_counts, sort_order, tenant_stats, top_values
from brindle.operators.jobs import counts_by_state, first_requests, work_order
from brindle.operators.metastore import page
from brindle.operators.ratelimit import limit_requests, offered_load
from brindle.sources.tables import micros, table
from brindle.streaming.events import closed_stream, deduplicated, windowed_counts

START, END, NOW = "2025-09-05 00:00:00", "2025-09-12 00:00:00", "2026-03-01 00:00:00"
DAY_US = 86_400_000_000
BOUNDS = [5.0, 10.0, 25.0, 50.0, 100.0, 250.0]


def audit_filter(spark, d):
    where = matching(event_types=["auth.login", "auth.logout"], results=["success", "failure"], start=START, end=END)
    return clean_events(table(spark, d, "audit_events").filter(where)).select("event_id", "event_type", "result", micros("timestamp").alias("t_us"))


def audit_search(spark, d):
    return clean_events(table(spark, d, "audit_events").filter(matching(text="ToKeN_", results=["success"]))).select("event_id", "action")


def audit_tags(spark, d):
    return clean_events(table(spark, d, "audit_events").filter(matching(tags=["secret", "login"]))).select("event_id", F.array_join("tags", ",").alias("tags"))


def audit_page(spark, d):
    rows = clean_events(table(spark, d, "audit_events")).select("event_id", "event_type", "actor_id", "result", "timestamp")
    return page(rows, sort_order("timestamp"), 3, 25).withColumn("timestamp", micros("timestamp"))


def audit_sorted_by_type(spark, d):
    rows = clean_events(table(spark, d, "audit_events")).select("event_id", "event_type")
    return page(rows, sort_order("event_type", descending=False), 1, 40).select("event_id", "event_type", "total_count")


def audit_tenant_stats(spark, d):
    return tenant_stats(table(spark, d, "audit_events"), START)


def audit_top_actors(spark, d):
    return top_values(table(spark, d, "audit_events"), "actor_id")


def audit_type_counts(spark, d):
    return clean_events(table(spark, d, "audit_events")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def audit_rollup(spark, d):
    return rollup_counts(table(spark, d, "audit_events"), ["tenant_id", "result"])


def audit_retention(spark, d):
    return retained(table(spark, d, "audit_events"), NOW).select("event_id", F.col("retention_days").cast("bigint").alias("retention_days"))


def audit_storage_cap(spark, d):
    return newest_per(table(spark, d, "audit_events"), "tenant_id", 20).select("event_id", "tenant_id", "age")


def audit_export_csv(spark, d):
    return export_lines(table(spark, d, "audit_events"), "csv")


def audit_export_json(spark, d):
    return export_lines(table(spark, d, "audit_events"), "json")


def request_histogram(spark, d):
    return histogram(table(spark, d, "events"), ["event_type"], "value", BOUNDS)


def rate_window(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", micros("ts").alias("t_us"))
    return offered_load(e, "user_id", "t_us", DAY_US)


def rate_limit_exact(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", micros("ts").alias("t_us"))
    return limit_requests(e, "user_id", "t_us", "event_id", DAY_US, 2).select(F.col("id").alias("event_id"), F.col("key").alias("user_id"), "accepted")


def _jobs(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("seq"), (5 - F.substring("o_orderpriority", 1, 1).cast("int")).alias("priority"), F.col("o_orderstatus").alias("state"), F.concat_ws("-", "o_custkey", "o_orderpriority").alias("request_key"))


def queue_order(spark, d):
    jobs = _jobs(spark, d)
    return page(jobs.select("seq", F.col("priority").cast("bigint").alias("priority")), work_order(jobs, "priority", "seq"), 1, 100).select("seq", "priority", "total_count")


def queue_dedup(spark, d):
    return first_requests(_jobs(spark, d), "request_key", "seq").select("request_key", "seq", F.col("priority").cast("bigint").alias("priority"))


def queue_stats(spark, d):
    return counts_by_state(_jobs(spark, d), "state", ["O", "F"]).select("total", F.col("O").alias("open"), F.col("F").alias("finished"), "other")


def _scratch(spark, name):
    """A new folder beside the checkpoints, which all executors share."""
    from brindle.session import checkpoint_dir

    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _audit_stream(spark, d):
    return spark.readStream.schema(table(spark, d, "audit_events").schema).parquet(_as_folder(spark, d, "audit_events"))


#: How late an audit event may come; the latest in the log comes three days after its time.
LATENESS = "4 days"


def stream_hourly_counts(spark, d):
    """A stream over the whole table: repeats go, and a window is given once the watermark has passed its end."""
    counted = closed_stream(
        spark, _audit_stream(spark, d), "timestamp", _scratch(spark, "hourly"),
        lambda e: deduplicated(e, "event_id", "timestamp", LATENESS).groupBy(F.window("timestamp", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")),
    )
    return counted.select(F.unix_micros("w.start").alias("start_us"), "event_type", "n")


def stream_event_windows(spark, d):
    events = spark.readStream.schema(table(spark, d, "events").schema).parquet(_as_folder(spark, d, "events"))
    counted = closed_stream(spark, events, "ts", _scratch(spark, "windows"), lambda e: windowed_counts(e, "ts", ["event_type"], "6 hours", "2 hours", LATENESS))
    return counted.select(F.unix_micros("window_start").alias("start_us"), "event_type", "n")


def _as_folder(spark, d, name):
    """A file source streams folders; a table of one file is found by its name in the folder above."""
    return f"{d}/{name}.parquet*"


QUERIES = {f.__name__: f for f in (
    audit_filter, audit_search, audit_tags, audit_page, audit_sorted_by_type, audit_tenant_stats, audit_top_actors, audit_type_counts, audit_rollup, audit_retention,
    audit_storage_cap, audit_export_csv, audit_export_json, request_histogram, rate_window, rate_limit_exact, queue_order, queue_dedup, queue_stats, stream_hourly_counts, stream_event_windows,
)}

_E = "SELECT DISTINCT ON (event_id) * FROM audit_events WHERE event_id IS NOT NULL"
_J = "SELECT o_orderkey AS seq, CAST(5 - CAST(substring(o_orderpriority, 1, 1) AS INT) AS BIGINT) AS priority, o_orderstatus AS state, o_custkey || '-' || o_orderpriority AS request_key FROM orders"
_CSV = " || ',' || ".join(
    f"'\"' || replace(coalesce({c}, ''), '\"', '\"\"') || '\"'"
    for c in ("event_id", "strftime(\"timestamp\", '%Y-%m-%d %H:%M:%S.%f')", "event_type", "result", "actor_id", "tenant_id", "action", "description")
)
_JSON = ", ".join(
    f"CASE WHEN {c} IS NOT NULL THEN '\"{n}\":' || CAST(to_json({c}) AS VARCHAR) END"
    for n, c in [("event_id", "event_id"), ("timestamp", "strftime(\"timestamp\", '%Y-%m-%d %H:%M:%S.%f')"), *((x, x) for x in ("event_type", "result", "actor_id", "tenant_id", "action", "description"))]
)
SQL = {
    "audit_filter": f"""SELECT event_id, event_type, result, epoch_us("timestamp") AS t_us FROM ({_E}) WHERE event_type IN ('auth.login', 'auth.logout')
  AND result IN ('success', 'failure') AND "timestamp" BETWEEN '{START}' AND '{END}'""",
    "audit_search": f"SELECT event_id, action FROM ({_E}) WHERE result = 'success' AND (contains(lower(description), 'token_') OR contains(lower(action), 'token_') OR contains(lower(event_type), 'token_'))",
    "audit_tags": f"SELECT event_id, array_to_string(tags, ',') AS tags FROM ({_E}) WHERE list_has_any(tags, ['secret', 'login'])",
    "audit_page": f"""SELECT event_id, event_type, actor_id, result, epoch_us("timestamp") AS "timestamp", count(*) OVER () AS total_count, CAST(ceil(count(*) OVER () / 25.0) AS BIGINT) AS total_pages,
  ceil(count(*) OVER () / 25.0) > 3 AS has_next, true AS has_previous FROM ({_E}) e ORDER BY e."timestamp" DESC NULLS LAST, event_id LIMIT 25 OFFSET 50""",
    "audit_sorted_by_type": f"SELECT event_id, event_type, count(*) OVER () AS total_count FROM ({_E}) ORDER BY event_type ASC NULLS LAST, event_id LIMIT 40",
    "audit_tenant_stats": f"""SELECT tenant_id, count(*) AS total, count(*) FILTER (result = 'success') AS successful, count(*) FILTER (result IN ('failure', 'denied', 'error')) AS failed,
  count(DISTINCT actor_id) AS actors, count(DISTINCT CASE WHEN resource_id <> '' THEN coalesce(resource_type, 'None') || ':' || resource_id END) AS resources
FROM ({_E}) WHERE "timestamp" >= '{START}' GROUP BY tenant_id""",
    "audit_top_actors": f"SELECT actor_id AS value, count(*) AS n FROM ({_E}) WHERE actor_id IS NOT NULL GROUP BY actor_id ORDER BY n DESC, value LIMIT 10",
    "audit_type_counts": f"SELECT event_type, count(*) AS n FROM ({_E}) GROUP BY event_type",
    "audit_rollup": f"SELECT tenant_id, result, CAST(grouping(tenant_id, result) AS BIGINT) AS level, count(*) AS n FROM ({_E}) GROUP BY ROLLUP (tenant_id, result)",
    "audit_retention": f"""SELECT event_id, CAST(retention_days AS BIGINT) AS retention_days FROM ({_E})
WHERE retention_days IS NULL OR "timestamp" >= TIMESTAMP '{NOW}' - to_days(retention_days)""",
    "audit_storage_cap": f"""SELECT event_id, tenant_id, age FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY "timestamp" DESC NULLS LAST, event_id DESC) AS age FROM ({_E})) WHERE age <= 20""",
    "audit_export_csv": f"SELECT event_id, {_CSV} AS line FROM ({_E})",
    "audit_export_json": f"SELECT event_id, '{{' || array_to_string(list_filter([{_JSON}], lambda x: x IS NOT NULL), ',') || '}}' AS line FROM ({_E})",
    "rate_limit_exact": f"""WITH RECURSIVE o AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE ts IS NOT NULL),
l(user_id, event_id, i, taken, accepted) AS (SELECT user_id, event_id, i, [t], true FROM o WHERE i = 1
UNION ALL SELECT o.user_id, o.event_id, o.i, CASE WHEN len(k) < 2 THEN list_append(k, o.t) ELSE k END, len(k) < 2
FROM (SELECT l.user_id, l.i, list_filter(l.taken, lambda x: x >= n.t - {DAY_US}) AS k FROM l JOIN o n ON n.user_id IS NOT DISTINCT FROM l.user_id AND n.i = l.i + 1) b JOIN o ON o.user_id IS NOT DISTINCT FROM b.user_id AND o.i = b.i + 1)
SELECT event_id, user_id, accepted FROM l""",
    "request_histogram": "SELECT event_type, total, le, n FROM (SELECT event_type, count(*) AS total, "
    + ", ".join(f"count(*) FILTER (value <= {b}) AS b{n}" for n, b in enumerate(BOUNDS)) + " FROM events GROUP BY event_type), LATERAL (VALUES "
    + ", ".join(f"(CAST({b} AS DOUBLE), b{n})" for n, b in enumerate(BOUNDS)) + ") v(le, n)",
    "rate_window": f"SELECT event_id, user_id, t_us, count(*) OVER (PARTITION BY user_id ORDER BY t_us RANGE BETWEEN {DAY_US} PRECEDING AND CURRENT ROW) AS offered FROM (SELECT event_id, user_id, epoch_us(ts) AS t_us FROM events)",
    "queue_order": f"SELECT seq, priority, count(*) OVER () AS total_count FROM ({_J}) ORDER BY greatest(priority, 0) DESC, seq LIMIT 100",
    "queue_dedup": f"SELECT request_key, min(seq) AS seq, arg_min(priority, seq) AS priority FROM ({_J}) GROUP BY request_key",
    "queue_stats": f"SELECT count(*) AS total, count(*) FILTER (state = 'O') AS open, count(*) FILTER (state = 'F') AS finished, count(*) FILTER (state NOT IN ('O', 'F')) AS other FROM ({_J})",
    "stream_hourly_counts": f"""SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, "timestamp")) AS start_us, event_type, count(*) AS n FROM ({_E}) WHERE "timestamp" IS NOT NULL GROUP BY ALL""",
    "stream_event_windows": """SELECT epoch_us(time_bucket(INTERVAL 2 HOUR, ts)) - k * 7200000000 AS start_us, event_type, count(*) AS n
FROM events, (VALUES (0), (1), (2)) t(k) WHERE ts IS NOT NULL GROUP BY ALL""",
}
