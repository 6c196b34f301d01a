"""Audit logs: conjunctive filters, search, sorted pages, statistics, retention, export."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SORT_KEYS = ("timestamp", "event_type", "actor_id", "result")


def clean_events(events: DataFrame) -> DataFrame:
    """One row per event (redelivered ones are equal but for ``ingested_at``); rows without id are dropped."""
    return events.filter("event_id is not null").dropDuplicates(["event_id"])


def matching(
    event_types: Sequence[str] | None = None, results: Sequence[str] | None = None, actor_id: str | None = None, resource_type: str | None = None,
    resource_id: str | None = None, start: str | None = None, end: str | None = None, text: str | None = None, tags: Sequence[str] | None = None, tenant_id: str | None = None,
) -> Column:
    """The predicate of an audit query: every given condition must hold; both ends of the time range count.

    ``text`` is a substring, in any case, of description, action or event type (``%`` and ``_`` are ordinary signs);
    ``tags`` asks for at least one of them. Nulls match no given condition.
    """
    whole = F.lit(True)
    for name, values in (("event_type", event_types), ("result", results)):
        if values is not None:
            whole = whole & F.col(name).isin(list(values))
    for name, value in (("tenant_id", tenant_id), ("actor_id", actor_id), ("resource_type", resource_type), ("resource_id", resource_id)):
        if value is not None:
            whole = whole & (F.col(name) == value)
    if start is not None:
        whole = whole & (F.col("timestamp") >= F.to_timestamp_ntz(F.lit(start)))
    if end is not None:
        whole = whole & (F.col("timestamp") <= F.to_timestamp_ntz(F.lit(end)))
    if text is not None:
        hit = F.lit(False)
        for c in ("description", "action", "event_type"):
            hit = hit | F.contains(F.lower(c), F.lower(F.lit(text)))
        whole = whole & hit
    if tags is not None:
        whole = whole & F.arrays_overlap("tags", F.array(*map(F.lit, tags)))
    return whole


def sort_order(key: str = "timestamp", descending: bool = True) -> list[Column]:
    """A stable order: an unknown key is the timestamp; ties go by event id; nulls last."""
    key = key if key in SORT_KEYS else "timestamp"
    return [F.col(key).desc_nulls_last() if descending else F.col(key).asc_nulls_last(), F.col("event_id").asc()]


def tenant_stats(events: DataFrame, since: str) -> DataFrame:
    """Per tenant, of the events since a time: totals, successes, failures, distinct actors and resources."""
    # repeats of an event are equal in these columns, so the filter can stand before their removal and reach the scan
    rows = clean_events(events.filter(F.col("timestamp") >= F.to_timestamp_ntz(F.lit(since))).select("event_id", "tenant_id", "result", "actor_id", "resource_type", "resource_id"))
    resource = F.when(F.col("resource_id") != "", F.concat(F.coalesce("resource_type", F.lit("None")), F.lit(":"), "resource_id"))
    return rows.groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("result") == "success").alias("successful"), F.count_if(F.col("result").isin("failure", "denied", "error")).alias("failed"),
        F.countDistinct("actor_id").alias("actors"), F.countDistinct(resource).alias("resources"),
    )


def top_values(events: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The ``k`` most frequent values; equal counts go by value; nulls don't count."""
    counts = clean_events(events.filter(F.col(column).isNotNull()).select("event_id", column)).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "value").limit(k)


def rollup_counts(events: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Counts for every prefix of the dimensions (grouping sets of a roll-up); ``level`` tells which are summed over."""
    return clean_events(events.select("event_id", *dimensions)).rollup(*dimensions).agg(F.grouping_id().cast("bigint").alias("level"), F.count(F.lit(1)).alias("n"))


def retained(events: DataFrame, now: str) -> DataFrame:
    """Events whose retention isn't over at ``now``: timestamp >= now - retention_days; null retention keeps for ever."""
    limit = F.to_timestamp_ntz(F.lit(now)) - F.make_dt_interval(F.col("retention_days"))
    return clean_events(events.filter(F.col("retention_days").isNull() | (F.col("timestamp") >= limit)))


def newest_per(events: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` newest events of each key (null is a key), as a bounded log keeps them."""
    order = W.partitionBy(key).orderBy(F.col("timestamp").desc_nulls_last(), F.desc("event_id"))
    return clean_events(events).withColumn("age", F.row_number().over(order).cast("bigint")).filter(F.col("age") <= n)


def histogram(df: DataFrame, by: Sequence[str], value: str, bounds: Sequence[float]) -> DataFrame:
    """Cumulative buckets: per group and bound, how many values are at most the bound; null values only count in ``total``."""
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(value) <= b).alias(f"b{n}") for n, b in enumerate(bounds)])
    pairs = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"b{n}").alias("n")) for n, b in enumerate(bounds)])
    return counts.select(*by, "total", F.inline(pairs))


def export_lines(events: DataFrame, form: str = "json") -> DataFrame:
    """``event_id, line`` of each event, as JSON or as CSV with quotes doubled; nulls are left out or empty."""
    names = ["event_id", "timestamp", "event_type", "result", "actor_id", "tenant_id", "action", "description"]
    at = F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    cols = [at.alias(c) if c == "timestamp" else F.col(c) for c in names]
    if form == "json":
        return clean_events(events).select("event_id", F.to_json(F.struct(*cols)).alias("line"))
    if form == "csv":
        quoted = [F.concat(F.lit('"'), F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in cols]
        return clean_events(events).select("event_id", F.concat_ws(",", *quoted).alias("line"))
    raise ValueError(f"unknown format {form}")


def request_kind(path: Column, status: Column) -> Column:
    """The outcome of a request: ``success`` under 400, else ``failure``; null status is ``error``."""
    return F.when(status.isNull(), "error").when(status < 400, "success").otherwise("failure")
