"""Sets of scopes, policies, chains and tenants as they are asked for by audit and token logs, and the statistics of such logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.operators.audit import clean_events, newest_per


def within(asked: Column, allowed: Column) -> Column:
    """Whether every element of ``asked`` is in ``allowed``; null counts as empty."""
    none = F.array().cast("array<string>")
    return F.size(F.array_except(F.coalesce(asked, none), F.coalesce(allowed, none))) == 0


def united(*sets: Column) -> Column:
    """The sorted distinct elements of all arrays; null arrays are empty, null elements left out."""
    return F.array_sort(F.array_distinct(F.array_compact(F.flatten(F.array_compact(F.array(*sets))))))


def chain_is_valid(chain: Column, most: int) -> Column:
    """Whether nobody is twice in a chain and it isn't longer than ``most``; null is no chain, hence valid."""
    return F.coalesce((F.size(F.array_distinct(chain)) == F.size(chain)) & (F.size(chain) <= most), F.lit(True))


def merged_maps(left: Column, right: Column) -> Column:
    """Both maps in one, the right one's value where both have a key; null maps are empty."""
    a, b = (F.coalesce(m, F.create_map().cast("map<string,string>")) for m in (left, right))
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def expired(now: Column, until: Column) -> Column:
    """Whether ``now`` is after ``until``; what has no end doesn't expire."""
    return F.coalesce(now > until, F.lit(False))


def visible_to(rows: DataFrame, tenant: str, own: str | None, sees_all: bool = False) -> DataFrame:
    """The rows of one's own tenant, or all of them for an administrator; without tenant none."""
    return rows if sees_all else rows.filter(F.col(tenant) == F.lit(own))


def first_policies(requests: DataFrame, policies: DataFrame, most_policies: int = 10_000) -> DataFrame:
    """``request_id, policy_seq``: the first policy (by ``policy_seq``) that covers a request, null if none does.

    ``requests``: ``request_id, tenant_id, scopes, targets``; ``policies``: ``policy_seq, tenant_id, source_scopes,
    target_scopes``. A policy covers requests of its tenant whose scopes hold its source scopes and whose targets are
    among its target scopes; an empty or null list of a policy asks for nothing. Requests that ask for the same are
    compared once. Policies are sent to all executors, so more than ``most_policies`` are an error.
    """
    rules = policies.select(F.col("tenant_id").alias("of"), "policy_seq", "source_scopes", "target_scopes")
    if len(rules.limit(most_policies + 1).select("of").collect()) > most_policies:
        raise ValueError(f"more than {most_policies} policies")
    kinds = requests.groupBy("tenant_id", "scopes", "targets").agg(F.lit(1).alias("one")).drop("one")
    open_end = F.size(F.coalesce("target_scopes", F.array())) == 0
    covers = (F.col("of") == F.col("tenant_id")) & within(F.col("source_scopes"), F.col("scopes")) & (open_end | within(F.col("targets"), F.col("target_scopes")))
    first = kinds.join(F.broadcast(rules), covers).groupBy("tenant_id", "scopes", "targets").agg(F.min("policy_seq").alias("policy_seq"))
    same = [requests[c].eqNullSafe(first[c]) for c in ("tenant_id", "scopes", "targets")]
    return requests.join(first, same, "left").select("request_id", "policy_seq")


def request_kind(path: Column, method: Column, status: Column) -> Column:
    """The type of an audit event by the first rule that holds: errors, then denials, then the part of the service, then reading or writing."""
    part = lambda p: F.contains(path, F.lit(p))
    return (
        F.when(status >= 500, "error.occurred").when(status.isin(401, 403), "access.denied").when(part("login"), "auth.login").when(part("logout"), "auth.logout")
        .when(part("token"), "auth.token_issued").when(part("secret"), "secret.fetch").when(method.isin("POST", "PUT", "PATCH", "DELETE"), "config.changed").otherwise("access.granted")
    )


def not_under(path: Column, prefixes: Sequence[str]) -> Column:
    """Whether a path begins with none of the prefixes; null paths begin with none."""
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | F.startswith(path, F.lit(p))
    return ~F.coalesce(hit, F.lit(False))


def offset_page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """``limit`` rows from ``offset`` on, with ``total`` and ``has_more`` (offset + limit < total)."""
    total = rows.agg(F.count(F.lit(1))).scalar()
    return rows.orderBy(*order).offset(offset).limit(limit).select("*", total.alias("total"), (F.lit(offset + limit) < total).alias("has_more"))


def event_totals(events: DataFrame, duration: Column | None = None, size: Column | None = None) -> DataFrame:
    """One row per ``measure, key``: all events, their outcomes, the events of each type and resource type, mean duration, summed bytes.

    ``value`` is a double; nulls are skipped by mean and sum, which are null where nothing is left.
    """
    rows = clean_events(events).select("event_type", "result", "resource_type", (duration if duration is not None else F.lit(None)).cast("double").alias("d"), (size if size is not None else F.lit(None)).cast("double").alias("b"))
    counts = rows.groupBy("event_type", "result", "resource_type").agg(F.count(F.lit(1)).alias("n"), F.sum("d").alias("d"), F.count("d").alias("nd"), F.sum("b").alias("b"))
    # the counts of each combination are few; everything else is read from them
    per = [counts.groupBy(F.lit(m).alias("measure"), F.col(c).alias("key")).agg(F.sum("n").cast("double").alias("value")) for m, c in (("result", "result"), ("event_type", "event_type"), ("source_type", "resource_type"))]
    whole = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("n"), F.try_divide(F.sum("d"), F.sum("nd").cast("double")).alias("d"), F.sum("b").alias("b"))
    named = F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), F.lit(None).cast("string").alias("key"), F.col(c).alias("value")) for m, c in (("total", "n"), ("mean_duration", "d"), ("bytes", "b"))]))
    return per[0].union(per[1]).union(per[2]).union(whole.select(named))


def exchange_stats(events: DataFrame) -> DataFrame:
    """One row: ``total, succeeded, failed, delegations, impersonations`` of the events that exchange or refresh tokens."""
    kind = F.lower("event_type")
    rows = clean_events(events.filter(F.contains(kind, F.lit("token_")))).select(kind.alias("kind"), "result", F.lower("action").alias("action"))
    return rows.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("result") == "success").alias("succeeded"), F.count_if(F.coalesce(F.col("result") != "success", F.lit(True))).alias("failed"),
        F.count_if(F.contains("kind", F.lit("exchange"))).alias("delegations"), F.count_if(F.contains("action", F.lit("impersonat"))).alias("impersonations"),
    )


def storage_stats(events: DataFrame, most_events: int) -> DataFrame:
    """One row: ``events, tenants, actors, most_events``."""
    rows = clean_events(events.select("event_id", "tenant_id", "actor_id"))
    return rows.agg(F.count(F.lit(1)).alias("events"), F.countDistinct("tenant_id").alias("tenants"), F.countDistinct("actor_id").alias("actors"), F.lit(most_events).cast("bigint").alias("most_events"))


def bounded_log(events: DataFrame, most: int) -> DataFrame:
    """``log, event_id``: what a log of ``most`` events still holds: as a whole, a tenth of it per tenant, a twentieth per actor.

    The oldest go first in each. Every limit is applied before the shuffle.
    """
    rows = clean_events(events.select("event_id", "tenant_id", "actor_id", "timestamp"))
    out = rows.orderBy(F.col("timestamp").desc_nulls_last(), F.desc("event_id")).limit(most).select(F.lit("all").alias("log"), "event_id")
    for name, key, part in (("tenant", "tenant_id", 10), ("actor", "actor_id", 20)):
        kept = newest_per(events.select("event_id", key, "timestamp").filter(F.col(key).isNotNull()), key, max(1, most // part))
        out = out.union(kept.select(F.lit(name).alias("log"), "event_id"))
    return out
