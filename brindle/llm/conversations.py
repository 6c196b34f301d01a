"""Rebuilding conversations from message rows.

Messages that lack a session id are gathered first: reply and quote links between messages are edges, their connected
components (alternating large-star and small-star joins) are conversations, which take the smallest session id that
any of their messages carries, else a name made of the smallest message id. Then every conversation is put in order
and checked.

The check is a fold of segments. The rows of one conversation and hour make a segment (count, first and last role,
flaw or none), and segments are joined in order of time, so that a session with a third of all rows is spread over
hours instead of going through one task. Rows without a time, which are flawed anyhow, are spread by their content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brindle.functions.text import WS, strip
from brindle.llm.components import connected_components
from brindle.sources.tables import micros

SLICE_US = 3_600_000_000
#: Slices of the rows of a conversation that have no time, below all others.
TIMELESS, NO_ROWS = 256, -(1 << 40)


def links_in_metadata(messages: DataFrame, keys: tuple[str, ...] = ("reply_to", "quoted_id", "quote_of", "in_reply_to")) -> DataFrame:
    """``src, dst`` message ids from the JSON text ``metadata``; invalid JSON and missing keys give no link."""
    found = F.array_compact(F.array(*[F.get_json_object("metadata", f"$.{k}") for k in keys]))
    rows = messages.filter(F.col("metadata").rlike("|".join(keys)))
    return rows.select(F.col("id").alias("src"), F.explode(found).alias("dst")).filter("src is not null")


def assign_conversations(messages: DataFrame, links: DataFrame | None) -> DataFrame:
    """``messages`` with ``conversation_id``: the session id, else that of its component, else null."""
    base = messages.withColumn("conversation_id", F.col("session_id"))
    if links is None or links.isEmpty():
        return base
    parts = connected_components(links)
    members = messages.select(F.col("id").alias("node"), "session_id").filter("node is not null").distinct().join(parts, "node", "right")
    names = members.groupBy("component").agg(F.coalesce(F.min("session_id"), F.concat(F.lit("conversation_"), F.first("component"))).alias("name"))
    named = parts.join(names, "component").select(F.col("node").alias("id"), "name")
    lone = messages.filter("session_id is null").join(named, "id", "left").withColumn("conversation_id", F.col("name")).drop("name")
    return base.filter("session_id is not null").unionByName(lone)


def _turn_rows(messages: DataFrame) -> DataFrame:
    """One row per distinct (role, content, timestamp) of a conversation, without system rows, with flaw marks."""
    role = F.lower(strip("role"))
    visible = F.coalesce(F.regexp_replace("content", f"[{WS}\\x{{200b}}\\x{{feff}}]+", "") != "", F.lit(False))
    rows = messages.filter("conversation_id is not null").select(
        "conversation_id", F.col("role").alias("raw_role"), role.alias("role"), F.col("content"), F.md5("content").alias("mark"),
        micros("timestamp").alias("t"), visible.alias("visible"),
    )
    spread = F.pmod(F.xxhash64("raw_role", "mark"), F.lit(TIMELESS)) - (1 << 39)
    rows = rows.withColumn("slice", F.coalesce(F.expr(f"t div {SLICE_US}"), spread))
    rank = F.when(F.col("role") == "user", 0).otherwise(1)
    w = W.partitionBy("conversation_id", "slice").orderBy("t", rank, "raw_role", "mark")
    same = F.lit(True)
    for c in ("t", "raw_role", "mark"):
        same = same & F.lag(c).over(w).eqNullSafe(F.col(c))
    rows = rows.withColumn("again", (F.row_number().over(w) > 1) & same).filter(~F.col("again")).drop("again")
    rows = rows.filter(~F.coalesce(F.col("role") == "system", F.lit(False)))
    flaw = F.coalesce(~F.col("role").isin("user", "assistant") | F.col("t").isNull() | ~F.col("visible"), F.lit(True))
    in_turn = F.lag("role").over(w)
    return rows.withColumn("flaw", flaw | F.coalesce(in_turn == F.col("role"), F.lit(False))).withColumn("place", F.row_number().over(w)).withColumn("rank", rank)


def _segments(turns: DataFrame) -> DataFrame:
    edge = F.struct("t", "rank")
    return turns.groupBy("conversation_id", "slice").agg(
        F.count(F.lit(1)).alias("n"), F.max("flaw").alias("flaw"), F.min(edge)["rank"].alias("first"), F.max(edge)["rank"].alias("last")
    )


def judge_conversations(messages: DataFrame, known_ids: DataFrame | None = None, links: DataFrame | None = None) -> DataFrame:
    """``conversation_id, n_turns, kept``: one row per conversation, and per id of ``known_ids`` that has no message.

    Kept is a conversation that alternates user, assistant, user, assistant … in order of timestamp (the user first at
    equal times), with at least one pair and no user left without reply, every row having the role user or assistant,
    a timestamp and visible content. Roles are read without outer blanks and in lower case, system rows don't count,
    rows with equal role, content and timestamp count once, even under different ids. Rows without session id belong
    to the conversation their links lead to, if any; null ids in ``known_ids`` don't count. Empty tables give no rows.
    """
    return _fold(_segments(_turn_rows(assign_conversations(messages, links))), known_ids)


def _fold(segments: DataFrame, known_ids: DataFrame | None) -> DataFrame:
    if known_ids is not None:
        ids = known_ids.select(F.col(known_ids.columns[0]).alias("conversation_id")).filter("conversation_id is not null").distinct()
        segments = segments.unionByName(ids.select("conversation_id", F.lit(NO_ROWS).cast("bigint").alias("slice"), F.lit(0).cast("bigint").alias("n"), F.lit(False).alias("flaw"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last")))
    w = W.partitionBy("conversation_id").orderBy("slice")
    joint = F.coalesce(F.lag("last").over(w) == F.col("first"), F.lit(False))
    folded = segments.withColumn("flaw", F.col("flaw") | joint).groupBy("conversation_id").agg(
        F.sum("n").alias("n_turns"), F.max("flaw").alias("flaw"),
        F.min_by("first", F.when(F.col("n") > 0, F.col("slice"))).alias("first"), F.max_by("last", F.when(F.col("n") > 0, F.col("slice"))).alias("last"),
    )
    kept: Column = ~F.col("flaw") & F.coalesce(F.col("first") == 0, F.lit(False)) & F.coalesce(F.col("last") == 1, F.lit(False))
    return folded.select("conversation_id", "n_turns", kept.alias("kept"))


def rebuild_conversations(messages: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """The turns of the kept conversations: ``conversation_id, turn, role, content, timestamp`` (turn counts from 1)."""
    turns = _turn_rows(assign_conversations(messages, links))
    segments = _segments(turns)
    before = W.partitionBy("conversation_id").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = segments.select("conversation_id", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    kept = _fold(segments, None).filter("kept").select("conversation_id")
    rows = turns.join(offsets.join(kept, "conversation_id", "left_semi"), ["conversation_id", "slice"])
    return rows.select("conversation_id", (F.col("offset") + F.col("place")).alias("turn"), "role", "content", F.timestamp_micros("t").alias("timestamp"))
