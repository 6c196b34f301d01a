import random

from pyspark.sql import functions as F

from brindle.llm.components import connected_components
from brindle.llm.conversations import judge_conversations, links_in_metadata, rebuild_conversations

SCHEMA = "id string, session_id string, role string, content string, timestamp timestamp_ntz, metadata string, turn int"


def components(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def test_components_like_union_find(spark):
    r = random.Random(5)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(0, n) for n in range(400, 460)] + [(n, n + 1) for n in range(600, 650)] + [(7, 7), (7, 7)]
    df = spark.createDataFrame([*pairs, (None, 3)], "a long, b long")
    assert {x.node: x.component for x in connected_components(df).collect()} == components(pairs)
    assert connected_components(df.limit(0)).count() == 0


def messages(spark, rows):
    from datetime import datetime, timedelta

    at = lambda n: None if n is None else datetime(2025, 1, 1) + timedelta(hours=n)
    return spark.createDataFrame([(i, s, role, text, at(t), meta, 0) for i, s, role, text, t, meta in rows], SCHEMA)


def test_kept_and_left_out(spark):
    rows = [
        ("1", "fine", " User", "hi", 0, None), ("2", "fine", "assistant", "yes", 0, None), ("3", "fine", "user", "and", 50, None), ("4", "fine", "ASSISTANT ", "ok", 90, None),
        ("5", "fine", "ASSISTANT ", "ok", 90, None), ("5b", "fine", "system", None, None, None),
        ("6", "no_reply", "user", "hi", 0, None), ("7", "blank", "user", " ​﻿　", 0, None), ("8", "blank", "assistant", "x", 1, None),
        ("9", "tool", "user", "x", 0, None), ("10", "tool", "assistant", "x", 1, None), ("11", "tool", "tool", "x", 2, None),
        ("12", "untimed", "user", "x", None, None), ("13", "untimed", "assistant", "x", 1, None), ("14", "twice", "user", "x", 0, None), ("15", "twice", "user", "y", 30, None), ("16", "twice", "assistant", "x", 31, None),
        ("17", "norole", "user", "x", 0, None), ("18", "norole", "assistant", "x", 1, None), ("19", "norole", None, "x", 2, None), ("20", "only_system", "system", "x", 2, None), ("21", None, "user", "x", 2, None),
    ]
    known = spark.createDataFrame([("empty",), ("fine",), (None,), ("only_system",)], "id string")
    out = {r.conversation_id: r.kept for r in judge_conversations(messages(spark, rows), known).collect()}
    assert {k for k, v in out.items() if v} == {"fine"}
    assert set(out) == {"fine", "no_reply", "blank", "tool", "untimed", "twice", "norole", "only_system", "empty"}
    turns = rebuild_conversations(messages(spark, rows)).orderBy("turn").collect()
    assert [(r.turn, r.role, r.content) for r in turns] == [(1, "user", "hi"), (2, "assistant", "yes"), (3, "user", "and"), (4, "assistant", "ok")]


def test_links_give_messages_their_conversation(spark):
    rows = [
        ("m1", "s", "user", "a", 0, None), ("m2", None, "assistant", "b", 1, '{"reply_to": "m1"}'), ("m3", None, "user", "c", 2, '{"quoted_id": "m2"}'), ("m4", None, "assistant", "d", 3, '{"reply_to": "m3"}'),
        ("n1", None, "user", "a", 0, "not json reply_to"), ("n2", None, "assistant", "b", 1, '{"reply_to": "n1"}'),
    ]
    df = messages(spark, rows)
    out = {r.conversation_id: (r.n_turns, r.kept) for r in judge_conversations(df, None, links_in_metadata(df)).collect()}
    assert out == {"s": (4, True), "conversation_n1": (2, True)}


def test_empty(spark):
    df = messages(spark, [("1", "a", "user", "x", 0, None)]).filter(F.lit(False))
    assert judge_conversations(df, df.select("session_id"), links_in_metadata(df)).count() == 0
    assert rebuild_conversations(df).count() == 0
