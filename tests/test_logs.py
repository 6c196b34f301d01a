import random
from collections import deque
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from brindle.operators.audit import clean_events, export_lines, histogram, matching, newest_per, retained, rollup_counts, sort_order, tenant_stats, top_values
from brindle.operators.jobs import counts_by_state, first_requests, replay_attempts, work_order
from brindle.operators.metastore import history, page, session_rollup, user_stats
from brindle.operators.rag import NOTHING_FOUND, context, embed, token_estimate
from brindle.operators.ratelimit import limit_requests, offered_load
from brindle.streaming.events import append_log, deduplicated, fan_out, read_stream, run_to_table, windowed_counts

EVENT = "event_id string, timestamp timestamp_ntz, event_type string, result string, actor_id string, tenant_id string, resource_type string, resource_id string, action string, description string, tags array<string>, retention_days int, ingested_at timestamp_ntz"
T0 = datetime(2025, 1, 1)


@pytest.fixture(scope="module")
def events(spark):
    rows = []
    for n in range(25):
        rows.append((f"e{n:02}", T0 + timedelta(days=n), "auth.login" if n % 2 else "auth.logout", "success" if n % 2 else "failure", f"actor{n % 3}", "t", "doc", f"r{n % 2}", "do_it", f'say "{n}%"', ["a", "b"] if n % 5 == 0 else [], 10, T0))
    rows.append(rows[3][:-1] + (T0 + timedelta(days=99),))
    rows.append(("x", None, None, None, None, None, None, None, None, None, None, None, None))
    return spark.createDataFrame(rows, EVENT)


def ids(df):
    return sorted(r.event_id for r in df.collect())


def test_filters(events):
    e = clean_events(events)
    assert e.count() == 26 and len(ids(e.filter(matching()))) == 26
    assert ids(e.filter(matching(event_types=["auth.login"], results=["success"], start="2025-01-04", end="2025-01-06"))) == ["e03", "e05"]
    assert ids(e.filter(matching(text="SAY \"7%"))) == ["e07"] and len(ids(e.filter(matching(text="DO_IT")))) == 25 and ids(e.filter(matching(text="_%"))) == []
    assert ids(e.filter(matching(tags=["b", "z"]))) == ["e00", "e05", "e10", "e15", "e20"] and len(ids(e.filter(matching(actor_id="actor1", resource_id="r1")))) == 4


def test_pages(events):
    rows = clean_events(events).filter("timestamp is not null")
    sizes = []
    for n in (1, 2, 3, 4):
        got = page(rows, sort_order("nonsense"), n, 10).collect()
        sizes.append(len(got))
        if got:
            assert (got[0].total_count, got[0].total_pages, got[0].has_next, got[0].has_previous) == (25, 3, n < 3, n > 1)
    assert sizes == [10, 10, 5, 0]
    assert [r.event_id for r in page(rows, sort_order("event_type", False), 1, 2).collect()] == ["e01", "e03"]
    with pytest.raises(ValueError):
        page(rows, sort_order(), 0, 10)


def test_statistics(spark, events):
    s = tenant_stats(events, "2025-01-01").collect()
    assert [tuple(r) for r in s] == [("t", 25, 12, 13, 3, 2)]
    assert [tuple(r) for r in top_values(events, "actor_id", 2).collect()] == [("actor0", 9), ("actor1", 8)]
    roll = {(r.tenant_id, r.result, r.level): r.n for r in rollup_counts(events, ["tenant_id", "result"]).collect()}
    assert roll[(None, None, 3)] == 26 and roll[("t", None, 1)] == 25 and roll[("t", "success", 0)] == 12
    h = histogram(spark.createDataFrame([("a", 1.0), ("a", 7.0), ("a", None)], "k string, v double"), ["k"], "v", [1, 5, 10]).collect()
    assert sorted((r.le, r.n, r.total) for r in h) == [(1.0, 1, 3), (5.0, 1, 3), (10.0, 2, 3)]
    assert tenant_stats(events.limit(0), "2025-01-01").count() == 0


def test_retention_and_caps(events):
    assert ids(retained(events, "2025-01-31 00:00:00")) == ["e20", "e21", "e22", "e23", "e24", "x"]
    assert ids(newest_per(events, "tenant_id", 2)) == ["e23", "e24", "x"]


def test_export(events):
    line = export_lines(events, "csv").filter("event_id = 'e07'").first().line
    assert line.startswith('"e07","2025-01-08 00:00:00.000000","auth.login","success"') and line.endswith('"do_it","say ""7%"""')
    assert '"event_id":"e07"' in export_lines(events, "json").filter("event_id = 'e07'").first().line
    with pytest.raises(ValueError):
        export_lines(events, "xml")


def test_rate_limits(spark):
    r = random.Random(4)
    rows = [(n, r.choice(["a", "b", None]), r.randrange(500)) for n in range(300)] + [(999, "a", None)]
    df = spark.createDataFrame(rows, "id int, k string, t long")
    want, taken = {}, {}
    for i, k, t in sorted((x for x in rows if x[2] is not None), key=lambda x: (x[2], x[0])):
        d = taken.setdefault(k, deque())
        while d and d[0] < t - 20:
            d.popleft()
        want[i] = len(d) < 2
        if want[i]:
            d.append(t)
    assert {x.id: x.accepted for x in limit_requests(df, "k", "t", "id", 20, 2).collect()} == want
    load = {x.id: x.offered for x in offered_load(df.filter("k = 'a' and t is not null"), "k", "t", 20).collect()}
    mine = [(i, t) for i, k, t in rows if k == "a" and t is not None]
    assert load == {i: sum(t - 20 <= u <= t for _, u in mine) for i, t in mine}


def test_jobs(spark):
    df = spark.createDataFrame([("k1", 5, 1), ("k1", 2, 9), ("k2", 3, -4), (None, 4, 0), (None, 1, None)], "request_key string, seq int, priority int")
    first = first_requests(df, "request_key", "seq")
    assert sorted(r.seq for r in first.collect()) == [1, 2, 3, 4]
    assert [r.seq for r in df.orderBy(*work_order(df, "priority", "seq")).collect()] == [2, 5, 1, 3, 4]
    states = spark.createDataFrame([("a",), ("a",), ("b",), (None,), ("zz",)], "s string")
    assert tuple(counts_by_state(states, "s", ["a", "b"]).first()) == (5, 2, 1, 2) and tuple(counts_by_state(states.limit(0), "s", ["a", "b"]).first()) == (0, 0, 0, 0)
    log = [("j", n, op) for n, op in enumerate(["start", "fail", "start", "fail"])] + [("k", 1, "start"), ("k", 2, "complete"), ("m", 1, "start"), ("n", 1, "odd"), (None, 1, "start"), ("c", 1, "start"), ("c", 2, "cancel")]
    out = {r.job_id: (r.attempts, r.state) for r in replay_attempts(spark.createDataFrame(log, "job_id string, seq int, op string"), 2).collect()}
    assert out == {"j": (2, "failed"), "k": (1, "completed"), "m": (1, "processing"), "c": (1, "cancelled")}


def test_metadata_tables(spark):
    sessions = spark.createDataFrame([("s1", "u1"), ("s1", "u1"), ("s2", "u1"), ("s3", None), (None, "u9")], "id string, user_id string")
    messages = spark.createDataFrame([("m1", "s1", T0), ("m1", "s1", T0), ("m2", "s1", T0 + timedelta(hours=1)), ("m3", "gone", None), ("m4", None, T0)], "id string, session_id string, timestamp timestamp_ntz")
    got = {r.session_id: (r.n_messages, r.known) for r in session_rollup(sessions, messages).collect()}
    assert got == {"s1": (2, True), "s2": (0, True), "s3": (0, True), "gone": (1, False)}
    docs = spark.createDataFrame([(1, "u1"), (2, "u2"), (3, None)], "doc_id long, user_id string")
    assert sorted(tuple(r) for r in user_stats(sessions, messages, docs).collect()) == [("u1", 2, 2, 1), ("u2", 0, 0, 1)]
    assert [(r.id, r.place) for r in history(messages, 1).collect()] == [("m2", 1)] and [r.id for r in history(messages, 1, newest=False).collect()] == ["m1"]


def test_contexts(spark):
    hits = spark.createDataFrame([("q", 2, "b"), ("q", 1, "a"), ("q", 3, None), ("z", 1, None)], "query_id string, rank int, text string")
    assert {r.query_id: r.context for r in context(hits, "query_id").collect()} == {"q": "[Source 1]: a\n\n[Source 2]: b", "z": NOTHING_FOUND}
    df = spark.createDataFrame([("a b c", None), (None, None)], "x string, y string")
    assert [r.n for r in df.select(token_estimate(F.col("x"), F.col("y")).alias("n")).collect()] == [3, 0]
    v = [r.embedding for r in embed(spark.createDataFrame([("same",), ("same",), ("",), (None,)], "t string"), "t", 8).collect()]
    assert v[0] == v[1] and abs(sum(x * x for x in v[0]) - 1) < 1e-6 and v[2] == [0.0] * 8 and v[3] is None


def test_streams(spark, events, tmp_path):
    path = str(tmp_path / "in")
    events.repartition(3).write.parquet(path)
    stream = lambda: read_stream(spark, path, events.schema, 1)
    out = run_to_table(deduplicated(stream(), "event_id", "timestamp", "400 days").select("event_id"), str(tmp_path / "a"))
    assert ids(out) == ids(clean_events(events).filter("timestamp is not null"))
    counted = run_to_table(windowed_counts(stream(), "timestamp", ["result"], "10 days", lateness="400 days"), str(tmp_path / "b"), "complete")
    assert sum(r.n for r in counted.collect()) == 26
    append_log(stream(), str(tmp_path / "log"), str(tmp_path / "ck"))
    append_log(stream(), str(tmp_path / "log"), str(tmp_path / "ck"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 27
    seen = []
    fan_out(stream(), [lambda b, n: seen.append(b.count()), lambda b, n: b.write.mode("append").parquet(str(tmp_path / "copy"))], str(tmp_path / "ck2"))
    assert sum(seen) == 27 and spark.read.parquet(str(tmp_path / "copy")).count() == 27
