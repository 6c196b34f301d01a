import random

from pyspark.sql import functions as F

from brindle.operators.sessionize import audit_sessions, sessionize
from brindle.streaming.sessions import stream_sessions

GAP = 1_800_000_000
SCHEMA = "k string, t long, id string, kind string"


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    out = sessionize(df, F.col("k"), F.col("t"), F.col("id"), F.col("kind"), **kw).collect()
    return sorted((r.key, r.start_us, r.end_us, r.n_events, tuple(sorted(r.by_type.items()))) for r in out)


def plain(rows, gap=GAP):
    groups, seen = {}, set()
    for k, t, i, kind in rows:
        if k is None or t is None or (i is not None and (k, t, i) in seen):
            continue
        seen.add((k, t, i))
        groups.setdefault(k, []).append((t, kind or "unknown"))
    out = []
    for k, ev in groups.items():
        ev.sort()
        now = []
        for e in [*ev, (None, None)]:
            if now and (e[0] is None or e[0] - now[-1][0] > gap):
                kinds = [x[1] for x in now]
                out.append((k, now[0][0], now[-1][0], len(now), tuple(sorted({c: kinds.count(c) for c in kinds}.items()))))
                now = []
            now.append(e)
    return sorted(out)


def test_against_a_loop_with_repeats_nulls_and_ties(spark):
    r = random.Random(3)
    rows = []
    for n in range(600):
        rows.append((r.choice(["a", "a", "b", None]), r.choice([None, r.randrange(40) * GAP // 3]), r.choice([None, f"e{n}"]), r.choice(["x", "y", None])))
    rows += [x for x in rows if r.random() < 0.2 and x[2]]
    r.shuffle(rows)
    assert run(spark, rows) == plain(rows)


def test_exact_gap_and_slice_borders(spark):
    rows = [("a", n * GAP, f"{n}", "x") for n in range(7)] + [("b", 0, "1", "x"), ("b", GAP + 1, "2", "x")]
    assert run(spark, rows) == plain(rows)
    assert run(spark, rows, slice_us=GAP // 7) == plain(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_audit_spellings_and_either_time(spark):
    df = spark.createDataFrame(
        [(" Bob", None, 60.0004, "1", "Login", "x"), ("bob\t", None, float("nan"), "2", "login", "x"), ("BOB", None, 61.0, "3", "login ", "x"), ("  ", None, 1.0, "4", "login", "x")],
        "actor_id string, timestamp timestamp_ntz, timestamp_unix double, event_id string, event_type string, key string",
    )
    (r,) = audit_sessions(df).collect()
    assert (r.actor_id, r.start_us, r.end_us, r.n_events, r.by_type) == ("bob", 60_000_000, 61_000_000, 2, {"login": 2})


def test_stream_gives_the_same_sessions(spark, tmp_path):
    rows = [("a", n * 60_000_000, f"{n}", "x") for n in (1, 2, 3, 100, 101)] + [("a", 60_000_000, "1", "x")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_micros("t"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    late = spark.createDataFrame([("z", 9_000_000_000_000, "z", "x")], SCHEMA).withColumn("ts", F.timestamp_micros("t"))
    late.write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_sessions(stream, F.col("k"), F.col("ts"), F.col("id")).writeStream.format("memory").queryName("found").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    out = spark.sql("select n_events from found where key = 'a' order by start_time").collect()
    assert [r.n_events for r in out] == [3, 2]


def test_stream_keeps_a_pause_of_exactly_the_gap(spark, tmp_path):
    rows = [("a", "2024-01-01 10:00:00", "1"), ("a", "2024-01-01 10:30:00", "2"), ("b", "2024-01-01 10:00:00", "3"), ("b", "2024-01-01 10:30:00.000001", "4"), ("z", "2024-01-03 00:00:00", "5")]
    events = spark.createDataFrame(rows, "k string, ts string, id string").withColumn("ts", F.to_timestamp("ts"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = stream_sessions(stream, F.col("k"), F.col("ts"), F.col("id")).writeStream.format("memory").queryName("exact_gap").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.key, r.n_events) for r in spark.table("exact_gap").collect()) == [("a", 2), ("b", 1), ("b", 1)]


def test_a_late_event_bridges_two_sessions_and_one_too_late_does_not(spark, tmp_path):
    minute = lambda n: f"2024-01-01 {10 + n // 60:02}:{n % 60:02}:00"
    # each batch a file: two sessions 50 minutes apart, the event between them 40 minutes late, then one after the watermark
    batches = [[("a", minute(0), "1"), ("b", minute(0), "2")], [("a", minute(50), "3"), ("b", minute(50), "4")], [("a", minute(25), "5"), ("a", minute(0), "1")], [("z", minute(400), "6")], [("z", minute(401), "9")], [("b", minute(25), "7")], [("z", minute(800), "8")]]
    for n, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "k string, ts string, id string").withColumn("ts", F.to_timestamp("ts"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/n={n}"))
    stream = spark.readStream.schema("k string, ts timestamp, id string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_sessions(stream, F.col("k"), F.col("ts"), F.col("id"), lateness="1 hour").writeStream.format("memory").queryName("bridge").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.key, r.n_events) for r in spark.table("bridge").collect() if r.key != "z") == [("a", 3), ("b", 1), ("b", 1)]


def test_rows_without_id_keep_their_types(spark):
    rows = [("a", 5, None, "x"), ("a", 5, None, "y"), ("a", 5, None, "y"), ("a", 5, "e", "y"), ("a", 5, "e", "y")]
    assert run(spark, rows) == plain(rows) == [("a", 5, 5, 4, (("x", 1), ("y", 3)))]
