import base64
import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from brindle.operators.access import chain_is_valid, expired, first_policies, merged_maps, united, visible_to, within
from brindle.operators.chat import EmbeddingProvider, answer_events, answered, by_model, document_rows, embed_by, history_before, joined_answers, page_chunks, result_rows, running_summaries, starter_prompt
from brindle.operators.jobs import dispatch, replay_jobs
from brindle.operators.ratelimit import offered_load
from brindle.operators.vectors import cosine_of_shared_length, nearest
from brindle.sources.fetch import CachedToken, HttpFetcher, attempt_events, copy_files
from brindle.sources.files import default_registry, download_tasks, json_rows, parse_files, uploads
from brindle.streaming.events import event_stream_lines, fan_out, json_log, log_sink, no_sink

T = datetime(2025, 1, 1)


def test_chunks_are_numbered_through_a_document(spark):
    rows = [("d", 1, "x" * 25, "1"), ("d", 2, None, "2"), ("d", 3, "", "3"), ("d", 4, "y" * 5, "4"), (None, 1, "z", None)]
    out = page_chunks(spark.createDataFrame(rows, "doc string, n int, text string, page string"), "doc", ["n"], "text", F.col("page"), 10, 2)
    got = [(r.doc, r.chunk_index, r.page, r.text, r.span_start, r.span_end) for r in out.orderBy("doc", "chunk_index").collect()]
    assert got == [(None, 0, None, "z", 0, 1), ("d", 0, "1", "x" * 10, 0, 10), ("d", 1, "1", "x" * 10, 8, 18), ("d", 2, "1", "x" * 9, 16, 25), ("d", 3, "4", "y" * 5, 0, 5)]
    assert out.first().metadata["chunk_size"] == "10" and {r.doc: r.n_chunks for r in document_rows(out, "doc").collect()} == {"d": 4, None: 1}
    assert page_chunks(spark.createDataFrame([], "doc string, n int, text string"), "doc", ["n"], "text", F.lit(None)).count() == 0


def test_providers(spark):
    p = EmbeddingProvider("len", 2, lambda texts: [[float(len(t)), float(len(texts))] for t in texts], batch=2)
    df = spark.createDataFrame([(n, "x" * n if n else None) for n in range(6)], "n int, text string").coalesce(1)
    assert [r.embedding for r in embed_by(df, "text", p).orderBy("n").collect()] == [None, [1.0, 2.0], [2.0, 2.0], [3.0, 2.0], [4.0, 2.0], [5.0, 1.0]]
    assert p.healthy() and not EmbeddingProvider("bad", 3, p.vectors).healthy() and not EmbeddingProvider("dead", 3, lambda t: 1 / 0).healthy()
    with pytest.raises(Exception):
        embed_by(df, "text", EmbeddingProvider("bad", 3, p.vectors)).collect()
    assert [r[0] for r in spark.createDataFrame([("a",), (None,), ("b",)], "m string").select(by_model(F.col("m"), {"a": 2.0}, 0.1)).collect()] == [2.0, 0.1, 0.1]


def test_a_search_stays_with_its_user(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0], "u"), ("b", [1.0, 0.0], "w"), ("c", [0.0, 1.0], "u"), ("d", [1.0, 0.0], None)], "vec_id string, embedding array<float>, user string")
    asked = spark.createDataFrame([("q", [1.0, 0.0], "u"), ("r", [1.0, 0.0], "nobody"), ("s", [1.0, 0.0], None)], "vec_id string, embedding array<float>, user string")
    assert [(r.query_id, r.id) for r in nearest(rows, asked, 5, within="user").orderBy("rank").collect()] == [("q", "a"), ("q", "c")]
    zero = spark.createDataFrame([(f"v{n:03}", [1.0, float(n)], "u") for n in range(300)], "vec_id string, embedding array<float>, user string")
    q = spark.createDataFrame([("q", [0.0, 0.0], "u")], "vec_id string, embedding array<float>, user string")
    assert [r.id for r in nearest(zero, q, 3).orderBy("rank").collect()] == ["v000", "v001", "v002"]
    out = result_rows(rows.withColumn("text", F.lit("t")), F.col("user"), F.col("text"), include_text=False).collect()
    assert {r.document_id for r in out} == {"u", "w", "unknown"} and {r.text for r in out} == {None}


def test_history_is_what_was_said_before(spark):
    said = [(f"m{n}", "s", "user" if n % 2 else "assistant", f"c{n}", T + timedelta(minutes=n)) for n in range(9)] + [("m1", "s", "user", "c1", T + timedelta(minutes=1)), ("x", None, "user", "c", T), ("y", "s", "user", "c", None)]
    asked = [("a", "s", T + timedelta(minutes=8)), ("b", "s", T), ("c", None, T), ("d", "other", T), ("e", "s", None), ("a", "s", T + timedelta(minutes=8))]
    out = history_before(spark.createDataFrame(asked, "request_id string, session_id string, requested_at timestamp_ntz"), spark.createDataFrame(said, "id string, session_id string, role string, content string, timestamp timestamp_ntz"))
    got = {r.request_id: [m.content for m in r.history] for r in out.collect()}
    assert got == {"a": [f"c{n}" for n in range(2, 8)], "b": [], "c": [], "d": [], "e": []} and out.count() == 5


def test_answers_errors_and_events(spark):
    def model(messages):
        if messages[-1]["content"] == "bad":
            raise ValueError("no")
        return f"You said  {messages[-1]['content']}"

    df = spark.createDataFrame([("a", [("user", "hi")]), ("b", [("user", "bad")])], "id string, messages array<struct<role: string, content: string>>")
    out = answered(df, "messages", model)
    assert {r.id: (r.answer, r.error) for r in out.collect()} == {"a": ("You said  hi", None), "b": (None, "ValueError: no")}
    events = answer_events(out, "id", "answer", "error")
    assert [r.kind for r in events.filter("id = 'b'").orderBy("seq").collect()] == ["metadata", "error"]
    assert [tuple(r) for r in joined_answers(events, "id").collect()] == [("a", "You said  hi")]
    line = events.filter("id = 'a' and seq = 1").select(event_stream_lines(F.col("kind"), F.col("data")).alias("x")).first().x
    assert line == 'data: {"event":"content","data":"You"}\n\n'
    assert spark.range(1).select(starter_prompt(F.array(F.lit("a"), F.lit("b")), F.lit("")).alias("x")).first().x == "a\n\n---\nb"


def test_summaries(spark):
    rows = [(f"m{n:02}", "s", "user" if n % 2 == 0 else "assistant", T + timedelta(minutes=n)) for n in range(18)]
    (r,) = running_summaries(spark.createDataFrame(rows, "id string, session_id string, role string, timestamp timestamp_ntz")).collect()
    assert (r.n_turns, r.n_summaries, r.summarised, r.kept) == (9, 2, 12, 6)


def test_jobs_are_guarded(spark):
    log = [("a", 1, "submit"), ("a", 2, "complete"), ("a", 3, "start"), ("a", 4, "fail"), ("a", 5, "start"), ("a", 6, "fail"), ("a", 7, "start"), ("b", 1, "start"), ("c", 1, "submit"), ("c", 2, "start"), ("c", 3, "complete"), ("c", 4, "cancel"), ("d", 1, "submit"), ("d", 2, "start"), ("d", 9, "fail"), ("e", 1, "odd"), (None, 1, "submit")]
    out = {r.job_id: (r.state, r.attempts, r.n_refused, r.queue_seq) for r in replay_jobs(spark.createDataFrame(log, "job_id string, seq int, op string"), 2).collect()}
    assert out == {"a": ("failed", 2, 2, None), "b": ("none", 0, 1, None), "c": ("cancelled", 1, 0, None), "d": ("queued", 1, 0, 9)}
    assert replay_jobs(spark.createDataFrame([], "job_id string, seq int, op string")).count() == 0
    jobs = spark.createDataFrame([("a", "up", "x"), ("b", "boom", "x"), ("c", "what", None)], "job_id string, type string, payload string")
    done = {r.job_id: (r.op, r.message) for r in dispatch(jobs, {"up": str.upper, "boom": lambda p: {}[p]}).collect()}
    assert done == {"a": ("complete", "X"), "b": ("fail", "KeyError: 'x'"), "c": ("fail", "ValueError: unknown type what")}


def test_scopes_chains_maps(spark):
    arr = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    null = F.lit(None).cast("array<string>")
    one = spark.range(1).select(
        within(arr("a"), arr("a", "b")).alias("a"), within(arr("c"), null).alias("b"), within(null, null).alias("c"), united(arr("b", "a"), null, arr("a")).alias("d"), chain_is_valid(arr("a", "b", "a"), 5).alias("e"),
        chain_is_valid(arr("a", "b"), 1).alias("f"), chain_is_valid(null, 1).alias("g"), merged_maps(F.create_map(F.lit("k"), F.lit("1"), F.lit("l"), F.lit("2")), F.create_map(F.lit("k"), F.lit("3"))).alias("h"),
        expired(F.lit(5), F.lit(4)).alias("i"), expired(F.lit(5), F.lit(None).cast("int")).alias("j"), cosine_of_shared_length(F.array(F.lit(1.0), F.lit(0.0), F.lit(9.0)), F.array(F.lit(2.0), F.lit(0.0))).alias("k"),
    ).first()
    assert tuple(one) == (True, False, True, ["a", "b"], False, False, True, {"k": "3", "l": "2"}, True, False, 1.0)
    rows = spark.createDataFrame([("t",), ("u",), (None,)], "tenant string")
    assert (visible_to(rows, "tenant", "t").count(), visible_to(rows, "tenant", None).count(), visible_to(rows, "tenant", None, True).count()) == (1, 0, 3)
    with pytest.raises(ValueError):
        first_policies(rows, spark.createDataFrame([("t", n, None, None) for n in range(3)], "tenant_id string, policy_seq int, source_scopes array<string>, target_scopes array<string>"), 2)


def test_offered_load_over_slices(spark):
    rows = [("k", t) for t in (0, 5, 9, 10, 11, 19, 20, 21, 40, 40)] + [("l", 7), ("k", None)]
    out = sorted((r.k, r.t, r.offered) for r in offered_load(spark.createDataFrame(rows, "k string, t long"), "k", "t", 10).collect() if r.t is not None)
    assert out == sorted((k, t, sum(k == j and u is not None and t - 10 <= u <= t for j, u in rows)) for k, t in rows if t is not None)


def test_uploads_configs_and_parsers(spark, tmp_path):
    rows = [("a.json", base64.b64encode(b'["x", {"b": 1, "a": 2}]').decode()), ("b.txt", "§"), (None, "")]
    good, bad = uploads(spark.createDataFrame(rows, "name string, data string"), "name", "data")
    spans, errors = parse_files(good)
    assert [r.text for r in spans.orderBy("ordinal").collect()] == ["x", '{"a": 2, "b": 1}'] and errors.count() == 0
    assert {(r.path, r.error) for r in bad.collect()} == {("b.txt", "not base 64"), (None, "no name")}
    assert all(default_registry().health().values()) and json_rows(b'"one"') == [("json", None, None, "one")]
    (tmp_path / "c.json").write_text(json.dumps([{"id": "1", "type": "HTTP", "source": "http://a"}, {"type": "gopher", "source": "g"}, {"type": "local", "source": "/x"}]))
    tasks, unknown = download_tasks(spark, str(tmp_path / "c.json"))
    assert sorted(r.address for r in tasks.collect()) == ["/x", "http://a"] and [r.source_type for r in unknown.collect()] == ["gopher"]


def test_requests_tokens_and_copies(spark, tmp_path):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    seen = []

    class Handler(BaseHTTPRequestHandler):
        def answer(self):
            seen.append((self.command, self.path, self.headers.get("Authorization"), self.headers.get("X-A")))
            busy = len(seen) in (1, 3)
            self.send_response(503 if busy else 200)
            self.end_headers()
            self.wfile.write(b"ok")

        do_GET = do_POST = answer

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/a"
    try:
        now = [0.0]
        token = CachedToken(lambda: (f"t{now[0]}", 100.0), lambda: now[0])
        assert HttpFetcher(headers=(("X-A", "1"),), params=(("q", "a b"),), token=token)(url) == b"ok"
        assert seen[1] == ("GET", "/a?q=a+b", "Bearer t0.0", "1")
        with pytest.raises(OSError):
            HttpFetcher(method="POST", body=b"x")(url)
        now[0] = 39.0
        assert token() == "t0.0"
        now[0] = 40.0
        assert token() == "t40.0"
    finally:
        server.shutdown()
    (tmp_path / "f").write_text("x")
    a, b = str(tmp_path / "f"), str(tmp_path / "g")
    assert [e for *_, e in copy_files(spark, [(a, b), (a, b)])] == [None, "the target exists"] and (tmp_path / "g").read_text() == "x"
    assert copy_files(spark, [(a, str(tmp_path / "h"))], move=True)[0][2] is None and not (tmp_path / "f").exists()
    fetched = spark.createDataFrame([("a", True, 2), ("b", False, 2), ("c", False, 0)], "source_id string, success boolean, attempts int")
    assert sorted((r.source_id, r.attempt, r.event_type) for r in attempt_events(fetched).collect()) == [("a", 1, "download.retry"), ("a", 2, "download.success"), ("b", 1, "download.retry"), ("b", 2, "download.failure")]


def test_a_failing_sink_stops_no_other(spark, tmp_path):
    spark.createDataFrame([(1,), (2,)], "n int").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("n int").parquet(str(tmp_path / "in"))
    got, failures = [], []
    fan_out(stream, [lambda b, n: 1 / 0, no_sink, log_sink("brindle.test"), lambda b, n: got.append(b.count())], str(tmp_path / "c"), failures)
    assert got == [2] and [(b, s) for b, s, _ in failures] == [(0, 0)]
    json_log(stream, str(tmp_path / "out"), str(tmp_path / "c2"), most_rows=1)
    assert spark.read.json(str(tmp_path / "out")).count() == 2 and len(list((tmp_path / "out").glob("*.json"))) == 2
