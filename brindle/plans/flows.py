"""Queries on ingest, search, chat, token logs and job logs, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions.files import base64url, made_id, url_encoded
from brindle.operators.access import bounded_log, chain_is_valid, event_totals, exchange_stats, first_policies, merged_maps, not_under, offset_page, request_kind, storage_stats, united, within
from brindle.operators.audit import clean_events, matching, sort_order
from brindle.operators.chat import (
    OTHER_PRICE, SYSTEM, answer_events, by_model, chat_cost, chat_messages, document_rows, embedding_totals, heading_sections, history_before, joined_answers, page_chunks, result_rows, running_summaries,
)
from brindle.operators.chunking import count_windows
from brindle.operators.jobs import replay_jobs
from brindle.operators.metastore import latest_rows
from brindle.operators.rag import NOTHING_FOUND, prompt
from brindle.operators.vectors import cosine_of_shared_length, nearest
from brindle.plans.logs import _E, END, START
from brindle.plans.stores import _COS, _M, _V, _words
from brindle.sources.tables import micros, table
from brindle.streaming.events import metrics_text


def _page_chunks(spark, d):
    rows = latest_rows(table(spark, d, "parsed_chunks"), "chunk_id").filter("source is not null")
    return page_chunks(rows, "source", ["ordinal", "chunk_id"], "text", F.col("metadata")["page"])


def ingest_chunks(spark, d):
    return _page_chunks(spark, d).select("source", "chunk_index", "page", "text", "span_start", "span_end", F.col("metadata")["strategy"].alias("strategy"))


def ingest_documents(spark, d):
    return document_rows(_page_chunks(spark, d), "source")


def embed_cost(spark, d):
    return embedding_totals(latest_rows(table(spark, d, "chat_requests"), "request_id"), "model", "message")


def search_own(spark, d):
    """Each query sees the vectors of its own label only, as a user's search sees that user's."""
    e = table(spark, d, "embeddings")
    return nearest(e, e.filter("vec_id % 100 = 0"), 5, within="label")


def search_results(spark, d):
    own = latest_rows(table(spark, d, "vector_documents"), "id").select("id", "text", "metadata")
    hits = table(spark, d, "query_results").filter("query_id is not null and score is not null").select("query_id", "id", "rank_no").distinct()
    out = result_rows(hits.join(own, "id", "left"), F.col("metadata")["document_id"], F.col("text"))
    return out.select("query_id", "id", F.col("rank_no").cast("bigint").alias("rank_no"), "document_id", "text")


def _told(history):
    return F.array_join(F.transform(history, lambda m: F.concat(F.coalesce(m["role"], F.lit("")), F.lit(": "), F.coalesce(m["content"], F.lit("")))), "\n")


def chat_history(spark, d):
    h = history_before(table(spark, d, "chat_requests"), table(spark, d, "messages"))
    return h.select("request_id", F.size("history").cast("bigint").alias("n"), _told(F.col("history")).alias("history"))


def chat_prompts(spark, d):
    requests = latest_rows(table(spark, d, "chat_requests"), "request_id")
    both = requests.join(history_before(requests, table(spark, d, "messages")), "request_id")
    asked = prompt(F.lit(NOTHING_FOUND), F.coalesce("message", F.lit("")))
    return both.select("request_id", _told(chat_messages(F.col("system_prompt"), F.col("history"), asked)).alias("prompt"))


def _answers(spark, d):
    return latest_rows(table(spark, d, "messages"), "id").filter("lower(trim(role)) = 'assistant' and content is not null")


def rag_cost(spark, d):
    tokens, cost = chat_cost(F.lit("the question asked"), F.col("content"), F.lit(NOTHING_FOUND))
    return _answers(spark, d).select("id", tokens.alias("n_tokens"), F.round(cost, 12).alias("cost"))


def chat_events(spark, d):
    return answer_events(_answers(spark, d), "id", "content")


def chat_rejoined(spark, d):
    return joined_answers(chat_events(spark, d), "id")


def session_summaries(spark, d):
    return running_summaries(table(spark, d, "messages"))


def sections_by_heading(spark, d):
    rows = latest_rows(table(spark, d, "parsed_chunks"), "chunk_id").filter("source is not null")
    return heading_sections(rows, "source", ["ordinal", "chunk_id"], "text", F.col("metadata")["type"] == "heading")


def chunk_word_estimate(spark, d):
    from brindle.functions.text import word_count

    return table(spark, d, "documents").select("doc_id", count_windows(word_count("text"), 512, 50).alias("n_chunks"))


def vec_truncated_cosine(spark, d):
    """Every vector against the one of the smallest id, over the numbers that both have."""
    v = latest_rows(table(spark, d, "vector_documents"), "id").filter("embedding is not null").select("id", F.transform("embedding", lambda x: F.when(~F.isnan(x) & (F.abs(x) < 1e9), x)).alias("v"))
    v = v.filter(F.forall("v", lambda x: x.isNotNull()))
    one = v.agg(F.min_by("v", "id").alias("w"))
    return v.crossJoin(F.broadcast(one)).select("id", F.round(cosine_of_shared_length(F.col("v"), F.col("w")), 6).alias("cosine"))


# logs


def dl_audit_filter(spark, d):
    where = matching(tenant_id="tenant_57", start=START, end=END) & (F.col("result") == "success") & (F.col("data_classification") == "restricted")
    rows = clean_events(table(spark, d, "audit_events").filter(where)).select("event_id", "event_type", "resource_id", "timestamp")
    return offset_page(rows, sort_order("timestamp"), 10, 20).withColumn("timestamp", micros("timestamp"))


def dl_audit_stats(spark, d):
    return event_totals(table(spark, d, "audit_events"), F.col("status_code"), F.col("retention_days"))


def exchange_totals(spark, d):
    return exchange_stats(table(spark, d, "audit_events"))


def exchange_newest(spark, d):
    rows = clean_events(table(spark, d, "audit_events").filter(F.contains(F.lower("event_type"), F.lit("token_")) & (F.col("actor_type") == "user")))
    return rows.select("event_id", "actor_id", "timestamp").orderBy(*sort_order("timestamp")).limit(100).withColumn("timestamp", micros("timestamp"))


def log_storage(spark, d):
    return storage_stats(table(spark, d, "audit_events"), 10_000)


def log_bounded(spark, d):
    return bounded_log(table(spark, d, "audit_events"), 2_000)


def tenant_view(spark, d):
    from brindle.operators.access import visible_to

    return clean_events(visible_to(table(spark, d, "audit_events"), "tenant_id", "tenant_57")).select("event_id", "tenant_id")


def scope_checks(spark, d):
    e = clean_events(table(spark, d, "audit_events")).select("event_id", "tags", F.array("actor_type", "resource_type", "action").alias("chain"))
    return e.select("event_id", within(F.col("tags"), F.array(F.lit("secret"), F.lit("prod"))).alias("allowed"), F.array_join(united(F.col("tags"), F.array(F.lit("read"))), ",").alias("scopes"), chain_is_valid(F.array_compact("chain"), 3).alias("chain_valid"))


POLICIES = [(1, "tenant_57", ["secret"], ["auth", "secret"]), (2, "tenant_57", [], ["auth"]), (3, "tenant_57", ["login"], []), (4, "tenant_01", None, None)]


def policy_matches(spark, d):
    rules = spark.createDataFrame(POLICIES, "policy_seq bigint, tenant_id string, source_scopes array<string>, target_scopes array<string>")
    e = clean_events(table(spark, d, "audit_events")).select(F.col("event_id").alias("request_id"), "tenant_id", F.col("tags").alias("scopes"), F.when(F.col("resource_type").isNotNull(), F.array("resource_type")).alias("targets"))
    return first_policies(e, rules)


OPEN_PATHS = ["/res-0001", "/res-0002"]


def request_kinds(spark, d):
    e = clean_events(table(spark, d, "audit_events"))
    path = F.concat(F.lit("/"), F.coalesce("resource_id", F.lit("")), F.lit("/"), F.coalesce("action", F.lit("")))
    return e.filter(not_under(path, OPEN_PATHS)).select("event_id", request_kind(path, F.upper("action"), F.col("status_code")).alias("kind"))


def merged_metadata(spark, d):
    e = clean_events(table(spark, d, "audit_events"))
    m = merged_maps(F.col("metadata"), F.create_map(F.lit("client"), F.lit("batch"), F.lit("tenant"), F.coalesce("tenant_id", F.lit(""))))
    return e.select("event_id", F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",").alias("metadata"))


def ids_and_codes(spark, d):
    u = table(spark, d, "documents")
    return u.select("doc_id", made_id("session", F.col("name")).alias("session_id"), base64url(F.col("name")).alias("code"), url_encoded(F.col("name")).alias("encoded"))


def metrics_lines(spark, d):
    counts = clean_events(table(spark, d, "audit_events")).groupBy("event_type", "result").agg(F.count(F.lit(1)).alias("n"))
    return metrics_text(counts, "requests_total", ["event_type", "result"], "n")


OPS = ["start", "start", "complete", "fail", "cancel", "start"]


def queue_replay(spark, d):
    """Jobs of orders, their log by lines: submitted at 0, then what the part's number stands for."""
    op = F.element_at(F.array(*map(F.lit, OPS)), (F.col("l_partkey") % len(OPS) + 1).cast("int"))
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").cast("bigint").alias("seq")).agg(F.min(op).alias("op"))
    first = lines.select("job_id", F.lit(0).cast("bigint").alias("seq"), F.lit("submit").alias("op")).distinct()
    return replay_jobs(lines.union(first), 2)


def queue_retry_order(spark, d):
    """What waits, in order of work: those put back stand behind, whatever their priority."""
    return queue_replay(spark, d).filter("state = 'queued'").orderBy("queue_seq", "job_id").select("job_id", "attempts", "queue_seq").limit(200)


QUERIES = {f.__name__: f for f in (
    ingest_chunks, ingest_documents, embed_cost, search_own, search_results, chat_history, chat_prompts, rag_cost, chat_events, chat_rejoined, session_summaries, sections_by_heading, chunk_word_estimate, vec_truncated_cosine,
    dl_audit_filter, dl_audit_stats, exchange_totals, exchange_newest, log_storage, log_bounded, tenant_view, scope_checks, policy_matches, request_kinds, merged_metadata, ids_and_codes, metrics_lines, queue_replay, queue_retry_order,
)}

_P = "SELECT DISTINCT ON (chunk_id) * FROM parsed_chunks WHERE chunk_id IS NOT NULL AND source IS NOT NULL"
_R = "SELECT DISTINCT ON (request_id) * FROM chat_requests WHERE request_id IS NOT NULL"
_N = "CASE WHEN coalesce(length(text), 0) = 0 THEN 0 WHEN length(text) <= 1000 THEN 1 ELSE (length(text) - 100 + 899) // 900 END"
_CUT = f"""p AS ({_P}), n AS (SELECT *, {_N} AS n, coalesce(sum({_N}) OVER (PARTITION BY source ORDER BY ordinal NULLS FIRST, chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM p),
c AS (SELECT source, metadata['page'] AS page, text AS whole, first, unnest(range(0, n)) AS i FROM n),
k AS (SELECT source, CAST(first + i AS BIGINT) AS chunk_index, page, substring(whole, i * 900 + 1, 1000) AS text, i * 900 AS span_start, least(i * 900 + 1000, length(whole)) AS span_end FROM c)"""
_H = f"""r AS ({_R}), m AS ({_M}), h AS (SELECT request_id, coalesce(role, '') || ': ' || coalesce(content, '') AS line, m."timestamp" AS t, m.id AS id,
  row_number() OVER (PARTITION BY request_id ORDER BY m."timestamp" DESC, m.id DESC) AS back FROM r JOIN m ON r.session_id = m.session_id AND m."timestamp" < r.requested_at),
g AS (SELECT request_id, count(*) AS n, string_agg(line, chr(10) ORDER BY t, id) AS history FROM h WHERE back <= 6 GROUP BY request_id)"""
_A = f"SELECT id, content FROM ({_M}) WHERE lower(trim(role)) = 'assistant' AND content IS NOT NULL"
_TOKENS = "lower(event_type) LIKE '%token\\_%' ESCAPE '\\'"
_PATH = "'/' || coalesce(resource_id, '') || '/' || coalesce(action, '')"
_W = lambda x: "coalesce(" + _words(x) + ", 0)"
_POLICY = ", ".join(f"({n}, '{t}', {a if a is not None else 'NULL'}::VARCHAR[], {b if b is not None else 'NULL'}::VARCHAR[])" for n, t, a, b in POLICIES)
SQL = {
    "ingest_chunks": f"WITH {_CUT} SELECT *, 'fixed_size' AS strategy FROM k",
    "ingest_documents": f"""WITH {_CUT}, s AS (SELECT source, count(*) AS n_chunks, CAST(sum(length(text)) AS BIGINT) AS n_chars, CAST(floor(sum({_W('text')}) * 1.3) AS BIGINT) AS n_tokens FROM k GROUP BY source)
SELECT *, round(n_tokens / 1e6 * 0.02, 9) AS cost FROM s""",
    "embed_cost": f"""SELECT model, count(*) AS n_texts, CAST(ceil(count(*) / 100.0) AS BIGINT) AS n_batches, CAST(sum(floor({_W('message')} * 1.3)) AS BIGINT) AS n_tokens,
  round(sum(floor({_W('message')} * 1.3)) / 1e6 * {OTHER_PRICE}, 9) AS cost FROM ({_R}) WHERE message IS NOT NULL GROUP BY model""",
    "search_own": f"""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT * FROM e WHERE vec_id % 100 = 0),
s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round({_COS}, 6) + 0.0 AS distance FROM q JOIN e ON q.label = e.label),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM s)
SELECT query_id, rank, id, distance, round(CASE WHEN 1 + distance <> 0 THEN 1 / (1 + distance) END, 6) AS score FROM r WHERE rank <= 5""",
    "search_results": f"""SELECT DISTINCT query_id, q.id, CAST(rank_no AS BIGINT) AS rank_no, coalesce(v.metadata['document_id'], 'unknown') AS document_id, v.text
FROM query_results q LEFT JOIN ({_V}) v ON v.id = q.id WHERE query_id IS NOT NULL AND score IS NOT NULL""",
    "chat_history": f"WITH {_H} SELECT r.request_id, coalesce(n, 0) AS n, coalesce(history, '') AS history FROM r LEFT JOIN g USING (request_id)",
    "chat_prompts": f"""WITH {_H} SELECT r.request_id, 'system: ' || coalesce(nullif(system_prompt, ''), '{SYSTEM}') || chr(10) || coalesce(history || chr(10), '') || 'user: Context from documents:' || chr(10) || chr(10)
  || '{NOTHING_FOUND}' || chr(10) || chr(10) || 'Question: ' || coalesce(message, '') AS prompt FROM r LEFT JOIN g USING (request_id)""",
    "rag_cost": f"""WITH a AS (SELECT id, {_W('content')} AS w FROM ({_A})), t AS (SELECT id, w, CAST(floor((3 + w + 4) * 1.3) AS BIGINT) AS n_tokens FROM a)
SELECT id, n_tokens, round(n_tokens * 0.15 / 1e6 + w * 1.3 * 0.60 / 1e6, 12) AS cost FROM t""",
    "chat_events": f"""WITH a AS ({_A}), p AS (SELECT id, string_split(content, ' ') AS s FROM a), b AS (SELECT id, list_filter(list_transform(range(1, len(s) + 1), lambda i: CASE WHEN i = 1 THEN s[i] ELSE ' ' || s[i] END), lambda x: x <> '') AS parts FROM p)
SELECT id, CAST(0 AS BIGINT) AS seq, 'metadata' AS kind, id AS data FROM b UNION ALL SELECT id, CAST(len(parts) + 1 AS BIGINT), 'done', '' FROM b
UNION ALL SELECT id, CAST(unnest(range(1, len(parts) + 1)) AS BIGINT), 'content', unnest(parts) FROM b""",
    "chat_rejoined": f"SELECT id, content AS answer FROM ({_A})",
    "session_summaries": f"""WITH m AS (SELECT * FROM ({_M}) WHERE session_id IS NOT NULL AND "timestamp" IS NOT NULL),
t AS (SELECT session_id, count(*) FILTER (lower(trim(role)) = 'user') OVER w AS turn, row_number() OVER w AS no FROM m WINDOW w AS (PARTITION BY session_id ORDER BY "timestamp", id ROWS UNBOUNDED PRECEDING)),
l AS (SELECT session_id, max(turn) AS n_turns, count(*) AS n FROM t GROUP BY session_id)
SELECT session_id, n_turns, n_turns // 4 AS n_summaries, count(*) FILTER (turn <= n_turns - n_turns % 4 AND no <= n - 6) AS summarised, n - count(*) FILTER (turn <= n_turns - n_turns % 4 AND no <= n - 6) AS kept
FROM t JOIN l USING (session_id) GROUP BY session_id, n_turns, n""",
    "sections_by_heading": f"""WITH s AS (SELECT source, text, coalesce(metadata['type'] = 'heading', false) AS own, count(*) FILTER (metadata['type'] = 'heading') OVER (PARTITION BY source ORDER BY ordinal NULLS FIRST, chunk_id ROWS UNBOUNDED PRECEDING) AS section FROM ({_P}))
SELECT source, section, max(CASE WHEN own THEN text END) AS heading, count(*) AS n_rows, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS n_chars FROM s GROUP BY source, section""",
    "chunk_word_estimate": f"SELECT doc_id, CAST(CASE WHEN n = 0 THEN 0 WHEN n <= 512 THEN 1 ELSE (n - 50 + 461) // 462 END AS BIGINT) AS n_chunks FROM (SELECT doc_id, {_W('text')} AS n FROM documents)",
    "vec_truncated_cosine": f"""WITH v AS (SELECT id, CAST(embedding AS DOUBLE[]) AS v FROM ({_V}) WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR abs(x) >= 1e9)) = 0),
w AS (SELECT arg_min(v, id) AS w FROM v), p AS (SELECT id, v[1:least(len(v), len(w))] AS a, w[1:least(len(v), len(w))] AS b FROM v, w),
n AS (SELECT id, a, b, sqrt(coalesce(list_sum(list_transform(a, lambda x: x * x)), 0)) * sqrt(coalesce(list_sum(list_transform(b, lambda x: x * x)), 0)) AS norm FROM p)
SELECT id, CASE WHEN norm = 0 THEN 0.0 ELSE round(list_inner_product(a, b) / norm, 6) END AS cosine FROM n""",
    "dl_audit_filter": f"""SELECT event_id, event_type, resource_id, epoch_us("timestamp") AS "timestamp", count(*) OVER () AS total, 30 < count(*) OVER () AS has_more FROM ({_E}) e WHERE tenant_id = 'tenant_57'
  AND e."timestamp" BETWEEN '{START}' AND '{END}' AND result = 'success' AND data_classification = 'restricted' ORDER BY e."timestamp" DESC NULLS LAST, event_id LIMIT 20 OFFSET 10""",
    "dl_audit_stats": f"""WITH e AS ({_E}) SELECT 'result' AS measure, result AS key, CAST(count(*) AS DOUBLE) AS value FROM e GROUP BY result UNION ALL SELECT 'event_type', event_type, count(*) FROM e GROUP BY event_type
UNION ALL SELECT 'source_type', resource_type, count(*) FROM e GROUP BY resource_type UNION ALL SELECT 'total', NULL, count(*) FROM e UNION ALL SELECT 'mean_duration', NULL, avg(status_code) FROM e UNION ALL SELECT 'bytes', NULL, sum(retention_days) FROM e""",
    "exchange_totals": f"""SELECT count(*) AS total, count(*) FILTER (result = 'success') AS succeeded, count(*) FILTER (result IS DISTINCT FROM 'success') AS failed, count(*) FILTER (contains(lower(event_type), 'exchange')) AS delegations,
  count(*) FILTER (contains(lower(action), 'impersonat')) AS impersonations FROM ({_E}) WHERE {_TOKENS}""",
    "exchange_newest": f"""SELECT event_id, actor_id, epoch_us("timestamp") AS "timestamp" FROM ({_E}) e WHERE {_TOKENS} AND actor_type = 'user' ORDER BY e."timestamp" DESC NULLS LAST, event_id LIMIT 100""",
    "log_storage": f"SELECT count(*) AS events, count(DISTINCT tenant_id) AS tenants, count(DISTINCT actor_id) AS actors, CAST(10000 AS BIGINT) AS most_events FROM ({_E})",
    "log_bounded": f"""WITH e AS (SELECT *, row_number() OVER (ORDER BY "timestamp" DESC NULLS LAST, event_id DESC) AS a, row_number() OVER (PARTITION BY tenant_id ORDER BY "timestamp" DESC NULLS LAST, event_id DESC) AS t,
  row_number() OVER (PARTITION BY actor_id ORDER BY "timestamp" DESC NULLS LAST, event_id DESC) AS c FROM ({_E}))
SELECT 'all' AS log, event_id FROM e WHERE a <= 2000 UNION ALL SELECT 'tenant', event_id FROM e WHERE t <= 200 AND tenant_id IS NOT NULL UNION ALL SELECT 'actor', event_id FROM e WHERE c <= 100 AND actor_id IS NOT NULL""",
    "tenant_view": f"SELECT event_id, tenant_id FROM ({_E}) WHERE tenant_id = 'tenant_57'",
    "scope_checks": f"""SELECT event_id, len(list_filter(coalesce(tags, []), lambda x: x NOT IN ('secret', 'prod'))) = 0 AS allowed, array_to_string(list_sort(list_distinct(list_concat(coalesce(tags, []), ['read']))), ',') AS scopes,
  len(list_distinct([actor_type, resource_type, action])) = len(list_filter([actor_type, resource_type, action], lambda x: x IS NOT NULL)) AS chain_valid FROM ({_E})""",
    "policy_matches": f"""WITH p(n, t, s, g) AS (VALUES {_POLICY}) SELECT event_id AS request_id, CAST(min(n) AS BIGINT) AS policy_seq FROM ({_E}) e LEFT JOIN p ON t = tenant_id AND list_has_all(coalesce(tags, []), coalesce(s, []))
  AND (len(coalesce(g, [])) = 0 OR resource_type IS NULL OR list_contains(g, resource_type)) GROUP BY event_id""",
    "request_kinds": f"""SELECT event_id, CASE WHEN status_code >= 500 THEN 'error.occurred' WHEN status_code IN (401, 403) THEN 'access.denied' WHEN contains(path, 'login') THEN 'auth.login' WHEN contains(path, 'logout') THEN 'auth.logout'
  WHEN contains(path, 'token') THEN 'auth.token_issued' WHEN contains(path, 'secret') THEN 'secret.fetch' WHEN upper(action) IN ('POST', 'PUT', 'PATCH', 'DELETE') THEN 'config.changed' ELSE 'access.granted' END AS kind
FROM (SELECT *, {_PATH} AS path FROM ({_E})) WHERE NOT starts_with(path, '/res-0001') AND NOT starts_with(path, '/res-0002')""",
    "merged_metadata": f"""WITH e AS (SELECT event_id, list_filter(map_entries(coalesce(metadata, MAP {{}}::MAP(VARCHAR, VARCHAR))), lambda x: x.key NOT IN ('client', 'tenant')) AS a, coalesce(tenant_id, '') AS t FROM ({_E}))
SELECT event_id, array_to_string(list_sort(list_concat(list_transform(a, lambda x: x.key || '=' || x.value), ['client=batch', 'tenant=' || t])), ',') AS metadata FROM e""",
    "ids_and_codes": "SELECT doc_id, 'session_' || left(sha256(name), 16) AS session_id, rtrim(replace(replace(to_base64(encode(name)), '+', '-'), '/', '_'), '=') AS code, url_encode(name) AS encoded FROM documents",
    "metrics_lines": f"""SELECT 'requests_total{{event_type="' || coalesce(event_type, '') || '",result="' || coalesce(result, '') || '"}} ' || count(*) AS line FROM ({_E}) GROUP BY event_type, result""",
}
_OPS = f"{OPS}[CAST(l_partkey % {len(OPS)} + 1 AS INT)]"
_REPLAY = f"""WITH RECURSIVE l AS (SELECT l_orderkey AS j, CAST(l_linenumber AS BIGINT) AS seq, min({_OPS}) AS op FROM lineitem GROUP BY ALL),
o AS (SELECT j, seq, op, row_number() OVER (PARTITION BY j ORDER BY seq) AS i FROM l WHERE op IS NOT NULL),
s(j, i, state, attempts, refused, place) AS (SELECT DISTINCT j, CAST(0 AS BIGINT), 'queued', CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM l
UNION ALL SELECT s.j, o.i, CASE WHEN op = 'fail' THEN CASE WHEN attempts < 2 THEN 'queued' ELSE 'failed' END WHEN op = 'cancel' THEN 'cancelled' WHEN op = 'start' AND state = 'queued' THEN 'processing'
  WHEN op = 'complete' AND state = 'processing' THEN 'completed' ELSE state END, attempts + CASE WHEN op = 'start' AND state = 'queued' THEN 1 ELSE 0 END,
  refused + CASE WHEN (op = 'start' AND state <> 'queued') OR (op = 'complete' AND state <> 'processing') THEN 1 ELSE 0 END,
  CASE WHEN op = 'fail' THEN CASE WHEN attempts < 2 THEN o.seq END WHEN op = 'cancel' OR (op = 'start' AND state = 'queued') THEN NULL ELSE place END
FROM s JOIN o ON o.j = s.j AND o.i = s.i + 1),
z AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY j ORDER BY i DESC) = 1)
"""
SQL["queue_replay"] = _REPLAY + "SELECT j AS job_id, state, attempts, refused AS n_refused, place AS queue_seq FROM z"
SQL["queue_retry_order"] = _REPLAY + "SELECT j AS job_id, attempts, place AS queue_seq FROM z WHERE state = 'queued' ORDER BY place, j LIMIT 200"
