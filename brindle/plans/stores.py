"""Queries on the vector collection and the metadata tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.operators.metastore import cited_texts, delete_documents, document_chunks, history, page, session_rollup, user_stats
from brindle.operators.rag import context, prompt, token_estimate
from brindle.operators.vectors import delete_rows, nearest, upsert
from brindle.sources.tables import micros, table


def _asked(e):
    return e.filter("vec_id % 100 = 0")


def _knn(metric, where=None, k=10):
    def run(spark, d):
        e = table(spark, d, "embeddings")
        return nearest(e, _asked(e), k, metric, where)

    return run


knn_cosine, knn_l2, knn_ip = _knn("cosine"), _knn("l2"), _knn("ip")
knn_filtered = _knn("cosine", {"label": 1}, 5)
knn_filtered_ops = _knn("cosine", {"$or": [{"label": {"$gte": 2, "$lt": 4}}, {"label": {"$in": [0, 5]}}], "vec_id": {"$ne": 100}}, 5)


def _flat(df):
    """A vector as the sum of its numbers times their places, as results must be flat."""
    placed = F.transform("embedding", lambda x, i: x.cast("double") * (i + 1))
    total = F.aggregate(placed, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    return df.select("vec_id", F.size("embedding").cast("bigint").alias("n"), F.round(total, 4).alias("checksum"), F.col("label").cast("bigint").alias("label"))


def vec_upsert(spark, d):
    e = table(spark, d, "embeddings")
    changed = e.filter("vec_id % 3 = 0").select("vec_id", "embedding", (F.col("label") + 100).cast(e.schema["label"].dataType).alias("label"), F.lit(1).alias("version"))
    newer = e.filter("vec_id % 9 = 0").select((F.col("vec_id") + 1_000_000 * (F.col("vec_id") % 2)).alias("vec_id"), "embedding", (F.col("label") + 200).cast(e.schema["label"].dataType).alias("label"), F.lit(2).alias("version"))
    return _flat(upsert(e, changed.union(newer), "vec_id", "version"))


def vec_delete(spark, d):
    e = table(spark, d, "embeddings")
    return _flat(delete_rows(e, e.filter("label = 1").select("vec_id"), "vec_id"))


def vec_count(spark, d):
    return table(spark, d, "embeddings").groupBy(F.col("label").cast("bigint").alias("label")).agg(F.count(F.lit(1)).alias("n"))


def session_totals(spark, d):
    r = session_rollup(table(spark, d, "sessions"), table(spark, d, "messages"))
    return r.select("session_id", "user_id", "n_messages", F.unix_micros(F.col("last_activity").cast("timestamp")).cast("string").alias("last_us"), "known")


def session_page(spark, d):
    s = table(spark, d, "sessions").filter("id is not null").dropDuplicates(["id"]).select("id", "user_id", micros("last_activity").alias("last_us"))
    return page(s, [F.desc("last_us"), "id"], 3, 20)


def session_user_stats(spark, d):
    return user_stats(table(spark, d, "sessions"), table(spark, d, "messages"), table(spark, d, "documents"))


def _history(newest):
    def run(spark, d):
        return history(table(spark, d, "messages"), 6, newest).select("session_id", "place", "id", "role")

    return run


history_newest, history_oldest = _history(True), _history(False)


def doc_list(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "name", "status", micros("uploaded_at").alias("uploaded_us"))
    return page(docs, [F.desc_nulls_last("uploaded_us"), "doc_id"], 2, 50)


def doc_chunks(spark, d):
    return document_chunks(table(spark, d, "documents"), table(spark, d, "vector_documents"))


def doc_delete_cascade(spark, d):
    gone = table(spark, d, "documents").filter("doc_id % 7 = 3").select("doc_id")
    return delete_documents(table(spark, d, "vector_documents"), gone).filter("id is not null").select("id").distinct()


def rag_sources(spark, d):
    return cited_texts(table(spark, d, "messages"), table(spark, d, "vector_documents"))


def rag_context(spark, d):
    return context(rag_sources(spark, d), "message_id")


def rag_prompt(spark, d):
    m = table(spark, d, "messages").filter("id is not null").dropDuplicates(["id"]).select(F.col("id").alias("message_id"), F.coalesce("content", F.lit("")).alias("content"))
    both = m.join(rag_context(spark, d), "message_id")
    return both.select("message_id", prompt(F.col("context"), F.col("content")).alias("prompt"), token_estimate(F.col("context"), F.col("content")).alias("n_tokens"))


QUERIES = {
    "knn_cosine": knn_cosine, "knn_l2": knn_l2, "knn_ip": knn_ip, "knn_filtered": knn_filtered, "knn_filtered_ops": knn_filtered_ops, "history_newest": history_newest, "history_oldest": history_oldest,
} | {f.__name__: f for f in (vec_upsert, vec_delete, vec_count, session_totals, session_page, session_user_stats, doc_list, doc_chunks, doc_delete_cascade, rag_sources, rag_context, rag_prompt)}

_COS = "1 - coalesce(list_cosine_similarity(q.v, e.v), 0)"
_L2 = "list_aggregate(list_transform(range(1, len(q.v) + 1), lambda i: (q.v[i] - e.v[i]) * (q.v[i] - e.v[i])), 'sum')"
_IP = "1 - list_inner_product(q.v, e.v)"


def _knn_sql(distance, k=10, where="true"):
    return f"""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT * FROM e WHERE vec_id % 100 = 0),
s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round({distance}, 6) + 0.0 AS distance FROM q, e WHERE {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM s)
SELECT query_id, rank, id, distance, round(CASE WHEN 1 + distance <> 0 THEN 1 / (1 + distance) END, 6) AS score FROM r WHERE rank <= {k}"""


_M = "SELECT DISTINCT ON (id) * FROM messages WHERE id IS NOT NULL"
_S = "SELECT DISTINCT ON (id) * FROM sessions WHERE id IS NOT NULL"
_V = "SELECT DISTINCT ON (id) * FROM vector_documents WHERE id IS NOT NULL"
_ROLL = f"""m AS ({_M}), s AS ({_S}), c AS (SELECT session_id, count(*) AS n, max("timestamp") AS t FROM m WHERE session_id IS NOT NULL GROUP BY session_id),
r AS (SELECT coalesce(s.id, c.session_id) AS session_id, user_id, coalesce(n, 0) AS n_messages, epoch_us(t) AS last_us, s.id IS NOT NULL AS known FROM s FULL JOIN c ON s.id = c.session_id)"""
_CITES = f"""c AS (SELECT id AS message_id, unnest(range(1, len(sources) + 1)) AS rank, unnest(sources) AS chunk_id FROM ({_M}) WHERE len(sources) > 0),
t AS (SELECT message_id, rank, chunk_id, text FROM c LEFT JOIN (SELECT id, text FROM ({_V})) v ON v.id = chunk_id)"""
_CONTEXT = """x AS (SELECT message_id, coalesce(string_agg('[Source ' || rank || ']: ' || text, chr(10) || chr(10) ORDER BY rank) FILTER (WHERE text IS NOT NULL),
  'No relevant documents found.') AS context FROM t GROUP BY message_id)"""
_FLAT = "vec_id, len(embedding) AS n, round(list_sum(list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) * i)), 4) AS checksum, CAST(label AS BIGINT) AS label"


def _words(x):
    from brindle.plans.texts import WS

    return f"len(list_filter(regexp_split_to_array({x}, '[{WS}]+'), lambda w: w <> ''))"


def _page(n, size):
    return f"count(*) OVER () AS total_count, CAST(ceil(count(*) OVER () / {size}.0) AS BIGINT) AS total_pages, ceil(count(*) OVER () / {size}.0) > {n} AS has_next, {'true' if n > 1 else 'false'} AS has_previous"


def _history_sql(order):
    return f"""SELECT session_id, place, id, role FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY {order}) AS place FROM ({_M})
WHERE session_id IS NOT NULL AND "timestamp" IS NOT NULL) WHERE place <= 6"""


SQL = {
    "knn_cosine": _knn_sql(_COS),
    "knn_l2": _knn_sql(_L2),
    "knn_ip": _knn_sql(_IP),
    "knn_filtered": _knn_sql(_COS, 5, "e.label = 1"),
    "knn_filtered_ops": _knn_sql(_COS, 5, "((e.label >= 2 AND e.label < 4) OR e.label IN (0, 5)) AND e.vec_id <> 100"),
    "vec_upsert": f"""WITH c AS (SELECT vec_id, embedding, label + 100 AS label, 1 AS version FROM embeddings WHERE vec_id % 3 = 0
  UNION ALL SELECT vec_id + 1000000 * (vec_id % 2), embedding, label + 200, 2 FROM embeddings WHERE vec_id % 9 = 0),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY version DESC) AS r FROM c) WHERE r = 1)
SELECT {_FLAT} FROM n UNION ALL SELECT {_FLAT} FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM n)""",
    "vec_delete": f"SELECT {_FLAT} FROM embeddings WHERE label IS DISTINCT FROM 1",
    "vec_count": "SELECT CAST(label AS BIGINT) AS label, count(*) AS n FROM embeddings GROUP BY label",
    "session_totals": f"WITH {_ROLL} SELECT session_id, user_id, n_messages, CAST(last_us AS VARCHAR) AS last_us, known FROM r",
    "session_page": f"SELECT id, user_id, epoch_us(last_activity) AS last_us, {_page(3, 20)} FROM ({_S}) ORDER BY last_us DESC, id LIMIT 20 OFFSET 40",
    "session_user_stats": f"""WITH {_ROLL}, a AS (SELECT user_id, count(*) AS n_sessions, sum(n_messages) AS n_messages FROM r WHERE known AND user_id IS NOT NULL GROUP BY user_id),
b AS (SELECT user_id, count(*) AS n_documents FROM documents WHERE user_id IS NOT NULL GROUP BY user_id)
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(n_sessions, 0) AS n_sessions, CAST(coalesce(n_messages, 0) AS BIGINT) AS n_messages, coalesce(n_documents, 0) AS n_documents FROM a FULL JOIN b USING (user_id)""",
    "history_newest": _history_sql('"timestamp" DESC, id DESC'),
    "history_oldest": _history_sql('"timestamp", id'),
    "doc_list": f"SELECT doc_id, name, status, epoch_us(uploaded_at) AS uploaded_us, {_page(2, 50)} FROM documents ORDER BY uploaded_us DESC NULLS LAST, doc_id LIMIT 50 OFFSET 50",
    "doc_chunks": f"""SELECT doc_id, id AS chunk_id, row_number() OVER (PARTITION BY doc_id ORDER BY p, id) - 1 AS chunk_index FROM
(SELECT id, TRY_CAST(metadata['document_id'] AS BIGINT) AS doc_id, coalesce(TRY_CAST(metadata['page'] AS INT), 0) AS p FROM ({_V})) WHERE doc_id IN (SELECT doc_id FROM documents)""",
    "doc_delete_cascade": f"""SELECT id FROM ({_V}) WHERE metadata['document_id'] IS NULL OR metadata['document_id'] NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id % 7 = 3)""",
    "rag_sources": f"WITH {_CITES} SELECT message_id, rank, chunk_id, text FROM t",
    "rag_context": f"WITH {_CITES}, {_CONTEXT} SELECT message_id, context FROM x",
    "rag_prompt": f"""WITH {_CITES}, {_CONTEXT}, m AS (SELECT id AS message_id, coalesce(content, '') AS content FROM ({_M}))
SELECT message_id, 'Context from documents:' || chr(10) || chr(10) || context || chr(10) || chr(10) || 'Question: ' || content AS prompt,
  CAST(floor(({_words('context')} + {_words('content')}) * 1.3) AS BIGINT) AS n_tokens FROM x JOIN m USING (message_id)""",
}
