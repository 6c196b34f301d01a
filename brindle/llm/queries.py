"""The queries of the training-data operators, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brindle.llm.abuse import fit_from_tables, rates_by_source, score_documents
from brindle.llm.boilerplate import furniture_lines, main_text
from brindle.llm.conversations import assign_conversations, judge_conversations, links_in_metadata, rebuild_conversations
from brindle.llm.mixing import mix_report, mix_sources
from brindle.llm.neardup import duplicate_groups, duplicate_pairs, near_duplicates
from brindle.llm.pii import find_personal_data, fit_finder, redact
from brindle.llm.similar import most_similar
from brindle.llm.splitting import split_oversized
from brindle.llm.tokenize import encode_corpus
from brindle.operators.metastore import latest_rows
from brindle.sources.tables import table


def p1_neighbours(spark, d):
    return most_similar(table(spark, d, "vector_documents"), "id", "embedding", least_score=0.85)


def p1_found(spark, d):
    near = p1_neighbours(spark, d)
    return near.select(F.least("id", "other_id").alias("id_a"), F.greatest("id", "other_id").alias("id_b")).distinct()


def p2_found(spark, d):
    messages = table(spark, d, "messages")
    known = table(spark, d, "sessions").select("id").union(table(spark, d, "chat_requests").select("session_id"))
    known = known.union(messages.select("session_id"))
    judged = judge_conversations(messages, known, links_in_metadata(messages)).filter("not kept")
    return judged.select(F.col("conversation_id").alias("session_id"))


def p2_turns(spark, d):
    messages = table(spark, d, "messages")
    turns = rebuild_conversations(messages, links_in_metadata(messages))
    return turns.select(F.col("conversation_id").alias("session_id"), F.col("turn").cast("bigint").alias("turn"), "role", "content")


def p2_threads(spark, d):
    """Conversations found by links alone: all but the first message of each session lose its id and get a link to the one before."""
    messages = latest_rows(table(spark, d, "messages"), "id").filter("session_id is not null and timestamp is not null")
    along = W.partitionBy("session_id").orderBy("timestamp", "id")
    linked = messages.select("id", "session_id", F.lag("id").over(along).alias("before"))
    link = F.when(F.col("before").isNotNull(), F.to_json(F.struct(F.col("before").alias("reply_to"))))
    torn = linked.select("id", F.when(F.col("before").isNull(), F.col("session_id")).alias("session_id"), link.alias("metadata"))
    return assign_conversations(torn, links_in_metadata(torn)).select("id", "conversation_id")


def p4_found(spark, d):
    return furniture_lines(table(spark, d, "parsed_chunks"))


def p4_main(spark, d):
    return main_text(table(spark, d, "parsed_chunks"))


def p5_found(spark, d):
    pieces = split_oversized(table(spark, d, "parsed_chunks"), "chunk_id", "text", with_text=False)
    return pieces.select(F.col("id").alias("chunk_id"), "piece_start", "piece_end")


def _near(spark, d):
    chunks = table(spark, d, "parsed_chunks").select(F.lit(1).alias("part"), F.col("chunk_id").alias("id"), "text")
    vectors = table(spark, d, "vector_documents").select(F.lit(2).alias("part"), "id", "text")
    return near_duplicates(chunks.union(vectors), "id", "text", "part", similarity="0.6", width=3, least_words=30)


def p6_found(spark, d):
    return duplicate_pairs(*_near(spark, d))


def p6_groups(spark, d):
    return duplicate_groups(*_near(spark, d))


def _texts_of_people(spark, d):
    messages = table(spark, d, "messages").select(F.col("id").alias("record_id"), F.col("content").alias("text"))
    return messages.union(table(spark, d, "chat_requests").select("request_id", "message"))


def p7_found(spark, d):
    texts = _texts_of_people(spark, d)
    lexicon, model = fit_finder(texts.select("text"), table(spark, d, "known_names"))
    return find_personal_data(texts, "record_id", "text", lexicon, model).withColumnRenamed("id", "record_id")


def p7_redacted(spark, d):
    texts = _texts_of_people(spark, d)
    return redact(texts.distinct(), "text", *fit_finder(texts.select("text"), table(spark, d, "known_names")))


def p8_ids(spark, d):
    return encode_corpus(table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p9_mix(spark, d):
    return mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_shares(spark, d):
    targets = table(spark, d, "mix_targets")
    return mix_report(mix_sources(table(spark, d, "documents"), targets), targets)


def _severity(spark, d):
    documents = table(spark, d, "documents")
    numbered, models, _ = fit_from_tables(documents, table(spark, d, "content_labels"), table(spark, d, "content_terms"))
    return documents, score_documents(numbered, models)


#: A document counts for a category from this probability of the highest grade on.
CONTENT_FROM = 0.5


def p10_found(spark, d):
    return _severity(spark, d)[1].filter(F.col("p_content") >= CONTENT_FROM).select("doc_id", "category")


def p10_scores(spark, d):
    return _severity(spark, d)[1].select("doc_id", "category", F.round("severity", 6).alias("severity"))


def p10_rates(spark, d):
    return rates_by_source(*_severity(spark, d), CONTENT_FROM)


QUERIES = {f.__name__: f for f in (p1_found, p1_neighbours, p2_found, p2_turns, p2_threads, p4_found, p4_main, p5_found, p6_found, p6_groups, p7_found, p7_redacted, p8_ids, p9_mix, p9_shares, p10_found, p10_scores, p10_rates)}

_WS = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_TURNS = f"""
WITH ids AS (SELECT id AS session_id FROM sessions UNION SELECT session_id FROM messages UNION SELECT session_id FROM chat_requests),
m AS (SELECT DISTINCT session_id, role AS raw, content, "timestamp" AS t, lower(regexp_replace(role, '^{_WS}|{_WS}$', '', 'g')) AS role
  FROM messages WHERE session_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY t, CASE WHEN role = 'user' THEN 0 ELSE 1 END) AS turn
  FROM m WHERE role IS DISTINCT FROM 'system'),
f AS (SELECT session_id, count(*) AS n, bool_and(coalesce(t IS NOT NULL AND role = CASE WHEN turn % 2 = 1 THEN 'user' ELSE 'assistant' END
  AND regexp_replace(content, '{_WS[:-2]}\\x{{200b}}\\x{{feff}}]+', '', 'g') <> '', false)) AS fine FROM o GROUP BY session_id)
"""
SQL = {
    "p2_found": _TURNS + "SELECT ids.session_id FROM ids LEFT JOIN f USING (session_id) WHERE ids.session_id IS NOT NULL AND NOT coalesce(fine AND n % 2 = 0, false)",
    "p2_turns": _TURNS + "SELECT session_id, turn, role, content FROM o JOIN f USING (session_id) WHERE fine AND n % 2 = 0",
}
SQL["p2_threads"] = 'SELECT DISTINCT id, session_id AS conversation_id FROM messages WHERE id IS NOT NULL AND session_id IS NOT NULL AND "timestamp" IS NOT NULL'


def _last(pattern, back):
    """The end of the last match in the 1,000 characters up to s + 2000, read from ``back`` characters before them; 0 if none."""
    return f"length(regexp_extract(substring(text, s + 1001 - {back}, {1000 + back}), '(?s)^({pattern})', 1)) - {back}"


def _end(pattern, back):
    return f"CASE WHEN {_last(pattern, back)} > 0 THEN s + 1000 + {_last(pattern, back)} END"


_MARKED = f"greatest({_end('.*[.!?][ \\t\\r\\n]', 1)}, {_end('.+[。！？]', 1)})"
_NATURAL = f"coalesce({_end('.*\\n\\n', 1)}, {_end('.*\\n', 0)}, {_MARKED}, {_end('.*[ \\t\\r\\n]', 0)}, s + 2000)"
SQL["p5_found"] = f"""WITH RECURSIVE t AS (SELECT DISTINCT ON (chunk_id) chunk_id, text, length(text) AS n FROM parsed_chunks WHERE chunk_id IS NOT NULL AND length(text) > 2000),
p(chunk_id, s, e) AS (SELECT chunk_id, CAST(0 AS BIGINT), CAST({_NATURAL} AS BIGINT) FROM (SELECT *, 0 AS s FROM t)
UNION ALL SELECT chunk_id, s, CAST(CASE WHEN n - s <= 2000 THEN n ELSE {_NATURAL} END AS BIGINT) FROM (SELECT chunk_id, text, n, CAST(e - 200 AS BIGINT) AS s FROM p JOIN t USING (chunk_id) WHERE e < n))
SELECT chunk_id, s AS piece_start, e AS piece_end FROM p"""
