"""All queries of the core, their SQL, and the flagship query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators.chunking import fixed_size_chunks
from brindle.operators.chat import answered, chat_cost, chat_messages, history_before
from brindle.operators.metastore import latest_rows
from brindle.operators.rag import NOTHING_FOUND, context, embed, prompt
from brindle.operators.vectors import nearest
from brindle.plans import flows, logs, sessions, stores, texts
from brindle.sources.tables import table


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Documents cut into chunks and embedded; for every question its user's five nearest chunks, the prompt with context and history, an answer, and its cost.

    A question sees the documents of its own user only. All questions are asked. The model is a stand-in that needs no network.
    """
    chunks = fixed_size_chunks(table(spark, d, "documents").filter("user_id is not null").withColumn("key", F.struct("user_id", "doc_id")), "key", "text")
    chunks = chunks.select(F.col("id.user_id").alias("user_id"), F.concat_ws("_", "id.doc_id", "chunk_id").alias("vec_id"), "text")
    requests = latest_rows(table(spark, d, "chat_requests"), "request_id")
    asked = requests.filter("message <> ''").select("user_id", F.col("request_id").alias("vec_id"), F.col("message").alias("text"))
    hits = nearest(embed(chunks, "text"), embed(asked, "text"), 5, within="user_id")
    ranked = hits.join(chunks.select(F.col("vec_id").alias("id"), "text"), "id").select(F.col("query_id").alias("request_id"), "rank", "text")
    both = requests.join(context(ranked, "request_id"), "request_id", "left").join(history_before(requests, table(spark, d, "messages")), "request_id")
    both = both.withColumn("context", F.coalesce("context", F.lit(NOTHING_FOUND)))
    asking = both.withColumn("messages", chat_messages(F.col("system_prompt"), F.col("history"), prompt(F.col("context"), F.coalesce("message", F.lit("")))))
    tokens, cost = chat_cost(F.col("message"), F.col("answer"), F.col("context"))
    return answered(asking, "messages").select("request_id", "user_id", "context", "answer", tokens.alias("n_tokens"), F.round(cost, 12).alias("cost"))


_PARTS = [texts, stores, logs, sessions, flows]
QUERIES = {"flagship": flagship} | {k: v for p in _PARTS for k, v in p.QUERIES.items()}
SQL = {k: v for p in _PARTS for k, v in p.SQL.items()}
