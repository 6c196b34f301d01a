"""The relational side of a retrieval system: sessions, messages, documents and their chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest_rows(df: DataFrame, key: str) -> DataFrame:
    """One row per key of rows that are equal but for their time of arrival; null keys are dropped."""
    return df.filter(F.col(key).isNotNull()).dropDuplicates([key])


def session_rollup(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """``session_id, user_id, n_messages, last_activity, known``: of every session that is known or has messages.

    Messages of unknown sessions are kept (``known`` false); a known session without messages has 0 and null. Messages
    are aggregated before the join, so that a busy session is one row by then.
    """
    counted = latest_rows(messages, "id").filter("session_id is not null").groupBy("session_id").agg(F.count(F.lit(1)).alias("n_messages"), F.max("timestamp").alias("last_activity"))
    own = latest_rows(sessions, "id").select(F.col("id").alias("session_id"), "user_id", F.lit(True).alias("known"))
    both = own.join(counted, "session_id", "full")
    return both.select("session_id", "user_id", F.coalesce("n_messages", F.lit(0)).alias("n_messages"), "last_activity", F.coalesce("known", F.lit(False)).alias("known"))


def user_stats(sessions: DataFrame, messages: DataFrame, documents: DataFrame) -> DataFrame:
    """``user_id, n_sessions, n_messages, n_documents``: zero where a user has none; users of null id don't count."""
    roll = session_rollup(sessions, messages).filter("known and user_id is not null")
    a = roll.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_sessions"), F.sum("n_messages").alias("n_messages"))
    b = documents.filter("user_id is not null").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_documents"))
    return a.join(b, "user_id", "full").select("user_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_sessions", "n_messages", "n_documents")])


def page(df: DataFrame, order: list, number: int = 1, size: int = 50) -> DataFrame:
    """Rows of page ``number`` (from 1), with ``total_count, total_pages, has_next, has_previous`` on each.

    ``order`` must end with a unique column. Spark keeps only the rows up to the page's end (a top-k per partition); a
    page past the end is empty.
    """
    if number < 1 or not 1 <= size <= 1000:
        raise ValueError("number >= 1 and 1 <= size <= 1000 must hold")
    total = df.agg(F.count(F.lit(1))).scalar()
    pages = F.ceil(total / size)
    rows = df.orderBy(*order).offset((number - 1) * size).limit(size)
    return rows.select("*", total.alias("total_count"), pages.cast("bigint").alias("total_pages"), (pages > number).alias("has_next"), F.lit(number > 1).alias("has_previous"))


def history(messages: DataFrame, n: int, newest: bool = True) -> DataFrame:
    """The ``n`` newest (or oldest) messages of each session, with ``place`` 1 for the nearest end.

    Messages without session or time have no place in a history. The limit per group is applied before the shuffle.
    """
    order = [F.desc("timestamp"), F.desc("id")] if newest else ["timestamp", "id"]
    rows = latest_rows(messages, "id").filter("session_id is not null and timestamp is not null")
    return rows.withColumn("place", F.row_number().over(W.partitionBy("session_id").orderBy(*order)).cast("bigint")).filter(F.col("place") <= n)


def document_chunks(documents: DataFrame, vectors: DataFrame) -> DataFrame:
    """``doc_id, chunk_id, chunk_index``: the chunks of each document, in order of page, then id."""
    own = latest_rows(vectors, "id").select(F.col("metadata")["document_id"].cast("bigint").alias("doc_id"), F.coalesce(F.col("metadata")["page"].cast("int"), F.lit(0)).alias("page"), F.col("id").alias("chunk_id"))
    rows = own.filter("doc_id is not null").join(documents.select("doc_id"), "doc_id", "left_semi")
    return rows.select("doc_id", "chunk_id", (F.row_number().over(W.partitionBy("doc_id").orderBy("page", "chunk_id")) - 1).cast("bigint").alias("chunk_index"))


def delete_documents(vectors: DataFrame, gone: DataFrame) -> DataFrame:
    """``vectors`` without the chunks of the documents in ``gone`` (its first column); chunks without document stay."""
    ids = gone.select(F.col(gone.columns[0]).cast("string").alias("gone_id")).filter("gone_id is not null").distinct()
    return vectors.join(ids, F.col("metadata")["document_id"] == F.col("gone_id"), "left_anti")


def cited_texts(messages: DataFrame, vectors: DataFrame) -> DataFrame:
    """``message_id, rank, chunk_id, text``: the texts a message cites, in order; unknown chunks have a null text."""
    cites = latest_rows(messages, "id").filter(F.size("sources") > 0).select(F.col("id").alias("message_id"), F.posexplode("sources").alias("pos", "chunk_id"))
    texts = latest_rows(vectors, "id").select(F.col("id").alias("chunk_id"), "text")
    return cites.join(texts, "chunk_id", "left").select("message_id", (F.col("pos") + 1).cast("bigint").alias("rank"), "chunk_id", "text")
