"""The flow of a retrieval system in batch: pages to chunks and document rows, a user's search, prompts with history, answers and what they cost."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brindle.functions.text import word_count
from brindle.operators.chunking import count_windows
from brindle.operators.metastore import latest_rows

#: Dimensions and price per million tokens of the known embedding models, and what holds for others.
MODEL_DIMENSIONS, OTHER_DIMENSION = {"text-embedding-3-small": 1536, "text-embedding-3-large": 3072, "text-embedding-ada-002": 1536}, 1536
MODEL_PRICES, OTHER_PRICE = {"text-embedding-3-small": 0.02, "text-embedding-3-large": 0.13, "text-embedding-ada-002": 0.10}, 0.10
#: Price per million tokens of a prompt and of an answer.
PROMPT_PRICE, ANSWER_PRICE = 0.15, 0.60
SYSTEM = "You answer questions from the documents given."


def by_model(model: Column, known: dict, other) -> Column:
    """The value of a model, ``other`` for unknown and null ones."""
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.coalesce(table[model], F.lit(other))


# ingest


def page_chunks(rows: DataFrame, document: str, order: list[str], text: str, page: Column, size: int = 1000, overlap: int = 100) -> DataFrame:
    """``document, chunk_index, page, text, span_start, span_end, metadata``: windows of each row, numbered through the document.

    No window crosses a row, so spans are those within the row; the number goes on from row to row in ``order``. The
    numbers come from the lengths of the rows alone, so that texts aren't cut before they are numbered. Null and empty
    texts have no chunks; null documents are one document.
    """
    n = count_windows(F.length(text), size, overlap)
    before = W.partitionBy(document).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    numbered = rows.withColumn("first", F.coalesce(F.sum(n).over(before), F.lit(0))).filter(n > 0)
    cut = numbered.select(document, page.alias("page"), text, "first", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("no"))
    start = F.col("no") * (size - overlap)
    meta = F.create_map(F.lit("strategy"), F.lit("fixed_size"), F.lit("chunk_size"), F.lit(str(size)), F.lit("overlap"), F.lit(str(overlap)))
    return cut.select(
        document, (F.col("first") + F.col("no")).alias("chunk_index"), "page", F.substring(text, (start + 1).cast("int"), F.lit(size)).alias("text"),
        start.alias("span_start"), F.least(start + size, F.length(text).cast("bigint")).alias("span_end"), meta.alias("metadata"),
    )


def document_rows(chunks: DataFrame, document: str, model: str = "text-embedding-3-small") -> DataFrame:
    """``document, n_chunks, n_chars, n_tokens, cost``: a row per ingested document, by its chunks."""
    tokens = F.floor(F.sum(word_count("text")) * 1.3).cast("bigint")
    return chunks.groupBy(document).agg(
        F.count(F.lit(1)).alias("n_chunks"), F.sum(F.length("text")).cast("bigint").alias("n_chars"), tokens.alias("n_tokens"),
        F.round(tokens / 1e6 * by_model(F.lit(model), MODEL_PRICES, OTHER_PRICE), 9).alias("cost"),
    )


@dataclass(frozen=True)
class EmbeddingProvider:
    """Something that turns a list of texts into as many vectors, asked for ``batch`` texts at a time."""

    name: str
    dimension: int
    vectors: Callable[[list[str]], list[list[float]]]
    batch: int = 100

    def healthy(self) -> bool:
        try:
            found = self.vectors(["test"])
            return len(found) == 1 and len(found[0]) == self.dimension
        except Exception:
            return False


def embed_by(df: DataFrame, text_col: str, provider: EmbeddingProvider, out_col: str = "embedding") -> DataFrame:
    """``df`` with the provider's vectors, in batches, in order; null texts have none. A failing batch, or vectors of another number or length, fail the job."""

    @F.pandas_udf("array<float>")
    def vectors(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in series:
            out, at = [None] * len(texts), [n for n, t in enumerate(texts) if t is not None]
            for s in range(0, len(at), provider.batch):
                part = at[s : s + provider.batch]
                found = provider.vectors([texts.iloc[n] for n in part])
                if len(found) != len(part) or any(len(v) != provider.dimension for v in found):
                    raise ValueError(f"{provider.name} gave vectors of another number or length")
                for n, v in zip(part, found):
                    out[n] = v
            yield pd.Series(out)

    return df.withColumn(out_col, vectors(F.col(text_col)))


def embedding_totals(texts: DataFrame, model: str, text: str, batch: int = 100) -> DataFrame:
    """``model, n_texts, n_batches, n_tokens, cost``: what embedding the non-null texts of each model takes."""
    rows = texts.filter(F.col(text).isNotNull()).groupBy(model).agg(F.count(F.lit(1)).alias("n_texts"), F.sum(F.floor(word_count(text) * 1.3)).cast("bigint").alias("n_tokens"))
    price = by_model(F.col(model), MODEL_PRICES, OTHER_PRICE)
    return rows.select(F.col(model).alias("model"), "n_texts", F.ceil(F.col("n_texts") / batch).cast("bigint").alias("n_batches"), "n_tokens", F.round(F.col("n_tokens") / 1e6 * price, 9).alias("cost"))


def result_rows(hits: DataFrame, document: Column, text: Column, include_text: bool = True) -> DataFrame:
    """Search results as they are given out: an unknown document is ``unknown``, the text null unless asked for."""
    return hits.withColumn("document_id", F.coalesce(document, F.lit("unknown"))).withColumn("text", text if include_text else F.lit(None).cast("string"))


# prompts


def history_before(requests: DataFrame, messages: DataFrame, n: int = 6) -> DataFrame:
    """``request_id, history``: the last ``n`` messages of the request's session before its time, oldest first, as structs (role, content).

    Messages and requests of a session are sorted once; each message carries the window of the last ``n``, and a request
    takes that of the message before it. So a busy session is neither joined with itself nor held.
    """
    said = latest_rows(messages, "id").filter("session_id is not null and timestamp is not null").select("session_id", F.col("timestamp").alias("t"), "id", "role", "content")
    lately = W.partitionBy("session_id").orderBy("t", "id").rowsBetween(1 - n, 0)
    said = said.select("session_id", "t", F.lit(1).alias("kind"), "id", F.collect_list(F.struct("role", "content")).over(lately).alias("history"))
    asked = latest_rows(requests, "request_id").select("session_id", F.col("requested_at").alias("t"), F.lit(0).alias("kind"), F.col("request_id").alias("id"), F.lit(None).cast(said.schema["history"].dataType).alias("history"))
    # at equal times the request comes first: what is said then is said after it
    along = W.partitionBy("session_id").orderBy("t", "kind", "id").rowsBetween(W.unboundedPreceding, -1)
    found = said.union(asked.filter("session_id is not null and t is not null")).withColumn("before", F.last("history", ignorenulls=True).over(along)).filter("kind = 0")
    rest = asked.filter("session_id is null or t is null").select("id", F.col("history").alias("before"))
    return found.select("id", "before").union(rest).select(F.col("id").alias("request_id"), F.coalesce("before", F.array().cast(said.schema["history"].dataType)).alias("history"))


def chat_messages(system: Column, history: Column, prompt: Column) -> Column:
    """The list that a model gets: system message (the usual one for null or empty), history, and the question with its context."""
    one = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.concat(F.array(one("system", F.coalesce(F.nullif(system, F.lit("")), F.lit(SYSTEM)))), history, F.array(one("user", prompt)))


def starter_prompt(snippets: Column, summary: Column) -> Column:
    """One system message of the snippets, parted by lines, and the running summary, if any."""
    return F.concat_ws("\n\n---\n", F.array_join(snippets, "\n\n---\n"), F.nullif(summary, F.lit("")))


def echo_model(messages: list[dict]) -> str:
    """A model for tests and dry runs: says how many messages it got and repeats the last."""
    return f"({len(messages)}) {messages[-1]['content']}" if messages else ""


def answered(df: DataFrame, messages: str, model: Callable[[list[dict]], str] = echo_model, most_retries: int = 2) -> DataFrame:
    """``df`` with ``answer`` and ``error``: a call that fails ``most_retries`` + 1 times gives an error and no answer; other rows go on."""

    @F.pandas_udf("struct<answer: string, error: string>")
    def ask(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for rows in series:
            out = []
            for given in rows:
                answer, error = None, None
                for _ in range(most_retries + 1):
                    try:
                        answer, error = model([dict(m) for m in given]), None
                        break
                    except Exception as e:
                        error = f"{type(e).__name__}: {e}"
                out.append((answer, error))
            yield pd.DataFrame(out, columns=["answer", "error"])

    return df.withColumn("said", ask(F.col(messages))).select(*df.columns, "said.answer", "said.error")


def chat_cost(message: Column, answer: Column, context: Column) -> tuple[Column, Column]:
    """(tokens, cost): words of all three times 1.3; the price of a prompt for all of them, and that of an answer for the answer."""
    words = [F.coalesce(word_count(c), F.lit(0).cast("bigint")) for c in (message, answer, context)]
    tokens = F.floor((words[0] + words[1] + words[2]) * 1.3).cast("bigint")
    return tokens, tokens * PROMPT_PRICE / 1e6 + words[1] * 1.3 * ANSWER_PRICE / 1e6


def answer_events(answers: DataFrame, key: str, answer: str, error: str | None = None) -> DataFrame:
    """``key, seq, kind, data``: the events of a streamed answer: metadata, a content event per word, and done; after an error only that."""
    failed = F.col(error).isNotNull() if error else F.lit(False)
    event = lambda kind, data: F.struct(F.lit(kind).alias("kind"), data.alias("data"))
    # a word with the blank before it, so that the parts joined are the answer
    parts = F.filter(F.split(F.coalesce(F.col(answer), F.lit("")), "(?= )"), lambda x: x != "")
    empty = F.lit("")
    good = F.concat(F.array(event("metadata", F.col(key).cast("string"))), F.transform(parts, lambda x: event("content", x)), F.array(event("done", empty)))
    bad = F.array(event("metadata", F.col(key).cast("string")), event("error", F.col(error) if error else empty))
    return answers.select(key, F.posexplode(F.when(failed, bad).otherwise(good)).alias("seq", "e")).select(key, F.col("seq").cast("bigint").alias("seq"), "e.kind", "e.data")


def joined_answers(events: DataFrame, key: str) -> DataFrame:
    """``key, answer``: the content events put together again, of answers that were done; the others aren't kept."""
    part = F.when(F.col("kind") == "content", F.struct("seq", "data"))
    told = events.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda x: x["data"]), "").alias("answer"), F.max(F.col("kind") == "done").alias("done"))
    return told.filter("done").select(key, "answer")


def running_summaries(messages: DataFrame, every: int = 4, keep: int = 6) -> DataFrame:
    """``session_id, n_turns, n_summaries, summarised, kept``: a session is summarised at each ``every``-th user turn.

    ``summarised`` counts the messages up to the last such turn that are older than the ``keep`` newest; ``kept`` the others.
    """
    rows = latest_rows(messages, "id").filter("session_id is not null and timestamp is not null")
    along = W.partitionBy("session_id").orderBy("timestamp", "id")
    turns = F.count_if(F.coalesce(F.lower(F.trim("role")) == "user", F.lit(False))).over(along.rowsBetween(W.unboundedPreceding, 0))
    numbered = rows.select("session_id", turns.alias("turn"), F.row_number().over(along).alias("no"))
    last = numbered.groupBy("session_id").agg(F.max("turn").alias("n_turns"), F.count(F.lit(1)).alias("n"))
    old = numbered.join(last, "session_id").groupBy("session_id", "n_turns", "n").agg(F.count_if((F.col("turn") <= F.col("n_turns") - F.col("n_turns") % every) & (F.col("no") <= F.col("n") - keep)).alias("summarised"))
    return old.select("session_id", "n_turns", F.floor(F.col("n_turns") / every).alias("n_summaries"), "summarised", (F.col("n") - F.col("summarised")).alias("kept"))


def heading_sections(rows: DataFrame, document: str, order: list[str], text: str, is_heading: Column) -> DataFrame:
    """``document, section, heading, n_rows, n_chars``: a document's rows parted at its headings; section 0 is what stands before the first."""
    along = W.partitionBy(document).orderBy(*order)
    flag = F.coalesce(is_heading, F.lit(False))
    cut = rows.withColumn("section", F.count_if(flag).over(along.rowsBetween(W.unboundedPreceding, 0))).withColumn("own", flag)
    return cut.groupBy(document, "section").agg(F.max(F.when(F.col("own"), F.col(text))).alias("heading"), F.count(F.lit(1)).alias("n_rows"), F.sum(F.coalesce(F.length(text), F.lit(0))).cast("bigint").alias("n_chars"))
