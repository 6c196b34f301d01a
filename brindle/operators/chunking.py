"""Cutting texts into overlapping windows, of characters or of tokens, in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.text import words


def _checked(size: int, overlap: int) -> None:
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("0 <= overlap < size must hold")


def count_windows(length: Column, size: int, overlap: int) -> Column:
    """How many windows cover ``length`` units: none for 0 or null, else 1 or ceil((length - overlap) / (size - overlap))."""
    _checked(size, overlap)
    step = size - overlap
    n = F.when(length <= size, F.lit(1)).otherwise(F.floor((length - overlap + step - 1) / step))
    return F.when(F.coalesce(length, F.lit(0)) <= 0, F.lit(0)).otherwise(n).cast("bigint")


def fixed_size_chunks(df: DataFrame, id_col: str, text_col: str, size: int = 1000, overlap: int = 100) -> DataFrame:
    """``id, chunk_index, chunk_id, text, char_count, span_start, span_end`` (code points, the end exclusive).

    Null and empty texts have no chunks. The last window ends with the text. No shuffle and no Python: a text is cut
    where it is read, so that only the chunks' rows leave the scan.
    """
    _checked(size, overlap)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("whole"), F.length(text_col).alias("n"))
    rows = rows.filter("n > 0").withColumn("windows", count_windows(F.col("n"), size, overlap))
    cut = rows.select("id", "whole", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("windows") - 1)).alias("chunk_index"))
    start = F.col("chunk_index") * (size - overlap)
    cut = cut.withColumn("span_start", start).withColumn("span_end", F.least(start + size, F.col("n").cast("bigint")))
    return cut.select(
        "id", "chunk_index", F.concat(F.lit("chunk_"), F.col("chunk_index")).alias("chunk_id"),
        F.substring("whole", (F.col("span_start") + 1).cast("int"), F.lit(size)).alias("text"),
        (F.col("span_end") - F.col("span_start")).alias("char_count"), "span_start", "span_end",
    )


def word_chunks(df: DataFrame, id_col: str, text_col: str, size: int = 512, overlap: int = 50) -> DataFrame:
    """``id, chunk_index, text, token_count``: windows of white-space separated words, joined by single spaces.

    The window rule is that of ``fixed_size_chunks``, over words; a text without words has no chunks.
    """
    _checked(size, overlap)
    rows = df.select(F.col(id_col).alias("id"), words(text_col).alias("tokens")).filter(F.size("tokens") > 0)
    rows = rows.withColumn("windows", count_windows(F.size("tokens"), size, overlap))
    cut = rows.select("id", "tokens", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("windows") - 1)).alias("chunk_index"))
    piece = F.slice("tokens", (F.col("chunk_index") * (size - overlap) + 1).cast("int"), F.lit(size))
    return cut.select("id", "chunk_index", F.array_join(piece, " ").alias("text"), F.size(piece).cast("bigint").alias("token_count"))


def running_spans(df: DataFrame, group: str, order: list[str], text_col: str, gap: int = 1) -> DataFrame:
    """``df`` with ``span_from`` and ``span_to``: offsets of each text if those of a group were joined by ``gap`` signs.

    Null texts count as empty. Rows of equal order get the same place in turn by their text.
    """
    from pyspark.sql import Window as W

    length = F.coalesce(F.length(text_col), F.lit(0)).cast("bigint")
    before = W.partitionBy(group).orderBy(*order, text_col).rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(length + gap).over(before), F.lit(0))
    return df.withColumn("span_from", start).withColumn("span_to", start + length)


def token_chunks(df: DataFrame, id_col: str, text_col: str, vocabulary_path: str, size: int = 512, overlap: int = 50) -> DataFrame:
    """``id, chunk_index, text, token_count, span_start, span_end``: windows of the tokens of a public vocabulary.

    ``vocabulary_path`` is a tokenizer file that every executor can read. A window covers the characters that its tokens
    touch, so that pieces are substrings of the text even where a token ends inside a character. Null and empty texts
    have no chunks. Each text is encoded once, in time linear in its length.
    """
    from collections.abc import Iterator

    import pyarrow as pa

    _checked(size, overlap)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("whole")).filter("whole <> ''")
    kind = rows.schema["id"].dataType.simpleString()
    names = ["id", "chunk_index", "text", "token_count", "span_start", "span_end"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary_path)
        tokenizer.encode_special_tokens = True
        for batch in batches:
            texts = batch.column("whole").to_pylist()
            out: list[list] = [[] for _ in names]
            for n, (text, coded) in enumerate(zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False))):
                spans, start, index = coded.offsets, 0, 0
                while start < len(spans):
                    window = spans[start : start + size]
                    a, b = window[0][0], max(e for _, e in window)
                    for column, x in zip(out, (n, index, text[a:b], len(window), a, b)):
                        column.append(x)
                    if start + size >= len(spans):
                        break
                    start, index = start + size - overlap, index + 1
            ids = batch.column("id").take(pa.array(out[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), *[pa.array(x, pa.int64()) for x in out[3:]]], names=names)

    return rows.mapInArrow(cut, f"id {kind}, chunk_index long, text string, token_count long, span_start long, span_end long")
