"""Splitting oversized texts at natural boundaries, by a hierarchy of separators.

A piece is filled up to the limit and cut at the coarsest boundary that lies in its second half: section or
paragraph, line, sentence, word, then character. The next piece starts ``overlap`` characters before the cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SENTENCE = re.compile(r"(?<=[.!?])[ \t\r\n]|[。！？]")
_BLANK = re.compile(r"[ \t\r\n]")


def _last_end(pattern: re.Pattern, text: str, low: int, high: int) -> int:
    end = -1
    for m in pattern.finditer(text, low, high):
        end = m.end()
    return end


def _cut(text: str, low: int, high: int) -> int:
    """The end of a piece: the largest offset in ``(low, high]`` after the coarsest separator that has one there."""
    for mark in ("\n\n", "\n"):
        at = text.rfind(mark, max(0, low - len(mark) + 1), high)
        if at >= 0:
            return at + len(mark)
    for pattern in (_SENTENCE, _BLANK):
        end = _last_end(pattern, text, low, high)
        if end > low:
            return end
    return high


def piece_spans(text: str, limit: int = 2000, overlap: int = 200, least: int = 1000) -> Iterator[tuple[int, int]]:
    """Spans ``[start, end)`` in code points, in order; a text within the limit is one piece, an empty one none.

    Time and memory are linear in the text, however long: every cut looks at one window of at most ``limit``.
    """
    if not 0 <= overlap <= least < limit:
        raise ValueError("0 <= overlap <= least < limit must hold")
    n, start = len(text), 0
    while n - start > limit:
        end = _cut(text, start + least, start + limit)
        yield start, end
        start = end - overlap
    if start < n:
        yield start, n


def split_oversized(df: DataFrame, id_col: str, text_col: str, limit: int = 2000, overlap: int = 200, least: int = 1000, with_text: bool = True) -> DataFrame:
    """Pieces of the texts longer than ``limit``: ``id, piece_no, piece_start, piece_end[, piece_text]``.

    Null, empty and short texts give no rows (they need no cut). Rows that repeat id and text give their pieces once;
    rows of one id with different texts give the pieces of each. A null id is kept as null. Only id and text are read,
    so other columns may have any name. The texts stay where they were read; only pieces are shuffled.
    """
    shape = "id string, piece_no int, piece_start long, piece_end long" + (", piece_text string" if with_text else "")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = shape.replace(",", "").split()[::2]
        for pdf in batches:
            rows = []
            for key, text in zip(pdf["id"], pdf["text"]):
                for no, (s, e) in enumerate(piece_spans(text, limit, overlap, least)):
                    rows.append((key, no, s, e, text[s:e])[: len(names)])
                if len(rows) > 20_000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    long = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).filter(F.length("text") > limit)
    return long.mapInPandas(cut, shape).distinct()
