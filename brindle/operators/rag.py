"""Context and prompts from ranked texts, and a deterministic embedding for use without a remote model."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.text import word_count

_ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
NOTHING_FOUND = "No relevant documents found."


def context(hits: DataFrame, by: str, rank: str = "rank", text: str = "text") -> DataFrame:
    """``by, context``: ``[Source i]: text`` in order of rank, separated by blank lines; hits without text don't show.

    The list of a question is as long as its top-k, so the aggregate is bounded by k.
    """
    shown = hits.filter(F.col(text).isNotNull())
    lines = F.transform(F.sort_array(F.collect_list(F.struct(rank, text))), lambda x: F.concat(F.lit("[Source "), x[rank].cast("string"), F.lit("]: "), x[text]))
    made = shown.groupBy(by).agg(F.array_join(lines, "\n\n").alias("context"))
    return hits.select(by).distinct().join(made, by, "left").select(by, F.coalesce("context", F.lit(NOTHING_FOUND)).alias("context"))


def prompt(context_col: Column, question: Column) -> Column:
    return F.concat(F.lit("Context from documents:\n\n"), context_col, F.lit("\n\nQuestion: "), question)


def token_estimate(*texts: Column) -> Column:
    """Words of all texts times 1.3, cut to a whole number; null texts have no words."""
    total = F.lit(0)
    for t in texts:
        total = total + F.coalesce(word_count(t), F.lit(0))
    return F.floor(total * 1.3).cast("bigint")


def embed(df: DataFrame, text_col: str, dim: int = 64, out_col: str = "embedding") -> DataFrame:
    """``df`` with a vector of hashed character trigrams of length one; null for null, zero for empty text."""

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for t in texts:
                if t is None:
                    out.append(None)
                    continue
                v = np.zeros(dim)
                if t:
                    c = np.frombuffer(f" {t.lower()} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
                    with np.errstate(over="ignore"):
                        h = (c[:-2] * _ODD[0] + c[1:-1] * _ODD[1] + c[2:] * _ODD[2]) * _ODD[3]
                    h ^= h >> np.uint64(29)
                    v += np.bincount((h % np.uint64(dim)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0), dim)
                norm = np.linalg.norm(v)
                out.append((v / norm if norm else v).astype(np.float32))
            yield pd.Series(out)

    return df.withColumn(out_col, vectors(F.col(text_col)))
