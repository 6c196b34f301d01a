"""A collection of vectors: metadata filters, exact nearest neighbours, upsert and delete.

Exact search takes a stated set of queries against all rows: queries and rows meet as a grid of blocks of bounded size,
each block keeps its k best per query by a matrix product, and only those are ranked together. Nothing goes to the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: About so many queries and rows meet in one block of the grid.
QUERY_BLOCK, ROW_BLOCK = 4_096, 65_536
METRICS = {"cosine": "cosine", "l2": "l2", "euclidean": "l2", "ip": "ip", "dot": "ip"}


def metadata_filter(where: dict | None, lookup=F.col) -> Column:
    """A filter dictionary as a predicate for ``filter``. A missing or null field matches nothing, whatever the operator.

    ``{"a": 1, "b": {"$gte": 2}}`` means both; operators are $eq $ne $gt $gte $lt $lte $in $nin, and $and / $or over
    lists of filters. Plain columns stay visible to the scan, so that the predicate is pushed down.
    """
    compare = {
        "$eq": lambda c, v: c == v, "$ne": lambda c, v: c != v, "$gt": lambda c, v: c > v, "$gte": lambda c, v: c >= v,
        "$lt": lambda c, v: c < v, "$lte": lambda c, v: c <= v, "$in": lambda c, v: c.isin(list(v)), "$nin": lambda c, v: ~c.isin(list(v)),
    }
    whole = F.lit(True)
    for key, value in (where or {}).items():
        if key in ("$and", "$or"):
            if not value:
                raise ValueError(f"{key} needs at least one filter")
            parts = [metadata_filter(w, lookup) for w in value]
            one = parts[0]
            for p in parts[1:]:
                one = (one & p) if key == "$and" else (one | p)
        else:
            one = F.lit(True)
            for op, v in (value if isinstance(value, dict) else {"$eq": value}).items():
                if op not in compare:
                    raise ValueError(f"unknown operator {op}")
                one = one & compare[op](lookup(key), v)
        whole = whole & one
    return whole


def _distances(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    dot = q @ x.T
    if metric == "ip":
        return 1 - dot
    if metric == "l2":
        return (q * q).sum(1)[:, None] - 2 * dot + (x * x).sum(1)[None, :]
    norm = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :]
    return 1 - np.divide(dot, norm, out=np.zeros_like(dot), where=norm > 0)


def _blocked(df: DataFrame, by: str, size: int, name: str) -> DataFrame:
    """``w, name``: how many blocks of about ``size`` rows each group has; null groups are left out."""
    return df.groupBy(F.col(by).alias("w")).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name)).filter("w is not null")


def nearest(
    collection: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine", where: dict | None = None, id_col: str = "vec_id", vector_col: str = "embedding", within: str | None = None
) -> DataFrame:
    """``query_id, rank, id, distance, score`` of the ``k`` nearest rows of each query.

    Distances are 1 - cosine (1 if a vector is zero), squared Euclidean or 1 - dot product, in double precision, rounded
    to 6 decimals; equal ones rank by the smaller id; ``score = 1 / (1 + distance)``, null where that divides by zero.
    Unknown metrics mean cosine. Null vectors, null ids and vectors of another length than the query are no
    neighbours; repeated rows count as often as they are there. With ``within``, a column of both tables, a query sees
    the rows of its own value only (a user's rows, say), and none if that is null; a value with a third of all rows is
    cut into as many blocks as it needs. An empty collection or query set gives no rows.
    """
    if k < 1:
        raise ValueError("k must be positive")
    kind = METRICS.get(metric, "cosine")
    group = F.col(within) if within else F.lit(0)
    sides = [
        df.select(group.alias("w"), F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter("w is not null and id is not null and v is not null")
        for df in (collection.filter(metadata_filter(where)), queries)
    ]
    rows, asked = sides
    kinds = rows.schema["id"].dataType, asked.schema["id"].dataType
    parts = _blocked(rows, "w", ROW_BLOCK, "n").join(_blocked(asked, "w", QUERY_BLOCK, "m"), "w")
    own = lambda n: F.pmod(F.xxhash64("id", "v"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    none = lambda x: F.lit(None).cast(kinds[x])
    grid = rows.join(parts, "w").select("w", own("n").alias("i"), every("m").alias("j"), F.col("id"), none(1).alias("query_id"), F.lit(False).alias("asks"), "v")
    grid = grid.union(asked.join(parts, "w").select("w", every("n").alias("i"), own("m").alias("j"), none(0), F.col("id"), F.lit(True), "v"))
    shape = f"query_id {kinds[1].simpleString()}, id {kinds[0].simpleString()}, distance double"
    found = grid.groupBy("w", "i", "j").applyInArrow(_searcher(k, kind, kinds), shape)
    place = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "id"))
    ranked = found.withColumn("rank", place).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("bigint").alias("rank"), "id", "distance", F.round(F.try_divide(F.lit(1.0), 1 + F.col("distance")), 6).alias("score"))


def _searcher(k: int, metric: str, kinds: tuple):
    from pyspark.sql.pandas.types import to_arrow_type

    id_type, query_type = (to_arrow_type(t) for t in kinds)

    def by_length(side: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        out: dict[int, list] = {}
        for at, v in enumerate(side.column("v").to_pylist()):
            if v and None not in v:
                out.setdefault(len(v), []).append((at, v))
        return {n: (np.array([a for a, _ in x]), np.array([v for _, v in x], float)) for n, x in out.items()}

    def search(table: pa.Table) -> pa.Table:
        rows, asked = table.filter(pc.invert(table.column("asks"))), table.filter(table.column("asks"))
        rows = rows.sort_by("id")  # so that of equal distances the smaller ids come first
        ids, keys, out = rows.column("id").combine_chunks(), asked.column("query_id").combine_chunks(), [[], [], []]
        held = by_length(rows)
        for n, (who, q) in by_length(asked).items():
            if n not in held:
                continue
            which, x = held[n]
            most = min(k, len(x))
            step = max(1, 4_000_000 // len(x))
            for s in range(0, len(q), step):
                d = np.round(_distances(q[s : s + step], x, metric), 6) + 0.0
                edge = np.partition(d, most - 1, 1)[:, most - 1 : most]
                ties = d == edge
                keep = (d < edge) | (ties & (np.cumsum(ties, 1) <= most - (d < edge).sum(1, keepdims=True)))
                a, b = np.nonzero(keep)
                for column, y in zip(out, (who[s + a], which[b], d[a, b])):
                    column.append(y)
        a, b, d = (np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(out, (np.int64, np.int64, float)))
        return pa.table({"query_id": keys.take(pa.array(a)).cast(query_type), "id": ids.take(pa.array(b)).cast(id_type), "distance": pa.array(d)})

    return search


def upsert(current: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """The rows of both with one row per key: the change of the highest ``version``, else the current row.

    ``changes`` has the columns of ``current`` and ``version``; rows of equal key and version are decided by their
    values, so that the result doesn't depend on order. Null keys are dropped. The changes are aggregated before they
    meet the collection, which is shuffled once.
    """
    cols = [c for c in current.columns if c != key]
    last = changes.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(version, F.xxhash64(*cols))).alias("new"))
    kept = current.filter(F.col(key).isNotNull()).join(last.select(key), key, "left_anti")
    return kept.select(key, *cols).unionByName(last.select(key, *[F.col(f"new.{c}").alias(c) for c in cols]))


def delete_rows(current: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """``current`` without the keys of ``ids`` (its first column); unknown, repeated and null ids do nothing."""
    gone = ids.select(F.col(ids.columns[0]).alias(key)).filter(F.col(key).isNotNull())
    return current.join(gone, key, "left_anti")


def cosine_of_shared_length(a: Column, b: Column) -> Column:
    """Cosine over the first numbers of both vectors, as many as the shorter has; 0 if either is zero there, null for null."""
    n = F.least(F.size(a), F.size(b))
    x, y = (F.transform(F.slice(v, F.lit(1), n), lambda e: e.cast("double")) for v in (a, b))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, e: s + e)
    norm = F.sqrt(total(F.transform(x, lambda e: e * e))) * F.sqrt(total(F.transform(y, lambda e: e * e)))
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(norm == 0, 0.0).otherwise(total(F.zip_with(x, y, lambda p, q: p * q)) / norm)
