"""The most similar vectors of every vector: an inverted file of coarse centroids with product-quantised residuals.

1. Vectors that are equal are one class; classes are searched, and members get the result of theirs.
2. Centroids and residual codebooks are fitted on a bounded sample of the classes (smallest hashes), the centroids in two
   levels; every class is then indexed: by its nearest centroid, with the codes of its residual. The cells grow as
   2 * sqrt(n), so that a cell and the list of cells grow alike.
3. Every class probes the cells whose centroid is nearly as close as the nearest one. In a cell, tables of the
   products of the query with each codebook entry give the score of every code (asymmetric distance); the best of
   them are scored again on the vectors themselves, in double precision.
4. The best of all cells are ranked, ids expanded, and ties broken by the smaller id.

Cells are joined in blocks of bounded size: a cell with a third of all vectors becomes a grid of blocks. The driver
sees the sample and a count per cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brindle.llm.sampling import least_draws
from brindle.session import cut_lineage

#: Fitting looks at no more than this many vectors, or ``PER_CELL`` for each cell where that is more (as the square root
#: of the collection: 64 MB for 500 million vectors); indexing and searching at all.
SAMPLE, PER_CELL = 20_000, 6
BLOCK = 8_192
#: Vectors of the sample that the codebooks are fitted on.
CODED = 20_000


def _fit_kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int, unit: bool) -> np.ndarray:
    """Lloyd's iterations; empty clusters keep their centre; centres of length one if ``unit``."""
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        own = (x @ c.T - (0 if unit else (c * c).sum(1) / 2)).argmax(1)
        n = np.bincount(own, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
        if unit:
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c.astype(np.float32)


def _fit_cells(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """``k`` centroids of length one in two levels: about sqrt(k) groups, each with a share of the centroids by its size."""
    top = _fit_kmeans(x, max(1, int(np.sqrt(k))), rng, 10, unit=True)
    own = (x @ top.T).argmax(1)
    n = np.bincount(own, minlength=len(top))
    want = k * n / len(x)
    share = np.maximum(np.floor(want), n > 0).astype(np.int64)
    order = np.argsort(share - want, kind="stable")
    share[order[: max(0, k - share.sum())]] += 1
    share = np.minimum(share, n)
    c = np.concatenate([_fit_kmeans(x[own == g], int(share[g]), rng, 10, unit=True) for g in range(len(top)) if share[g]])
    for _ in range(2):  # across the borders of the groups, in blocks
        own = np.concatenate([(x[s : s + 2048] @ c.T).argmax(1) for s in range(0, len(x), 2048)])
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        length = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(length > 1e-12, total / np.maximum(length, 1e-12), c).astype(np.float32)
    return c


class Quantiser:
    """Coarse centroids and, per group of dimensions, a codebook of residuals."""

    def __init__(self, sample: np.ndarray, cells: int, groups: int, entries: int = 256, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.centroids = _fit_cells(sample, cells, rng)
        sample = sample[:CODED]
        rest = sample - self.centroids[(sample @ self.centroids.T).argmax(1)]
        self.groups = np.array_split(np.arange(sample.shape[1]), groups)
        self.books = [_fit_kmeans(rest[:, g], min(entries, max(1, len(sample))), rng, 6, unit=False) for g in self.groups]

    def cell(self, u: np.ndarray) -> np.ndarray:
        return (u @ self.centroids.T).argmax(1)

    def codes(self, u: np.ndarray, cell: np.ndarray) -> np.ndarray:
        rest = u - self.centroids[cell]
        return np.stack([(rest[:, g] @ b.T - (b * b).sum(1) / 2).argmax(1) for g, b in zip(self.groups, self.books)], 1).astype(np.uint8)

    def tables(self, q: np.ndarray) -> list[np.ndarray]:
        return [q[:, g] @ b.T for g, b in zip(self.groups, self.books)]

    def scores(self, q: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        out = np.repeat((q @ self.centroids[cell])[:, None], len(codes), 1)
        for t, c in zip(self.tables(q), codes.T):
            out += t[:, c]
        return out


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    # scaled first, so that neither huge nor tiny values over- or underflow
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable_vectors(df: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    """``id, embedding`` of the rows with an id and ``dim`` finite numbers that aren't all zero."""
    v = F.col("embedding")
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(vector_col).cast("array<float>").alias("embedding"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col("id").isNotNull() & (F.size(v) == dim) & finite & F.exists(v, lambda x: x != 0))


def most_similar(
    df: DataFrame, id_col: str, vector_col: str, dim: int = 64, k: int = 5, least_score: float = -1.0, cells: int | None = None, groups: int = 16, margin: float = 0.15, most_probes: int | None = None, depth: int = 64
) -> DataFrame:
    """``id, rank_no, other_id, score``: for every id the (at most) ``k`` other ids of the highest cosine.

    Scores are cosines in double precision, rounded to 6 decimals, of at least ``least_score``; the smaller id comes
    first among equal scores. Vectors of another length, with null, NaN or infinite numbers or all zero have no
    neighbours and are none; null ids don't count. A repeated row counts once; an id that has two different vectors has
    the neighbours of each. ``margin`` (radians), ``most_probes`` (by default one more than the fourth root of the cells, 6 at least)
    and ``depth`` (candidates per cell that are scored exactly, and all that tie with the last) trade accuracy for time. No more than ``k`` neighbours are listed, however many copies a vector has. An
    empty table gives no rows; other columns aren't read.
    """
    if not 1 <= k <= depth:
        raise ValueError("1 <= k <= depth must hold")
    spark = df.sparkSession
    rows = usable_vectors(df, id_col, vector_col, dim)

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.ascontiguousarray(b.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float32)).reshape(-1, dim) + np.float32(0)
            raw = [r.tobytes() for r in x]
            keys = pa.array([xxhash.xxh3_128_digest(r) for r in raw], pa.binary())
            yield pa.RecordBatch.from_arrays([keys, b.column("id"), pa.array(raw, pa.binary())], names=["key", "id", "v"])

    named = rows.mapInArrow(classes, "key binary, id string, v binary")
    members = cut_lineage(named.select("key", "id").distinct())
    vectors = cut_lineage(named.select("key", "v").dropDuplicates(["key"]))
    n = vectors.count()
    shape = "id string, rank_no int, other_id string, score double"
    if n == 0:
        return spark.createDataFrame([], shape)
    cells = cells or max(1, int(2 * np.sqrt(n)))
    sample = [r.v for r in least_draws(vectors, "key", n, max(SAMPLE, PER_CELL * cells)).collect()]
    u = _unit(np.frombuffer(b"".join(sample), np.float32).reshape(-1, dim)).astype(np.float32)
    probes = most_probes or max(6, int(np.ceil(cells**0.25)) + 1)
    quantiser = spark.sparkContext.broadcast(Quantiser(u, min(cells, len(u)), min(groups, dim)))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector in its own cell (own = true) and in each cell that it asks."""
        q = quantiser.value
        for b in batches:
            u = _unit(_vectors(b.column("v"), dim)).astype(np.float32)
            for s in range(0, len(u), 4096):
                p = np.arccos(np.clip(u[s : s + 4096] @ q.centroids.T, -1, 1))
                most = min(probes, p.shape[1])
                near = np.argpartition(p, most - 1, 1)[:, :most]
                angle = np.take_along_axis(p, near, 1)
                who, which = np.nonzero(angle <= angle.min(1, keepdims=True) + margin)
                own = p.argmin(1)
                take = np.concatenate([np.arange(len(own)), who]) + s
                cell = np.concatenate([own, near[who, which]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell.astype(np.int32)), pa.array(np.arange(len(take)) < len(own)), b.column("key").take(pa.array(take)), b.column("v").take(pa.array(take))],
                    names=["cell", "own", "key", "v"],
                )

    spread = vectors.mapInArrow(probe, "cell int, own boolean, key binary, v binary")
    counts = {(r.cell, r.own): r["count"] for r in spread.groupBy("cell", "own").count().collect()}  # a row per cell
    parts = np.ones((2, len(quantiser.value.centroids)), np.int64)
    for (cell, own), c in counts.items():
        parts[int(own), cell] = -(-c // BLOCK)
    most = spark.createDataFrame(pd.DataFrame({"cell": np.arange(parts.shape[1], dtype=np.int32), "asked": parts[1], "asking": parts[0]}))
    laid = spread.join(F.broadcast(most), "cell")
    mine, others = (F.when(F.col("own"), F.col(x)).otherwise(F.col(y)) for x, y in (("asked", "asking"), ("asking", "asked")))
    laid = laid.select("cell", "own", F.pmod(F.xxhash64("key"), mine).alias("m"), F.explode(F.sequence(F.lit(0).cast("bigint"), others - 1)).alias("o"), "key", "v")
    grid = laid.select("cell", F.when(F.col("own"), F.col("m")).otherwise(F.col("o")).alias("i"), F.when(F.col("own"), F.col("o")).otherwise(F.col("m")).alias("j"), "own", "key", "v")

    def search(group: tuple, rows: pa.Table) -> pa.Table:
        quant, cell = quantiser.value, group[0].as_py()
        asked, asking = rows.filter(rows.column("own")), rows.filter(pc.invert(rows.column("own")))
        names = ["key", "other", "score"]
        out = [[], [], []]
        if len(asked) and len(asking):
            index_keys, query_keys = asked.column("key").combine_chunks(), asking.column("key").combine_chunks()
            exact, q_exact = _unit(_vectors(asked.column("v"), dim)), _unit(_vectors(asking.column("v"), dim))
            codes = quant.codes(exact.astype(np.float32), np.full(len(exact), cell))
            deep = min(depth, len(exact))
            step = max(1, 4_000_000 // len(exact))
            for s in range(0, len(q_exact), step):
                q = q_exact[s : s + step]
                approx = quant.scores(q.astype(np.float32), cell, codes)
                # all whose codes tie with the last that is taken are taken
                edge = -np.partition(-approx, deep - 1, 1)[:, deep - 1]
                who, which = np.nonzero(approx >= edge[:, None])
                score = np.empty(len(who))
                for t in range(0, len(who), 65_536):
                    part = slice(t, t + 65_536)
                    score[part] = np.einsum("nd,nd->n", q[who[part]], exact[which[part]])
                score = np.round(score, 6)
                score = np.where(np.abs(score) > 1, np.sign(score), score)
                # all that tie with the k-th are kept: the ids decide later
                order = np.lexsort((-score, who))
                who, which, score = who[order], which[order], score[order]
                size = np.bincount(who, minlength=len(q))
                edge = score[np.cumsum(size) - size + np.minimum(k, size - 1)]
                keep = (score >= edge[who]) & (score >= least_score)
                out[0].append(who[keep] + s)
                out[1].append(which[keep])
                out[2].append(score[keep])
            a, b, c = (np.concatenate(x) for x in out)
            return pa.Table.from_arrays([query_keys.take(pa.array(a)), index_keys.take(pa.array(b)), pa.array(c)], names=names).combine_chunks()
        return pa.Table.from_arrays([pa.array([], pa.binary()), pa.array([], pa.binary()), pa.array([], pa.float64())], names=names)

    found = grid.groupBy("cell", "i", "j").applyInArrow(search, "key binary, other binary, score double")
    found = found.filter("key <> other").unionByName(vectors.select("key", F.col("key").alias("other"), F.lit(1.0).alias("score")))

    # the k + 1 smallest ids of a class are all that a list can need
    by_id = W.partitionBy("key").orderBy("id")
    short = members.withColumn("no", F.row_number().over(by_id)).filter(F.col("no") <= k + 1).select(F.col("key").alias("other"), F.col("id").alias("other_id"))
    best = W.partitionBy("key").orderBy(F.desc("score"), "other_id")
    listed = found.filter(F.col("score") >= least_score).join(short, "other").withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k + 1)
    lists = listed.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("place", "other_id", "score"))).alias("near"))
    own = members.join(lists, "key").select("id", F.slice(F.filter("near", lambda x: x["other_id"] != F.col("id")), 1, k).alias("near"))
    out = own.select("id", F.posexplode("near").alias("no", "x"))
    return out.select("id", (F.col("no") + 1).alias("rank_no"), F.col("x.other_id").alias("other_id"), F.col("x.score").alias("score"))
