"""Connected components by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.session import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the smallest node it knows."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links its smaller neighbours and itself to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, component`` for the nodes of ``edges`` (its first two columns); a component is its smallest node.

    Null ends and loops don't link, repeated edges count once, no edges give no rows. A round costs two joins on the
    node; the minimum is aggregated before it is joined, so a node with very many links is a skewed join that AQE
    splits, never a list in one task. Rounds grow with the logarithm of the longest path; each is written to the
    checkpoint folder, so a lost executor costs one round.
    """
    u, v = edges.columns[:2]
    now = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).filter("u is not null and v is not null")
    nodes = now.select("u").union(now.select("v")).distinct().withColumnRenamed("u", "node")
    now = cut_lineage(now.filter("u <> v").distinct())
    sign = None
    for _ in range(most_rounds):
        now = cut_lineage(_small_star(_large_star(now)))
        last, sign = sign, now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sign == last:
            break
    else:
        raise RuntimeError("the components didn't settle")
    return nodes.join(now.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
