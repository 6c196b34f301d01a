"""Bounded samples for fitting: the rows of the smallest hashes, found without sending more than the sample to the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unit_draw(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on key and seed alone, hence the same after a lost task or another partitioning."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11).cast("double") / float(1 << 53)


def least_draws(rows: DataFrame, key: str, n_rows: int, most: int, seed: int = 3) -> DataFrame:
    """At most ``most`` of ``n_rows`` rows, those of the smallest draws by ``key``.

    A threshold on the draw leaves about a tenth more rows than are wanted, wherever they lie; only these are sorted
    and limited. So no more than that reaches the driver, whatever the number of partitions.
    """
    draw = unit_draw(F.col(key), seed)
    share = 1.1 * most / max(1, n_rows) + 1e-12
    near = rows if share >= 1 else rows.filter(draw < share)
    return near.withColumn("_draw", draw).orderBy("_draw", key).limit(most).drop("_draw")
