"""Sliding-window request limits: offered load, and the exact log of accepted requests."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def offered_load(events: DataFrame, key: str, time_us: str, window_us: int) -> DataFrame:
    """``events`` with ``offered``: requests of the key in the window that ends with each, itself included.

    Time is cut into slices as long as the window; a request counts in its own slice and, as one of those before, in the
    next. So a key with a third of all requests is spread over its slices. Rows without time have no window: null.
    """
    rows = events.withColumn("_slice", F.expr(f"{time_us} div {window_us}"))
    carried = rows.filter(F.col(time_us).isNotNull()).withColumn("_slice", F.col("_slice") + 1).withColumn("_own", F.lit(False))
    w = W.partitionBy(key, "_slice").orderBy(time_us).rangeBetween(-window_us, 0)
    both = rows.withColumn("_own", F.lit(True)).unionByName(carried).withColumn("offered", F.when(F.col(time_us).isNotNull(), F.count(F.lit(1)).over(w)))
    return both.filter("_own").drop("_own", "_slice")


def limit_requests(events: DataFrame, key: str, time_us: str, id_col: str, window_us: int, most: int) -> DataFrame:
    """``key, id, time_us, accepted``: a request is accepted if fewer than ``most`` were accepted in the window before it.

    Rejected requests don't count, so each decision needs those before it: a partition is sorted by key, time and id
    and read once, keeping at most ``most`` times. Null keys share one limit; null times are dropped.
    """
    rows = events.select(F.col(key).alias("key"), F.col(id_col).alias("id"), F.col(time_us).alias("time_us")).filter("time_us is not null")
    laid = rows.repartition("key").sortWithinPartitions("key", "time_us", "id")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, taken = object(), deque()
        for batch in batches:
            out = []
            for k, t in zip(batch.column("key").to_pylist(), batch.column("time_us").to_pylist()):
                if k != now:
                    now, taken = k, deque()
                while taken and taken[0] < t - window_us:
                    taken.popleft()
                out.append(len(taken) < most)
                if out[-1]:
                    taken.append(t)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.bool_())], names=["key", "id", "time_us", "accepted"])

    return laid.mapInArrow(decide, f"key {kinds['key']}, id {kinds['id']}, time_us {kinds['time_us']}, accepted boolean")
