"""A job table: repeated requests, order of work, counts by state, retries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_requests(requests: DataFrame, key: str, seq: str) -> DataFrame:
    """One row per idempotency key: that of the smallest ``seq``; rows of null key are all kept."""
    cols = [c for c in requests.columns if c != key]
    first = requests.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*cols), F.struct(seq, F.xxhash64(*cols))).alias("row"))
    kept = first.select(key, *[F.col(f"row.{c}").alias(c) for c in cols])
    return kept.select(*requests.columns).unionByName(requests.filter(F.col(key).isNull()))


def work_order(jobs: DataFrame, priority: str, seq: str) -> list:
    """Higher priorities first, in order of arrival among equal ones; priorities below 1 (and null) share the last rank."""
    return [F.greatest(F.coalesce(F.col(priority), F.lit(0)), F.lit(0)).desc(), F.col(seq).asc()]


def counts_by_state(jobs: DataFrame, state: str, states: list[str]) -> DataFrame:
    """One row: ``total``, a count per state, and ``other`` for the rest, nulls included. Zeros for an empty table."""
    known = [F.count_if(F.col(state) == s).alias(s) for s in states]
    return jobs.agg(F.count(F.lit(1)).alias("total"), *known, F.count_if(~F.coalesce(F.col(state).isin(states), F.lit(False))).alias("other"))


def replay_attempts(events: DataFrame, most_attempts: int = 3) -> DataFrame:
    """``job_id, attempts, state`` from a log of ``job_id, seq, op`` (start, complete, fail, cancel) that was checked (``replay_jobs`` checks).

    The fold needs only counts and the last operation, so it is one aggregate: failed for good after ``most_attempts``
    starts, queued again before that. Unknown operations and null jobs are ignored.
    """
    known = events.filter(F.col("job_id").isNotNull() & F.col("op").isin("start", "complete", "fail", "cancel"))
    last = known.groupBy("job_id").agg(F.count_if(F.col("op") == "start").alias("attempts"), F.max_by("op", "seq").alias("op"))
    state = F.when(F.col("op") == "start", "processing").when(F.col("op") == "complete", "completed").when(F.col("op") == "cancel", "cancelled")
    return last.select("job_id", "attempts", state.otherwise(F.when(F.col("attempts") < most_attempts, "queued").otherwise("failed")).alias("state"))


def replay_jobs(log: DataFrame, most_attempts: int = 3) -> DataFrame:
    """``job_id, state, attempts, n_refused, queue_seq`` from a log of ``job_id, seq, op``, read in order of ``seq``.

    ``submit`` queues a job that isn't known; ``start`` needs a queued one and counts an attempt; ``complete`` needs one in
    work, else it is refused; ``fail`` puts it back at the tail of the queue (``queue_seq`` is where it stands) until its
    attempts are used up, whatever its state; ``give_up`` fails it for good; ``cancel`` always holds. What isn't allowed
    is refused and counted; unknown operations and null jobs are ignored. A partition is sorted and read once, so that a
    job with many rows needs no memory.
    """
    rows = log.filter(F.col("job_id").isNotNull() & F.col("op").isin("submit", "start", "complete", "fail", "give_up", "cancel")).select("job_id", F.col("seq").cast("bigint").alias("seq"), "op")
    laid = rows.repartition("job_id").sortWithinPartitions("job_id", "seq", "op")
    kind = rows.schema["job_id"].dataType.simpleString()
    names = ["job_id", "state", "attempts", "n_refused", "queue_seq"]

    def step(job: list, seq: int, op: str) -> None:
        state, attempts = job[1], job[2]
        if op == "submit" and state == "none" or op == "fail" and state != "none" and attempts < most_attempts:
            job[1], job[4] = "queued", seq
        elif op == "start" and state == "queued":
            job[1:3], job[4] = ["processing", attempts + 1], None
        elif op == "complete" and state == "processing":
            job[1] = "completed"
        elif op in ("fail", "give_up", "cancel") and state != "none":
            job[1], job[4] = "cancelled" if op == "cancel" else "failed", None
        else:
            job[3] += 1

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job = None

        def made(out: list) -> pa.RecordBatch:
            ids = pa.array([j[0] for j in out], id_type)
            return pa.RecordBatch.from_arrays([ids, pa.array([j[1] for j in out], pa.string()), *(pa.array([j[k] for j in out], pa.int64()) for k in (2, 3, 4))], names=names)

        id_type = pa.null()
        for batch in batches:
            out, id_type = [], batch.schema.field("job_id").type
            for key, seq, op in zip(*(batch.column(c).to_pylist() for c in ("job_id", "seq", "op"))):
                if job is None or job[0] != key:
                    if job is not None:
                        out.append(job)
                    job = [key, "none", 0, 0, None]
                step(job, seq, op)
            yield made(out)
        if job is not None:
            yield made([job])

    return laid.mapInArrow(replay, f"job_id {kind}, state string, attempts bigint, n_refused bigint, queue_seq bigint")


def dispatch(jobs: DataFrame, handlers: dict[str, Callable[[str | None], str]]) -> DataFrame:
    """``job_id, op, message`` for ``job_id, type, payload``: ``complete`` with the handler's result, or ``fail`` with the error; an unknown type fails."""

    @F.pandas_udf("struct<op: string, message: string>")
    def run(kinds: pd.Series, payloads: pd.Series) -> pd.DataFrame:
        out = []
        for kind, payload in zip(kinds, payloads):
            try:
                if kind not in handlers:
                    raise ValueError(f"unknown type {kind}")
                out.append(("complete", handlers[kind](payload)))
            except Exception as e:
                out.append(("fail", f"{type(e).__name__}: {e}"))
        return pd.DataFrame(out, columns=["op", "message"])

    return jobs.select("job_id", run("type", "payload").alias("r")).select("job_id", "r.op", "r.message")
