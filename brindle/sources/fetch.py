"""Fetching a table of sources: routed by type, retried, checked by size and digest; errors are rows, not exceptions."""

from __future__ import annotations

import hashlib
import ssl
import time
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path
from urllib.parse import unquote, urlencode, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Fetcher = Callable[[str], bytes]


def fetch_local(address: str) -> bytes:
    parts = urlsplit(address)
    return Path(unquote(parts.path) if parts.scheme == "file" else address).read_bytes()


#: Methods that may be repeated, and statuses after which it helps.
REPEATABLE, PASSING = ("GET", "HEAD", "OPTIONS"), (429, 500, 502, 503, 504)


@dataclass(frozen=True)
class HttpFetcher:
    """Requests of one kind; as a fetcher, its body for an address. Redirects are followed; a status of 400 or more is an error.

    ``most_wait`` seconds bound the repeats of a request that failed in passing; methods that change something are repeated
    only with ``repeat_all``. ``token`` gives the current bearer token.
    """

    method: str = "GET"
    headers: tuple[tuple[str, str], ...] = ()
    params: tuple[tuple[str, str], ...] = ()
    body: bytes | None = None
    timeout: float = 30.0
    token: Callable[[], str] | None = None
    repeat_all: bool = False
    most_wait: float = 60.0
    verify: bool = True

    def __call__(self, address: str) -> bytes:
        if self.params:
            address += ("&" if "?" in address else "?") + urlencode(self.params)
        headers = {**dict(self.headers), **({"Authorization": f"Bearer {self.token()}"} if self.token else {})}
        request = urllib.request.Request(address, data=self.body, headers=headers, method=self.method)
        context = None if self.verify or not address.startswith("https:") else ssl._create_unverified_context()
        waited, pause = 0.0, 0.5
        while True:
            try:
                with urllib.request.urlopen(request, timeout=self.timeout, context=context) as r:
                    return r.read()
            except OSError as e:  # all that urllib raises, statuses included
                passing = getattr(e, "code", 503) in PASSING and (self.repeat_all or self.method in REPEATABLE)
                if not passing or waited + pause > self.most_wait:
                    raise
                time.sleep(pause)
                waited, pause = waited + pause, pause * 2


class CachedToken:
    """The token that ``ask`` gives with its seconds of life, asked for again a minute before its end."""

    def __init__(self, ask: Callable[[], tuple[str, float]], clock: Callable[[], float] = time.time, early: float = 60.0):
        self.ask, self.clock, self.early = ask, clock, early
        self.token, self.end = None, 0.0

    def __call__(self) -> str:
        if self.token is None or self.clock() >= self.end - self.early:
            self.token, life = self.ask()
            self.end = self.clock() + life
        return self.token


#: One request; the attempts are those of ``fetch``.
fetch_http = HttpFetcher(most_wait=0.0)


def fetch_hadoop(spark: SparkSession, address: str) -> bytes:
    """A file of any system that Hadoop knows (``s3a:``, ``hdfs:``, …), read on the driver; tables of them are read by ``files.read_files``."""
    return spark.read.format("binaryFile").load(address).first().content


def copy_files(spark: SparkSession, pairs: list[tuple[str, str]], move: bool = False) -> list[tuple[str, str, str | None]]:
    """(from, to, error) of each file or folder that Hadoop copied or moved; a target that exists is an error, and none is overwritten."""
    jvm, conf, out = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), []
    for source, target in pairs:
        a, b = (jvm.org.apache.hadoop.fs.Path(x) for x in (source, target))
        try:
            if b.getFileSystem(conf).exists(b):
                raise ValueError("the target exists")
            done = jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, move, conf)
            out.append((source, target, None if done else "not copied"))
        except Exception as e:
            out.append((source, target, str(e).splitlines()[0]))
    return out


def attempt_events(fetched: DataFrame) -> DataFrame:
    """``source_id, attempt, event_type, result``: a row per attempt of ``fetch``: all but the last failed, the last as the source did."""
    rows = fetched.filter("attempts > 0").select("source_id", "success", "attempts", F.explode(F.sequence(F.lit(1), F.col("attempts"))).alias("attempt"))
    good = (F.col("attempt") == F.col("attempts")) & F.col("success")
    kind = F.when(good, "download.success").when(F.col("attempt") < F.col("attempts"), "download.retry").otherwise("download.failure")
    return rows.select("source_id", "attempt", kind.alias("event_type"), F.when(good, "success").otherwise("failure").alias("result"))


FETCHERS: dict[str, Fetcher] = {"local": fetch_local, "http": fetch_http, "ftp": fetch_http}


def fetch(tasks: DataFrame, fetchers: dict[str, Fetcher] | None = None, most_retries: int = 3, wait: float = 1.0) -> DataFrame:
    """``source_id, success, attempts, size_bytes, sha256, content, error`` for ``source_id, source_type, address``.

    One row per source: of repeated ids the one of the greatest (type, address) is fetched, null ids are dropped. An
    unknown type is an error without an attempt. Failed attempts are repeated ``most_retries`` times, after ``wait``,
    twice that, and so on. Where Spark repeats a task, its sources are fetched again.
    """
    known = dict(fetchers or FETCHERS)
    one = tasks.filter(F.col("source_id").isNotNull()).groupBy(F.col("source_id").cast("string").alias("source_id")).agg(F.max(F.struct("source_type", "address")).alias("t"))
    rows = one.select("source_id", "t.source_type", "t.address")
    names = ["source_id", "success", "attempts", "size_bytes", "sha256", "content", "error"]
    types = [pa.string(), pa.bool_(), pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.string()]

    def one_source(kind: str | None, address: str | None) -> tuple:
        if kind not in known or address is None:
            return False, 0, None, None, None, f"no way to fetch {kind}"
        for attempt in range(1, most_retries + 2):
            try:
                data = known[kind](address)
                return True, attempt, len(data), hashlib.sha256(data).hexdigest(), data, None
            except Exception as e:
                error = f"{type(e).__name__}: {e}"
                if attempt <= most_retries:
                    time.sleep(wait * 2 ** (attempt - 1))
        return False, most_retries + 1, None, None, None, error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, kind, address in zip(*(batch.column(c).to_pylist() for c in ("source_id", "source_type", "address"))):
                row = (key, *one_source(kind, address))
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names=names)

    return rows.mapInArrow(run, "source_id string, success boolean, attempts int, size_bytes long, sha256 string, content binary, error string")


def verified(fetched: DataFrame, expected: DataFrame) -> DataFrame:
    """``source_id, intact``: success, and size and digest as in ``expected`` (``source_id, size_bytes, sha256``)."""
    want = expected.select(F.col("source_id").alias("id"), F.col("size_bytes").alias("n"), F.col("sha256").alias("digest"))
    both = want.join(fetched, F.col("id") == F.col("source_id"), "left")
    intact = F.coalesce(F.col("success") & (F.col("size_bytes") == F.col("n")) & (F.col("sha256") == F.col("digest")), F.lit(False))
    return both.select(F.col("id").alias("source_id"), intact.alias("intact"))


def summary(fetched: DataFrame) -> DataFrame:
    """One row: ``total, succeeded, failed, retried, bytes``; zeros for an empty table."""
    return fetched.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("success").alias("succeeded"), F.count_if(~F.col("success")).alias("failed"),
        F.count_if(F.col("attempts") > 1).alias("retried"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"),
    )
