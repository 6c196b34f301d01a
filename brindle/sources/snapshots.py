"""A keyed table in a folder: every change writes a new snapshot, and a pointer names the current one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from brindle.operators.vectors import delete_rows, upsert


class SnapshotTable:
    """Readers keep the snapshot they opened; a writer that fails leaves the pointer where it was. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str):
        self.spark, self.path, self.key, self.schema = spark, path.rstrip("/"), key, schema

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _current(self) -> str | None:
        jvm, fs = self._fs()
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        if not fs.exists(folder):
            return None
        # pointers are numbered and never rewritten, so that a reader sees an old or a new one, not half of one
        found = sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName().startswith("pointer-"))
        return found[-1] if found else None

    def read(self) -> DataFrame:
        now = self._current()
        if now is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/data-{now.split('-', 2)[2]}")

    def write(self, rows: DataFrame) -> None:
        now, name = self._current(), uuid.uuid4().hex
        number = int(now.split("-")[1]) + 1 if now else 0
        rows.write.parquet(f"{self.path}/data-{name}")
        jvm, fs = self._fs()
        fs.create(jvm.org.apache.hadoop.fs.Path(f"{self.path}/pointer-{number:012d}-{name}"), False).close()

    def upsert(self, changes: DataFrame, version: str) -> None:
        """Inserts or replaces by key; the highest ``version`` of a key wins."""
        self.write(upsert(self.read(), changes, self.key, version))

    def delete(self, ids: DataFrame) -> int:
        """Removes keys; returns how many rows there were of them."""
        old = self.read()
        new = delete_rows(old, ids, self.key)
        n = old.count()
        self.write(new)
        return n - self.count()

    def count(self) -> int:
        return self.read().count()

    def clear(self) -> int:
        n = self.count()
        self.write(self.read().limit(0))
        return n
