"""Table loader: parquet files or folders named ``<table>.parquet`` under one directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def micros(column: str):
    """Microseconds since 1970 (UTC) of a TIMESTAMP or TIMESTAMP_NTZ column, null for null."""
    return F.unix_micros(F.col(column).cast("timestamp"))
