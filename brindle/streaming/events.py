"""Structured Streaming over audit events: windowed counts with late data, deduplication, an append-only log."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def deduplicated(events: DataFrame, key: str, time: str, lateness: str = "1 hour") -> DataFrame:
    """The first row of each key; a repeat within ``lateness`` of it is dropped, and then the key is forgotten."""
    return events.withColumn(time, F.col(time).cast("timestamp")).filter(F.col(time).isNotNull()).withWatermark(time, lateness).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, time: str, by: list[str], width: str = "1 hour", slide: str | None = None, lateness: str = "1 hour") -> DataFrame:
    """``window_start, window_end, *by, n``: tumbling or sliding windows, late rows counted while the watermark allows."""
    rows = events.withColumn(time, F.col(time).cast("timestamp")).filter(F.col(time).isNotNull()).withWatermark(time, lateness)
    window = F.window(time, width, slide) if slide else F.window(time, width)
    counted = rows.groupBy(window.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n")


def append_log(events: DataFrame, path: str, checkpoint: str, time: str = "timestamp"):
    """Appends a stream to parquet by day; exactly once by the checkpoint. Returns the query, run to the end of the input."""
    rows = events.withColumn("day", F.to_date(time))
    q = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("day").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def fan_out(events: DataFrame, sinks: list, checkpoint: str, failures: list | None = None):
    """Writes each micro-batch to all sinks (functions of a DataFrame and its number); the batch is read once.

    A sink that fails doesn't keep the others from their batch; ``failures`` takes (batch, sink, error) of each.
    """

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for place, sink in enumerate(sinks):
                try:
                    sink(batch, number)
                except Exception as e:
                    if failures is not None:
                        failures.append((number, place, f"{type(e).__name__}: {e}"))
        finally:
            batch.unpersist()

    q = events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def json_log(events: DataFrame, path: str, checkpoint: str, most_rows: int = 100_000):
    """Appends a stream as JSON lines, in files of at most ``most_rows``; exactly once by the checkpoint."""
    q = events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).option("maxRecordsPerFile", most_rows).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def log_sink(name: str, level: int = 20, most: int = 1_000):
    """A sink for ``fan_out`` that writes up to ``most`` rows of a batch, and how many there are, to the Python log ``name``."""

    def sink(batch: DataFrame, number: int) -> None:
        logger = logging.getLogger(name)
        if logger.isEnabledFor(level):
            logger.log(level, "batch %d: %d rows", number, batch.count())
            for line in batch.limit(most).toJSON().collect():
                logger.log(level, line)

    return sink


def no_sink(batch: DataFrame, number: int) -> None:
    """A sink that computes its batch and keeps nothing."""
    batch.write.format("noop").mode("append").save()


def event_stream_lines(kind, payload):
    """One server-sent event: its data as JSON on one line and a blank line after it."""
    return F.concat(F.lit("data: "), F.to_json(F.struct(kind.alias("event"), payload.alias("data"))), F.lit("\n\n"))


def metrics_text(metrics: DataFrame, name: str, labels: list[str], value: str) -> DataFrame:
    """``line`` of each row in the text form of metrics: ``name{label="value",...} number``; quotes and line ends are escaped, nulls empty."""
    escaped = lambda c: F.replace(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    pairs = [F.concat(F.lit(f'{c}="'), escaped(c), F.lit('"')) for c in labels]
    return metrics.select(F.concat(F.lit(name + "{"), F.concat_ws(",", *pairs), F.lit("} "), F.col(value).cast("string")).alias("line"))


def run_to_table(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all input there is and reads back what it wrote under ``path``."""
    spark = stream.sparkSession
    if mode == "complete":

        def save(batch: DataFrame, _: int) -> None:
            batch.write.mode("overwrite").parquet(f"{path}/out")

        q = stream.writeStream.foreachBatch(save).outputMode("complete").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    else:
        q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


#: The time of the row that closes a stream.
CLOSING = "2999-01-01 00:00:00"


def closed_stream(spark: SparkSession, events: DataFrame, time: str, path: str, plan) -> DataFrame:
    """Runs ``plan`` (a function of a stream with a watermark) over all input there is and gives everything it would ever emit.

    In append mode what is younger than the watermark stays in the state. So when the input is read, a closing row, all
    null but for a time far ahead, comes as a second source of the same query: it moves the watermark past all events. What
    is made of that row itself is never emitted, as no watermark passes it. ``plan`` must not filter it out.
    """
    end, kinds = f"{path}/end", events.schema
    spark.createDataFrame([], kinds).write.parquet(end)
    closing = spark.readStream.schema(kinds).parquet(end)
    stream = plan(events.union(closing))

    def run() -> None:
        q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()

    run()
    row = spark.range(1).select(*[(F.lit(CLOSING) if f.name == time else F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds.fields])
    row.write.mode("append").parquet(end)
    run()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")
