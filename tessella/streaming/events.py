"""Structured Streaming over usage events and messages (an extension: the same operators, continuously)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """Events from files as they arrive."""
    return spark.readStream.schema(schema).parquet(path)


def window_counts(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts and sums by window and type; rows later than `late` are dropped with their state."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def once(events: DataFrame, key: str = "event_id", late: str = "1 day") -> DataFrame:
    """Each event once, as long as repeats arrive within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def for_each_batch(stream: DataFrame, f: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Runs a batch operator, such as recommendation, on each micro-batch and appends to a table under its batch number."""

    def write(batch: DataFrame, number: int) -> None:
        f(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
