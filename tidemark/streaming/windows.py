"""Structured Streaming: windows over event time, exactly-once segments, deduplication."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def event_stream(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    """A stream of the Parquet files that appear under a folder or pattern; ts is its event time."""
    reader = spark.readStream.schema(schema)
    raw = (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str, late: str, *keys: str) -> DataFrame:
    return _windowed(events, F.window("ts", width), late, keys)


def sliding(events: DataFrame, width: str, step: str, late: str, *keys: str) -> DataFrame:
    return _windowed(events, F.window("ts", width, step), late, keys)


def sessions(events: DataFrame, gap: str, late: str, *keys: str) -> DataFrame:
    return _windowed(events, F.session_window("ts", gap), late, keys)


def _windowed(events: DataFrame, window: Column, late: str, keys) -> DataFrame:
    out = events.withWatermark("ts", late).groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def first_seen(events: DataFrame, key: str, late: str) -> DataFrame:
    """One event a key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def append_segments(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Append all that is there to Parquet segments, each record exactly once, and stop."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def each_batch(stream: DataFrame, checkpoint: str, f: Callable[[DataFrame, int], None]) -> None:
    stream.writeStream.foreachBatch(f).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def drain(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Run a stream over all that is there and read what it wrote."""
    append_segments(stream, out, checkpoint)
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
