"""Incremental processing: new files once, event-time windows and sessions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tactus.streaming import sink


def run_new(spark: SparkSession, source: str, schema: T.StructType, out: str, checkpoint: str, stage: Callable[[DataFrame], DataFrame], key: str, writer: str = "new") -> StreamingQuery:
    """Apply stage to the rows of files not seen before, skipping keys that the output has; ends when all is done.

    A batch that is done twice leaves one copy: what its first attempt wrote is not among the keys that the output has.
    """
    kept = stage(spark.createDataFrame([], schema)).schema

    def fresh(rows: DataFrame, number: int) -> DataFrame:
        there = sink.read(spark, out, kept, but=(writer, number)).select(key).distinct()
        return stage(rows.join(there, key, "left_anti"))

    stream = spark.readStream.schema(schema).parquet(source)
    return sink.append_once(stream, out, checkpoint, writer, make=fresh)


def hopping(events: DataFrame, time: str, keys: list[str], length: str, step: str, aggregates: list[Column], late: str | None = None) -> DataFrame:
    """Aggregates over hopping windows (column window); with late, as a stream that tolerates so much delay."""
    rows = events.withWatermark(time, late) if late else events
    return rows.groupBy(F.window(time, length, step), *keys).agg(*aggregates)


def sessions(events: DataFrame, time: str, keys: list[str], gap: str, aggregates: list[Column], late: str | None = None) -> DataFrame:
    rows = events.withWatermark(time, late) if late else events
    return rows.groupBy(F.session_window(time, gap).alias("session"), *keys).agg(*aggregates)
