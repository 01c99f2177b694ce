"""Appends that may be repeated: every batch of a stream has a place of its own, written whole or not at all.

A batch goes to <folder>/writer=<name>/batch=<number>, replacing what an earlier attempt left there. Spark repeats a batch under its
number after a failure, so two attempts leave one copy. A batch counts once its folder has the marker that Spark's
committer writes last; readers see those alone. Writers of different names don't disturb each other; two streams
must not share a name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tactus.session import hadoop_path
from tactus.sources.sinks import rounded_timings

MARKER = "_SUCCESS"


def write_batch(rows: DataFrame, folder: str, writer: str, number: int, format: str = "parquet") -> None:
    """One batch in its place."""
    marked = rows.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true")
    marked.format(format).save(f"{folder}/writer={writer}/batch={number}")


def committed(spark: SparkSession, folder: str) -> list[tuple[str, int, str]]:
    """(writer, batch, path) of the whole batches in a folder, in order."""
    path, store = hadoop_path(spark, f"{folder}/writer=*/batch=*/{MARKER}")
    found = []
    for status in store.globStatus(path) or []:
        place = status.getPath().getParent()
        found.append((place.getParent().getName().removeprefix("writer="), int(place.getName().removeprefix("batch=")), place.toString()))
    return sorted(found)


def read(spark: SparkSession, folder: str, schema: T.StructType | str, format: str = "parquet", but: tuple[str, int] | None = None) -> DataFrame:
    """Rows of the whole batches (all but one, where named), with writer and batch; empty without any."""
    paths = [p for w, n, p in committed(spark, folder) if (w, n) != but]
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    whole = T.StructType([*schema.fields, T.StructField("writer", T.StringType()), T.StructField("batch", T.LongType())])
    if not paths:
        return spark.createDataFrame([], whole)
    return spark.read.schema(whole).option("basePath", folder).format(format).load(paths)


def append_once(stream: DataFrame, folder: str, checkpoint: str, writer: str, format: str = "parquet", make: Callable[[DataFrame, int], DataFrame] | None = None, **trigger) -> StreamingQuery:
    """Start appending a stream's batches, each once; make: what to write of a batch, given its number. trigger: as in DataStreamWriter.trigger."""

    def batch(rows: DataFrame, number: int) -> None:
        write_batch(rows if make is None else make(rows, number), folder, writer, number, format)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def append_timings(stream: DataFrame, folder: str, checkpoint: str, writer: str, **trigger) -> StreamingQuery:
    """Timing rows as JSON lines, times at two decimals, extra keys as they are; each batch once."""
    return append_once(rounded_timings(stream), folder, checkpoint, writer, "text", **trigger)
