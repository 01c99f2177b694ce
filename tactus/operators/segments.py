"""Segments between boundaries, islands of a flag, and labels of segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def seconds(frame: Column, hop: int = 441, rate: int = 44100) -> Column:
    return frame * hop / rate


def segment_ids(df: DataFrame, track: str, frame: str, boundary: Column) -> DataFrame:
    """Adds segment: how many boundaries after frame 0 lie at or before the frame."""
    so_far = W.partitionBy(track).orderBy(frame).rowsBetween(W.unboundedPreceding, W.currentRow)
    starts = F.when(boundary & (F.col(frame) > 0), 1).otherwise(0)
    return df.withColumn("segment", F.sum(starts).over(so_far).cast("bigint"))


def segments(df: DataFrame, track: str, frame: str) -> DataFrame:
    """(track, segment, start, end) as frames, end exclusive; the first starts at 0, the last ends with the track."""
    return df.groupBy(track, "segment").agg(F.min(frame).alias("start"), (F.max(frame) + 1).alias("end"))


def argmax(array: Column) -> Column:
    """Index from 0 of the first largest entry."""
    return (F.array_position(array, F.array_max(array)) - 1).cast("bigint")


def segment_labels(df: DataFrame, track: str, classes: list[str]) -> DataFrame:
    """Per segment the class with the largest mean probability (first on ties). classes: columns in class order."""
    means = df.groupBy(track, "segment").agg(*(F.avg(c).alias(c) for c in classes))
    return means.select(track, "segment", argmax(F.array(*classes)).alias("label_id"))


def islands(df: DataFrame, track: str, frame: str, flag: Column) -> DataFrame:
    """Rows where flag holds, with island: the number of its run in the track, from 1."""
    order = W.partitionBy(track).orderBy(frame)
    enters = flag & ~F.coalesce(F.lag(flag).over(order), F.lit(False))
    marked = df.withColumns({"_in": flag, "island": F.sum(F.when(enters, 1).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, 0)).cast("bigint")})
    return marked.where("_in").drop("_in")


def island_peaks(df: DataFrame, track: str, frame: str, height: Column) -> DataFrame:
    """(track, island, start, end, peak): end exclusive; peak is the first frame of the greatest height."""
    return df.groupBy(track, "island").agg(
        F.min(frame).alias("start"), (F.max(frame) + 1).alias("end"), F.max_by(frame, F.struct(height, -F.col(frame))).alias("peak")
    )


def threshold_trim(df: DataFrame, track: str, frame: str, height: Column, threshold: float) -> DataFrame:
    """The contiguous frames from the first to the last that reach the threshold; none if no frame does."""
    hit = F.when(height >= threshold, F.col(frame))
    whole = W.partitionBy(track)
    marked = df.withColumns({"_first": F.min(hit).over(whole), "_last": F.max(hit).over(whole)})
    return marked.where(F.col(frame).between(F.col("_first"), F.col("_last"))).drop("_first", "_last")
