"""Nearest-in-time matching and its summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def nearest_deltas(reference: DataFrame, candidates: DataFrame, track: str, time: str) -> DataFrame:
    """(track, time, delta): for each reference time the signed distance of the nearest candidate, the later on ties.

    Two passes over the union: in time order the last candidate at or before, in falling order the last at or after. Tracks
    without candidates have no rows.
    """
    both = reference.select(track, time, F.lit(True).alias("_ref")).unionByName(candidates.select(track, time, F.lit(False).alias("_ref")))
    mine = F.when(~F.col("_ref"), F.col(time))
    so_far = lambda order: W.partitionBy(track).orderBy(order).rangeBetween(W.unboundedPreceding, 0)
    passed = {"_before": F.last(mine, True).over(so_far(F.asc(time))), "_after": F.last(mine, True).over(so_far(F.desc(time)))}
    marked = both.withColumns(passed).where("_ref and coalesce(_before, _after) is not null")
    back, forth = F.col("_before") - F.col(time), F.col("_after") - F.col(time)
    delta = F.when(back.isNull() | (forth <= -back), forth).otherwise(back)
    return marked.select(track, time, delta.alias("delta"))


def delta_summary(deltas: DataFrame, by: str, delta: str = "delta") -> DataFrame:
    """Count, mean and median of the signed deltas; median, 90th percentile (interpolated) and maximum of the absolute."""
    d = F.col(delta).cast("double")
    return deltas.groupBy(by).agg(
        F.count("*").alias("n"),
        F.avg(d).alias("mean_signed"),
        F.percentile(d, 0.5).alias("median_signed"),
        F.percentile(F.abs(d), 0.5).alias("median_abs"),
        F.percentile(F.abs(d), 0.9).alias("p90_abs"),
        F.max(F.abs(d)).alias("max_abs"),
    )


def without_near(times: DataFrame, others: DataFrame, track: str, time: str, radius) -> DataFrame:
    """Rows of times that are more than radius from every row of others in the track: an anti-join on time buckets."""
    bucket = F.floor(F.col(time) / radius).cast("bigint")
    o = others.select(F.col(track).alias("_k"), F.col(time).alias("_t"), F.explode(F.sequence(bucket - 1, bucket + 1)).alias("_b"))
    t = times.withColumn("_bucket", bucket)
    near = (t[track] == o["_k"]) & (t["_bucket"] == o["_b"]) & (F.abs(t[time] - o["_t"]) <= radius)
    return t.join(o, near, "left_anti").drop("_bucket")
