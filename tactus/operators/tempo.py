"""Tempo from beat times: a histogram of rounded rates, ranked by votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def elapsed(time: Column, before: Column, micros: bool) -> Column:
    """Distance of two times: microseconds of timestamps, else the plain difference."""
    if not micros:
        return time - before
    epoch = F.expr("timestamp_ntz'1970-01-01 00:00:00'")
    since = lambda c: F.timestamp_diff("MICROSECOND", epoch, c)
    return since(time) - since(before)


def tempo_candidates(
    beats: DataFrame, track: str, order: list[str], minute: Column | None = None, micros: bool = False
) -> DataFrame:
    """Rows (track, bpm, votes, share, rank): how many gaps between consecutive beats round to each bpm.

    order: the time column, then tie breakers. minute: the length of a minute in units of the gap (60 for
    seconds). Rates round half to even; gaps of zero cast no vote; equal votes rank the higher bpm first.
    A track with fewer than two beats has no row.
    """
    by_time = W.partitionBy(track).orderBy(*order)
    gap = elapsed(F.col(order[0]), F.lag(order[0]).over(by_time), micros)
    rate = F.rint((F.lit(60.0) if minute is None else minute) / F.col("_gap")).cast("bigint")
    votes = (
        beats.withColumn("_gap", gap)
        .where("_gap > 0")
        .groupBy(track, rate.alias("bpm"))
        .agg(F.count("*").alias("votes"))
    )
    each = W.partitionBy(track)
    return votes.withColumns(
        {
            "share": F.col("votes") / F.sum("votes").over(each),
            "rank": F.row_number().over(each.orderBy(F.desc("votes"), F.desc("bpm"))),
        }
    )
