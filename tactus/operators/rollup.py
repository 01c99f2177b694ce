"""Timing rollups: totals by stage and by track and stage, collapsed stages, rebased timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stage_totals(timings: DataFrame, stage: str, track: str, duration: Column) -> DataFrame:
    """Grouping sets (stage) and (track, stage): stage, track (null in the first set), by_track, total."""
    named = timings.select(F.col(stage).alias("stage"), F.col(track).alias("track"), duration.alias("_d"))
    sets = named.groupingSets([["stage"], ["stage", "track"]], "stage", "track")
    totals = sets.agg(F.sum("_d").alias("total"), F.grouping("track").alias("_g"))
    by_track = F.col("_g") == 0
    return totals.where(~by_track | F.col("track").isNotNull()).select("stage", "track", by_track.alias("by_track"), "total")


def collapse(timings: DataFrame, stage: str, members: list[str], name: str, start: str, end: str, by: str) -> DataFrame:
    """The member stages of each track as one row: its first start and last end. Others stay, repeated ones too."""
    member = F.coalesce(F.col(stage).isin(members), F.lit(False))
    times = [F.col(by), F.col(stage).alias("stage"), F.col(start).alias("start"), F.col(end).alias("end")]
    one = timings.where(member).groupBy(by).agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("rows"))
    others = timings.where(~member).select(*times, F.lit(1).cast("long").alias("rows"))
    return others.unionByName(one.withColumn("stage", F.lit(name)))


def rebased(timings: DataFrame, by: str, start: str, skip: list[str], stage: str) -> DataFrame:
    """Adds since: the time since the track's first row, without the skipped stages (rows without a stage stay).

    The first times are summed up on the map side and joined, so a track that holds most rows isn't one task's.
    """
    kept = timings.where(~F.coalesce(F.col(stage).isin(skip), F.lit(False)))
    zero = kept.groupBy(F.col(by).alias("_by")).agg(F.min(start).alias("_zero"))
    met = kept.join(zero, F.col(by).eqNullSafe(F.col("_by")))
    return met.withColumn("since", F.col(start) - F.col("_zero")).drop("_by", "_zero")


def timing_summary(timings: DataFrame, stage: str = "stage", track: str = "track", duration: str = "duration") -> DataFrame:
    """One row: stage_totals (map of seconds by stage) and track_totals (map of such maps by track), two decimals, keys sorted."""
    totals = stage_totals(timings, stage, track, F.col(duration)).withColumn("total", F.round("total", 2))
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", "total"))))
    stages = totals.where("not by_track").agg(entries.alias("stage_totals"))
    tracks = totals.where("by_track").groupBy("track").agg(entries.alias("stages"))  # a few stages each
    by_track = tracks.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("track", "stages")), lambda a, b: F.when(a["track"] < b["track"], -1).otherwise(1))).alias("track_totals"))
    return stages.crossJoin(by_track)  # one row each


def track_totals(timings: DataFrame, stage: str = "stage", track: str = "track", duration: str = "duration") -> DataFrame:
    """(track, stages): for each track, and with a null track for all of them, a map of seconds by stage, two decimals, keys sorted.

    timing_summary as a row for each track, for any number of them.
    """
    totals = stage_totals(timings, stage, track, F.col(duration)).withColumn("total", F.round("total", 2))
    named = totals.select(F.when(F.col("by_track"), F.col("track")).alias("track"), "by_track", "stage", "total")
    stages = F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", "total"))))  # a few stages each
    return named.groupBy("track", "by_track").agg(stages.alias("stages")).select("track", "stages")


def timing_charts(timings: DataFrame, members: list[str], skip: list[str] = ["postprocess"]) -> DataFrame:  # noqa: B006
    """(track, label, since, until, duration, total): the bars of every track's timings; total: where its last bar ends."""
    kept = timings.where(~F.coalesce(F.col("stage").isin(skip), F.lit(False))).withColumn("_track", F.coalesce(F.col("track").cast("string"), F.lit("")))
    bars = rebased(collapse(kept, "stage", members, "post_process", "start", "end", "_track"), "_track", "start", [], "stage")
    bars = bars.select("_track", F.replace("stage", F.lit("_"), F.lit(" ")).alias("label"), "since", (F.col("since") + F.col("end") - F.col("start")).alias("until"), (F.col("end") - F.col("start")).alias("duration"))
    last = bars.groupBy("_track").agg(F.max("until").alias("total"))
    return bars.join(last, "_track").select(F.col("_track").alias("track"), "label", "since", "until", "duration", "total")


def timing_chart(timings: DataFrame, members: list[str], skip: list[str] = ["postprocess"]) -> DataFrame:  # noqa: B006
    """(label, since, until, duration, total): the bars of one track's timings in order. Raises without rows or with several tracks."""
    kept = timings.where(~F.coalesce(F.col("stage").isin(skip), F.lit(False)))
    seen = kept.agg(F.count("*").alias("rows"), F.count_distinct("track").alias("tracks")).first()
    if not seen["rows"]:
        raise ValueError("no timing rows are left")
    if seen["tracks"] > 1:
        raise ValueError("timings of more than one track")
    return timing_charts(kept.withColumn("track", F.lit("")), members, []).drop("track").orderBy("since")
