"""Parity of two results: differences of arrays, guards, exact equality."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tactus.operators import nearest

MOST_MAX, MOST_MEAN = 1e-3, 1e-4


def difference_metrics(pairs: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    d = F.col(a).cast("double") - F.col(b).cast("double")
    return pairs.groupBy(*by).agg(
        F.avg(F.abs(d)).alias("mean_abs"),
        F.max(F.abs(d)).alias("max_abs"),
        F.sqrt(F.avg(d * d)).alias("rmse"),
        F.avg(F.abs(d) / (F.abs(F.col(a).cast("double")) + 1e-8)).alias("mean_rel"),
    )


def guard(metrics: DataFrame, most_max: float = MOST_MAX, most_mean: float = MOST_MEAN) -> DataFrame:
    """Adds triggered: a difference above either threshold makes the checked backend fall back."""
    return metrics.withColumn("triggered", (F.col("max_abs") > most_max) | (F.col("mean_abs") > most_mean))


def exact_parity(pairs: DataFrame, by: str, columns: list[tuple[str, str]]) -> DataFrame:
    equal: Column = F.lit(True)
    for a, b in columns:
        equal = equal & F.col(a).eqNullSafe(F.col(b))
    return pairs.groupBy(by).agg(F.bool_and(equal).alias("equal"))


def shuffled(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of places joined by their keys, never by a broadcast: Spark judges places by the size of the arrays they were unpacked from."""
    return a.hint("merge").join(b, keys)


def cropped(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, a, b): two results at the places that both have."""
    return shuffled(a.select(*keys, F.col(value).alias("a")), b.select(*keys, F.col(value).alias("b")), keys)


def macro_average(metrics: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Unweighted means of per-track metrics."""
    return metrics.groupBy(*by).agg(*(F.avg(c).alias(c) for c in columns))


def best_config(metrics: DataFrame, by: list[str], config: str, error: str = "mean_abs") -> DataFrame:
    """(by, config, error): the configuration with the least error, of equal ones the first."""
    least = F.min(F.struct(F.col(error), F.col(config))).alias("_least")
    return metrics.groupBy(*by).agg(least).select(*by, F.col(f"_least.{config}").alias(config), F.col(f"_least.{error}").alias(error))


def summary(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, least, median and greatest of measured times."""
    v = F.col(value).cast("double")
    return values.groupBy(*by).agg(F.avg(v).alias("mean"), F.min(v).alias("min"), F.percentile(v, 0.5).alias("median"), F.max(v).alias("max"))


def beat_parity(beats: DataFrame, pairs: list[tuple[str, str]], run: str, track: str, time: str) -> DataFrame:
    """beats of several runs -> for each pair of runs and track the summary of nearest deltas, null where one side has none."""
    out = None
    for reference, candidate in pairs:
        a, b = (beats.where(F.col(run) == r).select(track, time) for r in (reference, candidate))
        found = nearest.delta_summary(nearest.nearest_deltas(a, b, track, time), track)
        both = a.select(track).unionByName(b.select(track)).distinct().join(found, track, "left")
        row = both.select(F.lit(reference).alias("reference"), F.lit(candidate).alias("candidate"), *both.columns).na.fill(0, ["n"])
        out = row if out is None else out.unionByName(row)
    return out


def spectrum_search(expected: DataFrame, magnitudes: DataFrame, powers: list[float], logs: list[str], keys: list[str]) -> DataFrame:
    """(power, log, mean_abs, max_abs, rmse, mean_rel): how well each variant of log(1 + magnitude^power) meets the expected levels.

    expected: (keys, level); magnitudes: (keys, magnitude). Means over all places, all variants in one pass.
    """
    bases = {"ln": 1.0, "log10": 10.0, "log2": 2.0}
    options = [F.struct(F.lit(float(p)).alias("power"), F.lit(name).alias("log")) for p in powers for name in logs]
    both = shuffled(expected, magnitudes, keys).withColumn("o", F.explode(F.array(*options)))
    natural = F.log1p(F.pow("magnitude", F.col("o.power")))
    scale = F.element_at(F.create_map(*(F.lit(x) for name in logs for x in (name, float(np.log(bases[name])) if bases[name] > 1 else 1.0))), F.col("o.log"))
    return difference_metrics(both.withColumn("a", natural / scale), ["o.power", "o.log"], "a", "level")


def layout_search(expected: DataFrame, levels: DataFrame, track: str, frame: str, band: str, shifts: list[int], last_band: int) -> DataFrame:
    """(shift, turned, whole, mean_abs, max_abs, rmse, mean_rel): how well each way to lay out levels meets the expected ones.

    expected and levels: (track, frame, band, level). shift: frames that levels are moved on; turned: frames and bands change places;
    whole: with the last band, or without it. Places that both sides have count; all layouts in one pass, and each row of levels is
    met by equality, once a shift and turn.
    """
    moves = [F.struct(F.lit(n).alias("shift"), F.lit(turned).alias("turned")) for n in shifts for turned in (False, True)]
    laid = levels.select(track, F.col(frame).alias("_f"), F.col(band).alias("_b"), F.col("level").alias("b"), F.explode(F.array(*moves)).alias("o"))
    at = F.when(F.col("o.turned"), F.col("_b")).otherwise(F.col("_f")) + F.col("o.shift")
    place = F.when(F.col("o.turned"), F.col("_f")).otherwise(F.col("_b"))
    laid = laid.select(track, at.cast("bigint").alias("_frame"), place.cast("bigint").alias("_band"), "b", "o")
    there = expected.select(track, F.col(frame).cast("bigint").alias("_frame"), F.col(band).cast("bigint").alias("_band"), F.col("level").alias("a"))
    ways = F.when(F.col("_band") < last_band, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))
    both = shuffled(there, laid, [track, "_frame", "_band"]).withColumn("whole", F.explode(ways))
    return difference_metrics(both, ["o.shift", "o.turned", "whole"], "a", "b")
