"""Quantiles of groups of any size from mergeable sketches, with a stated bound on their rank error.

`percentile` keeps every distinct value of a group in one task. A sketch keeps a few thousand numbers whatever the group's size, is
made where the rows are, and is merged on the way, so a group that holds a third of all rows costs no task more. Sketches can be
written and merged with those of later data.

An estimate of the p-quantile of n values has a rank between (p - error) n and (p + error) n, `rank_error` being 99 % sure for one
estimate; groups of up to `size` values are exact. Nulls and NaNs don't count; a group without values has null estimates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers that a sketch keeps on its largest level.
SIZE = 800


def rank_error(size: int = SIZE) -> float:
    """The bound of one estimate's rank error, as a part of n: the sketch's published constants."""
    return 2.296 / size**0.9021


def sketches(rows: DataFrame, by: list[str], value: str, size: int = SIZE) -> DataFrame:
    """(by, sketch): binary, to be written, merged or asked."""
    v = F.col(value).cast("double")
    return rows.groupBy(*by).agg(F.kll_sketch_agg_double(F.when(~F.isnan(v), v), F.lit(size)).alias("sketch"))


def merged(parts: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of the same groups as one each."""
    return parts.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def count(sketch: Column) -> Column:
    return F.kll_sketch_get_n_double(sketch)


def quantile(sketch: Column, p: float) -> Column:
    return F.when(count(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(p)))


def estimates(parts: DataFrame, by: list[str], probabilities: list[float]) -> DataFrame:
    """Sketches -> (by, p, n, estimate)."""
    each = F.array(*(F.struct(F.lit(float(p)).alias("p"), quantile(F.col("sketch"), p).alias("estimate")) for p in probabilities))
    return parts.select(*by, count(F.col("sketch")).alias("n"), F.explode(each).alias("_e")).select(*by, "_e.p", "n", "_e.estimate")


def ranked(rows: DataFrame, by: list[str], value: str, found: DataFrame) -> DataFrame:
    """found (by, p, n, estimate) with below and upto: the exact parts of the group's values under the estimate, and up to it.

    A few estimates stand beside each row of their group and are counted as partial sums; nothing is sorted.
    """
    v = F.col(value).cast("double")
    known = rows.where(v.isNotNull() & ~F.isnan(v)).select(*by, v.alias("_v"))
    counted = known.join(found, by).groupBy(*by, "p", "n", "estimate").agg(F.count_if(F.col("_v") < F.col("estimate")).alias("_below"), F.count_if(F.col("_v") <= F.col("estimate")).alias("_upto"))
    return counted.select(*by, "p", "n", "estimate", (F.col("_below") / F.col("n")).alias("below"), (F.col("_upto") / F.col("n")).alias("upto"))


def within(p: Column, below: Column, upto: Column, error: float) -> Column:
    """Whether some rank of the estimate (equal values have several) is within the error of p."""
    return (below <= p + error) & (upto >= p - error)


def delta_summary(deltas: DataFrame, by: str, delta: str = "delta", size: int = SIZE) -> DataFrame:
    """nearest.delta_summary with estimated median_signed, median_abs and p90_abs."""
    d = F.col(delta).cast("double")
    sketch = lambda x: F.kll_sketch_agg_double(F.when(~F.isnan(x), x), F.lit(size))
    met = deltas.groupBy(by).agg(F.count("*").alias("n"), F.avg(d).alias("mean_signed"), F.max(F.abs(d)).alias("max_abs"), sketch(d).alias("_s"), sketch(F.abs(d)).alias("_a"))
    found = {"median_signed": quantile(F.col("_s"), 0.5), "median_abs": quantile(F.col("_a"), 0.5), "p90_abs": quantile(F.col("_a"), 0.9)}
    return met.select(by, "n", "mean_signed", *(q.alias(k) for k, q in found.items()), "max_abs")


def summary(values: DataFrame, by: list[str], value: str, size: int = SIZE) -> DataFrame:
    """parity.summary with an estimated median."""
    v = F.col(value).cast("double")
    met = values.groupBy(*by).agg(F.avg(v).alias("mean"), F.min(v).alias("min"), F.kll_sketch_agg_double(F.when(~F.isnan(v), v), F.lit(size)).alias("_s"), F.max(v).alias("max"))
    return met.select(*by, "mean", "min", quantile(F.col("_s"), 0.5).alias("median"), "max")
