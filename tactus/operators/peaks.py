"""Peaks of a framed signal by sliding windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _order(track: str, order: str):
    return W.partitionBy(track).orderBy(order)


def sliding(df: DataFrame, track: str, frame: str, value: str, past: int, future: int) -> DataFrame:
    """Adds _top, _before and _after: maximum of [-past, future], sums of [-past, -1] and [1, future].

    Every row costs the same whatever the width: maximum and sums are put together from the rest of one block and the beginning of
    another. Nothing is summed beyond a block, so a NaN spoils only what it is part of, and long tracks lose no digits.
    """
    v, by = F.col(value), _order(track, frame)
    rows = df.withColumns({"_n": F.row_number().over(by) - 1, "_rows": F.count(F.lit(1)).over(W.partitionBy(track))})
    n, rows_in = F.col("_n"), F.col("_rows")
    own = F.coalesce(v, F.lit(0.0))
    made: list[str] = []

    def blocks(name: str, width: int, f, of: Column) -> tuple[str, str]:
        """Over blocks of width rows: f from a row's block's first row up to it, and from it to the block's last row."""
        nonlocal rows
        name = f"_{name}{width}"
        if f"{name}_block" in made:  # sums of both sides, if these are as wide
            return f"{name}_from", f"{name}_rest"
        rows = rows.withColumn(f"{name}_block", F.floor(n / width))
        block = W.partitionBy(track, f"{name}_block")
        upto = W.unboundedPreceding, W.currentRow
        rows = rows.withColumn(f"{name}_from", f(of).over(block.orderBy(frame).rowsBetween(*upto)))
        rows = rows.withColumn(f"{name}_rest", f(of).over(block.orderBy(F.desc(frame)).rowsBetween(*upto)))
        made.extend((f"{name}_block", f"{name}_from", f"{name}_rest"))
        return f"{name}_from", f"{name}_rest"

    def spread(name: str, low: int, high: int, f, of: Column, join) -> Column:
        """f over the rows low to high beside each (of those there are): low's block's rest, and high's block's beginning if that is another."""
        width = high - low + 1
        begun, rest = blocks(name, width, f, of)
        whole = by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        at = lambda column, k: F.lag(column, -k).over(by) if k < 0 else F.lead(column, k).over(by) if k else F.col(column)
        first, last = n + low, n + high
        ends = F.least(last, rows_in - 1)
        block = lambda x: F.floor(x / width)
        left = F.when((first >= 0) & (first < rows_in), at(rest, low))
        right = F.when(last < rows_in, at(begun, high)).otherwise(F.last(begun).over(whole))
        one = F.when(first < 0, right).otherwise(left)  # the window is in one block, or begins before the track
        apart = (first >= 0) & (block(first) < block(ends))
        inside = (ends >= 0) & (first < rows_in) & (ends >= first)
        return F.when(inside, F.when(apart, join(left, right)).otherwise(one))

    add = lambda a, b: a + b
    found = {"_top": spread("max", -past, future, F.max, v, F.greatest)}
    zero = F.lit(0.0)
    found["_before"] = F.coalesce(spread("sum", -past, -1, F.sum, own, add), zero) if past else zero
    found["_after"] = F.coalesce(spread("sum", 1, future, F.sum, own, add), zero) if future else zero
    return rows.withColumns(found).drop("_n", "_rows", *made)


def peak_strength(df: DataFrame, track: str, frame: str, value: str, past: int = 1200, future: int = 1200) -> DataFrame:
    """Adds strength: at positive maxima of [-past, future] the value less the mean of both sides, else 0.

    The sides' sums are divided by the whole window length, also where the signal ends.
    """
    if (past + future) % 2:
        raise ValueError("past + future must be even")
    v = F.col(value)
    mean = (F.col("_before") / past + F.col("_after") / future) / 2
    strength = F.when((v == F.col("_top")) & (v > 0), v - mean).otherwise(F.lit(0.0))
    return sliding(df, track, frame, value, past, future).withColumn("strength", strength).drop("_top", "_before", "_after")


def local_maxima(df: DataFrame, track: str, frame: str, value: str, width: int = 41) -> DataFrame:
    """Adds kept: the value where it is the maximum of the centred window of odd width, else 0."""
    if width % 2 == 0:
        raise ValueError("width must be odd")
    v = F.col(value)
    kept = F.when(v == F.col("_top"), v).otherwise(F.lit(0.0))
    return sliding(df, track, frame, value, width // 2, width // 2).withColumn("kept", kept).drop("_top", "_before", "_after")


def strict_maxima(df: DataFrame, track: str, frame: str, value: str, order: int = 20) -> DataFrame:
    """Adds is_peak: above all of the `order` neighbours on both sides; the first and last frame never are."""
    v = F.col(value)
    side = lambda low, high: F.max(v).over(_order(track, frame).rowsBetween(low, high))  # noqa: E731  a few rows
    above = (v > side(-order, -1)) & (v > side(1, order))
    return df.withColumn("is_peak", F.coalesce(above, F.lit(False)))


def frame_numbers(df: DataFrame, track: str, *order: str | Column, name: str = "frame") -> DataFrame:
    """Adds a frame number from 0 in each track."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(track).orderBy(*order)).cast("bigint") - 1)
