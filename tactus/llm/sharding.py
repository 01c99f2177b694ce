"""Uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

1. The rows get a position (source partition, place in it), which a written table freezes: whatever is
   recomputed after a lost executor gets the same position.
2. The matrix of how many rows go from each source partition to each shard is drawn with exact margins. A
   binary tree over the source partitions splits the shards' capacities; each node's draw depends on the seed
   and the node alone, so a task derives the row of its own partition in log(partitions) draws, and the whole
   matrix is nowhere held.
3. Each partition permutes its rows locally and deals them out by its row of the matrix.
4. After the exchange the rows are permuted again: a second random number cuts each shard into slices and
   orders each slice. Slots are gapless over the slices of a shard.

Nulls, empty texts, ties and repeated rows are rows like any others. An empty table gives no row. Input columns
that are named as an output column are replaced by it.
"""

from __future__ import annotations

import bisect
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tactus.session import durable

#: Bits of a row's position that hold its place in its partition (as monotonically_increasing_id has it).
PLACE_BITS = 33
RANDOM_BITS = 62


def shard_sizes(rows: int, shards: int) -> list[int]:
    """Row counts at most one apart."""
    return [rows // shards + (k < rows % shards) for k in range(shards)]


def _factorials(a: int, b: int) -> float:
    """log(a! / b!), the leading terms subtracted before they are rounded."""
    if a < b:
        return -_factorials(b, a)
    if b < 64:
        return math.lgamma(a + 1) - math.lgamma(b + 1)
    rest = lambda n: 1 / (12 * n) - 1 / (360 * n**3) + 1 / (1260 * n**5)  # noqa: E731  Stirling's series
    return (b + 0.5) * math.log1p((a - b) / b) + (a - b) * (math.log(a) - 1) + rest(a) - rest(b)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of `drawn` are good: one rejection sampler for populations of any size.

    A ratio of uniforms around the mean is proposed and accepted by its probability against the mode's.
    """
    total = good + bad
    low, high = max(0, drawn - bad), min(good, drawn)
    if low == high:
        return low
    mean = drawn * good / total
    variance = mean * (bad / total) * ((total - drawn) / (total - 1))
    mode = (drawn + 1) * (good + 1) // (total + 2)
    width = 2 * math.sqrt((variance + 0.5) * 2 / math.e) + 3 - 2 * math.sqrt(3 / math.e)
    while True:
        u, v = rng.random(2)
        if u == 0:
            continue
        x = math.floor(mean + 0.5 + width * (v - 0.5) / u)
        if low <= x <= high:
            ratio = _factorials(mode, x) + _factorials(good - mode, good - x)
            ratio += _factorials(drawn - mode, drawn - x) + _factorials(bad - drawn + mode, bad - drawn + x)
            if 2 * math.log(u) <= ratio:
                return x


def split_capacities(rng: np.random.Generator, capacities: list[int], drawn: int) -> list[int]:
    """How many of `drawn` rows fall on each shard, the shards having these capacities."""
    rest, out = sum(capacities), []
    for capacity in capacities:
        rest -= capacity
        got = hypergeometric(rng, capacity, rest, drawn)
        out.append(got)
        drawn -= got
    return out


def matrix_row(source: int, offsets: list[int], capacities: list[int], seed: int) -> list[int]:
    """Counts from one source partition to each shard. offsets: rows before each partition, then all rows."""
    low, high = 0, len(offsets) - 1
    while high - low > 1:
        middle = (low + high) // 2
        rng = np.random.default_rng([seed, low, high])
        left = split_capacities(rng, capacities, offsets[middle] - offsets[low])
        if source < middle:
            capacities, high = left, middle
        else:
            capacities, low = [c - x for c, x in zip(capacities, left, strict=True)], middle
    return capacities


def shard_rows(df: DataFrame, shards: int, seed: int = 7, slice_rows: int = 1 << 14) -> DataFrame:
    """df with shard (int) and slot (long, gapless from 0 in each shard); shard sizes differ by one at most.

    slice_rows: rows that one task orders in the second permutation, about.
    """
    kept = durable(df.select(F.monotonically_increasing_id().alias("position"), F.struct("*").alias("row")), "sharding", "zstd")
    source = F.shiftright("position", PLACE_BITS)
    counted = sorted(kept.groupBy(source.alias("source")).count().collect())  # a row for each partition of the input
    ids = [r["source"] for r in counted]
    offsets = [0, *np.cumsum([r["count"] for r in counted]).tolist()]
    rows = offsets[-1]
    capacities = shard_sizes(rows, shards)
    slices = max(1, math.ceil(rows / shards / slice_rows))
    plan = df.sparkSession.sparkContext.broadcast((ids, offsets))  # two longs for each partition of the input
    last: dict = {}

    @F.pandas_udf("shard int, slice int, ord long")
    def deal(position: pd.Series) -> pd.DataFrame:
        at = position.to_numpy()
        source, place = at >> PLACE_BITS, at & ((1 << PLACE_BITS) - 1)
        shard, order = np.empty(len(at), np.int32), np.empty(len(at), np.int64)
        for s in np.unique(source):
            if last.get("source") != s:
                ids, offsets = plan.value
                k = bisect.bisect_left(ids, s)
                n = offsets[k + 1] - offsets[k]
                ends = np.cumsum(matrix_row(k, offsets, capacities, seed))
                rng = np.random.default_rng([seed, int(s), 1])
                last.update(
                    source=s,
                    shard=np.searchsorted(ends, rng.permutation(n), side="right").astype(np.int32),
                    order=rng.integers(0, 1 << RANDOM_BITS, n),
                )
            own = source == s
            shard[own], order[own] = last["shard"][place[own]], last["order"][place[own]]
        half = RANDOM_BITS // 2
        return pd.DataFrame({"shard": shard, "slice": ((order >> half) * slices >> half).astype(np.int32), "ord": order})

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.withColumn("d", deal("position")).select(*rows.columns, "d.*")

    within = W.partitionBy("shard", "slice").orderBy("ord", "position")
    placed = dealt(kept).withColumn("slot", F.row_number().over(within).cast("long") - 1)
    if slices > 1:
        sizes = dealt(kept.select("position")).groupBy("shard", "slice").count()
        before = W.partitionBy("shard").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
        starts = sizes.select("shard", "slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
        placed = placed.join(starts, ["shard", "slice"]).withColumn("slot", F.col("slot") + F.col("start"))
    columns = [F.col("row").getField(c).alias(c) for c in df.columns if c not in ("shard", "slot")]
    return placed.select(*columns, "shard", "slot")
