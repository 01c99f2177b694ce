"""Tones at the times of a track's events, as rows of samples, and loudness of a signal."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tactus.schema import SAMPLE_RATE
from tactus.session import durable

#: Samples of a stretch of a track, and samples that sound in a partition, on average.
STRETCH = 4096
PART_SAMPLES = 1 << 20

# Each kind's pitch in Hz where it begins and where it ends, its length in seconds, and the octaves of loudness it falls by.
TONES = {"beat": (1500.0, 1500.0, 0.1, 10.0), "downbeat": (3000.0, 3000.0, 0.1, 10.0), "boundary": (1000.0, 1000.0, 0.1, 10.0), "drop": (4000.0, 40.0, 0.5, 4.0)}


def clip(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(-1.0)), F.lit(1.0))


def tone(k: Column, samples: Column, begin: Column, end: Column, octaves: Column, rate: float) -> Column:
    """The k-th of a tone's samples. Its pitch goes from begin to end by equal ratios; the phase is the sum of the pitches so far.

    That sum is a geometric series, so a sample costs the same wherever it stands.
    """
    last = F.greatest(samples - 1, F.lit(1))
    ratio = F.pow(end / begin, 1 / last)
    pitches = F.when(begin == end, begin * k).otherwise(begin * (1 - F.pow(ratio, k + 1)) / (1 - ratio))
    return F.sin(2 * math.pi * pitches / rate) * F.pow(F.lit(2.0), -octaves * k / last)


def rendered(events: DataFrame, lengths: DataFrame, rate: int = SAMPLE_RATE) -> DataFrame:
    """events (path, time, kind) and lengths (path, samples) -> (path, at, value): the samples at which something sounds, all tones added, in -1..1.

    What would sound before a track's start or behind its end is left out; samples without a sound have no row. Kinds without a tone raise.
    Equal tones at one time are one, so many times as loud. Tones are dealt by stretches of tracks before they become samples, to as many
    partitions as their samples ask for: what a task adds up is bounded, and no sample moves.
    """
    known = F.create_map(*(x for kind, of in TONES.items() for x in (F.lit(kind), F.struct(*(F.lit(v).alias(n) for n, v in zip(("begin", "end", "seconds", "octaves"), of, strict=True))))))
    told = F.raise_error(F.concat(F.lit("no tone for events of kind "), F.coalesce("kind", F.lit("null"))))
    start = F.rint(F.col("time") * rate).cast("long").alias("_start")
    each = events.select("path", start, F.coalesce(known[F.col("kind")], told).alias("_t"))
    each = each.withColumn("_n", F.floor(F.col("_t.seconds") * rate)).where("_n > 0").join(lengths.select("path", F.col("samples").alias("_end")), "path").where("_start >= 0 and _start < _end")
    same = durable(each.groupBy("path", "_start", "_end", "_t", "_n").agg(F.count(F.lit(1)).alias("_times")), "tones")
    parts = max(1, -(-(same.agg(F.sum("_n")).first()[0] or 0) // PART_SAMPLES))
    first, last = F.floor(F.col("_start") / STRETCH), F.floor((F.least(F.col("_start") + F.col("_n"), F.col("_end")) - 1) / STRETCH)
    dealt = same.withColumn("_stretch", F.explode(F.sequence(first, last))).repartition(parts, "path", "_stretch")
    low = F.greatest(F.col("_stretch") * STRETCH - F.col("_start"), F.lit(0).cast("long"))
    high = F.least(F.col("_n"), F.col("_end") - F.col("_start"), (F.col("_stretch") + 1) * STRETCH - F.col("_start"))
    heard = dealt.withColumn("_k", F.explode(F.sequence(low, high - 1)))
    value = tone(F.col("_k"), F.col("_n"), F.col("_t.begin"), F.col("_t.end"), F.col("_t.octaves"), rate) * F.col("_times")
    summed = heard.groupBy("path", "_stretch", (F.col("_start") + F.col("_k")).alias("at")).agg(F.sum(value).alias("value"))
    return summed.select("path", "at", clip(F.col("value")).alias("value"))


def envelope(samples: DataFrame, track: str, at: str, value: str, size: int = 4096, hop: int = 1024) -> DataFrame:
    """(track, frame, rms): root mean square of frames of size samples centred at frame * hop, zeros beyond the ends.

    samples: a row for each sample. Each goes to the frames that hold it (size / hop of them), so the sums combine on the map side.
    """
    place = F.col(at) + size // 2
    first, last = F.greatest(F.floor((place - size) / hop) + 1, F.lit(0)), F.floor(place / hop)
    frames = samples.select(track, F.col(at), (F.col(value) * F.col(value)).alias("_square"), F.explode(F.sequence(first, last)).alias("frame"))
    ends = samples.groupBy(track).agg(F.max(at).alias("_end"))
    sums = frames.groupBy(track, "frame").agg(F.sum("_square").alias("_sum")).join(ends, track).where(F.col("frame") * hop <= F.col("_end") + 1)
    return sums.select(track, "frame", F.sqrt(F.col("_sum") / size).alias("rms"))
