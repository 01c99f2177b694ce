"""Frames, filterbanks and log-magnitude spectra.

A track's samples are either one array, or chunks of a track in rows of their own: (track, chunk, at, total, samples). Chunks get the
edges of their neighbours (with_edges, or the wave source's option), and every frame is made in the chunk that holds its centre, so a
track may be of any length.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tactus.functions.columns import bound

# The spectrogram's tuning.
BANDS_PER_OCTAVE, LOWEST, HIGHEST, REFERENCE = 12, 30.0, 17000.0, 440.0
RATE = 44100


def log_frequencies(per_octave: int = BANDS_PER_OCTAVE, low: float = LOWEST, high: float = HIGHEST, reference: float = REFERENCE) -> np.ndarray:
    """reference * 2^(k / per_octave) within [low, high]."""
    first = math.floor(math.log2(low / reference) * per_octave)
    last = math.ceil(math.log2(high / reference) * per_octave)
    f = reference * 2.0 ** (np.arange(first, last) / per_octave)
    return f[(f >= low) & (f <= high)]


def filterbank(rate: int = 44100, size: int = 2048) -> np.ndarray:
    """(bins, bands) triangles, each summing to 1, between neighbouring distinct bins nearest the log frequencies."""
    bins = np.arange(size // 2) * rate / size
    f = log_frequencies()
    right = np.clip(np.searchsorted(bins, f), 1, len(bins) - 1)
    nearest = np.where(f - bins[right - 1] < bins[right] - f, right - 1, right)
    points = np.unique(nearest)
    if len(points) < 3:
        raise ValueError("fewer than three distinct bins")
    bank = np.zeros((len(bins), len(points) - 2))
    for band, (a, b, c) in enumerate(zip(points, points[1:], points[2:], strict=False)):
        if c - a < 2:
            b, c = a, a + 1
        weights = np.zeros(len(bins))
        weights[a:b] = np.arange(b - a) / max(b - a, 1)
        weights[b:c] = 1 - np.arange(c - b) / (c - b)
        bank[:, band] = np.maximum(bank[:, band], weights / weights.sum())
    return bank


def frame_count(samples: int, hop: float) -> int:
    return math.ceil(samples / hop)


def frames(signal: np.ndarray, size: int, hop: float) -> np.ndarray:
    """(frames, size): frame i is centred at int(i * hop), zeros beyond the ends."""
    n = frame_count(len(signal), hop)
    padded = np.concatenate([np.zeros(size // 2, signal.dtype), signal, np.zeros(size, signal.dtype)])
    starts = (np.arange(n) * hop).astype(np.int64)
    return np.lib.stride_tricks.sliding_window_view(padded, size)[starts] if n else np.zeros((0, size), signal.dtype)


def log_spectrum(signal: np.ndarray, bank: np.ndarray, size: int = 2048, hop: float = 441) -> np.ndarray:
    """(frames, bands): log10(1 + filtered magnitude) under a symmetric Hann window; integer audio counts as full scale 1."""
    window = np.hanning(size)
    if np.issubdtype(signal.dtype, np.integer):
        window = window / np.iinfo(signal.dtype).max
    return levels(frames(signal, size, hop), bank, window).astype(np.float32)


def levels(framed: np.ndarray, bank: np.ndarray, window: np.ndarray) -> np.ndarray:
    """(frames, bands) of (frames, size), some hundred frames at a time."""
    out = [np.zeros((0, bank.shape[1]))]
    for part in np.array_split(framed, max(1, len(framed) // 512)):
        out.append(np.log10(np.abs(np.fft.rfft(part * window))[:, : len(bank)] @ bank + 1))
    return np.concatenate(out)


def spectrogram(signals: DataFrame, size: int = 2048, fps: float = 100) -> DataFrame:
    """signals (track_id, stem, sample_rate, samples) -> (track_id, stem, frame, bands), one row a frame.

    One row holds a stem; stems and tracks are the parallelism.
    """

    def transform(batches):
        banks: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.itertuples(index=False):
                rate = int(row.sample_rate)
                bank = banks.setdefault(rate, filterbank(rate, size))
                spectrum = log_spectrum(np.asarray(row.samples), bank, size, rate / fps)
                yield pd.DataFrame({"track_id": row.track_id, "stem": row.stem, "frame": np.arange(len(spectrum), dtype=np.int32), "bands": list(spectrum)})

    return signals.select("track_id", "stem", "sample_rate", "samples").mapInPandas(transform, "track_id string, stem string, frame int, bands array<float>")


def framed(samples: Column, size: int, hop: int) -> Column:
    """array<array>: frames of an array column, centred at multiples of hop, zeros beyond the ends."""
    pad = lambda n: F.array_repeat(F.lit(0.0), n)
    padded = F.concat(pad(size // 2), F.transform(samples, lambda x: x.cast("double")), pad(size))
    last = F.ceil(F.size(samples) / hop).cast("int") - 1
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(padded, i * hop + 1, size))


def with_edges(chunks: DataFrame, track: str, edge: int) -> DataFrame:
    """chunks (track, chunk, at, total, samples) with left and right: the `edge` samples on either side, shorter at a track's ends.

    A chunk's samples go to its own place, and its ends to the chunks that they are beside, in one shuffle on track and chunk;
    no task holds a track. All chunks of a track but its last are of one length, of at least one sample.
    """
    chunks = chunks.where(F.size("samples") > 0)
    own = F.col("samples")
    size = F.size(own)
    reach = F.ceil(F.lit(edge) / size).cast("int")  # an edge may lie in several chunks
    kept = lambda n: F.least(F.greatest(n, F.lit(0)), size).cast("int")
    # To the k-th chunk behind, (k - 1) chunks lie between: of the edge only what is left of it comes from here. Before: alike.
    behind = F.transform(F.sequence(F.lit(1), reach), lambda k: F.struct((F.col("chunk") + k).alias("to"), (-k).alias("place"), F.slice(own, size - kept(edge - (k - 1) * size) + 1, kept(edge - (k - 1) * size)).alias("part")))
    ahead = F.transform(F.sequence(F.lit(1), F.col("_reach")), lambda k: F.struct((F.col("chunk") - k).alias("to"), k.alias("place"), F.slice(own, 1, kept(edge - (k - 1) * F.col("_length"))).alias("part")))
    mine = F.array(F.struct(F.col("chunk").alias("to"), F.lit(0).alias("place"), own.alias("part")))
    length = F.when(F.col("chunk") > 0, F.floor(F.col("at") / F.col("chunk"))).otherwise(size)  # of the chunks before
    sized = chunks.withColumn("_length", length).withColumn("_reach", F.ceil(F.lit(edge) / F.col("_length")).cast("int"))
    sent = sized.withColumn("_p", F.explode(F.concat(mine, *([behind, ahead] if edge else [])))).where((F.col("_p.to") >= 0) & ((F.col("_p.place") == 0) | (F.size("_p.part") > 0)))
    rest = [c for c in chunks.columns if c not in (track, "chunk", "samples")]
    parts = F.array_sort(F.collect_list(F.struct("_p.place", "_p.part")))  # the chunk and what is beside it
    kept_rest = [F.max(F.when(F.col("_p.place") == 0, F.struct(*rest))).alias("_rest")]
    met = sent.groupBy(track, F.col("_p.to").alias("chunk")).agg(parts.alias("_parts"), *kept_rest).where("_rest is not null")
    side = lambda keep: F.flatten(F.transform(F.filter("_parts", keep), lambda p: p["part"]))
    sides = {"samples": lambda p: p["place"] == 0, "left": lambda p: p["place"] < 0, "right": lambda p: p["place"] > 0}
    return met.select(track, "chunk", "_rest.*", *(side(keep).alias(name) for name, keep in sides.items()))


def _frame_numbers(hop: float) -> Column:
    """The frames whose centre lies in the chunk."""
    at, end = F.col("at"), F.col("at") + F.size("samples")
    near = F.sequence(F.floor(at / hop), F.ceil(end / hop))
    centre = lambda i: F.floor(i * F.lit(float(hop)))
    return F.filter(near, lambda i: (centre(i) >= at) & (centre(i) < end) & (i < F.ceil(F.col("total") / hop)))


def chunk_frames(chunks: DataFrame, track: str, size: int, hop: float) -> DataFrame:
    """chunks with edges of at least size / 2 -> (track, frame, samples array<double>): the frames of the whole tracks, as frames has them."""
    zeros = lambda n: F.array_repeat(F.lit(0.0), F.greatest(n, F.lit(0)).cast("int"))
    doubles = lambda c: F.transform(c, lambda x: x.cast("double"))
    padded = F.concat(zeros(size // 2 - F.size("left")), doubles("left"), doubles("samples"), doubles("right"), zeros(F.lit(size)))
    first = F.col("at") - F.greatest(F.size("left"), F.lit(size // 2))
    start = lambda i: F.floor(i * F.lit(float(hop))) - size // 2 - first
    cut = bound(padded, lambda x: F.transform(_frame_numbers(hop), lambda i: F.struct(i.alias("frame"), F.slice(x, (start(i) + 1).cast("int"), size).alias("samples"))))
    return chunks.select(track, F.explode(cut).alias("_f")).select(track, "_f.frame", "_f.samples")


def chunk_spectrogram(chunks: DataFrame, keys: list[str], size: int = 2048, fps: float = 100, exact: bool = False) -> DataFrame:
    """chunks (keys, sample_rate, at, total, samples, left, right) -> (keys, frame, bands): each chunk by itself, whatever its track's length.

    exact: bands as doubles.
    """
    number = "double" if exact else "float"

    def transform(batches):
        banks: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_dict("records"):
                rate = int(row["sample_rate"])
                bank, hop = banks.setdefault(rate, filterbank(rate, size)), rate / fps
                own, left, right = (np.asarray(row[k], np.float64) for k in ("samples", "left", "right"))
                at, end = int(row["at"]), int(row["at"]) + len(own)
                low, high = max(0, math.ceil(at / hop) - 1), min(frame_count(int(row["total"]), hop), math.ceil(end / hop) + 1)
                number = np.arange(low, high)
                centre = (number * hop).astype(np.int64)
                inside = (centre >= at) & (centre < end)
                number, centre = number[inside], centre[inside]
                if not len(number):  # a chunk shorter than a hop may have no centre
                    continue
                padded = np.concatenate([np.zeros(max(0, size // 2 - len(left))), left, own, right, np.zeros(size)])
                starts = centre - size // 2 - (at - max(len(left), size // 2))
                held = np.lib.stride_tricks.sliding_window_view(padded, size)[starts]
                spectrum = levels(held, bank, np.hanning(size))
                columns = {k: row[k] for k in keys} | {"frame": number, "bands": list(spectrum if exact else spectrum.astype(np.float32))}
                yield pd.DataFrame(columns, index=range(len(number)))

    kinds = dict(chunks.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"frame long, bands array<{number}>"])
    return chunks.select(*keys, "sample_rate", "at", "total", "samples", "left", "right").mapInPandas(transform, schema)


def dft(df: DataFrame, key: str, samples: str, size: int) -> DataFrame:
    """(key, bin, re, im) for the first half of the bins, as a relational transform."""
    bins = df.select(key, F.col(samples).alias("_x"), F.explode(F.sequence(F.lit(0), F.lit(size // 2 - 1))).alias("bin"))
    term = lambda f: F.aggregate("_t", F.lit(0.0), lambda acc, t: acc + t["x"] * f(t["i"] * F.col("bin") * (-2 * math.pi / size)))
    pairs = F.transform("_x", lambda x, i: F.struct(x.cast("double").alias("x"), i.cast("double").alias("i")))
    return bins.withColumn("_t", pairs).select(key, F.col("bin").cast("bigint").alias("bin"), term(F.cos).alias("re"), term(F.sin).alias("im"))


def to_mono(samples: np.ndarray) -> np.ndarray:
    """One channel: the mean over the axis that looks like channels (1 or 2 long and the shorter one, else the second)."""
    if samples.ndim == 1:
        return samples
    if samples.ndim != 2:
        raise ValueError("a signal has one or two axes")
    channels_first = samples.shape[0] in (1, 2) and samples.shape[0] < samples.shape[1]
    return samples.mean(0 if channels_first else 1)
