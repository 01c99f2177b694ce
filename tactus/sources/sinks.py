"""Sinks: result files, activations, timings."""

from __future__ import annotations

import io
import json
import wave

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tactus.functions.columns import compact_arrays, duration_text, rounded
from tactus.operators.rollup import timing_summary
from tactus.schema import STEMS
from tactus.sources import arrays
from tactus.sources.store import file_stem, write_files


def rounded_results(results: DataFrame) -> DataFrame:
    """Times at two decimals, as result files have them."""
    segments = F.transform("segments", lambda s: F.struct(F.round(s["start"], 2).alias("start"), F.round(s["end"], 2).alias("end"), s["label"].alias("label")))
    return results.withColumns({"beats": rounded(F.col("beats")), "downbeats": rounded(F.col("downbeats")), "segments": segments})


def pretty_json(results: DataFrame, name: str = "json") -> DataFrame:
    """Adds the text of each result file."""
    columns = results.columns

    @F.pandas_udf("string")
    def pretty(compact: pd.Series) -> pd.Series:
        return compact.map(lambda t: compact_arrays(json.dumps(json.loads(t), indent=2)))

    return rounded_results(results).withColumn(name, pretty(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})))


def save_results(results: DataFrame, folder: str) -> None:
    """One JSON row for each track, rounded. Tracks that are there are replaced, others stay."""
    rows = rounded_results(results).withColumn("track", F.col("path"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("track").json(folder)


def save_result_files(results: DataFrame, folder: str) -> DataFrame:
    """<track>.json for each track, pretty, rounded, arrays of numbers on one line; returns (file, bytes)."""
    return write_files(pretty_json(results), folder, F.concat(file_stem(F.col("path")), F.lit(".json")), F.col("json"))


def _save_by_track(rows: DataFrame, folder: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("track_id").parquet(folder)


def save_activations(activations: DataFrame, folder: str) -> None:
    _save_by_track(activations, folder)


def save_embeddings(scores: DataFrame, folder: str) -> None:
    """From scores with embeddings: (track_id, fold, frame, stem_idx, vec)."""
    vectors = scores.select("track_id", "fold", "frame", F.posexplode("embedding").alias("stem_idx", "vec"))
    _save_by_track(vectors, folder)


#: The activations' arrays in side files, and the columns they come from.
SIDE_ARRAYS = {"beat": "p_beat", "downbeat": "p_downbeat", "segment": "p_section"}


def save_activation_files(activations: DataFrame, folder: str) -> None:
    """<track>.activ.npz for each track: beat, downbeat and segment (frames), and label (classes, frames)."""
    file = F.concat(file_stem(F.col("track_id")), F.lit(".activ.npz")).alias("file")
    one = lambda c: F.array(F.col(c).cast("float")).alias("value")
    by_class = activations.select("track_id", "frame", F.posexplode("p_function").alias("at", "p"))
    ordered = F.array_sort(F.collect_list(F.struct("frame", F.col("p").cast("float").alias("p"))))  # the frames of one track
    label = by_class.groupBy("track_id", "at").agg(F.transform(ordered, lambda x: x["p"]).alias("value"))
    rows = label.select(file, F.lit("label").alias("name"), F.col("at").cast("long").alias("at"), "value")
    for name, column in SIDE_ARRAYS.items():
        rows = rows.unionByName(activations.select(file, F.lit(name).alias("name"), F.col("frame").cast("long").alias("at"), one(column)))
    arrays.save(rows, folder, "npz", tuple(SIDE_ARRAYS))


def _save_by_stem(rows: DataFrame, folder: str, suffix: str) -> None:
    """rows (track_id, stem_idx, frame, value) as one array (stems, frames, ...) for each track."""
    whole = W.partitionBy("track_id")
    lead = F.array(F.max("stem_idx").over(whole) + 1, F.max("frame").over(whole) + 1).cast("array<bigint>")
    placed = rows.withColumn("lead", lead).withColumn("at", F.col("stem_idx") * F.col("lead")[1] + F.col("frame"))
    arrays.save(placed.select(F.concat(file_stem(F.col("track_id")), F.lit(suffix)).alias("file"), "at", "lead", "value"), folder)


def save_embedding_files(scores: DataFrame, folder: str) -> None:
    """<track>.embed.npy for each track, from scores with embeddings: (stems, frames, channels, folds)."""
    by_stem = scores.select("track_id", "fold", "frame", F.posexplode("embedding").alias("stem_idx", "vec"))
    folds = F.transform(F.array_sort(F.collect_list(F.struct("fold", "vec"))), lambda x: x["vec"])  # one for each member of the ensemble
    met = by_stem.groupBy("track_id", "stem_idx", "frame").agg(folds.alias("_folds"))
    channels = F.transform(F.col("_folds")[0], lambda _, k: F.transform("_folds", lambda fold: F.get(fold, k)))
    _save_by_stem(met.select("track_id", "stem_idx", "frame", channels.alias("value")), folder, ".embed.npy")


def save_spectrogram_files(spectrogram: DataFrame, folder: str, stems: tuple[str, ...] = STEMS) -> None:
    """<track>.npy for each track: (stems, frames, bands)."""
    place = F.array_position(F.array(*map(F.lit, stems)), F.col("stem")).cast("int") - 1
    rows = spectrogram.where(F.col("stem").isin(*stems)).select("track_id", place.alias("stem_idx"), "frame", F.col("bands").alias("value"))
    _save_by_stem(rows, folder, ".npy")


def save_spectrogram(spectrogram: DataFrame, folder: str) -> None:
    _save_by_track(spectrogram.select("track_id", "stem", "frame", "bands"), folder)


def save_waves(signals: DataFrame, folder: str) -> DataFrame:
    """<track>.<stem>.wav of 16 bits for each stem; returns (file, bytes)."""

    @F.pandas_udf("binary")
    def encode(rate: pd.Series, samples: pd.Series) -> pd.Series:
        return pd.Series([encode_wave(int(r), np.asarray(x)) for r, x in zip(rate, samples, strict=True)], dtype=object)

    name = F.concat_ws(".", "track_id", "stem", F.lit("wav"))
    return write_files(signals, folder, name, encode("sample_rate", "samples"))


def encode_wave(rate: int, samples: np.ndarray) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes(np.rint(np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def rounded_timings(timings: DataFrame) -> DataFrame:
    """Timing rows as one JSON object each (column value): times at two decimals, the keys of extra beside the others, nulls left out."""
    known = [c for c in timings.columns if c != "extra"]
    value = lambda c: F.round(c, 2) if c in ("start", "end", "duration") else F.col(c)
    entries = F.filter(F.array(*(F.struct(F.lit(c).alias("key"), value(c).cast("variant").alias("value")) for c in known)), lambda e: e["value"].isNotNull())
    whole = F.map_from_entries(entries)
    if "extra" in timings.columns:
        own = F.map_filter(F.coalesce("extra", F.map_from_entries(F.filter(entries, lambda e: F.lit(False)))), lambda k, _: ~k.isin(*known))
        whole = F.map_concat(whole, own)
    return timings.select(F.to_json(whole).alias("value"))


def append_timings(timings: DataFrame, folder: str) -> None:
    rounded_timings(timings).write.mode("append").text(folder)


def timing_lines(summary: DataFrame, columns: list[str]) -> DataFrame:
    """One tab-separated line a track, na for what is missing."""
    return summary.select(F.concat_ws("\t", "track", *(duration_text(F.col(c)) for c in columns)).alias("value"))


def append_timing_lines(summary: DataFrame, columns: list[str], folder: str) -> None:
    timing_lines(summary, columns).write.mode("append").text(folder)


def save_timing_summary(timings: DataFrame, folder: str) -> None:
    """Totals by stage, and by track and stage, as one JSON row with sorted keys."""
    timing_summary(timings).write.mode("overwrite").json(folder)
