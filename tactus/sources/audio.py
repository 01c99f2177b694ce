"""Sources: paths, audio files, stems of external folders, results, timings, verified files."""

from __future__ import annotations

import io
import os
import re
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tactus.functions.columns import basename
from tactus.operators.signal import to_mono
from tactus.operators.stems import first_by_priority, stem_of
from tactus.schema import ACTIVATIONS, AUDIO_SUFFIXES, RESULT, SAMPLE_RATE, STEMS, TIMING
from tactus.sources import arrays
from tactus.sources import waves as waves_source
from tactus.sources.sinks import SIDE_ARRAYS
from tactus.sources.store import file_stem


def paths(spark: SparkSession, *globs: str) -> DataFrame:
    """Distinct files of the globs in order: path, length. Contents are not read."""
    return spark.read.format("binaryFile").load(list(globs)).select("path", "length").distinct().orderBy("path")


def files(spark: SparkSession, *globs: str) -> DataFrame:
    """Distinct files of the globs: path, length, content.

    Spark's driver lists the files in any case; the distinct ones of its list are read where they are, so no content is shuffled to
    drop what two globs name, or to be sorted.
    """
    named = [r["path"] for r in paths(spark, *globs).collect()] if len(globs) > 1 else list(globs)
    return spark.read.format("binaryFile").load(named).select("path", "length", "content")


def distinct_inputs(inputs: DataFrame, column: str) -> DataFrame:
    """Each input once, in order."""
    return inputs.select(column).distinct().orderBy(column)


def first_inputs(inputs: DataFrame, column: str, most: int | None) -> DataFrame:
    """The first so many inputs in order (all with None): each task hands on its own first ones, so the rest isn't sorted."""
    ordered = distinct_inputs(inputs, column)
    return ordered if most is None else ordered.limit(most)


def expanded_path(path: str) -> str:
    """~ expanded and relative paths made absolute; addresses of other stores stay."""
    return path if "://" in path or path.startswith("file:") else os.path.abspath(os.path.expanduser(path))


def missing(inputs: DataFrame, present: DataFrame) -> DataFrame:
    """Paths that are asked for and not there."""
    return inputs.join(present, "path", "left_anti").select("path").orderBy("path")


def require(inputs: DataFrame, present: DataFrame, most_named: int = 20) -> DataFrame:
    """inputs, or one error about all paths that are not there (naming the first of them)."""
    lacking = missing(inputs, present)
    if named := [r["path"] for r in lacking.limit(most_named).collect()]:
        raise FileNotFoundError(f"{lacking.count()} paths are not there: {', '.join(named)}")
    return inputs


def in_order(results: DataFrame, asked: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """results in the caller's order: asked has (path, ordinal). A path asked for without a result has nulls."""
    return asked.join(results, "path", "left").orderBy(ordinal)


def digest(content: Column) -> Column:
    return F.sha2(content, 256)


def decode_wave(content: bytes) -> tuple[int, np.ndarray]:
    """(sample rate, mono samples in -1..1)."""
    with wave.open(io.BytesIO(content)) as f:
        rate, width, channels = f.getframerate(), f.getsampwidth(), f.getnchannels()
        raw = f.readframes(f.getnframes())
    if width == 1:
        samples = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width in (2, 4):
        samples = np.frombuffer(raw, f"<i{width}").astype(np.float32) / 2.0 ** (8 * width - 1)
    else:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        samples = (((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / 2.0**23).astype(np.float32)
    return rate, to_mono(samples.reshape(-1, channels)).astype(np.float32) if channels > 1 else samples


def waves(found: DataFrame) -> DataFrame:
    """files -> (path, sample_rate, samples)."""

    def decode(batches):
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rate, samples = decode_wave(content)
                yield pd.DataFrame({"path": [path], "sample_rate": [rate], "samples": [samples]})

    return found.select("path", "content").mapInPandas(decode, "path string, sample_rate int, samples array<float>")


def stem_signals(spark: SparkSession, folder: str) -> DataFrame:
    """<folder>/<track>/<stem>.wav -> (track_id, stem, sample_rate, samples)."""
    named = waves(files(spark, f"{expanded_path(folder)}/*/*.wav"))
    return named.select(F.element_at(F.split("path", "/"), -2).alias("track_id"), stem_of(basename(F.col("path"))).alias("stem"), "sample_rate", "samples").where("stem is not null")


def played(spark: SparkSession, path: str, rate: int = SAMPLE_RATE) -> DataFrame:
    """(path, sample_rate, samples by channel) of WAV files at one rate: what is played, a row for each file."""
    chunks = waves_source.read(spark, path, mono=False)
    ordered = F.array_sort(F.collect_list(F.struct("chunk", "samples")))  # the chunks of one file
    channels = F.transform(F.sequence(F.lit(0), F.max("channels") - 1), lambda k: F.flatten(F.transform(ordered, lambda c: F.get(c["samples"], k))))
    whole = chunks.groupBy("path", "sample_rate").agg(channels.alias("samples"))
    return at_rate(whole, rate)


def stem_chunks(spark: SparkSession, folder: str, edge: int = 1024, chunk: int = waves_source.CHUNK) -> DataFrame:
    """<folder>/<track>/<stem>.wav in chunks with edges: (track_id, stem, sample_rate, total, chunk, at, samples, left, right), tracks of any length."""
    read = waves_source.read(spark, f"{expanded_path(folder)}/*/*.wav", chunk=chunk, edge=edge)
    named = read.select(F.element_at(F.split("path", "/"), -2).alias("track_id"), stem_of(basename(F.col("path"))).alias("stem"), *read.columns[1:])
    return named.drop("channels").where("stem is not null")


def external_stems(listing: DataFrame, tracks: DataFrame) -> DataFrame:
    """listing (folder, name) x tracks (track): the file of each stem, from the track's own folder before the shared one.

    In the shared folder (empty name) a file must be named as a stem or begin with the track.
    """
    suffixes = [F.lower("name").endswith(s) for s in AUDIO_SUFFIXES]
    audio = suffixes[0]
    for s in suffixes[1:]:
        audio = audio | s
    known = listing.where(audio).withColumn("stem", stem_of(F.col("name"))).where("stem is not null")
    own = known.join(tracks, known["folder"] == tracks["track"]).select("track", "stem", "folder", "name", F.lit(0).alias("_root"))
    bare = F.lower(F.regexp_replace("name", r"\.[^.]*$", ""))
    shared = known.where("folder = ''").withColumn("_plain", bare == F.col("stem"))
    plain = first_by_priority(shared.where("_plain"), ["stem"], "name").collect()  # one row for each of six stems
    named = shared.where("not _plain")
    # What the name begins with meets the track by equality: its beginnings, a few dozen a file.
    starts = F.transform(F.sequence(F.lit(1), F.length("name")), lambda n: F.lower(F.substr("name", F.lit(1), n)))
    begun = named.select("stem", "folder", "name", F.explode(starts).alias("_start")).join(tracks.withColumn("_start", F.lower("track")), "_start")
    both = own.unionByName(begun.select("track", "stem", "folder", "name", F.lit(1).alias("_root")))
    if plain:
        every = F.explode(F.array(*(F.struct(F.lit(r["stem"]).alias("stem"), F.lit(r["name"]).alias("name")) for r in plain))).alias("p")
        both = both.unionByName(tracks.select("track", every).select("track", "p.stem", F.lit("").alias("folder"), "p.name", F.lit(1).alias("_root")))
    return first_by_priority(both, ["track", "stem"], "_root", "name").drop("_root")


def resampled(samples: np.ndarray, rate: int, to: int, lobes: int = 16) -> np.ndarray:
    """Band-limited interpolation under a Hann window of `lobes` zero crossings on each side."""
    if rate == to or not len(samples):
        return samples
    cut = min(1.0, to / rate)
    reach = int(np.ceil(lobes / cut))
    padded = np.pad(samples.astype(np.float64), reach)
    out = np.empty(-(-len(samples) * to // rate))
    for low in range(0, len(out), 1 << 16):
        at = np.arange(low, min(low + (1 << 16), len(out))) * (rate / to)
        base = np.floor(at).astype(np.int64)
        offset = np.arange(-reach + 1, reach + 1)
        x = (at - base)[:, None] - offset
        weight = cut * np.sinc(cut * x) * np.cos(np.pi / 2 * np.clip(x / reach, -1, 1)) ** 2
        out[low : low + len(at)] = (padded[np.minimum(base[:, None] + offset + reach, len(padded) - 1)] * weight).sum(1)
    return out.astype(np.float32)


def at_rate(signals: DataFrame, rate: int) -> DataFrame:
    """signals with all samples at one rate; samples may be an array for each channel."""
    channels = dict(signals.dtypes)["samples"].startswith("array<array")

    def converted(x, own: int):
        return [resampled(np.asarray(c), own, rate) for c in x] if channels else resampled(np.asarray(x), own, rate)

    def convert(batches):
        for batch in batches:
            samples = [converted(x, int(r)) for x, r in zip(batch["samples"], batch["sample_rate"], strict=True)]
            yield batch.assign(samples=samples, sample_rate=rate)

    return signals.mapInPandas(convert, signals.schema)


def equal_rates(signals: DataFrame) -> DataFrame:
    """signals; a track whose stems differ in their rates raises."""
    rates = signals.groupBy("track_id").agg(F.collect_set("sample_rate").alias("_rates"))  # a few a track
    told = F.format_string("%s has stems of several rates", "track_id")
    checked = rates.select("track_id", F.when(F.size("_rates") > 1, F.raise_error(told)).otherwise(F.lit(True)).alias("_equal"))
    return signals.join(checked, "track_id").where("_equal").drop("_equal")


def spectrograms(spark: SparkSession, folder: str) -> DataFrame:
    """(track_id, stem, frame, bands) as sinks.save_spectrogram writes them."""
    return spark.read.schema("stem string, frame int, bands array<float>, track_id string").parquet(folder)


def spectrogram_files(spark: SparkSession, folder: str, stems: tuple[str, ...] = STEMS) -> DataFrame:
    """(track_id, stem, frame, bands) of <track>.npy files with arrays (stems, frames, bands); each task reads a range of frames."""
    rows = arrays.read(spark, f"{folder}/*.npy", axes=2)
    stem = F.array(*map(F.lit, stems))[F.col("index")[0].cast("int")]
    return rows.select(file_stem(F.col("path")).alias("track_id"), stem.alias("stem"), F.col("index")[1].cast("int").alias("frame"), F.col("value").alias("bands"))


def activation_files(spark: SparkSession, folder: str) -> DataFrame:
    """The activations table of <track>.activ.npz files; an array that a file lacks is null. Empty without files."""
    if not arrays.listed(f"{folder}/*.activ.npz"):
        return spark.createDataFrame([], ACTIVATIONS)
    track = F.regexp_replace(basename(F.col("path")), r"\.activ\.npz$", "").alias("track_id")
    rows = arrays.read(spark, f"{folder}/*.activ.npz", (*SIDE_ARRAYS, "label"), flat=True)  # every file is opened once
    of_label = F.col("name") == "label"
    column = F.create_map(*(F.lit(x) for pair in SIDE_ARRAYS.items() for x in pair))[F.col("name")]
    named = rows.select(track, "name", F.col("at").cast("int").alias("at"), "value")  # once for each row, not for each of its entries
    each = named.select("track_id", "name", "at", F.posexplode("value").alias("i", "v")).where(of_label | (F.col("i") == 0))
    frame, k = F.when(of_label, F.col("i")).otherwise(F.col("at")), F.when(of_label, F.col("at")).otherwise(0)
    every = each.select("track_id", frame.alias("frame"), F.when(of_label, "p_function").otherwise(column).alias("part"), k.alias("k"), "v")
    plain = [F.max(F.when(F.col("part") == c, F.col("v"))).cast("float").alias(c) for c in SIDE_ARRAYS.values()]
    classes = F.array_sort(F.collect_list(F.when(F.col("part") == "p_function", F.struct("k", F.col("v").cast("float").alias("v")))))
    function = F.when(F.size(classes) > 0, F.transform(classes, lambda x: x["v"])).alias("p_function")
    return every.groupBy("track_id", "frame").agg(*plain, function)


def embedding_files(spark: SparkSession, folder: str) -> DataFrame:
    """(track_id, stem_idx, frame, fold, vec) of <track>.embed.npy files with arrays (stems, frames, channels, folds). Empty without files."""
    if not arrays.listed(f"{folder}/*.embed.npy"):
        return spark.createDataFrame([], "track_id string, stem_idx int, frame int, fold int, vec array<float>")
    track = F.regexp_replace(basename(F.col("path")), r"\.embed\.npy$", "").alias("track_id")
    rows = arrays.read(spark, f"{folder}/*.embed.npy", axes=2).select(track, F.col("index")[0].cast("int").alias("stem_idx"), F.col("index")[1].cast("int").alias("frame"), "value")
    each = rows.withColumn("fold", F.explode(F.sequence(F.lit(0), F.size(F.col("value")[0]) - 1)))
    return each.select("track_id", "stem_idx", "frame", "fold", F.transform("value", lambda x: F.get(x, F.col("fold")).cast("float")).alias("vec"))


def with_side(results: DataFrame, side: DataFrame, key: str) -> DataFrame:
    """results with what the side table has for them, null where it has nothing."""
    return results.join(side, key, "left")


def results(spark: SparkSession, folder: str, activations: DataFrame | None = None) -> DataFrame:
    """All rows of sinks.save_results, with the activations table beside them where it is given (null where a track has none)."""
    return _beside(spark.read.schema(RESULT).json(folder).select(*RESULT.names), activations)


def result_files(spark: SparkSession, folder: str, activations: DataFrame | None = None) -> DataFrame:
    """The rows of <track>.json files as sinks.save_result_files writes them, one a file."""
    return _beside(spark.read.schema(RESULT).json(f"{folder}/*.json", multiLine=True), activations)


def results_with_files(spark: SparkSession, folder: str, array_folder: str | None = None) -> DataFrame:
    """Rows of <track>.json files and whether side files lie beside them or in array_folder: (*RESULT, track_id, has_activations, has_embeddings).

    The arrays themselves are activation_files and embedding_files, by track_id: they have rows of their own.
    """
    there = arrays.listed(array_folder or folder)
    names = spark.createDataFrame([(uri.rsplit("/", 1)[1],) for uri, _ in there], "name string")
    has = lambda suffix: names.where(F.col("name").endswith(suffix)).select(F.regexp_replace("name", re.escape(suffix) + "$", "").alias("track_id"), F.lit(True).alias(suffix))
    out = result_files(spark, folder).withColumn("track_id", file_stem(F.col("path")))
    for suffix, column in ((".activ.npz", "has_activations"), (".embed.npy", "has_embeddings")):
        out = out.join(has(suffix), "track_id", "left").withColumn(column, F.coalesce(F.col(f"`{suffix}`"), F.lit(False))).drop(suffix)
    return out


def _beside(out: DataFrame, activations: DataFrame | None) -> DataFrame:
    return out if activations is None else with_side(out, activations, "path")


def timings(spark: SparkSession, path: str) -> DataFrame:
    """Timing lines, blank ones left out, with all further keys of a line in extra (map<string, variant>). Raises where there is none.

    Every key keeps its name, type and nesting, so a row can be written again as it was (sinks.append_timings).
    """
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    whole = lines.select(F.from_json("value", TIMING).alias("_t"), F.from_json("value", "map<string,variant>").alias("_all"))
    known = [c.split()[0] for c in TIMING.split(", ")]
    extra = F.map_filter("_all", lambda k, _: ~k.isin(*known)).alias("extra")
    found = whole.where("_t.stage is not null").select("_t.*", extra)
    if found.isEmpty():
        raise ValueError(f"no timings in {path}")
    return found


def verified(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Files whose SHA-256 is that of expected (name, sha256)."""
    named = found.withColumns({"name": basename(F.col("path")), "sha256": digest(F.col("content"))})
    return named.join(expected, ["name", "sha256"], "left_semi")
