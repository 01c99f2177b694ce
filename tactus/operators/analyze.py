"""From activations, or from stem signals, to one result row for each track; and the tables that renderers draw."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tactus.operators import hmm, peaks, score, segments, signal
from tactus.operators.tempo import tempo_candidates
from tactus.schema import FPS, LABELS, STEMS


def track_segments(activations: DataFrame, past: int = 12 * FPS, future: int = 12 * FPS) -> DataFrame:
    """(track_id, segment, start, end, label): start and end in seconds."""
    strong = peaks.peak_strength(activations, "track_id", "frame", "p_section", past, future)
    cut = segments.segment_ids(strong, "track_id", "frame", F.col("strength") > 0)
    classes = cut.withColumns({f"_c{k}": F.col("p_function")[k] for k in range(len(LABELS))})
    named = segments.segment_labels(classes, "track_id", [f"_c{k}" for k in range(len(LABELS))])
    label = F.element_at(F.array(*map(F.lit, LABELS)), (F.col("label_id") + 1).cast("int")).alias("label")
    spans = segments.segments(cut, "track_id", "frame").join(named, ["track_id", "segment"])
    return spans.select("track_id", "segment", *(segments.seconds(F.col(c)).alias(c) for c in ("start", "end")), label)


def analyze_activations(activations: DataFrame, threshold: float = 0.24) -> DataFrame:
    """activations -> (path, bpm, beats, downbeats, beat_positions, segments). bpm is null with fewer than two beats."""
    beats = hmm.beats(activations, "track_id", "frame", "p_beat", "p_downbeat", (3, 4), FPS, threshold)
    ordered = F.array_sort(F.collect_list(F.struct("time", "position")))
    by_track = beats.groupBy("track_id").agg(ordered.alias("_b"))
    bpm = tempo_candidates(beats, "track_id", ["time"]).where("rank = 1").select("track_id", F.col("bpm").cast("int"))
    spans = track_segments(activations).groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "label"))).alias("segments"))
    none = F.array().cast("array<struct<time:double,position:int>>")
    out = spans.join(by_track, "track_id", "left").join(bpm, "track_id", "left").withColumn("_b", F.coalesce("_b", none))
    downbeats = F.transform(F.filter("_b", lambda b: b["position"] == 1), lambda b: b["time"])
    return out.select(F.col("track_id").alias("path"), "bpm", F.col("_b.time").alias("beats"), downbeats.alias("downbeats"), F.col("_b.position").alias("beat_positions"), "segments")


def analyze(signals: DataFrame, scorers: list[score.Scorer], threshold: float = 0.24) -> DataFrame:
    """signals (track_id, stem, sample_rate, samples) -> results, scored by an ensemble of networks or of any callables like them."""
    return analyze_spectrogram(signal.spectrogram(signals), scorers, threshold)


def analyze_spectrogram(spectrogram: DataFrame, scorers: list[score.Scorer], threshold: float = 0.24) -> DataFrame:
    """spectrogram (track_id, stem, frame, bands) -> results."""
    return analyze_activations(score.ensemble(score.scores(spectrogram, scorers, STEMS)), threshold)


def clicks(results: DataFrame, radius: float = 0.03) -> DataFrame:
    """(path, time, kind): what a sonification plays: downbeats, beats that are no downbeat, and section boundaries."""
    down = results.select("path", F.explode("downbeats").alias("time"), F.lit("downbeat").alias("kind"))
    apart = F.filter("beats", lambda b: ~F.exists(F.col("downbeats"), lambda d: F.abs(b - d) <= radius))
    plain = results.select("path", F.explode(apart).alias("time"), F.lit("beat").alias("kind"))
    inner = results.select("path", F.explode("segments").alias("s")).where(~F.col("s.label").isin("start", "end"))
    return down.unionByName(plain).unionByName(inner.select("path", F.col("s.start").alias("time"), F.lit("boundary").alias("kind")))
