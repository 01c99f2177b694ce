"""Schemas and constants of structure analysis."""

from __future__ import annotations

from pyspark.sql import types as T

# Section labels (a label's place is its class id), stems, stages, and suffixes of audio files.
LABELS = ("start", "end", "intro", "outro", "break", "bridge", "inst", "solo", "verse", "chorus")
STEMS = ("bass", "drums", "other", "vocals")
EXTRA_STEMS = ("guitar", "piano")
STAGES = ("demix", "spec", "json", "viz", "sonify")
AUDIO_SUFFIXES = (".wav", ".flac", ".mp3", ".ogg", ".m4a", ".aac")

SAMPLE_RATE, HOP, FRAME_SIZE, FPS = 44100, 441, 2048, 100

SEGMENT = T.StructType([T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType()), T.StructField("label", T.StringType())])
RESULT = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("bpm", T.IntegerType()),
        T.StructField("beats", T.ArrayType(T.DoubleType())),
        T.StructField("downbeats", T.ArrayType(T.DoubleType())),
        T.StructField("beat_positions", T.ArrayType(T.IntegerType())),
        T.StructField("segments", T.ArrayType(SEGMENT)),
    ]
)
ACTIVATIONS = "track_id string, frame int, p_beat float, p_downbeat float, p_section float, p_function array<float>"
TIMING = "stage string, start double, end double, duration double, device string, model string, track string"
