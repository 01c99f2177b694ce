"""What has to be done again: a manifest of what every stage of every track was made from.

A stage's key is the digest of its name, its options, the track's input and the keys of the stages before it. So a changed input
changes every key of its track, a changed option those of its stage and of all that follows it, and nothing else. Stages whose key
the manifest has are done; all others are to do, with the reason. Keys are computed, not stored in order: no stage has to run to know
what follows it.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tactus.streaming import sink

MANIFEST = "track string, stage string, input string, options string, before string, key string"
DONE, NEW, INPUT, OPTIONS, BEFORE = "done", "new", "input changed", "options changed", "an earlier stage changed"


@dataclass(frozen=True)
class Stage:
    """A stage, the stages whose results it reads, and the options that its result depends on."""

    name: str
    after: tuple[str, ...] = ()
    options: dict[str, Any] = field(default_factory=dict)

    @property
    def digest(self) -> str:
        return hashlib.sha256(json.dumps(self.options, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def in_order(stages: list[Stage]) -> list[Stage]:
    """Each stage behind those it reads; raises for unknown names and circles."""
    left = {s.name: s for s in stages}
    if len(left) < len(stages):
        raise ValueError("two stages have one name")
    if unknown := sorted({a for s in stages for a in s.after} - set(left)):
        raise ValueError(f"unknown stages: {', '.join(unknown)}")
    done: list[Stage] = []
    while left:
        ready = [s for s in left.values() if not set(s.after) & set(left)]
        if not ready:
            raise ValueError(f"stages wait for each other: {', '.join(sorted(left))}")
        done += ready
        for s in ready:
            del left[s.name]
    return done


def expected(inputs: DataFrame, stages: list[Stage]) -> DataFrame:
    """inputs (track, input: a digest) -> a row of MANIFEST and its ordinal for each track and stage. No shuffle: all follows from the row."""
    digest = lambda *parts: F.sha2(F.concat_ws("|", *parts), 256)
    keys: dict[str, Column] = {}
    rows = inputs.select(F.col("track").cast("string").alias("track"), F.col("input").cast("string").alias("input"))
    named = []
    for ordinal, s in enumerate(in_order(stages)):
        before = digest(*(keys[a] for a in sorted(s.after))) if s.after else F.lit("")
        rows = rows.withColumn(f"_before{ordinal}", before)
        rows = rows.withColumn(f"_key{ordinal}", digest(F.lit(s.name), F.lit(s.digest), F.coalesce("input", F.lit("")), F.col(f"_before{ordinal}")))
        keys[s.name] = F.col(f"_key{ordinal}")
        named.append(F.struct(F.lit(ordinal).alias("ordinal"), F.lit(s.name).alias("stage"), F.lit(s.digest).alias("options"), F.col(f"_before{ordinal}").alias("before"), F.col(f"_key{ordinal}").alias("key")))
    each = rows.select("track", "input", F.explode(F.array(*named)).alias("_s"))
    return each.select("track", "_s.stage", "input", "_s.options", "_s.before", "_s.key", "_s.ordinal")


def planned(inputs: DataFrame, stages: list[Stage], manifest: DataFrame) -> DataFrame:
    """expected with status: done, or why the stage is to do. manifest: one row for each track and stage, as `read` gives it."""
    known = manifest.select("track", "stage", *(F.col(c).alias(f"_{c}") for c in ("input", "options", "before", "key")))
    changed = lambda c: ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    status = F.when(F.col("_key").isNull(), NEW).when(~changed("key"), DONE).when(changed("input"), INPUT).when(changed("options"), OPTIONS).otherwise(BEFORE)
    return expected(inputs, stages).join(known, ["track", "stage"], "left").select("track", "stage", "ordinal", "input", "options", "before", "key", status.alias("status"))


def todo(plan: DataFrame, stage: str) -> DataFrame:
    """The tracks for which a stage is to do, as rows to record once it is done."""
    return plan.where((F.col("stage") == stage) & (F.col("status") != DONE)).select("track", "stage", "input", "options", "before", "key")


def record(done: DataFrame, folder: str, run: int, writer: str = "run") -> None:
    """Add rows of MANIFEST as run number `run`; a run that is recorded twice counts once, and of a track's stage the latest run counts."""
    sink.write_batch(done.select(*(c.split()[0] for c in MANIFEST.split(", "))), folder, writer, run)


def next_run(spark: SparkSession, folder: str, writer: str = "run") -> int:
    return max((n for w, n, _ in sink.committed(spark, folder) if w == writer), default=-1) + 1


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The latest row of every track and stage."""
    rows = sink.read(spark, folder, MANIFEST)
    latest = F.max_by(F.struct("input", "options", "before", "key"), F.struct("batch", "writer", "key")).alias("_m")
    return rows.groupBy("track", "stage").agg(latest).select("track", "stage", "_m.*")
