"""Stems: names from file names, priority of folders, collapse of six stems to four; planning by what exists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tactus.schema import EXTRA_STEMS, STAGES, STEMS

#: Tracks that an error names at most.
MOST_NAMED = 20


def stem_of(file_name: Column) -> Column:
    """The first stem that the name is, or names in brackets, or ends with after an underscore."""
    name = F.lower(file_name)
    bare = F.regexp_replace(name, r"\.[^.]*$", "")
    hits = [(bare == s) | name.contains(f"({s})") | name.contains(f"_{s}.") for s in STEMS + EXTRA_STEMS]
    return F.coalesce(*(F.when(h, F.lit(s)) for h, s in zip(hits, STEMS + EXTRA_STEMS, strict=True)))


def first_by_priority(found: DataFrame, keys: list[str], *order) -> DataFrame:
    """One row for each key: the first in the order."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return found.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def stem_sets(samples: DataFrame, track: str, stem: str) -> DataFrame:
    """(track, mode, missing): mode is external_6_to_4, external_4 or null; missing: what lacks of four and of six."""
    have = samples.groupBy(track).agg(F.collect_set(stem).alias("_have"))  # at most as many as there are stems
    lacks = {name: F.array_except(F.array(*map(F.lit, names)), "_have") for name, names in (("four", STEMS), ("six", STEMS + EXTRA_STEMS))}
    mode = F.when(F.size(lacks["six"]) == 0, "external_6_to_4").when(F.size(lacks["four"]) == 0, "external_4")
    return have.select(track, mode.alias("mode"), F.struct(*(c.alias(k) for k, c in lacks.items())).alias("missing"))


def collapse_stems(samples: DataFrame, track: str, stem: str, at: str, value: str, strict: bool = True) -> DataFrame:
    """(track, stem, at, value): of six stems guitar and piano are added to other; four pass, any others are left out.

    What is summed is cut to the shortest. Tracks with neither set raise a ValueError that says what (the first of them) lack; with
    strict off they are left out. The check is a pass of its own before anything is summed, so there is one error, in one place.
    """
    sets = stem_sets(samples, track, stem)
    if strict:
        lacking = F.format_string("%s lacks %s of four stems, %s of six", F.col(track).cast("string"), *(F.array_join(f"missing.{k}", ", ") for k in ("four", "six")))
        told = [r["_told"] for r in sets.where("mode is null").orderBy(track).select(lacking.alias("_told")).limit(MOST_NAMED).collect()]
        if told:
            raise ValueError("; ".join(told))
    whole = samples.join(sets.select(track, F.col("mode").alias("_mode")), track).where("_mode is not null")
    four = F.when(F.col(stem).isin(*EXTRA_STEMS), F.when(F.col("_mode") == "external_6_to_4", "other")).otherwise(F.col(stem))
    merged = whole.withColumn("_four", four).where(F.col("_four").isin(*STEMS))
    parts = merged.groupBy(track, "_four").agg(F.count_distinct(stem).alias("_parts"))
    summed = merged.groupBy(track, "_four", at).agg(F.sum(value).alias(value), F.count_distinct(stem).alias("_n"))
    return summed.join(parts, [track, "_four"]).where("_n = _parts").select(track, F.col("_four").alias(stem), at, value)


def missing_stems(samples: DataFrame, track: str, stem: str) -> DataFrame:
    """(track, missing): what each track lacks of the four stems; empty if complete."""
    have = samples.groupBy(track).agg(F.collect_set(stem).alias("_have"))
    return have.select(track, F.array_sort(F.array_except(F.array(*map(F.lit, STEMS)), "_have")).alias("missing"))


def todo(inputs: DataFrame, done: DataFrame, key: str, overwrite: bool = False) -> DataFrame:
    """Inputs whose output does not exist yet (all with overwrite)."""
    return inputs if overwrite else inputs.join(done, key, "left_anti")


def done(inputs: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """Inputs whose output exists."""
    return inputs.join(outputs, key, "left_semi")


def cached_and_new(inputs: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """(key, origin): what is cached, as often as it is, and what is to be done."""
    fresh = todo(inputs.select(key), outputs, key)
    return outputs.select(key).withColumn("origin", F.lit("cached")).unionByName(fresh.withColumn("origin", F.lit("new")))


def apart(rows: DataFrame, others: DataFrame) -> DataFrame:
    """Distinct rows that are not among the others."""
    return rows.subtract(others)


def plan_counts(inputs: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """One row: existing and todo."""
    marked = inputs.join(outputs.select(key).distinct().withColumn("_done", F.lit(True)), key, "left")
    return marked.agg(F.count_if("_done").alias("existing"), F.count_if(F.col("_done").isNull()).alias("todo"))


def complete(parts: DataFrame, key: str, part: str, needed: int) -> DataFrame:
    """Keys that have all parts."""
    return parts.groupBy(key).agg(F.count_distinct(part).alias("_n")).where(F.col("_n") == needed).select(key)


def overwrite_stages(value: str | bool | None) -> set[str]:
    """The stages named in a comma-separated list; "all" or True for all. Unknown names raise."""
    if value is None or value is False:
        return set()
    named = {x.strip().lower() for x in str(value).split(",")} - {""} if value is not True else {"all"}
    if "all" in named:
        return set(STAGES)
    if unknown := sorted(named - set(STAGES)):
        raise ValueError(f"unknown stages: {', '.join(unknown)}; known: {', '.join(STAGES)}")
    return named


def with_downstream(stages: set[str]) -> set[str]:
    """A stage that is done again makes those after it be done again."""
    first = min((STAGES.index(s) for s in stages), default=len(STAGES))
    return stages | set(STAGES[first:])


def ensemble_mean(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Mean of scalar columns over the members of an ensemble."""
    return rows.groupBy(*keys).agg(*(F.avg(F.col(v).cast("double")).alias(v) for v in values))


