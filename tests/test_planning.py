import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tactus.operators import manifest, nearest, parity, quantiles, rollup
from tactus.operators.manifest import Stage
from tactus.sources import audio, cache, sinks

# --- the manifest

STAGES = [Stage("viz", ("json",)), Stage("demix"), Stage("spec", ("demix",), {"size": 2048}), Stage("json", ("spec",), {"threshold": 0.24})]


def statuses(plan):
    return {(r["track"], r["stage"]): r["status"] for r in plan.collect()}


def test_what_changed_is_done_again_and_nothing_else(spark, tmp_path):
    folder = str(tmp_path / "manifest")
    inputs = lambda a="1": spark.createDataFrame([("a", a), ("b", "2")], "track string, input string")
    plan = lambda stages=STAGES, a="1": manifest.planned(inputs(a), stages, manifest.read(spark, folder))
    assert set(statuses(plan()).values()) == {manifest.NEW} and [r["stage"] for r in plan().where("track = 'a'").orderBy("ordinal").collect()] == ["demix", "spec", "json", "viz"]
    for run, stage in enumerate(("demix", "spec", "json", "viz")):
        assert manifest.next_run(spark, folder) == run
        for _ in range(2):  # a run that is recorded twice
            manifest.record(manifest.todo(plan(), stage) if _ == 0 else manifest.expected(inputs(), STAGES).where(F.col("stage") == stage), folder, run)
    assert set(statuses(plan()).values()) == {manifest.DONE} and manifest.read(spark, folder).count() == 8
    changed = statuses(plan(a="9"))
    assert {s for (t, _), s in changed.items() if t == "a"} == {manifest.INPUT} and {s for (t, _), s in changed.items() if t == "b"} == {manifest.DONE}
    other = [*STAGES[:2], Stage("spec", ("demix",), {"size": 4096}), STAGES[3]]
    assert statuses(plan(other)) == {(t, s): w for t in "ab" for s, w in (("demix", manifest.DONE), ("spec", manifest.OPTIONS), ("json", manifest.BEFORE), ("viz", manifest.BEFORE))}
    manifest.record(manifest.todo(plan(other), "spec"), folder, manifest.next_run(spark, folder))
    assert statuses(plan(other))["a", "spec"] == manifest.DONE and statuses(plan(other))["a", "json"] == manifest.BEFORE and statuses(plan())["a", "spec"] == manifest.OPTIONS
    rewired = [Stage("viz", ("json", "demix")), *STAGES[1:]]
    assert statuses(plan(rewired))["b", "viz"] == manifest.BEFORE


def test_order_and_odd_manifests(spark):
    with pytest.raises(ValueError, match="wait for each other: x, y"):
        manifest.in_order([Stage("x", ("y",)), Stage("y", ("x",)), Stage("z")])
    with pytest.raises(ValueError, match="unknown stages: none"):
        manifest.in_order([Stage("x", ("none",))])
    with pytest.raises(ValueError, match="one name"):
        manifest.in_order([Stage("x"), Stage("x")])
    assert Stage("x", (), {"b": 1, "a": [2]}).digest == Stage("x", (), {"a": [2], "b": 1}).digest != Stage("x", (), {"a": [2], "b": 2}).digest
    empty = spark.createDataFrame([], manifest.MANIFEST)
    odd = spark.createDataFrame([(None, None), ("a", None), ("a", None)], "track string, input string")
    assert [r["status"] for r in manifest.planned(odd, [Stage("x")], empty).collect()] == [manifest.NEW] * 3
    assert manifest.planned(odd.limit(0), STAGES, empty).collect() == []


# --- the cache


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_cached_files_are_verified_replaced_and_refused(spark, tmp_path):
    folder, origin = tmp_path / "cache", tmp_path / "origin"
    origin.mkdir()
    payload, other = b"weights" * 1000, b"x" * (9 << 20)
    (origin / "w").write_bytes(payload)
    (origin / "x").write_bytes(other)
    wanted = lambda *rows: spark.createDataFrame(list(rows), "name string, sha256 string, source string")
    run = lambda *rows, **more: {r["name"]: r for r in cache.cached(wanted(*rows), str(folder), **more).collect()}
    w, x = ("w", sha(payload).upper(), f"file://{origin}/w"), ("x", sha(other), str(origin / "x"))
    first = run(w, x, ("again", sha(payload), None))
    assert {k: r["status"] for k, r in first.items()} == {"w": "fetched", "x": "fetched", "again": "fetched"} and first["w"]["path"] == first["again"]["path"]
    place = folder / sha(payload)[:2] / sha(payload)
    assert place.read_bytes() == payload
    (origin / "w").unlink()
    assert run(w)["w"]["status"] == "kept"  # offline
    place.write_bytes(b"spoiled")
    with pytest.raises(ValueError, match="w missing"):
        run(w)
    assert not place.exists()
    (origin / "w").write_bytes(payload)
    place.write_bytes(b"spoiled")
    assert run(w)["w"]["status"] == "replaced" and place.read_bytes() == payload
    (origin / "bad").write_bytes(b"something else")
    with pytest.raises(ValueError, match="bad rejected"):
        run(("bad", sha(b"asked for"), str(origin / "bad")))
    told = run(("bad", sha(b"asked for"), str(origin / "bad")), ("none", sha(b"z"), None), w, strict=False)
    assert {k: r["status"] for k, r in told.items()} == {"bad": "rejected", "none": "missing", "w": "kept"} and told["bad"]["path"] is None
    assert sorted(p.name for p in folder.rglob("*") if p.is_file()) == sorted([sha(payload), sha(other)])  # no temporary file stays
    with pytest.raises(ValueError, match="without a digest"):
        run(("n", None, None))
    assert run() == {}


# --- quantiles


def test_estimates_are_within_their_bound(spark):
    """A hot group, ties, a group of few values, one without any; parts merged."""
    rng = np.random.default_rng(0)
    groups = {"hot": rng.normal(size=60_000), "ties": rng.integers(0, 5, 5000).astype(float), "few": np.arange(700.0), "one": np.array([3.0])}
    rows = spark.createDataFrame([(g, float(v)) for g, x in groups.items() for v in x] + [("few", None), ("few", float("nan")), ("none", None)], "g string, v double").repartition(8)
    ps = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    parts = quantiles.sketches(rows.withColumn("part", F.spark_partition_id() % 3), ["g", "part"], "v")
    found = quantiles.estimates(quantiles.merged(parts, ["g"]), ["g"], ps)
    ranked = quantiles.ranked(rows, ["g"], "v", found).collect()
    assert len(ranked) == 4 * len(ps)
    for r in ranked:
        x = np.sort(groups[r["g"]])
        assert r["n"] == len(x) and r["below"] == (x < r["estimate"]).mean() and r["upto"] == (x <= r["estimate"]).mean()
        error = 2 * quantiles.rank_error() if len(x) > quantiles.SIZE else 1 / len(x)
        assert r["below"] <= r["p"] + error and r["upto"] >= r["p"] - error, r
    assert [r["estimate"] for r in found.where("g = 'none'").collect()] == [None] * len(ps)
    assert 0.004 < quantiles.rank_error() < 0.006
    assert max(r["n"] for r in parts.select(F.length("sketch").alias("n")).collect()) < 40_000
    exact = parity.summary(rows.where("g <> 'none' and not isnan(v)"), ["g"], "v").orderBy("g").collect()
    near = quantiles.summary(rows.where("g <> 'none' and not isnan(v)"), ["g"], "v").orderBy("g").collect()
    assert [(r["mean"], r["min"], r["max"]) for r in exact] == [(r["mean"], r["min"], r["max"]) for r in near] and abs(exact[1]["median"] - near[1]["median"]) < 0.05
    deltas = rows.where("g = 'hot'").withColumnRenamed("v", "delta")
    a, b = nearest.delta_summary(deltas, "g").first(), quantiles.delta_summary(deltas, "g").first()
    assert set(a.asDict()) == set(b.asDict()) and a["n"] == b["n"] and abs(a["p90_abs"] - b["p90_abs"]) < 0.05


# --- timing rows


def test_timing_rows_keep_keys_of_their_own(spark, tmp_path):
    lines = ['{"stage":"nn","start":1.239,"end":2.5,"duration":1.261,"track":"a","batch":4,"shape":[4,19557,81],"deep":{"fast":true,"note":"x"},"none":null}', "", "  ",
             '{"stage":"load","start":0.111,"end":1,"duration":0.889,"device":"cpu","model":"m"}']
    (tmp_path / "t.jsonl").write_text("\n".join(lines) + "\n")
    t = audio.timings(spark, str(tmp_path / "t.jsonl"))
    first = t.where("stage = 'nn'").select(F.variant_get(F.col("extra")["shape"], "$[1]", "int").alias("n"), F.variant_get(F.col("extra")["deep"], "$.fast", "boolean").alias("fast"), F.array_sort(F.map_keys("extra")).alias("keys")).first()
    assert (first["n"], first["fast"], first["keys"]) == (19557, True, ["batch", "deep", "none", "shape"])
    for _ in range(2):
        sinks.append_timings(t, str(tmp_path / "out"))
    again = audio.timings(spark, str(tmp_path / "out"))
    assert again.count() == 4
    text = sorted({r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()})
    assert len(text) == 2 and '"start":1.24' in text[1] and '"shape":[4,19557,81]' in text[1] and '"deep":{"fast":true,"note":"x"}' in text[1] and '"device"' not in text[1] and '"none":null' in text[1]
    assert [r["stage"] for r in rollup.stage_totals(again, "stage", "track", F.col("duration")).where("by_track").collect()] == ["nn"]
    plain = spark.createDataFrame([("x", 1.005, None)], "stage string, start double, track string")
    sinks.append_timings(plain, str(tmp_path / "plain"))
    assert spark.read.text(str(tmp_path / "plain")).first()["value"] in ('{"stage":"x","start":1.0}', '{"stage":"x","start":1.01}')


def test_totals_and_charts_of_many_tracks(spark):
    rows = [("load", 0.0, 1.0, 1.004, "a"), ("nn", 1.0, 3.0, 2.0, "a"), ("dbn", 3.0, 4.0, 1.0, "a"), ("nn", 10.0, 12.0, 2.0, "b"), ("load", 5.0, 6.0, 1.0, None)]
    df = spark.createDataFrame(rows, "stage string, start double, end double, duration double, track string")
    assert {r["track"]: r["stages"] for r in rollup.track_totals(df).collect()} == {None: {"dbn": 1.0, "load": 2.0, "nn": 4.0}, "a": {"dbn": 1.0, "load": 1.0, "nn": 2.0}, "b": {"nn": 2.0}}
    bars = sorted(tuple(r) for r in rollup.timing_charts(df, ["nn", "dbn"]).collect())
    assert bars == [("", "load", 0.0, 1.0, 1.0, 1.0), ("a", "load", 0.0, 1.0, 1.0, 4.0), ("a", "post process", 1.0, 4.0, 3.0, 4.0), ("b", "post process", 0.0, 2.0, 2.0, 2.0)]
