import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tactus.operators import nearest, segments
from tactus.streaming import guard, incremental, islands, sink

BEGAN = datetime(2024, 1, 1)


# --- appends


def test_a_batch_that_is_done_twice_leaves_one_copy(spark, tmp_path):
    out, rows = str(tmp_path / "out"), spark.range(10).select("id", F.lit("x").alias("v"))
    for number, part in ((0, "id < 4"), (1, "id >= 4"), (1, "id >= 4"), (0, "id < 4")):
        sink.write_batch(rows.where(part), out, "a", number)
    sink.write_batch(rows.where("id = 0"), out, "b", 0)  # another writer's batch 0
    got = sink.read(spark, out, rows.schema)
    assert sorted((r["id"], r["writer"], r["batch"]) for r in got.collect()) == sorted([(k, "a", int(k >= 4)) for k in range(10)] + [(0, "b", 0)])
    assert sink.read(spark, out, rows.schema, but=("a", 1)).count() == 5
    assert sink.read(spark, str(tmp_path / "none"), "id long").count() == 0
    (tmp_path / "out" / "writer=a" / "batch=1" / "_SUCCESS").unlink()  # cut off before its end
    assert sink.read(spark, out, rows.schema).count() == 5


def test_a_stream_that_fails_behind_its_write_repeats_the_batch(spark, tmp_path):
    source, out, state = (str(tmp_path / d) for d in ("in", "out", "state"))
    tries = []

    def make(rows, number):
        tries.append(number)
        return rows

    def run(fail):
        stream = spark.readStream.schema("id long").parquet(source)

        def batch(rows, number):
            sink.write_batch(make(rows, number), out, "w", number)
            if fail:
                raise RuntimeError("lost behind the write")

        stream.writeStream.foreachBatch(batch).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination(120)

    spark.range(5).coalesce(1).write.parquet(source)
    for fail in (True, False):
        if fail:
            with pytest.raises(Exception, match="lost behind the write"):
                run(fail)
        else:
            run(fail)
    assert tries == [0, 0] and sorted(r["id"] for r in sink.read(spark, out, "id long").collect()) == list(range(5))


def test_timing_lines_are_appended_by_a_stream(spark, tmp_path):
    line = {"stage": "model_load", "start": 1234567890.123456789, "end": 1234567895.987654321, "duration": 5.864197532}
    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps(line) + "\n")
        stream = spark.readStream.schema("stage string, start double, end double, duration double").json(str(tmp_path / "in"))
        sink.append_timings(stream, str(tmp_path / "out"), str(tmp_path / "state"), "timings").awaitTermination(120)
    rows = sink.read(spark, str(tmp_path / "out"), "stage string, start double, end double, duration double", "json").collect()
    assert len(rows) == 2 and {(r["start"], r["end"], r["duration"]) for r in rows} == {(1234567890.12, 1234567895.99, 5.86)}


def test_new_keys_once_also_when_a_batch_is_repeated(spark, tmp_path):
    source, out, state = (str(tmp_path / d) for d in ("in", "out", "state"))
    schema = spark.createDataFrame([], "track string, v int").schema
    double = lambda rows: rows.withColumn("v", F.col("v") * 2)
    spark.createDataFrame([("a", 1), ("b", 2)], schema).coalesce(1).write.parquet(source)
    incremental.run_new(spark, source, schema, out, state, double, "track").awaitTermination(120)
    spark.createDataFrame([("b", 9), ("c", 3)], schema).coalesce(1).write.mode("append").parquet(source)
    incremental.run_new(spark, source, schema, out, state, double, "track").awaitTermination(120)
    rows = lambda: sorted((r["track"], r["v"]) for r in sink.read(spark, out, schema).collect())
    assert rows() == [("a", 2), ("b", 4), ("c", 6)]
    again = [p for p in (tmp_path / "state" / "commits").iterdir() if p.name.strip(".").startswith("1")]
    for p in again:
        p.unlink()  # as if the last batch had not been told done
    incremental.run_new(spark, source, schema, out, state, double, "track").awaitTermination(120)
    assert rows() == [("a", 2), ("b", 4), ("c", 6)]


# --- the guard


def test_guard_state_get_and_reset(spark, tmp_path):
    """Triggered, sticky, read as a table, reset, and never triggered below the thresholds."""
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    schema = "backend string, ordinal long, event string, max_abs double, mean_abs double"
    batches = [
        [("fast", 1, "check", 1e-3, 1e-4), ("other", 1, "check", 0.0, 0.0)],  # at the thresholds, not above
        [("fast", 2, "check", 1.1e-3, 0.0)],
        [("fast", 3, "check", 0.0, 0.0), ("fast", 4, "note", 9.0, 9.0), ("other", 2, "check", None, None)],
        [("fast", 6, "check", 0.0, 0.0), ("fast", 5, "reset", None, None)],
        [("fast", 7, "check", 0.0, 1.1e-4)],
    ]
    want = [
        {"fast": ("fast", False, 1), "other": ("other", False, 1)}, {"fast": ("slow", True, 2)}, {"fast": ("slow", True, 3), "other": ("other", False, 2)},
        {"fast": ("fast", False, 1)}, {"fast": ("slow", True, 2)},
    ]
    kept = {}
    for number, (rows, expected) in enumerate(zip(batches, want, strict=True)):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        seen = []
        stream = guard.guarded_stream(spark.readStream.schema(schema).parquet(source), "slow")
        keep = lambda batch, n: seen.extend(batch.collect())  # noqa: B023, E731
        stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination(120)
        assert {r["backend"]: (r["effective"], r["triggered"], r["checked"]) for r in seen} == expected
        kept |= expected
        got = guard.guard_state(spark, state, "slow")
        assert {r["backend"]: (r["effective"], r["triggered"], r["checked"]) for r in got.collect()} == kept, number
    before = {r["backend"]: r["effective"] for r in guard.guard_state(spark, state, "slow", 0).collect()}
    assert before == {"fast": "fast", "other": "other"}
    table = spark.createDataFrame([r for b in batches for r in b if r[2] != "note"], schema)
    batch = {(r["backend"], r["ordinal"]): r["effective"] for r in guard.guarded(table, "ordinal", "slow", event="event").collect()}
    assert batch == {("fast", 1): "fast", ("fast", 2): "slow", ("fast", 3): "slow", ("fast", 5): "fast", ("fast", 6): "fast", ("fast", 7): "slow", ("other", 1): "other", ("other", 2): "other"}


# --- islands and nearness


def shuffled_files(spark, rows, schema, folder, most_late=40, per_file=60, seed=0):
    """Files of rows that come up to most_late places late; the last row is far behind, alone."""
    rng = random.Random(seed)
    order = sorted(range(len(rows)), key=lambda k: k + rng.uniform(0, most_late))
    for low in range(0, len(rows), per_file):
        spark.createDataFrame([rows[k] for k in order[low : low + per_file]], schema).coalesce(1).write.mode("append").parquet(folder)
    end = [("end", rows[-1][1] + timedelta(days=99), *rows[-1][2:])]
    spark.createDataFrame(end, schema).coalesce(1).write.mode("append").parquet(folder)


def run(spark, stream, tmp_path, name):
    out = str(tmp_path / name)
    sink.append_once(stream, out, out + "-state", name).awaitTermination(300)
    return sink.read(spark, out, stream.schema).drop("writer", "batch")


def test_streamed_islands_equal_the_batch(spark, tmp_path):
    """Late and shuffled rows, a row for each second, two tracks."""
    rng = random.Random(1)
    rows = [(t, BEGAN + timedelta(seconds=k), k, rng.random() < 0.6, float(rng.randint(0, 5))) for k in range(300) for t in "ab"]
    schema = "track string, time timestamp, frame long, flag boolean, height double"
    shuffled_files(spark, rows, schema, str(tmp_path / "in"))
    stream = islands.islands(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "40 seconds", 3600)
    got = sorted(map(tuple, run(spark, stream, tmp_path, "islands").collect()))
    marked = segments.islands(spark.createDataFrame(rows, schema), "track", "frame", F.col("flag"))
    want = segments.island_peaks(marked, "track", "frame", F.col("height")).select("track", "island", "start", "end", "peak")
    assert got == sorted(map(tuple, want.collect())) and len(got) > 100


def test_a_gap_closes_an_island(spark, tmp_path):
    schema = "track string, time timestamp, frame long, flag boolean, height double"
    at = (0, 1, 2, 50, 51, 52)
    shuffled_files(spark, [("a", BEGAN + timedelta(seconds=s), s, s != 51 or None, None) for s in at], schema, str(tmp_path / "in"))
    stream = islands.islands(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "1 second", 10)
    got = sorted(map(tuple, run(spark, stream, tmp_path, "gaps").collect()))
    assert got == [("a", 1, 0, 3, 0), ("a", 2, 50, 51, 50), ("a", 3, 52, 53, 52)]


def test_streamed_nearness_equals_the_batch(spark, tmp_path):
    rng = random.Random(2)
    times = sorted(rng.sample(range(40_000), 240))
    rows = [("ab"[rng.random() < 0.3], BEGAN + timedelta(milliseconds=20 * s), s, rng.random() < 0.5) for s in times]
    schema = "track string, time timestamp, s long, ref boolean"
    for kind, name in ((True, "ref"), (False, "other")):
        shuffled_files(spark, [r for r in rows if r[3] == kind], schema, str(tmp_path / name), most_late=5, per_file=30)
    read = lambda name: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    apart = run(spark, islands.without_near(read("ref"), read("other"), "60 seconds", "2 seconds", ["s"]), tmp_path, "apart").where("track <> 'end'")
    deltas = run(spark, islands.nearest_deltas(read("ref"), read("other"), "60 seconds", "4 seconds", ["s"]), tmp_path, "deltas").where("track <> 'end'")
    table = spark.createDataFrame(rows, schema).withColumn("us", F.unix_micros("time"))
    ref, other = table.where("ref"), table.where("not ref")
    want = nearest.without_near(ref, other, "track", "us", 2_000_000)
    assert sorted((r["track"], r["s"]) for r in apart.collect()) == sorted((r["track"], r["s"]) for r in want.collect())
    batch = {(r["track"], r["us"]): r["delta"] for r in nearest.nearest_deltas(ref, other, "track", "us").collect()}
    got = {(r["track"], r["us"]): r["delta"] for r in deltas.withColumn("us", F.unix_micros("time")).collect()}
    assert got == {(r["track"], r["us"]): d if (d := batch.get((r["track"], r["us"]))) is not None and abs(d) <= 4_000_000 else None for r in ref.collect()}
    assert sum(d is None for d in got.values()) > 3 and sum(d is not None for d in got.values()) > 30


def test_questions_to_the_state_do_not_grow_with_a_tracks_rows():
    """Each is a message to Spark."""

    class Handle:
        def __init__(self):
            self.asked, self.rows, self.value, self.timers = 0, [], None, []

        def __getattr__(self, name):
            def answer(*x):
                if name in ("getListState", "getMapState", "getValueState"):
                    return self
                self.asked += 1
                if name == "appendList":
                    self.rows += x[0]
                elif name == "listTimers":
                    return iter(self.timers)
                return None

            return answer

    handle, state = Handle(), islands.Islands(1000)
    state.init(handle)
    list(state.handleInputRows(("a",), iter({"ms": k, "frame": k, "flag": True, "height": 1.0} for k in range(500)), None))
    assert handle.asked <= 4 and len(handle.rows) == 500
