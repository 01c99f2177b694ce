import io
import itertools
import json
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from tactus import schema
from tactus.functions import columns as fn
from tactus.operators import hmm, parity, peaks, segments, signal, sound, stems
from tactus.operators.tempo import tempo_candidates
from tactus.sources import audio, sinks
from tactus.streaming import incremental


def test_tempo_ties_and_short_tracks(spark):
    rows = [("a", t) for t in (0.0, 0.5, 1.0, 1.5)] + [("b", 0.0)] + [("c", t) for t in (0.0, 1.0, 1.5, 2.5, 3.0)] + [("d", 1.0), ("d", 1.0)]
    df = spark.createDataFrame(rows, "track string, t double")
    best = {r["track"]: r["bpm"] for r in tempo_candidates(df, "track", ["t"]).where("rank = 1").collect()}
    assert best == {"a": 120, "c": 120}


def test_peaks_equal_numpy(spark):
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=60), 1)
    df = spark.createDataFrame([("t", k, float(v)) for k, v in enumerate(x)], "track string, frame int, v double")
    got = [r["strength"] for r in peaks.peak_strength(df, "track", "frame", "v", 12, 6).orderBy("frame").collect()]
    padded = np.concatenate([np.zeros(12), x, np.zeros(6)])
    for k, s in enumerate(got):
        w = padded[k : k + 19]
        top = x[k] > 0 and x[k] == max(x[max(0, k - 12) : k + 7])
        assert s == pytest.approx(x[k] - (w[:12].sum() / 12 + w[13:].sum() / 6) / 2 if top else 0)


def test_filterbank_and_frames():
    bank = signal.filterbank()
    assert bank.shape == (1024, 81) and np.allclose(bank.sum(0), 1)
    assert len(hmm.beat_lengths()) == 60 and hmm.beat_lengths().sum() == 3719
    x = np.arange(1, 10.0)
    assert signal.frames(x, 4, 2).tolist() == [[0, 0, 1, 2], [1, 2, 3, 4], [3, 4, 5, 6], [5, 6, 7, 8], [7, 8, 9, 0]]
    assert len(signal.frames(np.zeros(22050), 2048, 441)) == 50 and len(signal.frames(np.zeros(22050), 2048, 220.5)) == 100


def tone(hz, rate=44100, seconds=0.5, channels=1):
    t = np.arange(int(rate * seconds)) / rate
    data = (np.sin(2 * np.pi * hz * t) * 0.2 * 32767).astype("<i2")
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes(np.repeat(data, channels).tobytes())
    return out.getvalue()


def test_spectrogram_of_stem_files(spark, tmp_path):
    for stem, hz in zip(schema.STEMS, (110, 220, 330, 440), strict=True):
        (tmp_path / "track1").mkdir(exist_ok=True)
        (tmp_path / "track1" / f"{stem}.wav").write_bytes(tone(hz, channels=2 if stem == "bass" else 1))
    found = audio.stem_signals(spark, str(tmp_path))
    spec = signal.spectrogram(found).toPandas()
    assert sorted(spec.groupby("stem").size().items()) == [(s, 50) for s in sorted(schema.STEMS)]
    assert all(len(b) == 81 for b in spec["bands"])
    loudest = {s: int(np.mean(np.stack(g["bands"]), 0).argmax()) for s, g in spec.groupby("stem")}
    assert loudest["bass"] < loudest["drums"] < loudest["other"] < loudest["vocals"]


def brute_path(bar, density):
    """All paths over the bar's states, textbook steps."""
    n = len(bar.position)
    step = np.full((n, n), -np.inf)
    k = len(bar.lengths)
    for s in range(n - 1):
        if s + 1 not in bar.first:
            step[s, s + 1] = 0
    for i, last in enumerate(bar.last):
        for j in range(k):
            step[last, bar.first[(i // k + 1) % bar.beats * k + j]] = bar.change[i % k, j]
    best = np.full(n, -np.log(n)) + density[0][bar.column]
    for t in range(1, len(density)):
        best = (best[:, None] + step).max(0) + density[t][bar.column]
    return best.max(), step


def test_decoder_is_optimal():
    rng = np.random.default_rng(3)
    bar = hmm.Bar(2, np.array([2, 3]), 2.0, zone=3)
    density = np.log(rng.uniform(0.05, 0.9, (9, 3)))
    path, best = bar.decode(density)
    want, step = brute_path(bar, density)
    assert best == pytest.approx(want)
    total = -np.log(len(bar.position)) + sum(density[t][bar.column[s]] for t, s in enumerate(path)) + sum(step[a, b] for a, b in itertools.pairwise(path))
    assert total == pytest.approx(best)


@pytest.mark.parametrize("meter", [3, 4])
def test_click_trains(spark, meter):
    rows = []
    for frame in range(1200):
        on = frame % 50 == 25
        down = on and (frame // 50) % meter == 0
        rows.append(("t", frame, 0.9 if on else 0.02, 0.85 if down else 0.01))
    df = spark.createDataFrame(rows, "track string, frame int, b double, d double")
    out = hmm.beats(df, "track", "frame", "b", "d").orderBy("time").collect()
    assert len(out) >= 22 and np.allclose(np.diff([r["time"] for r in out]), 0.5)
    assert {r["position"] for r in out} == set(range(1, meter + 1))
    assert all(a["position"] % meter + 1 == b["position"] for a, b in itertools.pairwise(out))
    silent = df.select("track", "frame", F.lit(0.0).alias("b"), F.lit(0.0).alias("d"))
    assert hmm.beats(silent, "track", "frame", "b", "d", threshold=0.24).collect() == []


def test_stem_rules(spark):
    names = {"Bass.wav": "bass", "a (drums).mp3": "drums", "x_vocals.flac": "vocals", "bassline.wav": None, "piano.ogg": "piano"}
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert {r["name"]: r["s"] for r in df.select("name", stems.stem_of(F.col("name")).alias("s")).collect()} == names
    six = [("song", s, i, float(k + 1)) for k, s in enumerate((*schema.STEMS, *schema.EXTRA_STEMS)) for i in range(8 if s != "piano" else 6)]
    df = spark.createDataFrame(six, "track string, stem string, i int, v double")
    out = {(r["stem"], r["i"]): r["v"] for r in stems.collapse_stems(df, "track", "stem", "i", "v").collect()}
    assert out[("other", 0)] == 14 and ("other", 6) not in out and out[("bass", 7)] == 1
    listing = spark.createDataFrame([("", "bass.wav"), ("", "song_drums.wav"), ("", "else_drums.wav"), ("song", "x (bass).wav"), ("song", "notes.txt")], "folder string, name string")
    got = audio.external_stems(listing, spark.createDataFrame([("song",), ("other",)], "track string"))
    assert {(r["track"], r["stem"], r["name"]) for r in got.collect()} == {("song", "bass", "x (bass).wav"), ("song", "drums", "song_drums.wav"), ("other", "bass", "bass.wav")}
    assert stems.overwrite_stages(" JSON, viz ") == {"json", "viz"} and stems.overwrite_stages(True) == set(schema.STAGES)
    assert stems.with_downstream({"spec"}) == {"spec", "json", "viz", "sonify"}
    with pytest.raises(ValueError):
        stems.overwrite_stages("nope")


def test_guard_thresholds(spark):
    df = spark.createDataFrame([(1.1e-3, 0.0), (0.0, 1.1e-4), (1e-3, 1e-4)], "max_abs double, mean_abs double")
    assert [r["triggered"] for r in parity.guard(df).collect()] == [True, True, False]


def test_result_files_round_trip(spark, tmp_path):
    row = ("/a/b.wav", 120, [0.3700000047683716, 1.2345678901234567, 3.0], [0.37], [1, 2, 3], [(0.0, 19.5812, "intro")])
    df = spark.createDataFrame([row, ("/c.wav", None, [], [], [], [])], schema.RESULT)
    text = sinks.pretty_json(df).where("bpm = 120").first()["json"]
    assert '"beats": [0.37,1.23,3.0]' in text and json.loads(text)["segments"][0]["end"] == 19.58 and json.loads(text)["bpm"] == 120
    sinks.save_results(df, str(tmp_path / "out"))
    back = {r["path"]: r for r in audio.results(spark, str(tmp_path / "out")).collect()}
    assert back["/c.wav"]["bpm"] is None and back["/a/b.wav"]["beats"] == [0.37, 1.23, 3.0]
    assert fn.compact_arrays("[\n  1,\n  -2\n]") == "[\n  1,\n  -2\n]" and fn.compact_arrays("[1]") == "[1]"


def test_argmax_takes_the_first(spark):
    df = spark.createDataFrame([([0.1, 0.5, 0.5],)], "p array<double>")
    assert df.select(segments.argmax(F.col("p")).alias("k")).first()["k"] == 1


def test_incremental_runs_take_each_file_once(spark, tmp_path):
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    stage = lambda df: df.select("track", (F.col("v") * 2).alias("w"))
    schema_ = spark.createDataFrame([("a", 1)], "track string, v long").schema
    for n, rows in enumerate([[("a", 1), ("b", 2)], [("b", 9), ("c", 3)]]):
        spark.createDataFrame(rows, schema_).write.mode("append").parquet(source)
        incremental.run_new(spark, source, schema_, out, check, stage, "track").awaitTermination()
        assert spark.read.parquet(out).count() == 2 + n
    assert {tuple(r) for r in spark.read.parquet(out).select("track", "w").collect()} == {("a", 2), ("b", 4), ("c", 6)}


def test_streamed_windows_equal_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    n = [F.count("*").alias("n")]
    stream = spark.readStream.schema(events.schema).parquet("/root/testdata/sf0.001/events.parquet*")
    q = incremental.hopping(stream, "ts", ["user_id"], "1 hour", "30 minutes", n).writeStream.outputMode("complete").format("memory").queryName("hops").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    batch = incremental.hopping(events, "ts", ["user_id"], "1 hour", "30 minutes", n)
    assert sorted(map(str, spark.table("hops").collect())) == sorted(map(str, batch.collect()))


def test_without_the_llm_package(tmp_path):
    """The entry imports and lists the other queries where the llm folders are gone."""
    import pathlib
    import shutil
    import subprocess
    import sys

    repo = pathlib.Path(__file__).parent.parent
    shutil.copytree(repo / "tactus", tmp_path / "tactus", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(repo / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and 'tempo_mode' in q and not any(k.startswith('op') for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)




@pytest.mark.parametrize(("past", "future"), [(3, 3), (5, 1), (1, 7), (40, 40)])
def test_sliding_windows_equal_brute_force(spark, past, future):
    rng = np.random.default_rng(past)
    tracks = {k: np.round(rng.normal(size=n), 1).tolist() for k, n in enumerate((1, 2, 7, 30, 31, 64))}
    df = spark.createDataFrame([(k, 10 * i, v) for k, x in tracks.items() for i, v in enumerate(x)], "track int, frame int, v double")
    rows = {(r["track"], r["frame"] // 10): r for r in peaks.sliding(df, "track", "frame", "v", past, future).collect()}
    for k, x in tracks.items():
        for i in range(len(x)):
            r, low = rows[k, i], max(0, i - past)
            assert r["_top"] == max(x[low : i + future + 1])
            assert r["_before"] == pytest.approx(sum(x[low:i])) and r["_after"] == pytest.approx(sum(x[i + 1 : i + future + 1]))


def dense(bar, density):
    """Viterbi over all states, frame by frame."""
    n, k = len(bar.position), len(bar.lengths)
    change = np.log(np.maximum(hmm.length_changes(bar.lengths, bar.stiffness), 1e-300))
    change[change < -600] = -np.inf
    step = np.full((n, n), -np.inf)
    for state in range(n):
        if state not in bar.last:
            step[state, state + 1] = 0
    for b in range(bar.beats):
        nxt = (b + 1) % bar.beats
        for i in range(k):
            for j in range(k):
                step[bar.last[b * k + i], bar.first[nxt * k + j]] = change[i, j]
    best, back = np.full(n, -np.log(n)) + density[0][bar.column], []
    for row in density[1:]:
        into = best[:, None] + step
        back.append(into.argmax(0))
        best = into.max(0) + row[bar.column]
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1], best.max()


@pytest.mark.parametrize(("beats", "lengths", "stiffness"), [(3, (3, 4, 5), 5.0), (4, (2, 5, 9), 30.0), (2, (1, 2), 1.0), (4, (5, 6, 7, 8), None)])
def test_decoder_equals_a_dense_one(beats, lengths, stiffness):
    rng = np.random.default_rng(beats)
    for frames in (1, 2, 3, 17, 90):
        density = np.log(rng.dirichlet([1, 1, 1], frames))
        bar = hmm.Bar(beats, np.array(lengths), stiffness, zone=4)
        path, score = bar.decode(density)
        want, best = dense(bar, density)
        assert score == pytest.approx(best) and path.tolist() == want
    several = [np.log(rng.dirichlet([1, 1, 1], n)) for n in (7, 1, 40, 7, 12)]
    for (path, score), density in zip(bar.decode_all(several), several, strict=True):
        want, best = dense(bar, density)
        assert score == pytest.approx(best) and path.tolist() == want


@pytest.mark.parametrize("chunk", [4096, 7, 1])
def test_viterbi_equals_brute_force(spark, chunk):
    rng = np.random.default_rng(3)
    step = np.log(rng.dirichlet([1] * 4, 4))
    tracks = {k: rng.normal(size=(n, 4)) for k, n in enumerate((1, 2, 6, 7, 8, 50))}
    rows = [(k, i, *map(float, x)) for k, s in tracks.items() for i, x in enumerate(s)]
    df = spark.createDataFrame(rows, "track int, frame int, a double, b double, c double, d double")
    found = {}
    for r in hmm.viterbi(df, "track", "frame", list("abcd"), step, chunk).collect():
        found[r["track"], r["frame"]] = (r["state"], r["score"])
    for k, s in tracks.items():
        best, back = s[0], []
        for x in s[1:]:
            into = best[:, None] + step
            back.append(into.argmax(0))
            best = into.max(0) + x
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        assert [found[k, i][0] for i in range(len(s))] == path[::-1]
        assert all(found[k, i][1] == pytest.approx(best.max()) for i in range(len(s)))


def test_a_nan_spoils_its_own_windows_alone(spark):
    """Strengths, maxima and sums by brute force, with a NaN, nulls, and windows wider than the track."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=60)
    x[2] = np.nan
    rows = [("t", k, float(v)) for k, v in enumerate(x)] + [("u", k, None if k % 4 == 0 else float(k % 3)) for k in range(9)] + [("one", 0, 5.0)]
    df = spark.createDataFrame(rows, "track string, frame long, v double")
    for past, future in ((2, 2), (3, 1), (0, 4), (20, 100), (1, 0)):
        got = {(r["track"], r["frame"]): r for r in peaks.sliding(df, "track", "frame", "v", past, future).collect()}
        for t in ("t", "u", "one"):
            y = [v for track, _, v in rows if track == t]
            for k in range(len(y)):
                seen = [v for v in y[max(0, k - past) : k + future + 1] if v is not None]
                top = None if not seen else np.nan if np.isnan(seen).any() else max(seen)
                sums = [sum(v or 0.0 for v in side) for side in (y[max(0, k - past) : k], y[k + 1 : k + 1 + future])]
                for name, want in zip(("_top", "_before", "_after"), (top, *sums), strict=True):
                    found = got[t, k][name]
                    assert (found is None) == (want is None) and (want is None or np.isclose(found, want, equal_nan=True)), (past, future, t, k, name)
    strong = peaks.peak_strength(df.where("track = 't'"), "track", "frame", "v", 2, 2).collect()
    assert sum(np.isnan(r["strength"]) for r in strong) <= 5


def test_layouts_are_met_by_a_shuffle(spark):
    """Places are many times the arrays they come from: Spark would take them for small and broadcast them through the driver."""
    rows = [(t, f, b, float(t * 31 + f * 7 + b * b)) for t in range(3) for f in range(5) for b in range(4)]
    levels = spark.createDataFrame(rows, "t long, f long, b long, level double")
    expected = levels.withColumn("f", F.col("f") + 1)
    out = parity.layout_search(expected, levels, "t", "f", "b", [0, 1], 3)
    search = parity.spectrum_search(expected, levels.withColumnRenamed("level", "magnitude"), [1.0], ["ln"], ["t", "f", "b"])
    for df in (out, search):
        assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()
    got = {(r.shift, r.turned, r.whole): r for r in out.collect()}
    assert len(got) == 8
    at = {r[:3]: r[3] for r in rows}
    for (shift, turned, whole), r in got.items():
        laid = [((t, (b if turned else f) + shift, f if turned else b), v) for (t, f, b), v in at.items()]
        d = [abs(at[t, f - 1, b] - v) for (t, f, b), v in laid if (t, f - 1, b) in at and (whole or b < 3)]
        assert (r.mean_abs, r.max_abs) == (pytest.approx(sum(d) / len(d)), max(d))
    assert got[1, False, True].max_abs == 0


def test_tones_are_dealt_before_they_are_samples(spark, monkeypatch):
    """Partitions follow the samples, across borders of stretches; tones of one kind and time add up; no sample is shuffled."""
    monkeypatch.setattr(sound, "STRETCH", 16)
    monkeypatch.setattr(sound, "PART_SAMPLES", 50)
    rows = [("a", s / 1000, kind) for s, kind in ((0, "beat"), (7, "drop"), (7, "drop"), (130, "beat"), (390, "beat"), (400, "beat"), (-5, "beat"))]
    out = sound.rendered(spark.createDataFrame(rows, "path string, time double, kind string"), spark.createDataFrame([("a", 400), ("b", 9)], "path string, samples long"), 1000)
    assert out.rdd.getNumPartitions() == 16  # 100 + 500 + 100 + 100 samples, equal tones once, none behind the end
    want = {}
    for _, time, kind in rows:
        begin, end, seconds, octaves = sound.TONES[kind]
        n, start = int(seconds * 1000), round(time * 1000)
        for k in range(n if 0 <= start < 400 else 0):
            ratio = (end / begin) ** (1 / (n - 1))
            pitch = begin * k if begin == end else begin * (1 - ratio ** (k + 1)) / (1 - ratio)
            if start + k < 400:
                want[start + k] = want.get(start + k, 0) + np.sin(2 * np.pi * pitch / 1000) * 2 ** (-octaves * k / (n - 1))
    got = {r["at"]: r["value"] for r in out.collect()}
    assert set(got) == set(want) and all(abs(got[i] - min(max(v, -1), 1)) < 1e-9 for i, v in want.items())
