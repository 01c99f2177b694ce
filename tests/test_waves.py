import io
import struct
import wave

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tactus.operators import signal
from tactus.sources import arrays, audio, waves

RNG = np.random.default_rng(0)


def riff(rate, x, width, code=1, extra=b"", size=None, tag=b"RIFF"):
    """x: (samples, channels) as stored."""
    data = x.tobytes() if width != 3 else np.ascontiguousarray(x.astype("<i4")).view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    fmt = struct.pack("<HHIIHH", code, x.shape[1], rate, rate * width * x.shape[1], width * x.shape[1], 8 * width)
    body = extra + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"LIST\x03\0\0\0abc\0" + b"data" + struct.pack("<I", len(data) if size is None else size) + data
    return tag + struct.pack("<I", (4 + len(body)) & 0xFFFFFFFF if size is None else size) + b"WAVE" + body


def stored(width, code, n, channels):
    if code == 3:
        return RNG.uniform(-1, 1, (n, channels)).astype(f"<f{width}")
    if width == 1:
        return RNG.integers(0, 256, (n, channels)).astype("u1")
    top = 1 << (8 * width - 1)
    return RNG.integers(-top, top, (n, channels)).astype(f"<i{4 if width == 3 else width}")


def as_floats(x, width, code):
    return x.astype(float) if code == 3 else (x.astype(float) - 128) / 128 if width == 1 else x.astype(float) / 2.0 ** (8 * width - 1)


def joined(df, column="samples"):
    rows = df.orderBy("path", "at").collect()
    assert [r["at"] for r in rows] == [r["chunk"] * len(rows[0]["samples"]) for r in rows] or len(rows) == 1
    return np.concatenate([np.array(r[column]) for r in rows])


@pytest.mark.parametrize(("width", "code", "channels"), [(1, 1, 1), (2, 1, 1), (2, 1, 2), (3, 1, 2), (4, 1, 1), (4, 3, 2), (8, 3, 1)])
def test_every_encoding_by_range(spark, tmp_path, width, code, channels):
    x = stored(width, code, 1000, channels)
    (tmp_path / "x.wav").write_bytes(riff(8000, x, width, code))
    want = as_floats(x, width, code)
    for split in (1 << 20, 300):
        df = waves.read(spark, str(tmp_path / "x.wav"), chunk=64, split_bytes=split)
        assert np.allclose(joined(df), want.mean(1), atol=1e-6) and df.select("sample_rate", "channels", "total").distinct().collect() == [(8000, channels, 1000)]
    apart = waves.read(spark, str(tmp_path / "x.wav"), mono=False, chunk=300).orderBy("at").collect()
    assert np.allclose(np.concatenate([np.array(r["samples"]) for r in apart], 1), want.T, atol=1e-6)
    if code == 1:
        assert np.allclose(audio.decode_wave((tmp_path / "x.wav").read_bytes())[1], want.mean(1), atol=1e-6)


def test_headers_and_odd_files(spark, tmp_path):
    x = stored(2, 1, 50, 1)
    plain = riff(8000, x, 2)
    files = {
        "a": plain, "long": riff(8000, x, 2, extra=b"ds64" + struct.pack("<IQQQI", 28, 0, 100, 0, 0), size=0xFFFFFFFF, tag=b"RF64"),
        "unknown": riff(8000, x, 2, size=0xFFFFFFFF), "zero": riff(8000, x, 2, size=0), "cut": plain[:-20], "none": riff(8000, x[:0], 2),
    }
    for name, data in files.items():
        (tmp_path / f"{name}.WAV").write_bytes(data)
    (tmp_path / "note.txt").write_text("no sound")
    counts = {r["path"].rsplit("/", 1)[1]: r["n"] for r in waves.read(spark, str(tmp_path)).groupBy("path").agg(F.sum(F.size("samples")).alias("n")).collect()}
    assert counts == {"a.WAV": 50, "long.WAV": 50, "unknown.WAV": 50, "zero.WAV": 50, "cut.WAV": 40}
    assert waves.read(spark, str(tmp_path / "nothing*")).count() == 0
    for name, data, told in (("x", b"RIFX....WAVE", "no WAV"), ("y", riff(8000, x, 2, code=85), "encoding 85"), ("z", plain[:36], "no samples")):
        (tmp_path / "bad").mkdir(exist_ok=True)
        (tmp_path / "bad" / f"{name}.wav").write_bytes(data)
        with pytest.raises(PySparkException, match=told):
            waves.read(spark, str(tmp_path / "bad" / f"{name}.wav")).collect()


@pytest.mark.parametrize(("length", "rate", "chunk"), [(3000, 8000, 64), (5000, 22050, 999), (4096, 44100, 4096), (10, 8000, 64), (2049, 8000, 2048)])
def test_frames_of_chunks_equal_those_of_the_whole(spark, tmp_path, length, rate, chunk):
    """At every border, by the source's edges and by the shuffle."""
    x = stored(2, 1, length, 1)
    (tmp_path / "x.wav").write_bytes(riff(rate, x, 2))
    whole, hop = as_floats(x, 2, 1)[:, 0].astype(np.float32), rate / 100
    want = signal.frames(whole, 256, hop)
    from_source = waves.read(spark, str(tmp_path / "x.wav"), chunk=chunk, edge=128, split_bytes=2 * chunk)
    shuffled = signal.with_edges(waves.read(spark, str(tmp_path / "x.wav"), chunk=chunk).repartition(3), "path", 128)
    keep = [c for c in from_source.columns if c != "channels"]
    assert sorted(map(str, from_source.select(keep).collect())) == sorted(map(str, shuffled.select(keep).collect()))
    rows = signal.chunk_frames(shuffled, "path", 256, hop).orderBy("frame").collect()
    assert [r["frame"] for r in rows] == list(range(len(want))) and np.array_equal(np.array([r["samples"] for r in rows]), want.astype(float))
    bank = signal.filterbank(rate, 256) if rate > 8000 else signal.filterbank(rate, 2048)
    size = 2 * len(bank)
    edged = waves.read(spark, str(tmp_path / "x.wav"), chunk=chunk, edge=size // 2)
    got = signal.chunk_spectrogram(edged, ["path"], size).orderBy("frame").collect()
    assert np.allclose([r["bands"] for r in got], signal.log_spectrum(whole, bank, size, hop), atol=1e-6) and [r["frame"] for r in got] == list(range(len(want)))


def test_edges_over_several_tracks_and_chunks(spark):
    x = {f"t{k}": list(map(float, range(n))) for k, n in enumerate((1, 5, 6, 17))}
    rows = [(t, c, 3 * c, len(v), v[3 * c : 3 * c + 3]) for t, v in x.items() for c in range(-(-len(v) // 3))]
    df = spark.createDataFrame([*rows, ("empty", 0, 0, 0, [])], "track string, chunk long, at long, total long, samples array<double>").repartition(4)
    for edge in (0, 2, 3, 7, 100):
        got = {(r["track"], r["chunk"]): r for r in signal.with_edges(df, "track", edge).collect()}
        assert set(got) == {(t, c) for t, c, *_ in rows}
        for (t, c), r in got.items():
            at = 3 * c
            assert (r["at"], r["total"], r["samples"]) == (at, len(x[t]), x[t][at : at + 3])
            assert r["left"] == x[t][max(0, at - edge) : at] and r["right"] == x[t][at + 3 : at + 3 + edge]


def test_ten_hours_in_bounded_pieces(spark, tmp_path):
    """288 MB of samples with a mark at every hour: no row has more than a chunk, no partition more than its share."""
    hours, rate = 10, 8000
    total = hours * 3600 * rate
    head = bytearray(riff(rate, np.zeros((0, 1), "u1"), 1))
    head[-4:] = struct.pack("<I", total)
    with open(tmp_path / "long.wav", "wb") as f:
        f.write(head)
        f.truncate(len(head) + total)  # zeros: the lowest sample
        for h in range(hours):
            f.seek(len(head) + h * 3600 * rate)
            f.write(b"\xff")
    df = waves.read(spark, str(tmp_path / "long.wav"), split_bytes=16 << 20)
    assert df.rdd.getNumPartitions() == -(-total // (16 << 20))
    loud = F.filter("samples", lambda s: s > 0)
    seen = df.agg(F.sum(F.size("samples")), F.max(F.size("samples")), F.sum(F.size(loud))).first()
    assert tuple(seen) == (total, waves.CHUNK, hours)
    marks = df.where(F.size(loud) > 0).select((F.col("at") + F.array_position("samples", F.array_max("samples")) - 1).alias("i")).collect()
    assert sorted(r["i"] for r in marks) == [h * 3600 * rate for h in range(hours)]


def test_files_are_read_once_whatever_names_them(spark, tmp_path):
    for name in ("b", "a"):
        with wave.open(str(tmp_path / f"{name}.wav"), "wb") as f:
            f.setparams((1, 2, 8000, 0, "NONE", ""))
            f.writeframes(b"\0\0" * 10)
    found = audio.files(spark, str(tmp_path / "*.wav"), str(tmp_path / "a.wav"))
    assert found.count() == 2 and [r["path"][-5:] for r in audio.paths(spark, str(tmp_path / "*.wav"), str(tmp_path / "a*")).collect()] == ["a.wav", "b.wav"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # no content moves
    assert io.BytesIO(found.first()["content"]).read(4) == b"RIFF"


def test_stereo_is_played_at_one_rate(spark, tmp_path):
    t = np.arange(8000) / 8000
    x = np.stack([np.sin(2 * np.pi * 300 * t), np.sin(2 * np.pi * 500 * t)], 1)
    (tmp_path / "s.wav").write_bytes(riff(8000, np.rint(x * 32767).astype("<i2"), 2))
    (tmp_path / "m.wav").write_bytes(riff(44100, np.rint(x[:, :1] * 32767).astype("<i2"), 2))
    rows = {r["path"][-5]: r for r in audio.played(spark, str(tmp_path)).collect()}
    assert {r["sample_rate"] for r in rows.values()} == {44100} and len(rows["m"]["samples"]) == 1 and len(rows["m"]["samples"][0]) == 8000
    got, n = np.array(rows["s"]["samples"]), np.arange(44100) / 44100
    assert got.shape == (2, 44100)
    for channel, hz in enumerate((300, 500)):
        assert np.abs(got[channel, 500:-500] - np.sin(2 * np.pi * hz * n)[500:-500]).max() < 0.01


def test_many_small_files_are_few_partitions(spark, tmp_path):
    """Parts of a few bytes, asked for over many files, are put together; every sample is read once."""
    for k in range(1500):
        (tmp_path / f"{k}.wav").write_bytes(riff(8000, np.full((20 + k % 60, 1), k, "<i2"), 2))
    df = waves.read(spark, str(tmp_path), chunk=16, split_bytes=128)
    assert df.rdd.getNumPartitions() <= 1.5 * arrays.MOST_PARTS
    got = {r["path"].rsplit("/", 1)[1]: (r["n"], r["low"], r["high"]) for r in df.select("path", F.explode("samples").alias("v")).groupBy("path").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()}
    assert got == {f"{k}.wav": (20 + k % 60, k / 32768, k / 32768) for k in range(1500)}
    assert sum(1 for b in waves.WaveReader(str(tmp_path), True, 16, 0, 1 << 20).read(waves.Part([(f"{tmp_path}/{k}.wav", 200) for k in range(100)]))) == 1
