import resource

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tactus import schema
from tactus.plans import catalog
from tactus.sources import arrays, audio, sinks

RNG = np.random.default_rng(0)
KINDS = ["?", "i1", "<i2", ">i4", "i8", "u1", "u2", "u4", "u8", "f2", "<f4", ">f8", "U5", "S4"]


def made(kind, shape):
    if kind[0] in "US":
        return np.array([f"é{k}"[: 3] if kind[0] == "U" else b"a%d" % k for k in range(int(np.prod(shape)))]).astype(kind).reshape(shape)
    return (RNG.random(shape) * 100).astype(kind)


def rows(df):
    return [r["value"] for r in df.orderBy("path", "name", "at").collect()]


def plain(value):
    return [plain(v) for v in value] if isinstance(value, (list, np.ndarray)) else float(value) if isinstance(value, (np.floating, float)) else bytes(value) if isinstance(value, (bytes, bytearray, memoryview)) else value if isinstance(value, str) else int(value)


@pytest.mark.parametrize("kind", KINDS)
def test_files_of_numpy_are_read(spark, tmp_path, kind):
    for shape in ((7,), (5, 3), (4, 2, 3)):
        x = made(kind, shape)
        np.save(tmp_path / "x.npy", x)
        assert plain(rows(arrays.read(spark, str(tmp_path / "x.npy")))) == plain(x)
        np.savez(tmp_path / "y.npz", a=x, b=x[:0])
        np.savez_compressed(tmp_path / "z.npz", a=x)
        np.save(tmp_path / "f.npy", np.asfortranarray(x))
        for name, member in (("y.npz", "a"), ("z.npz", "a"), ("f.npy", None)):
            for split in (1 << 20, 16):  # as a whole, and some rows to a partition
                assert plain(rows(arrays.read(spark, str(tmp_path / name), member, split_bytes=split))) == plain(x), (name, split, shape)


def test_axes_flat_and_odd_files(spark, tmp_path):
    x = RNG.random((4, 5, 3)).astype("f4")
    np.save(tmp_path / "x.npy", x)
    got = arrays.read(spark, str(tmp_path / "x.npy"), axes=2, split_bytes=30).orderBy("at").collect()
    assert [r["index"] for r in got] == [[i, j] for i in range(4) for j in range(5)] and np.array_equal([r["value"] for r in got], x.reshape(20, 3))
    assert np.allclose(rows(arrays.read(spark, str(tmp_path), flat=True)), x.reshape(4, 15))
    np.save(tmp_path / "n.npy", np.float64(2.5))
    assert rows(arrays.read(spark, str(tmp_path / "n.npy"))) == [2.5]
    np.save(tmp_path / "e.npy", np.zeros((0, 3)))
    assert rows(arrays.read(spark, str(tmp_path / "e.npy"))) == []
    np.savez(tmp_path / "m.npz", a=np.zeros(3), b=np.zeros((2, 2), "i4"))
    assert arrays.read(spark, str(tmp_path / "m.npz"), flat=True).groupBy("name").count().orderBy("name").collect() == [("a", 3), ("b", 2)]
    for path, more, told in (("m.npz", {}, "several kinds"), ("m.npz", {"array": "c"}, "no array c"), ("none.npy", {}, "no array files"), ("x.npy", {"axes": 4}, "less than 4 axes")):
        with pytest.raises(PySparkException, match=told):
            arrays.read(spark, str(tmp_path / path), **more)
    np.save(tmp_path / "o.npy", np.array([{}], object), allow_pickle=True)
    with pytest.raises(PySparkException, match="not read"):
        arrays.read(spark, str(tmp_path / "o.npy"))
    (tmp_path / "bad.npy").write_bytes(b"something else")
    with pytest.raises(PySparkException, match="no array file"):
        arrays.read(spark, str(tmp_path / "bad.npy"))
    with pytest.raises(PySparkException, match="is not"):
        arrays.read(spark, str(tmp_path / "[nx].npy")).collect()


def test_partitions_come_from_sizes_and_headers(spark, tmp_path):
    np.save(tmp_path / "long.npy", np.arange(100_000, dtype="f8"))
    for k in range(20):
        np.save(tmp_path / f"short{k:02}.npy", np.full(10, float(k)))
    df = arrays.read(spark, str(tmp_path / "*.npy"), split_bytes=100_000)
    assert df.rdd.getNumPartitions() == 9 and df.count() == 100_200  # eight ranges, and the short ones together
    assert df.where("at >= 10").agg(F.sum(F.col("value") - F.col("at"))).first()[0] == 0


def test_numpy_reads_what_is_written(spark, tmp_path):
    x = {f"t{k}": RNG.random((50 + k, 4)).astype("f4") for k in range(5)}
    data = [(f"{t}.npy", at, v.tolist()) for t, a in x.items() for at, v in enumerate(a)]
    RNG.shuffle(data)
    df = spark.createDataFrame([(f, int(a), [float(z) for z in v]) for f, a, v in data], "file string, at int, value array<float>").repartition(7)
    for _ in range(2):  # files are replaced whole
        arrays.save(df, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == [f"t{k}.npy" for k in range(5)]
    assert all(np.array_equal(np.load(tmp_path / "out" / f"{t}.npy"), a) for t, a in x.items())
    many = df.select("file", F.lit("n").alias("name"), "at", F.col("value")[0].alias("value")).unionByName(df.select("file", F.lit("m").alias("name"), "at", (F.col("value")[0] * 2).alias("value")))
    arrays.save(many.withColumn("file", F.replace("file", F.lit("npy"), F.lit("npz"))), str(tmp_path / "zip"), "npz")
    got = np.load(tmp_path / "zip" / "t3.npz")
    assert sorted(got.files) == ["m", "n"] and np.array_equal(got["n"], x["t3"][:, 0]) and np.array_equal(got["m"], x["t3"][:, 0] * 2)
    back = arrays.read(spark, str(tmp_path / "zip"), "n")
    assert back.count() == sum(map(len, x.values())) and rows(back.where("path like '%t3.npz'")) == x["t3"][:, 0].tolist()
    arrays.save(df.limit(0), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()
    for odd in (df.where("at <> 3"), df.unionByName(df.where("at = 3")), df.withColumn("value", F.slice("value", 1, F.col("at") % 2 + 1))):
        with pytest.raises(PySparkException, match="several shapes|without gaps"):
            arrays.save(odd, str(tmp_path / "odd"))
    assert not [p for p in (tmp_path / "odd").iterdir() if p.name.startswith(".")]


def test_side_files_of_results(spark, tmp_path):
    """Results, activations and embeddings beside each other, in another folder, and missing."""
    results = spark.createDataFrame([(f"in/{t}.wav", 120, [0.37], [0.37], [1], [(0.0, 2.0, "intro")]) for t in ("one", "two", "three")], schema.RESULT)
    frames = [(t, f, f / 9, f / 10, f / 11, [float(c) / (f + 1) for c in range(10)]) for t in ("in/one.wav", "in/two.wav") for f in range(6 if "one" in t else 9)]
    activations = spark.createDataFrame(frames, schema.ACTIVATIONS)
    scores = spark.createDataFrame([("in/two.wav", k, f, [[float(100 * k + 10 * f + s + c / 8) for c in range(3)] for s in range(4)]) for k in range(2) for f in range(5)], "track_id string, fold int, frame int, embedding array<array<double>>")
    sinks.save_result_files(results, str(tmp_path / "struct"))
    assert not (tmp_path / "arrays").exists()
    assert audio.activation_files(spark, str(tmp_path / "arrays")).isEmpty() and audio.embedding_files(spark, str(tmp_path / "arrays")).isEmpty()
    sinks.save_activation_files(activations, str(tmp_path / "arrays"))
    sinks.save_embedding_files(scores, str(tmp_path / "arrays"))
    assert sorted(p.name for p in (tmp_path / "arrays").iterdir()) == ["one.activ.npz", "two.activ.npz", "two.embed.npy"]
    files = np.load(tmp_path / "arrays" / "two.activ.npz")
    assert sorted(files.files) == ["beat", "downbeat", "label", "segment"] and files["beat"].shape == (9,) and files["label"].shape == (10, 9)
    embedding = np.load(tmp_path / "arrays" / "two.embed.npy")
    assert embedding.shape == (4, 5, 3, 2) and embedding[3, 2, 1, 1] == 100 + 20 + 3 + 1 / 8
    back = audio.activation_files(spark, str(tmp_path / "arrays")).withColumn("track_id", F.concat(F.lit("in/"), "track_id", F.lit(".wav")))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, activations.collect()))
    vectors = audio.embedding_files(spark, str(tmp_path / "arrays")).where("stem_idx = 3 and frame = 2 and fold = 1").collect()
    assert [(r["track_id"], r["vec"]) for r in vectors] == [("two", [123.0, 123.125, 123.25])]
    beside = audio.results_with_files(spark, str(tmp_path / "struct"), str(tmp_path / "arrays")).orderBy("track_id").collect()
    assert [(r["track_id"], r["has_activations"], r["has_embeddings"]) for r in beside] == [("one", True, False), ("three", False, False), ("two", True, True)]
    np.savez(tmp_path / "arrays" / "four.activ.npz", beat=np.zeros(4, "f4"))  # no more than that
    four = audio.activation_files(spark, str(tmp_path / "arrays")).where("track_id = 'four'").collect()
    assert len(four) == 4 and {(r["p_beat"], r["p_downbeat"], r["p_function"]) for r in map(lambda r: r.asDict(), four)} == {(0.0, None, None)}


def test_spectrograms_as_files(spark, tmp_path):
    x = RNG.random((4, 7, 81)).astype("f4")
    (tmp_path / "in").mkdir()
    np.save(tmp_path / "in" / "song.npy", x)
    spec = audio.spectrogram_files(spark, str(tmp_path / "in"))
    assert spec.count() == 28 and spec.where("stem = 'other' and frame = 5").first()["bands"] == x[2, 5].tolist()
    sinks.save_spectrogram_files(spec, str(tmp_path / "out"))
    assert np.array_equal(np.load(tmp_path / "out" / "song.npy"), x)


def test_a_long_array_passes_in_little_memory(spark, tmp_path):
    """400 MB: no process of this machine's but the one that writes it ever holds it."""
    with open(tmp_path / "long.npy", "wb") as f:
        f.write(arrays.write_header(np.dtype("f4"), (25_000_000, 4)))
        for _ in range(25):
            f.write(np.ones((1_000_000, 4), "f4").tobytes())
    reader = arrays.ArrayReader(str(tmp_path / "long.npy"), None, 1, False, 64 << 20, arrays.ArrayFiles({"path": str(tmp_path / "long.npy")}).schema())
    parts = reader.partitions()
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert len(parts) == 6 and sum(b.num_rows for b in reader.read(parts[3])) == parts[3].high - parts[3].low
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 150_000  # kB


def test_small_parts_of_a_long_file_are_put_together(spark, tmp_path):
    """Parts of a few rows, asked for over many rows, become larger, yet no larger than the default; several members in one pass."""
    np.save(tmp_path / "x.npy", np.arange(40_000.0).reshape(20_000, 2))
    df = arrays.read(spark, str(tmp_path / "x.npy"), split_bytes=64)
    assert df.rdd.getNumPartitions() <= arrays.MOST_PARTS + 1
    assert df.agg(F.count("*"), F.sum(F.col("value")[0] - 2 * F.col("at")), F.countDistinct("at")).first()[:] == (20_000, 0.0, 20_000)
    assert [arrays.part_bytes(t, s) for t, s in ((100, 64), (1 << 50, 64), (1 << 50, 1 << 30), (400 * 640, 64))] == [64, arrays.SPLIT_BYTES, 1 << 30, 640]
    np.savez(tmp_path / "m.npz", a=np.zeros(3), b=np.ones(2), text=np.array(["x"]))
    got = arrays.read(spark, str(tmp_path / "m.npz"), ("a", "b"), flat=True).groupBy("name").count().orderBy("name").collect()
    assert got == [("a", 3), ("b", 2)]


def test_vectors_are_read_back_by_some_hundred_tasks(spark, tmp_path):
    """array_files over 20,000 vectors, 1,250 ranges as asked for: tasks are bounded, every entry is right."""
    made = spark.range(20_000).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: (F.col("id") + k).cast("float")).alias("embedding"), (F.col("id") % 10).cast("int").alias("label"))
    made.write.parquet(str(tmp_path / "embeddings.parquet"))
    df = catalog.QUERIES["array_files"](spark, str(tmp_path))
    assert 100 < df.rdd.getNumPartitions() <= arrays.MOST_PARTS + 10
    off = F.sum(F.abs(F.col("v") - F.col("at") * 10 - F.col("label") - F.col("k")))
    assert df.agg(F.count("*"), F.countDistinct("label", "at", "k"), off).first()[:] == (1_280_000, 1_280_000, 0.0)


@pytest.mark.parametrize("name", ["array_files", "wave_files", "side_files"])
def test_names_are_taken_apart_below_the_entries(spark, name):
    """A file's name is the same for all entries of a row: its pattern runs once for each row."""
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Generate posexplode") :]  # what stands above it comes first
    assert "regexp" not in plan.removesuffix(below) and "regexp" in below


def test_a_whole_batch_is_not_kept_until_the_next():
    """Small batches are put together in order; one that is large enough goes on before another is made."""
    taken = []

    def batches(sizes):
        for n in sizes:
            taken.append(n)
            yield pa.RecordBatch.from_pydict({"v": pa.array(np.full(n, len(taken), np.int64))})

    assert next(arrays.gathered(batches([1000, 1000]), 4000)).num_rows == 1000 and taken == [1000]
    taken.clear()
    got = list(arrays.gathered(batches([100, 100, 1000, 100, 300, 200]), 4000))
    assert [b.num_rows for b in got] == [200, 1000, 400, 200]
    assert [v for b in got for v in b["v"].to_pylist()] == [k + 1 for k, n in enumerate(taken) for _ in range(n)]
