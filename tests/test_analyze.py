import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tactus import __main__ as cli
from tactus import schema
from tactus.functions.columns import softmax
from tactus.operators import analyze, score, stems
from tactus.sources import audio, sinks, weights
from tests.test_operators import tone


def activations(spark, frames=512):
    rows = []
    for f in range(frames):
        on = f % 50 == 25
        kind = 8 if f < frames // 2 else 9
        p = [0.01] * 10
        p[kind] = 0.91
        rows.append(("a.wav", f, 0.95 if on else 0.02, 0.9 if on and f % 200 == 25 else 0.01, 0.9 if f in (0, 200, 400) else 0.03, p))
    return spark.createDataFrame(rows, schema.ACTIVATIONS)


def test_results_of_periodic_activations(spark):
    row = analyze.analyze_activations(activations(spark)).first()
    assert row["bpm"] == 120 and len(row["beats"]) >= 9 and row["downbeats"] and set(row["beat_positions"]) <= {1, 2, 3, 4}
    spans = [(s["start"], s["end"], s["label"]) for s in row["segments"]]
    assert spans == [(0.0, 2.0, "verse"), (2.0, 4.0, "chorus"), (4.0, 5.12, "chorus")]


def test_no_boundary_is_one_segment(spark):
    flat = activations(spark, 100).withColumn("p_section", F.lit(0.0).cast("float")).withColumn("p_beat", F.lit(0.0).cast("float")).withColumn("p_downbeat", F.lit(0.0).cast("float"))
    row = analyze.analyze_activations(flat).first()
    assert row["bpm"] is None and row["beats"] == [] and [(s["start"], s["end"]) for s in row["segments"]] == [(0.0, 1.0)]


def test_neighbours_stay_inside_their_class():
    places = score.neighbours(23, 3, 4)
    assert (places % 4 == (np.arange(23) % 4)[:, None]).all() and places.max() < 23
    assert all(len(set(row)) == 3 for row in places) and all(i in row for i, row in enumerate(places))


def test_softmax_sums_to_one(spark):
    out = spark.createDataFrame([([1000.0, 1001.0, 999.0],)], "v array<double>").select(softmax(F.col("v")).alias("p")).first()["p"]
    assert sum(out) == pytest.approx(1) and out[1] == pytest.approx(np.exp(0) / (1 + np.exp(-1) + np.exp(-2)))


def test_command_line_end_to_end(spark, tmp_path):
    for track in ("one", "two"):
        (tmp_path / "in" / track).mkdir(parents=True)
        for stem, hz in zip(schema.STEMS, (110, 220, 330, 440), strict=True):
            (tmp_path / "in" / track / f"{stem}.wav").write_bytes(tone(hz))
    args = [str(tmp_path / "in"), str(tmp_path / "out"), "--seeds", "1", "2", "--depth", "2"]
    for more in ([], [], ["--overwrite", "json"]):  # the second run finds nothing to do, the third replaces
        cli.main(args + more)
        rows = audio.results(spark, str(tmp_path / "out")).collect()
        assert sorted(r["path"] for r in rows) == ["one", "two"]
        assert all(r["segments"][0]["start"] == 0 and r["segments"][-1]["end"] == 0.5 for r in rows)


def plain_attention(net, x, name, tall, wide, dilation):
    """One place after another."""
    w, heads = net.w, net.shape.heads
    h, t, c = x.shape
    d = c // heads
    part = lambda p: np.stack([w[f"{name}.self.{p}.weight"] @ v + w[f"{name}.self.{p}.bias"] for v in x.reshape(-1, c)]).reshape(h, t, heads, d)
    q, k, v = part("query"), part("key"), part("value")
    rpb = w[f"{name}.self.rpb"].reshape(heads, -1, 2 * wide - 1)
    out = np.zeros((h, t, c))

    def near(i, n, kernel, step):
        own = list(range(i % step, n, step))
        low = min(max(own.index(i) - kernel // 2, 0), len(own) - kernel)
        return own[low : low + kernel]

    for i in range(h):
        for j in range(t):
            for n in range(heads):
                places = [(a, b) for a in near(i, h, tall, 1) for b in near(j, t, wide, dilation)]
                s = np.array([q[i, j, n] @ k[a, b, n] / d**0.5 + rpb[n, a - i + tall - 1, (b - j) // dilation + wide - 1] for a, b in places])
                e = np.exp(s - s.max())
                out[i, j, n * d : n * d + d] = sum(x * v[a, b, n] for x, (a, b) in zip(e / e.sum(), places, strict=True))
    return np.stack([w[f"{name}.output.dense.weight"] @ v + w[f"{name}.output.dense.bias"] for v in out.reshape(-1, c)]).reshape(h, t, c)


def test_attention_equals_a_plain_one():
    shape = score.Shape(channels=8, depth=1, heads=2)
    net = score.Network(score.seeded(3, shape), shape)
    rng = np.random.default_rng(0)
    for name, h, t, tall, dilation in (("timelayer", 2, 23, 1, 2), ("timelayer", 1, 10, 1, 1), ("instlayer", 5, 9, 5, 1)):
        x = rng.normal(size=(h, t, 8))
        for a in ("attention", "attention2")[: 2 - (tall > 1)]:
            key = f"encoder.layers.0.{name}.{a}"
            assert np.allclose(net.attend(x, key, tall, 5, dilation), plain_attention(net, x, key, tall, 5, dilation), atol=1e-5)


def test_convolutions_pools_and_activations():
    rng = np.random.default_rng(1)
    x, w, b = rng.normal(size=(6, 7, 2)), rng.normal(size=(3, 3, 4, 2)), rng.normal(size=3)
    padded = np.pad(x, ((1, 1), (0, 0), (0, 0)))
    want = [[[(padded[t : t + 3, f : f + 4] * w[o]).sum() + b[o] for o in range(3)] for f in range(4)] for t in range(6)]
    assert np.allclose(score.conv(x, w, b, 1), want)
    assert score.pool(x).shape == (6, 2, 2) and np.allclose(score.pool(x)[2, 1], x[2, 3:6].max(0))
    z = rng.normal(size=(4, 5)) * 3
    assert np.allclose(score.erf(z), np.vectorize(math.erf)(z), atol=2e-7)
    assert np.allclose(np.exp(score.activation("log_softmax")(z)).sum(-1), 1) and (score.activation("elu")(z) > -1).all()
    assert np.allclose(score.activation("selu")(np.array([1.0])), 1.0507009873554805) and score.activation("prelu")(np.array([-4.0]))[0] == -1
    with pytest.raises(ValueError, match="unknown activation"):
        score.activation("swish")


def test_networks_from_weight_files(tmp_path):
    shape = score.Shape(depth=2)
    made = score.seeded(5, shape)
    np.savez(tmp_path / "fold.npz", **made)
    blobs = {k: v.astype("<f4").tobytes() for k, v in made.items()}
    at, head = 0, {"__metadata__": {"x": "y"}}
    for k, v in made.items():
        head[k] = {"dtype": "F32", "shape": list(v.shape), "data_offsets": [at, at + len(blobs[k])]}
        at += len(blobs[k])
    text = json.dumps(head).encode()
    assert weights.resolve_weights("fold", folder=str(tmp_path)).endswith(".npz")
    (tmp_path / "fold.safetensors").write_bytes(len(text).to_bytes(8, "little") + text + b"".join(blobs.values()))
    first = weights.resolve_weights("fold", folder=str(tmp_path))
    assert first.endswith(".safetensors") and weights.resolve_weights("x", str(tmp_path / "fold.npz")).endswith(".npz")
    (tmp_path / "fold.json").write_text('{"a": 1}')
    (tmp_path / "fold.yaml").write_text("# c\nfold: 0\nname: 'x'\nbest_threshold_downbeat: 0.24\nnested:\n  a: 1\n")
    assert weights.read_config(weights.resolve_config(first)) == {"fold": 0, "name": "x", "best_threshold_downbeat": 0.24}
    spec = np.random.default_rng(0).random((4, 33, 81)).astype(np.float32)
    a, b = (score.Network(weights.read_weights(str(tmp_path / f"fold{k}")), shape)(spec) for k in (".npz", ".safetensors"))
    assert all(np.array_equal(a[0][k], b[0][k]) for k in a[0]) and a[0]["function"].shape == (33, 10) and a[1].shape == (4, 33, 24)
    other = spec.copy()
    other[:, 20:] = 0
    assert not np.allclose(score.Network(made, shape)(other)[0]["beat"], a[0]["beat"])
    with pytest.raises(ValueError, match="lack"):
        score.Network({k: v for k, v in made.items() if k != "norm.bias"}, shape)
    with pytest.raises(FileNotFoundError):
        weights.resolve_weights("none", folder=str(tmp_path))
    assert weights.members("m-all") == [f"m-fold{k}" for k in range(8)] and weights.members("m-fold3") == ["m-fold3"]
    for k in range(2):
        (tmp_path / f"m-fold{k}.npz").write_bytes((tmp_path / "fold.npz").read_bytes())
    folder = f"file://{tmp_path}"
    assert weights.resolve_ensemble("m-all", folder, 2) == [f"{folder}/m-fold{k}.npz" for k in range(2)]
    assert set(weights.read_weights(f"{folder}/m-fold1.npz")) == set(made) and weights.read_config(weights.resolve_config(f"{folder}/fold.npz"))["fold"] == 0
    with pytest.raises(FileNotFoundError, match="m-fold2"):
        weights.resolve_ensemble("m-all", folder)


def test_any_callable_scores_and_embeddings_are_kept(spark, tmp_path):
    rows = [(t, s, f, [float(f)] * 3) for t in ("a/x", "b") for s in schema.STEMS for f in range(5)]
    spec = spark.createDataFrame(rows, "track_id string, stem string, frame int, bands array<float>")
    sinks.save_spectrogram(spec, str(tmp_path / "spec"))
    sinks.save_spectrogram(spec.where("track_id = 'b'"), str(tmp_path / "spec"))
    again = audio.spectrograms(spark, str(tmp_path / "spec"))
    assert again.count() == len(rows) and stems.todo(spec, again, "track_id").isEmpty()
    fold = lambda k: lambda x: ({h: np.full((x.shape[1], n), k + x[0, :, :1].mean(1, keepdims=True) * 0) for h, n in score.HEADS_OUT.items()}, x)
    scored = score.scores(again, [fold(1.0), fold(3.0)], schema.STEMS, embeddings=True)
    mean = score.ensemble(scored).collect()
    assert len(mean) == 10 and all(r["p_beat"] == pytest.approx(1 / (1 + np.exp(-2))) for r in mean)
    sinks.save_embeddings(scored, str(tmp_path / "embed"))
    assert spark.read.parquet(str(tmp_path / "embed")).count() == 2 * 2 * 5 * 4
    configs = spark.createDataFrame([(0, 0.2, 0.22), (1, 0.3, 0.26)], "fold int, best_threshold_beat double, best_threshold_downbeat double")
    assert tuple(score.ensemble_thresholds(configs).first()) == (0.25, 0.24)


def test_clicks_leave_out_beats_at_downbeats(spark):
    df = spark.createDataFrame([("p", 120, [0.37, 1.23], [0.38], [1, 2], [(0.0, 2.0, "intro")])], schema.RESULT)
    assert sorted((r["kind"], r["time"]) for r in analyze.clicks(df).collect()) == [("beat", 1.23), ("boundary", 0.0), ("downbeat", 0.38)]
