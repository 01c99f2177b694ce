"""Frame scores from a network of dilated neighbourhood attention, and the ensemble of its folds.

A fold is its named weights (see sources.weights), or random ones from a seed; any callable of a spectrogram to logits can take
a fold's place. A track's spectrogram is scored by all folds where it is, so its frames are shuffled once; the folds' logits
are rows that an aggregate averages.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tactus.functions.columns import sigmoid, softmax

HEADS_OUT = {"beat": 1, "downbeat": 1, "section": 1, "function": 10}
Weights = dict[str, np.ndarray]
#: spectrogram (stems, frames, bands) -> (logits by head (frames, n), embeddings (stems, frames, channels))
Scorer = Callable[[np.ndarray], tuple[dict[str, np.ndarray], np.ndarray]]


@dataclass(frozen=True)
class Shape:
    bands: int = 81
    channels: int = 24
    heads: int = 2
    depth: int = 11
    kernel: int = 5
    across: int = 5
    widening: int = 4
    most_dilation: int = 3200
    stems: int = 4


def erf(x: np.ndarray) -> np.ndarray:
    """Within 1.5e-7, by a rational approximation (fixed values)."""
    t = 1 / (1 + 0.3275911 * np.abs(x))
    near = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return np.sign(x) * (1 - near * np.exp(-x * x))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


#: Activations by name. selu's constants and the slope of leaky_relu are fixed values.
ACTIVATIONS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "relu": lambda x: np.maximum(x, 0),
    "sigmoid": lambda x: 1 / (1 + np.exp(-x)),
    "tanh": np.tanh,
    "leaky_relu": lambda x: np.where(x > 0, x, 0.01 * x),
    "softmax": _softmax,
    "log_softmax": lambda x: np.log(_softmax(x)),
    "elu": lambda x: np.where(x > 0, x, np.expm1(np.minimum(x, 0))),
    "selu": lambda x: 1.0507009873554805 * np.where(x > 0, x, 1.6732632423543772 * np.expm1(np.minimum(x, 0))),
    "gelu": lambda x: 0.5 * x * (1 + erf(x / np.sqrt(2))),
    "prelu": lambda x: np.where(x > 0, x, 0.25 * x),
}


def activation(name: str) -> Callable[[np.ndarray], np.ndarray]:
    if name not in ACTIVATIONS:
        raise ValueError(f"unknown activation {name}; known: {', '.join(sorted(ACTIVATIONS))}")
    return ACTIVATIONS[name]


def conv(x: np.ndarray, weight: np.ndarray, bias: np.ndarray, pad_time: int) -> np.ndarray:
    """x: (frames, bands, channels); weight: (out, frames, bands, channels)."""
    x = np.pad(x, ((pad_time, pad_time), (0, 0), (0, 0)))
    views = np.lib.stride_tricks.sliding_window_view(x, weight.shape[1:3], (0, 1))
    return np.tensordot(views, weight, ([2, 3, 4], [3, 1, 2])) + bias


def pool(x: np.ndarray, width: int = 3) -> np.ndarray:
    """Maxima of whole groups of bands."""
    n = x.shape[1] // width
    return x[:, : n * width].reshape(len(x), n, width, -1).max(2)


def neighbours(n: int, kernel: int, dilation: int) -> np.ndarray:
    """(n, kernel): for each place the kernel places of its own residue class nearest to it, shifted inwards at the ends."""
    at = np.arange(n)
    residue, rank = at % dilation, at // dilation
    members = (n - 1 - residue) // dilation + 1
    first = np.clip(rank - kernel // 2, 0, np.maximum(members - kernel, 0))
    ranks = np.minimum(first[:, None] + np.arange(kernel), members[:, None] - 1)
    return ranks * dilation + residue[:, None]


class Network:
    """One fold: convolutions to one vector a frame, blocks of attention along time and across stems, linear heads."""

    def __init__(self, weights: Weights, shape: Shape = Shape()):
        self.w, self.shape = weights, shape
        if lacking := sorted(set(weight_shapes(shape)) - set(weights)):
            raise ValueError(f"weights lack {', '.join(lacking)}")
        for name, size in weight_shapes(shape).items():
            if weights[name].shape != size:
                raise ValueError(f"{name} is {weights[name].shape}, not {size}")

    def linear(self, x: np.ndarray, name: str) -> np.ndarray:
        return x @ self.w[f"{name}.weight"].T + self.w[f"{name}.bias"]

    def norm(self, x: np.ndarray, name: str) -> np.ndarray:
        centred = x - x.mean(-1, keepdims=True)
        return centred / np.sqrt((centred**2).mean(-1, keepdims=True) + 1e-5) * self.w[f"{name}.weight"] + self.w[f"{name}.bias"]

    def embed(self, spec: np.ndarray) -> np.ndarray:
        """(frames, bands) -> (frames, channels)."""
        x = spec[..., None]
        for k, pad in enumerate((1, 0, 1)):
            x = ACTIVATIONS["elu"](pool(conv(x, self.w[f"embeddings.conv{k}.weight"], self.w[f"embeddings.conv{k}.bias"], pad)))
        return self.norm(x[:, 0], "embeddings.norm")

    def attend(self, x: np.ndarray, name: str, tall: int, wide: int, dilation: int) -> np.ndarray:
        """Attention over tall x wide neighbours with a bias by their relative places. x: (stems, frames, channels)."""
        h, t, c = x.shape
        heads = self.shape.heads
        q, k, v = (self.linear(x, f"{name}.self.{p}").reshape(h, t, heads, -1) for p in ("query", "key", "value"))
        rows, columns = neighbours(h, tall, 1), neighbours(t, wide, dilation)
        bias = self.w[f"{name}.self.rpb"].reshape(heads, -1, 2 * wide - 1)
        down, along = rows - np.arange(h)[:, None] + tall - 1, (columns - np.arange(t)[:, None]) // dilation + wide - 1
        places = [(a, b) for a in range(tall) for b in range(wide)]
        scores = np.empty((h, t, heads, len(places)), x.dtype)
        for i, (a, b) in enumerate(places):
            near = k[rows[:, a]][:, columns[:, b]]
            scores[..., i] = (q * near).sum(-1) * (c // heads) ** -0.5 + bias[:, down[:, a][:, None], along[:, b]].transpose(1, 2, 0)
        shares = _softmax(scores)
        out = sum(shares[..., i, None] * v[rows[:, a]][:, columns[:, b]] for i, (a, b) in enumerate(places))
        return self.linear(out.reshape(h, t, c), f"{name}.output.dense")

    def layer(self, x: np.ndarray, name: str, tall: int, dilations: tuple[int, ...]) -> np.ndarray:
        """Attentions side by side, each added to x; then an MLP over all of them, added to their mean."""
        h, t, _ = x.shape
        y = self.norm(x, f"{name}.layernorm_before")
        y = np.pad(y, ((0, max(0, tall - h)), (0, max(0, self.shape.kernel * dilations[-1] - t)), (0, 0)))
        names = ("attention", "attention2")
        states = [x + self.attend(y, f"{name}.{n}", tall, self.shape.kernel if tall == 1 else self.shape.across, d)[:h, :t] for n, d in zip(names, dilations, strict=False)]
        z = self.norm(np.concatenate(states, -1), f"{name}.layernorm_after")
        z = self.linear(ACTIVATIONS["gelu"](self.linear(z, f"{name}.intermediate.dense")), f"{name}.output.dense")
        return sum(states) / len(states) + z

    def __call__(self, spec: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        x = np.stack([self.embed(s) for s in spec])
        for k in range(self.shape.depth):
            dilation = min(2**k, self.shape.most_dilation)
            x = self.layer(x, f"encoder.layers.{k}.timelayer", 1, (dilation, 2 * dilation))
            x = self.layer(x, f"encoder.layers.{k}.instlayer", self.shape.across, (1,))
        x = self.norm(x, "norm")
        joined = x.transpose(1, 0, 2).reshape(x.shape[1], -1)
        return {k: self.linear(joined, f"{k}_classifier.classifier") for k in HEADS_OUT}, x


def weight_shapes(shape: Shape = Shape()) -> dict[str, tuple[int, ...]]:
    """Names and sizes of a fold's weights, as weight files have them."""
    c = shape.channels
    convs = {0: (c // 2, 3, 3, 1), 1: (c, 1, 12, c // 2), 2: (c, 3, 3, c)}
    out: dict[str, tuple[int, ...]] = {}

    def both(name: str, size: tuple[int, ...]) -> None:
        out.update({f"{name}.weight": size, f"{name}.bias": size[:1]})

    for k, size in convs.items():
        both(f"embeddings.conv{k}", size)
    both("embeddings.norm", (c,))
    for k in range(shape.depth):
        for layer, attentions in (("timelayer", ("attention", "attention2")), ("instlayer", ("attention",))):
            name = f"encoder.layers.{k}.{layer}"
            wide = c * len(attentions)
            for a in attentions:
                for part in ("self.query", "self.key", "self.value", "output.dense"):
                    both(f"{name}.{a}.{part}", (c, c))
                span = 2 * (shape.kernel if layer == "timelayer" else shape.across) - 1
                out[f"{name}.{a}.self.rpb"] = (shape.heads, span) if layer == "timelayer" else (shape.heads, span, span)
            both(f"{name}.layernorm_before", (c,))
            both(f"{name}.layernorm_after", (wide,))
            both(f"{name}.intermediate.dense", (wide * shape.widening, wide))
            both(f"{name}.output.dense", (c, wide * shape.widening))
    both("norm", (c,))
    for head, n in HEADS_OUT.items():
        both(f"{head}_classifier.classifier", (n, shape.stems * c))
    return out


def seeded(seed: int, shape: Shape = Shape()) -> Weights:
    """Random weights, for tests and timing."""
    rng = np.random.default_rng(seed)
    made = {k: rng.normal(0, 1 / np.sqrt(np.prod(size[1:]) or 1), size).astype(np.float32) for k, size in weight_shapes(shape).items()}
    return {k: np.ones_like(v) if "norm" in k and k.endswith("weight") else v for k, v in made.items()}


def scores(spectrogram: DataFrame, scorers: list[Scorer], stems: tuple[str, ...], embeddings: bool = False) -> DataFrame:
    """spectrogram (track_id, stem, frame, bands) -> logits of each fold and frame; with embeddings also those (array by stem)."""
    schema = "track_id string, fold int, frame int, beat double, downbeat double, section double, function array<double>"
    def run(group: pd.DataFrame) -> pd.DataFrame:
        by_stem = {s: np.stack(g.sort_values("frame")["bands"]) for s, g in group.groupby("stem")}
        frames = min(len(v) for v in by_stem.values())
        spec = np.stack([by_stem[s][:frames] for s in stems]).astype(np.float32)
        parts = []
        for fold, scorer in enumerate(scorers):
            logits, inner = scorer(spec)
            out = pd.DataFrame({"track_id": group["track_id"].iloc[0], "fold": fold, "frame": np.arange(frames)})
            for k, v in logits.items():
                out[k] = list(v) if k == "function" else v[:, 0]
            if embeddings:
                out["embedding"] = list(inner.transpose(1, 0, 2).tolist())
            parts.append(out)
        return pd.concat(parts)

    return spectrogram.groupBy("track_id").applyInPandas(run, schema + ", embedding array<array<float>>" * embeddings)


def ensemble(logits: DataFrame) -> DataFrame:
    """Mean logits over folds, then probabilities: the activations table."""
    heads = ("beat", "downbeat", "section")
    function = F.array(*(F.avg(F.col("function")[k]) for k in range(HEADS_OUT["function"]))).alias("function")
    mean = logits.groupBy("track_id", "frame").agg(*(F.avg(c).alias(c) for c in heads), function)
    return mean.select("track_id", "frame", *(sigmoid(F.col(c)).alias(f"p_{c}") for c in heads), softmax(F.col("function")).alias("p_function"))


def ensemble_thresholds(configs: DataFrame) -> DataFrame:
    """configs (fold, best_threshold_beat, best_threshold_downbeat): the ensemble's, their means."""
    return configs.agg(*(F.avg(c).alias(c) for c in ("best_threshold_beat", "best_threshold_downbeat")))
