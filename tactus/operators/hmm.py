"""Beat tracking by a hidden Markov model over bar positions and tempi, and Viterbi decoding of small models.

A state is a place in a beat of a given length (in frames). Time moves every state one place on; at the end of a beat it
goes to the start of the next one, whose length may differ at a cost. So a path is a row of whole beats: its score
needs the frames at which beats begin alone, and sums of densities in between are differences of running sums. No beat is shorter
than the shortest length, so the beginnings of so many frames are decided at once. A track is decoded in one
task, tracks are the parallelism.

The decoder of small models has no such bound on a track: chunks of frames give their best scores from each state to each,
a track's chunks are chained, and the chunks are decoded for themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLOOR = float(np.finfo(np.float64).eps)
#: Scores that are held for tracks decoded together (a long track alone may need more).
ROOM = 1 << 21


def beat_lengths(fps: float = 100, min_bpm: float = 55, max_bpm: float = 215, tempi: int | None = 60) -> np.ndarray:
    """Distinct beat lengths in frames; about logarithmically spaced where there are more than `tempi`."""
    low, high = round(60 * fps / max_bpm), round(60 * fps / min_bpm)
    every = np.arange(low, high + 1)
    if tempi is None or len(every) <= tempi:
        return every
    points, found = tempi, np.zeros(0)
    while len(found) < tempi:
        found = np.unique(np.rint(np.geomspace(60 * fps / max_bpm, 60 * fps / min_bpm, points)).astype(int))
        points += 1
    return found


def length_changes(lengths: np.ndarray, stiffness: float | None = 100) -> np.ndarray:
    """Probability of each length (column) after each (row); below machine precision 0; without stiffness none changes."""
    if stiffness is None:
        return np.eye(len(lengths))
    p = np.exp(-stiffness * np.abs(lengths[None, :] / lengths[:, None] - 1))
    p[p <= np.spacing(1)] = 0
    return p / p.sum(1, keepdims=True)


@dataclass
class Bar:
    """One meter's states, laid out beat by beat, length by length, place by place."""

    beats: int
    lengths: np.ndarray
    stiffness: float | None = 100
    zone: int = 16

    def __post_init__(self):
        per_beat = int(self.lengths.sum())
        starts = np.cumsum(self.lengths) - self.lengths
        beat = np.repeat(np.arange(self.beats), per_beat)
        place = np.concatenate([np.arange(n) / n for n in self.lengths])
        self.position = beat + np.tile(place, self.beats)
        self.first = np.concatenate([b * per_beat + starts for b in range(self.beats)])
        self.last = self.first + np.tile(self.lengths, self.beats) - 1
        near = place < 1 / self.zone
        self.column = np.where(np.tile(near, self.beats), np.where(beat == 0, 2, 1), 0)
        self.near = np.add.reduceat(near, starts, dtype=np.int64)  # places of a beat that count as the beat itself
        with np.errstate(divide="ignore"):
            self.change = np.log(length_changes(self.lengths, self.stiffness))
        known = np.isfinite(self.change)
        width = int(known.sum(0).max())
        self.before = np.argsort(~known, axis=0, kind="stable")[:width].T  # for each length those that may precede it
        self.cost = np.take_along_axis(self.change.T, self.before, 1)

    def decode(self, density: np.ndarray) -> tuple[np.ndarray, float]:
        """The most likely states (frames,) and their log probability. density: (frames, 3) log densities."""
        return self.decode_all([density])[0]

    def decode_all(self, densities: list[np.ndarray]) -> list[tuple[np.ndarray, float]]:
        """decode for each; tracks of like length go together, as many as the room for their scores allows."""
        out: list = [None] * len(densities)
        cells = len(self.lengths) * self.beats
        held: list[int] = []

        def flush() -> None:
            for i, found in zip(held, self._decode([densities[i] for i in held]) if held else (), strict=True):
                out[i] = found
            held.clear()

        for i in sorted(range(len(densities)), key=lambda i: len(densities[i])):
            if (len(held) + 1) * (len(densities[i]) + int(self.lengths.max())) * cells > ROOM:
                flush()
            held.append(i)
        flush()
        return out

    def _decode(self, densities: list[np.ndarray]) -> list[tuple[np.ndarray, float]]:
        tracks, frames, k, most = len(densities), max(map(len, densities)), len(self.lengths), int(self.lengths.max())
        sums = np.zeros((tracks, frames + 1, 3))
        for own, density in zip(sums, densities, strict=True):
            np.cumsum(density, axis=0, out=own[1 : len(density) + 1])
        kinds = np.array([2] + [1] * (self.beats - 1))

        def passed(own: np.ndarray, start: np.ndarray, zone: np.ndarray, end: np.ndarray) -> np.ndarray:
            """Densities of a beat's frames from start to end (not with it), for each number of the beat in the bar."""
            turn = np.minimum(start + zone, end)
            at_start, at_turn, at_end = (own[..., np.clip(t, 0, frames), :] for t in (start, turn, end))
            return at_turn[..., kinds] - at_start[..., kinds] + (at_end[..., 0] - at_turn[..., 0])[..., None]

        # entered[track, t + most, length, beat]: the best score with which the beat begins at frame t; any state may be the first frame's
        entered = np.full((tracks, frames + most, k, self.beats), -np.inf)
        for i, n in enumerate(self.lengths):
            entered[:, most - n + 1 : most + 1, i] = -np.log(len(self.position))
        each = np.arange(k)

        def ended(own: np.ndarray, scores: np.ndarray, now: np.ndarray) -> np.ndarray:
            """(..., lengths, frames of now, beats): the best score of a beat of the length that ends before the frame."""
            start = now - self.lengths[:, None]
            return scores[..., start + most, each[:, None], :] + passed(own, start, self.near[:, None], np.broadcast_to(now, start.shape))

        width = int(self.lengths.min())
        room = np.empty((*self.before.T.shape, tracks * width * self.beats))
        for low in range(1, frames, width):
            now = np.arange(low, min(low + width, frames))
            before = np.roll(ended(sums, entered, now), 1, axis=3).swapaxes(0, 1).reshape(k, -1)
            into = room if len(now) == width else np.empty((*self.before.T.shape, before.shape[1]))
            np.take(before, self.before.T, axis=0, out=into, mode="clip")
            into += self.cost.T[:, :, None]
            entered[:, now + most] = into.max(0).reshape(k, tracks, len(now), self.beats).transpose(1, 2, 0, 3)
        place = np.concatenate([np.arange(n) for n in self.lengths])
        length = np.repeat(each, self.lengths)

        def trace(own: np.ndarray, scores: np.ndarray, frames: int) -> tuple[np.ndarray, float]:
            start = frames - 1 - place
            last = scores[start + most, length] + passed(own, start, self.near[length], np.full(len(start), frames))
            state = int(last.T.argmax())  # states run beat by beat
            score = float(last.T.ravel()[state])
            beat, at = divmod(state, len(place))
            n, begin = int(length[at]), int(start[at])
            path = np.empty(frames, np.int64)
            end = frames
            while True:
                first = int(self.first[beat * k + n])
                inside = max(begin, 0)
                path[inside:end] = first + np.arange(inside - begin, end - begin)
                if begin <= 0:
                    return path, score
                beat = (beat - 1) % self.beats
                before = ended(own, scores, np.array([begin]))[self.before[n], 0, beat] + self.cost[n]
                end, n = begin, int(self.before[n, before.argmax()])
                begin = end - int(self.lengths[n])

        return [trace(own, scores, len(d)) for own, scores, d in zip(sums, entered, densities, strict=True)]


@lru_cache(8)
def bars(meters: tuple[int, ...], fps: float, min_bpm: float, max_bpm: float, tempi: int | None) -> list[Bar]:
    """This worker's models."""
    return [Bar(m, beat_lengths(fps, min_bpm, max_bpm, tempi)) for m in meters]


def log_densities(pairs: np.ndarray, observation: int = 16) -> np.ndarray:
    """(frames, 3): neither, beat, downbeat."""
    none = (1 - pairs.sum(1)) / (observation - 1)
    return np.log(np.maximum(np.column_stack([none, pairs]), FLOOR))


def track_beats(pairs: np.ndarray, bars: list[Bar], fps: float = 100, threshold: float | None = 0.05, correct: bool = True) -> np.ndarray:
    """(beats, 2): time in seconds and number in the bar. pairs: (frames, 2) beat and downbeat activations."""
    return all_beats([pairs], bars, fps, threshold, correct)[0]


def all_beats(tracks: list[np.ndarray], bars: list[Bar], fps: float = 100, threshold: float | None = 0.05, correct: bool = True) -> list[np.ndarray]:
    """track_beats for each."""
    out = [np.empty((0, 2))] * len(tracks)
    begun: dict[int, tuple[int, np.ndarray]] = {}
    for i, pairs in enumerate(tracks):
        hits = np.flatnonzero((pairs >= threshold).any(1)) if threshold else np.arange(len(pairs))
        if len(hits) and (kept := pairs[hits[0] : hits[-1] + 1]).any():
            begun[i] = (int(hits[0]), kept)
    decoded = [bar.decode_all([log_densities(pairs) for _, pairs in begun.values()]) for bar in bars]
    for k, (i, (first, pairs)) in enumerate(begun.items()):
        best = max(range(len(bars)), key=lambda m: decoded[m][k][1])  # noqa: B023  the first meter on ties
        path = decoded[best][k][0]
        number = bars[best].position[path].astype(int) + 1
        if correct:
            near = np.concatenate([[False], bars[best].column[path] >= 1, [False]])
            edges = np.flatnonzero(near[1:] != near[:-1]).reshape(-1, 2)
            frames = np.array([a + pairs[a:b].max(1).argmax() for a, b in edges], int)
        else:
            frames = np.flatnonzero(np.diff(number)) + 1
        if len(frames):
            out[i] = np.column_stack([(frames + first) / fps, number[frames]])
    return out


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt by the keys in as many parts as shuffles have: decoding is dear for its few bytes, so parts are not to be merged."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def metrical_triple(beat: Column, downbeat: Column) -> dict[str, Column]:
    """Normalised shares of beat without downbeat, downbeat and neither."""
    x = F.greatest(beat - downbeat, F.lit(1e-8))
    n = 1 - (beat + downbeat) / 2
    total = x + downbeat + n
    return {"p_only_beat": x / total, "p_downbeat": downbeat / total, "p_none": n / total}


def beats(
    activations: DataFrame, track: str, frame: str, beat: str, downbeat: str, meters: tuple[int, ...] = (3, 4), fps: float = 100,
    threshold: float = 0.24, min_bpm: float = 55, max_bpm: float = 215, tempi: int = 60,
) -> DataFrame:
    """(track, time, position): beats of each track; a downbeat is a beat in position 1."""
    if fps <= 0 or not meters or any(m < 1 for m in meters) or not 0 < min_bpm < max_bpm:
        raise ValueError("beats need a frame rate, meters of one beat at least and a tempo range")
    kind = activations.select(track).schema[0].dataType.simpleString()
    rows = activations.select(track, frame, *(c.alias(k) for k, c in metrical_triple(F.col(beat), F.col(downbeat)).items()))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models = bars(meters, fps, min_bpm, max_bpm, tempi)
        for whole in _groups(batches, [track]):
            pairs = whole[["p_only_beat", "p_downbeat"]].to_numpy()
            opens = np.flatnonzero((whole[track] != whole[track].shift()).to_numpy())
            ends = [*opens[1:], len(whole)]
            found = all_beats([pairs[a:b] for a, b in zip(opens, ends, strict=True)], models, fps, threshold)
            out = np.concatenate(found)
            names = whole[track].iloc[np.repeat(opens, [len(f) for f in found])]
            yield pd.DataFrame({track: names.to_numpy(), "time": out[:, 0], "position": out[:, 1].astype("int32")})

    # Tracks one after another in a part: a group for each would cost more than its decoding.
    ordered = spread(rows, track).sortWithinPartitions(track, frame).drop(frame)
    return ordered.mapInPandas(decode, f"{track} {kind}, time double, position int")


#: Frames of a track that are decoded together.
CHUNK = 4096


def _together(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """For each place but the first: how many groups (by falling length) reach it."""
    for t in range(1, int(lengths.max(initial=0))):
        yield t, int(np.searchsorted(-lengths, -t))


def _groups(batches: Iterator[pd.DataFrame], keys: list[str], most_rows: int = 1 << 18) -> Iterator[pd.DataFrame]:
    """Runs of whole groups of sorted rows, about most_rows rows at a time."""
    held: list[pd.DataFrame] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows < most_rows:
            continue
        whole = pd.concat(held, ignore_index=True)
        last = (whole[keys] == whole[keys].iloc[-1]).all(axis=1)
        if not last.all():
            yield whole[~last].reset_index(drop=True)
        held = [whole[last]]
        rows = int(last.sum())
    if held and (whole := pd.concat(held, ignore_index=True)).size:
        yield whole


def viterbi(df: DataFrame, track: str, frame: str, scores: list[str], step: np.ndarray, chunk: int = CHUNK) -> DataFrame:
    """(track, frame, state, score): a best path for per-frame state scores and additive step[from][to]; first on ties.

    frame: whole numbers, each once in a track. No task holds a track, only chunks of `chunk` frames and a table of states for each
    chunk. Where several paths are best, the first state counts at every frame, and first of all at the chunks' borders.
    """
    n = len(scores)
    kind = df.select(track).schema[0].dataType.simpleString()
    rows = df.select(F.col(track).alias("track"), F.col(frame).cast("bigint").alias("frame"), F.array(*(F.col(c).cast("double") for c in scores)).alias("s"))
    rows = rows.withColumn("chunk", F.floor(F.col("frame") / chunk))
    keys = ["track", "chunk"]
    begin = np.vstack([step, np.zeros(n)])  # the row behind the states: nothing before

    def dealt(x: DataFrame) -> DataFrame:
        return spread(x, *keys).sortWithinPartitions(*keys, "frame")

    def split(whole: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First row and number of rows of each group, by falling length; and all scores."""
        opens = np.flatnonzero((whole[keys] != whole[keys].shift()).any(axis=1).to_numpy())
        lengths = np.diff([*opens, len(whole)])
        order = np.argsort(-lengths, kind="stable")
        return opens[order], lengths[order], np.stack(whole["s"].to_numpy())

    def transfer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """For each chunk the best score from each state before it (or from nothing) to each of its last states."""
        for whole in _groups(batches, keys):
            first, lengths, s = split(whole)
            best = begin + s[first][:, None]
            for t, live in _together(lengths):
                best[:live] = (best[:live, :, :, None] + step).max(2) + s[first[:live] + t][:, None]
            yield whole.loc[first, keys].assign(best=list(best.reshape(len(first), -1)))

    def chain(group: pd.DataFrame) -> pd.DataFrame:
        parts = group.sort_values("chunk")
        best = [np.reshape(b, (n + 1, n)) for b in parts["best"]]
        before = [np.r_[np.full(n, -np.inf), 0.0]]
        for b in best:
            before.append(np.r_[(before[-1][:, None] + b).max(0), -np.inf])
        states = [int(before[-1].argmax())]
        for e, b in zip(before[-2::-1], best[::-1], strict=True):
            states.append(int((e + b[:, states[-1]]).argmax()))
        return pd.DataFrame({"track": parts["track"], "chunk": parts["chunk"], "entry": states[:0:-1], "exit": states[-2::-1], "score": float(before[-1].max())})

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in _groups(batches, keys):
            first, lengths, s = split(whole)
            now = begin[whole.loc[first, "entry"]] + s[first]
            back = np.zeros(s.shape, np.int64)
            for t, live in _together(lengths):
                into = now[:live, :, None] + step
                back[first[:live] + t] = into.argmax(1)
                now[:live] = into.max(1) + s[first[:live] + t]
            state = whole.loc[first, "exit"].to_numpy(np.int64)
            path = np.empty(len(whole), np.int64)
            for t, live in [*_together(lengths)][::-1]:
                at = first[:live] + t
                path[at] = state[:live]
                state[:live] = back[at, state[:live]]
            path[first] = state
            yield whole[["track", "frame", "score"]].assign(state=path)

    tables = dealt(rows).mapInPandas(transfer, f"track {kind}, chunk bigint, best array<double>")
    chained = spread(tables, "track").groupBy("track").applyInPandas(chain, f"track {kind}, chunk bigint, entry int, exit int, score double")
    same = F.col("r.track").eqNullSafe(F.col("c.track")) & (F.col("r.chunk") == F.col("c.chunk"))
    joined = rows.alias("r").join(chained.alias("c"), same).select("r.*", "c.entry", "c.exit", "c.score")
    found = dealt(joined).mapInPandas(decode, f"track {kind}, frame bigint, score double, state bigint")
    return found.select(F.col("track").alias(track), F.col("frame").alias(frame), "state", "score")
