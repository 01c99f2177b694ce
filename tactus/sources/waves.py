"""WAV files as a data source: a row for each chunk of samples, read by byte range.

Partitions come from file sizes and headers: files up to `splitBytes` go several to a partition unopened, longer ones are cut at
multiples of `chunk` samples; both as in `arrays.part_bytes` where so small parts would be too many. A task reads its own range and, with option `edge`, so many samples on either side of it, so that frames
can be made without moving a sample (see signal.chunk_frames).

    waves.read(spark, "folder/*.wav")   # path, sample_rate, channels, total, chunk, at, samples

at: the chunk's first sample; total: the file's samples; samples: the mean of the channels in -1..1, or with mono off an array for each
channel; left and right (with edge): what lies beside the chunk, shorter at the ends of the file. Integers of 8 to 32 bits and
floats of 32 and 64 are read, also from files over 4 GB (RF64) and from those whose writer didn't know the length.
Other encodings raise. A file without samples gives no row.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tactus.sources.arrays import MOST_FILES, gathered, listed, nested, part_bytes
from tactus.sources.store import store_of

FORMAT = "waves"
SPLIT_BYTES = 64 << 20
#: Samples of a chunk.
CHUNK = 1 << 16
#: Bytes of samples that are decoded at once.
STEP_BYTES = 4 << 20

# Fixed values of the format: encodings, and sizes that mean that the length stands elsewhere or wasn't known.
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE
UNKNOWN = (0, 0xFFFFFFFF)


@dataclass(frozen=True)
class Wave:
    """Where a file's samples lie and what they are. width: bytes of one channel's sample."""

    rate: int
    channels: int
    width: int
    floats: bool
    start: int
    total: int

    @property
    def step(self) -> int:
        return self.width * self.channels

    def decoded(self, data: bytes) -> np.ndarray:
        """(samples, channels) in -1..1."""
        if self.floats:
            flat = np.frombuffer(data, f"<f{self.width}").astype(np.float32)
        elif self.width == 1:
            flat = (np.frombuffer(data, np.uint8).astype(np.float32) - 128) / 128
        elif self.width == 3:
            b = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
            flat = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) / 2.0**31).astype(np.float32)
        else:
            flat = (np.frombuffer(data, f"<i{self.width}") / 2.0 ** (8 * self.width - 1)).astype(np.float32)
        return flat.reshape(-1, self.channels)


def read_wave(read: Callable[[int, int], bytes], size: int, name: str) -> Wave:
    """From the chunks before the samples. read(at, n): n bytes of the file from byte at on."""
    head = read(0, 12)
    if head[:4] not in (b"RIFF", b"RF64") or head[8:] != b"WAVE":
        raise ValueError(f"{name} is no WAV file")
    at, known, long_size = 12, None, None
    while at + 8 <= size:
        tag, length = struct.unpack("<4sI", read(at, 8))
        if tag == b"ds64":
            long_size = struct.unpack("<Q", read(at + 16, 8))[0]
        elif tag == b"fmt ":
            fields = read(at + 8, min(length, 40))
            code, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", fields)
            code = struct.unpack_from("<H", fields, 24)[0] if code == EXTENSIBLE and len(fields) >= 26 else code
            known = (rate, channels, bits // 8, code == FLOAT)
            if code not in (PCM, FLOAT) or not channels or bits not in ((32, 64) if code == FLOAT else (8, 16, 24, 32)):
                raise ValueError(f"{name}: encoding {code} of {bits} bits and {channels} channels is not read")
        elif tag == b"data":
            if known is None:
                raise ValueError(f"{name} has samples before it says what they are")
            there = size - at - 8
            length = there if length in UNKNOWN and long_size is None else min(there, long_size if length == UNKNOWN[1] else length)
            return Wave(*known, at + 8, length // (known[1] * known[2]))
        at += 8 + length + length % 2
    raise ValueError(f"{name} has no samples")


@dataclass
class Part(InputPartition):
    """Samples low to high (all with high None) of some files."""

    places: list[tuple[str, int]]
    low: int = 0
    high: int | None = None


class WaveFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        samples = "array<float>" if self.options.get("mono", "true").lower() == "true" else "array<array<float>>"
        edges = f", left {samples}, right {samples}" if int(self.options.get("edge", 0)) else ""
        return f"path string, sample_rate int, channels int, total long, chunk long, at long, samples {samples}{edges}"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        o = self.options
        numbers = (int(o.get(k, d)) for k, d in (("chunk", CHUNK), ("edge", 0), ("splitBytes", SPLIT_BYTES)))
        return WaveReader(o["path"], o.get("mono", "true").lower() == "true", *numbers)


class WaveReader(DataSourceReader):
    def __init__(self, path: str, mono: bool, chunk: int, edge: int, split: int):
        self.path, self.mono, self.chunk, self.edge, self.split = path, mono, chunk, edge, split

    def partitions(self) -> list[Part]:
        parts: list[Part] = []
        together: list[tuple[str, int]] = []
        held = 0
        files = listed(self.path, (".wav",))
        split = part_bytes(sum(size for _, size in files), self.split)
        for uri, size in files:
            if size <= split:
                if together and (held + size > split or len(together) == MOST_FILES):
                    parts.append(Part(together))
                    together, held = [], 0
                together.append((uri, size))
                held += size
                continue
            store, place = store_of(uri)
            with store.open_input_file(place) as f:
                wave = read_wave(lambda at, n: f.read_at(n, at), size, uri)  # noqa: B023
            step = max(1, split // (wave.step * self.chunk)) * self.chunk
            parts += [Part([(uri, size)], low, min(low + step, wave.total)) for low in range(0, wave.total, step)]
        return [*parts, *([Part(together)] if together else [])] or [Part([])]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        return gathered(self._read(part), STEP_BYTES)

    def _read(self, part: Part) -> Iterator[pa.RecordBatch]:
        for uri, size in part.places:
            store, place = store_of(uri)
            with store.open_input_file(place) as f:
                wave = read_wave(lambda at, n: f.read_at(n, at), size, uri)  # noqa: B023
                high = wave.total if part.high is None else part.high
                step = max(1, STEP_BYTES // (4 * wave.channels * self.chunk)) * self.chunk
                for low in range(part.low, high, step):
                    yield self._rows(f, uri, wave, low, min(low + step, high))

    def _rows(self, file, uri: str, wave: Wave, low: int, high: int) -> pa.RecordBatch:
        first, end = max(0, low - self.edge), min(wave.total, high + self.edge)
        x = wave.decoded(file.read_at((end - first) * wave.step, wave.start + first * wave.step))
        if self.mono:
            x = x.mean(axis=1, dtype=np.float32) if wave.channels > 1 else x[:, 0]
        starts = np.arange(low, high, self.chunk)
        ends = np.minimum(starts + self.chunk, high)

        def column(begin: np.ndarray, stop: np.ndarray) -> pa.Array:
            pieces = [x[a:b] if self.mono else x[a:b].T for a, b in zip((begin - first).tolist(), (stop - first).tolist(), strict=True)]
            if self.mono:
                offsets = np.concatenate([[0], np.cumsum(stop - begin)]).astype(np.int32)
                return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(pieces)))
            return pa.concat_arrays([nested(np.ascontiguousarray(p)[None], "f4") for p in pieces])

        n = len(starts)
        columns = {"path": pa.array([uri] * n)}
        columns |= {k: pa.array(np.full(n, v, np.int32)) for k, v in (("sample_rate", wave.rate), ("channels", wave.channels))}
        columns |= {"total": pa.array(np.full(n, wave.total)), "chunk": pa.array(starts // self.chunk), "at": pa.array(starts), "samples": column(starts, ends)}
        if self.edge:
            columns |= {"left": column(np.maximum(starts - self.edge, 0), starts), "right": column(ends, np.minimum(ends + self.edge, wave.total))}
        return pa.RecordBatch.from_pydict(columns)


def read(spark: SparkSession, path: str, mono: bool = True, chunk: int = CHUNK, edge: int = 0, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    spark.dataSource.register(WaveFiles)
    reader = spark.read.format(FORMAT).option("mono", str(mono).lower()).option("chunk", chunk).option("edge", edge)
    return reader.option("splitBytes", split_bytes).load(path)
