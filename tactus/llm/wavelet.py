"""Token ids in wavelet matrices: one compressed file per shard, written in ascending document order.

A shard's ids are stored as bit-planes, highest bit first; after each plane the ids are parted stably by its bit. With
rank directories on every plane the one file answers what token stands at a place (access), how often a token occurs
up to a place (rank, count) and where its k-th occurrence is (select), and it decodes whole runs plane by plane.

File: MAGIC, then a length-prefixed JSON head (tokens, zeros, compressed sizes and the rank directories), the documents'
table and the planes in chunks of CHUNK bits, each compressed by itself, so a question reads a chunk or two of a plane. Files hold whole documents, about `shard_tokens` tokens each, so a task's memory is
bounded however large its partition. They are written under a temporary name and moved, so a task that runs twice
leaves the same file.

Null and empty texts have the end token alone. A null id sorts first. Rows of one id are ordered by a hash of the text. An empty table
gives no row.
"""

from __future__ import annotations

import bisect
import itertools
import json
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tactus.llm.text import bounded_batches, steps, strings
from tactus.llm.tokens import WORD_PIECES, encoder
from tactus.session import durable, fresh_path
from tactus.sources.store import store_of

MAGIC = b"TWM2"
END = 2
SHARD_TOKENS = 1 << 20
#: Bits of a plane that are compressed together; the rank directory has an entry for each.
CHUNK = 1 << 17


class Plane:
    """One bit-plane in compressed chunks, with its rank directory: ones before each chunk, and in all."""

    def __init__(self, n: int, before: list[int], load: Callable[[int], np.ndarray]):
        self.n, self.before, self.load = n, before, load
        self.held: dict[int, np.ndarray] = {}

    @classmethod
    def of(cls, bits: np.ndarray) -> Plane:
        packed = np.packbits(bits)
        parts = [packed[k : k + CHUNK // 8] for k in range(0, len(packed), CHUNK // 8)]
        ones = [int(np.bitwise_count(p).sum(dtype=np.int64)) for p in parts]
        return cls(len(bits), [0, *itertools.accumulate(ones)], parts.__getitem__)

    @property
    def chunks(self) -> int:
        return len(self.before) - 1

    def chunk(self, k: int) -> np.ndarray:
        if k not in self.held:
            self.held[k] = self.load(k)
        return self.held[k]

    def bits(self) -> np.ndarray:
        parts = [self.load(k) for k in range(self.chunks)]
        return np.unpackbits(np.concatenate(parts) if parts else np.zeros(0, np.uint8), count=self.n).view(bool)

    def get(self, i: int) -> int:
        k, rest = divmod(i, CHUNK)
        return int(self.chunk(k)[rest >> 3] >> (7 - (rest & 7))) & 1

    def rank(self, bit: int, i: int) -> int:
        """Occurrences of bit before place i."""
        k, rest = divmod(i, CHUNK)
        ones = self.before[k]
        if rest:
            whole, odd = divmod(rest, 8)
            row = self.chunk(k)
            ones += int(np.bitwise_count(row[:whole]).sum(dtype=np.int64))
            if odd:
                ones += (int(row[whole]) >> (8 - odd)).bit_count()
        return ones if bit else i - ones

    def select(self, bit: int, k: int) -> int:
        """Place of the k-th occurrence (from 0) of bit: by the directory, then in one chunk."""
        count = lambda c: self.before[c] if bit else c * CHUNK - self.before[c]
        at = bisect.bisect_right(range(self.chunks), k, key=count) - 1
        inside = np.unpackbits(self.chunk(at), count=min(CHUNK, self.n - at * CHUNK)) == bit
        return at * CHUNK + int(np.flatnonzero(inside)[k - count(at)])


class WaveletMatrix:
    def __init__(self, n: int, planes: list[Plane], zeros: list[int]):
        self.n, self.planes, self.zeros = n, planes, zeros

    @classmethod
    def build(cls, ids: np.ndarray, width: int) -> WaveletMatrix:
        planes, zeros = [], []
        x = ids.astype(np.uint16 if width <= 16 else np.uint32)
        for level in range(width - 1, -1, -1):
            bit = (x & x.dtype.type(1 << level)) != 0
            planes.append(Plane.of(bit))
            low = np.compress(~bit, x)
            zeros.append(len(low))
            x = np.concatenate([low, np.compress(bit, x)])
        return cls(len(ids), planes, zeros)

    def decode(self) -> np.ndarray:
        """All ids in order: the parting of each plane is undone from the last to the first."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        x = np.zeros(self.n, kind)
        for level, (plane, zeros) in enumerate(zip(reversed(self.planes), reversed(self.zeros), strict=True)):
            bit = plane.bits()
            up = np.empty_like(x)
            up[np.flatnonzero(~bit)] = x[:zeros]
            up[np.flatnonzero(bit)] = x[zeros:] | kind(1 << level)
            x = up
        return x.astype(np.uint32)

    def access(self, i: int) -> int:
        value = 0
        for plane, zeros in zip(self.planes, self.zeros, strict=True):
            bit = plane.get(i)
            value = value << 1 | bit
            i = zeros + plane.rank(1, i) if bit else plane.rank(0, i)
        return value

    def _interval(self, token: int, start: int, stop: int) -> tuple[int, int]:
        """Where the token's occurrences in start..stop stand behind the last plane."""
        width = len(self.planes)
        if token >> width:
            return 0, 0
        for level, (plane, zeros) in enumerate(zip(self.planes, self.zeros, strict=True)):
            bit = token >> (width - 1 - level) & 1
            start, stop = (bit * zeros + plane.rank(bit, i) for i in (start, stop))
        return start, stop

    def rank(self, token: int, i: int) -> int:
        """Occurrences of token before place i."""
        start, stop = self._interval(token, 0, i)
        return stop - start

    def count(self, token: int, start: int = 0, stop: int | None = None) -> int:
        low, high = self._interval(token, start, self.n if stop is None else stop)
        return high - low

    def select(self, token: int, k: int) -> int:
        """Place of the k-th occurrence (from 0) of token; IndexError if there are fewer."""
        start, stop = self._interval(token, 0, self.n)
        if not 0 <= k < stop - start:
            raise IndexError(k)
        i = start + k
        for level, (plane, zeros) in enumerate(zip(reversed(self.planes), reversed(self.zeros), strict=True)):
            bit = token >> level & 1
            i = plane.select(bit, i - bit * zeros)
        return i


def to_bytes(matrix: WaveletMatrix, docs: list[int | None], lengths: list[int]) -> bytes:
    compress = zstandard.ZstdCompressor(level=1).compress
    known = np.array([d is not None for d in docs], bool)
    table = [np.packbits(known), np.array([d or 0 for d in docs], "<i8"), np.array(lengths, "<i8")]
    parts = [compress(x.tobytes()) for x in table]
    planes = [[compress(p.load(k).tobytes()) for k in range(p.chunks)] for p in matrix.planes]
    head = {"tokens": matrix.n, "docs": len(docs), "zeros": matrix.zeros, "table": list(map(len, parts))}
    head |= {"planes": [list(map(len, p)) for p in planes], "before": [p.before for p in matrix.planes]}
    text = json.dumps(head).encode()
    return b"".join([MAGIC, len(text).to_bytes(4, "little"), text, *parts, *itertools.chain.from_iterable(planes)])


def open_shard(read: Callable[[int, int], bytes]) -> tuple[WaveletMatrix, list[int | None], np.ndarray]:
    """(matrix, document ids, their numbers of tokens). read(at, n): n bytes of the file from byte at on.

    Of the planes only the chunks that a question needs are read and expanded.
    """
    start = read(0, 8)
    if start[:4] != MAGIC:
        raise ValueError("not a wavelet matrix file")
    size = int.from_bytes(start[4:8], "little")
    head = json.loads(read(8, size))
    expand = zstandard.ZstdDecompressor().decompress
    places = [8 + size, *itertools.accumulate([*head["table"], *itertools.chain.from_iterable(head["planes"])], initial=0)]
    places = [places[0] + x for x in places[1:]]
    part = lambda k: np.frombuffer(expand(read(places[k], places[k + 1] - places[k])), np.uint8)
    known = np.unpackbits(part(0), count=head["docs"])
    docs = [int(d) if k else None for d, k in zip(part(1).view("<i8"), known, strict=True)]
    planes, first = [], len(head["table"])
    for before in head["before"]:
        planes.append(Plane(head["tokens"], before, lambda k, first=first: part(first + k)))
        first += len(before) - 1
    return WaveletMatrix(head["tokens"], planes, head["zeros"]), docs, part(2).view("<i8")


def from_bytes(data: bytes) -> tuple[WaveletMatrix, list[int | None], np.ndarray]:
    return open_shard(lambda at, n: data[at : at + n])


def read_file(uri: str) -> bytes:
    store, path = store_of(uri)
    with store.open_input_stream(path) as f:
        return f.read()


@contextmanager
def shard_at(uri: str) -> Iterator[tuple[WaveletMatrix, list[int | None], np.ndarray]]:
    """A shard's file, opened for questions that read parts of it."""
    store, path = store_of(uri)
    with store.open_input_file(path) as f:
        yield open_shard(lambda at, n: f.read_at(n, at))


def write_shards(docs: DataFrame, path: str, folder: str, text: str = "text", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write the files into the folder; returns their list (part, number, file, docs, tokens) in document order."""
    bounded_batches()
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Rows of one id go by a hash of their text; like rows, by where they come from: no id or row fills a task.
    keys = {"key": F.xxhash64("text"), "row": F.monotonically_increasing_id()}
    ordered = docs.select("doc_id", F.col(text).alias("text")).withColumns(keys)
    ordered = ordered.repartitionByRange(tasks, "doc_id", *keys).sortWithinPartitions("doc_id", *keys).select("doc_id", "text")
    end = END.to_bytes(4, "little")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        words = encoder(path, WORD_PIECES)
        store, root = store_of(folder)
        store.create_dir(root, recursive=True)
        held: list[bytes] = []
        names: list[int | None] = []
        number = 0

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), "<u4")
            data = to_bytes(WaveletMatrix.build(ids, words.width), names, [len(h) // 4 for h in held])
            name = f"part-{part:06d}-{number:06d}.twm"
            temporary = f"{root}/.{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(temporary) as f:
                f.write(data)
            store.move(temporary, f"{root}/{name}")
            row = {"part": [part], "number": [number], "file": [f"{folder}/{name}"], "docs": [len(names)], "tokens": [len(ids)]}
            held.clear()
            names.clear()
            return pa.RecordBatch.from_pydict(row)

        size = 0
        for batch in batches:
            keys = iter(batch.column("doc_id").to_pylist())  # not by pandas, whose floats are no ids
            for step in steps(strings(batch.column("text").to_pylist())):
                for ids in words.encode(step):
                    key = next(keys)
                    held.append(ids + end)
                    names.append(key)
                    size += len(ids) // 4 + 1
                    if size >= shard_tokens:
                        yield flush()
                        number, size = number + 1, 0
        if held:
            yield flush()

    return durable(ordered.mapInArrow(write, "part long, number long, file string, docs long, tokens long"), "wavelet-files")


def read_shards(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files alone; start counts the ids of all documents before."""
    parts = files.groupBy("part").agg(F.sum("tokens").alias("_sum"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row for each partition that was written
    parts = parts.select("part", F.coalesce(F.sum("_sum").over(before), F.lit(0).cast("long")).alias("_part_start"))
    within = W.partitionBy("part").orderBy("number").rowsBetween(W.unboundedPreceding, -1)
    placed = files.withColumn("_start", F.coalesce(F.sum("tokens").over(within), F.lit(0).cast("long"))).join(parts, "part")
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = placed.select("file", (F.col("_start") + F.col("_part_start")).alias("start")).repartition(tasks, "file")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for uri, start in zip(batch["file"], batch["start"], strict=True):
                matrix, docs, lengths = from_bytes(read_file(uri))
                raw = matrix.decode().astype("<u4").tobytes()
                ends = np.cumsum(lengths)
                crcs = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                rows = {"doc_id": pd.array(docs, "Int64"), "start": start + ends - lengths, "n_tokens": lengths, "ids_crc32": crcs}
                yield pd.DataFrame(rows)

    return placed.mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, path: str, text: str = "text", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write docs as wavelet files in the shared folder and read them back."""
    return read_shards(write_shards(docs, path, fresh_path(docs.sparkSession, "wavelet"), text, shard_tokens))
