"""Best-fit packing of documents into sequences, in bulk-synchronous rounds.

A document longer than the capacity is cut into pieces of that length; its first piece takes what is left over.
Pieces of one length are alike, and so are gaps of one size, so both sides of the matching are run-length classes: the
histogram of lengths is their range sort, at most `capacity` classes however many documents there are. A round
takes the longest unplaced classes (a band), sweeps all of them to their successor, the smallest gap that holds
them, resolves conflicts over a gap by rank (the longer first), updates the gaps and repeats. When nothing in the band
finds a gap, the longest class opens sequences.

The rounds therefore need the class table alone, which is bounded by the capacity and handled on the driver. What grows
with the data stays distributed: the histogram is a partial aggregate, a piece is numbered within its length where it is cut,
prefix counts over the parts make that its rank (one very common length is spread over all parts), and a rank finds
its sequence by a sorted lookup in the rounds' placements.

Null and empty texts are one piece of the end token alone. Repeated rows are packed each for itself. An empty table
gives no row.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tactus.llm.text import bounded_batches, steps, strings
from tactus.llm.tokens import BYTE_PIECES, ROOM, encoder
from tactus.session import durable

CAPACITY = 1024
END = 2
#: Lengths in a band: those above this part of the longest unplaced one.
BAND = 0.97
#: Counts by length and part (at most `capacity` a part) that are broadcast, about 50 MB; beyond it the pieces move to them.
MOST_BROADCAST = 1 << 19


def piece_lengths(tokens: int, capacity: int) -> list[int]:
    """Lengths in order: whole pieces, the first one what is left over if anything is."""
    rest = tokens % capacity
    return ([rest] if rest else []) + [capacity] * (tokens // capacity)


def id_type(path: str) -> str:
    """How ids are kept on the way: in two bytes where the vocabulary allows it, else in four."""
    from tokenizers import Tokenizer

    return "<u2" if max(Tokenizer.from_file(path).get_vocab().values()) < 1 << 16 else "<u4"


def token_pieces(docs: DataFrame, path: str, kind: str, text: str = "text", capacity: int = CAPACITY, room: int = ROOM) -> DataFrame:
    """(doc_id, piece, start, length, part, nth, ids): ids of id_type kind; nth: the piece's number among those of its length in its part.

    To be written before it is used, for parts are those of the task that made them.
    """
    bounded_batches()
    schema = "doc_id long, piece int, start long, length long, part long, nth long, ids binary"
    end = END.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, BYTE_PIECES, room).encode
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            docs, done = batch.column(0), 0  # ids stay what they are, also beside nulls
            for step in steps(strings(batch.column(1).to_pylist())):
                encoded = [data + end for data in encode(step)]
                own, piece, start, length = cuts(np.fromiter(map(len, encoded), np.int64, len(encoded)) // 4, capacity)
                order = np.argsort(length, kind="stable")
                kinds, first, many = np.unique(length[order], return_index=True, return_counts=True)
                nth = np.empty(len(length), np.int64)
                nth[order] = np.arange(len(length)) - np.repeat(first, many) + np.repeat(seen[kinds], many)
                seen[kinds] += many
                data = np.frombuffer(b"".join(encoded), "<u4").astype(kind)
                ends = (np.cumsum(np.append(0, length)) * data.itemsize).astype(np.int32)
                ids = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(ends), pa.py_buffer(data)])
                columns = [docs.take(pa.array(own + done)), *map(pa.array, (piece, start, length, np.full(len(length), part, np.int64), nth)), ids]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])
                done += len(step)

    return docs.select(F.col("doc_id").cast("long"), text).mapInArrow(cut, schema)


def cuts(tokens: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, piece, start, length) of the pieces of documents of so many tokens, as piece_lengths has them."""
    pieces = -(-tokens // capacity)
    first = tokens - (pieces - 1) * capacity
    own = np.repeat(np.arange(len(tokens)), pieces)
    piece = np.arange(len(own)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = np.where(piece > 0, first[own] + (piece - 1) * capacity, 0)
    return own, piece.astype(np.int32), start, np.where(piece > 0, capacity, first[own])


def rounds(counts: dict[int, int], capacity: int, band: float = BAND) -> list[tuple[int, int, int, int, int]]:
    """Placements (length, first rank, ranks, first sequence, offset): rank first + i goes to sequence first + i."""
    left = {length: n for length, n in counts.items() if n}
    rank = dict.fromkeys(left, 0)
    placed: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # size -> runs (first sequence, sequences)
    sequences = 0

    def place(length: int, runs: list[tuple[int, int]], size: int) -> None:
        for first, n in runs:
            placed.append((length, rank[length], n, first, capacity - size))
            rank[length] += n
            left[length] -= n
            if size > length:
                gaps.setdefault(size - length, []).append((first, n))

    def take(size: int, n: int) -> list[tuple[int, int]]:
        runs = []
        while n:
            first, there = gaps[size].pop()
            runs.append((first, min(n, there)))
            if there > n:
                gaps[size].append((first + n, there - n))
            n -= runs[-1][1]
        if not gaps[size]:
            del gaps[size]
        return runs

    while left := {length: n for length, n in left.items() if n}:
        longest = max(left)
        active = sorted(length for length in left if length > band * longest or length == longest)
        sizes = sorted(gaps)
        wants: dict[int, list[int]] = {}
        for length in reversed(active):  # by rank: the longer first
            at = bisect.bisect_left(sizes, length)
            if at < len(sizes):
                wants.setdefault(sizes[at], []).append(length)
        granted = []
        for size, lengths in wants.items():
            there = sum(n for _, n in gaps[size])
            for length in lengths:
                n = min(left[length], there)
                there -= n
                if n:
                    granted.append((length, size, n))
        taken = [(length, size, take(size, n)) for length, size, n in granted]  # all sweeps end before gaps change
        for length, size, runs in taken:
            place(length, runs, size)
        if longest not in {length for length, _, _ in granted}:
            n = left[longest] if 2 * longest > capacity else -(-left[longest] // (capacity // longest))
            place(longest, [(sequences, n)], capacity)
            sequences += n
    return placed


def packed(pieces: DataFrame, capacity: int = CAPACITY, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """pieces: written rows of token_pieces. Adds sequence_id (long) and offset (long)."""
    counted = durable(pieces.groupBy("length", "part").agg(F.count("*").alias("_n")), "packing-lengths")
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = counted.select("length", "part", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long")).alias("_before"))
    histogram = counted.groupBy("length").agg(F.sum("_n").alias("n")).collect()  # a row for each length there is
    placed = sorted(rounds({r["length"]: r["n"] for r in histogram}, capacity))
    table = np.array(placed, np.int64).reshape(-1, 5)
    keys = table[:, 0] << 48 | table[:, 1]
    plan = pieces.sparkSession.sparkContext.broadcast((keys, table))  # bounded by capacity and rounds, not by rows

    @F.pandas_udf("sequence_id long, offset long")
    def find(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        keys, table = plan.value
        own = table[np.searchsorted(keys, length.to_numpy() << 48 | rank.to_numpy(), side="right") - 1]
        return pd.DataFrame({"sequence_id": own[:, 3] + rank.to_numpy() - own[:, 1], "offset": own[:, 4]})

    way = "broadcast" if counted.count() <= most_broadcast else "shuffle_hash"  # the ids needn't move for their ranks
    ranked = pieces.join(starts.hint(way), ["length", "part"])
    found = ranked.withColumn("_place", find("length", F.col("nth") + F.col("_before")))
    return found.select(*pieces.columns, "_place.sequence_id", "_place.offset")


def filled(pieces: DataFrame) -> DataFrame:
    """pieces: packed. The sequences: (sequence_id, length, ids in the pieces' id type, pieces: what lies in it, in order)."""
    columns = ("offset", "doc_id", "piece", "start", "length")
    parts = F.array_sort(F.collect_list(F.struct(*columns)))  # at most `capacity` pieces
    joined = F.expr("listagg(ids) within group (order by offset)")
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("ids"), parts.alias("pieces"))


def _sequences(docs: DataFrame, path: str, kind: str, text: str, capacity: int, room: int) -> DataFrame:
    return filled(packed(durable(token_pieces(docs, path, kind, text, capacity, room), "packing-pieces", "zstd"), capacity))


def pack_documents(docs: DataFrame, path: str, text: str = "text", capacity: int = CAPACITY, room: int = ROOM) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. room: pieces of text a worker keeps.

    The sequences are made; ids_crc32 is that of the ids that lie at the piece's place in its sequence.
    """
    kind = id_type(path)
    size = np.dtype(kind).itemsize

    @F.pandas_udf("long")
    def crc(ids: pd.Series) -> pd.Series:
        return pd.Series([zlib.crc32(np.frombuffer(x, kind).astype("<u4")) for x in ids], dtype="int64")

    laid = _sequences(docs, path, kind, text, capacity, room).select("sequence_id", "ids", F.explode("pieces").alias("p"))
    there = F.substring("ids", (F.col("p.offset") * size + 1).cast("int"), (F.col("p.length") * size).cast("int"))
    return laid.select("p.doc_id", "p.piece", "p.start", "p.length", crc(there).alias("ids_crc32"), "sequence_id", "p.offset")


def sequences(docs: DataFrame, path: str, text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """The sequences themselves: (sequence_id, length, ids: little-endian unsigned 32-bit), each of at most `capacity` tokens."""
    kind = id_type(path)

    @F.pandas_udf("binary")
    def wide(ids: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(x, kind).astype("<u4").tobytes() for x in ids], dtype=object)

    return _sequences(docs, path, kind, text, capacity, ROOM).select("sequence_id", "length", wide("ids").alias("ids"))
