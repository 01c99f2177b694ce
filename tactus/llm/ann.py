"""Approximate nearest neighbours by largest cosine: a hierarchical navigable small-world graph for each shard, results merged.

Vectors are dealt to shards of about `shard_rows` rows by a hash of id and vector. A shard's graph is a stored row of flat
arrays: its distinct directions (nodes), the neighbour table of every level, and the ids behind each node. Nodes are numbered by
falling level, so a level's nodes are the first ones and its table needs no index. Nodes are put in, in batches: each is searched in
the graph so far from the top level down, gets neighbours that are nearer to it than to each other, and is linked back;
full tables are chosen anew by the same rule. A level is that of a hash, so reruns give the same graph.

Queries are packed into blocks; a task searches one shard's graph for some blocks, whatever the numbers of both. What a
search finds is scored exactly, in double precision, on the original vectors, and the best k of all shards are a query's.

Rows take no part whose id or vector is null, or whose vector is zero, empty or holds a null or non-finite component. Only vectors
of the same length are compared. Rows of one id are one candidate with the best of its vectors, and one query; a query is never its own
neighbour. Repeated rows count once. Other columns don't matter. An empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tactus.llm.text import bounded_batches, mix64
from tactus.session import durable

#: Neighbours of a node on the upper levels; twice as many on the lowest.
LINKS = 16
#: Nodes that a search keeps while the graph is made, and for a query.
EF_BUILD = 64
EF_SEARCH = 96
#: Rows of a shard, on average, and queries of a block. Both bound what a task holds.
SHARD_ROWS = 8192
BLOCK_ROWS = 4096
#: Blocks that one copy of a shard meets.
SPAN = 8
#: Nodes put in together at most; nodes expanded together in a step of a search.
BATCH = 256
STRIDE = 4
#: Bytes of candidates' vectors and similarities that are held at once.
CANDIDATE_BYTES = 64 << 20
TOP = 12


def levels_of(keys: np.ndarray) -> np.ndarray:
    """A node's top level: one in LINKS nodes of a level is on the next."""
    uniform = (mix64(keys).astype(np.float64) + 1) / 2.0**64
    return np.minimum(np.floor(-np.log(uniform) / np.log(LINKS)), TOP).astype(np.int64)


def diverse(sims: np.ndarray, vectors: np.ndarray, most: int) -> np.ndarray:
    """Which candidates (a row of them by falling similarity, -inf for none) become neighbours, at most `most`.

    One is taken if it is nearer to the row's node than to those taken before; what room is left goes to the nearest others.
    """
    between = vectors @ vectors.transpose(0, 2, 1)
    there = np.isfinite(sims)
    taken = np.zeros(sims.shape, bool)
    near = np.full(sims.shape, -np.inf)  # to the nearest one taken
    room = np.full(len(sims), most)
    for k in range(sims.shape[1]):
        good = there[:, k] & (sims[:, k] > near[:, k]) & (room > 0)
        taken[:, k] = good
        room -= good
        near = np.where(good[:, None], np.maximum(near, between[:, k]), near)
    rest = there & ~taken
    return taken | (rest & (np.cumsum(rest, axis=1) <= room[:, None]))


@dataclass
class Graph:
    """links[level]: (nodes of the level, room) node numbers, -1 for none. count[level]: how many nodes are on it."""

    vectors: np.ndarray
    count: list[int]
    links: list[np.ndarray]

    @classmethod
    def made(cls, vectors: np.ndarray, level: np.ndarray) -> Graph:
        """vectors: distinct unit vectors (float32) by falling level."""
        top = int(level.max(initial=0))
        count = [int((level >= k).sum()) for k in range(top + 1)]
        graph = cls(vectors, count, [np.full((n, LINKS * (2 if k == 0 else 1)), -1, np.int32) for k, n in enumerate(count)])
        low = 0
        while low < len(vectors):
            high = min(len(vectors), low + min(BATCH, max(LINKS, low)))
            graph._put(low, high, level[low:high])
            low = high
        return graph

    def _put(self, low: int, high: int, level: np.ndarray) -> None:
        own = self.vectors[low:high]
        start = np.zeros(len(own), np.int64)
        for k in range(len(self.count) - 1, -1, -1):
            mine = int((level >= k).sum())  # the first ones of the batch
            found = np.full((len(own), 1), -1)
            sims = np.full(found.shape, -np.inf, np.float32)
            if min(low, self.count[k]):
                if mine:
                    found, sims = self.beam(k, own[:mine], start[:mine], EF_BUILD)
                    start[:mine] = found[:, 0]
                if mine < len(own):
                    start[mine:] = self.beam(k, own[mine:], start[mine:], 1)[0][:, 0]
            if not mine:
                continue
            among = own[:mine] @ own[:mine].T  # those of the batch may be neighbours as well
            np.fill_diagonal(among, -np.inf)
            found = np.concatenate([found[:mine], np.broadcast_to(np.arange(low, low + mine), among.shape)], axis=1)
            sims = np.concatenate([sims[:mine], among], axis=1)
            order = np.argsort(-sims, axis=1, kind="stable")[:, :EF_BUILD]
            found, sims = np.take_along_axis(found, order, 1), np.take_along_axis(sims, order, 1)
            keep = self._chosen(sims, found, LINKS)
            row, column = np.nonzero(keep)
            place = (np.cumsum(keep, axis=1) - 1)[row, column]
            self.links[k][low + row, place] = found[row, column]
            self._link_back(k, low + row, found[row, column], sims[row, column])

    def _chosen(self, sims: np.ndarray, found: np.ndarray, most: int) -> np.ndarray:
        step = max(1, CANDIDATE_BYTES // (4 * found.shape[1] * (found.shape[1] + self.vectors.shape[1])))
        return np.concatenate([diverse(sims[k : k + step], self.vectors[found[k : k + step]], most) for k in range(0, len(sims), step)])

    def _link_back(self, k: int, source: np.ndarray, target: np.ndarray, sims: np.ndarray) -> None:
        table = self.links[k]
        known = (table[target] == source[:, None]).any(axis=1)
        source, target, sims = source[~known], target[~known], sims[~known]
        order = np.lexsort((-sims, target))
        source, target, sims = source[order], target[order], sims[order]
        node, first, many = np.unique(target, return_index=True, return_counts=True)
        room = table.shape[1]
        nth = np.arange(len(target)) - np.repeat(first, many)
        fresh = np.full((len(node), min(room, int(many.max(initial=0)))), -1)
        fits = nth < fresh.shape[1]  # of more than would fit alone, the nearest
        fresh[np.repeat(np.arange(len(node)), many)[fits], nth[fits]] = source[fits]
        both = np.concatenate([table[node], fresh], axis=1)
        full = (both >= 0).sum(1) > room
        easy = both[~full]
        table[node[~full]] = np.take_along_axis(easy, np.argsort(easy < 0, axis=1, kind="stable"), 1)[:, :room]
        node, both = node[full], both[full]
        if not len(node):
            return
        sims = np.where(both >= 0, np.einsum("nkd,nd->nk", self.vectors[both], self.vectors[node]), -np.inf)
        order = np.argsort(-sims, axis=1, kind="stable")
        both, sims = np.take_along_axis(both, order, 1), np.take_along_axis(sims, order, 1)
        keep = self._chosen(sims, both, room)
        first = np.argsort(~keep, axis=1, kind="stable")[:, :room]
        table[node] = np.where(np.take_along_axis(keep, first, 1), np.take_along_axis(both, first, 1), -1)

    def beam(self, k: int, queries: np.ndarray, start: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """Nodes of level k (-1 for none) and their similarities, for each query the best ef found from its start, best first."""
        n, table = len(queries), self.links[k]
        seen = np.zeros((n, len(table)), bool)
        ids = np.full((n, ef), -1, np.int64)
        sims = np.full((n, ef), -np.inf, np.float32)
        fresh = np.zeros((n, ef), bool)  # not expanded yet
        ids[:, 0], fresh[:, 0] = start, True
        sims[:, 0] = np.einsum("nd,nd->n", queries, self.vectors[start])
        seen[np.arange(n), start] = True
        while True:
            live = np.flatnonzero(fresh.any(axis=1))
            if not len(live):
                return ids, sims
            nearest = fresh[live] & (np.cumsum(fresh[live], axis=1) <= STRIDE)
            row, column = np.nonzero(nearest)
            fresh[live[row], column] = False
            near = table[ids[live[row], column]]
            row = np.repeat(row, near.shape[1])
            near = near.ravel()
            unseen = (near >= 0) & ~seen[live[row], near]
            pairs = np.unique(row[unseen] * len(table) + near[unseen])
            row, near = np.divmod(pairs, len(table))
            seen[live[row], near] = True
            if not len(row):
                continue
            s = np.einsum("nd,nd->n", queries[live[row]], self.vectors[near])
            many = np.bincount(row, minlength=len(live))
            at = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            more = np.full((len(live), int(many.max())), -1, np.int64)
            score = np.full(more.shape, -np.inf, np.float32)
            more[row, at], score[row, at] = near, s
            all_ids = np.concatenate([ids[live], more], axis=1)
            all_sims = np.concatenate([sims[live], score], axis=1)
            all_fresh = np.concatenate([fresh[live], more >= 0], axis=1)
            order = np.argsort(-all_sims, axis=1, kind="stable")[:, :ef]
            ids[live], sims[live], fresh[live] = (np.take_along_axis(x, order, 1) for x in (all_ids, all_sims, all_fresh))

    def search(self, queries: np.ndarray, ef: int = EF_SEARCH) -> np.ndarray:
        """(queries, ef): the nodes found for unit vectors, nearest first, -1 for none."""
        found = []
        together = max(1, min(BATCH, (64 << 20) // max(1, len(self.vectors))))  # each marks the nodes it has seen
        for low in range(0, len(queries), together):
            q = queries[low : low + together]
            start = np.zeros(len(q), np.int64)
            for k in range(len(self.count) - 1, 0, -1):
                start = self.beam(k, q, start, 1)[0][:, 0]
            found.append(self.beam(0, q, start, ef)[0])
        return np.concatenate(found) if found else np.zeros((0, ef), np.int64)


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that no square overflows or vanishes; cosines don't change by it."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    dot = lambda x, y: (x * y).sum(axis=1)
    return dot(a, b) / (np.sqrt(dot(a, a)) * np.sqrt(dot(b, b)))


def units(vectors: np.ndarray) -> np.ndarray:
    return (vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]).astype(np.float32) + np.float32(0)


SHARD = "shard int, dim int, nodes long, rows long, count array<int>, units binary, links binary, originals binary, owner binary, nth binary, ids binary"


def shard_row(shard: int, dim: int, ids: np.ndarray, vectors: np.ndarray) -> dict:
    """The stored form of a shard: its graph, and its rows (original vector and id) by node and id."""
    vectors = scaled(vectors)
    directions, node = np.unique(units(vectors), axis=0, return_inverse=True)
    node = node.ravel()
    key = mix64(np.ascontiguousarray(directions).view(np.uint32).sum(axis=1, dtype=np.uint64))  # a rerun's levels are the same
    level = levels_of(key)
    order = np.lexsort((key, -level))
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    graph = Graph.made(directions[order], level[order])
    owner = number[node]
    variant = np.unique(vectors, axis=0, return_inverse=True)[1].ravel()
    by = np.lexsort((ids, variant, owner))
    starts = np.flatnonzero(np.concatenate([[True], (variant[by][1:] != variant[by][:-1])]))
    nth = np.arange(len(by)) - np.repeat(starts, np.diff(np.append(starts, len(by))))  # among the ids of one vector
    return {
        "shard": shard, "dim": dim, "nodes": len(order), "rows": len(ids), "count": graph.count, "units": graph.vectors.tobytes(),
        "links": b"".join(t.tobytes() for t in graph.links), "originals": vectors[by].tobytes(), "owner": owner[by].tobytes(), "nth": nth.tobytes(), "ids": ids[by].tobytes(),
    }


def opened(row) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(graph, original vectors, their nodes, their places among like vectors, their ids) of a stored shard; rows by node."""
    dim = int(row.dim)
    links, at = [], 0
    flat = np.frombuffer(row.links, np.int32)
    for k, n in enumerate(row.count):
        size = int(n) * LINKS * (2 if k == 0 else 1)
        links.append(flat[at : at + size].reshape(int(n), -1))
        at += size
    graph = Graph(np.frombuffer(row.units, np.float32).reshape(-1, dim), [int(n) for n in row.count], links)
    return graph, np.frombuffer(row.originals, np.float64).reshape(-1, dim), *(np.frombuffer(x, np.int64) for x in (row.owner, row.nth, row.ids))


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): the distinct rows that take part, vectors as doubles."""
    v = F.col(vector)
    odd = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    known = df.where(F.col(key).isNotNull() & v.isNotNull() & ~F.exists(v, odd) & F.exists(v, lambda x: x != 0))
    return known.select(F.col(key).cast("long").alias("id"), v.cast("array<double>").alias("v")).distinct()


def index(df: DataFrame, key: str, vector: str, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The written index: a row of SHARD for each shard and length of vectors; every row that takes part is in one of them."""
    bounded_batches()
    shards = max(1, -(-df.count() // shard_rows))
    dealt = usable(df, key, vector).withColumn("shard", F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int"))

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        rows = pd.concat(held, ignore_index=True)
        held.clear()
        for (shard, dim), group in rows.groupby(["shard", rows["v"].map(len)]):
            row = shard_row(int(shard), int(dim), group["id"].to_numpy(np.int64), np.stack(group["v"].to_list()))
            yield pd.DataFrame([row])

    return durable(dealt.repartitionById(shards, "shard").mapInPandas(build, SHARD), "ann-shards", "zstd")


BLOCKS = "block int, dim int, query_ids binary, queries binary"
FOUND = "query_id long, vec_id long, score double"


def blocks(df: DataFrame, key: str, vector: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Queries packed: a written row of BLOCKS for each block and length of vectors."""
    number = max(1, -(-df.count() // block_rows))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        rows = pd.concat(held, ignore_index=True)
        for (block, dim), group in rows.groupby(["block", rows["v"].map(len)]):
            data = np.stack(group["v"].to_list())
            yield pd.DataFrame([{"block": block, "dim": dim, "query_ids": group["id"].to_numpy(np.int64).tobytes(), "queries": data.tobytes()}])

    dealt = usable(df, key, vector).withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(number)).cast("int"))
    return durable(dealt.repartitionById(number, "block").mapInPandas(pack, BLOCKS), "ann-blocks", "zstd")


def best_of(shard, query_ids: np.ndarray, queries: np.ndarray, k: int, ef: int = EF_SEARCH) -> Iterator[pd.DataFrame]:
    """FOUND of one stored shard for a block: for each query the k best ids of what its search finds."""
    graph, originals, owner, nth, ids = opened(shard)
    some = np.flatnonzero(nth <= k)  # of the ids of one vector, k besides the query's own are enough
    originals, owner, ids = originals[some], owner[some], ids[some]
    queries = scaled(queries)
    for low in range(0, len(queries), BATCH):
        asked, own = queries[low : low + BATCH], query_ids[low : low + BATCH]
        found = graph.search(units(asked), max(ef, k + 1))
        q, column = np.nonzero(found >= 0)
        first, end = (np.searchsorted(owner, found[q, column], side=side) for side in ("left", "right"))
        many = end - first
        at = np.arange(many.sum()) + np.repeat(first - np.cumsum(many) + many, many)
        q = np.repeat(q, many)
        other = ids[at] != own[q]
        q, at = q[other], at[other]
        score = np.concatenate([np.zeros(0), *(cosines(asked[q[i : i + 65536]], originals[at[i : i + 65536]]) for i in range(0, len(q), 65536))])
        order = np.lexsort((ids[at], -score, q))
        rows = pd.DataFrame({"query_id": own[q[order]], "vec_id": ids[at[order]], "score": score[order], "q": q[order]})
        rows = rows[~rows.duplicated(["q", "vec_id"])]
        yield rows[rows.groupby("q").cumcount() < k][["query_id", "vec_id", "score"]]


def nearest(shards: DataFrame, asked: DataFrame, k: int, ef: int = EF_SEARCH) -> DataFrame:
    """shards: index; asked: blocks. (query_id, rank, vec_id, score): each query's k nearest of what is found, ties to the smaller id."""
    bounded_batches()
    last = shards.agg(F.coalesce(F.max("shard"), F.lit(0))).first()[0]
    spans = asked.agg(F.coalesce(F.floor(F.max("block") / SPAN), F.lit(0))).first()[0]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(int(n))))
    met = asked.withColumns({"shard": every(last), "span": F.floor(F.col("block") / SPAN).cast("int")})
    # Blocks times shards are many times the blocks' files, by which Spark would judge them small enough for a broadcast.
    pairs = met.hint("merge").join(shards.withColumn("span", every(spans)), ["shard", "dim", "span"])

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                queries = np.frombuffer(row.queries, np.float64).reshape(-1, int(row.dim))
                yield from best_of(row, np.frombuffer(row.query_ids, np.int64), queries, k, ef)

    found = pairs.mapInPandas(search, FOUND)
    one = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return one.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_neighbours(df: DataFrame, key: str, vector: str, asked: Column, k: int, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, ef: int = EF_SEARCH) -> DataFrame:
    """Of the rows for which asked holds, the k nearest among all rows: (query_id, rank, vec_id, score)."""
    return nearest(index(df, key, vector, shard_rows), blocks(df.where(asked), key, vector, block_rows), k, ef)
