"""SimHash near-duplicates by pivot distance tables.

Fingerprints: 64 bits, the majority of the XXH64 bits of a text's 3-word shingles. Two fingerprints link at 3 or
fewer differing bits; documents are grouped by what they reach over links.

Distinct fingerprints alone are compared, so exact copies cost nothing. A fingerprint falls in five sections; two
that differ in at most 3 bits agree in at least two of them, so each of the ten pairs of sections makes a key, and
every linked pair meets under one of them (exact, no probability). A written table holds the Hamming distances of each
distinct fingerprint to PIVOTS reference fingerprints. Distances of linked fingerprints to any pivot differ by at
most 3: rows are swept in the order of the first distance while it allows a link, pairs are dropped by their
largest difference over the other pivots, and the survivors are verified. A key with more than `most_together`
fingerprints is cut into cells of two salts, so that every pair still meets in some cell and no task gathers the
group. Each group hands on a spanning star of its links, not all pairs.

Null and empty texts have fingerprint 0 and link like any other. Null ids count in no minimum; a component
without any id has a null component_id. Repeated rows each keep their row.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tactus.llm.text import bounded_batches, steps, utf8
from tactus.session import durable

SHINGLE = 3
SEED = 42
MOST_BITS = 3
#: First bit of each section, and the end.
SECTIONS = (0, 13, 26, 39, 52, 64)
PIVOTS = 16
MOST_TOGETHER = 4096
#: Bytes of a text whose words are cut out together, and shingles whose bits are added up together.
PIECE_BYTES = 1 << 20
SHINGLES_TOGETHER = 1 << 16
SPACE_AT = re.compile(rb"[ \t-\r]")
#: Reference fingerprints: seeded, spread over the whole space.
PIVOT_TABLE = np.random.default_rng(64).integers(0, 1 << 64, PIVOTS, dtype=np.uint64)


def hashes(raw: bytes, piece: int = PIECE_BYTES) -> Iterator[np.ndarray]:
    """XXH64 of each shingle of the text, repeats included, those of a piece of it at a time."""
    carried: list[bytes] = []
    low, made = 0, False
    while True:
        space = SPACE_AT.search(raw, low + piece)
        high = space.start() if space else len(raw)
        words = carried + raw[low:high].lower().split()  # bytes: lower-cases A-Z only and splits at ASCII white space
        if len(words) >= SHINGLE:
            shingles = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE)), strict=False))
            yield np.fromiter(map(xxhash.xxh64_intdigest, shingles, itertools.repeat(SEED)), np.uint64)
            words, made = words[1 - SHINGLE :], True
        carried, low = words, high
        if high == len(raw):
            break
    if carried and not made:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(carried), SEED)], np.uint64)


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """Bits are added up for a bounded number of shingles at a time, whether these are of many texts or of one."""
    ones, counts = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    owners: list[int] = []
    held: list[np.ndarray] = []

    def add() -> None:
        sizes = np.fromiter(map(len, held), np.int64, len(held))
        if len(held):
            bits = np.unpackbits(np.concatenate(held).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            np.add.at(ones, owners, np.add.reduceat(bits, np.cumsum(sizes) - sizes, axis=0, dtype=np.int64))
            np.add.at(counts, owners, sizes)
        owners.clear()
        held.clear()

    waiting = 0
    for k, text in enumerate(texts):
        for h in hashes(text):
            owners.append(k)
            held.append(h)
            waiting += len(h)
            if waiting >= SHINGLES_TOGETHER:
                add()
                waiting = 0
    add()
    return np.packbits(2 * ones > counts[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprint(text: Column | str) -> Column:
    """The 64 bits as a (signed) long."""

    bounded_batches()
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        parts = [fingerprints(step) for step in steps(utf8(texts))]
        return pd.Series(np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64))

    return of(text)


def pivot_columns(fp: Column) -> list[Column]:
    """The pivot distance table's row of a fingerprint: PIVOTS distances of one byte each, in longs near0, near1 and so on."""

    def packed(pivots) -> Column:
        out = F.lit(0).cast("long")
        for k, p in enumerate(pivots.astype(np.int64).tolist()):
            out = out.bitwiseOR(F.shiftleft(F.bit_count(fp.bitwiseXOR(F.lit(p))).cast("long"), 8 * k))
        return out

    return [packed(PIVOT_TABLE[k : k + 8]).alias(f"near{k // 8}") for k in range(0, PIVOTS, 8)]


NEAR = [f"near{k}" for k in range(PIVOTS // 8)]


def group_roots(group: np.ndarray, fp: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The first row that each row reaches over links within its group. Rows by group, then first pivot distance.

    table: (rows, PIVOTS) distances to the reference fingerprints.
    """
    n = len(fp)
    first = table[:, 0]
    left, right = [], []
    active = np.arange(n)
    for shift in range(1, n):
        active = active[active + shift < n]
        active = active[(group[active + shift] == group[active]) & (first[active + shift] - first[active] <= MOST_BITS)]
        if not len(active):
            break
        a = active
        for k in range(1, PIVOTS):  # the largest coordinate difference decides; most pairs fall at the first few
            a = a[np.abs(table[a, k] - table[a + shift, k]) <= MOST_BITS]
        a = a[np.bitwise_count(fp[a] ^ fp[a + shift]) <= MOST_BITS]
        left.append(a)
        right.append(a + shift)
    root = np.arange(n)
    if left:
        a, b = np.concatenate(left), np.concatenate(right)
        while True:
            low = np.minimum(root[a], root[b])
            new = root.copy()
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            new = new[new]
            if (new == root).all():
                break
            root = new
    return root


def _section_keys(fp: Column) -> Column:
    """One long for each pair of sections: their bits, and which pair it is."""
    bits = [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in itertools.pairwise(SECTIONS)]
    pairs = itertools.combinations(range(len(bits)), 2)
    return F.array(*(F.shiftleft(F.shiftleft(bits[i], 13).bitwiseOR(bits[j]), 4).bitwiseOR(F.lit(k)) for k, (i, j) in enumerate(pairs)))


def links(distinct: DataFrame, most_together: int = MOST_TOGETHER) -> DataFrame:
    """distinct: (fp). Returns (a, b): stars that join exactly the fingerprints that reach each other by links."""
    pivots = durable(distinct.select("fp", *pivot_columns(F.col("fp"))), "simhash-pivots")
    keyed = pivots.select("fp", *NEAR, F.explode(_section_keys(F.col("fp"))).alias("key"))
    counts = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    grouped = durable(keyed.join(counts.hint("merge"), "key"), "simhash-keys")
    salts = F.when(F.col("n") <= most_together, 1).otherwise(F.ceil(F.col("n") / (most_together // 2))).cast("long")
    own = F.pmod(F.xxhash64("fp"), F.col("salts"))
    cells = grouped.withColumn("salts", salts).withColumn("own", own)
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    cell = F.least("own", "other") * F.col("salts") + F.greatest("own", "other")
    first = F.col("near0").bitwiseAND(F.lit(0xFF))
    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cells.select("key", cell.alias("cell"), first.alias("first"), "fp", *NEAR).repartition(tasks, "key", "cell")

    def link(batches):
        held: list[pd.DataFrame] = []

        def stars(rows: pd.DataFrame) -> pd.DataFrame:
            fp = rows["fp"].to_numpy().view(np.uint64)
            change = (rows["key"].diff() != 0) | (rows["cell"].diff() != 0)
            table = rows[NEAR].to_numpy(np.int64).astype("<i8", order="C").view(np.int8).reshape(-1, PIVOTS)
            root = group_roots(change.cumsum().to_numpy(), fp, table)
            moved = np.flatnonzero(root != np.arange(len(root)))
            signed = fp.view(np.int64)
            return pd.DataFrame({"a": signed[moved], "b": signed[root[moved]]})

        for batch in batches:
            held.append(batch)
            last = batch.iloc[-1] if len(batch) else None
            if last is None:
                continue
            rows = pd.concat(held, ignore_index=True)
            open_group = (rows["key"] == last["key"]) & (rows["cell"] == last["cell"])
            if not open_group.all():
                yield stars(rows[~open_group].reset_index(drop=True))
            held = [rows[open_group]]
        if held:
            yield stars(pd.concat(held, ignore_index=True))

    return rows.sortWithinPartitions("key", "cell", "first", "fp").mapInPandas(link, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node reachable. Alternating large and small stars, each round written."""
    edges = durable(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "simhash-edges")

    def mark(df):
        mixed = [F.xxhash64(F.lit(k), "u", "v") for k in (1, 2)]
        return tuple(df.agg(F.count("*"), *(F.bit_xor(m) for m in mixed), *(F.sum(m.cast("decimal(20,0)")) for m in mixed)).first())

    now = mark(edges)
    while now[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = durable(small.distinct(), "simhash-edges")
        before, now = now, mark(edges)
        if now == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _rooted(distinct: DataFrame, most_together: int) -> DataFrame:
    """distinct: (fp, ...), each once. Adds root: the smallest fingerprint of its component."""
    rooted = components(links(distinct.select("fp"), most_together)).withColumnRenamed("node", "fp")
    return distinct.join(rooted, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, text: str = "text", most_together: int = MOST_TOGETHER) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs."""
    marked = durable(docs.select("doc_id", fingerprint(text).alias("fp")), "simhash-fingerprints")
    named = _rooted(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), most_together)
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = named.join(smallest, "root").select("fp", "component_id")
    return marked.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, text: str = "text", most_together: int = MOST_TOGETHER) -> DataFrame:
    """One row of each component: that with the smallest id, rows without an id last; of equal ids the first row.

    Rows are numbered in a written table and known by their numbers alone, so ids may be null or repeated.
    """
    row = F.monotonically_increasing_id().alias("row")
    numbered = durable(docs.select(row, fingerprint(text).alias("fp"), F.struct("*").alias("doc")), "simhash-rows", "zstd")
    order = F.struct(F.col("doc.doc_id").isNull().alias("none"), F.col("doc.doc_id").alias("doc_id"), "row")
    named = _rooted(numbered.groupBy("fp").agg(F.min(order).alias("first")), most_together)
    kept = named.groupBy("root").agg(F.min("first").alias("first")).select("first.row")
    return numbered.join(kept.hint("shuffle_hash"), "row").select("doc.*")


def deduplicated(docs: DataFrame, text: str = "text") -> DataFrame:
    """The representatives that have an id, for uses that name rows by it; representatives() loses no component."""
    return representatives(docs, text).where("doc_id is not null")
