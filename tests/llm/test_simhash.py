import re
import string
import tracemalloc

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tactus.llm import simhash

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_roots(fps):
    """Smallest position reachable."""
    root = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= 3 and root[j] < root[i]:
                    root[i], changed = root[j], True
    return root


@pytest.mark.parametrize("text", [None, "", " \n", "One", "One two", "A b c", "É É é É x", "word " * 50, "a\x0bb\xa0c d E f g"])
def test_fingerprint_equals_brute_force(text):
    assert int(simhash.fingerprints([(text or "").encode()])[0]) == brute_fingerprint(text)


@pytest.mark.parametrize("piece", [1, 5, 9, 1 << 20])
def test_pieces_give_the_same_shingles(piece):
    for text in ("", " ", "a", " a b", "a b c", "a b c d\n e  f g h i j kkkkkkkkkkkkkkkk l", "x" * 40 + " y z", "a b c d e f " * 9):
        got = np.concatenate([np.zeros(0, np.uint64), *simhash.hashes(text.encode(), piece)]).tolist()
        words = text.split()
        shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        assert got == [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]


def test_a_very_long_text_takes_little_memory():
    text = b" ".join(b"word%d" % (k % 977) for k in range(1_500_000))
    tracemalloc.start()
    long = simhash.fingerprints([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20
    assert long == simhash.fingerprints([b"x y z", text, b""])[1]


def variants(rng, n, center, most):
    out = []
    for _ in range(n):
        x = center
        for b in rng.choice(64, rng.integers(0, most + 1), replace=False):
            x ^= 1 << int(b)
        out.append(x)
    return out


def test_group_roots_equal_brute_force():
    rng = np.random.default_rng(1)
    fps = np.array(sorted(set(variants(rng, 60, 0, 7) + variants(rng, 30, 2**63 + 12345, 3))), np.uint64)
    table = np.bitwise_count(fps[:, None] ^ simhash.PIVOT_TABLE[None, :]).astype(np.int8)
    order = np.argsort(table[:, 0], kind="stable")
    fps, table = fps[order], table[order]
    got = simhash.group_roots(np.zeros(len(fps), int), fps, table)
    want = brute_roots([int(x) for x in fps])
    assert got.tolist() == want


def test_the_stored_pivot_table_holds_all_distances(spark):
    fps = np.random.default_rng(2).integers(0, 1 << 64, 50, dtype=np.uint64)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long").select("fp", *simhash.pivot_columns(F.col("fp"))).toPandas()
    table = df[simhash.NEAR].to_numpy(np.int64).astype("<i8", order="C").view(np.int8)
    assert (table == np.bitwise_count(df["fp"].to_numpy().view(np.uint64)[:, None] ^ simhash.PIVOT_TABLE[None, :])).all()


@pytest.mark.parametrize("together", [4096, 4])
def test_every_link_is_found(spark, together):
    """Links lose nothing, also when groups are cut into cells."""
    rng = np.random.default_rng(2)
    fps = [int(x) for x in rng.integers(0, 1 << 63, 40)]
    fps += [y for x in fps[:12] for y in variants(rng, 6, x, 5)] + [0, 1, 3, 7, 15, 31, 63, 2**64 - 1]
    fps = sorted(set(fps))
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, together)).collect()}
    roots = brute_roots(fps)
    groups: dict = {}
    for x, r in zip(signed, roots, strict=True):
        groups.setdefault(r, []).append(x)
    assert {x: min(g) for g in groups.values() for x in g if x != min(g)} == got


def brute(docs):
    fps = [brute_fingerprint(t) for _, t in docs]
    roots = brute_roots(fps)
    best: dict = {}
    for (d, _), r in zip(docs, roots, strict=True):
        if d is not None:
            best[r] = min(d, best.get(r, d))
    return sorted((d if d is not None else -1, f"{f:016x}", best.get(r)) for (d, _), f, r in zip(docs, fps, roots, strict=True))


def rows(spark, df):
    return sorted((r["doc_id"] if r["doc_id"] is not None else -1, f"{r['fp'] & (2**64 - 1):016x}", r["component_id"]) for r in df.collect())


def test_odd_rows(spark):
    base = " ".join(f"w{k}" for k in range(300))
    docs = [(9, None), (5, ""), (7, "one"), (8, "ONE"), (3, base), (2, base + " tail"), (4, base.upper()), (4, base.upper()), (None, base), (None, "lonely"), (11, "long " * 100_000)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, fp int")
    assert rows(spark, simhash.near_duplicates(df)) == brute(docs)
    assert simhash.near_duplicates(df.limit(0)).collect() == []
    kept = simhash.deduplicated(df).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted({c for _, _, c in brute(docs) if c is not None})


def test_query(spark):
    import __spark_entry__ as entry

    d = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = entry.queries()["op8_simhash_near_dedup"](spark, d).collect()
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == brute(docs)


def test_the_stage_keeps_one_row_of_each_component(spark):
    a, b, c, d, e = (" ".join(f"{x}{k}" for k in range(200)) for x in "abcde")
    rows = [(None, a), (None, a), (None, b), (1, b), (2, c), (2, d), (2, d), (3, d), (1, e), (None, e), (4, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for docs in (df.coalesce(1), df.repartition(3)):
        out = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()), key=str)
        assert out == sorted([(None, a), (1, b), (2, c), (2, d), (1, e), (4, None)], key=str)
