from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tactus.llm import mixing
from tactus.session import durable


@pytest.mark.parametrize("n", [1, 2, 3, 7, 10, 63, 1000])
def test_permutation_is_a_bijection(spark, n):
    for key in (1, 2):
        x = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(key)).alias("x"))
        assert sorted(r["x"] for r in x.collect()) == list(range(n))


def test_permutation_looks_random(spark):
    n = 2000
    x = [r["x"] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5)).alias("x")).collect()]
    assert sum(abs(a - b) == 1 for a, b in zip(x, x[1:], strict=False)) < 15
    mean = sum(abs(a - b) for a, b in zip(x, x[1:], strict=False)) / (n - 1)
    assert abs(mean - n / 3) < n / 20


def targets(sizes):
    """Brute force: share, stop at three times, share again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode())
    names += [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    full, out = set(), {}
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        open_weight = sum(weight[s] for s in names if s not in full)
        out = {s: 3 * sizes[s] if s in full else rest * weight[s] / open_weight for s in names}
        over = {s for s in names if s not in full and out[s] > 3 * sizes[s]}
        if not over:
            return out
        full |= over


def check(docs, rows):
    """docs: (doc_id, source, text)."""
    size = {d: len((t or "").encode().split()) for d, _, t in docs}
    by_source = defaultdict(int)
    for d, s, _ in docs:
        by_source[s] += size[d]
    want = targets(by_source)
    source = {d: s for d, s, _ in docs}
    taken = defaultdict(int)
    assert Counter(r["doc_id"] for r in rows) == Counter(d for d, _, _ in docs)
    for r in rows:
        s = source[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == by_source[s]
        assert abs(r["target"] - want[s]) < 1e-6 * max(1, want[s])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s in want:
        assert abs(taken[s] - want[s]) <= 2 * mixing.BLOCK_WORDS, (s, taken[s], want[s])


def test_report_over_odd_rows(spark):
    docs = [(1, None, "a b"), (2, "b", None), (3, "b", ""), (4, "é", "x " * 900), (5, "a", "w\x0b" * 3000), (6, "z", "t " * 50)]
    docs += [(100 + k, "b", "v\n" * (k % 90)) for k in range(60)]
    df = spark.createDataFrame([(*d, 7) for d in docs], "doc_id long, source string, text string, size int")
    rows = mixing.mix_report(df).collect()
    check(docs, rows)
    again = mixing.mix_report(df.repartition(3)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    assert mixing.mix_report(df.limit(0)).collect() == []
    assert [r["taken"] for r in mixing.mix_report(df.where("doc_id = 2")).collect()] == [0]


def test_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a", "x y z " * 100)] * 5 + [(2, "b", "k " * 700)], "doc_id long, source string, text string")
    rows = mixing.mix_report(df).collect()
    assert len(rows) == 6 and all(r["taken"] <= 3 * r["size"] for r in rows)


def test_rows_repeated_very_often_are_parted(spark):
    docs = [(1, "a", "x y z " * 30)] * 200 + [(1, "a", "other " * 40)] * 3 + [(None, None, "k " * 70)] * 90 + [(k, "b", f"v{k} " * (k % 50)) for k in range(100)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    rows = mixing._rows(df, "text")
    numbers, parts = mixing._buckets(rows.select("row", "doc.doc_id", "doc.source", "size", "mark"), 32)
    assert numbers.groupBy("source", *parts).count().agg(F.max("count")).first()[0] <= 60
    report = lambda d: Counter(map(tuple, mixing.mix_report(d).collect()))
    whole = mixing.BUCKET_ROWS
    try:
        mixing.mix_pieces.__defaults__ = (*mixing.mix_pieces.__defaults__[:-1], 32)
        found = report(df)
        assert found == report(df.repartition(5))
    finally:
        mixing.mix_pieces.__defaults__ = (*mixing.mix_pieces.__defaults__[:-1], whole)
    assert sum(found.values()) == len(docs) and all(r[4] <= 3 * r[1] for r in found)
    for size, target in {(r[2], r[3]) for r in found}:
        assert abs(sum(r[4] * n for r, n in found.items() if r[2] == size) - target) <= 2 * mixing.BLOCK_WORDS


def test_clashing_names_stay(spark):
    df = spark.createDataFrame([(1, "a", "x y " * 90, [5], 6, "s", 7)], "doc_id long, source string, text string, _own array<int>, row int, _mixed string, turn int")
    out = mixing.mix_documents(df)
    assert out.dtypes == df.dtypes and [tuple(r)[3:] for r in out.collect()] == [([5], 6, "s", 7)]


def test_mixed_documents_hold_the_words_taken(spark):
    docs = [(k, "abc"[k % 3], " ".join(f"d{k}w{j}" for j in range(20 + 13 * k)) + "\n") for k in range(30)]
    df = spark.createDataFrame([(d, s, t, len(t)) for d, s, t in docs], "doc_id long, source string, text string, n_chars long")
    report = {r["doc_id"]: r for r in mixing.mix_report(df).collect()}
    words = Counter()
    per_word = Counter()
    for r in mixing.mix_documents(df).collect():
        assert r["n_chars"] == len(r["text"])
        tokens = r["text"].split()
        words[r["doc_id"]] += len(tokens)
        per_word.update(tokens)
        assert all(t.startswith(f"d{r['doc_id']}w") for t in tokens)
    assert all(words[d] == report[d]["taken"] for d in report)
    assert max(per_word.values()) <= 3


def test_draws_sum_to_the_quotas_and_vary_by_shard(spark):
    plan = mixing.source_plan(spark.createDataFrame([("a", 64_000), ("b", 64_000), ("c", 64_000)], "source string, source_size long"))
    plan = durable(plan, "plan")
    draws = mixing.dealt_slots(plan, 3, 100).groupBy("rank", "shard").agg(F.count("*").alias("drawn")).toPandas()
    quota = {r["rank"]: r["quota"] for r in plan.collect()}
    assert draws.groupby("rank").drawn.sum().to_dict() == quota
    whole = draws.groupby("shard").drawn.sum()
    assert set(whole[:-1]) == {100}
    first = draws[draws["rank"] == 0].drawn
    p = quota[0] / sum(quota.values())
    assert 0.4 < first.var() / (100 * p * (1 - p)) < 2.0


def test_query(spark):
    import __spark_entry__ as entry

    d = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["source"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    check(docs, entry.queries()["op5_mixing"](spark, d).collect())


def test_the_mix_holds_its_shards_slots_and_words(spark):
    docs = [(k, "abc"[k % 3], " \n" * (k % 2) + "  ".join(f"d{k}w{j}" for j in range(15 + 31 * k)) + "\n") for k in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    wide = mixing._rows(df, "text")
    plan, mixed = mixing.mix_pieces(wide, shard_blocks=32)
    text = {r["row"]: r["doc"]["text"] for r in wide.collect()}
    quota, slots = {r["rank"]: r["quota"] for r in plan.collect()}, mixing.slots_of(mixed).collect()
    assert sorted((r["shard"], r["slot"]) for r in slots) == [(k // 32, k % 32) for k in range(sum(quota.values()))]
    assert Counter(r["rank"] for r in slots) == quota
    for r in slots:
        assert "abc"[r["rank"]] == r["source"] and 1 <= sum(p["piece_words"] for p in r["pieces"]) <= mixing.BLOCK_WORDS
        for p in r["pieces"]:
            assert p["words"] in text[p["row"]]
            assert p["words"].split() == text[p["row"]].split()[p["piece_from"] :][: p["piece_words"]]
    in_order = [(r["rank"], r["block"]) for r in sorted(slots, key=lambda r: (r["shard"], r["slot"]))]
    for rank, n in quota.items():
        blocks = {r["block"] for r in slots if r["rank"] == rank}
        own = [b for k, b in in_order if k == rank]
        assert len(set(own[: len(blocks)])) == min(n, len(blocks))  # none twice before all have come
    other = mixing.slots_of(mixing.mix_pieces(wide, seed=12, shard_blocks=32)[1]).collect()
    assert {(r["shard"], r["slot"], r["rank"], r["block"]) for r in other} != {(r["shard"], r["slot"], r["rank"], r["block"]) for r in slots}
    counted = Counter()
    for r in mixing.mix(df).collect():
        counted.update(w.split("w")[0] for p in r["pieces"] for w in p["words"].split())
    assert {f"d{r['doc_id']}": r["taken"] for r in mixing.mix_report(df).collect() if r["taken"]} == counted
    whole = {(d, t) for d, _, t in docs}
    assert any((r["doc_id"], r["text"]) in whole for r in mixing.mix_documents(df).collect())
