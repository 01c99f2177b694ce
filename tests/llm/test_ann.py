import types

import numpy as np
import pytest

from tactus.llm import ann, catalog


def brute(rows, every=50, k=5):
    """{query: [(vec_id, score)]}, nearest first: every pair."""
    known = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            known.setdefault(i, []).append(np.array(v, float))
    out = {}
    for q, vs in known.items():
        if q % every == 0:
            best = {}
            for i, ws in known.items():
                scores = [float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum()))) for a in vs for b in ws if len(a) == len(b)]
                if i != q and scores:
                    best[i] = max(scores)
            if best:
                out[q] = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
    return out


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q, rows in out.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, len(rows) + 1)), q
        assert [(-s, i) for _, i, s in rows] == sorted((-s, i) for _, i, s in rows)
    return {q: [(i, s) for _, i, s in rows] for q, rows in out.items()}


def recall(got, want):
    return np.mean([len({i for i, _ in got.get(q, [])} & {i for i, _ in top}) / len(top) for q, top in want.items()])


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_query_reaches_the_recall_and_scores_exactly(spark, size):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"/root/testdata/{size}/embeddings.parquet").collect()]
    want = brute(rows)
    out = catalog.QUERIES["op11_nearest_neighbours"](spark, f"/root/testdata/{size}")
    assert out.columns == ["query_id", "rank", "vec_id", "score"] and dict(out.dtypes)["rank"] == "int"
    got = found(out)
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    vectors = {i: np.array(v, float) for i, v in rows}
    for q, top in got.items():
        for i, s in top:
            a, b = vectors[q], vectors[i]
            assert q != i and s == pytest.approx((a @ b) / (np.linalg.norm(a) * np.linalg.norm(b)), abs=1e-14)
    assert recall(got, want) >= 0.95


def cloud(n, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(10, dim))[rng.integers(0, 10, n)] + rng.normal(size=(n, dim))


def test_many_shards_and_blocks(spark):
    rows = [(k, v.tolist()) for k, v in enumerate(cloud(3000))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    shards = ann.index(df, "vec_id", "embedding", 300)
    stored = shards.collect()
    assert len(stored) == 10 and sum(r.rows for r in stored) == 3000
    ids = np.concatenate([np.frombuffer(r.ids, np.int64) for r in stored])
    assert sorted(ids.tolist()) == list(range(3000))  # every row is indexed
    asked = ann.blocks(df.where("vec_id % 50 = 0"), "vec_id", "embedding", 7)
    assert asked.count() > 1
    assert recall(found(ann.nearest(shards, asked, 5)), brute(rows)) >= 0.97


def test_stored_graph_is_hierarchical_and_navigable():
    vectors = cloud(2000)
    row = ann.shard_row(0, 16, np.arange(2000), vectors)
    graph, *_ = ann.opened(types.SimpleNamespace(**row))
    assert len(graph.count) >= 2 and all(3 < a / b for a, b in zip(graph.count, graph.count[1:], strict=False) if b > 20)
    for level, table in enumerate(graph.links):
        assert len(table) == graph.count[level] and table.max() < graph.count[level]
        for k, near in enumerate(table.tolist()):
            near = [x for x in near if x >= 0]
            assert k not in near and len(near) == len({*near})
    reached, todo = {0}, [0]
    while todo:
        new = {int(x) for x in graph.links[0][todo.pop()] if x >= 0} - reached
        reached |= new
        todo += new
    assert len(reached) >= 0.99 * len(graph.vectors)
    again = ann.shard_row(0, 16, np.arange(2000), vectors)
    assert again == row


def test_a_third_are_copies_of_one_vector(spark):
    """Copies, scaled copies and near copies; ties go to the smaller id."""
    base = cloud(1, 16, 5)[0]
    rng = np.random.default_rng(2)
    rows = [(k, v.tolist()) for k, v in enumerate(cloud(600, 16, 3))]
    rows += [(1000 + k, base.tolist()) for k in range(400)] + [(2000 + k, (base * 2.0**k).tolist()) for k in range(40)]
    rows += [(3000 + k, (base + rng.normal(size=16) * 1e-4).tolist()) for k in range(400)]
    rng.shuffle(rows)
    rows = [(int(i), [float(x) for x in v]) for i, v in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(ann.nearest_neighbours(df, "vec_id", "embedding", df["vec_id"] % 50 == 0, 5, 400, 16))
    want = brute(rows)
    assert recall(got, want) >= 0.95
    for q in range(1000, 1400, 50):
        assert got[q] == want[q]


def test_odd_rows(spark):
    one = [1.0, 2.0, 3.0]
    rows = [(0, one), (0, one), (1, one), (1, [1.0, 2.0, 2.5]), (2, None), (3, []), (4, [0.0, 0.0, 0.0]), (5, [1.0, None, 2.0]), (6, [float("nan"), 1.0, 1.0])]
    rows += [(7, [float("inf"), 1.0, 1.0]), (None, one), (8, [-1.0, -2.0, -3.0]), (9, [1e300, 2e300, 3e300]), (10, [1e-310, 2e-310, 3e-310]), (50, [1.0, 1.0]), (11, [2.0, 2.0]), (100, None)]
    rows += [(-50, [5.0]), (2**53 + 1, [3.0, 2.0, 1.0]), (-(2**63), [3.0, 2.0, 1.5])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, shard int, id string")
    got = found(ann.nearest_neighbours(df, "vec_id", "embedding", df["vec_id"] % 50 == 0, 5))
    want = brute([(i, [x * 1e-200 for x in v] if i == 9 else [x * 1e200 for x in v] if i == 10 else v) for i, v in rows])
    assert {q: {i for i, _ in v} for q, v in got.items()} == {q: {i for i, _ in v} for q, v in want.items()}
    assert [i for i, _ in got[50]] == [11] and -50 not in got and len(got[0]) == 5


def test_empty_and_small_tables(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.nearest_neighbours(empty, "vec_id", "embedding", empty["vec_id"] % 50 == 0, 5).collect() == []
    alone = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")
    assert ann.nearest_neighbours(alone, "vec_id", "embedding", alone["vec_id"] % 50 == 0, 5).collect() == []


def test_blocks_meet_shards_by_a_shuffle_in_spans(spark):
    """Blocks times shards are many times the blocks' files: a broadcast of them would pass through the driver."""
    rows = [(k, v.tolist()) for k, v in enumerate(cloud(600, seed=3))]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    asked = ann.blocks(df.where("id % 3 = 0"), "id", "v", block_rows=10)
    assert asked.count() > 2 * ann.SPAN
    out = ann.nearest(ann.index(df, "id", "v", shard_rows=100), asked, 5)
    assert "BroadcastExchange" not in out._jdf.queryExecution().executedPlan().toString()
    got, want = found(out), brute(rows, every=3)
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values()) and recall(got, want) >= 0.95
