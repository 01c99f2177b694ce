import itertools
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from tactus.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed]


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
texts_of_words = st.lists(st.sampled_from(["a", "b", "é", "c#", "\n", "\n", "dd", "\x0b", "\xa0x"]), max_size=40).map(" ".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(texts_of_words, st.text(alphabet="ab \n\té", max_size=30)), min_size=1, max_size=5))
def test_measures_equal_brute_force(texts):
    got = quality.verdicts(quality.PRIOR, [t.encode() for t in texts])
    assert got[COLUMNS].values.tolist() == [brute(t) for t in texts]


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(5)
    counts = [1, 4, 3, 6]
    doc = np.repeat(np.arange(4), counts)
    features = rng.normal(size=(len(doc), len(quality.FEATURES)))
    crf = quality.Crf(tuple(rng.normal(size=features.shape[1])), tuple(map(tuple, rng.normal(size=(2, 2)))), tuple(rng.normal(size=2)))
    got = quality.decode(crf, doc, features)
    e = features @ np.array(crf.emission)
    for d, n in enumerate(counts):
        at = np.flatnonzero(doc == d)

        def score(path, at=at):
            steps = sum(crf.transition[a][b] for a, b in itertools.pairwise(path))
            return crf.start[path[0]] + steps + sum(e[i] * s for i, s in zip(at, path, strict=True))

        best = max(itertools.product((0, 1), repeat=n), key=score)
        assert got[at].astype(int).tolist() == list(best)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    even = labels.where("doc_id % 2 = 0")
    crf = quality.train(docs, even, 300)
    assert crf != quality.PRIOR
    out = docs.join(labels.where("doc_id % 2 = 1"), "doc_id").select("quality", quality.quality("text", crf)["kept"].alias("kept")).toPandas()
    good, bad = out[out.quality == 1], out[out.quality == 0]
    assert good.kept.mean() > 0.9 and bad.kept.mean() < 0.1, (good.kept.mean(), bad.kept.mean())


def slow_share(crf, text):
    """Line by line, by a table of best paths."""
    _, _, features, chars = quality.measure([text.encode()])
    best = None
    for f in features:
        content = sum(a * b for a, b in zip(f, crf.emission, strict=True))
        if best is None:
            best = {0: (crf.start[0], []), 1: (crf.start[1] + content, [])}
        else:
            # of equal ways the one from content
            to = {s: max((best[p][0] + crf.transition[p][s], p) for p in (0, 1)) for s in (0, 1)}
            best = {s: (score + content * s, [*best[p][1], p]) for s, (score, p) in to.items()}
    if best is None:
        return 0.0
    last = 1 if best[1][0] >= best[0][0] else 0
    states = [*best[last][1], last]
    return sum(c for c, s in zip(chars.tolist(), states, strict=True) if s) / max(sum(chars.tolist()), 1)


def labelled(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    crf = quality.train(docs, labels.where("doc_id % 2 = 0"), 300)
    held = docs.join(labels.where("doc_id % 2 = 1"), "doc_id").select("doc_id", "text", "quality").orderBy("doc_id").collect()
    return crf, [(r["text"], r["quality"]) for r in held]


def test_borders_of_joined_texts_are_found(spark):
    """Held-out good and bad texts, joined in either order: one change, within a line of the border."""
    crf, held = labelled(spark)
    assert crf.transition[0][0] > crf.transition[0][1] and crf.transition[1][1] > crf.transition[1][0]
    count = lambda t: sum(bool(WORD.search(x)) for x in t.split("\n"))
    good, bad = ([t for t, q in held if q == kind and count(t)] for kind in (1, 0))
    found, mixed = [], []
    for k, (a, b) in enumerate(zip(good, bad, strict=False)):
        first, second = (a, b) if k % 2 else (b, a)
        text = (first + "\n" + second).encode()
        _, doc, features, _ = quality.measure([text])
        states = quality.decode(crf, doc, features)
        changes = np.flatnonzero(states[1:] != states[:-1]) + 1
        found.append(len(changes) == 1 and abs(changes[0] - count(first)) <= 1)
        mixed.append(0 < quality.verdicts(crf, [text])["content_share"][0] < 1)
    assert len(found) > 150 and np.mean(found) >= 0.8 and np.mean(mixed) > 0.8, (np.mean(found), np.mean(mixed))


def test_kept_equals_a_slow_decoder(spark):
    crf, held = labelled(spark)
    texts = [t for t, _ in held[:300]] + ["\n".join([held[k][0], held[k + 1][0]]) for k in range(0, 300, 2)]
    got = quality.verdicts(crf, [t.encode() for t in texts])
    for t, kept, share in zip(texts, got["kept"], got["content_share"], strict=True):
        slow = slow_share(crf, t)
        assert abs(slow - share) < 1e-9 and kept == (not brute(t)[5] and slow >= quality.LEAST_SHARE)
    assert len({*got["content_share"]} - {0.0, 1.0}) > 30


def test_odd_rows(spark):
    long = " ".join(f"word{k}" for k in range(60_000))
    rows = [(1, None, 5), (2, "", 5), (3, "\n \n", 5), (4, "one two", 5), (5, long, 5), (5, long, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    out = df.select("doc_id", quality.quality("text", quality.PRIOR).alias("q")).select("doc_id", "q.*").collect()
    assert [r["kept"] for r in out] == [False] * 4 + [True] * 2
    assert [r["n_words"] for r in out] == [0, 0, 0, 2, 60_000, 60_000]
    empty = df.limit(0)
    assert empty.select(quality.quality("text", quality.PRIOR)).collect() == []
    assert quality.train(df, spark.createDataFrame([], "doc_id long, quality int")) == quality.PRIOR


def test_query(spark):
    import __spark_entry__ as entry

    d = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    out = entry.queries()["op3_quality_rules"](spark, d).collect()
    assert len(out) == len(docs)
    for r in out:
        assert [r[c] for c in COLUMNS] == brute(docs[r["doc_id"]])
        assert not (r["base_failed"] and r["kept"])


def test_training_takes_a_bounded_number_of_texts(spark, monkeypatch):
    docs = spark.range(4000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("a line\n"), "id").alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(2, "### $$$\n" * 50)], "doc_id long, text string"))
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda doc, features, label: seen.append((doc, label)) or quality.PRIOR)
    quality.train(docs, labels, 1, 7)
    doc, label = seen[0]  # the bad text, the good one, and both joined: at most seven lines each
    assert doc.tolist() == [0] * 7 + [1] * 2 + [2] * 5 and label.tolist() == [0] * 7 + [1] * 2 + [0] * 3 + [1] * 2


def test_long_texts_decode_like_short_ones(monkeypatch):
    rng = np.random.default_rng(5)
    doc = np.repeat(np.arange(6), [1, 40, 3, 90, 2, 60])
    features = rng.normal(size=(len(doc), len(quality.FEATURES)))
    together = quality.decode(quality.PRIOR, doc, features)
    monkeypatch.setattr(quality, "TOGETHER", 30)
    assert (quality.decode(quality.PRIOR, doc, features) == together).all()
    monkeypatch.setattr(quality, "TOGETHER", 0)
    assert (quality.decode(quality.PRIOR, doc, features) == together).all()
