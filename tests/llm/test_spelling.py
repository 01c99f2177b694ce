import random
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tactus.llm import catalog, spelling

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def brute(counts, ratio=10):
    """(word, n, n_near, form, form_n, root) by wildcards: near words share a string with one place masked or left out."""
    meet = defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            meet[w[:i] + "\0" + w[i + 1 :]].add(w)
            meet[w[:i] + w[i + 1 :]].add(w)
        meet[w].add(w)
    near = defaultdict(set)
    for group in meet.values():
        for a in group:
            near[a] |= {b for b in group if one_edit(a, b)}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda b: (-counts[b], b), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, n, len(near[w]), form[w], None if form[w] is None else counts[form[w]], root(w)) for w, n in counts.items()}


def rows_of(df):
    got = [tuple(r) for r in df.select("word", "n", "n_near", "form", "form_n", "root").collect()]
    assert len(got) == len({*got})
    return {*got}


WORDS = st.lists(st.text("abé\U0001d4b3", min_size=1, max_size=9), min_size=1, max_size=40, unique=True)


@settings(max_examples=150, deadline=None)
@given(WORDS)
def test_numbers_are_a_minimal_perfect_hash(words):
    words = sorted(words)
    automaton = spelling.Automaton(words)
    length = np.array([len(w) for w in words])
    assert automaton.numbers(spelling.code_points(words, length), length).tolist() == list(range(len(words)))
    others = ["c", "abab" * 3, *(w + "c" for w in words)]
    length = np.array([len(w) for w in others])
    found = automaton.numbers(spelling.code_points(others, length), length)
    assert [w in words for w in others] == (found >= 0).tolist()
    # minimal: as many states as there are different sets of endings
    endings = {frozenset(w[k:] for w in words if w.startswith(p)) for x in words for k in range(len(x) + 1) for p in [x[:k]]}
    assert len(automaton.final) == len(endings)


@settings(max_examples=100, deadline=None)
@given(WORDS.filter(lambda ws: all(len(w) > 1 for w in ws)))
def test_each_pair_is_found_once_in_one_direction(words):
    """One automaton of each direction over all keys of the words."""
    rows = [(w, 1, b, True) for w in words for b in (len(w), len(w) - 1)]
    group = pd.DataFrame(rows, columns=["word", "n", "base", "indexed"])
    counts = Counter()
    for backward in (False, True):
        for word, n in spelling.near_in_group(group, backward)[["word", "n_near"]].itertuples(index=False):
            counts[word] += n
    # A row asks for its own base alone, so each pair is counted once from either side.
    assert dict(counts) == {w: n for w in words if (n := sum(one_edit(w, v) for v in words))}


def corpus(seed, n, alphabet="abcé", low=2, high=9):
    rng = random.Random(seed)
    words = {"".join(rng.choices(alphabet, k=rng.randint(low, high))) for _ in range(n)}
    words |= {w[:k] + w[k + 1 :] for w in list(words)[: n // 4] for k in [rng.randrange(len(w))] if len(w) > low}
    return {w: int(10 ** rng.uniform(0, 4)) for w in words}


@pytest.mark.parametrize("most", [10**6, 7])
def test_variants_equal_brute_force(spark, most):
    """With 7, most keys are dealt to several cells."""
    counts = corpus(3, 600)
    df = spark.createDataFrame([(w, c) for w, n in counts.items() for c in (n - n // 3, n // 3)], "word string, n long")
    assert rows_of(spelling.variants(df, most=most, task_rows=300)) == brute(counts)


def test_one_key_holds_a_third_of_all_words(spark):
    """All begin alike, so one forward key has them all."""
    counts = corpus(5, 200) | {"aaaaaaaa" + w: n for w, n in corpus(6, 300, "ab", 7, 8).items()}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert rows_of(spelling.variants(df, most=20)) == brute(counts)


def test_odd_words(spark):
    chain = {"a" * 7: 1, "a" * 8: 10, "a" * 9: 100, "a" * 10: 1000, "a" * 11: 10**4}
    counts = chain | {"b" * 60_000: 1, "b" * 60_001: 30, "\U0001d4b3" * 7: 5, "\U0001d4b3" * 6 + "x": 50, "tie word": 1, "tie worda": 10, "tie wordb": 10}
    rows = [*counts.items(), (None, 3), ("a" * 7, 0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "word string, n long, base string")
    got = rows_of(spelling.variants(df))
    assert got == brute(counts)
    root = {r[0]: r[5] for r in got}
    assert root["a" * 7] == "a" * 11
    assert rows_of(spelling.variants(df, least=10)) == brute({w: n for w, n in counts.items() if n >= 10})


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "word string, n long")
    assert rows_of(spelling.variants(empty)) == set()
    assert rows_of(spelling.variants(spark.createDataFrame([("a", 1)], "word string, n long"))) == {("a", 1, 0, None, None, "a")}


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query_equals_brute_force(spark, size):
    d = f"/root/testdata/{size}"
    counts = Counter()
    for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{r.doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    want = brute({w: n for w, n in counts.items() if n >= 2})
    out = catalog.QUERIES["op12_spelling_variants"](spark, d)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert rows_of(out) == want


def test_query_takes_nulls_and_odd_texts(spark, tmp_path):
    texts = [None, "", "Abcdefg ABCDEFG abcdefgh", "Àbcdefg àbcdefg", "x" * 50_000, "x" * 50_000, "abcdefg×÷ij abcdefg_abcdefg"]
    rows = [(None, t) for t in texts] + [(k, t) for k, t in enumerate(texts)] * 2
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            run = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run
            if len(run) >= 7:
                counts[run] += 1
    assert rows_of(catalog.QUERIES["op12_spelling_variants"](spark, str(tmp_path))) == brute({w: n for w, n in counts.items() if n >= 2})
