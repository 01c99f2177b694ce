import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer
from tokenizers.models import Unigram

from tactus.llm import tokencount, wavelet

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=1300), st.integers(4, 5))
def test_queries_equal_a_plain_list(ids, width):
    made = wavelet.WaveletMatrix.build(np.array(ids, np.uint32), width)
    data = wavelet.to_bytes(made, [3, None], [len(ids), 0])
    matrix, docs, lengths = wavelet.from_bytes(data)
    assert docs == [3, None] and lengths.tolist() == [len(ids), 0]
    assert matrix.decode().tolist() == ids
    some = range(0, len(ids), max(1, len(ids) // 7))
    assert [matrix.access(i) for i in some] == [ids[i] for i in some]
    for token in (0, 4, 9, 12, 99):
        places = [i for i, t in enumerate(ids) if t == token]
        assert matrix.count(token) == len(places)
        assert [matrix.rank(token, i) for i in some] == [ids[:i].count(token) for i in some]
        for k in range(0, len(places), max(1, len(places) // 5)):
            assert matrix.select(token, k) == places[k]
        with pytest.raises(IndexError):
            matrix.select(token, len(places))


def check_files(docs, out):
    library = Tokenizer.from_file(WORDS)
    want = Counter()
    for d, t in docs:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want[d, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in out) == want
    at = 0
    rows = sorted(out, key=lambda r: r["start"])
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    keys = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in rows]
    assert keys == sorted(keys)


def test_questions_read_a_part_of_the_file(monkeypatch):
    monkeypatch.setattr(wavelet, "CHUNK", 64)
    ids = np.random.default_rng(1).integers(0, 500, 20_000).astype(np.uint32)
    data = wavelet.to_bytes(wavelet.WaveletMatrix.build(ids, 9), [1], [len(ids)])
    read = []

    def part(at, n):
        read.append(n)
        return data[at : at + n]

    matrix, _, _ = wavelet.open_shard(part)
    head = sum(read)
    assert matrix.access(777) == ids[777] and matrix.count(int(ids[5]), 0, 9000) == (ids[:9000] == ids[5]).sum()
    assert matrix.select(int(ids[5]), 3) == np.flatnonzero(ids == ids[5])[3]
    assert sum(read) - head < (len(data) - head) / 20


def test_files_answer_questions(spark):
    docs = spark.createDataFrame([(k, f"text number {k} of the shard") for k in range(30)], "doc_id long, text string")
    folder = wavelet.fresh_path(spark, "questions")
    files = wavelet.write_shards(docs, WORDS, folder).collect()
    for f in files:
        whole = wavelet.from_bytes(wavelet.read_file(f["file"]))[0].decode().tolist()
        with wavelet.shard_at(f["file"]) as (matrix, ids, lengths):
            assert [matrix.access(i) for i in range(len(whole))] == whole and matrix.count(2) == len(ids) == len(lengths)


def test_files_of_odd_rows(spark):
    docs = [(5, None), (3, ""), (9, "Word two!"), (9, "Word two!"), (9, "A"), (None, "no id"), (1, "long text " * 30_000)]
    docs += [(100 + k, f"é{k} <|endoftext|> don't") for k in range(40)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, start int")
    for size in (50, 1 << 20):
        check_files(docs, wavelet.token_files(df, WORDS, shard_tokens=size).collect())
    assert wavelet.token_files(df.limit(0), WORDS).collect() == []


def test_ids_stay_exact_beside_a_null(spark):
    docs = [(None, "a b"), (2**53 + 1, "c d e"), (2**53 + 3, ""), (-(2**63), None), (2**63 - 1, "x " * 3000), (None, "a c")]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    out = wavelet.token_files(df, WORDS).collect()
    check_files(docs, out)
    assert sorted(str(r["doc_id"]) for r in out) == sorted(str(d) for d, _ in docs)


def test_file_query(spark):
    import __spark_entry__ as entry

    d = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    check_files(docs, entry.queries()["op10_token_ids"](spark, d).collect())


# --- counts


def brute_tokens(scores, word):
    """Best over all segmentations, without a trie."""
    s = tokencount.MARK + word
    unknown = min(scores.values()) - tokencount.UNKNOWN
    table = [(0.0, 0)]
    for end in range(1, len(s) + 1):
        options = []
        for start in range(end):
            if s[start:end] in scores:
                options.append((table[start][0] + scores[s[start:end]], table[start][1] + 1))
            elif start == end - 1:
                n = len(s[start].encode())
                options.append((table[start][0] + n * unknown, table[start][1] + n))
        table.append(max(options, key=lambda o: (o[0], -o[1])))
    return table[-1][1]


def test_counts_equal_brute_force_and_survive_a_small_room():
    scores = tokencount.piece_scores(PIECES)
    words = ["there", "thereof", "the", "zzzqqq", "éà", "日本語テスト", "a" * 300, "x", "😀!", "ther"]
    for room in (5, 10**6):
        trie = tokencount.Trie(scores, room)
        for _ in range(2):
            got = [trie.count([w.encode()])[0] for w in words]
            assert got == [(1, brute_tokens(scores, w)) for w in words]


def test_counts_equal_the_library():
    """A unigram model of the tokenizers library with the same pieces and scores, over words that pieces cover."""
    scores = tokencount.piece_scores(PIECES)
    vocabulary = [("<unk>", -100.0), *scores.items()]
    model = Tokenizer(Unigram(vocabulary, 0, False))
    trie = tokencount.Trie(scores)
    words = [w for w in "the quick brown fox thinks oneself entertaining unbelievably tokenization préparation straße niño".split()]
    rng = np.random.default_rng(0)
    words += ["".join(rng.choice(list("etaoinshr"), rng.integers(1, 14))) for _ in range(500)]
    assert [trie.insert(w) for w in words] == [len(model.encode("▁" + w, add_special_tokens=False).ids) for w in words]


def test_prefixes_are_scored_once():
    trie = tokencount.Trie(tokencount.piece_scores(PIECES))
    trie.insert("walking")
    nodes = len(trie.best)
    trie.insert("walked")
    assert len(trie.best) == nodes + 2


def test_count_query_and_odd_rows(spark):
    import __spark_entry__ as entry

    rows = [(1, None), (2, ""), (3, "the the\x0bthe"), (4, "word " * 100_000), (4, "word " * 100_000), (None, "the")]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, n_tokens int, c string")
    got = df.select(tokencount.token_counts("text", PIECES).alias("c")).select("c.*").collect()
    scores = tokencount.piece_scores(PIECES)
    the, long = brute_tokens(scores, "the"), (100_000, 100_000 * brute_tokens(scores, "word"))
    assert [tuple(r) for r in got] == [(0, 0), (0, 0), (3, 3 * the), long, long, (1, the)]
    assert df.limit(0).select(tokencount.token_counts("text", PIECES)).collect() == []
    d = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    known: dict = {}
    for r in entry.queries()["op9_token_counts"](spark, d).collect():
        words = [w.decode() for w in docs[r["doc_id"]].encode().split()]
        for w in words:
            if w not in known:
                known[w] = brute_tokens(scores, w)
        assert (r["n_pretokens"], r["n_tokens"]) == (len(words), sum(known[w] for w in words))
