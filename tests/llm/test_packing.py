import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tactus.llm import packing, tokens

BYTE = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "a", "  a  b ", "x\n\n\ny", "it's ' s 'saint", "tab\t\t end  ", "é\xa0\xa0\nß", "a  b\x1c\x1d c", "<|endoftext|> x  <|endoftext|>y",
       "日本語 テスト", "<|ENDOFTEXT|> THE End", "J̌ ΣΑΣ İx ǅ ÀÉ SHOUT!!", "1234 56.7", "\x85z", "Á e ́x", "don't  WON'T", " 　 q"]


@pytest.mark.parametrize(("path", "piece"), [(BYTE, tokens.BYTE_PIECES), (WORDS, tokens.WORD_PIECES)], ids=["byte", "word"])
def test_cached_ids_equal_the_library(path, piece):
    library = Tokenizer.from_file(path)
    for room in (3, 10_000):
        ours = tokens.Encoder(path, piece, room)

        @settings(max_examples=80, deadline=None)
        @given(st.lists(st.one_of(st.sampled_from(ODD), st.text(max_size=30), st.lists(st.sampled_from(ODD), max_size=4).map(" ".join)), max_size=5))
        def same(texts):
            got = [np.frombuffer(x, "<u4").tolist() for x in ours.encode(texts)]  # noqa: B023
            assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]

        same()


def best_fit(counts, capacity):
    """Sequences that best-fit decreasing opens, one piece after another."""
    gaps: list[int] = []
    for length in sorted((x for x, n in counts.items() for _ in range(n)), reverse=True):
        fits = [g for g in gaps if g >= length]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - length)
        else:
            gaps.append(capacity - length)
    return len(gaps)


def check_rounds(counts, capacity):
    placed = packing.rounds(counts, capacity)
    room: dict = defaultdict(list)
    ranks: dict = defaultdict(list)
    for length, rank, n, first, offset in placed:
        ranks[length] += range(rank, rank + n)
        for s in range(first, first + n):
            room[s].append((offset, length))
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in counts.items() if n}
    for parts in room.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(room)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(0, 12), max_size=12))
def test_rounds_pack_as_well_as_best_fit_decreasing(counts):
    used = check_rounds(counts, 32)
    assert used <= best_fit(counts, 32) * 1.1 + 1


def test_rounds_are_near_the_lower_bound():
    rng = np.random.default_rng(0)
    counts = Counter(rng.integers(1, 1024, 20_000).tolist())
    used = check_rounds(dict(counts), 1024)
    assert used <= 1.01 * sum(k * n for k, n in counts.items()) / 1024


def check(docs, out):
    library = Tokenizer.from_file(BYTE)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    copies = Counter(d for d, _ in docs)
    for d, t in docs:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        lengths = packing.piece_lengths(len(ids), 1024)
        parts = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by_doc[d])
        starts = np.cumsum([0, *lengths])[:-1].tolist()
        want = [(k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(zip(starts, lengths, strict=True))]
        assert parts == sorted(want * copies[d])
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r["length"] for r in out)
    assert len(by_sequence) <= 1.05 * total / 1024 + 1


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "word " * 3000), (4, "tie"), (4, "tie"), (5, " ".join(f"w{k}" for k in range(40_000))), (6, "x " * 1023)]
    df = spark.createDataFrame([(*d, 5) for d in docs], "doc_id long, text string, offset int")
    check(docs, packing.pack_documents(df, BYTE).collect())
    assert packing.pack_documents(df.limit(0), BYTE).collect() == []
    made = packing.sequences(df, BYTE).collect()
    assert all(len(r["ids"]) == 4 * r["length"] <= 4096 for r in made)


def test_query(spark):
    import __spark_entry__ as entry

    d = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    check(docs, entry.queries()["op7_best_fit_packing"](spark, d).collect())


def test_digests_come_from_the_packed_sequences(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "word " * (k * 40 % 1500)) for k in range(40)], "doc_id long, text string")
    cut = packing.token_pieces(docs, BYTE, "<u4").collect()
    want = {(r["doc_id"], r["piece"]): zlib.crc32(r["ids"]) for r in cut}
    assert len({(r["part"], r["length"], r["nth"]) for r in cut}) == len(cut)
    assert {(r["doc_id"], r["piece"]): r["ids_crc32"] for r in packing.pack_documents(docs, BYTE).collect()} == want
    filled = packing.filled
    monkeypatch.setattr(packing, "filled", lambda pieces: filled(pieces).withColumn("ids", F.translate(F.hex("ids"), "0", "1").cast("binary")))
    spoilt = {(r["doc_id"], r["piece"]): r["ids_crc32"] for r in packing.pack_documents(docs, BYTE).collect()}
    assert not any(spoilt[k] == want[k] for k in want)


def test_both_ways_to_the_ranks_place_alike(spark, tmp_path):
    docs = spark.createDataFrame([(k, "word " * (k * 37 % 90)) for k in range(300)], "doc_id long, text string").repartition(5)
    packing.token_pieces(docs, BYTE, "<u2", capacity=64).write.parquet(str(tmp_path / "pieces"))
    pieces = spark.read.parquet(str(tmp_path / "pieces"))
    rows = lambda most: sorted(packing.packed(pieces, 64, most).drop("ids").collect())
    assert len({(r["sequence_id"], r["offset"]) for r in rows(0)}) == pieces.count()
    assert rows(0) == rows(packing.MOST_BROADCAST)


def test_ids_stay_exact_beside_a_null(spark):
    docs = [(None, "a b"), (2**53 + 1, "c d e"), (2**53 + 3, ""), (-(2**63), None), (2**63 - 1, "x " * 3000), (None, "a b")]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    check(docs, packing.pack_documents(df, BYTE).collect())


def test_other_tokenizer_files_take_the_librarys_way(spark):
    """The word tokenizer isn't the one that packing cuts texts for."""
    library = Tokenizer.from_file(WORDS)
    texts = ["It's 12.5 o'clock, <|endoftext|> İx", "", None, "THE end. of, ODD_words"]
    out = packing.pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), WORDS).collect()
    want = {k: zlib.crc32(np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")) for k, t in enumerate(texts)}
    assert {r["doc_id"]: r["ids_crc32"] for r in out} == want


@given(st.lists(st.integers(1, 200), max_size=20), st.integers(1, 40))
def test_cuts_are_the_piece_lengths(tokens, capacity):
    own, piece, start, length = (x.tolist() for x in packing.cuts(np.array(tokens, np.int64), capacity))
    want = [(d, k, n) for d, t in enumerate(tokens) for k, n in enumerate(packing.piece_lengths(t, capacity))]
    assert list(zip(own, piece, length, strict=True)) == want
    assert start == [sum(n for e, j, n in want if e == d and j < k) for d, k, _ in want]
