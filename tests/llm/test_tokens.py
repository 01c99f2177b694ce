import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tactus.llm.tokens import BYTE_PIECES, WORD_PIECES, Encoder, encoder

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
ODD = "abZéß İſΣς._,,..  \n\t\x1c\x1f\x85\xa0 　'’\"()-0²5½éẞ中"
PARTS = st.sampled_from([*ODD, "'s", "don't", "<|endoftext|>", "<|", "word", "Word", ", ", ". ", "..", "., ", "_. "])


@pytest.mark.parametrize(("path", "pieces"), [(WORDS, WORD_PIECES), (BYTES, BYTE_PIECES)])
def test_ids_equal_the_library(path, pieces):
    library = Tokenizer.from_file(path)
    ours = Encoder(path, pieces, room=20)

    @settings(max_examples=400, deadline=None)
    @given(st.lists(st.lists(PARTS, max_size=30).map("".join), max_size=4))
    def check(texts):
        for text, ids in zip(texts, ours.encode(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text

    check()


def test_workers_know_the_files(spark):
    """A worker's copy of the pieces is the driver's, so words are looked up there as well."""

    def known(batches):
        for batch in batches:
            batch["known"] = encoder(BYTES, BYTE_PIECES, 5).known and encoder(WORDS, WORD_PIECES, 5).known and not encoder(WORDS, BYTE_PIECES, 5).known
            yield batch[["known"]]

    assert [r["known"] for r in spark.range(1).mapInPandas(known, "known boolean").collect()] == [True]
