"""Text conventions shared by the operators: a word is a run of anything but ASCII white space."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession

#: White space that separates words, as a regular expression class body (space, tab to carriage return).
SPACE = r"\x20\x09-\x0D"

#: True for the bytes of that white space.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Texts handled together in one vectorised step, in bytes.
STEP_BYTES = 2 << 20

#: Rows that Spark hands to a Python worker at once, in bytes: long texts come few at a time.
BATCH_BYTES = 16 << 20


def bounded_batches() -> None:
    """Bound what a Python worker holds by bytes, not by a number of rows."""
    SparkSession.active().conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def utf8(texts) -> list[bytes]:
    """The texts as UTF-8, nulls as empty."""
    return [b"" if t is None or t != t else t.encode("utf-8", "surrogatepass") for t in texts]


def strings(texts) -> list[str]:
    """The texts, nulls as empty."""
    return ["" if t is None or t != t else t for t in texts]


def steps[Text: (bytes, str)](texts: list[Text], most: int = STEP_BYTES) -> Iterator[list[Text]]:
    """Consecutive lists of whole texts of about `most` bytes or characters, in order; every text is in one of them."""
    held: list[Text] = []
    size = 0
    for text in texts:
        if held and size + len(text) > most:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
