"""Fill-in-middle: a text is cut in three at unit borders and its parts are put in another order.

A unit is a run of ASCII letters, or any other single code point. A text is held as its maximal runs of one class
(letters or not) with the units before each of them: a run of letters is one unit, a run of others as many as it has
code points. A cut after c units is found by a binary search for the run that holds it, and its place in that run is
arithmetic. So a text costs its runs, and no unit is made an object.

Cuts, form and order come from the SHA-256 of the seed and the row's id alone, so reruns and other partitionings agree.

Forms: `plain` is the text as it is (empty, holding a mark already, or by chance), `psm` is
prefix, suffix, middle, `spm` is suffix, prefix, middle, each part behind its mark. A text with a mark is never cut, so a form
can be undone exactly.

Null texts count as empty. A null id is drawn for as the empty string. Repeated rows are cut alike. Other columns stay
in the JVM, and ids never pass through a float. Empty tables give no row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tactus.llm.text import bounded_batches, strings

# The marks of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
SEED = 1
#: Of a hundred texts, how many are cut, and how many of those begin with the suffix.
CUT_PERCENT = 90
SUFFIX_FIRST_PERCENT = 20

SCHEMA = "n long, form string, prefix_chars long, middle_chars long, output string"


class Runs:
    """Maximal runs of one class: where each starts, the units before it, and whether it is one of letters."""

    def __init__(self, text: str):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        lower = points | 0x20
        letter = (lower >= 0x61) & (lower <= 0x7A)
        starts = np.flatnonzero(letter[1:] != letter[:-1]) + 1
        self.start = np.concatenate([[0], starts, [len(points)]]) if len(points) else np.zeros(1, np.int64)
        self.letters = letter[self.start[:-1]]
        self.before = np.concatenate([[0], np.cumsum(np.where(self.letters, 1, np.diff(self.start)))])

    @property
    def units(self) -> int:
        return int(self.before[-1])

    def place(self, cut: int) -> int:
        """The code points before a cut after so many units."""
        run = int(np.searchsorted(self.before, cut, side="right")) - 1
        return int(self.start[run]) + (cut - int(self.before[run]))  # within a run of letters no cut but its start falls


def draws(key: str, seed: int = SEED) -> list[int]:
    """Four numbers of 32 bits."""
    hexed = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(hexed[8 * k : 8 * k + 8], 16) for k in range(4)]


def transformed(text: str, key: str, seed: int = SEED, cut_percent: int = CUT_PERCENT, suffix_first: int = SUFFIX_FIRST_PERCENT) -> tuple:
    """(units, form, prefix's code points, middle's code points, output) of one text."""
    runs = Runs(text)
    n = runs.units
    first, second, chance, order = draws(key, seed)
    if not n or chance % 100 >= cut_percent or any(m in text for m in MARKS):
        return n, "plain", None, None, text
    a, b = (runs.place(c) for c in sorted((first % (n + 1), second % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if order % 100 < suffix_first:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(text: Column | str, key: Column | str, seed: int = SEED, cut_percent: int = CUT_PERCENT, suffix_first: int = SUFFIX_FIRST_PERCENT) -> Column:
    """A struct column of SCHEMA: the text in the form that its key (an id) draws."""
    bounded_batches()

    @F.pandas_udf(SCHEMA)
    def form(texts: pd.Series, keys: pd.Series) -> pd.DataFrame:
        rows = [transformed(t, k, seed, cut_percent, suffix_first) for t, k in zip(strings(texts), strings(keys), strict=True)]
        out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
        return out.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    key = F.col(key) if isinstance(key, str) else key
    return form(text, key.cast("string"))


def restored(output: Column | str, form: Column | str) -> Column:
    """The text that a form was made of, from the form and its output alone."""
    output = F.col(output) if isinstance(output, str) else output
    form = F.col(form) if isinstance(form, str) else form
    parts = F.split(output, "|".join(MARKS), -1)  # begins with an empty part, for the output begins with a mark
    whole = lambda *order: F.concat(*(parts[k] for k in order))
    return F.when(form == "psm", whole(1, 3, 2)).when(form == "spm", whole(2, 3, 1)).otherwise(output)
