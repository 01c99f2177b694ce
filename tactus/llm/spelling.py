"""Spelling variants: words within one edit of each other, and the form that a rare one is a variant of.

Two words are near if one code point inserted, deleted or replaced makes one the other. Let B be the shorter one's length
and h half of it. Either both share their first h code points, or their last B - h. So each word is dealt out under the
beginnings and ends that it can share with a near word (four keys: both ends, as the shorter and as the longer one), and a task
holds the words of its keys in two minimal acyclic automata, one of the words and one of the reversed words. A word is
looked up by walking the shared part exactly, then completing with one error. Every edge knows how many words come
before those behind it, so the edges' sum along a walk is the word's number in code-point order, a perfect hash without a
table of words. A pair whose beginnings agree is taken from the forward automaton alone, and of a run of like code points
one place is edited, so that every pair is found once.

A key with more than `most` words is dealt to several cells: each of its words is indexed in one of them and looked up in all, so
no task grows with a key, and no pair is lost.

Null words and words shorter than 2 code points take no part in the lookup (they are returned with no near word). Repeated rows of a word count
together. An empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tactus.llm.text import bounded_batches, mix64
from tactus.session import durable

#: Rows (a word under a key) that a task takes on average, and words of one key that stay together.
TASK_ROWS = 200_000
MOST_TOGETHER = 100_000
#: How many times as frequent as a word the form must be that it is a variant of.
RATIO = 10
#: Words that are looked up together.
BLOCK = 1 << 15

NONE = np.int64(-1)


def _spans(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[k], first[k] + 1, ... for each k, count[k] of them."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + count, count)


def code_points(words: list[str], length: np.ndarray) -> np.ndarray:
    """A row for each word: its code points plus 1, padded with zeros."""
    width = max(1, int(length.max(initial=0)))
    points = np.array(words, dtype=f"U{width}").view(np.uint32).reshape(len(words), width).astype(np.int64)
    return np.where(np.arange(width) < length[:, None], points + 1, 0)


class Automaton:
    """The minimal acyclic automaton of distinct words in code-point order. A state's edges are a run of `label`, `target`, `offset`."""

    def __init__(self, words: list[str]):
        self.words = len(words)
        length = np.fromiter(map(len, words), np.int64, len(words))
        chars = code_points(words, length)
        seed = 1
        while not self._build(chars, length, seed):
            seed += 1

    def _build(self, chars: np.ndarray, length: np.ndarray, seed: int) -> bool:
        """States are the prefixes that accept the same endings, known by a 64-bit hash; False if two that differ share one."""
        width = chars.shape[1]
        shared = np.concatenate([[NONE], np.argmax(chars[1:] != chars[:-1], axis=1)])  # code points shared with the word before
        hashes, counts, finals, labels, degrees = [], [], [], [], []
        below = hashed = counted = np.zeros(0, np.uint64)
        for depth in range(width, -1, -1):
            rows = np.flatnonzero((length >= depth) & (shared < depth))  # the first word of each prefix
            start, end = np.searchsorted(below, rows), np.searchsorted(below, np.append(rows[1:], self.words))
            final = length[rows] == depth
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashed, dtype=np.uint64)])
            totals = np.concatenate([[0], np.cumsum(counted, dtype=np.int64)])
            own = mix64((sums[end] - sums[start]) + final.astype(np.uint64) + np.uint64(seed))
            count = totals[end] - totals[start] + final
            label = chars[rows, depth - 1] if depth else np.zeros(len(rows), np.int64)
            hashes.append(own)
            counts.append(count)
            finals.append(final)
            labels.append(label)
            degrees.append(end - start)
            below, hashed, counted = rows, mix64(own + mix64(label.astype(np.uint64) + np.uint64(seed << 32))), count
        hashes, counts, finals, labels, degrees = (np.concatenate(x[::-1]) for x in (hashes, counts, finals, labels, degrees))
        # Prefixes stand by depth and order, so the children of all of them follow each other behind the root.
        child = 1 + np.concatenate([[0], np.cumsum(degrees)[:-1]])
        before = np.concatenate([[0], np.cumsum(counts)])
        _, one, state = np.unique(hashes, return_index=True, return_inverse=True)
        self.degree = degrees[one]
        self.first = np.concatenate([[0], np.cumsum(self.degree)[:-1]])
        edge = _spans(child[one], self.degree)
        self.label, self.target = labels[edge], state[edge]
        self.offset = before[edge] - np.repeat(before[child[one]], self.degree) + np.repeat(finals[one], self.degree)
        self.final, self.root = finals[one], int(state[0])
        self.key = np.repeat(np.arange(len(one)), self.degree) << 21 | self.label
        return bool(np.array_equal(self.numbers(chars, length), np.arange(self.words)) and counts[0] == self.words)

    def step(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The edge that each state has for its code point, or NONE."""
        if not len(self.key):
            return np.full(len(state), NONE)
        wanted = state << 21 | char
        at = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
        return np.where(self.key[at] == wanted, at, NONE)

    def completed(self, chars: np.ndarray, length: np.ndarray, row: np.ndarray, place: np.ndarray, state: np.ndarray, number: np.ndarray):
        """Walks on exactly from each place of a row to its end: (rows, numbers) of what is accepted."""
        rows, numbers = [], []
        while len(row):
            over = place == length[row]
            accepted = over & self.final[state]
            rows.append(row[accepted])
            numbers.append(number[accepted])
            row, place, state, number = (x[~over] for x in (row, place, state, number))
            edge = self.step(state, chars[row, place])
            on = edge >= 0
            edge = edge[on]
            row, place, state, number = row[on], place[on] + 1, self.target[edge], number[on] + self.offset[edge]
        return np.concatenate([np.zeros(0, np.int64), *rows]), np.concatenate([np.zeros(0, np.int64), *numbers])

    def numbers(self, chars: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The number of each word, NONE where it is not one of the automaton's."""
        zero = np.zeros(len(length), np.int64)
        rows, found = self.completed(chars, length, np.arange(len(length)), zero, zero + self.root, zero)
        out = np.full(len(length), NONE)
        out[rows] = found
        return out

    def one_error(self, chars: np.ndarray, length: np.ndarray, exact: np.ndarray, shorter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, numbers): the words that agree with a row in its first `exact` code points and differ behind them by one edit.

        Rows for which shorter holds look for words one code point shorter, the others for words as long or one longer.
        """
        rows, numbers = [], []
        row = np.arange(len(length))
        state, number = np.full(len(row), self.root), np.zeros(len(row), np.int64)
        padded = np.concatenate([chars, np.zeros((len(chars), 1), np.int64)], axis=1)
        for place in range(int(length.max(initial=0)) + 1):
            free = place >= exact[row]
            kept = np.flatnonzero(free & ~shorter[row])
            edge = _spans(self.first[state[kept]], self.degree[state[kept]])
            source = np.repeat(kept, self.degree[state[kept]])
            other = self.label[edge] != padded[row[source], place]  # the same one may as well be put in behind
            edge, source = edge[other], source[other]
            made = row[source], self.target[edge], number[source] + self.offset[edge]
            replace = place < length[made[0]]
            gone = np.flatnonzero(free & shorter[row] & (place < length[row]))
            gone = gone[padded[row[gone], place] != padded[row[gone], np.minimum(place + 1, chars.shape[1])]]
            found = self.completed(
                chars, length,
                np.concatenate([made[0], made[0][replace], row[gone]]),
                np.concatenate([np.full(len(edge), place), np.full(int(replace.sum()) + len(gone), place + 1)]),
                np.concatenate([made[1], made[1][replace], state[gone]]),
                np.concatenate([made[2], made[2][replace], number[gone]]),
            )
            rows.append(found[0])
            numbers.append(found[1])
            on = np.flatnonzero(place < length[row])
            edge = self.step(state[on], padded[row[on], place])
            on, edge = on[edge >= 0], edge[edge >= 0]
            row, state, number = row[on], self.target[edge], number[on] + self.offset[edge]
            if not len(row):
                break
        return np.concatenate([np.zeros(0, np.int64), *rows]), np.concatenate([np.zeros(0, np.int64), *numbers])


NEAR = "word string, n_near long, best_n long, best string"


def near_in_group(group: pd.DataFrame, backward: bool) -> pd.DataFrame:
    """group (word, n, base, indexed): of its looked-up words with near indexed ones, how many, and the most frequent of them."""
    turn = (lambda w: w[::-1]) if backward else (lambda w: w)
    there = group[group["indexed"]].drop_duplicates("word")
    index = sorted(zip(map(turn, there["word"]), there["word"], there["n"], strict=True))
    if not index:
        return pd.DataFrame(columns=["word", "n_near", "best_n", "best"])
    automaton = Automaton([t for t, _, _ in index])
    words = np.array([w for _, w, _ in index], dtype=object)
    counts = np.array([n for _, _, n in index], np.int64)
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    own, base = group["word"].to_numpy(object), group["base"].to_numpy(np.int64)
    asked, found = [], []
    for low in range(0, len(own), BLOCK):
        texts = [turn(w) for w in own[low : low + BLOCK]]
        length = np.fromiter(map(len, texts), np.int64, len(texts))
        short = base[low : low + BLOCK]
        exact = short - short // 2 if backward else short // 2
        row, number = automaton.one_error(code_points(texts, length), length, exact, length > short)
        asked.append(row + low)
        found.append(number)
    asked, found = np.concatenate(asked), np.concatenate(found)
    if backward:  # what begins alike is the forward automaton's
        half = (base // 2).tolist()
        apart = [own[a][: half[a]] != words[b][: half[a]] for a, b in zip(asked.tolist(), found.tolist(), strict=True)]
        apart = np.array(apart, bool)
        asked, found = asked[apart], found[apart]
    order = np.lexsort((rank[found], -counts[found], asked))
    asked, found = asked[order], found[order]
    which, first, many = np.unique(asked, return_index=True, return_counts=True)
    best = found[first]
    return pd.DataFrame({"word": own[which], "n_near": many, "best_n": counts[best], "best": words[best]})


def keyed(words: DataFrame, most: int = MOST_TOGETHER) -> DataFrame:
    """words (word, n) under their keys: (key, cell, backward, base, word, n, indexed). cell: where rows of one key meet, 0 if they all do."""
    length = F.length("word")

    def ends(base: Column, of: str) -> list[Column]:
        half = F.floor(base / 2).cast("int")
        sides = {False: F.substring("word", F.lit(1), half), True: F.substring("word", length - (base - half) + 1, base - half)}
        return [F.struct(F.lit(b).alias("backward"), base.alias("base"), F.xxhash64(F.lit(b), base, part).alias("key")) for b, part in sides.items()]

    known = words.where(length >= 2)
    rows = known.select("word", "n", F.explode(F.array(*ends(length, "shorter"), *ends(length - 1, "longer"))).alias("k")).select("word", "n", "k.*")
    large = durable(rows.groupBy("key").agg(F.count("*").alias("_n")).where(F.col("_n") > most), "spelling-large-keys")
    if large.isEmpty():
        return rows.withColumns({"cell": F.lit(0).cast("long"), "indexed": F.lit(True)})
    cells = F.ceil(F.col("_n") / most).cast("int")
    joined = rows.join(large, "key", "left").withColumn("_cells", F.coalesce(cells, F.lit(1)))
    own = F.pmod(F.xxhash64("word"), F.col("_cells")).cast("int")
    dealt = joined.withColumns({"_own": own, "_cell": F.explode(F.sequence(F.lit(0), F.col("_cells") - 1))})
    cell = F.when(F.col("_cells") > 1, F.xxhash64("key", "_cell")).otherwise(F.lit(0).cast("long"))
    return dealt.select("key", cell.alias("cell"), "backward", "base", "word", "n", (F.col("_own") == F.col("_cell")).alias("indexed"))


def near_words(words: DataFrame, most: int = MOST_TOGETHER, task_rows: int = TASK_ROWS) -> DataFrame:
    """words: written rows (word, n), each word once. Parts (word, n_near, best_n, best) to be summed up by word."""
    bounded_batches()
    rows = keyed(words, most)
    tasks = max(1, -(-4 * words.count() // task_rows), int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        rows = pd.concat(held, ignore_index=True)
        held.clear()
        rows = rows[rows.duplicated(["key", "cell"], keep=False)]  # a word alone under its key has none near there
        size = np.frexp(rows["base"].to_numpy(np.float64))[1]  # lengths up to twice as long go together
        for (backward, _, _), group in rows.groupby([rows["backward"], rows["cell"], size], sort=False):
            yield near_in_group(group, bool(backward)).astype({"n_near": "int64", "best_n": "int64"})

    return rows.repartition(tasks, "key", "cell").mapInPandas(meet, NEAR)


def variants(words: DataFrame, ratio: int = RATIO, least: int = 1, most: int = MOST_TOGETHER, task_rows: int = TASK_ROWS) -> DataFrame:
    """words (word, n) -> (word, n, n_near, form, form_n, root).

    form: the near word of largest n (of equal ones the first in code-point order) where that is at least ratio times the
    word's own; root: where the forms end, the word itself if it has none. Rows of one word are added up; a word of fewer than
    `least` in all is left out.
    """
    summed = words.where("word is not null").groupBy("word").agg(F.sum("n").alias("n"))
    counted = durable(summed.where(F.col("n") >= least), "spelling-words")
    none = [F.lit(None).cast("long").alias("best_n"), F.lit(None).cast("string").alias("best")]
    parts = counted.select("word", "n", F.lit(0).cast("long").alias("n_near"), *none)
    parts = parts.unionByName(near_words(counted, most, task_rows), allowMissingColumns=True)
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), "best"))).alias("_best")
    met = parts.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best)
    enough = -F.col("_best.less") >= ratio * F.col("n")
    met = met.select("word", "n", "n_near", F.when(enough, F.col("_best.best")).alias("form"), F.when(enough, -F.col("_best.less")).alias("form_n"))
    met = durable(met, "spelling-forms")
    roots = roots_of(met.where("form is not null").select("word", "form"))
    return met.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def roots_of(forms: DataFrame) -> DataFrame:
    """forms (word, form) without circles -> (word, root): every round doubles how far a word has been followed."""
    reached = forms.select("word", F.col("form").alias("root"))
    while True:
        onward = reached.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        followed = durable(reached.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "spelling-roots")
        if followed.where("_moved").isEmpty():
            return followed.select("word", "root")
        reached = followed.select("word", "root")


def long_runs(text: Column | str, least: int) -> Column:
    """The maximal runs of Latin letters (A to Z and U+00C0 to U+00FF) of at least `least` code points, A to Z in small letters."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    found = F.regexp_extract_all(text, F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{least},}}"), F.lit(0))  # shorter runs match nowhere
    return F.transform(found, lambda w: F.translate(w, upper, upper.lower()))
