"""Quality rules: a linear-chain conditional random field marks each line as content or boilerplate.

Each line of a text gets features (shares of symbols, capitals, digits, repeats and so on). A linear-chain CRF over
the two states is trained on labelled texts and on pairs of them, a good one and a bad one joined in either order: a line bears the
label of the text that it comes from, so the transitions learn how states run on and where they change. Viterbi decoding marks the
lines of each text one by one, and a text is kept if the content lines hold at least `least_share` of its characters in words.

Fixed rules come first: a text fails with fewer than 10 words, or if over 20 % of its words lie in 5-word windows
that it holds twice or more. Null and empty texts have no words, so they fail. Whole texts are measured.
Words and lines are compared by 64-bit hashes within one text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tactus.llm.text import IS_SPACE, bounded_batches, mix64, steps, utf8

#: Labelled texts that the model is fitted on, at most: those with the smallest hashed ids. A documented bound.
TRAIN_DOCS = 600
#: Lines of each of them. A documented bound.
TRAIN_LINES = 200
WINDOW = 5
LEAST_WORDS = 10
REPEAT_PERCENT = 20
LEAST_SHARE = 0.5
#: Steps of the fit, and how strongly the prior draws.
ROUNDS = 300
PULL = 0.0003

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, content_share double, kept boolean"
)


def _flags(characters: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(characters)] = True
    return table


SYMBOL = _flags(b"#*$%&|<>")
SHOUT = _flags(b"!?")
CAPITAL = _flags(bytes(range(65, 91)))
DIGIT = _flags(b"0123456789")
END = _flags(b".!?:;,")
CLOSE = _flags(b".!?")
#: Bytes that begin a code point.
LEAD = np.ones(256, bool)
LEAD[0x80:0xC0] = False

FEATURES = ("bias", "symbols", "shouts", "capitals", "digits", "ends", "repeated", "short", "word_length", "in_windows", "symbol_words", "begins", "closes")


@dataclass(frozen=True)
class Crf:
    """emission: weight of each feature for content against boilerplate; transition[from][to]; start. 1 is content."""

    emission: tuple[float, ...]
    transition: tuple[tuple[float, float], tuple[float, float]]
    start: tuple[float, float]


#: The prior: what the fitted weights are drawn towards, and the model where no text is labelled.
PRIOR = Crf((2.0, -12.0, -12.0, -6.0, -3.0, 0.0, -1.0, -0.2, 0.0, -2.0, -4.0, 0.0, 0.0), ((0.5, -0.5), (-0.5, 0.5)), (0.0, 0.0))


def measure(texts: list[bytes]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Of a step of texts: measures by text; and by line its text, its features and its word characters."""
    joined = b"\n".join(texts)
    a = np.frombuffer(joined + b"\n", np.uint8)
    docs = len(texts)
    line_end = np.flatnonzero(a == 10)
    line_start = np.concatenate([[0], line_end[:-1] + 1])
    text_end = np.cumsum([len(t) + 1 for t in texts]) - 1
    doc = np.searchsorted(text_end, line_end)
    lines = joined.split(b"\n")

    space = IS_SPACE[a]
    begins = ~space & np.concatenate([[True], space[:-1]])
    per_line = lambda flags: np.add.reduceat(flags.astype(np.int64), line_start)  # noqa: E731  each line ends with its \n
    per_doc = lambda counts: np.bincount(doc, counts, docs).astype(np.int64)
    chars = per_line(LEAD[a] & ~space)
    words = per_line(begins)
    symbol_words = per_line(begins & SYMBOL[a])
    # The first and the last byte of a line's words; a line without any doesn't count.
    places = np.arange(len(a))
    first = np.minimum(np.minimum.reduceat(np.where(begins, places, len(a) - 1), line_start), len(a) - 1)
    last = np.maximum.reduceat(np.where(space, 0, places), line_start)
    capital_first, closed = CAPITAL[a[first]], CLOSE[a[last]]
    symbols, shouts, capitals, digits, ends = (per_line(f[a]) for f in (SYMBOL, SHOUT, CAPITAL, DIGIT, END))

    own = np.fromiter(map(hash, lines), np.int64, len(lines)).astype(np.uint64)
    key = mix64(own + mix64(doc.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    again = np.concatenate([[False], key[order][1:] == key[order][:-1]])
    repeated = np.zeros(len(lines), bool)
    repeated[order] = again
    repeated &= words > 0

    n_words = per_doc(words)
    word_doc = np.repeat(np.arange(docs), n_words)
    tokens = joined.split()
    h = mix64(np.fromiter(map(hash, tokens), np.int64, len(tokens)).astype(np.uint64))
    covered = np.zeros(len(tokens), bool)
    if len(tokens) >= WINDOW:
        last = len(tokens) - WINDOW + 1
        window = word_doc[:last].astype(np.uint64)
        for k in range(WINDOW):
            window = mix64(window * np.uint64(0x9E3779B97F4A7C15) + h[k : last + k])
        inside = np.flatnonzero(word_doc[:last] == word_doc[WINDOW - 1 :])
        window = window[inside]
        order = np.argsort(window, kind="stable")
        same = window[order][1:] == window[order][:-1]
        twice = np.zeros(len(window), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        change = np.zeros(len(tokens) + 1, np.int64)
        np.add.at(change, inside[twice], 1)
        np.add.at(change, inside[twice] + WINDOW, -1)
        covered = np.cumsum(change[:-1]) > 0
    word_line = np.repeat(np.arange(len(lines)), words)
    in_windows = np.bincount(word_line, covered, len(lines))

    by_text = {
        "n_words": n_words,
        "word_chars": per_doc(chars),
        "n_symbols": per_doc(symbols),
        "n_dup_lines": per_doc(repeated),
        "n_repeat_words": np.bincount(word_doc, covered, docs).astype(np.int64),
    }
    some, some_words = np.maximum(chars, 1), np.maximum(words, 1)
    features = np.column_stack(
        [
            np.ones(len(lines)),
            symbols / some,
            shouts / some,
            capitals / some,
            digits / some,
            ends / some_words,
            repeated,
            words < 4,
            np.minimum(chars / some_words, 30) / 10,
            in_windows / some_words,
            symbol_words / some_words,
            capital_first,
            closed,
        ]
    )
    full = words > 0
    return by_text, doc[full], features[full], chars[full]


def _by_place(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts by falling number of lines: their first line, number of lines, and number."""
    number, first, count = np.unique(doc, return_index=True, return_counts=True)
    order = np.argsort(-count, kind="stable")
    return first[order], count[order], number[order]


#: Texts with more lines are decoded one by one.
TOGETHER = 2000


def decode(crf: Crf, doc: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Viterbi over the lines of every text; doc is sorted. True: content; ties go to content.

    Texts of up to TOGETHER lines go line place by line place at once, longer ones alone: the same steps either way.
    """
    out = np.ones(len(doc), bool)
    if not len(doc):
        return out
    emission = features @ np.array(crf.emission)
    first, count, _ = _by_place(doc)
    long = int(np.searchsorted(-count, -TOGETHER))
    for at, n in zip(first[:long].tolist(), count[:long].tolist(), strict=True):
        out[at : at + n] = _decode_one(crf, emission[at : at + n].tolist())
    first, count = first[long:], count[long:]
    if not len(first):
        return out
    to_content, to_other = np.array(crf.transition)[:, 1], np.array(crf.transition)[:, 0]
    score = np.array(crf.start) + np.column_stack([np.zeros(len(first)), emission[first]])
    back: list[np.ndarray] = []
    for t in range(1, int(count[0])):
        live = int(np.searchsorted(-count, -t))  # texts with more than t lines
        s = score[:live]
        other, content = s + to_other, s + to_content
        back.append(np.column_stack([other[:, 1] >= other[:, 0], content[:, 1] >= content[:, 0]]))
        score[:live] = np.column_stack([other.max(1), content.max(1) + emission[first[:live] + t]])
    state = (score[:, 1] >= score[:, 0]).astype(np.int64)
    out[first + count - 1] = state == 1
    for t in range(int(count[0]) - 1, 0, -1):
        live = int(np.searchsorted(-count, -t))
        state[:live] = back[t - 1][np.arange(live), state[:live]]
        out[first[:live] + t - 1] = state[:live] == 1
    return out


def _decode_one(crf: Crf, emission: list[float]) -> np.ndarray:
    (oo, oc), (co, cc) = ((float(x) for x in row) for row in crf.transition)
    other, content = float(crf.start[0]), float(crf.start[1]) + emission[0]
    back_other, back_content = bytearray(len(emission)), bytearray(len(emission))
    for t in range(1, len(emission)):
        stay, turn = other + oo, content + co
        leave, go_on = other + oc, content + cc
        back_other[t], back_content[t] = turn >= stay, go_on >= leave
        other, content = max(stay, turn), max(leave, go_on) + emission[t]
    state = content >= other
    out = bytearray(len(emission))
    for t in range(len(emission) - 1, -1, -1):
        out[t] = state
        state = back_content[t] if state else back_other[t]
    return np.frombuffer(out, np.uint8).astype(bool)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def fit(doc: np.ndarray, features: np.ndarray, label: np.ndarray, rounds: int = ROUNDS, rate: float = 0.3, pull: float = PULL) -> Crf:
    """Penalised maximum likelihood by gradient ascent with forward-backward; label: per line, 1 is content. doc is sorted.

    Both labels weigh the same in total. pull: weight of the squared distance from the prior.
    """
    prior = np.concatenate([PRIOR.emission, np.ravel(PRIOR.transition), PRIOR.start])
    if not len(doc):
        return PRIOR
    n = len(PRIOR.emission)
    first, count, _ = _by_place(doc)
    live = [int(np.searchsorted(-count, -t)) for t in range(int(count[0]))]
    mine = label == 1
    own = np.repeat(np.arange(len(first)), count)
    lines = np.concatenate([np.arange(a, a + k) for a, k in zip(first.tolist(), count.tolist(), strict=True)])
    good = np.bincount(own, mine[lines], len(first)) / count  # the share of good lines
    weight = good * 0.5 / max(good.sum(), 1e-9) + (1 - good) * 0.5 / max((1 - good).sum(), 1e-9)
    weight_line = np.zeros(len(doc))
    weight_line[lines] = (weight / count)[own]
    inside = np.flatnonzero(doc[1:] == doc[:-1])  # doc is sorted, so these lines have a next one in their text
    told = np.zeros((2, 2))
    np.add.at(told, (mine[inside].astype(int), mine[inside + 1].astype(int)), weight_line[inside])
    theta, momentum, scale = prior.copy(), np.zeros(n + 6), np.zeros(n + 6)
    for step in range(1, rounds + 1):
        emission = features @ theta[:n]
        trans, start = theta[n : n + 4].reshape(2, 2), theta[n + 4 :]
        both = lambda at: np.column_stack([np.zeros(len(at)), emission[at]])
        alpha = [start + both(first)]
        for t in range(1, len(live)):
            at = first[: live[t]] + t
            alpha.append(_log_sum(alpha[-1][: live[t], :, None] + trans, 1) + both(at))
        beta = np.zeros((len(first), 2))
        expected, steps_seen = np.zeros(len(doc)), np.zeros((2, 2))
        for t in range(len(live) - 1, -1, -1):
            k = live[t]
            post = alpha[t] + beta[:k]
            total = _log_sum(post, 1)
            expected[first[:k] + t] = np.exp(post[:, 1] - total)
            if t:
                at = first[:k] + t
                onward = both(at) + beta[:k]
                pair = np.exp(alpha[t - 1][:k, :, None] + trans + onward[:, None, :] - total[:, None, None])
                steps_seen += (pair * (weight / count)[:k, None, None]).sum(0)
                beta[:k] = _log_sum(trans + onward[:, None, :], 2)
        gap = (mine - expected) * weight_line
        initial = ((mine[first] - expected[first]) * weight / count).sum()
        gradient = np.concatenate([features.T @ gap, (told - steps_seen).ravel(), [-initial, initial]]) - pull * (theta - prior)
        momentum = 0.9 * momentum + 0.1 * gradient
        scale = 0.99 * scale + 0.01 * gradient**2
        theta = theta + rate * (momentum / (1 - 0.9**step)) / (np.sqrt(scale / (1 - 0.99**step)) + 1e-8)
    trans = theta[n : n + 4].reshape(2, 2)
    return Crf(tuple(theta[:n]), tuple(map(tuple, trans)), tuple(theta[n + 4 :]))


def train(documents: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS, most_lines: int = TRAIN_LINES) -> Crf:
    """A CRF fitted on at most `most` labelled texts of each kind: those with the smallest hashed ids.

    The texts count each alone and as pairs of a good and a bad one. Of rows that share an id one text counts. Of a long text a run
    of most_lines lines counts, from a hashed line on.
    """
    known = labels.select("doc_id", F.col("quality").cast("int").alias("good")).where("good is not null and doc_id is not null").distinct()
    kinds = [known.where(F.col("good") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for k in (1, 0)]
    rows = documents.select("doc_id", "text").join(F.broadcast(kinds[0].unionByName(kinds[1])), "doc_id")
    one = rows.groupBy("good", "doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # at most twice `most` rows
    sample = sorted(one.collect(), key=lambda r: (r["good"], r["doc_id"]))
    if len({r["good"] for r in sample}) < 2:
        return PRIOR
    texts = utf8([r["text"] for r in sample])
    good = [r["good"] for r in sample]
    full = [sum(map(bool, map(bytes.split, t.split(b"\n")))) for t in texts]  # lines with words
    doc, features, label = [], [], []
    for number, parts in enumerate([*((k,) for k in range(len(texts))), *joined(good)]):
        whole, at = measure([b"\n".join(texts[k] for k in parts)])[2], 0
        for side, k in enumerate(parts):
            room = most_lines // len(parts)
            low = 0
            if full[k] > room:  # of a pair's texts the lines next to the border
                hashed = int(mix64(np.array([full[k] + k]))[0] % np.uint64(full[k] - room + 1))
                low = hashed if len(parts) == 1 else full[k] - room if side == 0 else 0
            n = min(full[k] - low, room)
            features.append(whole[at + low : at + low + n])
            label.append(np.full(n, good[k]))
            doc.append(np.full(n, number))
            at += full[k]
    return fit(*map(np.concatenate, (doc, features, label)))


def joined(good: list[int]) -> list[tuple[int, int]]:
    """Pairs of a good and a bad text, each text in one at most, in either order by turns."""
    pairs = zip((k for k, g in enumerate(good) if g), (k for k, g in enumerate(good) if not g), strict=False)
    return [pair if turn % 2 else pair[::-1] for turn, pair in enumerate(pairs)]


def verdicts(crf: Crf, texts: list[bytes], least_share: float = LEAST_SHARE) -> pd.DataFrame:
    by_text, doc, features, chars = measure(texts)
    content = decode(crf, doc, features)
    total = np.maximum(by_text["word_chars"], 1)
    share = np.bincount(doc, chars * content, len(texts)) / total
    n = by_text["n_words"]
    failed = (n < LEAST_WORDS) | (100 * by_text["n_repeat_words"] > REPEAT_PERCENT * n)
    return pd.DataFrame(by_text | {"base_failed": failed, "content_share": share, "kept": ~failed & (share >= least_share)})


def quality(text: Column | str, crf: Crf, least_share: float = LEAST_SHARE) -> Column:
    """A struct column of SCHEMA for each text."""

    bounded_batches()
    @F.pandas_udf(SCHEMA)
    def judge(texts: pd.Series) -> pd.DataFrame:
        parts = [verdicts(crf, step, least_share) for step in steps(utf8(texts))]
        return pd.concat(parts, ignore_index=True) if parts else verdicts(crf, [b""], least_share)[:0]

    return judge(text)
