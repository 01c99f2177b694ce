"""Token counts under a unigram model, by dynamic programming shared along a trie.

Each distinct pre-token (a word with the word-start mark before it) is inserted in a trie once. A node stands for a
prefix, and its forward score, the best score of any segmentation of that prefix, depends on the prefix alone: it is
computed when the node is made, from the forward scores of its ancestors, for all words that share the prefix. The pieces that end at
a node are found by walking back from it in a trie of the reversed vocabulary, which ends where no piece goes on. A word's
last node stores the number of tokens of its best segmentation. A document's count is the sum over its words.

The vocabulary is a public piece model's; a piece of rank r has the log probability of the Zipf-Mandelbrot law,
-log((r + SHIFT) * H) with H making the law sum to 1. A character that no piece covers falls back to its UTF-8 bytes,
one token each at UNKNOWN below the least score. Among equal scores the fewest tokens count.

A worker keeps its trie between tasks and begins a new one beyond `ROOM` nodes, and keeps words' counts in two generations of
about as many words; counts do not depend on that. Nothing is shuffled. Null and empty texts have 0 tokens.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tactus.llm.text import bounded_batches, steps, utf8

MARK = "▁"
SHIFT = 2.7
UNKNOWN = 10.0
ROOM = 600_000

SCHEMA = "n_pretokens long, n_tokens long"


def piece_scores(path: str) -> dict[str, float]:
    """Piece -> log probability, for the model's ordinary pieces in the order of their ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ordinary = lambda i: not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if ordinary(i)]
    total = sum(1 / (r + SHIFT) for r in range(len(pieces)))
    return {p: -math.log((r + SHIFT) * total) for r, p in enumerate(pieces)}


class Trie:
    def __init__(self, scores: dict[str, float], room: int = ROOM):
        self.ending: dict = {}  # the reversed vocabulary: by character, and under None the score of the piece that ends there
        for piece, score in scores.items():
            at = self.ending
            for ch in reversed(piece):
                at = at.setdefault(ch, {})
            at[None] = score
        self.unknown = min(scores.values()) - UNKNOWN
        self.room = room
        self.terminal: dict[bytes, int] = {}  # word -> its stored count
        self.older: dict[bytes, int] = {}
        self.clear()

    def clear(self) -> None:
        """Begin a new trie. Words' counts stay: they don't depend on it."""
        self.child: dict[int, int] = {}  # by the node's number and the character's
        self.best = [0.0]  # forward score of each node
        self.tokens = [0]  # tokens of that segmentation

    def insert(self, word: str) -> int:
        """The tokens of MARK + word; makes the nodes that are not there yet."""
        s = MARK + word
        node, path = 0, [0]
        known = self.child.get
        for end, ch in enumerate(map(ord, s), 1):
            key = node << 21 | ch
            node = known(key, -1)
            if node < 0:
                node = self.child[key] = self._extend(s, end, path)
            path.append(node)
        return self.tokens[node]

    def _extend(self, s: str, end: int, path: list[int]) -> int:
        best, tokens = self.best, self.tokens
        top, least = -math.inf, 0
        at = self.ending
        for start in range(end - 1, -1, -1):
            at = at.get(s[start])
            score = None if at is None else at.get(None)
            if score is not None:
                score += best[path[start]]
                n = 1 + tokens[path[start]]
            elif start == end - 1:  # a character that is no piece
                n = len(s[start].encode("utf-8", "surrogatepass"))
                score = n * self.unknown + best[path[start]]
                n += tokens[path[start]]
            if score is not None and (score > top or (score == top and n < least)):
                top, least = score, n
            if at is None:
                break
        best.append(top)
        tokens.append(least)
        return len(best) - 1

    def count(self, texts: list[bytes]) -> list[tuple[int, int]]:
        """(words, tokens) of each text."""
        cut = [t.split() for t in texts]
        if len(self.best) > self.room:
            self.clear()
        if len(self.terminal) > self.room:
            self.older, self.terminal = self.terminal, {}
        terminal, older = self.terminal, self.older
        for word in {w for words in cut for w in words if w not in terminal}:
            n = older.get(word)
            terminal[word] = self.insert(word.decode("utf-8", "surrogatepass")) if n is None else n
        return [(len(words), sum(map(terminal.__getitem__, words))) for words in cut]


_tries: dict[str, Trie] = {}


def token_counts(text: Column | str, path: str, room: int = ROOM) -> Column:
    """A struct column of SCHEMA for each whole text."""

    bounded_batches()
    @F.pandas_udf(SCHEMA)
    def count(texts: pd.Series) -> pd.DataFrame:
        if path not in _tries:
            _tries[path] = Trie(piece_scores(path), room)
        rows = [row for step in steps(utf8(texts)) for row in _tries[path].count(step)]
        return pd.DataFrame(rows, columns=["n_pretokens", "n_tokens"])

    return count(text)
