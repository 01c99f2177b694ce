"""Token ids by the tokenizers library, each distinct piece of text encoded once in a while.

Both tokenizers cut a text at white space, and between letters and what follows them, before they merge anything; so
the ids of a text are those of such pieces one after another. A worker keeps the ids of the pieces it has met in two
generations of bounded size: the older one goes when the younger is full. Of the pieces not met yet, a word of small
letters is one pre-token whatever the tokenizer's first steps are, so the library's model merges it at once, in its
byte alphabet; all others take the library's whole way. None of this changes any id, only what the library is asked.

That holds for the tokenizers it was made for, known by their files' SHA-256. Any other file's texts take the library's whole way.
"""

from __future__ import annotations

import array
import hashlib
import os
import re
from collections.abc import Callable
from dataclasses import dataclass, field

# White space as Unicode has it, and letters (the Latin ranges up to U+024F, but for U+0130,
# which is a letter and a combining dot in lower case).
SPACES = "\t\n\x0b\x0c\r \x85\xa0  -     　"
LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
ENDS = r"(?![^ ,.\n])"
#: Pieces that a generation holds.
ROOM = 400_000
#: A mark that ends a clause behind a letter or digit is a pre-token of its own.
MARK = re.compile(f"[,.](?<=[{LETTERS}0-9].)(?![^ \n])").sub
#: White space for str.split, but not for the tokenizers.
SEPARATORS = "\x1c\x1d\x1e\x1f"
#: Byte-level: the last space before a word belongs to it, and its first token begins with that space.
cut_bytes = re.compile(f" ?[{LETTERS}]++{ENDS}|[{SPACES}]*[^{SPACES}]+|[{SPACES}]+").findall
cut_at_spaces = re.compile(f"[^{SPACES}]+").findall


def cut_words(text: str) -> list[str]:
    """White space is dropped; the last token of a word is marked as its end."""
    marked = MARK(" \\g<0>", text)
    if any(c in text for c in SEPARATORS):
        return cut_at_spaces(marked)
    return marked.split()


@dataclass(frozen=True)
class Pieces:
    """How a tokenizer's texts are cut. space: what goes before a word of letters that is a piece of its own."""

    name: str
    cut: Callable[[str], list[str]] = field(compare=False)  # a worker's copy isn't the driver's
    space: str
    folds: bool = False  # the tokenizer lower-cases, so a piece may be looked up in lower case


BYTE_PIECES = Pieces("bytes", cut_bytes, " ")
WORD_PIECES = Pieces("words", cut_words, "", True)
# The tokenizers' files.
FILES = {
    "cec27cb89f428497695f4e2a90118d636a594654897a44c0fb11b8f185521820": BYTE_PIECES,
    "53fa9d558ea625daafcd57cd61e7be7b3c7043ea584b22d09575cf5ea9131b0a": WORD_PIECES,
}
#: Texts of these characters alone have the same ids in lower case: none of them composes or has special cases.
PLAIN = re.compile("[\0-\u024f]*+\\Z").match
#: The byte alphabet of byte-level models: printable Latin-1 stands for itself, the other bytes for U+0100 onwards in order.
SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTES = {b: 0x100 + k for k, b in enumerate(b for b in range(0x100) if b not in SHOWN)}

_encoders: dict[tuple[str, Pieces, int], Encoder] = {}


class Encoder:
    """Ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, pieces: Pieces, room: int = ROOM):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, "rb") as f:
            self.known = FILES.get(hashlib.file_digest(f, "sha256").hexdigest()) == pieces
        self.cut = pieces.cut
        self.word = re.compile(f"{pieces.space}[{LETTERS}]+\\Z").match
        self.space = pieces.space
        self.folds = pieces.folds
        self.room = room
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.width = (max(self.tokenizer.get_vocab().values())).bit_length()

    def _fresh(self, pieces: list[str]) -> None:
        skip = len(self.space)
        lead = self.space.translate(BYTES)
        merge = self.tokenizer.model.tokenize
        rest: list[str] = []
        for p in pieces:
            if self.word(p) and (not self.folds or p == p.lower()):
                shown = lead + p[skip:] if p.isascii() else p.encode().decode("latin-1").translate(BYTES)
                self.young[p] = array.array("I", [t.id for t in merge(shown)]).tobytes()
            else:
                rest.append(p)
        for p, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            self.young[p] = array.array("I", e.ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        if not self.known:
            return [array.array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        if self.folds:
            texts = [t.lower() if (t.isascii() or PLAIN(t)) and "<|" not in t else t for t in texts]  # special tokens keep their case
        cut = [self.cut(t) for t in texts]
        found = [list(map(self.young.get, pieces)) for pieces in cut]  # one look at the large table for each piece
        gaps = [[i for i, ids in enumerate(row) if ids is None] if None in row else [] for row in found]
        unknown = {pieces[i] for pieces, gap in zip(cut, gaps, strict=True) for i in gap}
        if len(self.young) + len(unknown) > self.room:
            self.old, self.young = self.young, {}
        fresh = []
        for p in unknown:
            ids = self.old.get(p)
            if ids is None:
                fresh.append(p)
            else:
                self.young[p] = ids
        self._fresh(fresh)
        for pieces, row, gap in zip(cut, found, gaps, strict=True):
            for i in gap:
                row[i] = self.young[pieces[i]]
        return [b"".join(row) for row in found]


def encoder(path: str, pieces: Pieces, room: int = ROOM) -> Encoder:
    """This worker's encoder."""
    key = (path, pieces, room)
    if key not in _encoders:
        _encoders[key] = Encoder(path, pieces, room)
    return _encoders[key]
