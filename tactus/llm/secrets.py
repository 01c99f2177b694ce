"""Secret scans over a trigram inverted index.

From the parse tree of each rule's pattern a Boolean trigram query is derived: what every match must contain. A
block of texts is indexed by the trigrams that any query names (letters folded): for each trigram the sorted list
of the block's texts that hold it. A rule's query intersects and unites these postings; only the texts left over
are verified with the pattern itself. A rule without mandatory trigrams (a run of hexadecimal digits) scans all
texts. Blocks are built where the texts are, so nothing is shuffled.

Null and empty texts have no spans. Positions count code points; ends are exclusive. An input column named as the
output is replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as kinds
from re import _parser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tactus.llm.text import bounded_batches, steps, utf8


@dataclass(frozen=True)
class Rule:
    """Matches are leftmost and do not overlap; those whose group is shorter than `least` are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# The base rules, in the order in which spans at one start are listed.
BASE_RULES = (
    Rule("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),  # a match is a maximal run, so dropping the shorter ones is the same
)
# Further public token formats.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 24),
)
RULES = BASE_RULES + MORE_RULES
SPANS = "array<struct<kind:string,start:long,end:long>>"

#: Alternatives of exact strings that are followed up before a part counts as any string.
MOST_EXACT = 64
#: Members of a character class that are followed up.
MOST_CLASS = 8
#: Trigrams are indexed over ASCII letters folded to lower case.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

ANY = ("any",)


def all_of(parts: list) -> tuple:
    parts = [p for p in dict.fromkeys(parts) if p != ANY]
    return ANY if not parts else parts[0] if len(parts) == 1 else ("all", *parts)


def one_of(parts: list) -> tuple:
    parts = list(dict.fromkeys(parts))
    return ANY if ANY in parts or not parts else parts[0] if len(parts) == 1 else ("one", *parts)


def of_string(s: str) -> tuple:
    raw = s.lower().encode()
    return all_of([("has", raw[i : i + 3]) for i in range(len(raw) - 2)])


def _class_members(items) -> set[str] | None:
    out: set[str] = set()
    for op, value in items:
        if op is kinds.LITERAL:
            out.add(chr(value))
        elif op is kinds.RANGE and value[1] - value[0] < MOST_CLASS:
            out |= set(map(chr, range(value[0], value[1] + 1)))
        else:
            return None
    return out if len(out) <= MOST_CLASS else None


def _query(tree) -> tuple[set[str] | None, tuple]:
    """(the exact strings that the part matches, or None if they are too many; what they must contain)."""
    exact: set[str] | None = {""}
    whole, needs = True, []
    for op, value in tree:
        own: set[str] | None = None
        need = ANY
        if op is kinds.LITERAL:
            own = {chr(value)}
        elif op is kinds.IN:
            own = _class_members(value)
        elif op is kinds.SUBPATTERN:
            own, need = _query(value[-1])
        elif op is kinds.BRANCH:
            sides = [_query(x) for x in value[1]]
            own = set().union(*(s for s, _ in sides)) if all(s is not None for s, _ in sides) else None
            need = one_of([n if s is None else one_of([of_string(x) for x in s]) for s, n in sides])
        elif op in (kinds.MAX_REPEAT, kinds.MIN_REPEAT):
            low, high, part = value
            once, inner = _query(part)
            if once is not None and (low, high) == (0, 1):
                own = once | {""}
            elif low > 0:
                need = inner if once is None else one_of([of_string(x) for x in once])
        elif op is kinds.AT:
            own = {""}
        if own is not None and len(own) * len(exact) <= MOST_EXACT:
            exact = {a + b for a in exact for b in own}
            continue
        needs.append(one_of([of_string(x) for x in exact]))
        needs.append(need if own is None else one_of([of_string(x) for x in own]))
        exact, whole = ({""}, False) if own is None or len(own) > MOST_EXACT else (own, False)
    needs.append(one_of([of_string(x) for x in exact]))
    return (exact if whole else None), all_of(needs)


def trigram_query(pattern: str) -> tuple:
    """What a text must contain to match, folded: ("any",), ("has", trigram), ("all", ...) or ("one", ...)."""
    return _query(_parser.parse(pattern))[1]


def trigrams_of(query: tuple) -> set[bytes]:
    return {query[1]} if query[0] == "has" else set().union(*map(trigrams_of, query[1:])) if len(query) > 1 else set()


def build_postings(block: list[bytes], wanted: list[bytes]) -> dict[bytes, np.ndarray]:
    """Trigram -> sorted numbers of the block's texts that hold it, for the wanted trigrams."""
    joined = np.frombuffer(b"\0\0\0".join(block) + b"\0\0\0", np.uint8)
    ends = np.cumsum([len(t) + 3 for t in block])
    a = FOLD[joined].astype(np.uint32)
    codes = (a[:-2] << 16) | (a[1:-1] << 8) | a[2:]
    number = np.zeros(1 << 24, np.uint16)
    number[[int.from_bytes(t, "big") for t in wanted]] = np.arange(1, len(wanted) + 1)
    which = number[codes]
    at = np.flatnonzero(which)
    rows = np.searchsorted(ends, at, side="right")
    keys = np.unique(which[at].astype(np.int64) * len(block) + rows)
    trigram, row = keys // len(block) - 1, keys % len(block)
    cuts = np.searchsorted(trigram, np.arange(len(wanted) + 1))
    return {t: row[cuts[i] : cuts[i + 1]] for i, t in enumerate(wanted)}


def candidates(query: tuple, postings: dict[bytes, np.ndarray], everything: np.ndarray) -> np.ndarray:
    if query[0] == "any":
        return everything
    if query[0] == "has":
        return postings[query[1]]
    found = sorted((candidates(q, postings, everything) for q in query[1:]), key=len)
    out = found[0]
    for more in found[1:]:
        out = (np.intersect1d if query[0] == "all" else np.union1d)(out, more)
    return out


def scan_block(texts: list[str], rules: tuple[Rule, ...], queries: list[tuple]) -> list[list[tuple]]:
    """Per text (kind, start, end) by start, then in the order of the rules."""
    wanted = sorted(set().union(*map(trigrams_of, queries)))
    postings = build_postings([t.encode("utf-8", "surrogatepass") for t in texts], wanted)
    out: list[list[tuple]] = [[] for _ in texts]
    everything = np.arange(len(texts))
    for number, (rule, query) in enumerate(zip(rules, queries, strict=True)):
        pattern = re.compile(rule.pattern)
        for k in candidates(query, postings, everything):
            for m in pattern.finditer(texts[k]):
                if m.end(rule.group) - m.start(rule.group) >= rule.least:
                    out[k].append((m.start(), number, m.end()))
    return [[(rules[n].kind, start, end) for start, n, end in sorted(spans)] for spans in out]


def secret_spans(text: Column | str, rules: tuple[Rule, ...] = RULES) -> Column:
    """A column array<struct<kind, start, end>> of the secrets in each text."""
    bounded_batches()
    queries = [trigram_query(r.pattern) for r in rules]

    @F.pandas_udf(SPANS)
    def find(texts: pd.Series) -> pd.Series:
        out = []
        rest = iter(["" if t is None else t for t in texts])
        for block in steps(utf8(texts)):
            found = scan_block([next(rest) for _ in block], rules, queries)
            out += [[{"kind": k, "start": s, "end": e} for k, s, e in spans] for spans in found]
        return pd.Series(out, dtype=object)

    return find(text)


def trigram_index(df: DataFrame, key: str, text: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The postings as a table (trigram string, keys array): one row for each block and trigram that occurs."""
    bounded_batches()
    wanted = sorted(set().union(*(trigrams_of(trigram_query(r.pattern)) for r in rules)))
    kind = df.select(key).schema[0].dataType.simpleString()

    def build(batches):
        for batch in batches:
            keys, texts = batch[key].to_numpy(), utf8(batch[text])
            done = 0
            for block in steps(texts):
                own = keys[done : done + len(block)]
                done += len(block)
                rows = [(t.decode(), own[r]) for t, r in build_postings(block, wanted).items() if len(r)]
                yield pd.DataFrame(rows, columns=["trigram", "keys"])

    return df.select(key, text).mapInPandas(build, f"trigram string, keys array<{kind}>")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each span, or run of overlapping spans, replaced by the mark (code points)."""
    start = "struct('' as done, 0L as at, 0L as covered)"
    return F.aggregate(
        F.coalesce(spans, F.array().cast(SPANS)),
        F.expr(start),
        lambda acc, s: F.struct(
            F.when(
                s["start"] >= acc["covered"],
                F.concat(acc["done"], F.substring(text, acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int")), F.lit(mark)),
            )
            .otherwise(acc["done"])
            .alias("done"),
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.greatest(acc["covered"], s["end"]).alias("covered"),
        ),
        lambda acc: F.concat(acc["done"], F.substring(text, acc["at"].cast("int") + 1, F.length(text))),
    )
