"""Main text of web pages by wrappers: union-free regular expressions inferred for each host.

A page becomes a stream of structural tokens (opening and closing tags with their classes, and text); inline tags,
comments, scripts and styles are left out, and missing end tags are supplied. The streams of a host are aligned one
after another against its wrapper, which starts as the first of them: equal tokens agree; text against other text
becomes a slot; a run of the same element becomes a repeated group; an element that one side lacks becomes optional.
No alternatives are formed, so the wrapper stays as small as the host's template. Merging wrappers is the same
alignment, so partial wrappers of a host's pages are formed where the pages are and then merged in levels: no task
sees all pages of a host.

Texts are tokens of the alignment. A text that all pages with its place agree on is constant; it counts as part of the
template once SUPPORT pages with different texts of their own, and half of the host's pages, have it. A page is read
along the wrapper: slots and groups are taken, template text is left out, save headings, and save on pages where it
would be more than half of the text.

The region is the heaviest of the host's alternatives (elements, optional ones too, that hold most text outside links where
they stand) that the page has; of it, or where the page has none of them, its article elements, else its main elements, if they hold
half of it (one alone a quarter); else the page's own heaviest element, else its body. Navigation, asides, forms, notices, adverts and comments are known by
their tags, roles and class words, unless the host's wrapper shows that next to no text stands outside such an element, and by their
share of link text. The blocks of each page inside that region, in page order, are its text.

Null and empty pages have an empty text. Pages whose address is null or without a host form one host. Repeated rows are
pages like others.
"""

from __future__ import annotations

import bisect
import html as entities
import itertools
import json
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tactus.llm.text import bounded_batches
from tactus.session import durable

# Elements without content, elements whose content is no markup, and elements that do not part text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg iframe object textarea title".split())
INLINE = frozenset("""a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr
 math semantics annotation annotation-xml maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts none mroot mrow ms mspace
 msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover""".split())
# Which open elements a starting tag closes, up to the given borders.
CLOSES = {
    "li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)),
    "td": ("td th", ("tr",)), "th": ("td th", ("tr",)), "option": ("option", ("select",)),
}
ENDS_PARAGRAPH = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
# Elements and words of class, id or role that mark what is not the article.
BOILERPLATE_TAGS = frozenset("nav footer aside form button select input dialog menu head".split())
#: Those of them in which an article is a teaser, never the page's article.
ASIDE_TAGS = BOILERPLATE_TAGS - {"form"}
BOILERPLATE_WORDS = frozenset("""ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments
 complementary contentinfo cookie cookies disqus footer menu nav navbar navigation newsletter notice notices pagination popup
 promo promotion promoted related replies reply responses share sharing sidebar sidebars signup social sponsor sponsored subscribe toolbar widget""".split())
#: Listed words that other words are made with: commentlist, sidebarbox.
STEMS = tuple("advert banner breadcrumb comment cookie footer newsletter sidebar sponsor".split())

#: Words that say how things are, not what an element is: has-sidebar, no-comments, share-enabled, ad-free.
STATES = frozenset("has no not with without is free enabled disabled open closed on off hidden active allowed".split())
#: Where an element ends whose content is no markup and that is never closed.
BORDER = re.compile(r"</?(?:head|body|html|article|main|section|div|p|h[1-6]|ul|ol|table|nav|header|footer|aside|blockquote|pre|figure|form)\b[^<]", re.I)
#: Elements that hold no such border: one before their closing tag shows that the tag is another one's.
BORDERLESS = frozenset("svg title".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*|[^>]*)>", re.S)
SELF_CLOSED = re.compile(r"""(?:^|[\s"'])/\s*$|^[^=]*/\s*$""")
HEADING = re.compile(r"h[1-6](?:\.|$)")
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

#: Levels and width of the tree in which partial wrappers of a host meet.
FAN = 64
#: Hosts whose partial wrappers a task holds before it hands them on.
HELD_HOSTS = 2000
#: Bytes of wrappers that are broadcast at most; beyond, hosts are joined with salted pages.
BROADCAST_BYTES = 16 << 20
SALTS = 16

#: Pages with different texts that must agree on a text before it is template, and the part of the host's pages.
SUPPORT = 8
SHARE = 0.5
#: An element that holds this part of the text around it, on the pages that have it, is where the text stands.
HEAVY = 0.7
#: A region of the host's with less than this part of a page's text is not the page's.
LEAST = 0.1
#: Wrappers are this deep at most: what is below counts as text of the element there. Pages are read at any depth.
DEEPEST = 100
#: Siblings of one kind that may be parts of a layout; more are a list.
MOST_PARTS = 6
#: An element named as boilerplate outside of which a host has less than this part of its text isn't boilerplate there.
OUTSIDE = 0.2

Node = list  # [label, quantifier, children, pages, characters, characters in links, text or None, pages that agree]; texts have label #
Element = list  # [label, children, characters, characters in links, text]; texts have label #


def _label(tag: str, attributes: str) -> str:
    if "=" not in attributes:
        return tag
    words = [w for _, a, b, c in ATTRIBUTE.findall(attributes) for w in (a or b or c).lower().split()]
    return ".".join([tag, *sorted({*words})])


NUMBER = re.compile(r"\d+")


def _named(children: list[Element]) -> None:
    """Numbers in the labels of like siblings become 0, unless they tell different parts of a layout apart.

    Of siblings that differ in numbers alone (item-1 and item-2, or col-8 and col-4), those whose numbers count up one by one are
    like; others are kept apart.
    """
    kinds: dict[str, list[Element]] = {}
    for child in children:
        tag, dot, words = child[0].partition(".")
        if NUMBER.search(words):
            kinds.setdefault(tag + dot + NUMBER.sub("0", words), []).append(child)
    for folded, like in kinds.items():
        numbers = [tuple(map(int, NUMBER.findall(c[0].partition(".")[2]))) for c in like]
        apart = {y for n in zip(*numbers, strict=False) if len({*n}) > 1 for y in [all(b - a == 1 for a, b in itertools.pairwise(n))]}
        if False not in apart or len(like) > MOST_PARTS:
            for child in like:
                child[0] = folded


def tokens(page: str) -> Iterator[tuple]:
    """("open", label), ("close",), and ("text", decoded text, in a link); balanced, inline elements left out."""
    stack: list[str] = []
    link = 0
    at = 0
    n = len(page)

    def drop(names, borders) -> Iterator[tuple]:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k] in borders:
                return
            if stack[k] in names:
                while len(stack) > k:
                    stack.pop()
                    yield ("close",)
                return

    while at < n:
        m = TOKEN.search(page, at)
        end = m.start() if m else n
        if end > at:
            yield ("text", entities.unescape(page[at:end]), link > 0)
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag in RAW and not m[1]:
            if SELF_CLOSED.search(m[3]):
                continue
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if not close or (tag in BORDERLESS and "foreignobject" not in page[at : close.start()].lower()):
                border = BORDER.search(page, at, close.start() if close else n)
                at = border.start() if border else close.end() if close else n
            else:
                at = close.end()
            continue
        if tag in INLINE:
            if tag == "a":
                link = 0 if m[1] else 1
            elif tag == "br":
                yield ("text", " ", False)
            continue
        if m[1]:
            yield from drop({tag}, ())
            continue
        if tag in ENDS_PARAGRAPH:
            yield from drop({"p"}, {"td", "th", "li", "div", "article", "section", "body", "blockquote"})
        if tag in CLOSES:
            names, borders = CLOSES[tag]
            yield from drop(set(names.split()), borders)
        if tag in VOID:
            continue
        link = 0
        stack.append(tag)
        yield ("open", _label(tag, m[3]))
    for _ in stack:
        yield ("close",)


def boilerplate(label: str) -> bool:
    """By the tag, or by a word of class, id or role that has a listed word as a part, or a part that begins or ends with one, and names no state.

    This is a guess from names; whether it holds on a host is the wrapper's to say (`_spared`).
    """
    tag, *words = label.split(".")
    if tag in BOILERPLATE_TAGS or tag in ("html", "body"):
        return tag in BOILERPLATE_TAGS
    for word in words:
        parts = [p for p in re.split(r"[^a-z]+", word) if p]
        if not STATES & {*parts} and any(p in BOILERPLATE_WORDS or p.startswith(STEMS) or p.endswith(STEMS) for p in parts):
            return True
    return False


def tree(page: str) -> Element:
    """The page's elements and texts; a text runs to the next tag that is not inline."""
    root: Element = ["#page", [], 0, 0, None]
    path, held = [root], []

    def flush() -> None:
        text = " ".join("".join(t[1] for t in held).split())
        if text:
            sizes = [(len("".join(t[1].split())), t[2]) for t in held]
            path[-1][1].append(["#", [], sum(n for n, _ in sizes), sum(n for n, linked in sizes if linked), text])
        held.clear()

    for token in tokens(page):
        if token[0] == "text":
            held.append(token)
            continue
        flush()
        if token[0] == "close":
            _named(path.pop()[1])
        else:
            element: Element = [token[1], [], 0, 0, None]
            path[-1][1].append(element)
            path.append(element)
    flush()
    _named(root[1])
    return root


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


def _below(element: Element) -> Iterator[Element]:
    """Texts below an element, in page order, however deep."""
    todo = [*reversed(element[1])]
    while todo:
        child = todo.pop()
        if child[0] == "#":
            yield child
        else:
            todo += reversed(child[1])


def _texts(element: Element) -> Iterator[str]:
    return (text[4] for text in _below(element))


def skeleton(page: str | Element) -> Node:
    """The wrapper of one page."""
    root = tree(page) if isinstance(page, str) else page
    own = _hash("\n".join(sorted(_texts(root), key=lambda t: (-len(t), t))[:2]))  # copies with another date or count are one page

    def node(element: Element, depth: int) -> Node:
        text = element[0] == "#"
        inner = element[1] if depth < DEEPEST else list(_below(element))
        return [element[0], "1", [node(c, depth + 1) for c in inner], 1, element[2], element[3], _hash(element[4]) if text else None, [own] if text else []]

    return fold(node(root, 0))


def fold(node: Node) -> Node:
    """Runs of the same element become one repeated group, from the innermost outwards."""
    out: list[Node] = []
    for child in map(fold, node[2]):
        if out and out[-1][0] == child[0]:
            out[-1] = [*merged(out[-1], child)]
            out[-1][1] = "*" if "?" in (child[1], out[-1][1]) or "*" in (child[1], out[-1][1]) else "+"
            out[-1][3] = child[3]
        else:
            out.append(child)
    node[2] = out
    return node


QUANTIFIER = {(False, False): "1", (True, False): "?", (False, True): "+", (True, True): "*"}


def _either(a: str, b: str, missing: bool = False) -> str:
    return QUANTIFIER[missing or "?" in (a, b) or "*" in (a, b), "+" in (a, b) or "*" in (a, b)]


#: Pairs of children up to which a run of them is aligned by a full table.
TABLE = 40_000


def aligned(left: list[str], right: list[str]) -> list[tuple[int, int]]:
    """Pairs of places with equal labels, rising on both sides.

    Equal ends go first. What is between is a longest common subsequence up to TABLE pairs; beyond, labels that stand once
    on either side are anchors (their longest rising run), what is between anchors is aligned alike, and where there
    is no anchor each label takes its next place on the other side: n log n in all.
    """
    pairs: list[tuple[int, int]] = []
    todo = [(0, len(left), 0, len(right))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and left[i] == right[j]:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and left[m - 1] == right[n - 1]:
            m, n = m - 1, n - 1
            pairs.append((m, n))
        if i == m or j == n:
            continue
        if (m - i) * (n - j) <= TABLE:
            pairs += ((i + a, j + b) for a, b in _table(left[i:m], right[j:n]))
        elif anchors := _anchors(left, right, i, m, j, n):
            for a, b in [*anchors, (m, n)]:
                todo.append((i, a, j, b))
                i, j = a + 1, b + 1
            pairs += anchors
        else:
            places: dict[str, list[int]] = {}
            for b in range(j, n):
                places.setdefault(right[b], []).append(b)
            reach = max(16, (n - j) // max(1, m - i) * 4)
            for a in range(i, m):
                there = places.get(left[a], [])
                k = bisect.bisect_left(there, j)
                if k < len(there) and there[k] - j <= reach:  # no label far away uses up what is between
                    pairs.append((a, there[k]))
                    j = there[k] + 1
    return sorted(pairs)


def _anchors(left: list[str], right: list[str], i: int, m: int, j: int, n: int) -> list[tuple[int, int]]:
    """Labels that stand once on either side, in the longest run that rises on both."""
    once_left, once_right = Counter(left[i:m]), Counter(right[j:n])
    there = {right[b]: b for b in range(j, n) if once_right[right[b]] == 1}
    found = [(a, there[left[a]]) for a in range(i, m) if once_left[left[a]] == 1 and left[a] in there]
    ends: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for k, (_, b) in enumerate(found):
        p = bisect.bisect_left(ends, b)
        back.append(at[p - 1] if p else -1)
        ends[p : p + 1], at[p : p + 1] = [b], [k]
    run, k = [], at[-1] if at else -1
    while k >= 0:
        run.append(found[k])
        k = back[k]
    return run[::-1]


def _table(left: list[str], right: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence."""
    length = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    for i in range(len(left) - 1, -1, -1):
        for j in range(len(right) - 1, -1, -1):
            length[i][j] = length[i + 1][j + 1] + 1 if left[i] == right[j] else max(length[i + 1][j], length[i][j + 1])
    pairs = []
    i = j = 0
    while i < len(left) and j < len(right):
        if left[i] == right[j]:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        elif length[i + 1][j] >= length[i][j + 1]:
            i += 1
        else:
            j += 1
    return pairs


def merged(a: Node, b: Node) -> Node:
    """The least wrapper of both: children aligned by their labels, the rest optional."""
    left, right = a[2], b[2]
    children: list[Node] = []

    def lone(node: Node) -> Node:
        return [node[0], _either(node[1], "1", True), *node[2:]]

    i = j = 0
    for at, there in [*aligned([c[0] for c in left], [c[0] for c in right]), (len(left), len(right))]:
        children += map(lone, left[i:at])
        children += map(lone, right[j:there])
        if at < len(left):
            children.append(merged(left[at], right[there]))
        i, j = at + 1, there + 1
    # what is optional and stands beside its like is one repeated group
    grouped: list[Node] = []
    for child in children:
        if grouped and grouped[-1][0] == child[0]:
            before = grouped[-1]
            grouped[-1] = merged(before, child)
            grouped[-1][1] = "*" if "?" in before[1] + child[1] or "*" in before[1] + child[1] else "+"
        else:
            grouped.append(child)
    text = a[6] if a[6] == b[6] else None  # a text against another one: a slot from here on
    agree = sorted({*a[7], *b[7]})[:SUPPORT] if text is not None else []
    return [a[0], _either(a[1], b[1]), grouped, a[3] + b[3], a[4] + b[4], a[5] + b[5], text, agree]


def constant(node: Node) -> bool:
    """Whether enough different pages agree on the text."""
    return node[6] is not None and len(node[7]) >= SUPPORT


def pattern(node: Node) -> str:
    """The wrapper as a union-free regular expression over tags, text slots (#) and constant texts (= and their hash)."""
    if node[0] == "#":
        return f"={node[6]:x}" if constant(node) else "#"
    inner = "".join(map(pattern, node[2]))
    q = "" if node[1] == "1" else node[1]
    return inner if node[0] == "#page" else f"(<{node[0]}>{inner}</>){q}"


def _weight(node: Node, spared: set[str] = frozenset()) -> tuple[int, int]:
    """Characters, and those in links, outside what is boilerplate by name and not spared."""
    chars, links = node[4], node[5]
    for child in node[2]:
        if child[0] in spared or not boilerplate(child[0]):
            c, k = _weight(child, spared)
            chars, links = chars + c, links + k
    return chars, links


def _model(node: Node, pages: int) -> list | None:
    """[label, template text or None, children]: the part of the wrapper that knows template text; None without any."""
    if node[0] == "#":
        return ["#", node[6], []] if constant(node) and node[3] >= SHARE * pages else None
    if HEADING.match(node[0]):  # headings name the page
        return None
    inner = [_model(c, pages) for c in node[2]]
    if not any(inner):
        return None
    return [node[0], None, [m or [c[0], None, []] for c, m in zip(node[2], inner, strict=True)]]


def _alternatives(node: Node, path: list[str], spared: set[str] = frozenset()) -> list[dict]:
    """{"path": labels, "drop": labels} of the elements in which the text stands, on some pages this and on others that.

    An article, and an element with a heading of its own, is not gone into: the heading belongs to its text.
    """
    chars, links = _weight(node, spared)
    found = []
    whole = _tag(node) == "article" or any(HEADING.match(c[0]) for c in node[2])
    for c in [] if whole else node[2]:
        w = _weight(c, spared) if c[0] != "#" and (c[0] in spared or not boilerplate(c[0])) and c[1] in "1?" else (0, 0)
        if w[0] > w[1] and (w[0] - w[1]) * node[3] >= HEAVY * chars * c[3] and any(k[0] != "#" for k in c[2]):
            found += _alternatives(c, [*path, c[0]], spared)
    if found:
        return found
    drop = {c[0] for c in node[2] if c[0] != "#" and (w := _weight(c, spared))[0] and 2 * w[1] > w[0]}
    return [{"path": path, "drop": sorted(drop)}]


def _tag(node: Node | Element) -> str:
    return node[0].split(".")[0]


def _spared(wrapper: Node) -> set[str]:
    """Labels named as boilerplate in which, on this host, the text stands: outside of them there is next to none."""
    spared: set[str] = set()
    total = _all(wrapper)
    while True:
        outside = _weight(wrapper, spared)[0]
        if outside >= OUTSIDE * total:
            return spared
        named: Counter = Counter()

        def look(node: Node) -> None:
            for c in node[2]:
                if c[0] != "#":
                    if c[0] not in spared and boilerplate(c[0]) and _tag(c) not in BOILERPLATE_TAGS - {"form"}:
                        named[c[0]] += _all(c)  # noqa: B023
                    else:
                        look(c)

        look(wrapper)
        if not named or max(named.values()) <= outside:
            return spared
        spared.add(max(named, key=lambda label: (named[label], label)))


def _all(node: Node) -> int:
    """Characters outside links, and outside navigation and the like by tag."""
    return node[4] - node[5] + sum(_all(c) for c in node[2] if _tag(c) not in BOILERPLATE_TAGS - {"form"})


def region(wrapper: Node) -> dict:
    """What reading a page needs: {"paths": the alternatives, "model": the template text, "spared": what isn't boilerplate in spite of its name}."""
    spared = _spared(wrapper)
    return {"paths": _alternatives(wrapper, [], spared), "model": _model(wrapper, wrapper[3]), "spared": sorted(spared)}


def _beside(children: list[Element], model: list | None) -> list:
    """For each child its part of the model: runs of the same element against groups."""
    if not model or not model[2]:
        return [None] * len(children)
    runs = [k for k in range(len(children)) if not k or children[k][0] != children[k - 1][0]]
    known = model[2]
    out: list = [None] * len(children)
    for i, j in aligned([children[k][0] for k in runs], [m[0] for m in known]):
        end = runs[i + 1] if i + 1 < len(runs) else len(children)
        out[runs[i] : end] = [known[j]] * (end - runs[i])
    return out


def _tagged(root: Element, tag: str) -> list[list[Element]]:
    """The ways from the page to each outermost element of the tag, that element last."""
    found = []
    todo: list[tuple[Element, tuple | None]] = [(c, None) for c in reversed(root[1])]
    while todo:
        child, way = todo.pop()
        if _tag(child) == tag:
            steps = [child]
            while way:
                way, above = way
                steps.append(above)
            found.append(steps[::-1])
        elif child[0] != "#":
            todo += [(c, (way, child)) for c in reversed(child[1])]
    return found


def extract(page: str, where: dict) -> str:
    """The blocks of the page's region, one to a line, without the template's text.

    The region is the wrapper's, or of that the article or main elements if they hold most of it. Without a wrapper (an empty one) all of the page
    is its text.
    """
    root = tree(page)
    if not where.get("paths"):
        return "\n".join(_texts(root))
    known = set(where.get("spared", ()))
    spared: set[int] = set()  # the only article, else the only main element, and what is around it
    ways = {tag: _tagged(root, tag) for tag in ("article", "main")}
    for tag in ("article", "main"):
        if len(ways[tag]) == 1 and not any(_tag(e) in ASIDE_TAGS for e in ways[tag][0]):
            around = sum(len(t) for way in ways["main"] for t in _texts(way[-1]))
            if tag == "main" or 2 * sum(map(len, _texts(ways[tag][0][-1]))) >= around:  # not a lone comment in main
                spared.update(map(id, ways[tag][0]))

    def barred(element: Element) -> bool:
        return id(element) not in spared and element[0] not in known and boilerplate(element[0])

    def read(inside, drop=(), bars=barred) -> list[tuple[str, bool]]:
        """(block, whether it is the template's) of the elements for which inside holds, given the element, its depth and whether the path so far is asked for."""
        out: list[tuple[str, bool]] = []
        # (element, its part of the model, its depth, whether it is within, whether it is the region's root, whether it is on the path)
        within = inside(root, 0, True)[0]
        todo = [(root, where.get("model"), 0, within, within, True)]
        while todo:
            element, model, depth, within, at_root, on = todo.pop()
            if element[0] == "#":
                if within:
                    out.append((element[4], bool(model) and model[1] is not None and model[1] == _hash(element[4])))
                continue
            for child, part in reversed(list(zip(element[1], _beside(element[1], model), strict=True))):
                if child[0] == "#":
                    todo.append((child, part, depth + 1, within, False, False))
                elif not bars(child) and not (at_root and child[0] in drop):
                    entered, onward = (False, False) if within else inside(child, depth + 1, on)
                    todo.append((child, part, depth + 1, within or entered, entered, onward))
        return out

    def size(blocks: list[tuple[str, bool]]) -> int:
        return sum(len(text) for text, _ in blocks)

    def by_tag(tag: str):
        return lambda element, depth, on: (depth > 0 and _tag(element) == tag, True)

    def along(path: list[str]):
        def inside(element: Element, depth: int, on: bool) -> tuple[bool, bool]:
            on = on and (depth == 0 or (depth <= len(path) and element[0] == path[depth - 1]))
            return on and depth == len(path), on

        return inside

    everything = lambda element, depth, on: (True, True)
    tagged = [(read(by_tag(tag)), 4 if len(ways[tag]) == 1 else 2) for tag in ("article", "main") if ways[tag]]
    blocks = max((read(along(p["path"]), p["drop"]) for p in where["paths"]), key=size)
    if size(blocks) < LEAST * size(read(everything)):
        blocks = []
    for part, times in tagged:  # one element of the tag is the article even if it is a quarter of the wrapper's region, several may be teasers
        if part and (not blocks or times * size(part) >= size(blocks)):
            blocks = part
            break
    if not blocks:
        own = _alternatives(skeleton(root), [])
        blocks = max((read(along(p["path"]), p["drop"]) for p in own), key=size)
    if not blocks:
        blocks = read(everything, bars=lambda e: _tag(e) in BOILERPLATE_TAGS - {"form"})
    template = sum(len(text) for text, constant in blocks if constant)
    return "\n".join(text for text, constant in blocks if not constant or 2 * template > size(blocks))


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def wrappers(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, wrapper as JSON): inferred from every page of the host."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Node] = {}
        for batch in batches:
            for host, page in zip(batch["host"], batch["page"], strict=True):
                own = skeleton(page)
                held[host] = merged(held[host], own) if host in held else own
                if len(held) >= HELD_HOSTS:
                    yield rows(held)
                    held = {}
        yield rows(held)

    def rows(held: dict[str, Node]) -> pd.DataFrame:
        return pd.DataFrame([(h, json.dumps(w)) for h, w in held.items()], columns=["host", "wrapper"], dtype=object)

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        done = None
        for text in sorted(group["wrapper"]):
            done = json.loads(text) if done is None else merged(done, json.loads(text))
        return pd.DataFrame([(group["host"].iloc[0], json.dumps(done))], columns=["host", "wrapper"])

    out = pages.select(host_of(F.col(url)).alias("host"), F.coalesce(html, F.lit("")).alias("page")).mapInPandas(partial, "host string, wrapper string")
    out = out.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(FAN)))
    out = out.groupBy("host", "salt").applyInPandas(meet, "host string, wrapper string")
    return out.groupBy("host").applyInPandas(meet, "host string, wrapper string")


def main_text(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """pages with text (string): the main text of each page by its host's wrapper."""
    bounded_batches()
    columns = [c for c in pages.columns if c != "text"]
    kept = durable(wrappers(pages, url, html), "wrappers")

    @F.pandas_udf("string")
    def place(wrapper: pd.Series) -> pd.Series:
        return wrapper.map(lambda w: json.dumps(region(json.loads(w))))

    @F.pandas_udf("string")
    def read(page: pd.Series, where: pd.Series) -> pd.Series:
        known: dict[str, dict] = {}
        for w in where:
            if w not in known:
                known[w] = json.loads(w)
        return pd.Series([extract(p, known[w]) for p, w in zip(page, where, strict=True)], dtype=object)

    places = durable(kept.select("host", place("wrapper").alias("_where")), "wrapper-places")
    size = places.agg(F.sum(F.length("host") + F.length("_where")).alias("bytes")).first()["bytes"] or 0
    hosted = pages.select(F.struct(*columns).alias("page"), F.col(url).alias("url"), F.coalesce(html, F.lit("")).alias("html"), host_of(F.col(url)).alias("host"))
    if size <= BROADCAST_BYTES:
        joined = hosted.join(F.broadcast(places), "host")
    else:
        salted = places.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = hosted.withColumn("salt", F.pmod(F.xxhash64("html", "url"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"])
    return joined.select("page.*", read("html", "_where").alias("text"))
