"""Main text of web pages by wrappers: union-free regular expressions inferred per host.

A page becomes a tree of block elements with text slots; inline tags, comments, scripts and
styles leave no trace in it. Its structure is a nested pattern of items with a multiplicity:
``1``, ``?`` optional, ``+`` repeated, ``*`` both. Neighbouring repeats (of one element, or of a
run of several) fold into a repeated group. Pages of one host are aligned one after the other:
where two item sequences differ, what only one of them has becomes optional, what one has
repeatedly becomes repeated, and texts are slots. The result, free of alternatives, is the host's
wrapper.

Equal structures are one row per host before any alignment, and the distinct ones are folded in
groups of bounded size, then the groups' wrappers again, so a host with a third of all pages, or
with very many layouts, never meets in one task. On the wrapper each item is marked once as part
of the article or not; a page is aligned to its host's wrapper and keeps the texts whose items
are marked.
"""

from __future__ import annotations

import html
import json
import math
import re
import sys
from bisect import bisect_left
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialise, quoted
from quarry.llm.url_filter import host_of

GROUP = 256           # structures or partial wrappers aligned in one task at a time
MAX_RUN = 6           # elements of a repeated run
MAX_DEPTH = 256       # elements nested deeper are siblings at this depth, as in browsers; their texts stay blocks

sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))  # patterns are walked to the depth of their pages

# What HTML makes of its elements.
RAW = {"script", "style", "textarea", "title", "template", "iframe", "select"}
CODE = {"script", "style"}  # of the raw ones, those that go on to the end of the page if nothing ends them
FOREIGN = {"svg", "math"}   # their own elements leave no trace, up to a tag of these:
BREAKS_OUT = {"address", "article", "aside", "blockquote", "body", "center", "dd", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1",
              "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "td", "th", "tr", "ul"}
NOT_SHOWN = {"annotation", "annotation-xml", "desc", "metadata"}  # in foreign elements
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark",
          "q", "ruby", "rp", "rt", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var",
          "noscript", "object", "video", "audio", "canvas"}
SPACES = {"br", "td", "th", "wbr"}
TRANSPARENT = {"td", "th", "tbody", "thead", "tfoot"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}}
DROPPED = {"head", "nav", "header", "footer", "aside", "form", "button", "dialog", "menu", "fieldset"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

# Names, as class, id or role, of what is not the article and of what holds it.
NOT_ARTICLE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notices?|gdpr|popup|modal|overlay|menu\w*|nav\w*|breadcrumbs?|"
    r"sidebars?|aside|footer|header|masthead|comments?|disqus|replies|respond|related|recommend\w*|share\w*|sharing|social|newsletter|subscribe|"
    r"signup|login|search|widgets?|pagination|pager|toolbar|skip|alert|complementary|contentinfo|dialog|toc|tags?)(?:$|[\s_-])", re.I)
ARTICLE = re.compile(r"(?:^|[\s_-])(?:article\w*|post|entry|story|content|main|body-text|articlebody)(?:$|[\s_-])", re.I)

_TAG = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?|<([a-zA-Z])", re.S)
_NAME_END = re.compile(r"[\s/>]")
_SPECIAL = re.compile("[>\"']")
_END_TAGS = {t: re.compile(rf"</{t}\b[^>]*>?", re.I) for t in RAW | NOT_SHOWN}
_NAMES = re.compile(r"(?:^|\s)(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


# --- pages as trees -----------------------------------------------------------------------------

class Node:
    """A block element: ``key`` is its tag, with its names where it has some; children are nodes
    and texts."""

    __slots__ = ("tag", "key", "kids", "linked", "size", "spaced")

    def __init__(self, tag, key):
        self.tag, self.key, self.kids = tag, key, []
        self.linked = self.size = 0
        self.spaced = False  # only white space lies between this inline node and the next


class TagEnds:
    """Where the start tags of a page end: at the first ``>`` outside quotes. What was found out for one
    quote holds for every tag whose search comes to it, so a page is searched about once, however
    many of its tags and quotes are left open."""

    def __init__(self, page: str):
        self.page = page
        self.last = {c: page.rfind(c) for c in ">\"'"}
        self.known: dict[int, int] = {}  # by the place of an opening quote
        self.near = (0, -1)              # a place and that of the first special character from there on

    def _special(self, at: int) -> int:
        if self.near[0] <= at <= self.near[1]:
            return self.near[1]
        if at > max(self.last.values()):
            return -1
        m = _SPECIAL.search(self.page, at)
        self.near = (at, m.start())
        return m.start()

    def find(self, at: int) -> int:
        """The place of the ``>`` for a search from ``at``, -1 if there is none."""
        if at > self.last[">"]:
            return -1
        passed, end = [], None
        near = None
        while end is None:
            j = self._special(at)
            near = near or self.near
            if j < 0:
                end = -1
            elif self.page[j] == ">":
                end = j
            elif j in self.known:
                end = self.known[j]
            else:
                passed.append(j)
                quote = self.page[j]
                close = self.page.find(quote, j + 1) if j < self.last[quote] else -1
                if close < 0:
                    end = -1
                at = close + 1
        self.known.update((j, end) for j in passed)
        self.near = near or self.near  # the next tag is searched from further in front
        return end


def _names(attrs: str) -> str:
    found = sorted({re.sub(r"\d+", "", w).lower() for m in _NAMES.finditer(attrs) for w in (m[2] or m[3] or m[4] or "").split()})
    return " ".join(w for w in found if w)


def parse(page: str | None) -> Node:
    """Tree of the block elements. Unclosed elements end with their parent, paragraphs and items
    where the next block or item begins; end tags without a start are ignored. Elements below
    ``MAX_DEPTH`` are blocks beside each other. The time is about linear in the page's length."""
    page = page or ""
    root = Node("", "")
    stack, text, links = [root], [], 0
    foreign = None  # svg or math while inside
    opened: dict[str, list] = {}  # per inline tag, the open ones: their node, or None where they leave no trace
    deeper: dict[str, int] = {}   # per tag, the open ones below MAX_DEPTH
    tag_ends, endless = TagEnds(page), set()  # tags of which no further end tag is there

    def skipped(tag, pos):
        """Where the content of a raw element ends, with its end tag; None without one."""
        found = None if tag in endless else _END_TAGS[tag].search(page, pos)
        if found is None:
            endless.add(tag)
        return found.end() if found else None

    def flush(before_inline=False):
        """The text so far as a child; next to an inline node it keeps its space on that side."""
        if text:
            raw = "".join(text)
            s = " ".join(raw.split())
            text.clear()
            kids = stack[-1].kids
            after_inline = bool(kids) and not isinstance(kids[-1], str) and kids[-1].tag in INLINE
            if s:
                stack[-1].size += len(s)
                kids.append(" " * (after_inline and raw[0].isspace()) + s + " " * (before_inline and raw[-1].isspace()))
            elif raw and after_inline and before_inline:
                kids[-1].spaced = True

    def close_inline(node):
        """Ends an inline node; blocks left open in it go on behind it."""
        flush()
        i = stack.index(node)
        above = [x for x in stack[i + 1:] if x.tag not in INLINE]
        del stack[i:]
        for x in above:
            stack[-1].kids.append(again := Node(x.tag, x.key))
            stack.append(again)

    def put(s):
        if s:
            s = html.unescape(s)
            text.append(s)
            if links:
                stack[-1].linked += len(s)

    pos, n = 0, len(page)
    while pos < n:
        m = _TAG.search(page, pos)
        if m is None:
            put(page[pos:])
            break
        close, tag, attrs = m[1], None, ""
        if m[2]:
            stop = tag_ends.find(m.start())
            if stop < 0:  # no tag after all
                put(page[pos:m.start() + 1])
                pos = m.start() + 1
                continue
            name = _NAME_END.search(page, m.start() + 1, stop + 1).start()
            tag, attrs = page[m.start() + 1:name], page[name:stop]
        put(page[pos:m.start()])
        pos = stop + 1 if m[2] else m.end()
        if close:
            close = close.lower()
            if foreign and (close == foreign or any(x.tag == close for x in stack[1:])):
                foreign = None
            if close in FOREIGN or foreign and close not in INLINE:
                if close == "text":
                    text.append(" ")
                continue
            if close == "a":
                links = max(0, links - 1)
            if close in SPACES:
                text.append(" ")
            if close in INLINE:
                node = opened[close].pop() if opened.get(close) else None
                if node is not None and node in stack:
                    close_inline(node)
                continue
            if close in TRANSPARENT:
                continue
            if deeper.get(close):
                flush()
                deeper[close] -= 1
            elif any(x.tag == close for x in stack[1:]):
                flush()
                while stack.pop().tag != close:
                    pass
        elif tag:
            tag = tag.lower()
            if tag in SPACES:
                text.append(" ")
            if tag in VOID:
                if tag == "hr":
                    flush()
                continue
            if tag in RAW:
                empty = attrs.rstrip().endswith("/") and (foreign or tag not in CODE)
                end = None if empty else skipped(tag, pos)
                pos = end or (n if tag in CODE and not empty else pos)
                continue
            if foreign and tag in NOT_SHOWN:
                pos = skipped(tag, pos) or pos
                continue
            if foreign and tag in BREAKS_OUT:
                foreign = None
            if tag in FOREIGN or foreign and tag not in INLINE:
                if tag in FOREIGN and not foreign and not attrs.rstrip().endswith("/"):
                    foreign = tag
                continue
            if tag == "a":
                links += 1
            names = _names(attrs) if attrs else ""
            if tag in TRANSPARENT:
                continue
            if tag in INLINE:
                node = Node(tag, f"{tag} {names}") if names and NOT_ARTICLE.search(names) and len(stack) < MAX_DEPTH else None
                opened.setdefault(tag, []).append(node)
                if node is not None:
                    flush(before_inline=True)
                    stack[-1].kids.append(node)
                    stack.append(node)
                continue
            flush()
            links = 0
            top = next(i for i in range(len(stack) - 1, -1, -1) if stack[i].tag not in INLINE)
            if stack[top].tag == "p":
                del stack[top:]
            ends = CLOSES.get(tag)
            if ends:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in SCOPE.get(tag, ()):
                        break
                    if stack[i].tag in ends:
                        del stack[i:]
                        break
            node = Node(tag, f"{tag} {names}".strip())
            stack[-1].kids.append(node)
            if not attrs.rstrip().endswith("/") or tag not in ("div", "p", "section"):
                if len(stack) < MAX_DEPTH:
                    stack.append(node)
                else:  # what is in it stands beside it
                    deeper[tag] = deeper.get(tag, 0) + 1
    flush()
    return root


# --- union-free patterns ------------------------------------------------------------------------
# An item is [key, multiplicity, children, [linked characters, characters, pages]]; "#" is a text.

def structure(node: Node) -> list:
    kids = [["#", "1", [], [0, len(k), 1]] if isinstance(k, str) else structure(k) for k in node.kids]
    linked = node.linked + sum(k[3][0] for k in kids)
    size = sum(k[3][1] for k in kids)
    return [node.key, "1", fold(kids), [linked, size, 1]]


def _add(a: list, b: list) -> list:
    return [x + y for x, y in zip(a, b)]


def _times(a: str, b: str) -> str:
    """Multiplicity of what occurs as ``a`` in one place and as ``b`` in another."""
    many, none = ("+" in (a, b) or "*" in (a, b)), bool({a, b} & {"?", "*"})
    return "*" if many and none else "+" if many else "?" if none else "1"


def merge(a: list, b: list, mult: str) -> list:
    return [a[0], mult, align(a[2], b[2]), _add(a[3], b[3])]


def fold(items: list) -> list:
    """Neighbouring repeats as repeated items: single ones first, then runs of up to ``MAX_RUN``
    as groups (key ``()``)."""
    out: list = []
    for x in items:
        if out and out[-1][0] == x[0]:
            out[-1] = merge(out[-1], x, "*" if {out[-1][1], x[1]} & {"?", "*"} and out[-1][1] not in "1+" and x[1] not in "1+" else "+")
        else:
            out.append(x)
    for size in range(2, MAX_RUN + 1):
        i, keys = 0, [x[0] for x in out]
        while i + 2 * size <= len(out):
            if keys[i:i + size] == keys[i + size:i + 2 * size]:
                run = out[i:i + size]
                j = i + size
                while keys[j:j + size] == keys[i:i + size]:
                    run = [merge(p, q, _times(p[1], q[1])) for p, q in zip(run, out[j:j + size])]
                    j += size
                total = [sum(x[3][k] for x in run) for k in (0, 1)] + [run[0][3][2]]
                out[i:j] = [["()", "+", run, total]]
                keys = [x[0] for x in out]
            i += 1
    return out


def _matched(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of positions of an alignment, in order."""
    ka, kb = [_group_key(x) for x in a], [_group_key(x) for x in b]
    if ka == kb:
        return [(i, i) for i in range(len(a))]
    blocks = SequenceMatcher(None, ka, kb, autojunk=False).get_matching_blocks()
    return [(m.a + k, m.b + k) for m in blocks for k in range(m.size)]


def _group_key(x: list):
    return (x[0], *(y[0] for y in x[2])) if x[0] == "()" else x[0]


def align(a: list, b: list) -> list:
    """The least general of the patterns considered that covers both sequences."""
    if not a and not b:
        return []
    out, i, j = [], 0, 0
    optional = lambda x: [x[0], _times(x[1], "?"), x[2], x[3]]
    for p, q in [*_matched(a, b), (len(a), len(b))]:
        out += [optional(x) for x in a[i:p]] + [optional(x) for x in b[j:q]]
        if p < len(a):
            out.append(merge(a[p], b[q], _times(a[p][1], b[q][1])))
        i, j = p + 1, q + 1
    return fold(out) if any(x[0] == y[0] for x, y in zip(out, out[1:])) else out


def infer(patterns: list[list]) -> list:
    wrapper = patterns[0]
    for p in patterns[1:]:
        wrapper = merge(wrapper, p, "1")
    return wrapper


# --- what is the article ------------------------------------------------------------------------

def _reads_as_article(item: list) -> bool:
    """Whether a heading and a paragraph lie directly in the item."""
    tags = {k.split(" ")[0] for k in _flat(item[2])}
    return bool(tags & HEADINGS) and "p" in tags


def _not_article(item: list, inside: bool, menus: bool = True) -> bool:
    """``menus``: also what is mostly links. A container named both as an article and as something
    else is an article if it reads as one."""
    key, stats = item[0], item[3]
    tag, _, names = key.partition(" ")
    if tag == "header" and inside:
        return False  # an article's own header: its headings count, see below
    if tag in DROPPED:
        return True
    if names and NOT_ARTICLE.search(names) and not (ARTICLE.search(names) and _reads_as_article(item)):
        return True
    return menus and tag in ("ul", "ol", "div", "section", "table", "p") and stats[1] > 0 and stats[0] > 0.6 * stats[1]


def mark(wrapper: list) -> list:
    """The wrapper with ``1`` as fifth entry of items of the article and ``0`` of others, and as
    sixth whether all below an item is of the article with it. The article is what ``article`` and ``main`` elements hold (of nested ones the inner), else
    elements so named, else the element below which most of the unlinked text is directly."""
    roots = _roots(wrapper, lambda k: k.split(" ")[0] == "article") or _roots(
        wrapper, lambda k: k.split(" ")[0] == "main" or " main" in f" {k.partition(' ')[2]} ") or _roots(
        wrapper, lambda k: bool(ARTICLE.search(k.partition(" ")[2]))) or [_densest(wrapper)]
    # where nothing but the page holds the text, its menus are below it too
    page = len(roots) == 1 and roots[0][0].split(" ")[0] in ("", "html", "body")
    return _marked(wrapper, [id(r) for r in roots], False, False, page)


def _roots(item: list, wanted) -> list:
    """Outermost wanted items that lie in nothing dropped; comments are articles only by name."""
    if _not_article(item, False):
        return []
    if wanted(item[0]):
        return [item]
    return [r for x in item[2] for r in _roots(x, wanted)]


def _densest(item: list) -> list:
    best, score = item, -1.0
    todo = [item]
    while todo:
        x = todo.pop()
        if x[0] and _not_article(x, False):
            continue
        direct = sum(k[3][1] if k[0] == "#" or k[0] in HEADINGS or k[0].split(" ")[0] in ("p", "pre", "blockquote") else 0 for k in x[2])
        if direct > score:
            best, score = x, direct
        todo += x[2]
    return best


def _marked(item: list, roots: list, inside: bool, dropped: bool, menus: bool) -> list:
    key = item[0]
    is_root = id(item) in roots
    inside = inside or is_root
    if not is_root and key not in ("", "#", "()"):
        dropped = dropped or inside and _not_article(item, inside, menus)
    kids = [_marked(x, roots, inside, dropped, menus) for x in item[2]]
    own = int(inside and not dropped)
    return [key, item[1], kids, item[3], own, int(own and all(x[5] for x in kids))]


# --- extraction ---------------------------------------------------------------------------------

def texts(page: str | None, wrapper: list | None) -> list[str]:
    """Blocks of the article, in page order, by aligning the page to its host's marked wrapper. A
    page of another make than its host's articles, which leaves nothing, is its own wrapper."""
    root = parse(page)
    out: list[str] = []
    if wrapper is not None:
        _collect(root, wrapper[2], out, False, {})
    if not out:
        _collect(root, mark(structure(root))[2], out, False, {})
    return [b for b in (" ".join(x.split()) for x in out) if b]


def _flat(items: list) -> dict[str, list]:
    found: dict[str, list] = {}
    for x in items:
        if x[0] == "()":
            for k, v in _flat(x[2]).items():
                found.setdefault(k, []).extend(v)
        else:
            found.setdefault(x[0], []).append(x)
    return found


def _collect(node: Node, pattern: list, out: list[str], header: bool, known: dict) -> None:
    """``known``: what ``_places`` has found out about the patterns met on this page."""
    if not node.kids:
        return
    places = _places(["#" if isinstance(k, str) else k.key for k in node.kids], pattern, known)
    open_block = joined = False  # whether the last of out is a block that goes on here, and behind an inline node
    for kid, item in zip(node.kids, places):
        if isinstance(kid, str):
            shown = item is not None and item[4] and not header
            if shown and open_block and joined:
                out[-1] += kid
            elif shown:
                out.append(kid)
            open_block, joined = bool(shown) or open_block and joined, False
            continue
        had = len(out)
        if item is not None:
            _collect(kid, item[2], out, header and kid.tag not in HEADINGS or kid.tag == "header" and bool(item[4]), known)
        if kid.tag not in INLINE:
            open_block = joined = False
            continue
        if len(out) > had and open_block:
            out[had - 1:had + 1] = [out[had - 1] + out[had]]
        open_block, joined = open_block or len(out) > had, True
        if open_block and kid.spaced:
            out[-1] += " "


class Items:
    """A pattern's items: by key, in their order, and where those of a key are in it. Items of one key
    that are of the article with all below count as one, with what any of them holds."""

    def __init__(self, pattern: list):
        self.pattern = pattern
        self.flat = _leaves(pattern)
        self.where: dict[str, list[int]] = {}
        for i, x in enumerate(self.flat):
            self.where.setdefault(x[0], []).append(i)
        self.whole = {}
        for at in self.where.values():
            same = [x for x in map(self.flat.__getitem__, at) if x[5]]
            if len(same) > 1:
                one = [*same[0][:2], [y for x in same for y in x[2]], *same[0][3:]]
                self.whole.update((id(x), one) for x in same)


def _places(names: list, pattern: list, known: dict) -> list:
    """For each child (by key) the item of the pattern it is an instance of. Where the key is there once
    that is it; else the sequences are aligned, with the items of all groups in their order, and a
    child between two items takes the last one of its key passed, or the next."""
    if id(pattern) not in known:
        known[id(pattern)] = Items(pattern)
    items = known[id(pattern)]
    flat, where = items.flat, items.where
    if all(len(where.get(n, ())) < 2 for n in names):
        return [flat[where[n][0]] if n in where else None for n in names]
    out, at = [], 0
    for n in names:
        of = where.get(n, [])
        k = bisect_left(of, at)
        nxt, last = of[k] if k < len(of) else None, of[k - 1] if k else None
        if last is not None and (nxt is None or flat[last][1] in "+*" and last == at - 1):
            out.append(flat[last])
        elif nxt is not None:
            out.append(flat[nxt])
            at = nxt + 1
        else:
            out.append(None)
    return [x and items.whole.get(id(x), x) for x in out]


def _leaves(items: list) -> list:
    """The items in their order, those of groups (and of groups in groups) in the groups' place."""
    return [y for x in items for y in (_leaves(x[2]) if x[0] == "()" else [x])]


# --- jobs ---------------------------------------------------------------------------------------

def _dump(pattern) -> str:
    return json.dumps(pattern, ensure_ascii=False, separators=(",", ":"))


def _shape(item: list) -> list:
    return [item[0], item[1], [_shape(x) for x in item[2]]]


def _with_stats(shape: list, stats: list) -> list:
    """Shape and its numbers, listed depth first, back as one pattern."""
    it = iter(stats)

    def build(x):
        own = [next(it), next(it), next(it)]
        return [x[0], x[1], [build(k) for k in x[2]], own]

    return build(shape)


def _numbers(item: list) -> list:
    return [*item[3], *(n for x in item[2] for n in _numbers(x))]


def _structures(batches):
    """Tasks: (host, html) → (host, shape, numbers, pages), equal shapes of a host added up."""
    held: dict[tuple[str, str], list] = {}
    for b in batches:
        for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            s = structure(parse(page))
            key = (host, _dump(_shape(s)))
            n = _numbers(s)
            held[key] = [x + y for x, y in zip(held[key], n)] if key in held else n
        if len(held) > 20_000:
            yield _rows(held)
            held = {}
    if held:
        yield _rows(held)


def _rows(held):
    keys = list(held)
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()),
                                       pa.array([held[k] for k in keys], pa.list_(pa.int64()))], names=["host", "shape", "numbers"])


def _fold_group(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["shape"])
    w = infer([_with_stats(json.loads(s), list(n)) for s, n in zip(pdf["shape"], pdf["numbers"])])
    return pd.DataFrame({"host": [pdf["host"].iloc[0]], "shape": [_dump(_shape(w))], "numbers": [_numbers(w)]})


FOLDED = "host string, shape string, numbers array<long>"


def host_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(host, wrapper)``: the marked wrapper of every host, as JSON."""
    src = pages.select(host_of(quoted(url_col)).alias("host"), quoted(html_col).cast("string").alias("html"))
    rows = src.mapInArrow(_structures, FOLDED)
    # equal shapes have equally many numbers: added up by position
    at = rows.select("host", "shape", F.posexplode("numbers").alias("i", "n")).groupBy("host", "shape", "i").agg(F.sum("n").alias("n"))
    rows = materialise(at.groupBy("host", "shape").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "n"))), lambda x: x["n"]).alias("numbers")),
                       "html-shapes")
    while True:
        most = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= 1:
            break
        salt = F.pmod(F.xxhash64("shape"), F.lit(max(1, math.ceil(most / GROUP)))).alias("salt")
        rows = materialise(rows.groupBy("host", salt).applyInPandas(_fold_group, FOLDED), "html-folded")

    def marked(batches):
        for b in batches:
            done = [_dump(mark(_with_stats(json.loads(s), n))) for s, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(done, pa.string())], names=["host", "wrapper"])

    return materialise(rows.mapInArrow(marked, "host string, wrapper string"), "html-wrappers")


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", keep_html: bool = False) -> DataFrame:
    """``pages`` with ``main_text``: the article's blocks, white space inside each as one space,
    joined by newlines in page order; empty if there is none.

    Null and empty pages have the empty text; pages whose url gives no host share a wrapper; of
    pages that are all alike the wrapper is that page; repeated rows are each extracted; an empty
    table gives an empty table. A column ``main_text`` is replaced, all others are kept, the html
    only with ``keep_html``.
    """
    columns = [c for c in pages.columns if c.lower() != "main_text" and (keep_html or c != html_col)]
    src = pages.select(*[quoted(c).alias(f"__own_{i}") for i, c in enumerate(columns)], host_of(quoted(url_col)).alias("__host"),
                       quoted(html_col).cast("string").alias("__html"))
    wrappers = host_wrappers(pages, url_col, html_col).select(F.col("host").alias("__of"), F.col("wrapper").alias("__wrapper"))
    joined = src.join(wrappers, src["__host"] == wrappers["__of"], "left")

    @F.pandas_udf("string")
    def article(page: pd.Series, wrapper: pd.Series) -> pd.Series:
        loaded: dict = {}
        out = []
        for p, w in zip(page, wrapper):
            if w not in loaded:
                loaded[w] = json.loads(w) if w else None
            out.append("\n".join(texts(p, loaded[w])))
        return pd.Series(out, dtype=object)

    return joined.withColumn("main_text", article("__html", "__wrapper")).select(
        *[F.col(f"__own_{i}").alias(c) for i, c in enumerate(columns)], "main_text")
