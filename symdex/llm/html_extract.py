"""Main text of web pages by composite text density.

Every node of the page's tree gets its characters C and tags T and those
inside links, LC and LT, over its subtree, and the link-adjusted density

    C/T * log_b(C/LC' * T/LT'),   b = ln(C/(C - LC)' * LC + LCb/Cb * C + e)

with the body's own LCb and Cb, a primed zero counting as one.  A node's
density sum adds its children's densities, each direct stretch of text counting
as a child of one tag.  The node below the body with the largest sum is the
content (the first among equals).  The smallest density on the path from it
up to, but without, the body is the threshold: a branch beside that path is
content too if its density reaches the threshold and several of its children
make its sum exceed its density.

A page may have its paragraphs directly in the body, with no element around
them.  So a run of neighbouring text blocks (paragraphs, headings, quotations)
that are the body's own children is a candidate like a node, with the sum of
their densities; where it beats every node, the run is the content.

Pages are read leniently: unclosed paragraphs, list items, table parts and
options end where their next sibling or their parent's end comes, stray end
tags are skipped, comments, scripts, styles and templates hold no text,
references are decoded and white space is collapsed.  Blocks are on lines of
their own.

Cases: a null page has null text; an empty page, or one without text below the
body, has empty text; text directly in the body is the content if there is no
element; rows are read one by one, in time that grows as their length, deep or
flat; rows that repeat give equal rows; an empty table gives an empty result;
extra columns are not carried.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import small_batches

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>"']++|"[^"<]*+"|'[^'<]*+'|["'])*+)>|<[!?/][^>]*+>""", re.S)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SILENT = frozenset("script style noscript template textarea iframe svg head title".split())
_RAW = frozenset("script style textarea title iframe".split())
_BLOCK = frozenset("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
#: A start tag ends open ones of these kinds, up to a parent that holds them.
_ENDS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Blocks that hold running text.
_TEXT = frozenset("blockquote h1 h2 h3 h4 h5 h6 p pre".split())
_ENDS_P = _BLOCK - {"br", "td", "th", "tr", "tbody", "thead", "tfoot", "body"}


class Tree:
    """Nodes in document order: name, parent, and the pieces of text with the node that holds each."""

    def __init__(self, page: str):
        self.name, self.parent, self.last = ["#"], [-1], [0]
        self.text: list[tuple[int, str]] = []
        open_, at, silent = [0], 0, 0
        depths: dict[str, list[int]] = {}  # of the open elements of each name, outermost first

        def end(depth: int) -> None:
            nonlocal silent
            for i in reversed(open_[depth:]):
                self.last[i] = len(self.name) - 1
                silent -= self.name[i] in _SILENT
                depths[self.name[i]].pop()
            del open_[depth:]

        def end_nearest(kinds: Iterable[str], within: Iterable[str]) -> None:
            """Ends the outermost open element of ``kinds`` that is inside the innermost of ``within``."""
            fence = max((depths[k][-1] for k in within if depths.get(k)), default=0)
            found = len(open_)
            for kind in kinds:
                own = depths.get(kind)
                if own and own[-1] > fence:
                    found = min(found, own[bisect_right(own, fence)])
            if found < len(open_):
                end(found)

        def add(stretch: str) -> None:
            if not silent and stretch:
                own = " ".join(unescape(stretch).split())
                if own:
                    self.text.append((open_[-1], own))

        low = None
        while m := _TOKEN.search(page, at):
            add(page[at : m.start()])
            at = m.end()
            close, name = m[1], m[2]
            if name is None:
                continue
            name = name.lower()
            if close:
                if depths.get(name):
                    end(depths[name][-1])
                continue
            if name in _ENDS_P:
                end_nearest(("p",), ("body", "td", "th", "li", "button"))
            if name in _ENDS:
                end_nearest(*_ENDS[name])
            self.name.append(name)
            self.parent.append(open_[-1])
            self.last.append(len(self.name) - 1)
            if name in _VOID or m[3].endswith("/"):
                continue
            depths.setdefault(name, []).append(len(open_))
            open_.append(len(self.name) - 1)
            silent += name in _SILENT
            if name in _RAW:
                low = page.lower() if low is None else low
                if len(low) != len(page):
                    low = "".join(c if len(c.lower()) != 1 else c.lower() for c in page)
                stop = low.find("</" + name, at)
                at = len(page) if stop < 0 else stop
        add(page[at:])
        end(1)
        self.last[0] = len(self.name) - 1


def content(page: str) -> str:
    """The main text of one page."""
    tree = Tree(page)
    n = len(tree.name)
    chars, tags, link_chars, links = [0] * n, [1] * n, [0] * n, [0] * n
    direct: list[list[int]] = [[] for _ in range(n)]
    for i, text in tree.text:
        chars[i] += len(text)
        direct[i].append(len(text))
    for i in range(n - 1, 0, -1):
        if tree.name[i] == "a":
            link_chars[i], links[i] = chars[i], links[i] + 1
        p = tree.parent[i]
        chars[p] += chars[i]
        tags[p] += tags[i]
        link_chars[p] += link_chars[i]
        links[p] += links[i]
    body = next((i for i in range(1, n) if tree.name[i] == "body"), 0)
    ratio = link_chars[body] / max(chars[body], 1)

    def density(c: int, t: int, lc: int, lt: int) -> float:
        if not c:
            return 0.0
        base = log(c / max(c - lc, 1) * lc + ratio * c + e)
        return c / t * log(c / max(lc, 1) * t / max(lt, 1)) / log(base) if base > 1 + 1e-12 else c / t * log(c / max(lc, 1) * t / max(lt, 1))

    own = [density(*x) for x in zip(chars, tags, link_chars, links)]
    total = [sum(density(c, 1, 0, 0) for c in d) for d in direct]
    for i in range(1, n):
        total[tree.parent[i]] += own[i]
    below = range(body + 1, tree.last[body] + 1)
    best = max(below, key=lambda i: (total[i], -i), default=None)
    if best is None or not total[best]:
        return _write(tree, [(body, tree.last[body])])
    flat = _flat_run(tree, body, own)
    if flat and sum(own[i] for i in flat) > total[best]:
        return _write(tree, [(i, tree.last[i]) for i in flat])
    path, i = [], best
    while i != body:
        path.append(i)
        i = tree.parent[i]
    threshold = min(own[i] for i in path)
    up = set(path) | {body}
    spans = [(best, tree.last[best])]
    for i in below:
        if tree.parent[i] in up and i not in up and tree.parent[i] != best and own[i] >= threshold and total[i] > own[i] * (1 + 1e-9):
            spans.append((i, tree.last[i]))
    return _write(tree, sorted(spans))


def _flat_run(tree: Tree, body: int, own: list[float]) -> list[int]:
    """The run of neighbouring text blocks directly in the body with the largest density sum, the first among equals."""
    runs: list[list[int]] = [[]]
    for i in range(body + 1, tree.last[body] + 1):
        if tree.parent[i] == body:
            if tree.name[i] in _TEXT:
                runs[-1].append(i)
            elif tree.name[i] in _BLOCK:
                runs.append([])
    return max((r for r in runs if len(r) > 1), key=lambda r: sum(own[i] for i in r), default=[])


def _write(tree: Tree, spans: list[tuple[int, int]]) -> str:
    """The text of whole subtrees, given in order and apart, a line for each block."""
    block = [0] * len(tree.name)
    for i in range(1, len(block)):
        block[i] = i if tree.name[i] in _BLOCK else block[tree.parent[i]]
    out: list[list[str]] = [[]]
    last, inside = None, [False] * (len(tree.name) + 1)
    for a, b in spans:
        inside[a : b + 1] = [True] * (b + 1 - a)
    for i, text in tree.text:
        if not inside[i]:
            continue
        if block[i] != last:
            out.append([])
            last = block[i]
        out[-1].append(text)
    return "\n".join(" ".join(x) for x in out if x)


@F.arrow_udf(T.StringType())
def _content(pages: pa.Array) -> pa.Array:
    return pa.array([None if p is None else content(p) for p in (x.as_py() for x in pages)], pa.string())


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, text, n_chars of each row."""
    small_batches(pages.sparkSession)
    made = pages.select(F.col(id_col).alias("page_id"), _content(F.col(html_col)).alias("text"))
    return made.withColumn("n_chars", F.length("text"))
