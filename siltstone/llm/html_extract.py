"""Operator 8, main text of HTML pages by minimum-cut labelling.

A page is cut into text blocks at block-level tags. A linear classifier over a block's containers and their names,
its length and that of its neighbours, its share of links, its last character and its place gives the costs of
calling it content or boilerplate, which are the capacities to the two terminals. Its weights are fitted on labelled
pages of many layouts (page_layouts.py). Blocks next to each other, and consecutive blocks of one parent, are tied by
smoothness edges that grow with the part of the DOM path they share, weaker ones where one is inside a container
of boilerplate and the other is not. The minimum cut, found by maximum flow, labels the blocks.

Character references are decoded, white space inside a block becomes one space, and the content blocks are joined
in page order by one space. Null and empty pages, and pages without content, give the empty text. Pages that end
early, unclosed tags, an omitted end of the head, unclosed comments and unclosed scripts are read as far as they go.
Reader comments and hidden parts hold no text. Repeated rows are read each by itself; an empty table gives an empty
result; columns beyond page_id, url and html are not read. Nothing is cut off long pages, and reading them takes time
in proportion to their length, however deep they nest.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from dataclasses import dataclass
from functools import cache
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from siltstone.llm.common import table

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)
    |<(script|style|noscript|template|svg|math|iframe|object|textarea|select|title)(?=[\s>/]).*?(?:</\1\s*>|\Z)
    |<[!?][^>]*(?:>|\Z)
    |<(/?)([a-zA-Z][^\s>/]*)([^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*)>
    |<(/?)([a-zA-Z][^\s>/]*)([^>]*)(?:>|\Z)
    |[^<]+
    |<""",
    re.S | re.I | re.X,
)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|aria-label|style|itemprop)\b\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: An open tag of the second kind ends where one of the first begins.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
NOT_TEXT_TAGS = set("nav header footer aside menu dialog search".split())
FORM_TAGS = set("form button label fieldset".split())
NOT_TEXT = set("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner banners cookie cookies consent gdpr notice notices notification alert popup modal overlay sidebar side rail aside menu menus nav navbar navigation breadcrumb breadcrumbs header masthead footer copyright legal disclaimer comment comments commentlist disqus respond reply replies discussion share sharing social related recommend recommended recommendations newsletter subscribe subscription signup login widget widgets toc pagination pager tags toolbar search form skip contentinfo complementary".split())
COMMENTS = set("comment comments commentlist disqus respond reply replies discussion".split())
TEXT = set("article content main post entry story body text maincontent articlebody".split())
NAMES = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
#: What the containers of a block say about it.
ARTICLE, OTHER_TAG, IN_FORM, OTHER_NAME, TEXT_NAME, COMMENT, HIDDEN, HEADING, PARAGRAPH = (1 << i for i in range(9))
SAYS = (ARTICLE, OTHER_TAG, IN_FORM, OTHER_NAME, TEXT_NAME, HEADING, PARAGRAPH)
APART = OTHER_TAG | OTHER_NAME | COMMENT | HIDDEN
#: Smoothness of neighbours and of consecutive blocks of one parent, times the share of the path in common, and times
#: ACROSS where one alone is inside a container of boilerplate.
NEXT, SIBLING, ACROSS = 0.6, 0.8, 0.25
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
STOPS = frozenset("ul ol dl table div article section select".split())


def kind(tag: str, attributes: str) -> int:
    """What a tag says about the text inside, as bits."""
    out = ARTICLE if tag in ("article", "main") else OTHER_TAG if tag in NOT_TEXT_TAGS else IN_FORM if tag in FORM_TAGS else HEADING if tag in HEADINGS else PARAGRAPH if tag in ("p", "blockquote", "pre") else 0
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return out
    names: set[str] = set()
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return HIDDEN
        if name in ("class", "id", "role", "aria-label", "itemprop"):
            names.update(x.lower() for x in NAMES.findall(value))
    if tag in ("html", "body"):
        return out
    if names & COMMENTS:
        return out | COMMENT
    return out | (TEXT_NAME if names & TEXT else 0) | (OTHER_NAME if names & NOT_TEXT else 0)


@dataclass
class Block:
    text: str
    words: int
    links: int
    state: int
    #: number of the innermost block-level element
    element: int
    #: number of the innermost container that sounds like boilerplate, 0 if there is none
    root: int


def blocks_of(html: str) -> tuple[list[Block], list[int], list[int]]:
    """Blocks in page order, and for each block-level element its parent and depth."""
    stack: list[tuple[str, int, int, int]] = [("", 0, 0, 0)]  # tag, state, innermost block-level element, root
    parent, depth = [0], [0]
    open_: Counter = Counter()
    out: list[Block] = []
    buffer, links, roots = [], 0, 0

    def flush() -> None:
        nonlocal links
        if buffer:
            words = unescape("".join(buffer)).split()
            if words:
                out.append(Block(" ".join(words), len(words), min(links, len(words)), *stack[-1][1:]))
            buffer.clear()
        links = 0

    for m in TOKEN.finditer(html):
        text = m[0]
        if text[0] != "<" or text == "<":
            buffer.append(text)
            if open_["a"]:
                links += len(text.split())
            continue
        tag = (m[3] or m[6] or "").lower()
        if not tag:
            continue
        if m[2] or m[5]:
            if open_[tag]:
                if tag in BLOCK:
                    flush()
                while True:
                    name = stack.pop()[0]
                    open_[name] -= 1
                    if name == tag:
                        break
            continue
        if tag == "br":
            buffer.append(" ")
            continue
        if tag in BLOCK:
            flush()
        if tag in VOID:
            continue
        if (ends := CLOSES.get(tag)) and any(open_[x] for x in ends):
            # not past the container that such tags belong to
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in ends:
                    open_.subtract(x[0] for x in stack[i:])
                    del stack[i:]
                    break
                if stack[i][0] in STOPS:
                    break
        k, state = kind(tag, m[4] or m[7] or ""), stack[-1][1]
        # main text inside named boilerplate counts; comments and hidden parts hold none
        state = (state & ~(OTHER_TAG | OTHER_NAME | IN_FORM) if k & (ARTICLE | TEXT_NAME) else state) | k
        element = stack[-1][2]
        if tag in BLOCK:
            parent.append(element)
            depth.append(depth[element] + 1)
            element = len(parent) - 1
        roots += 1
        stack.append((tag, state, element, roots if k & (OTHER_TAG | OTHER_NAME | IN_FORM) else 0 if not state & (OTHER_TAG | OTHER_NAME | IN_FORM) else stack[-1][3]))
        open_[tag] += 1
    flush()
    return out, parent, depth


def features(blocks: list[Block]) -> np.ndarray:
    """A row for each block."""
    x = np.zeros((len(blocks), len(SAYS) + 11))
    inside: Counter = Counter()
    for b in blocks:
        inside[b.root] += b.words - b.links
    size = [0, *(math.log1p(b.words) for b in blocks), 0]
    for i, b in enumerate(blocks):
        x[i, : len(SAYS)] = [bool(b.state & bit) for bit in SAYS]
        place = i / len(blocks)
        form, named, near = bool(b.state & IN_FORM), bool(b.state & OTHER_NAME), (size[i] + size[i + 2]) / 2
        # a form or a misleading name may hold the whole article: its words tell
        both = (form * size[i + 1], form * math.log1p(inside[b.root]), named * size[i + 1], named * math.log1p(inside[b.root]))
        x[i, len(SAYS) :] = (*both, size[i + 1], b.links / b.words, b.text[-1] in ".!?:;\u201d\"'\u2026", near, place, max(size[i + 1] - 3, 0), 1.0)
    return x


@cache
def weights() -> np.ndarray:
    """Logistic weights from the labelled pages, fitted by Newton's method; the last is the constant."""
    from siltstone.llm.page_layouts import labelled_pages

    rows, labels = [], []
    for html, is_text in labelled_pages():
        blocks = [b for b in blocks_of(html)[0]]
        x, keep = features(blocks), [not b.state & (COMMENT | HIDDEN) for b in blocks]
        rows.append(x[keep])
        labels += [is_text(b.text) for b, k in zip(blocks, keep, strict=True) if k]
    x, y = np.concatenate(rows), np.array(labels, float)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g, h = x.T @ (p - y) / len(y) + 2e-4 * w, (x * (p * (1 - p))[:, None]).T @ x / len(y) + 2e-4 * np.eye(len(w))
        w = w - np.linalg.solve(h, g)
    return w


def min_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay on the source's side of a minimum cut (Dinic's algorithm; edges hold both ways)."""
    n = len(source)
    s, t = n, n + 1
    to: list[int] = []
    cap: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def add(a: int, b: int, forth: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        cap.append(forth)
        out[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i in range(n):
        both = min(source[i], sink[i])  # flows straight through
        if source[i] > both:
            add(s, i, source[i] - both, 0.0)
        elif sink[i] > both:
            add(i, t, sink[i] - both, 0.0)
    for a, b, w in edges:
        add(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        todo = deque([s])
        while todo:
            x = todo.popleft()
            for e in out[x]:
                if cap[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[x] + 1
                    todo.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        at = [0] * (n + 2)
        path: list[int] = []
        x = s
        while True:
            if x == t:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                cut = next(i for i, e in enumerate(path) if cap[e] <= 1e-9)
                x = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while at[x] < len(out[x]):
                e = out[x][at[x]]
                if cap[e] > 1e-9 and level[to[e]] == level[x] + 1:
                    break
                at[x] += 1
            else:
                if x == s:
                    break
                level[x] = -1
                x = to[path.pop() ^ 1]
                continue
            path.append(e)
            x = to[e]


def shared(a: int, b: int, parent: list[int], depth: list[int]) -> float:
    """Part of the longer of two DOM paths that both share."""
    longest = max(depth[a], depth[b], 1)
    while a != b:
        if depth[a] >= depth[b]:
            a = parent[a]
        else:
            b = parent[b]
    return depth[a] / longest


def main_text(html: str | None, w: np.ndarray | None = None) -> str:
    """w: the classifier's weights, fitted here if they are not given."""
    blocks, parent, depth = blocks_of(html) if html else ([], [], [])
    if not blocks:
        return ""
    odds = features(blocks) @ (weights() if w is None else w)
    odds[[bool(b.state & (COMMENT | HIDDEN)) for b in blocks]] = -50.0
    # costs of the two labels: the classifier's log odds
    content, other = np.maximum(odds, 0).tolist(), np.maximum(-odds, 0).tolist()
    edges = []
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        above = parent[b.element]
        for j, weight in ((i - 1, NEXT), (last.get(above, -1), SIBLING)):
            if j >= 0:
                # siblings share all of their paths but the last element
                part = shared(blocks[j].element, b.element, parent, depth) if weight == NEXT else depth[above] / max(depth[b.element], depth[blocks[j].element], 1)
                edges.append((j, i, weight * part * (1 if bool(b.state & APART) == bool(blocks[j].state & APART) else ACROSS)))
        last[above] = i
    keep = min_cut(content, other, edges)
    return " ".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def extract(pages: DataFrame) -> DataFrame:
    """pages: page_id, url and html are read."""
    fitted = weights()

    def run(batches):
        for b in batches:
            text = [main_text(h, fitted) for h in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": text, "n_chars": [len(t) for t in text]})

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, url string, text string, n_chars long")


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
