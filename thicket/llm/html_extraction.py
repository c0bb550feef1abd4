"""Main text of web pages as a maximum-scoring subsequence.

A page is a sequence of tags and words. Words score by the elements they are in and by their block (links
in it, its length, how it ends, words that menus and notices are made of), tags score below zero; the best
contiguous region is found by one linear scan. Boxes inside of it that score below zero as a whole (an advert between
paragraphs) are no main text and are left out of it; a block of the article, such as a short paragraph of links, never is. The weights are those of a logistic regression on labelled
pages (``html_pages``), some with telling names and some with none: a word's log-odds of being main text, and for
tags what they cost on average.

The names of an element that holds most of a page's words and a headline or an article say nothing: what is around
everything is a wrapper, whatever it is called. Work and memory are linear in the page, however deep its elements are.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from thicket.llm.html_pages import LABELLED
from thicket.sources.shred import ENDS, HOLDS, VOID

EXTRACTED = "page_id long, url string, text string, n_chars long"
PENALTY = 0.05
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""(?:class|id|role|data-main)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_NAME = re.compile(r"[a-z]+")
#: Kinds of HTML elements.
RAW = frozenset("script style title textarea iframe".split())  # up to the next end tag of that name, whatever stands there
FOREIGN = frozenset(("svg", "math"))
HIDDEN = frozenset("svg object select template noscript".split())  # elements like others, whose words aren't main text
SILENT = HIDDEN | {"option", "optgroup"}
LEFT = frozenset("svg select option optgroup".split())  # a block can't stand in them and ends them ..
ENTERED = frozenset("foreignobject desc annotation-xml".split())  # .. but for a block in one of these
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr math mi mn mo ms mtext mrow mfrac msqrt msub msup semantics".split())
CLOSES_P = frozenset(name for name, ends in ENDS.items() if "p" in ends)
PLAIN = frozenset("html body div section span p h1 h2 h3 h4 h5 h6 ul ol li table tbody tr td a b i".split())  # say nothing about the words in them
HEADLINES = frozenset("h1 h2 h3".split())
BOXES = frozenset("div section aside nav header footer form fieldset dialog iframe".split())  # may be no part of an article they stand in
#: Words of menus, notices and forms.
CUES = frozenset("about accept account advertisement archive categories comments contact cookie cookies copyright faq follow help home imprint legal login menu newsletter next policy popular previous privacy related reply reserved rights rss search share shop sign sitemap sponsored subscribe tags terms topics tweet".split())
WRAPS = 0.6  # share of the page's words beyond which an element is a wrapper


def _tags(html: str) -> list[tuple[int, int, str | None, bool, str]]:
    """Start, end, name (null: a comment), whether it closes, and attributes of each tag; raw text belongs to its start tag."""
    out, at, n, foreign = [], 0, len(html), 0
    while at < n and (tag := _TAG.search(html, at)):
        start, at = tag.span()
        name = tag[2] or tag[5]
        if not name:
            out.append((start, at, None, False, ""))
            continue
        name, closing, attributes = name.lower(), bool(tag[1] or tag[4]), tag[3] or tag[6] or ""
        empty = attributes.rstrip().endswith("/")
        if name in FOREIGN:
            foreign = max(0, foreign - 1) if closing else foreign + (not empty)
        elif name in RAW and not closing and not (empty and foreign):
            close = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(html, at)
            at = close.end() if close else n
        out.append((start, at, name, closing, attributes))
    return out


def _unclosed(tags: list[tuple[int, int, str | None, bool, str]]) -> set[int]:
    """Where start tags of hidden elements stand that no end tag belongs to."""
    waiting: dict[str, list[int]] = {}
    for start, _, name, closing, _ in tags:
        if name in HIDDEN:
            own = waiting.setdefault(name, [])
            if not closing:
                own.append(start)
            elif own:
                own.pop()
    return {k for own in waiting.values() for k in own}


@dataclass
class Page:
    """Events of a page in order. An element's end stands at the index ``end`` of its start."""

    text: list[str | None] = field(default_factory=list)  # null: a tag
    names: list[tuple[str, ...]] = field(default_factory=list)  # of a start tag: its name, words of class, id and role; of an end tag: its name
    block: list[bool] = field(default_factory=list)  # whether a block begins or ends
    end: list[int] = field(default_factory=list)  # of a start tag: where the element ends (0: not one)
    closed: list[int] = field(default_factory=list)  # of an event: how many of the open elements end before it

    def add(self, text: str | None, names: tuple[str, ...], block: bool, closed: int) -> int:
        for column, v in ((self.text, text), (self.names, names), (self.block, block), (self.end, 0), (self.closed, closed)):
            column.append(v)
        return len(self.text) - 1


def read_page(html: str) -> Page:
    """Tags and texts of a page. Nothing comes from inside of hidden elements; one without an end tag (or a self-closing one) hides nothing."""
    tags = _tags(html)
    unclosed = _unclosed(tags)
    page, stack, opened = Page(), [], Counter()  # of open elements: name, event (-1: none), the outermost that a block would end, hidden
    at, n, left, silent, ended = 0, len(html), -1, False, 0

    def cut(k: int) -> None:
        nonlocal left, silent, ended
        for name, event, _, _ in stack[k:]:
            opened[name] -= 1
            if event >= 0:
                page.end[event] = len(page.text)
                ended += 1
        del stack[k:]
        left, silent = stack[-1][2:] if stack else (-1, False)

    def add(text: str | None, names: tuple[str, ...], block: bool) -> int:
        nonlocal ended
        closed, ended = ended, 0
        return page.add(text, names, block, closed)

    for start, stop, name, closing, attributes in tags:
        if start > at and not silent:
            add(unescape(html[at:start]), (), False)
        at = stop
        if not name:
            continue
        if closing:
            if opened[name] > 0:
                cut(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name))
            if not silent:
                add(None, (name,), name not in INLINE)
            continue
        if left >= 0 and (name in CLOSES_P or name in ("input", "textarea", "select")):
            cut(left)
        ends, hit = ENDS.get(name, ()), -1
        if any(opened[e] > 0 for e in ends):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ends:
                    hit = k
                elif stack[k][0] in HOLDS:
                    break
        if hit >= 0:
            cut(hit)
        own = ["inner-header" if name == "header" and (opened["article"] > 0 or opened["main"] > 0) else name]
        for m in _ATTRIBUTE.finditer(attributes):
            value = (m[1] or m[2] or m[3] or "").lower()
            own += [f"data-main={value}"] if m[0].lower().startswith("data-main") else [f".{w}" for w in _NAME.findall(value)]
        event = -1 if silent else add(None, tuple(own), name not in INLINE)
        if name not in RAW and name not in VOID and not attributes.rstrip().endswith("/") and start not in unclosed:
            left = -1 if name in ENTERED else len(stack) if left < 0 and name in LEFT else left
            silent = silent or name in SILENT
            stack.append((name, event, left, silent))
            opened[name] += 1
    if at < n and not silent:
        add(unescape(html[at:]), (), False)
    cut(0)
    return page


def _blocks(page: Page) -> tuple[list[int], list[tuple[str, ...]]]:
    """Number of words of each event, and of each text the features of its block."""
    words, features, own = [0] * len(page.text), [()] * len(page.text), []
    links = headings = linked = articles = 0
    cues, heading, last = 0, False, ""

    def settle() -> None:
        nonlocal linked, cues, heading, last
        n = sum(words[i] for i in own)
        if n:
            found = [f"block:{k}" for k, there in (("links", 2 * linked >= n), ("short", n < 6 and not heading), ("long", n >= 12), ("sentence", last in ".!?:;\u2026\"\u201d\u2019)\u00bb\u3002" and not heading), ("cues", 4 * cues >= n), ("heading", heading)) if there]
            for i in own:
                features[i] = tuple(found)
        own.clear()
        linked, cues, heading, last = 0, 0, False, ""

    open_names: list[str] = []
    for i, text in enumerate(page.text):
        for _ in range(page.closed[i]):
            name = open_names.pop()
            links -= name == "a"
            headings -= name in HEADLINES
            articles -= name in ("article", "main")
        if page.block[i]:
            settle()
        if text is None:
            if page.end[i]:
                name = page.names[i][0]
                open_names.append(name)
                links += name == "a"
                headings += name in HEADLINES
                articles += name in ("article", "main")
            continue
        split = text.split()
        words[i] = len(split)
        own.append(i)
        if split:
            linked += len(split) * (links > 0)
            cues += 0 if articles else sum(w.strip(".,:;!?()").lower() in CUES for w in split)  # an article may end in such words
            heading = heading or headings > 0
            last = split[-1][-1]
    settle()
    return words, features


def _wrappers(page: Page, words: list[int]) -> set[int]:
    """Start tags of elements that hold most of the page's words, and a headline or an article."""
    before = [0, *accumulate(words)]
    telling = [0, *accumulate(t is None and bool(n) and e > 0 and n[0] in ("h1", "article", "main") for t, n, e in zip(page.text, page.names, page.end, strict=True))]
    return {i for i, e in enumerate(page.end) if e and before[e] - before[i] >= WRAPS * before[-1] and telling[e] > telling[i + 1]}


def _around(page: Page, wrappers: set[int], telling: dict[str, float] | None) -> Iterator[tuple[int, float, Counter]]:
    """Of each text: its event, the sum of the weights of the names it stands under (each once), and these names."""
    active, total, stack = Counter(), 0.0, []
    for i, text in enumerate(page.text):
        for _ in range(page.closed[i]):
            for x in stack.pop():
                active[x] -= 1
                if not active[x]:
                    del active[x]
                    total -= telling.get(x, 0.0) if telling else 0.0
        if text is not None:
            yield i, total, active
        elif page.end[i]:
            own = [x for x in page.names[i] if x not in PLAIN and (i not in wrappers or x.startswith("data-main") or x in ("article", "main"))]
            stack.append(own)
            for x in own:
                if not active[x]:
                    total += telling.get(x, 0.0) if telling else 0.0
                active[x] += 1


@lru_cache(maxsize=1)
def weights() -> tuple[dict[str, float], float, dict[str, float], float]:
    """Log-odds of names and features for words, their constant, and the cost of tags (by name; and of others), from the labelled pages."""
    rows, labels, inside, outside = [], [], Counter(), Counter()
    for html in LABELLED:
        page = read_page(html)
        words, features = _blocks(page)
        marks: list[str] = []
        for i, _, active in _around(page, _wrappers(page, words), None):
            # The innermost mark counts: a 0 stands inside of a 1 and never around one.
            marks = [x for x in active if x.startswith("data-main")]
            main = bool(marks) and "data-main=0" not in marks
            names = [x for x in active if not x.startswith("data-main")]
            rows += [frozenset([*names, *features[i]])] * words[i]
            labels += [main] * words[i]
            if words[i]:
                (inside if main else outside).update(names)
    names = sorted(set().union(*rows))
    column = {x: i for i, x in enumerate(names)}
    x = np.zeros((len(rows), len(names) + 1))
    x[:, -1] = 1
    for i, own in enumerate(rows):
        x[i, [column[v] for v in own]] = 1
    y, w = np.array(labels, float), np.zeros(len(names) + 1)
    # Both kinds of words weigh the same.
    each = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * 400
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (each * p * (1 - p))[:, None]).T @ x + PENALTY * np.eye(len(w)), x.T @ (each * (p - y)) + PENALTY * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    cost = {v: -0.1 - 0.5 * outside[v] / (inside[v] + outside[v]) for v in names if inside[v] + outside[v]}
    return {v: float(w[i]) for v, i in column.items()}, float(w[-1]), cost, -0.2


def best_region(score: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous region with the highest sum, found in one scan; nothing (0, 0) if none is above zero, the first of equal ones."""
    best, first, last, total, start = 0.0, 0, 0, 0.0, 0
    for i, s in enumerate(score):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, first, last = total, start, i + 1
    return first, last


def main_text(html: str) -> str:
    """The main text of one page, white space as single spaces."""
    odds, base, cost, other = weights()
    page = read_page(html)
    words, features = _blocks(page)
    score = [0.0 if t is not None else cost.get(n[0], other) for t, n in zip(page.text, page.names, strict=True)]
    for i, names, _ in _around(page, _wrappers(page, words), odds):
        score[i] = (base + names + sum(odds.get(x, 0.0) for x in features[i])) * words[i]
    first, last = best_region(score)
    out = _losing(page, score, odds, first, last)
    kept = (" " if page.text[i] is None else page.text[i] for i in range(first, last) if page.block[i] or (page.text[i] is not None and not out[i - first]))
    return " ".join("".join(kept).split())


def _losing(page: Page, score: list[float], odds: dict[str, float], first: int, last: int) -> list[bool]:
    """Which events of a region lie in an element that loses as a whole: a box, or an element whose own names speak against it."""
    total = [0.0, *accumulate(score[first:last])]
    out, i = [False] * (last - first), first
    while i < last:
        end = min(page.end[i], last)
        if end and page.text[i] is None:
            name, *own = page.names[i]
            speaks = sum(odds.get(x, 0.0) for x in own) < 0
            if (name in BOXES or speaks) and total[end - first] - total[i - first] < 0:
                out[i - first : end - first] = [True] * (end - i)
                i = end
                continue
        i += 1
    return out


def extracted(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, main ``text`` (empty if there is none) and ``n_chars`` (its code points) of each page.

    One row per row of ``pages``, whose whole ``html`` is read (null: empty). Repeated and null ids or urls are kept as
    they are; other columns are not read. Of several regions with the best score the first one counts. Broken markup (no end tags, a tag cut off at the end, stray ``<``) is read as
    far as it goes; only script, style, title, textarea and iframe without an end tag take the rest of the page, as in HTML.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py() or "") for h in batch.column(2)]
            yield pa.record_batch([batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, EXTRACTED)
