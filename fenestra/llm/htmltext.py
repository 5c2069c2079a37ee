"""Main text of web pages: flat text blocks with word counts and link densities, classified by a decision tree.

A page becomes a list of text blocks, cut at block-level tags. A block's features are its words and link density, those
of its two neighbours, the region that it lies in (by the tags, classes and ids of its containers), whether it is a
heading or a paragraph, and how much of the page's plain text lies in content regions. A decision tree, grown here from
the small labelled table below, tells main text from the rest; nothing else decides.

Elements without text of the page (scripts, buttons, ...) that lack their end tag end before the next block-level tag.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import small_batches

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)", re.S)
_HINT = re.compile(r"(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
#: Elements whose content is no text of the page; those of them whose content is no markup; those that nest.
_RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "math", "object", "canvas", "audio", "video", "select", "button", "datalist"}
_VERBATIM = {"script", "style", "iframe", "textarea", "title"}
_NESTS = {"template", "svg", "object"}
_BLOCK = re.compile(r"</?(?:p|div|h[1-6]|article|main|section|header|footer|nav|aside|body|form|ul|ol|dl|table|blockquote|figure)\b", re.I)
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "input", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br", "picture", "source", "link", "meta", "path", "nobr"}
_CONTAINERS = {"div", "section", "article", "main", "nav", "header", "footer", "aside", "form", "ul", "ol", "dl", "table", "figure", "blockquote", "dialog", "details", "menu", "fieldset", "center", "td", "tr", "li", "body"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_BOILER_TAGS = {"nav", "header", "footer", "aside", "form", "dialog", "menu", "fieldset"}
_CONTENT_TAGS = {"article", "main"}
#: Words of classes and ids that mark what is not main text, and what is. Fixed values.
_BOILER_HINTS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "adbox", "banner", "sponsor", "sponsored", "promo", "promotion", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "side", "aside", "widget", "footer", "foot", "header", "masthead", "topbar", "comment", "comments", "disqus", "discussion", "reply", "replies", "respond", "cookie", "cookies", "consent", "notice", "notices", "gdpr", "privacy", "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing", "social", "related", "recommended", "recommendations", "popup", "modal", "overlay", "search", "form", "toolbar", "pagination", "pager", "copyright", "legal", "disclaimer", "alert", "outbrain", "taboola", "tags", "byline", "meta", "skip"}
_CONTENT_HINTS = {"article", "content", "main", "post", "entry", "story", "body", "text"}
_STORY_HINTS = {"article", "post", "entry", "story"}
#: Of the first, those that decide even for an article element or an element called one; parts of words that do; and words
#: that say an element only has to do with such. Fixed values.
_STRONG_HINTS = {"ad", "ads", "comment", "comments", "related", "reply", "replies", "sponsored", "promo"}
_STRONG_PARTS = ("comment", "advert", "sponsor", "cookie", "newsletter", "sidebar", "breadcrumb")
_ABOUT = {"has", "with", "without"}
_WORDS = re.compile(r"[a-z]+")

#: Labelled blocks: words, link density in percent, the same of the previous and of the next block (0, 0 at the page's
#: ends), region (0 unknown, 1 content, 2 boilerplate), heading, paragraph, percent of the page's plain words that lie in
#: content regions, main text or not.
TABLE = [
    # menus, lists of links, teasers
    (1, 100, 0, 0, 1, 100, 0, 0, 0, 0, 0), (2, 100, 1, 100, 2, 100, 0, 0, 0, 0, 0), (3, 100, 2, 100, 40, 0, 0, 0, 0, 0, 0), (4, 80, 5, 90, 3, 100, 0, 0, 0, 0, 0),
    (6, 90, 30, 2, 6, 90, 0, 0, 1, 0, 0), (12, 70, 8, 80, 10, 75, 0, 0, 1, 0, 0), (20, 60, 15, 70, 18, 60, 0, 0, 0, 0, 0), (30, 75, 25, 70, 5, 90, 0, 0, 1, 0, 0),
    (5, 100, 60, 0, 40, 0, 0, 0, 1, 0, 0), (8, 95, 12, 0, 0, 0, 0, 0, 1, 0, 0), (3, 100, 60, 0, 2, 100, 0, 1, 0, 0, 0), (4, 100, 3, 100, 5, 100, 0, 1, 0, 0, 0),
    # short texts outside paragraphs: labels, dates, captions
    (3, 0, 0, 0, 2, 100, 0, 0, 0, 0, 0), (5, 0, 3, 100, 4, 0, 0, 0, 0, 0, 0), (2, 0, 4, 0, 3, 0, 0, 0, 0, 0, 0), (7, 0, 2, 100, 0, 0, 0, 0, 0, 0, 0),
    (4, 0, 6, 0, 5, 100, 0, 0, 0, 0, 0), (8, 20, 3, 60, 6, 50, 0, 0, 0, 0, 0), (9, 0, 1, 100, 1, 100, 0, 0, 0, 0, 0), (5, 10, 9, 30, 2, 80, 0, 0, 0, 0, 0),
    (4, 0, 60, 0, 2, 100, 0, 0, 0, 0, 0), (6, 0, 45, 0, 3, 100, 0, 0, 0, 0, 0), (3, 0, 2, 100, 70, 0, 0, 0, 0, 0, 0), (8, 0, 4, 100, 3, 0, 0, 0, 0, 0, 0),
    (2, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0), (4, 0, 0, 0, 3, 0, 0, 0, 0, 0, 0), (6, 0, 4, 0, 0, 0, 0, 0, 0, 0, 0),
    # short paragraphs among links
    (4, 0, 2, 100, 3, 100, 0, 0, 1, 0, 0), (6, 0, 3, 100, 2, 100, 0, 0, 1, 0, 0), (5, 20, 4, 90, 6, 80, 0, 0, 1, 0, 0), (3, 0, 5, 100, 0, 0, 0, 0, 1, 0, 0), (5, 0, 2, 100, 4, 100, 0, 0, 1, 0, 0),
    (6, 0, 4, 100, 0, 0, 0, 0, 1, 0, 0), (2, 0, 1, 100, 3, 100, 0, 0, 1, 0, 0), (7, 0, 3, 95, 4, 100, 0, 0, 1, 0, 0),
    # paragraphs of an article
    (60, 0, 4, 100, 55, 0, 0, 0, 1, 0, 1), (45, 2, 60, 0, 30, 0, 0, 0, 1, 0, 1), (120, 5, 45, 0, 80, 3, 0, 0, 1, 0, 1), (25, 0, 70, 0, 60, 0, 0, 0, 1, 0, 1),
    (15, 0, 90, 0, 40, 5, 0, 0, 1, 0, 1), (6, 0, 80, 0, 75, 0, 0, 0, 1, 0, 1), (3, 0, 50, 2, 60, 0, 0, 0, 1, 0, 1), (200, 8, 2, 100, 3, 100, 0, 0, 1, 0, 1),
    (40, 20, 55, 3, 70, 0, 0, 0, 1, 0, 1), (35, 0, 5, 100, 4, 0, 0, 0, 1, 0, 1), (10, 0, 45, 0, 50, 0, 0, 0, 1, 0, 1), (18, 10, 60, 0, 35, 0, 0, 0, 1, 0, 1),
    (30, 0, 2, 100, 3, 100, 0, 0, 1, 0, 1), (22, 0, 0, 0, 0, 0, 0, 0, 1, 0, 1), (60, 45, 40, 0, 30, 0, 0, 0, 1, 10, 1), (40, 0, 5, 0, 60, 0, 0, 0, 1, 30, 1),
    (50, 0, 60, 0, 0, 0, 0, 0, 1, 0, 1), (35, 0, 50, 0, 3, 100, 0, 0, 1, 0, 1), (24, 0, 80, 0, 2, 100, 0, 0, 0, 0, 1), (70, 3, 45, 0, 4, 90, 0, 0, 1, 20, 1), (28, 0, 90, 0, 0, 0, 0, 0, 0, 5, 1), (90, 0, 120, 0, 1, 100, 0, 0, 1, 40, 1),
    # short paragraphs beside other text, or alone
    (7, 0, 0, 0, 6, 0, 0, 0, 1, 0, 1), (6, 0, 7, 0, 0, 0, 0, 0, 1, 0, 1), (4, 0, 3, 0, 5, 0, 0, 0, 1, 0, 1), (8, 0, 0, 0, 0, 0, 0, 0, 1, 0, 1), (3, 0, 0, 0, 4, 0, 0, 0, 1, 0, 1),
    (6, 0, 60, 0, 3, 100, 0, 0, 1, 0, 1), (4, 0, 45, 0, 2, 100, 0, 0, 1, 0, 1), (5, 0, 30, 0, 4, 90, 0, 0, 1, 0, 1), (7, 0, 12, 0, 1, 100, 0, 0, 1, 0, 1), (5, 0, 2, 100, 60, 0, 0, 0, 1, 0, 1),
    (6, 0, 4, 100, 45, 0, 0, 0, 1, 0, 1), (3, 0, 3, 100, 12, 0, 0, 0, 1, 0, 1), (2, 0, 40, 0, 0, 0, 0, 0, 1, 0, 1), (7, 0, 3, 0, 2, 100, 0, 0, 1, 0, 1), (5, 0, 4, 0, 6, 0, 0, 0, 1, 0, 1),
    # long texts outside paragraphs, and short ones inside them
    (60, 0, 3, 100, 2, 100, 0, 0, 0, 0, 1), (30, 0, 40, 0, 35, 0, 0, 0, 0, 0, 1), (80, 5, 0, 0, 0, 0, 0, 0, 0, 0, 1), (25, 0, 0, 0, 30, 0, 0, 0, 0, 0, 1), (20, 0, 60, 0, 45, 0, 0, 0, 0, 0, 1),
    (6, 0, 80, 0, 75, 0, 0, 0, 0, 0, 1), (4, 0, 30, 0, 25, 0, 0, 0, 0, 0, 1), (9, 0, 45, 0, 50, 0, 0, 0, 0, 0, 1), (100, 10, 5, 0, 3, 100, 0, 0, 0, 0, 1),
    # headings
    (5, 0, 3, 100, 60, 0, 0, 1, 0, 0, 1), (9, 0, 2, 100, 45, 0, 0, 1, 0, 0, 1), (3, 0, 70, 0, 80, 0, 0, 1, 0, 0, 1), (3, 0, 60, 0, 2, 100, 0, 1, 0, 0, 0), (2, 0, 3, 100, 4, 100, 0, 1, 0, 0, 0),
    (1, 0, 3, 100, 22, 0, 0, 1, 0, 0, 1), (4, 0, 0, 0, 12, 0, 0, 1, 0, 0, 1), (2, 0, 40, 0, 0, 0, 0, 1, 0, 0, 0), (6, 0, 0, 0, 7, 0, 0, 1, 0, 0, 1), (3, 0, 5, 0, 1, 100, 0, 1, 0, 0, 0),
    (1, 0, 3, 100, 4, 0, 0, 1, 0, 0, 1), (2, 0, 1, 100, 5, 0, 0, 1, 0, 0, 1), (6, 0, 0, 0, 3, 0, 0, 1, 0, 0, 1), (4, 0, 50, 0, 4, 0, 0, 1, 0, 0, 1), (3, 0, 3, 100, 3, 100, 0, 1, 0, 0, 0), (1, 0, 6, 0, 5, 0, 0, 1, 0, 0, 1),
    # beside regions that hold the page's content
    (60, 0, 40, 0, 55, 0, 0, 0, 1, 100, 0), (25, 0, 4, 100, 30, 0, 0, 0, 1, 90, 0), (8, 0, 60, 0, 3, 100, 0, 0, 1, 75, 0), (40, 0, 70, 0, 0, 0, 0, 0, 0, 60, 0), (5, 0, 3, 100, 60, 0, 0, 1, 0, 80, 0),
    (120, 3, 90, 0, 80, 0, 0, 0, 1, 70, 0), (15, 0, 0, 0, 50, 0, 0, 0, 1, 95, 0), (10, 0, 30, 0, 0, 0, 0, 0, 1, 55, 0), (7, 0, 8, 0, 6, 0, 0, 0, 1, 85, 0), (30, 0, 25, 0, 20, 0, 0, 0, 0, 98, 0),
    # content regions
    (1, 100, 10, 0, 30, 0, 1, 0, 1, 100, 0), (1, 0, 10, 0, 30, 0, 1, 0, 1, 100, 1), (2, 0, 1, 0, 2, 0, 1, 0, 1, 100, 1), (4, 0, 0, 0, 8, 0, 1, 1, 0, 100, 1), (60, 0, 40, 0, 55, 0, 1, 0, 1, 90, 1),
    (3, 0, 5, 100, 6, 0, 1, 0, 0, 100, 1), (8, 0, 3, 100, 0, 0, 1, 0, 1, 100, 1), (30, 30, 20, 0, 25, 0, 1, 0, 1, 80, 1), (12, 45, 60, 0, 40, 0, 1, 0, 1, 70, 1), (1, 0, 60, 0, 4, 100, 1, 0, 0, 95, 1),
    (150, 10, 3, 0, 90, 4, 1, 0, 1, 60, 1), (2, 0, 0, 0, 0, 0, 1, 0, 0, 100, 1), (5, 0, 2, 0, 3, 100, 1, 0, 1, 20, 1), (3, 0, 2, 100, 4, 100, 1, 0, 1, 10, 1), (3, 0, 60, 0, 2, 100, 1, 1, 0, 30, 1),
    (3, 100, 5, 100, 4, 100, 1, 0, 0, 90, 0), (6, 95, 50, 0, 7, 90, 1, 0, 0, 100, 0), (2, 100, 80, 0, 3, 100, 1, 0, 1, 80, 0), (9, 90, 4, 100, 20, 0, 1, 0, 1, 60, 0),
    # boilerplate regions
    (60, 0, 40, 0, 55, 0, 2, 0, 1, 0, 0), (25, 0, 0, 0, 30, 0, 2, 0, 1, 90, 0), (120, 5, 3, 0, 60, 0, 2, 0, 1, 50, 0), (4, 0, 60, 0, 5, 0, 2, 1, 0, 70, 0), (10, 0, 80, 0, 0, 0, 2, 0, 0, 0, 0),
    (3, 100, 3, 100, 2, 100, 2, 0, 0, 0, 0), (15, 40, 8, 60, 20, 30, 2, 0, 1, 80, 0), (8, 0, 1, 100, 6, 0, 2, 0, 1, 0, 0), (7, 0, 5, 100, 50, 0, 2, 1, 0, 0, 0), (200, 0, 70, 0, 90, 0, 2, 0, 0, 100, 0),
    (30, 0, 45, 0, 60, 0, 2, 0, 1, 30, 0), (6, 0, 0, 0, 7, 0, 2, 0, 1, 0, 0),
]


def grow(rows: list[tuple], depth: int = 8) -> tuple | int:
    """A decision tree by Gini impurity: (feature, threshold, tree if <=, tree if >) or a class."""
    ones = sum(r[-1] for r in rows)
    if depth == 0 or ones in (0, len(rows)):
        return int(2 * ones >= len(rows))
    best = None
    for f in range(len(rows[0]) - 1):
        values = sorted({r[f] for r in rows})
        for lo, hi in zip(values, values[1:], strict=False):
            cut = (lo + hi) / 2
            left, right = [r for r in rows if r[f] <= cut], [r for r in rows if r[f] > cut]
            loss = sum(len(s) * (p := sum(r[-1] for r in s) / len(s)) * (1 - p) for s in (left, right))
            if best is None or loss < best[0] - 1e-12:
                best = (loss, f, cut, left, right)
    if best is None:
        return int(2 * ones >= len(rows))
    _, f, cut, left, right = best
    return f, cut, grow(left, depth - 1), grow(right, depth - 1)


@lru_cache
def tree() -> tuple | int:
    return grow(TABLE)


def classify(features: tuple) -> int:
    node = tree()
    while not isinstance(node, int):
        f, cut, lo, hi = node
        node = lo if features[f] <= cut else hi
    return node


def _region(tag: str, attrs: str, outer: int) -> int:
    """The region that an element begins: boilerplate stays so inside; content inside boilerplate does not come back."""
    if outer == 2 or tag in _BOILER_TAGS:
        return 2
    hints: set[str] = set()
    if attrs and tag not in ("body", "html"):
        for m in _HINT.finditer(attrs):
            hints |= set(_WORDS.findall((m[1] or m[2] or m[3] or "").lower()))
        if _HIDDEN.search(attrs):
            return 2
    if not hints & _ABOUT and (hints & _STRONG_HINTS or any(part in h for h in hints for part in _STRONG_PARTS)):
        return 2
    if not hints & _ABOUT and hints & _BOILER_HINTS and not (tag in _CONTENT_TAGS or hints & _STORY_HINTS):
        return 2
    if tag in _CONTENT_TAGS or hints & _CONTENT_HINTS:
        return 1
    return outer


class Block(NamedTuple):
    text: str
    words: int
    links: int  # words in links
    region: int
    heading: int
    paragraph: int
    container: int  # the region of the containers alone


def _end_of(page: str, tag: str, pos: int, flat: set[str]) -> int:
    """Where an element that holds no text of the page ends: after its end tag or, if it has none, before the next block.

    An element that does not nest has no end tag if it begins again before. flat: elements that nest, but were found
    unbalanced on this page."""
    depth = 1
    for m in re.compile(rf"<(/?){re.escape(tag)}\b[^>]*?(/?)>", re.I).finditer(page, pos):
        if m[1]:
            depth -= 1
            if not depth:
                return m.end()
        elif tag in _VERBATIM or m[2]:
            continue
        elif tag in _NESTS and tag not in flat:
            depth += 1
        else:
            break
    else:
        flat.add(tag)
    if tag in ("script", "style"):
        return len(page)
    m = _BLOCK.search(page, pos)
    return m.start() if m else len(page)


def blocks(page: str) -> list[Block]:
    """A page's text blocks in page order, white space runs as one space."""
    out: list[Block] = []
    parts: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, int]] = []
    flat: set[str] = set()
    region = heading = paragraph = in_link = 0
    here: int | None = None  # the region of a block whose own tag tells

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                links = len(html.unescape(" ".join(linked)).split()) if linked else 0
                out.append(Block(text, text.count(" ") + 1, links, region if here is None else here, heading, paragraph, region))
        parts, linked = [], []

    pos, n = 0, len(page)
    while pos < n:
        m = _TOKEN.search(page, pos)
        chunk = page[pos : m.start()] if m else page[pos:]
        if chunk:
            parts.append(chunk)
            if in_link:
                linked.append(chunk)
        if not m:
            break
        pos = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing = bool(m[1] or m[4])
        if tag in _INLINE:
            if tag == "a":
                in_link = 0 if closing else 1
            elif tag == "br":
                parts.append(" ")
            continue
        flush()
        here, paragraph = None, 0
        if tag in _RAW:
            if not closing and not (m[3] or "").rstrip().endswith("/"):
                pos = _end_of(page, tag, pos, flat)
        elif tag == "head":
            if not closing and (end := re.compile(r"</head\b[^>]*>", re.I).search(page, pos)):
                pos = end.end()
        elif tag in _HEADINGS:
            heading = 0 if closing else 1
            here = _region(tag, m[3], region) if not closing and m[3] else None
        elif tag in _CONTAINERS:
            heading = in_link = 0
            if closing:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        region = stack[k][1]
                        del stack[k:]
                        break
            else:
                stack.append((tag, region))
                region = _region(tag, m[3] or "", region)
        else:
            heading, paragraph = 0, int(tag == "p" and not closing)
            here = _region(tag, m[3], region) if not closing and m[3] else None
    flush()
    return out


def features(found: list[Block]) -> list[tuple]:
    """What the tree sees of each block. Plain words are those outside boilerplate regions and links."""
    plain = [(b.words - b.links, b.container) for b in found if b.region != 2]
    share = round(100 * sum(n for n, container in plain if container == 1) / max(1, sum(n for n, _ in plain)))
    sizes = [(0, 0), *[(b.words, round(100 * b.links / b.words)) for b in found], (0, 0)]
    return [(*sizes[i], *sizes[i - 1], *sizes[i + 1], b.region, b.heading, b.paragraph, share) for i, b in enumerate(found, 1)]


def extract(page: str | None) -> str:
    """The blocks that the tree takes for main text, joined by two line feeds; empty if there are none."""
    found = blocks(page or "")
    return "\n\n".join(b.text for b, x in zip(found, features(found), strict=True) if classify(x))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every row.

    Null and empty pages have an empty text; pages cut off anywhere are read as far as they go, very long ones whole; null
    ids and urls come back as null; repeated rows each get a row. An empty table gives no rows. Other columns are not read.
    """
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.array([extract(h) for h in batch.column(2).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), text], names=["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, text string")
