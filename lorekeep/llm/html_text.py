"""Main text of web pages: parser events, text-to-tag ratios, smoothing and threshold clustering.

The standard library's parser streams events. Block tags cut the page into lines; each line has its text, the number of
tags that it holds, how much of its text is links, and the elements that it lies in. Lines in elements that are never an
article's text (scripts, menus, footers, forms and the like, or such by role) are put aside. The ratios of text to tags of
the other lines are smoothed with a Gaussian along the page, and a threshold parts them into two clusters, content and the
rest: the one that a share of the ratios' spread gives, or the widest gap between the clusters' means (two means), whichever
is lower.

Clusters decide, tags and names only weigh. The content region is the named region (article, main) that holds the most
content, as long as no other element holds far more; else the deepest element that holds nearly all content. An element
that its class or id marks as no article's text stays out, unless the content lies in it. In the region, a run of lines
that the clusters call no content goes if its text is mostly links: a menu. Other short lines belong to the article like
its long ones. Without a named region the article reaches from the first content line, or the heading before it, to the
last.

Defined results: a null or empty page has an empty text; a page of any length is read whole, in linear time; a page that
ends in the middle of an element, tag or reference is read up to there; equal pages give equal texts; an empty table gives
an empty table; only the id, url and html columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import in_batches

#: HTML's elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
NEVER = frozenset("aside button canvas datalist dialog footer form head iframe menu nav noembed noframes noscript object script select style svg template textarea title".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
REGION = frozenset(("article", "main"))
ENDS_WITH_SIBLING = {
    "p": BLOCK - {"html", "body", "head", "title"},
    "li": frozenset(("li",)),
    "dt": frozenset(("dt", "dd")),
    "dd": frozenset(("dt", "dd")),
    "tr": frozenset(("tr", "tbody", "thead", "tfoot")),
    "td": frozenset(("td", "th", "tr", "tbody", "thead", "tfoot")),
    "th": frozenset(("td", "th", "tr", "tbody", "thead", "tfoot")),
    "option": frozenset(("option", "optgroup")),
    "head": frozenset(("body",)),
}
#: Words of class, id and role names that mark what is not the article.
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer form gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion recommended related replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
ASIDE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
NAME_PARTS = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")
SPACE = re.compile(r"\s+")

SIGMA = 1.5
THRESHOLD = 0.5
MOST = 0.8
FAR_MORE = 4.0  # content outside of the named region, for it not to be the region
LINKED = 0.5  # share of a line's text in links


@lru_cache(maxsize=4096)
def marks_aside(names: str) -> bool:
    return any(w.lower() in ASIDE_WORDS for w in NAME_PARTS.split(names))


class Line:
    __slots__ = ("inside", "aside", "heading", "parts", "tags", "linked")

    def __init__(self, inside: int, aside: bool, heading: bool):
        self.inside, self.aside, self.heading, self.parts, self.tags, self.linked = inside, aside, heading, [], 0, 0


class LineReader(HTMLParser):
    """Collects lines. Elements are numbers; ``parent`` and ``tag_of`` describe them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parent, self.tag_of = [-1], [""]
        self.open: list[tuple[int, str, bool, bool]] = [(0, "", False, False)]  # element, tag, aside, heading
        self.lines: list[Line] = []
        self.line: Line | None = None
        self.suspects: set[int] = set()
        self.anchors = 0  # links that are open

    def cut(self) -> None:
        self.line = None

    def current(self) -> Line:
        if self.line is None:
            element, _, aside, heading = self.open[-1]
            self.line = Line(element, aside, heading)
            self.lines.append(self.line)
        return self.line

    def is_aside(self, tag: str, attrs: list[tuple[str, str | None]], regions: bool) -> bool:
        if tag in NEVER or tag == "header" and not regions:
            return True
        if tag in ("html", "body", "main"):
            return False
        for name, value in attrs:
            if name == "role" and (value or "").lower() in ASIDE_ROLES or name == "hidden" or name == "aria-hidden" and (value or "").lower() == "true":
                return True
        return False

    def is_suspect(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        """Class and id words are evidence: ``put_aside`` weighs it against what the element holds."""
        if tag in ("html", "body", "main") or tag in HEADING:
            return False
        return any(name in ("class", "id") and value and marks_aside(value) for name, value in attrs)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        while (ends := ENDS_WITH_SIBLING.get(self.open[-1][1])) and tag in ends:
            self.open.pop()
            self.cut()
        if tag in BLOCK:
            self.cut()
        if tag == "br":
            self.current().parts.append(" ")
        if tag in VOID:
            if self.line:
                self.line.tags += 1
            return
        top = self.open[-1]
        inside_region = any(t in REGION for _, t, _, _ in self.open) if tag == "header" else False
        aside = top[2] or self.is_aside(tag, attrs, inside_region)
        suspect = not aside and self.is_suspect(tag, attrs)
        if tag in BLOCK or aside and not top[2] or suspect:
            self.parent.append(top[0])
            self.tag_of.append(tag)
            element = len(self.parent) - 1
            if suspect:
                self.suspects.add(element)
        else:
            element = top[0]
        if aside and not top[2] or suspect:
            self.cut()
        self.open.append((element, tag, aside, top[3] or tag in HEADING))
        self.anchors += tag == "a"
        if self.line:
            self.line.tags += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCK:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.cut()
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][1] == tag:
                if any(a or e in self.suspects for e, _, a, _ in self.open[i:]):
                    self.cut()
                self.anchors -= sum(t == "a" for _, t, _, _ in self.open[i:])
                del self.open[i:]
                return
            if self.open[i][1] in BLOCK and tag not in BLOCK:
                return  # an inline end tag does not end blocks

    def handle_data(self, data: str) -> None:
        if self.line is not None or data.strip():
            line = self.current()
            line.parts.append(data)
            line.linked += len(data.strip()) if self.anchors else 0


def smoothed(values: np.ndarray, sigma: float) -> np.ndarray:
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    padded = np.pad(values, reach, mode="constant")
    weight = np.pad(np.ones(len(values)), reach, mode="constant")
    return np.convolve(padded, kernel, mode="valid") / np.convolve(weight, kernel, mode="valid")


def threshold(ratio: np.ndarray) -> float:
    """Where smoothed ratios part into content and the rest: a share of their spread, or halfway between the means of two
    clusters if that is lower (a page of long and short lines alike has a wide spread). Equal ratios are all content."""
    low, high = float(ratio.min()), float(ratio.max())
    for _ in range(50):
        middle = (low + high) / 2
        below, above = ratio[ratio < middle], ratio[ratio >= middle]
        if not len(below):
            return 0.0
        now = float(below.mean()), float(above.mean())
        if now == (low, high):
            break
        low, high = now
    return min(THRESHOLD * float(ratio.std()), (low + high) / 2)


def sums(reader: LineReader, lines: list[Line], values: np.ndarray) -> np.ndarray:
    """What lies in each element, with all that is inside of it."""
    held = np.zeros(len(reader.parent))
    np.add.at(held, [line.inside for line in lines], values)
    for e in range(len(reader.parent) - 1, 0, -1):  # children have larger numbers
        held[reader.parent[e]] += held[e]
    return held


def region_of(reader: LineReader, held: np.ndarray, free: np.ndarray) -> int:
    """The element that the article lies in, by the content that elements hold: 0 is the whole page. ``free`` are those
    that no name marks, or that content clears."""
    named = [e for e in range(1, len(reader.parent)) if reader.tag_of[e] in REGION and held[e] > 0 and free[e]]
    best = max(named, key=lambda e: (held[e], -e), default=0)
    if best and held[0] - held[best] <= FAR_MORE * held[best]:
        return best
    best = 0
    for e in range(1, len(reader.parent)):
        if reader.parent[e] == best and held[e] >= MOST * held[0] > 0 and reader.tag_of[e] not in ("p", *HEADING, "li", "td"):
            best = e
    return best


def put_aside(reader: LineReader, lines: list[Line], content: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Elements that their names mark as aside, and what lies in them. A name is overruled if the element is or holds the
    named region with the most content, or most of the page's content, or is a section within a region with a heading and
    a content line."""
    size = len(reader.parent)
    aside = np.zeros(size, dtype=bool)
    if not reader.suspects:
        return aside
    text = np.array([not line.heading for line in lines])
    held = sums(reader, lines, np.where(content, lengths, 0.0))
    best = sums(reader, lines, (content & text).astype(float)) > 0
    titled = sums(reader, lines, (~text).astype(float)) > 0
    e = max((e for e in range(1, size) if reader.tag_of[e] in REGION and held[e] > 0), key=lambda e: (held[e], -e), default=0)
    around = set()
    while e > 0:
        around.add(e)
        e = reader.parent[e]
    within = np.zeros(size, dtype=bool)
    for e in range(1, size):
        up = reader.parent[e]
        within[e] = within[up] or reader.tag_of[up] in REGION
        cleared = e in around or held[e] >= MOST * held[0] > 0 or within[e] and reader.tag_of[e] == "section" and titled[e] and best[e]
        aside[e] = aside[up] or e in reader.suspects and not cleared
    return aside


def clustered(lines: list[Line], lengths: np.ndarray, sigma: float) -> np.ndarray:
    """Which lines are content, by the smoothed ratios of text to tags."""
    ratio = smoothed(lengths / np.maximum(1, [line.tags for line in lines]), sigma)
    return ratio >= threshold(ratio)


def main_text(html: str | None, sigma: float = SIGMA) -> str:
    """The article's text. ``sigma`` is the width of the smoothing, in lines."""
    if not html:
        return ""
    reader = LineReader()
    reader.feed(html)
    reader.close()
    found = [(line, text) for line in reader.lines if not line.aside and (text := SPACE.sub(" ", "".join(line.parts)).strip())]
    if not found:
        return ""
    lengths = np.array([len(t) for _, t in found], dtype=float)
    content = clustered([line for line, _ in found], lengths, sigma)
    aside = put_aside(reader, [line for line, _ in found], content, lengths)
    keep = [i for i, (line, _) in enumerate(found) if not aside[line.inside]]
    if not keep:
        return ""
    found, lengths = [found[i] for i in keep], lengths[keep]
    lines = [line for line, _ in found]
    content = clustered(lines, lengths, sigma)
    region = region_of(reader, sums(reader, lines, np.where(content, lengths, 0.0)), ~aside)
    inside = np.zeros(len(reader.parent), dtype=bool)
    for e in range(len(reader.parent)):
        inside[e] = e == region or e > 0 and inside[reader.parent[e]]
    member = inside[[line.inside for line in lines]]
    if reader.tag_of[region] not in REGION:
        # nothing says where the article ends: its lines are those from the first content line, or the heading before it, to the last
        on = np.flatnonzero(content & member)
        first, last = (on[0], on[-1]) if len(on) else (0, len(found) - 1)
        while first and lines[first - 1].heading and member[first - 1]:
            first -= 1
        member[:first] = False
        member[last + 1 :] = False
    member &= content | (np.array([line.linked for line in lines]) < LINKED * lengths)
    return "\n".join(t for (_, t), keep in zip(found, member, strict=True) if keep)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = [main_text(h) for h in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": text, "n_chars": [len(t) for t in text]})

    kind = pages.schema[key].dataType.simpleString()
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    return in_batches(rows).mapInPandas(run, f"page_id {kind}, url string, text string, n_chars long")
