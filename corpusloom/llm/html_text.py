"""Main text of web pages from streaming parser events.

The standard library's parser feeds events to a small state machine that cuts the page into lines: a line is the text between
two block-level tags, with the number of tags met since the last one. Each line's text-to-tag ratio is smoothed with a
Gaussian and compared with the ratios' standard deviation; lines above it form clusters. Regions of the page that hold a cluster are
content, and a content region is kept whole, so short paragraphs and headings inside it stay.

Regions are the page's article and main elements, and outside them the runs of lines between boilerplate elements. What is
left out between two lines of one parent, a button or an aside in the text, does not part them. Article and main elements
bound the regions and the smoothing, no more: each needs a cluster of its own. An article inside main is a region apart, and what main
holds around its articles goes with any of them. An article inside an article is a comment on it, unless it has more text. A page's
only article or main element is kept besides if it has no cluster.

Elements of boilerplate tags are never content. Names (class, id, role) that hint at boilerplate are evidence: lines in such an
element are a region of their own with a lower ratio, and less is made of their length, the more such elements are around them. Those
regions are content whose level of hints has most text by that measure, of hinted ones the largest, and those with fewer hints; a
main element lifts hints.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, runs, ship

#: Fixed: elements whose text is never content; elements that end a line; elements without an end tag.
BOILERPLATE = frozenset("head nav header footer aside form script style noscript template iframe svg object select button textarea dialog menu".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Fixed: words of class, id and role values that hint at menus, adverts, notices, sidebars, teasers and comments.
MARKS = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer header masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promotion related replies reply respond share sharing sidebar social sponsor sponsored subscribe teaser teasers toolbar widget complementary contentinfo search".split())
MAIN = ("article", "main")
RADIUS, SIGMA = 2, 1.0
_KERNEL = [math.exp(-(d * d) / (2 * SIGMA * SIGMA)) for d in range(-RADIUS, RADIUS + 1)]
_WORD = re.compile(r"[a-z]+")
#: How far out one parent of two lines may be, seen from the line that is deeper.
_NEAR = 4


#: Fixed: elements whose start ends an open one of the same name, and those that keep it from looking further out.
ENDED = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
#: How sure it is that an element is no content: not at all, by so many hints, or for certain.
CONTENT, NEVER = 0, 1 << 30
#: What a hint leaves of a line's ratio, and of its length where levels of hints are compared.
RATIO, LENGTH = 0.3, 0.1
#: Fixed: blocks that hold a paragraph's text, not other blocks' texts.
TEXTS = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt blockquote pre figcaption figure caption td th summary address".split())


class Lines(HTMLParser):
    """Feeds on a page and gathers lines: (text, tags, main element or 0, hints, run).

    Open elements are a stack, and for each tag the places where it is open, so that an end tag finds its start without a walk."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, int]] = []
        self.stack: list[tuple[str, int, int, int]] = []  # tag, how sure it is no content from here on, main element, number
        self.open: dict[str, list[int]] = {}
        self.blocks: list[int] = []  # where elements are open that end a line, paragraphs left out
        self.parts: list[str] = []
        self.tags = self.mains = self.run = self.number = 0
        self.around: dict[int, int] = {}  # of an article: the article or main element around it, or 0
        self.base = {0: CONTENT}  # hints around an article or main element
        self.nested: set[int] = set()  # articles inside articles
        self.runs = 0
        self.last_lines: dict[tuple[int, int], tuple[int, list[int]]] = {}  # run and parents of the last line, by main element and hints

    def state(self) -> tuple[int, int]:
        return self.stack[-1][1:3] if self.stack else (CONTENT, 0)

    def cut(self) -> None:
        self.runs += 1
        self.run = self.runs

    def parents(self) -> list[int]:
        """Numbers of the innermost open elements around the line's own block, the page's among them."""
        open_ = [0] * (len(self.stack) <= _NEAR + 1) + [x[3] for x in self.stack[-_NEAR - 1 :]]
        return open_[:-1] if self.stack and self.stack[-1][0] in TEXTS else open_

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        self.parts.clear()
        if text:
            sure, main = self.state()
            if sure == NEVER:
                self.cut()
            else:
                around = self.parents()
                run, before = self.last_lines.get((main, sure), (self.run, around))
                if run != self.run and (around[-1] in before[-_NEAR:] or before[-1] in around[-_NEAR:]):
                    self.run = run  # something was left out, but either line stands right in what is around the other
                self.lines.append((text, self.tags, main, sure, self.run))
                self.last_lines[main, sure] = (self.run, around)
            self.tags = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        parts = tag in BLOCKS or tag in BOILERPLATE
        if parts:
            self.flush()
        elif tag == "br":
            self.parts.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        if tag == "p":  # a paragraph ends the one before it
            self.close_to("p", self.blocks[-1] if self.blocks else -1)
        elif tag in ENDED:
            self.close_to(tag, max(self.last(t) for t in ENDED[tag]))
        before, main = self.state()
        sure = before
        if tag in BOILERPLATE or (attrs and self.hidden(attrs)):
            sure = NEVER
        elif before != NEVER and tag == "main":
            sure = CONTENT
        elif before != NEVER and attrs and tag not in ("html", "body") and self.hinted(attrs):
            sure = before + 1
        if sure != NEVER and (tag == "article" or tag == "main" and not main):
            self.mains += 1
            if tag == "article":
                if main in self.around:
                    self.nested.add(self.mains)
                self.around[self.mains] = main
            main = self.mains
            self.base[main] = sure
        if parts or sure != before:
            if not parts:
                self.flush()
            if sure != before:
                self.cut()
            self.open.setdefault(tag, []).append(len(self.stack))
            if tag in BLOCKS and tag != "p":
                self.blocks.append(len(self.stack))
            self.number += 1
            self.stack.append((tag, sure, main, self.number))

    @staticmethod
    def hinted(attrs: list[tuple[str, str | None]]) -> bool:
        return any(value and name in ("class", "id", "role") and not MARKS.isdisjoint(_WORD.findall(value.lower())) for name, value in attrs)

    @staticmethod
    def hidden(attrs: list[tuple[str, str | None]]) -> bool:
        return any(name == "hidden" or (name == "aria-hidden" and value == "true") for name, value in attrs)

    def last(self, tag: str) -> int:
        """Where tag was opened last and is still open, or -1."""
        at = self.open.get(tag)
        return at[-1] if at else -1

    def close_to(self, tag: str, barrier: int) -> bool:
        """Closes the innermost open tag and what is open inside it, unless barrier is further in."""
        at = self.last(tag)
        if at < 0 or at < barrier:
            return False
        self.flush()
        changed = self.stack[at][1] != (self.stack[at - 1][1] if at else CONTENT)
        while len(self.stack) > at:
            name = self.stack.pop()[0]
            self.open[name].pop()
            if self.blocks and self.blocks[-1] == len(self.stack):
                self.blocks.pop()
        if changed:
            self.cut()
        return True

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS or tag in BOILERPLATE:
            self.flush()
        self.tags += 1
        # What is open outside an article or main element is not closed from inside it.
        self.close_to(tag, -1 if tag in MAIN or tag in ("body", "html") else max(self.last(t) for t in MAIN))

    def handle_data(self, data: str) -> None:
        self.parts.append(data)


def smoothed(ratios: list[float], areas: list) -> list[float]:
    """Each ratio with those around it in the same area."""
    out = []
    for i in range(len(ratios)):
        total = weight = 0.0
        for d in range(-RADIUS, RADIUS + 1):
            if 0 <= i + d < len(ratios) and areas[i + d] == areas[i]:
                total += ratios[i + d] * _KERNEL[d + RADIUS]
                weight += _KERNEL[d + RADIUS]
        out.append(total / weight)
    return out


def chosen_lines(page: Lines) -> list[bool]:
    """Which lines are content: those of the regions with a cluster, at the levels of hints that hold the text."""
    lines = page.lines
    # In an article or main element without further hints, all lines are one region.
    regions = [(main, sure, run if not main or sure > page.base[main] else 0) for _, _, main, sure, run in lines]
    ratios = smoothed([len(text) / max(1, tags) * RATIO ** min(sure, 9) for text, tags, _, sure, _ in lines], regions)
    mean = sum(ratios) / len(ratios)
    threshold = math.sqrt(sum((r - mean) ** 2 for r in ratios) / len(ratios))
    chosen = {g for g, r in zip(regions, ratios, strict=True) if r >= threshold}
    size = dict.fromkeys(regions, 0)
    for g, x in zip(regions, lines, strict=True):
        size[g] += len(x[0])
    own: dict[int, int] = {}  # what article and main elements hold apart from others in them
    for (main, *_), n in size.items():
        own[main] = own.get(main, 0) + n
    comments: set[int] = set()
    outer: dict[int, int] = {}  # the most that one of the articles around an article holds
    for m in sorted(page.nested):
        around = page.around[m]
        outer[m] = max(outer.get(around, 0), own.get(around, 0))
        if around in comments or outer[m] and own.get(m, 0) <= outer[m]:
            comments.add(m)
    chosen = {g for g in chosen if g[0] not in comments}
    whole = {g for g in regions if g[0] and not g[2] and g[0] not in comments}
    if len(whole) == 1:
        chosen |= whole
    chosen |= {(around, page.base[around], 0) for around in (page.around.get(g[0]) for g in chosen) if around}
    if not chosen:
        return [False] * len(lines)
    levels = sorted({g[1] for g in chosen})
    best = max(levels, key=lambda s: (sum(n for g, n in size.items() if g in chosen and g[1] == s) * LENGTH ** min(s, 9), -s))
    if best:  # what hints speak against is the page's text in one region only
        largest = max((g for g in chosen if g[1] == best), key=lambda g: size[g])
        chosen = {g for g in chosen if g[1] < best or g == largest}
    return [g in chosen and g[1] <= best for g in regions]


def main_text(html: str) -> str:
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    if not parser.lines:
        return ""
    return "\n".join(x[0] for x, keep in zip(parser.lines, chosen_lines(parser), strict=True) if keep)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in runs(batch.column(2)):
            part = batch.slice(a, b - a)
            texts = pa.array([main_text(h) if h else "" for h in part.column(2).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), texts], ["id", "url", "text"])


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id_col, url_col, text, n_chars for each row of pages; other columns are ignored, whatever their names.

    A null or empty html gives an empty text, as does a page of boilerplate alone. White space inside a line (a <br> too)
    becomes one space; lines are joined by a line break. Pages cut off anywhere give what comes before the cut. Repeated rows
    are extracted each; ids and urls, null or not, pass through. An empty table gives an empty result.
    """
    kinds = dict(pages.dtypes)
    rows = pages.select(column(pages, id_col).alias("id"), column(pages, url_col).cast("string").alias("url"), column(pages, html_col).cast("string").alias("html"))
    out = rows.mapInArrow(_extract, f"id {kinds[id_col]}, url string, text string")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))


ship(__name__)
