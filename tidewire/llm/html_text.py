"""Main text of web pages by smoothed text-to-tag ratios (operator 12).

The standard library's streaming parser turns a page into events; no tree is built. Each block becomes a line with its
text, the tags read since the line before, and the element that holds it. The ratio of characters to tags per line is
smoothed by a Gaussian over the neighbouring lines; lines whose smoothed ratio is above the spread of all ratios of the
page form the content cluster. The cluster votes, by characters, for the element that holds the article:

* an ``article`` or ``main`` element, if there is one: the one with most of the cluster, then with most text;
* else the walk goes down from the page into the element that holds most of the cluster, while one does.

All lines of that element are the text, short ones too, so no paragraph is lost for its length. Where the walk ends at the
page itself, lines from the first to the last one of the cluster count, and the headings right before it.

Never text, wherever they stand: scripts, styles, comments of the markup, menus, page headers, footers, sidebars, forms,
hidden elements, and elements whose class, id or role names them as one of these, as a notice, an advert or as
readers' comments. Lists of three or more links and nothing else are menus.

Character references are decoded by the parser; white space inside a block (line breaks by ``br`` too) becomes one space;
blocks are joined by one line feed.

Defined results: a null or empty page, and one without text, gives an empty text; unclosed and stray tags close as a
browser would for blocks; a null id or url is carried; repeated rows are rows of their own; ties between elements go
to the first in page order; an empty table gives an empty result; extra columns are not carried, whatever their names."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Spread of the Gaussian in lines.
SMOOTHING = 1.5
#: Share of the cluster that an element must hold for the walk to go on into it.
MOST = 0.6

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead tr ul".split())
HOLDERS = frozenset("article body div main section table td".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BARRED = frozenset(
    "aside audio button canvas datalist dialog footer form head iframe map menu nav noscript object option script select "
    "style svg template textarea title video".split())
#: Words of a class, id or role that say what an element is for.
NAMES = frozenset(
    # menus, headers, footers
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pager pagination toolbar masthead topbar banner footer "
    "contentinfo copyright colophon "
    # sidebars
    "aside sidebar complementary rail widget widgets related recommended recommendations trending popular "
    # notices
    "notice notices notification alert cookie cookies consent gdpr popup modal overlay paywall newsletter subscribe "
    "subscription signup login dialog "
    # adverts
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promos promotion "
    # forms, sharing, comments of readers
    "form search share sharing social comment comments disqus discussion reply replies respond".split())
NOT_THIS = frozenset("has with no without not is".split())
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
#: A tag that the page breaks off in.
UNENDED = re.compile(r"<[A-Za-z/!?][^<>]*\Z")
#: Elements that an element of the same kind closes, and where the search for it ends.
SIBLINGS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"),
            "th": ("table", "tr"), "option": ("select",)}


def _names_boilerplate(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    for key, value in attrs:
        value = value or ""
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if key in ("class", "id", "role"):
            for name in value.split():
                words = [w.lower() for w in WORDS.findall(name)]
                if words and words[0] in NOT_THIS:
                    continue
                if tag == "article":  # an article can be a reader's comment, not a menu
                    words = [w for w in words if w in ("comment", "reply")]
                if NAMES.intersection(words) or words == ["header"]:
                    return True
    return False


class _Lines(HTMLParser):
    """Lines of a page: ``text, tags, link characters, holder, barred, kind of block``."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, bool, str]] = []
        self.kinds, self.parents = ["page"], [-1]
        self.open: list[tuple[str, bool, bool, int, str]] = []  # tag, and what held before it
        # Barred: now, and for the whole line; an element inside a line is left out of it and does not end it.
        self.barred, self.line_barred, self.holder, self.block = False, False, 0, "page"
        self.buffer: list[str] = []
        self.tags = self.linked = self.links = 0

    def updatepos(self, i: int, j: int) -> int:
        return j  # line numbers are not needed

    def flush(self) -> None:
        if self.buffer:
            text = " ".join("".join(self.buffer).split())
            if text:
                self.lines.append((text, max(1, self.tags), self.linked, self.holder, self.line_barred, self.block))
                self.tags = 0
            self.buffer, self.linked = [], 0

    def close_to(self, depth: int) -> None:
        while len(self.open) > depth:
            tag, barred, line_barred, holder, block = self.open.pop()
            if tag in BLOCKS:
                self.flush()
            if tag == "a":
                self.links -= 1
            self.barred, self.line_barred, self.holder, self.block = barred, line_barred, holder, block

    def find(self, tag: str, ends: tuple[str, ...] = (), over_blocks: bool = True) -> int:
        for depth in range(len(self.open) - 1, -1, -1):
            here = self.open[depth][0]
            if here == tag:
                return depth
            if here in ends or (not over_blocks and here in BLOCKS):
                return -1
        return -1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in BLOCKS:
            at = self.find("p", over_blocks=False)
            if at >= 0:
                self.close_to(at)
        if tag in SIBLINGS and (at := self.find(tag, SIBLINGS[tag])) >= 0:
            self.close_to(at)
        if tag in BLOCKS:
            self.flush()
        if tag in VOID:
            if tag == "br":
                self.buffer.append(" ")
            return
        barred = self.barred or tag in BARRED or (tag not in ("html", "body", "main") and _names_boilerplate(tag, attrs))
        if tag == "header" and not any(t[0] in ("article", "main") for t in self.open):
            barred = True
        self.open.append((tag, self.barred, self.line_barred, self.holder, self.block))
        if tag == "a":
            self.links += 1
        if tag in HOLDERS:
            self.kinds.append("main" if tag == "main" or ("role", "main") in attrs else tag)
            self.parents.append(self.holder)
            self.holder = len(self.kinds) - 1
        if tag in BLOCKS:
            self.block, self.line_barred = tag, barred
        self.barred = barred

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # as browsers do: the slash means nothing

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        at = self.find(tag, over_blocks=tag in BLOCKS or tag in BARRED)
        if at >= 0:
            self.close_to(at)
        elif tag in ("p", "br"):
            self.flush() if tag == "p" else self.buffer.append(" ")

    def handle_data(self, data: str) -> None:
        if self.barred and not self.line_barred:
            return
        self.buffer.append(data)
        if self.links:
            self.linked += len("".join(data.split()))


def smooth(ratios: np.ndarray, spread: float = SMOOTHING) -> np.ndarray:
    reach = math.ceil(2 * spread)
    kernel = np.exp(-np.arange(-reach, reach + 1) ** 2 / (2 * spread ** 2))
    return np.convolve(np.pad(ratios, reach, mode="edge"), kernel / kernel.sum(), mode="valid")


def _without_menus(lines: list[tuple]) -> list[tuple]:
    """Without runs of three or more list items that are links and nothing else."""
    out = []
    for menu, run in groupby(lines, key=lambda n: n[5] == "li" and n[2] >= len("".join(n[0].split()))):
        run = list(run)
        if not menu or len(run) < 3:
            out += run
    return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    page = _Lines()
    html = UNENDED.sub("", html)
    if html.rfind("<!--") > html.rfind("-->"):
        html = html[:html.rfind("<!--")]
    page.feed(html.replace("<![", "<! ["))  # marked sections are comments in web pages
    page.close()
    page.close_to(0)
    page.flush()
    lines = page.lines
    if not any(not line[4] for line in lines):
        return ""
    ratios = np.array([len(line[0]) / line[1] for line in lines])
    smoothed = smooth(ratios)
    content = (smoothed >= smoothed.std()) & np.array([not line[4] for line in lines])
    size, votes = [0] * len(page.kinds), [0] * len(page.kinds)
    for line, is_content in zip(lines, content.tolist()):
        at = -1 if line[4] else line[3]
        while at >= 0:
            size[at] += len(line[0])
            votes[at] += len(line[0]) if is_content else 0
            at = page.parents[at]
    best = [h for h, kind in enumerate(page.kinds) if kind in ("article", "main") and size[h]]
    if best:
        chosen = max(best, key=lambda h: (page.kinds[h] == "article", votes[h], size[h], -h))
        main = [h for h in best if page.kinds[h] == "main"]
        if main and votes[chosen] < MOST * max(votes[h] for h in main):
            chosen = max(main, key=lambda h: (votes[h], size[h], -h))
    else:
        chosen = 0
        while True:
            inside = [h for h, up in enumerate(page.parents) if up == chosen and votes[h] >= max(1, MOST * votes[chosen])]
            if not inside:
                break
            chosen = max(inside, key=lambda h: votes[h])
    held = [False] * len(page.kinds)
    held[chosen] = True
    for h in range(chosen + 1, len(held)):  # parents come before what they hold
        held[h] = held[page.parents[h]]
    kept = [i for i, line in enumerate(lines) if held[line[3]] and not line[4]]
    if page.kinds[chosen] in ("page", "body") and content.any():
        first, last = (int(i) for i in np.flatnonzero(content)[[0, -1]])
        while first - 1 in kept and lines[first - 1][5] in HEADINGS:
            first -= 1
        kept = [i for i in kept if first <= i <= last]
    return "\n".join(line[0] for line in _without_menus([lines[i] for i in kept]))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = pa.array([main_text(html) for html in batch.column("html").to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), texts], ["page_id", "url", "text"])


def extract_text(pages: DataFrame) -> DataFrame:
    """``page_id, url`` and the main ``text`` of each page: one pass, no shuffle, one page at a time in a task."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string")
