"""Main text of raw html by text-to-tag ratios over streaming parser events.

The standard library's parser streams a page's events.  Block tags cut the
page into lines; each line knows its text, the tags met on it, how much of the
text is links and the block it stands in.  Over all lines of the page that show
text, furniture too, the text-to-tag ratio is smoothed with a Gaussian and
clustered by a threshold (a fraction of the ratios' standard deviation).  The
lines above it are the content cluster; links, furniture elements (menus,
headers, footers, sidebars, forms; by element or role) and containers that a
class or id names as furniture never belong to it.  Inside an article or main
a container must bear no other name, and of a header the headings stay.

The cluster chooses the region: a page's one article if it has a line of the
cluster, else the articles (or articles and mains) if they hold half of its
text, else the smallest block around it, widened to its parent
while that adds no furniture and no list of links.  A region is kept whole, in
page order and short lines too, without its furniture elements; in a region
that is no article or main, blocks without a line of the cluster go if they are
mostly links, and divs before or after the cluster if the body is the region.

Row-wise work: one pass over the pages, no shuffle.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm import common

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark "
    "q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose text is no line of the page.
SILENT = frozenset(
    "head title script style noscript template button select textarea option svg iframe object "
    "canvas dialog audio video".split())
FURNITURE = frozenset("nav header footer aside form menu".split())
#: Elements that a stray end tag does not leave.
SECTIONS = frozenset("article main section div td body html".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert".split())
#: Class names and ids that name a container as furniture, also several joined
#: by hyphens or underscores ("cookie-notice", but not "related-work").
NAMES = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo promotion cookie cookies "
    "consent notice notices banner sidebar side menu nav navbar navigation breadcrumb "
    "breadcrumbs header masthead footer comment comments reply replies discussion share "
    "sharing social related recommended newsletter subscribe signup login popup modal "
    "overlay widget pagination pager toolbar disqus".split())
CONTAINERS = frozenset("div section article ul ol dl table center fieldset details".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARTS = re.compile(r"[-_]+")
UNFINISHED = re.compile(r"<[a-zA-Z/!?]")
#: Gaussian of the smoothing over neighbouring lines, and the threshold's
#: share of the standard deviation.
SIGMA, RADIUS, SHARE = 1.0, 2, 0.8
KERNEL = np.exp(-0.5 * (np.arange(-RADIUS, RADIUS + 1) / SIGMA) ** 2)


def is_furniture(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    return tag in FURNITURE or any(
        name == "hidden" or (name == "aria-hidden" and value == "true")
        or (name == "role" and value is not None and value.lower() in ROLES) for name, value in attrs)


def is_named(tag: str, attrs: list[tuple[str, str | None]], region: int) -> bool:
    """Whether a container's class or id names it as furniture: outside of
    articles and mains one of its names, inside all of them.  An article needs
    all of them anywhere, as a comment marked up as an article has."""
    if tag not in CONTAINERS:
        return False
    enough = all if region or tag == "article" else any
    return any(value and value.split() and name in ("class", "id")
               and enough(NAMES.issuperset(PARTS.split(token)) for token in value.lower().split())
               for name, value in attrs)


class Block(NamedTuple):
    """A block element: its place is its number, after its parent's."""
    tag: str
    parent: int
    furniture: bool  # it or a block around it is a furniture element
    named: bool  # as furniture
    region: int  # 0, 1 in a main, 2 in an article
    header: bool  # furniture only as a header in an article or main


class Line(NamedTuple):
    text: str
    tags: int
    linked: int  # characters inside links
    links: int
    block: int


class Lines(HTMLParser):
    """Collects the lines and blocks of a page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks = [Block("", 0, False, False, 0, False)]
        self.open: list[tuple[str, bool, int]] = []  # tag, silent, block
        self.lines: list[Line] = []
        self.text: list[str] = []
        self.tags = self.linked = self.links = self.anchors = 0

    def end_line(self):
        words = " ".join("".join(self.text).split())
        if words:
            self.lines.append(Line(words, self.tags, self.linked, self.links, self.open[-1][2] if self.open else 0))
        self.text.clear()
        self.tags = self.linked = self.links = 0

    def close_to(self, depth: int):
        self.anchors -= sum(name == "a" for name, _, _ in self.open[depth:])
        del self.open[depth:]

    def handle_starttag(self, tag, attrs):
        if tag not in INLINE:
            self.end_line()
            # a block that starts inside an open paragraph ends it
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] == "p":
                    self.close_to(k)
                    break
                if self.open[k][0] not in INLINE:
                    break
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        _, silent, block = self.open[-1] if self.open else ("", False, 0)
        furniture = is_furniture(tag, attrs)
        if tag in INLINE:
            silent = silent or furniture
            self.anchors += tag == "a"
            self.links += tag == "a"
        else:
            silent = silent or tag in SILENT
            around = self.blocks[block]
            named = is_named(tag, attrs, around.region)
            own = 2 if tag == "article" and not named else 1 if tag == "main" else 0
            header = bool(around.region) and (
                around.header and not furniture or tag == "header" and not around.furniture)
            furniture = (around.furniture or furniture) and not (header and tag in HEADINGS)
            self.blocks.append(Block(tag, block, furniture, named, max(around.region, own), header))
            block = len(self.blocks) - 1
        self.open.append((tag, silent, block))

    def handle_endtag(self, tag):
        if tag not in INLINE:
            self.end_line()
        self.tags += 1
        for k in range(len(self.open) - 1, -1, -1):
            name = self.open[k][0]
            if name == tag:
                self.close_to(k)
                return
            if name in SECTIONS and (tag in INLINE or tag == "p"):
                return  # a stray end tag does not leave its section

    def handle_data(self, data):
        if not (self.open and self.open[-1][1]):
            self.text.append(data)
            if self.anchors:
                self.linked += len(" ".join(data.split()))


def lines_of(html: str) -> tuple[list[Line], list[Block]]:
    parser = Lines()
    parser.feed(html)
    if UNFINISHED.match(parser.rawdata):
        parser.rawdata = ""  # a tag or comment that the page's end cuts off
    parser.close()
    parser.end_line()
    return parser.lines, parser.blocks


def cluster(lines: list[Line], free: list[int]) -> list[int]:
    """The lines of `free` whose smoothed ratio lies above the threshold; the
    ratios are those of all lines."""
    ratio = np.array([len(x.text) / max(1, x.tags) for x in lines])
    weight = np.convolve(np.ones(len(lines)), KERNEL)[RADIUS:-RADIUS]
    smooth = np.convolve(ratio, KERNEL)[RADIUS:-RADIUS] / weight
    cut = min(SHARE * smooth.std(), smooth[free].max())
    # above the threshold, and not by its neighbours' text alone
    above = (smooth >= cut) & (ratio >= cut / 4)
    return [i for i in free if above[i]] or [max(free, key=lambda i: ratio[i])]


def mostly_links(chars: int, linked: int, links: int) -> bool:
    return links > 1 and 2 * linked > chars


def main_text(html: str) -> str:
    """The content lines of a page, joined by newlines; empty if there are none."""
    lines, blocks = lines_of(html)
    size = len(blocks)
    named = [False] * size
    for i, b in enumerate(blocks):
        named[i] = named[b.parent] or b.named
    shown = [i for i, x in enumerate(lines) if not blocks[x.block].furniture]
    free = [i for i in shown if not named[lines[i].block]]
    if not free:  # names tell furniture from other text only where there is some
        named, free = [False] * size, shown
    free = [i for i in free if 2 * lines[i].linked <= len(lines[i].text)] or free
    if not free:
        return ""
    seeds = cluster(lines, free)
    total = sum(len(lines[i].text) for i in seeds)
    articles = sum(b.region == 2 and blocks[b.parent].region < 2 for b in blocks)
    for least in (2, 1):
        alone = least == 2 and articles == 1 and any(blocks[lines[i].block].region == 2 for i in seeds)
        if alone or 2 * sum(len(lines[i].text) for i in seeds if blocks[lines[i].block].region >= least) >= total:
            return "\n".join(lines[i].text for i in shown
                             if blocks[lines[i].block].region >= least and not named[lines[i].block])

    # per block, with all that stands in it: characters, linked ones, links, lines of the cluster, furniture
    sums = np.zeros((size, 5), np.int64)
    for i, x in enumerate(lines):
        sums[x.block, :3] += (len(x.text), x.linked, x.links)
        sums[x.block, 4] += blocks[x.block].furniture or named[x.block]
    for i in seeds:
        sums[lines[i].block, 3] += 1
    for i in range(size - 1, 0, -1):
        sums[blocks[i].parent] += sums[i]
    region = max(i for i in range(size) if sums[i, 3] == len(seeds))
    while region and blocks[region].tag not in ("body", "html"):
        around = blocks[region].parent
        chars, linked, links, _, furniture = (sums[around] - sums[region]).tolist()
        if blocks[around].tag in ("", "body", "html") or furniture or mostly_links(chars, linked, links):
            break
        region = around

    first, last = seeds[0], seeds[-1]
    begin, end = [len(lines)] * size, [-1] * size
    for i, x in enumerate(lines):
        begin[x.block], end[x.block] = min(begin[x.block], i), i
    for i in range(size - 1, 0, -1):
        j = blocks[i].parent
        begin[j], end[j] = min(begin[j], begin[i]), max(end[j], end[i])
    whole = blocks[region].tag in ("", "body", "html")
    alike = {blocks[i].tag for i in range(1, size) if blocks[i].parent == region and sums[i, 3]}
    # per block: 2 is kept whole, 1 holds lines of the cluster, 0 goes
    state = [0] * size
    state[region] = 1
    for i in range(region + 1, size):
        b = blocks[i]
        if state[b.parent] != 1:
            state[i] = state[b.parent]
        elif sums[i, 3]:
            state[i] = 1
        elif not mostly_links(*sums[i, :3].tolist()):
            apart = whole and b.parent == region and b.tag in ("div", "section") and b.tag not in alike
            state[i] = 0 if apart and (end[i] < first or begin[i] > last) else 2
    chosen = set(seeds)
    title = {i for i in shown if blocks[lines[i].block].tag == "h1"}
    return "\n".join(
        lines[i].text for i in shown if not named[lines[i].block] and (
            i in chosen or i in title or state[lines[i].block] == 2
            or (state[lines[i].block] == 1 and not mostly_links(len(lines[i].text), *lines[i][2:4]))))


def extract(pages: DataFrame, rows: int = 256) -> DataFrame:
    """One row per input row: page_id, url, text, n_chars (code points).

    Null html counts as empty and gives an empty text, as do pages of nothing
    but furniture.  Repeated rows are extracted one by one; extra columns are
    ignored; an empty table gives an empty result.
    """
    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, rows):
                part = batch.slice(i, rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1),
                     pa.array([main_text(h or "") for h in part.column(2).to_pylist()],
                              pa.string())], names=["page_id", "url", "text"])

    out = common.small_batches(common.only(pages, page_id="long", url="string", html="string")).mapInArrow(
        run, "page_id long, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
