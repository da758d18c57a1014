"""Main text of web pages by tag-path ratios.

Each text block of a page lies on a tag path from the root.  For every path the text length
and the punctuation of its blocks are summed up and divided by their number; both ratios
are smoothed over the blocks in page order, fused into one score and averaged for each
path.  Blocks on paths over the threshold are content and all of them are returned, in page
order.  Other blocks are returned where they belong to content: those between content
blocks, or between the title and the first of them, and list items, table cells and the
like that go on from content; such a block must not be mostly links, unless it is a heading.
Elements that are menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles or reader comments by tag, role, class or id have no part in it; a class or an id
counts only if all its words speak for that.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Paths count as content from this share of the standard deviation of all scores.
THRESHOLD = 0.8
#: A block with more than this share of its text in links is mostly links.
LINKED = 0.5
SMOOTH = np.array([0.25, 0.5, 0.25])

# What the names of tags, roles, classes and ids stand for.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe select".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ITEMS = frozenset("li dd dt td th pre figcaption caption blockquote".split())
DROP_TAGS = frozenset("head nav header footer aside form menu dialog button label fieldset".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
DROP_NAMES = frozenset(
    "ad ads adbox adslot adunit advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promos promotion banner "
    "sidebar sidebars aside menu menus nav navbar navigation topnav subnav breadcrumb breadcrumbs header masthead footer cookie cookies consent gdpr notice "
    "notices notification notifications alert alerts popup modal overlay newsletter subscribe subscription signup login share sharing related "
    "comment comments commentlist commentbox disqus replies toolbar pagination pager skiplink paywall form".split()
)
#: Words that may stand beside them in a name: "site-footer" is a footer, "legal-notice-history" is no notice.
BESIDE = frozenset(
    "site page main global top bottom left right primary secondary fixed sticky list box bar item items slot unit block area wrap wrapper container "
    "content inner outer section panel widget row link links policy popup text the user reader post posts article articles story stories thread form".split()
)
KEEP_TAGS = frozenset("html body main article".split())
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tbody": {"tr", "td", "th", "thead"}, "tfoot": {"tr", "td", "th", "tbody"}, "body": {"head"},
}
#: Blocks that may be left open; every other block ends the search for one to close.
OPEN_BLOCKS = frozenset("li dt dd tr td th tbody thead tfoot p head".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_NAME = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*|=)(\s*=\s*)?")
_BARE = re.compile(r"[^\s>]*")
_PART = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_PUNCTUATION = re.compile(r"[.,;:!?…。、，]")


def _tells(name: str) -> bool:
    """Whether a class or an id names boilerplate."""
    parts = set(_PART.findall(_CAMEL.sub(" ", name).lower()))
    return not parts.isdisjoint(DROP_NAMES) and parts <= DROP_NAMES | BESIDE


def _marked(attrs: dict[str, str]) -> bool:
    """Whether the attributes of an element tell that it is boilerplate or hidden."""
    if not attrs:
        return False
    return (
        attrs.get("role", "").strip().lower() in DROP_ROLES
        or "hidden" in attrs
        or attrs.get("aria-hidden", "").lower() == "true"
        or "display:none" in attrs.get("style", "").replace(" ", "").lower()
        or any(map(_tells, attrs.get("class", "").split()))
        or any(map(_tells, attrs.get("id", "").split()))
    )


class _Page:
    """Elements (parent, tag, path, whether dropped) and text blocks of a page.

    One pass over the source, in time and memory that follow its length, whatever the depth.
    """

    def __init__(self, source: str) -> None:
        self.parent, self.tag, self.path, self.drop, self.main = [-1], ["#"], [0], [False], [False]
        self.blocks: list[tuple[int, str]] = []
        self.linked: list[float] = []  # share of each block's text in links
        self._paths: dict[tuple[int, str, str], int] = {}
        self._stack, self._blocks, self._open = [0], [0], Counter()  # open elements, those that are blocks, how many of each tag
        self._text: list[str] = []
        self._links = 0  # characters of the text that are in links
        self._read(source)
        self._flush()
        for e in range(len(self.tag) - 1, 0, -1):  # a wrapper of the article is not dropped for its class
            self.main[self.parent[e]] |= self.main[e]
        for e in range(1, len(self.tag)):
            wraps = self.main[e] and self.tag[e] not in DROP_TAGS
            self.drop[e] = (self.drop[e] and not wraps) or self.drop[self.parent[e]]

    def _read(self, source: str) -> None:
        at, end, quotes = 0, len(source), {'"': 0, "'": 0}  # of each quote the next place from where it was last looked for
        while at < end:
            to = source.find("<", at)
            if to != at:
                self._add(source[at : to if to >= 0 else end])
                if to < 0:
                    return
                at = to
            if source.startswith("<!--", at):
                to = source.find("-->", at + 4)
                at = end if to < 0 else to + 3
                continue
            if source.startswith("<![CDATA[", at):
                to = source.find("]]>", at)
                at = end if to < 0 else to + 3
                continue
            m = _TAG.match(source, at)
            if not m:
                if source.startswith(("<!", "<?", "</"), at):
                    to = source.find(">", at)
                    at = end if to < 0 else to + 1
                else:
                    self._add("<")
                    at += 1
                continue
            at, attrs = m.end(), {}
            while at < end and source[at] != ">":
                n = _NAME.match(source, at)
                if not n:
                    at += 1
                    continue
                at, value = n.end(), ""
                if n[2] and at < end:
                    quote = source[at]
                    if quote in quotes and quotes[quote] >= 0 and quotes[quote] <= at:
                        quotes[quote] = source.find(quote, at + 1)
                    if quote in quotes and quotes[quote] > at:
                        value, at = source[at + 1 : quotes[quote]], quotes[quote] + 1
                    else:
                        v = _BARE.match(source, at)
                        value, at = v[0], v.end()
                attrs.setdefault(n[1].lower(), value)
            if at >= end:
                return  # the tag has no end
            at += 1
            tag = m[2].lower()
            if m[1]:
                self._end(tag)
            elif tag in RAW:
                close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(source, at)
                at = close.end() if close else end
            else:
                self._start(tag, attrs)

    def _add(self, text: str) -> None:
        self._text.append(text)
        if self._open["a"]:
            self._links += len("".join(text.split()))

    def _flush(self) -> None:
        if self._text:
            raw = "".join(self._text)
            joined = " ".join(html_lib.unescape(raw).split())
            if joined:
                self.blocks.append((self._blocks[-1], joined))
                self.linked.append(self._links / max(1, len("".join(raw.split()))))
            self._text, self._links = [], 0

    def _end(self, tag: str) -> None:
        if self._open[tag]:
            e = self._stack[-1]
            while self.tag[e] != tag:
                self._pop()
                e = self._stack[-1]
            self._pop()
        elif tag in BLOCK:
            self._flush()

    def _pop(self) -> None:
        e = self._stack[-1]
        if self.tag[e] in BLOCK:
            self._flush()
            self._blocks.pop()
        self._stack.pop()
        self._open[self.tag[e]] -= 1

    def _start(self, tag: str, attrs: dict[str, str]) -> None:
        if tag == "br":
            self._text.append(" ")
            return
        if tag in BLOCK:
            self._flush()
        if tag in VOID:
            return
        if tag in BLOCK and self.tag[self._blocks[-1]] == "p":  # an open paragraph ends here
            self._end("p")
        closes = CLOSED_BY.get(tag, ())
        for e in reversed(self._blocks) if closes else ():
            if self.tag[e] in closes:
                while self._stack[-1] != e:
                    self._pop()
                self._pop()
                if tag not in ("tr", "tbody", "tfoot"):
                    break
            elif self.tag[e] not in OPEN_BLOCKS:
                break
        e, up = len(self.tag), self._stack[-1]
        first = attrs.get("class", "").split()[:1]
        self.parent.append(up)
        self.tag.append(tag)
        self.path.append(self._paths.setdefault((self.path[up], tag, first[0] if first else ""), len(self._paths) + 1))
        self.drop.append(tag in DROP_TAGS or (tag not in KEEP_TAGS and _marked(attrs)))
        self.main.append(tag in ("article", "main", "h1"))
        self._stack.append(e)
        self._open[tag] += 1
        if tag in BLOCK:
            self._blocks.append(e)


def _smoothed(x: np.ndarray) -> np.ndarray:
    return np.convolve(np.pad(x, 1, mode="edge"), SMOOTH, mode="valid")


def main_text(source: str | None) -> str:
    """The article of a page; empty if there is none."""
    if not source:
        return ""
    page = _Page(source)
    shown = [not page.drop[e] for e, _ in page.blocks]
    blocks = [b for b, ok in zip(page.blocks, shown, strict=True) if ok]
    linked = [x for x, ok in zip(page.linked, shown, strict=True) if ok]
    if not blocks:
        return ""
    paths, at = np.unique([page.path[e] for e, _ in blocks], return_inverse=True)
    size = np.array([len(t) for _, t in blocks], float)
    marks = np.array([len(_PUNCTUATION.findall(t)) for _, t in blocks], float)
    nodes = np.bincount(at, minlength=len(paths))
    length = (np.bincount(at, size) / nodes)[at]
    points = (np.bincount(at, marks) / nodes)[at]
    fused = _smoothed(length) * np.log1p(_smoothed(points) + 1)
    score = np.bincount(at, fused) / nodes
    content = (score >= min(THRESHOLD * fused.std(), score.max()))[at]
    return " ".join(t for (_, t), ok in zip(blocks, _joined(page, blocks, linked, content), strict=True) if ok)


def _joined(page: _Page, blocks: list[tuple[int, str]], linked: list[float], content: np.ndarray) -> np.ndarray:
    """The content blocks and those that belong to them."""
    tags = [page.tag[e] for e, _ in blocks]
    kept = content.copy()
    first, last = np.flatnonzero(content)[[0, -1]]
    title = next((i for i in range(first, -1, -1) if tags[i] == "h1"), first)
    for i in range(title, last):
        kept[i] |= linked[i] <= LINKED or tags[i] in HEADINGS
    held = np.bincount([blocks[i][0] for i in np.flatnonzero(kept)], minlength=len(page.tag)).tolist()
    for e in range(len(page.tag) - 1, 0, -1):
        held[page.parent[e]] += held[e]
    best = max(e for e in range(len(held)) if held[e] == held[0])  # the smallest element that holds all content
    if any(e == best for e, _ in blocks):
        best = max(0, page.parent[best])  # one block alone: the element it stands in
    inside = [e == best for e in range(len(page.tag))]
    for e in range(best + 1, len(page.tag)):
        inside[e] |= inside[page.parent[e]]
    for step, i in ((-1, title - 1), (1, last + 1)):
        while 0 <= i < len(blocks) and inside[blocks[i][0]] and linked[i] <= LINKED:
            if tags[i] not in ITEMS and not (step < 0 and tags[i] in HEADINGS):
                break
            kept[i] = True
            i += step
    return kept


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """For each page: id, url, text, n_chars; the whole html, null as empty.

    Repeated pages are extracted alike; other columns are ignored.
    """

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], ["id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(texts, "id long, url string, text string, n_chars long").withColumnRenamed("id", id_col)
