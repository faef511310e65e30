"""Main text of web pages: parser events, text-to-tag ratio by line, Gaussian smoothing, threshold clustering."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, slices, text_or_empty

_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre "
    "section summary table tbody td tfoot th thead title tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never the article's.
_NEVER = frozenset("head title script style noscript template nav footer aside button select option textarea input iframe object svg canvas audio video map dialog menu".split())
#: Elements that end an open paragraph.
_ENDS_P = _BLOCKS - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "li", "dd", "dt", "title"}
_CONTENT = frozenset(("article", "main"))
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: Blocks that are no containers: lines in them belong to the container around.
_INNER = frozenset(("p", "li", *_HEADINGS, "blockquote", "pre", "td", "tr", "th", "dd", "dt", "ul", "ol", "dl"))
#: Words in a class or id that name boilerplate: such as brings whole paragraphs of its own, and such as holds little but links.
_THICK = frozenset(
    "ad ads adv advert adverts advertisement advertising byline-share comment comments commentlist consent cookie cookies copyright disqus gdpr newsletter notice notices alert popup promo promos promoted "
    "recommend recommended recommendations related replies reply respond signup sponsor sponsored subscribe teaser".split()
)
_THIN = frozenset("banner breadcrumb breadcrumbs footer masthead menu modal nav navbar navigation pager pagination paginator share sharing sidebar side skip social toolbar topbar header widget widgets".split())
_WORDS = re.compile(r"[^\s_-]+")
#: Words that, before or after one of those in a token, make it say how an element is laid out, not what it is.
_WITH = frozenset("with without has have no not non hide show".split())
_STATES = frozenset("open opened closed enabled disabled on off".split())
#: Words that make a header the one of the article.
_OWN_HEADER = frozenset("entry article post story content".split())
_THIN_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar".split())
_THICK_ROLES = frozenset("dialog alert alertdialog".split())
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _marked(names: str, in_content: bool) -> str:
    """What the tokens of a class and id prove: "thick" or "thin" boilerplate, or nothing (empty)."""
    proof = ""
    for token in names.lower().split():
        words = _WORDS.findall(token)
        if "byline-share" in token:
            return "thick"
        for i, word in enumerate(words):
            if _WITH.intersection(words[:i]) or (i + 1 < len(words) and words[i + 1] in _STATES):
                continue
            if word in _THICK:
                return "thick"
            if word in _THIN and not (word == "header" and (in_content or _OWN_HEADER.intersection(words[:i]))):
                proof = "thin"
    return proof


class _Line:
    """A run of text between block borders: its text, tags within, linked characters, the marked elements, the content elements and the container it is in."""

    __slots__ = ("parts", "tags", "linked", "marks", "region", "contents", "heading", "text")

    def __init__(self, marks: tuple[int, ...], region: int, contents: tuple[int, ...], heading: str):
        self.parts: list[str] = []
        self.tags, self.linked = 0, 0
        self.marks, self.region, self.contents, self.heading = marks, region, contents, heading
        self.text = ""

    @property
    def unlinked(self) -> int:
        return max(0, len(self.text) - self.linked)


class _Open(NamedTuple):
    """An open element, with what it takes over from those around it."""

    tag: str = ""
    never: bool = False
    marks: tuple[int, ...] = ()
    region: int = 0
    contents: tuple[int, ...] = (0,)
    heading: str = ""


class _Lines(HTMLParser):
    """Turns parser events into lines; nothing but the open elements, the containers and the lines is kept."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[_Line] = []
        self.stack: list[_Open] = [_Open()]
        self.count = 0
        self.parent: dict[int, int] = {}  # of each container
        self.kind: dict[int, str] = {0: "body"}  # of containers that are named: body, article, main
        self.thin: dict[int, int] = {}  # marked elements, with the content element (or page) that they must hold most of to count as its wrapper
        self.thick: set[int] = set()
        self.anchored: set[int] = set()  # marked elements that hold the page's main heading or element
        self.titles: list[int] = []  # the containers of main headings
        self.line: _Line | None = None
        self.anchors = 0

    def _ends(self, names: frozenset[str] | set[str], borders: frozenset[str]) -> None:
        """Close the nearest open element of ``names`` unless one of ``borders`` stands in between."""
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in names:
                del self.stack[i:]
                return
            if self.stack[i].tag in borders:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _BLOCKS:
            self.line = None
            if tag in _ENDS_P:
                self._ends({"p"}, frozenset(("td", "th", "div", "article", "section", "body")))
            if tag in ("li", "td", "th", "tr", "dd", "dt"):
                self._ends({tag}, frozenset(("ul", "ol", "dl", "table")) if tag != "td" else frozenset(("table", "tr")))
        elif tag == "br":
            if self.line:
                self.line.parts.append("\n")
        elif self.line:
            self.line.tags += 1
        if tag == "a":
            self.anchors += 1
        if tag in _VOID:
            return
        self.count += 1
        above = self.stack[-1]
        own = dict(attrs)
        role = own.get("role")
        hidden = "hidden" in own or own.get("aria-hidden") == "true" or bool(_HIDDEN.search(own.get("style") or ""))
        never = above.never or tag in _NEVER or (hidden and tag not in ("html", "body"))
        region, contents, marks = above.region, above.contents, above.marks
        if tag in _BLOCKS and tag not in _INNER:
            region = self.count
            self.parent[region] = above.region
            if tag in ("html", "body"):
                self.kind[region] = "body"
        if tag not in ("html", "body"):
            words = f"{own.get('class') or ''} {own.get('id') or ''}"
            proof = _marked(words, len(contents) > 1) if words.strip() else ""
            header = tag == "header" and len(contents) == 1 and not any(_OWN_HEADER.intersection(_WORDS.findall(t)) for t in words.lower().split() if t.endswith("header"))
            if proof == "thick" or role in _THICK_ROLES:
                marks = (*marks, self.count)
                self.thick.add(self.count)
            elif proof or header or tag == "form" or role in _THIN_ROLES:
                marks = (*marks, self.count)
                self.thin[self.count] = contents[-1]
        content = "main" if tag == "main" or role == "main" else "article" if tag == "article" or role == "article" or own.get("itemprop") == "articleBody" else ""
        if content:
            if region != self.count:
                region = self.count
                self.parent[region] = above.region
            self.kind[region] = content
            contents = (*contents, region)
        if tag == "h1" or content == "main":
            self.anchored.update(marks)
        if tag == "h1" and not never:
            self.titles.append(region)
        self.stack.append(_Open(tag, never, marks, region, contents, tag if tag in _HEADINGS else above.heading))

    def handle_endtag(self, tag: str) -> None:
        if tag in _BLOCKS:
            self.line = None
        if tag == "a":
            self.anchors = max(0, self.anchors - 1)
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                return

    def handle_data(self, data: str) -> None:
        now = self.stack[-1]
        if now.never or (self.line is None and not data.strip()):
            return
        if self.line is None:
            self.line = _Line(now.marks, now.region, now.contents, now.heading)
            self.lines.append(self.line)
        self.line.parts.append(data)
        if self.anchors:
            self.line.linked += len(data.strip())

    def finished(self) -> list[_Line]:
        """The lines that hold text, white space in them made single blanks."""
        for m in self.lines:
            m.text = " ".join("".join(m.parts).split())
            m.parts = []
        return [m for m in self.lines if m.text]


def smoothed(ratio: np.ndarray, sigma: float = 1.5) -> np.ndarray:
    """``ratio`` under a Gaussian window of ``sigma`` lines, weights renormalised at the ends."""
    reach = int(np.ceil(2 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    middle = slice(reach, reach + len(ratio))
    return np.convolve(ratio, kernel)[middle] / np.convolve(np.ones(len(ratio)), kernel)[middle]


def split_level(values: np.ndarray) -> float:
    """The threshold between two clusters of values (2-means in one dimension); minus infinity if they hardly differ."""
    low, high = values.min(), values.max()
    if high <= 2 * low:
        return -np.inf
    for _ in range(50):
        level = (low + high) / 2
        new = values[values <= level].mean(), values[values > level].mean()
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def _wrappers(parser: _Lines, lines: list[_Line]) -> set[int]:
    """Marked elements that are no boilerplate but hold the article.

    A thin one (a menu, a header, a form by its name) does if most of the unlinked text of the page, or
    of the content element around it, stands in it. A thick one (comments, adverts) may have more text
    than the article, so it has to hold the main heading too, or all there is.
    """
    held: dict[int, int] = {}
    total: dict[int, int] = {}
    every = 0
    for m in lines:
        weight = m.unlinked
        every += weight
        if not parser.thick.intersection(m.marks):
            for c in m.contents:
                total[c] = total.get(c, 0) + weight
        for x in m.marks:
            held[x] = held.get(x, 0) + weight
    free = {x for x in parser.thick if 2 * held.get(x, 0) > every and (x in parser.anchored or held[x] == every)}
    if free:  # what they hold counts for the thin ones as well
        total = {}
        for m in lines:
            if free.issuperset(parser.thick.intersection(m.marks)):
                for c in m.contents:
                    total[c] = total.get(c, 0) + m.unlinked
    return free | {x for x, c in parser.thin.items() if 2 * held.get(x, 0) > total.get(c, 0)}


#: The share of all dense text that a container must hold for the article to be looked for in it alone; less if it is a named content element or holds the only main heading.
#: And the share that may stand, beside containers, directly in those around it, unless the inner one is a named content element.
_MOST, _HINTED, _BESIDE = 0.8, 0.5, 0.05


def _container(parser: _Lines, weight: dict[int, int]) -> tuple[int, set[int]]:
    """The innermost container that holds nearly all dense text, and all containers within it. ``weight``: dense text directly in each."""
    whole = {0: weight.get(0, 0)} | {r: weight.get(r, 0) for r in parser.parent}
    inner: dict[int, list[int]] = {}
    for r in sorted(parser.parent, reverse=True):  # a container's number is larger than that of the one around
        whole[parser.parent[r]] += whole[r]
        inner.setdefault(parser.parent[r], []).append(r)
    titled, up = set(), parser.titles[0] if len(parser.titles) == 1 else 0
    while up:
        titled.add(up)
        up = parser.parent[up]
    at, beside = 0, 0
    while parser.kind.get(at) != "article" and at in inner:
        beside += weight.get(at, 0)
        for best in sorted(inner[at], key=lambda r: (r not in titled, -whole[r], r))[:2]:  # the one with the heading, then the one with most
            named = parser.kind.get(best) in _CONTENT
            share = _HINTED if named or best in titled else _MOST
            if whole[best] > 0 and whole[best] >= whole[0] * share and (named or beside <= whole[0] * _BESIDE):
                at = best
                break
        else:
            break
    within, more = set(), [at]
    while more:
        r = more.pop()
        within.add(r)
        more += inner.get(r, ())
    return at, within


def main_text(html: str, sigma: float = 1.5) -> str:
    """The article of a page, blocks joined by one space; empty if there is none.

    Lines are dense if their text-to-tag ratio is in the upper cluster, by itself and smoothed over its
    neighbours. The article is looked for in the innermost container with nearly all dense text: an
    article element is taken whole; of another container all but parts without a dense line at its
    ends; of a bare page the parts with dense lines. Names of elements and classes are hints: what they
    call boilerplate is left out unless it wraps the article, what they call content needs less of the
    dense text.
    """
    parser = _Lines()
    parser.feed(html)
    parser.close()
    lines = parser.finished()
    free = _wrappers(parser, lines)
    live = [m for m in lines if free.issuperset(m.marks)]
    if not live:
        return ""
    ratio = np.array([m.unlinked / (1 + m.tags) for m in live])
    near = smoothed(ratio, sigma)
    dense = (np.sqrt(near) > split_level(np.sqrt(near))) & (np.sqrt(ratio) > max(split_level(np.sqrt(ratio)), 0))
    weight: dict[int, int] = {}
    for m, d in zip(live, dense):
        if d:
            weight[m.region] = weight.get(m.region, 0) + m.unlinked
    at, within = _container(parser, weight)
    inside = np.array([m.region in within for m in live])
    hits = np.flatnonzero(dense & inside)
    if not len(hits):  # nothing but links: what the page calls its content, if it does
        named = {r for r, k in parser.kind.items() if k in _CONTENT}
        return " ".join(m.text for m in live if named.intersection(m.contents))
    if parser.kind.get(at) == "article":
        keep = inside
    else:
        bare = parser.kind.get(at) == "body"
        place = np.arange(len(live))
        between = (place >= hits[0]) & (place <= hits[-1])
        direct = np.array([m.region == at for m in live])
        own = hits[direct[hits]]
        around = (place >= own[0]) & (place <= own[-1]) if len(own) else np.zeros(len(live), bool)
        heads = [i for i, m in enumerate(live) if m.heading == "h1"]
        if bare and len(heads) == 1 and dense[heads[0] :].any():
            inside = inside & (place >= heads[0])  # what stands before the only main heading is not the article
        rich = np.array([m.region != at and m.region in weight for m in live])
        keep = inside & (rich | (direct & around if bare else direct | between))
        links = np.array([m.linked >= 0.7 * len(m.text) for m in live])
        alone = ~np.concatenate([[False], links[:-1]]) & ~np.concatenate([links[1:], [False]])
        keep &= ~links | (alone & between & (not bare))  # a menu is several links, or one beside the article
    first = int(np.flatnonzero(keep)[0]) if keep.any() else 0
    title = next((i for i in range(first - 1, max(-1, first - 9), -1) if live[i].heading == "h1"), None) if live[first].heading != "h1" else None
    if title is not None:
        keep[title] = True
    while title is None and first > 0 and live[first - 1].heading and not keep[first - 1]:
        first -= 1
        keep[first] = True
    return " ".join(m.text for m, k in zip(live, keep) if k)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text (the article; empty if there is none), n_chars (code points).

    Whole pages are parsed where they are read, nothing is shuffled. A null html counts as empty; null
    and repeated ids and urls are kept as they are; other columns are ignored; an empty table gives an
    empty result.
    """
    bounded_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), text_or_empty(html_col).alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [main_text(h) for h in batch["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(extracted, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
