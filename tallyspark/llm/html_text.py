"""HTML extraction: text-to-tag ratio per line, smoothed and clustered.

The standard library's streaming parser turns a page into lines, one per block element, each with its text, the tags
seen in it and the elements around it. The text-to-tag ratios are smoothed by a Gaussian and split by a threshold (their standard
deviation) into content and the rest. The content's weight picks the region: the ``article`` or ``main`` that holds more than half of it, else
the innermost element that holds all of it. In an ``article`` or ``main`` every line stays, in another region every line from the first content line
to the last, and of what is outside these the lines that aren't mostly links, where the region is an element of its own or they share the container of those two.

Names decide only on what no ratio can tell from an article: scripts, forms and styles; the elements ``nav``, ``header``,
``footer``, ``aside``, ``menu`` and ``dialog`` and their ARIA roles; classes and ids that name a menu, header, footer, sidebar, notice,
advert or reader comment (``_SURE``). Other suspicious names (``_UNSURE``) drop a line only if its own ratio is below the threshold, and below ``DENSE``,
or most of it is links.

Defined results: a null page counts as empty; a page without text gives an empty string; equal pages get equal texts. Pages are handled one by
one, in time linear in their length, however many elements stay open, so repeated rows have no influence; a column of ``pages`` named as
the result is replaced, other columns stay; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGMA, RADIUS = 1.0, 2
DENSE = 40  # characters for a tag from which a line under an unsure name is text in any case

_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hr html legend li main nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SILENT = frozenset("button canvas datalist head iframe math noscript object option script select style svg template textarea title".split())
_FURNITURE = frozenset("nav header footer aside form dialog menu".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
_SURE = (
    "ad ads adslot advert adverts advertisement advertising adbox sponsor sponsored nav navbar navigation menu submenu breadcrumb breadcrumbs"
    " header masthead topbar footer sidebar aside cookie cookies consent gdpr notice notices popup modal overlay newsletter"
    " subscribe subscription signup login comment comments disqus pagination pager"
)
_UNSURE = "banner promo promotion rail search share sharing social related recommended widget discussion replies respond toolbar copyright disclaimer skip"
_MARKED = re.compile(rf"(?:^|[-_])({'|'.join(f'{_SURE} {_UNSURE}'.split())})(?=$|[-_])")
_LAYOUT = re.compile(r"^(?:has|no|with|without|hide|show)[-_]")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_SURE_NAMES = frozenset(_SURE.split())
_ITEMS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",)}  # what the start of an item ends
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_SPACE = re.compile(r"\s+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class _Line:
    __slots__ = ("text", "tags", "linked", "node", "furniture")

    def __init__(self, text, tags, linked, node, furniture):
        self.text, self.tags, self.linked, self.node, self.furniture = text, tags, linked, node, furniture


class _Open:
    """An open element: its mark, the container it stands in (or is), the nearest block and the open elements of each tag in that block."""

    __slots__ = ("tag", "mark", "node", "block", "inner")

    def __init__(self, tag, mark, node, block, inner):
        self.tag, self.mark, self.node, self.block, self.inner = tag, mark, node, block, inner


class _Lines(HTMLParser):
    """Collects the lines of a page and the tree of its containers; every step costs the same, however many elements are open."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[_Line] = []
        self.root = _Open("", "", 0, "page", Counter())
        self.open: list[_Open] = []
        self.kinds, self.parents = ["page"], [0]  # of containers
        self.counts: Counter[str] = Counter()  # open elements by tag, and by mark as "mark:..."
        self.parts: list[str] = []
        self.tags = self.linked = 0

    def updatepos(self, i, j):  # line numbers aren't needed
        return j

    @property
    def top(self) -> _Open:
        return self.open[-1] if self.open else self.root

    def flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self.parts)).strip() if self.parts else ""
        if text:
            sure = self.counts["mark:sure"] or self.counts["mark:header"] and self.top.block not in _HEADINGS
            self.lines.append(_Line(text, self.tags, self.linked, self.top.node, "sure" if sure else "unsure" if self.counts["mark:unsure"] else ""))
        self.parts.clear()
        self.tags = self.linked = 0

    def mark(self, tag: str, attrs: list[tuple[str, str | None]]) -> str:
        if tag in _SILENT:
            return "silent"
        if not attrs and tag not in _FURNITURE:
            return ""
        inside = self.counts["article"] or self.counts["main"]
        given = dict(attrs)
        if "hidden" in given or given.get("aria-hidden") == "true" or _HIDDEN.search((given.get("style") or "").lower()):
            return "silent" if tag not in ("html", "body") else ""
        if tag in _FURNITURE:
            return "header" if tag == "header" and inside else "sure"
        if tag in ("html", "body", "main"):
            return ""
        if (given.get("role") or "").lower() in _ROLES:
            return "sure"
        names = _CAMEL.sub("-", f"{given.get('class') or ''} {given.get('id') or ''}").lower().split()
        found = {m for n in names if not _LAYOUT.match(n) for m in _MARKED.findall(n)}
        if not found:
            return ""
        if found == {"header"} and inside:
            return "header"
        return "sure" if found & _SURE_NAMES else "unsure"

    def handle_starttag(self, tag, attrs):
        if self.counts["mark:silent"] and tag not in ("body", "article", "main"):
            if tag not in _VOID:
                self.push(tag, "")
            return
        if tag in _BLOCK:
            self.flush()
            self.end_implied(tag)
        self.tags += 1
        if tag in ("body", "article", "main"):  # ends what was left open before
            while self.top.mark and not self.counts["mark:named"]:
                self.pop()
            while tag == "body" and self.open and self.top.tag != "html":
                self.pop()
        if tag in ("br", "td", "th", "dt", "dd", "img"):
            self.parts.append(" ")
        if tag not in _VOID:
            self.push(tag, self.mark(tag, attrs) if tag in _BLOCK or tag in _SILENT or attrs else "")

    def end_implied(self, tag: str) -> None:
        """End the paragraph that a block can't be part of, and the item before an item."""
        if self.top.inner["p"]:
            while self.pop() != "p":
                pass
        if tag in _ITEMS:
            at = len(self.open) - 1
            while at >= 0 and (self.open[at].tag == "div" or self.open[at].tag not in _BLOCK):
                at -= 1
            if at >= 0 and self.open[at].tag in _ITEMS[tag]:
                while len(self.open) > at:
                    self.pop()

    def push(self, tag: str, mark: str) -> None:
        top = self.top
        block = tag in _BLOCK
        node, inner = top.node, top.inner
        if block and tag not in ("p", "li") and tag not in _HEADINGS:
            node = len(self.kinds)
            self.kinds.append(tag)
            self.parents.append(top.node)
        if block and tag != "p":
            inner = Counter()
        else:
            inner[tag] += 1
        self.open.append(_Open(tag, mark, node, tag if block else top.block, inner))
        self.counts[tag] += 1
        if mark:
            self.counts[f"mark:{mark}"] += 1
            self.counts["mark:named"] += mark in ("sure", "unsure") and tag not in _FURNITURE

    def pop(self) -> str:
        x = self.open.pop()
        self.counts[x.tag] -= 1
        if x.tag == "p" or x.tag not in _BLOCK:
            x.inner[x.tag] -= 1
        if x.mark:
            self.counts[f"mark:{x.mark}"] -= 1
            self.counts["mark:named"] -= x.mark in ("sure", "unsure") and x.tag not in _FURNITURE
        return x.tag

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and tag not in _BLOCK:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if not self.counts["mark:silent"]:
            self.tags += 1
            if tag in _BLOCK:
                self.flush()
            elif tag in ("td", "th"):
                self.parts.append(" ")
        # what isn't a block ends inside its block only
        if self.counts[tag] and (tag in _BLOCK or self.top.inner[tag]):
            while self.pop() != tag:
                pass

    def handle_data(self, data):
        if not self.counts["mark:silent"]:
            self.parts.append(data)
            if self.counts["a"]:
                self.linked += len(data.strip())

    def end(self) -> None:
        self.close()
        self.flush()


def smooth(ratios: np.ndarray) -> np.ndarray:
    """Gaussian mean of each ratio's neighbours, the edges' own weights normalised."""
    kernel = np.array([math.exp(-(i * i) / (2 * SIGMA**2)) for i in range(-RADIUS, RADIUS + 1)])
    mid = slice(RADIUS, RADIUS + len(ratios))
    return np.convolve(ratios, kernel)[mid] / np.convolve(np.ones(len(ratios)), kernel)[mid]


def main_text(html: str | None) -> str:
    """The blocks of the page's main text, in order, joined by empty lines."""
    parser = _Lines()
    parser.feed(html or "")
    parser.end()
    lines = parser.lines
    if not lines:
        return ""
    own = np.array([len(x.text) / max(1, x.tags) for x in lines], float)
    ratios = smooth(own)
    least = min(ratios.std(), ratios.max())
    dense = [2 * x.linked <= len(x.text) for x in lines]
    rich = (own >= min(least, DENSE)).tolist()
    stays = [x.furniture == "" or x.furniture == "unsure" and r and d for x, r, d in zip(lines, rich, dense, strict=True)]
    content = [s and d and r >= least for s, d, r in zip(stays, dense, ratios.tolist(), strict=True)]
    if not any(content):
        content = stays
    weight = [0] * len(parser.kinds)
    for x, c in zip(lines, content, strict=True):
        weight[x.node] += c * len(x.text)
    for n in range(len(weight) - 1, 0, -1):  # parents have smaller numbers
        weight[parser.parents[n]] += weight[n]
    total = weight[0]
    if not total:
        return ""
    home, semantic = 0, False
    for n, w in enumerate(weight):
        if parser.kinds[n] in ("article", "main") and 2 * w > total:
            home, semantic = n, True
        elif not semantic and w == total:
            home = n
    under = [False] * len(weight)
    for n in range(home, len(weight)):
        under[n] = n == home or under[parser.parents[n]]
    inside = [i for i, x in enumerate(lines) if under[x.node] and stays[i]]
    if not semantic:
        core = [i for i in inside if content[i]]
        near = {lines[core[0]].node, lines[core[-1]].node}
        whole = parser.kinds[home] not in ("page", "html", "body")
        inside = [i for i in inside if core[0] <= i <= core[-1] or dense[i] and (whole or lines[i].node in near)]
    return "\n\n".join(lines[i].text for i in inside)


def extract(pages: DataFrame, html: str = "html", into: str = "text") -> DataFrame:
    """``pages`` with the main text of every page in place of its html."""
    kept = pages.drop(into) if into != html else pages
    rest = [c for c in kept.columns if c != html]
    ordered = kept.select(*(F.col(f"`{c}`") for c in rest), F.col(html).alias("__html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(len(rest))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], names=[*rest, into])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema.fields[:-1]]
    return ordered.mapInArrow(run, ", ".join([*fields, f"`{into}` string"]))
