"""Main text of web pages from the standard library's streaming parser events.

Events are gathered into lines, one for each run of text between block tags or breaks, with the number of tags met, the container the line
stands in (the nearest article, main, section, div, td or body) and whether it is inside something that is never article text: head,
scripts, styles, navigation, page headers and footers, asides, forms, hidden parts, or elements whose class, id or role says advert,
notice, sidebar, comment and so on. The other lines have their text-to-tag ratio, smoothed by a Gaussian; a threshold that parts the
smoothed ratios into two clusters selects content lines, and with them the regions that hold such lines: the outermost article that a line
is in, or its container. In a region, everything between the first and the last line above the threshold, smoothed or not, is content; of an
article, or of the lines that stand in main itself, everything is, and so is an article between the content lines of a chosen region.

Defined cases: a null or empty html, or one without content lines, gives the empty string; unclosed and stray tags are closed as by their
ancestors; rows repeat as they are; a null page_id or url stays; a page of any length is read whole; where all smoothed ratios are equal every
line is content, and a ratio that equals the threshold is below it; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.shared import columns, mapped

#: Fixed values of HTML.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul", "br"}
NEVER = {"head", "title", "script", "style", "noscript", "template", "nav", "footer", "aside", "form", "button", "select", "option", "textarea", "input", "label", "fieldset", "iframe", "object", "svg", "math", "canvas", "audio", "video", "menu", "dialog", "search", "map", "datalist"}
HOLDS = {"article", "main", "section", "div", "td", "body"}
#: A start tag of the key closes an open element of the value.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
LIMITS = {"table", "ul", "ol", "dl", "div", "article", "main", "section", "aside", "nav", "body", "select", "blockquote", "td"}
#: Words of class, id and role that mark what is not the article, and words that say nothing beside them. A name is one of the former, or is
#: made of both, parted by - and _; with any other word it says nothing, as in related-work or side-by-side.
SAYS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "sidebar rail widget widgets nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toolbar masthead header footer copyright legal comment comments commentlist "
    "respond replies reply disqus discussion share sharing social related recommended recirc teaser teasers newsletter subscribe signup login search skip hidden complementary contentinfo dialog form".split()
)
BESIDE = set(
    "site page main global top bottom left right upper lower primary secondary side user users reader readers visitor post posts article articles story content links link list item items box block area section "
    "wrapper wrap container inner outer bar button buttons icon icons slot unit text title thread policy message warning panel group row col column sticky fixed mobile desktop js id the a".split()
)
SIGMA = 1.0
SPACES = re.compile(r"\s+")


def marks(name: str) -> bool:
    """Whether a class, id or role says that its element is not part of the article."""
    words = [w for w in re.split(r"[-_]+|\d+", name) if w]
    said = [w for w in words if w in SAYS]
    # The header of an article or of a section of it is its own; site-header is not.
    return bool(said) and all(w in SAYS or w in BESIDE for w in words) and (set(said) != {"header"} or bool({"site", "page", "global", "main", "top"} & set(words)))


class Lines(HTMLParser):
    """lines: [text parts, tags, region, never, whether the region is content as a whole]."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, int]] = []  # tag, never, container
        self.lines: list[list] = []
        self.containers, self.fresh = 0, True

    def state(self) -> tuple[bool, int]:
        return self.stack[-1][1:] if self.stack else (False, 0)

    def line(self) -> list:
        if self.fresh or not self.lines:
            never, holder = self.state()
            article = next((at for t, _, at in self.stack if t == "article"), None)
            nearest = next((t for t, *_ in reversed(self.stack) if t in HOLDS), None)
            self.lines.append([[], 0, holder if article is None else article, never, article is not None or nearest == "main"])
            self.fresh = False
        return self.lines[-1]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in CLOSES:
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] in CLOSES[tag]:
                    del self.stack[i:]
                    self.fresh = True
                    break
                if self.stack[i][0] in LIMITS:
                    break
        if tag in BLOCK:
            self.fresh = True
        never, holder = self.state()
        if tag not in VOID:
            if tag in HOLDS:
                self.containers += 1
                holder = self.containers
            if not never and tag not in ("html", "body", "article", "main"):
                never = tag in NEVER or tag == "header" and not any(t in ("article", "main") for t, *_ in self.stack) or self.said(attrs)
            elif not never and tag == "article":
                never = self.said(attrs)
            before = self.state()[0]
            self.stack.append((tag, never, holder))
            if never != before:
                self.fresh = True
        if tag not in BLOCK or tag == "br":
            if self.lines and not self.fresh:
                self.lines[-1][1] += 1

    @staticmethod
    def said(attrs: list[tuple[str, str | None]]) -> bool:
        for k, v in attrs:
            if k in ("class", "id", "role") and v and any(marks(name) for name in v.lower().split()):
                return True
            if k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and v and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", v, re.I):
                return True
        return False

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.stack and self.stack[-1][0] == tag:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.fresh = True
        elif self.lines and not self.fresh:
            self.lines[-1][1] += 1
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                if any(never for _, never, _ in self.stack[i:]):
                    self.fresh = True
                del self.stack[i:]
                return
            if tag not in BLOCK and self.stack[i][0] in LIMITS:
                return

    def handle_data(self, data: str) -> None:
        if not data.isspace() or not self.fresh:
            self.line()[0].append(data)


def smooth(x: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """A Gaussian over neighbouring lines; ends weigh what they have."""
    k = np.exp(-0.5 * (np.arange(-3, 4) / sigma) ** 2)
    part = slice(3, 3 + len(x))
    return np.convolve(x, k, "full")[part] / np.convolve(np.ones(len(x)), k, "full")[part]


def threshold(x: np.ndarray) -> float:
    """Halfway between the means of two clusters, found by moving it there until it stays."""
    t = float(x.mean())
    for _ in range(50):
        lo, hi = x[x <= t], x[x > t]
        if not len(lo) or not len(hi):
            return float(x.min()) - 1
        if abs((new := (lo.mean() + hi.mean()) / 2) - t) < 1e-6:
            break
        t = float(new)
    return t


def main_text(html: str | None) -> str:
    """The article of a page."""
    if not html:
        return ""
    p = Lines()
    p.feed(html)
    p.close()
    lines = [(SPACES.sub(" ", "".join(parts)).strip(), *rest) for parts, *rest in p.lines]
    lines = [x for x in lines if x[0] and not x[3]]
    if not lines:
        return ""
    own = np.log1p([len(x[0]) / (1 + x[1]) for x in lines])
    ratio = smooth(own)
    least = threshold(ratio)
    holders = {x[2] for i, x in enumerate(lines) if ratio[i] > least}
    spans: dict[int, list[int]] = {}
    for i, x in enumerate(lines):
        if x[2] in holders and (x[4] or max(ratio[i], own[i]) > least):
            spans.setdefault(x[2], []).append(i)
    cover = np.zeros(len(lines) + 1, np.int64)  # spans that are open at a line
    for span in spans.values():
        cover[span[0]] += 1
        cover[span[-1] + 1] -= 1
    cover = cover.cumsum()
    return " ".join(x[0] for i, x in enumerate(lines) if x[2] in spans and spans[x[2]][0] <= i <= spans[x[2]][-1] or x[4] and cover[i])


def extract(pages: DataFrame) -> DataFrame:
    """A row for each row of pages: page_id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return mapped(columns(pages, ["page_id", "url", "html"], ["long", "string", "string"]), run, "page_id long, url string, text string, n_chars long")
