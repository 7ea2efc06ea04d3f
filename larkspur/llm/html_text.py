"""Main text of HTML pages, by text-to-tag ratios.

The page goes once through the standard library's streaming HTML parser. Its
events build *lines*: the text of one block each, with the number of tags in it and
how much of it lies outside links and menus. Elements that the contract names are left
out by what they are called: headers, footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments. A class or id calls an element so if all words of one of its tokens do (`ad-slot`, `cookie-notice`, not
`social-studies`). Menus' text counts as none, so that the ratios drop them.

A line's ratio is its text outside links and menus over its tags. The ratios are smoothed with a
Gaussian of `sigma` lines, and lines whose smoothed ratio reaches `share` of the page's median ratio
form clusters, each within one region: an article element, or all that lies outside articles. A
cluster begins and ends with a line that has a ratio of its own, so smoothing carries no
menu beside an article into it. The clusters choose the regions: an article that has one stays as a whole, but for its
menus, whatever its shorter blocks and links are; outside articles the clusters alone stay, and only if they hold
at least `REGION` times `share` of the most text that the clusters of one region hold. A `main` element without an article in it is one.
An article within an element that is left out counts only if nothing else does, since the element may just not have been closed.

Null and empty pages give an empty text; unclosed elements end with their
container; pages of equal texts or repeated rows each keep their row; very long pages are read as a stream of
events and deep nesting costs a stack of open containers, with no recursion; an empty table gives an empty
result; an input column with an output's name is replaced; nothing is capped.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm import common

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
NO_TEXT = {"head", "script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "audio", "video", "select", "textarea", "button", "datalist"}
BOILERPLATE = {"footer", "aside", "form", "dialog"} | NO_TEXT
MENUS = {"nav", "menu"}
CONTAINERS = {"html", "body", "main", "article", "section", "div", "header", "ul", "ol", "dl", "table", "blockquote", "figure", "details"} | BOILERPLATE | MENUS
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
BLOCKS = {"p", "li", "dt", "dd", "tr", "td", "th", "pre", "address", "caption", "figcaption", "summary", "hr", "thead", "tbody", "tfoot", "fieldset", "legend", "hgroup", "center"} | HEADINGS | CONTAINERS
#: Words of a class or id that mark an element as no part of the article, inside one and elsewhere.
COMMENT_MARKS = set("comment comments disqus respond replies reply".split())
MARKS = COMMENT_MARKS | set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar footer masthead "
    "notice notices cookie cookies consent gdpr popup modal overlay alert newsletter subscribe signup login".split()
)
#: Those that do so outside articles only.
OUTER_MARKS = MARKS | set("share sharing social related recommended widget skip copyright".split())
#: Words that may stand beside a mark in its token.
PLACES = set(
    "area bar block body bottom box button buttons card cards center col column container content desktop fixed form global group holder inner item items left link links "
    "list main mobile module outer page panel placeholder reader region right row section site slot sticky strip text thread top unit user wrap wrapper zone".split()
)
#: Words that mark it as a menu.
MENU_MARKS = set("nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar".split())
#: Marks of a page's header, which within an article may hold its title.
HEADER_MARKS = {"header", "topbar"}
ROLES = {"banner", "contentinfo", "complementary", "search", "form", "alert", "dialog"}
MENU_ROLES = {"navigation", "menu", "menubar"}
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
MARK_SPLIT = re.compile(r"[^a-z]+")
#: A region outside articles needs so many times the share of a line.
REGION = 4
WORD = re.compile(r"[^\W_]")
#: What an open element makes of its text.
KEPT, MENU, OUT = 0, 1, 2


def called(value: str, marks: set[str]) -> bool:
    """Whether a token of a class or id consists of marks and PLACES, with a mark among them."""
    for token in value.split():
        words = [w for w in MARK_SPLIT.split(token) if w]
        if not marks.isdisjoint(words) and all(w in marks or w in PLACES for w in words):
            return True
    return False


@dataclass(eq=False)
class Element:
    """An open container: what becomes of its text, the number of the article around it (0: none), the left-out elements around that
    article, and whether its own end tag has come."""

    tag: str
    kind: int
    article: int
    around: tuple[Element, ...] = ()
    ended: bool = False


class LineReader(HTMLParser):
    """Collects (text, characters outside links and menus, tags, article, whether in a menu) of each block that isn't left out."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, bool]] = []
        self.open: list[Element] = []
        self.named: Counter[str] = Counter()  # open containers by tag
        self.articles: list[Element] = []  # each article or main element; their numbers are places from 1
        self.wide: set[int] = set()  # main elements with an article in them
        self.linked = self.heading = False
        self.clear()

    def clear(self) -> None:
        self.parts: list[str] = []
        self.tags = self.plain = 0
        self.words = self.links = False

    @property
    def kind(self) -> int:
        return self.open[-1].kind if self.open else KEPT

    def end_line(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                plain = 0 if self.links and not self.words else self.plain  # what parts links is no text
                self.lines.append((text, plain, 1 + self.tags, self.open[-1].article if self.open else 0, self.kind == MENU))
        self.clear()

    def kind_of(self, tag: str, attrs: list[tuple[str, str | None]]) -> int:
        if tag in BOILERPLATE:
            return OUT
        within = bool(self.open and self.open[-1].article)
        if tag == "header" and not within:
            return OUT
        found = MENU if tag in MENUS else KEPT
        if tag in ("body", "html"):
            return found
        whole = tag in ("article", "main")  # comments may be articles; no other name makes one less than that
        marks = COMMENT_MARKS if whole else MARKS if within else OUTER_MARKS
        for name, value in attrs:
            value = (value or "").lower()
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and HIDDEN.search(value):
                return OUT
            if name == "role" and not whole:
                if value in ROLES:
                    return OUT
                found = MENU if value in MENU_ROLES else found
            if name in ("class", "id"):
                if called(value, marks) or not whole and not within and called(value, HEADER_MARKS):
                    return OUT
                found = MENU if not whole and called(value, MENU_MARKS) else found
        return found

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in BLOCKS:
            self.tags += tag not in VOID
            if tag == "br":
                self.parts.append(" ")
            elif tag == "a":
                self.linked = True
            if tag not in VOID and attrs and (kind := self.kind_of(tag, attrs)):
                self.push(tag, kind)
            return
        self.end_line()
        self.heading = tag in HEADINGS
        if tag == "body" and self.named["head"]:
            self.open = [o for o in self.open if o.tag != "head"]
            self.named["head"] = 0
        if tag in VOID:
            return
        kind = self.kind_of(tag, attrs) if attrs or tag in CONTAINERS else KEPT
        if tag in CONTAINERS or kind:
            self.push(tag, kind)

    def push(self, tag: str, kind: int) -> None:
        around = self.open[-1] if self.open else Element("", KEPT, 0)
        article, outside = around.article, around.around
        if tag in ("article", "main") and kind == KEPT:
            parent = self.articles[article - 1] if article else None
            if parent is None or parent.tag == "main" and tag == "article":
                if parent is not None:
                    self.wide.add(article)
                article = len(self.articles) + 1
                left_out = tuple(e for e in self.open if e.kind)
                outside, around = outside + left_out, Element("", KEPT, 0)  # is it really inside these? their end tags will tell
        element = Element(tag, max(kind, around.kind), article, outside)
        if article > len(self.articles):
            self.articles.append(element)
        self.named[tag] += 1
        self.open.append(element)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.end_line()
            self.linked = self.heading = False
        elif tag == "a":
            self.linked = False
        if self.named[tag]:
            self.close_from(next(i for i in range(len(self.open) - 1, -1, -1) if self.open[i].tag == tag), ended=True)

    def close_from(self, i: int, ended: bool) -> None:
        self.open[i].ended = ended
        for element in self.open[i:]:
            self.named[element.tag] -= 1
        del self.open[i:]

    def handle_data(self, data: str) -> None:
        if self.kind == OUT:
            return
        self.parts.append(data)
        if self.linked and not self.heading:
            self.links = True
        elif self.kind == KEPT:
            self.plain += len(data.strip())
            self.words = self.words or WORD.search(data) is not None

    def finish(self) -> None:
        self.close()
        self.end_line()

    def regions(self) -> np.ndarray:
        """The region of each line: the number of its article, negative if that lies in an element that is left out; 0 outside articles."""
        of = np.arange(len(self.articles) + 1)
        for i, element in enumerate(self.articles, 1):
            if i in self.wide:
                of[i] = 0
            elif any(e.ended for e in element.around):
                of[i] = -i
        return of[[x[3] for x in self.lines]]


def smoothed(ratios: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian means over neighbours; the ratios themselves if sigma is 0."""
    if not sigma:
        return ratios
    radius = max(1, round(4 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(ratios)), kernel)[radius : radius + len(ratios)]
    return np.convolve(ratios, kernel)[radius : radius + len(ratios)] / weight


#: What a line needs as a ratio of its own, if the threshold isn't lower: some text outside links.
LEAST = 0.01


def content_lines(lines: list[tuple[str, int, int, int, bool]], region: np.ndarray, sigma: float, share: float) -> list[str]:
    plain, tags = (np.array([x[k] for x in lines]) for k in (1, 2))
    ratio = plain / tags
    if not ratio.any():
        return []
    threshold = share * np.median(ratio[ratio > 0])
    own = ratio >= min(threshold, LEAST)
    dense = smoothed(ratio, sigma) >= threshold
    # clusters: runs of dense lines of one region, without the lines at their ends that have no ratio of their own
    change = np.flatnonzero((dense[1:] != dense[:-1]) | (region[1:] != region[:-1])) + 1
    clusters, mass = np.zeros(len(lines), bool), Counter()
    for first, end in zip([0, *change.tolist()], [*change.tolist(), len(lines)], strict=True):
        at = np.flatnonzero(own[first:end]) if dense[first] else ()
        if len(at):
            low, high = first + int(at[0]), first + int(at[-1]) + 1
            clusters[low:high] = True
            mass[int(region[first])] += int(plain[low:high].sum())
    sure = {k for k in mass if k >= 0} or set(mass)  # doubtful articles if there is nothing else
    chosen = {k for k in sure if k}
    if 0 in sure and mass[0] >= REGION * share * max(mass[k] for k in sure):
        chosen.add(0)
    stays = np.array([k in chosen for k in region.tolist()]) & (clusters | (region != 0))
    return [x[0] for x, stay, has in zip(lines, stays.tolist(), own.tolist(), strict=True) if stay and (has or not x[4])]


def main_text(html: str | None, sigma: float = 2.5, share: float = 0.07) -> str:
    """The text of one page. A `sigma` of 0 smooths nothing; with a `share` of 0 every line is dense."""
    if not html:
        return ""
    reader = LineReader()
    reader.feed(html)
    reader.finish()
    return "\n".join(content_lines(reader.lines, reader.regions(), sigma, share)) if reader.lines else ""


def extract(df: DataFrame, html: str = "html", sigma: float = 2.5, share: float = 0.07, keep: list[str] | None = None) -> DataFrame:
    """df's columns `keep` (all but the page by default) with text and n_chars."""
    kept = [c for c in (keep if keep is not None else df.columns) if c not in ("text", "n_chars", html)]
    compute = lambda: lambda pages: {"text": [main_text(h, sigma, share) for h in pages]}
    found = common.with_outputs(df, html, kept, {"text": T.StringType()}, compute)
    return found.withColumn("n_chars", F.length("text").cast("long"))
