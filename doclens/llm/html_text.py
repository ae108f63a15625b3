"""Main text of web pages from streaming parser events and smoothed text-to-tag ratios.

The standard library's parser streams tags and text once. Block tags cut the page into lines; a line keeps its text, the tags seen in it and its
region: an article (or main part) as a whole, or else the innermost division, menu, footer or other container, without the regions in it. The text-to-tag
ratios of a region's lines are smoothed by a Gaussian and add up to its mass. Two means on a log scale part the regions by mass;
those of the upper cluster are content, and all their lines are kept, short ones too. Where the means are less than ``APART`` times apart there is
one cluster, and all are content.

Markup weighs in: a region in an article has ``ARTICLE_WEIGHT`` times its mass, one whose class or id (or that of an element around it)
names a menu, advert or the like a part of it, and less if it names reader comments; an article in a named element is weighed as it is, unless it is among
comments. If regions with and without such names are chosen, those of less mass are dropped; if an article is among the others, regions outside
articles are. A name alone thus rules nothing out: a wrapper of such a name around the whole text stays. Lines in elements that cannot be text (menus, footers,
forms, hidden ones, by tag, role or attribute) never count. Names are not looked at on ``html`` and ``body``, nor in modifiers (``no-sidebar``, ``comments-open``).

Without any markup (``main_text(html, markup=False)``: all containers alike, no names) masses alone give the same text on nearly all pages of
the test tables, and without ratios they do not (``test_ratios_decide``).

A page is one row and one task's work; nothing is shuffled.

Cases: null or empty html, and a page of boilerplate alone, gives an empty text; very long pages are read whole; broken markup (tags left open, stray end
tags, markup cut off) is read as far as it goes: ``head`` ends where something stands that cannot be in it, ``select`` at a block, and a comment without an
end holds the rest of the page; repeated rows give equal texts; an empty table gives an empty result;
other columns stay, but for ``text`` and ``n_chars``, which are replaced.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclens.llm.passes import carried, map_texts

SIGMA, RADIUS = 1.0, 2
#: Weights of a region's mass, and how far apart the means of two clusters are.
ARTICLE_WEIGHT, NAMED_WEIGHT, COMMENT_WEIGHT, APART = 8.0, 1 / 4, 1 / 64, 4.0

# Tags by what they do to a page.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("applet audio button canvas datalist head iframe math noframes noscript object option script select style svg template textarea title video".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog".split())
ARTICLES, DIVISIONS = frozenset(["article", "main"]), frozenset(["div", "section", "td", "body", "article", "main"])
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NAMES = frozenset("ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist disqus reply replies respond pagination pager widget toolbar".split())
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond".split())
IN_HEAD = frozenset("base link meta noscript script style template title".split())
IN_SELECT = frozenset("option optgroup hr".split())
CLOSES = {"p": frozenset(["p"]), "li": frozenset(["li"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "tr": frozenset(["tr", "td", "th"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"])}
MODIFIERS = re.compile(r"(?:no|has|with|without)[-_].*|.*[-_](?:open|opened|closed|enabled|disabled)")
_NAME = re.compile(r"[^a-z0-9]+")


class Place(NamedTuple):
    """What holds a line."""

    skipped: bool = False
    excluded: bool = False
    region: int = 0
    article: bool = False
    weight: float = 1.0
    """Of names around it: 1 without any."""
    named: bool = False


class Line(NamedTuple):
    text: str
    tags: int
    place: Place


class Lines(HTMLParser):
    """Lines of one page. Without ``markup`` all containers are alike."""

    def __init__(self, markup: bool = True) -> None:
        super().__init__(convert_charrefs=True)
        self.markup = markup
        self.lines: list[Line] = []
        self.stack: list[tuple[str, Place]] = []
        self.open: dict[str, int] = {}
        self.text: list[str] = []
        self.tags = self.regions = 0
        self.last = Place()

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text.clear()
        if text:
            self.lines.append(Line(text, self.tags, self.last))
            self.tags = 0

    def drop(self, tag: str) -> None:
        """Close the innermost such tag and all that it holds."""
        while self.stack:
            name = self.stack.pop()[0]
            self.open[name] -= 1
            if name == tag:
                break
        self.last = self.stack[-1][1] if self.stack else Place()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
        elif tag == "br":
            self.text.append(" ")
        if self.open.get("head") and tag not in IN_HEAD:
            self.drop("head")
        if self.open.get("select") and tag in BLOCKS and tag not in IN_SELECT:
            self.drop("select")
        for name in CLOSES.get(tag, ()):
            if self.open.get(name) and self.stack[-1][0] not in DIVISIONS and self.closes(name):
                self.drop(name)
        if tag in ARTICLES and not self.last.article:
            for name in ("nav", "footer", "aside", "header", "form", "menu"):
                while self.open.get(name):  # left open
                    self.drop(name)
        if tag in VOID:
            return
        self.stack.append((tag, self.held(tag, attrs)))
        self.open[tag] = self.open.get(tag, 0) + 1
        self.last = self.stack[-1][1]

    def held(self, tag: str, attrs: list) -> Place:
        """The place within an element that opens here."""
        now = self.last
        skipped = now.skipped or tag in SKIPPED
        box = tag in BOILERPLATE or tag in DIVISIONS or tag == "header"
        if not self.markup:
            self.regions += box
            return now._replace(skipped=skipped, region=self.regions if box else now.region)
        names = set() if tag in ("html", "body") else marked(attrs)
        excluded = now.excluded or tag in BOILERPLATE or tag == "header" and not now.article or hidden(attrs)
        weight = min(now.weight, COMMENT_WEIGHT if names & COMMENTS else NAMED_WEIGHT if names else 1.0)
        article = now.article or tag in ARTICLES
        if tag in ARTICLES and not names and weight == NAMED_WEIGHT:
            weight = 1.0
        opens = bool(names) or excluded and not now.excluded or (box and not now.article)
        self.regions += opens
        return Place(skipped, excluded, self.regions if opens else now.region, article, weight, now.named or bool(names))

    def closes(self, name: str) -> bool:
        """Whether the open tag ends here: no division or list stands between."""
        for entry in reversed(self.stack):
            if entry[0] == name:
                return True
            if entry[0] in DIVISIONS or entry[0] in ("ul", "ol", "dl", "table", "blockquote"):
                return False
        return False

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
        if self.open.get(tag):
            self.drop(tag)

    def handle_data(self, data: str) -> None:
        if self.stack and self.stack[-1][0] == "head" and data.strip():
            self.drop("head")
        if not self.last.skipped:
            self.text.append(data)


def marked(attrs: list) -> set[str]:
    """Names of menus, sidebars, notices, adverts or the like in a class or id."""
    names = (n for name, value in attrs if name in ("class", "id") for n in (value or "").lower().split())
    return {part for n in names if not MODIFIERS.fullmatch(n) for part in _NAME.split(n)} & NAMES


def hidden(attrs: list) -> bool:
    """Whether attributes give the role of a menu, dialog or the like, or hide the element."""
    for name, value in attrs:
        value = (value or "").lower()
        if name == "role" and value in ROLES:
            return True
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


def smoothed(x: np.ndarray) -> np.ndarray:
    kernel = np.exp(-0.5 * (np.arange(-RADIUS, RADIUS + 1) / SIGMA) ** 2)
    return np.convolve(x, kernel, "full")[RADIUS : RADIUS + len(x)] / np.convolve(np.ones(len(x)), kernel, "full")[RADIUS : RADIUS + len(x)]


def threshold(x: np.ndarray) -> float:
    """Midway between two means, or the least value where these are not ``APART`` (on a log scale)."""
    low, high = float(x.min()), float(x.max())
    for _ in range(20):
        above = x >= (low + high) / 2
        if above.all() or not above.any():
            break
        new = float(x[~above].mean()), float(x[above].mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2 if high - low >= math.log(APART) else float(x.min())


def whole(html: str) -> str:
    """The page up to a comment that has no end."""
    at = html.rfind("<!--")
    ended = at < 0 or html.find("-->", at) >= 0 or re.search(r"</(?:script|style)", html[at:], re.IGNORECASE)
    return html if ended else html[:at]


def main_text(html: str | None, markup: bool = True, ratios: bool = True) -> str:
    parser = Lines(markup)
    parser.feed(whole(html or ""))
    parser.close()
    parser.flush()
    lines = [line for line in parser.lines if not line.place.excluded]
    if not lines:
        return ""
    ratios_of: dict[int, list[float]] = {}
    weight: dict[int, float] = {}
    for text, tags, place in lines:
        ratios_of.setdefault(place.region, []).append(len(text) / max(1, tags) if ratios else 1.0)
        weight[place.region] = place.weight * (ARTICLE_WEIGHT if place.article and not place.named else 1.0)
    mass = {region: float(smoothed(np.array(x)).sum()) * weight[region] for region, x in ratios_of.items()}
    score = np.log(np.array(list(mass.values())))
    chosen = {region for region, s in zip(mass, score.tolist(), strict=True) if s >= threshold(score) - 1e-12}
    named = {line.place.region for line in lines if line.place.named} & chosen
    if named != chosen:
        heavier = sum(mass[r] for r in named) > sum(mass[r] for r in chosen - named)
        chosen = named if heavier else chosen - named
    chosen = {line.place.region for line in lines if line.place.article} & chosen or chosen
    return " ".join(line.text for line in lines if line.place.region in chosen)


def extract(pages: DataFrame, html: str = "html", carry: list[str] | None = None) -> DataFrame:
    """``carry`` (all columns of ``pages`` by default) with ``text`` and its length in code points."""
    extracted = lambda texts: [[main_text(h) for h in texts.cast(pa.string()).to_pylist()]]
    rows = map_texts(pages, carried(pages, carry, ["text", "n_chars"]), html, extracted, "text string")
    return rows.withColumn("n_chars", F.length("text").cast("long"))
