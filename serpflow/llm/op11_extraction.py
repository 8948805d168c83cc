"""Main text of pages by text-to-tag ratios over streaming parser events.

The standard library's parser is fed each page and its events are folded into lines as they come: a line is the
text between two block boundaries (and line breaks), with the number of tags that came with it.  Its ratio is
characters of text to tags; text of links, and lines inside what is marked as menu, header, footer, sidebar,
notice, advert, form or comment, count no characters.  The ratios are smoothed by a Gaussian over neighbouring
lines and cut at a threshold, a multiple of their spread; runs of lines above it are the clusters of content.
The clusters choose the region: the articles that hold them, else the deepest element that holds nearly all of their
text.  Every line of the region is kept, long or short, but for what is marked as furniture.

Regions repair what ratios alone get wrong: a short paragraph between long ones, or a heading, is low in
ratio and still part of the article.  Outside of an article or main element a line must also stand among content: between the
first and the last line of a cluster, or beside one in its element, and not be mostly links.

Defined results: a null or empty page, and one without text outside of furniture, give '' and 0; markup left open closes
with the element around it; repeated rows give repeated rows; extra columns are left out; an
empty table gives no rows.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that never close, by the standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that stay inside a line.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label map mark meter nobr picture q rb ruby s samp small source span strike strong sub sup time tt u var wbr".split())
#: Elements whose content is no text of the page, and those that are furniture.
SILENT = frozenset("script style noscript template title head svg math iframe object canvas audio video datalist rt rp".split())
FURNITURE = frozenset("nav header footer aside form menu dialog button select textarea input option fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist status note".split())
#: Elements that a region is never narrowed down to, and those whose start ends an open paragraph.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre".split())
ENDS_P = TEXTUAL | frozenset("address article aside center details div dl fieldset figure figcaption footer form header hr main nav section table".split())
#: Words that mark furniture in a class or id, met as whole words of it; a number or plural may follow.
MARKED = re.compile(
    r"(?:^|[^a-z])(?:ad|advert|advertisement|advertising|ads?box|adsense|adslot|banner|billboard|promo|promotion|promoted|sponsor|sponsored|nav|navbar|navigation|navi|menu|menubar|breadcrumb|crumb|pagination|pager|toolbar|"
    r"header|masthead|topbar|footer|foot|colophon|copyright|sidebar|side|aside|rail|widget|related|recommended|recommendation|more|trending|popular|outbrain|taboola|cookie|consent|gdpr|notice|notification|alert|disclaimer|warning|popup|"
    r"modal|overlay|dialog|newsletter|subscribe|subscription|signup|login|paywall|share|sharing|social|follow|comment|discussion|disqus|respond|reply|replies|feedback|form|search|skip|hidden|tag|toc)(?:s|es|list|box|area|bar|block|section|wrapper|container|\d+)?(?:[^a-z]|$)"
).search
#: Class words that mark content, and so shield an element from the list above.
CONTENT = re.compile(r"(?:^|[^a-z])(?:article|post|entry|story|content|main|body|text|prose)(?:body|text|content)?(?:[^a-z]|$)").search
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])").sub
GAPS = re.compile(r"\s+")


class Lines(HTMLParser):
    """Folds events into lines: [text, tags, link characters, marked, place of the innermost element]."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        #: of every block element: parent's place, tag, whether it is content by tag
        self.elements: list[tuple[int, str]] = [(-1, "#page")]
        #: open elements: tag, place of the block around, silent, marked
        self.stack: list[tuple[str, int, bool, bool]] = [("#page", 0, False, False)]
        self.open: dict[str, int] = {}
        self.articles = 0
        self.links = 0
        self.lines: list[list] = []
        self.parts: list[str] = []
        self.tags = self.link_chars = 0

    def cut(self):
        """End the line at hand."""
        text = GAPS.sub(" ", "".join(self.parts)).strip()
        if text:
            _, at, _, marked = self.stack[-1]
            self.lines.append([text, self.tags, self.link_chars, marked, at])
            self.tags = 0
        self.parts, self.link_chars = [], 0

    def handle_starttag(self, tag, attrs):
        inline = tag in INLINE
        if not inline:
            self.cut()
            if tag in ENDS_P and self.open.get("p"):
                self.end_paragraph()
        self.tags += 1
        _, at, silent, marked = self.stack[-1]
        if tag in VOID:
            return
        silent = silent or tag in SILENT
        if not silent:
            furniture = marked or tag in FURNITURE or self.is_marked(tag, attrs)
            # an article inside an article is a reader's comment
            furniture = furniture or (tag == "article" and self.articles > 0)
            if furniture != marked:
                self.cut()
            marked = furniture
        if not inline:
            self.elements.append((at, tag))
            at = len(self.elements) - 1
        self.stack.append((tag, at, silent, marked))
        self.open[tag] = self.open.get(tag, 0) + 1
        self.articles += tag == "article"
        self.links += tag == "a"

    def end_paragraph(self):
        """Close the paragraph at hand, if only inline elements are open in it."""
        for name, *_ in reversed(self.stack):
            if name == "p":
                self.close_to("p")
            if name not in INLINE:
                return

    def is_marked(self, tag, attrs) -> bool:
        for name, value in attrs:
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                return True
            if not value:
                continue
            if name == "role":
                if value.strip().lower() in ROLES:
                    return True
            elif name == "style":
                if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value.lower()):
                    return True
            elif name in ("class", "id") and tag not in ("html", "body", "article", "main", "p", "h1"):
                for word in value.split():
                    word = CAMEL("-", word).lower()
                    if MARKED(word) and not CONTENT(word):
                        return True
        return False

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        if not self.open.get(tag):
            if tag in ("p", "br"):
                self.cut()
            return
        self.close_to(tag)

    def close_to(self, tag):
        while True:
            name, _, _, marked = self.stack[-1]
            above = self.stack[-2]
            if name not in INLINE or marked != above[3]:
                self.cut()
            self.stack.pop()
            self.open[name] -= 1
            self.articles -= name == "article"
            self.links -= name == "a"
            if name == tag:
                break

    def handle_data(self, data):
        if not self.stack[-1][2]:
            self.parts.append(data)
            if self.links:
                self.link_chars += len(data)

    def finish(self) -> list[list]:
        self.close()
        self.cut()
        return self.lines


def smooth(ratios: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing over neighbouring lines; beyond the ends the weights count over what is there."""
    radius = max(1, int(np.ceil(2 * sigma)))
    kernel = np.exp(-np.arange(-radius, radius + 1) ** 2 / (2 * sigma * sigma))
    over = lambda x: np.convolve(x, kernel)[radius : radius + len(x)]
    return over(ratios) / over(np.ones(len(ratios)))


def ratios(lines: list[list]) -> np.ndarray:
    """Characters of text outside links to tags, of every line; none where it is marked as furniture."""
    return np.array([0.0 if marked else max(len(text) - links, 0) / max(tags, 1) for text, tags, links, marked, _ in lines])


def clusters(values: np.ndarray, spread: float) -> np.ndarray:
    """Whether each line is above the threshold, so many standard deviations of the smoothed ratios, and never
    above the highest."""
    return values >= min(spread * values.std(), values.max()) if len(values) and values.max() > 0 else np.zeros(len(values), bool)


def main_text(html: str | None, sigma: float = 1.0, spread: float = 0.8, share: float = 0.9) -> str:
    """The main text of one page."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    lines = parser.finish()
    free = [k for k, x in enumerate(lines) if not x[3]]
    if not free:
        return ""
    content = clusters(smooth(ratios(lines), sigma), spread)
    mass = np.array([0 if x[3] else (len(x[0]) - x[2]) * int(c) for x, c in zip(lines, content)])
    elements = parser.elements
    # what each element holds, below it included: an element comes after its parent
    held, text = np.zeros(len(elements), dtype=np.int64), np.zeros(len(elements), dtype=np.int64)
    for k in free:
        held[lines[k][4]] += mass[k]
        text[lines[k][4]] += len(lines[k][0])
    for e in range(len(elements) - 1, 0, -1):
        held[elements[e][0]] += held[e]
        text[elements[e][0]] += text[e]
    inside = [-1] * len(elements)  # the outermost article or main element around, main only where no article is in it
    named = [e for e, (_, tag) in enumerate(elements) if tag == "article" and text[e]] or [e for e, (_, tag) in enumerate(elements) if tag == "main" and text[e]]
    with_content = [e for e in named if held[e]]
    if named and (not held[0] or 2 * sum(int(held[e]) for e in with_content) >= held[0]):
        roots = set(with_content or [max(named, key=lambda e: (text[e], -e))])
        for e, (parent, _) in enumerate(elements):
            inside[e] = inside[parent] if parent >= 0 and inside[parent] >= 0 else e if e in roots else -1
        return " ".join(lines[k][0] for k in free if inside[lines[k][4]] >= 0)
    # no such element: down to the deepest one that holds nearly all content
    root, children = 0, [[] for _ in elements]
    for e, (parent, _) in enumerate(elements):
        if parent >= 0:
            children[parent].append(e)
    while True:
        best = max((e for e in children[root] if elements[e][1] not in TEXTUAL), key=lambda e: held[e], default=None)
        if best is None or held[best] < share * held[0] or not held[best]:
            break
        root = best
    below = [False] * len(elements)
    for e, (parent, _) in enumerate(elements):
        below[e] = e == root or (parent >= 0 and below[parent])
    body = [k for k in free if below[lines[k][4]]]
    chosen = [k for k in body if mass[k]]
    if not chosen:
        return ""
    parents = {elements[lines[k][4]][0] for k in chosen} | {lines[k][4] for k in chosen}
    keep = lambda k: mass[k] or (2 * lines[k][2] < len(lines[k][0]) and (chosen[0] < k < chosen[-1] or lines[k][4] in parents or elements[lines[k][4]][0] in parents))
    return " ".join(lines[k][0] for k in body if keep(k))


def extract_main(pages: DataFrame, sigma: float = 1.0, spread: float = 0.8, share: float = 0.9) -> DataFrame:
    """page_id, url, text, n_chars of pages (page_id, url, html)."""

    @F.pandas_udf("string")
    def text_of(html: pd.Series) -> pd.Series:
        return html.map(lambda h: main_text(h, sigma, spread, share))

    return pages.select("page_id", "url", text_of("html").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
