"""Main text of web pages: text-to-tag ratios per line, Gaussian smoothing, and a threshold over the clusters.

One pass of the standard library's parser turns a page into lines, one per block element, each with the number of tags
it took and the elements it stands in. Smoothed ratios above the page's spread mark the content lines. The region is the
element that holds them: an article or main element where one holds most of their text, else the smallest element that
holds nearly all of it. All its lines are kept in page order, but for those in menus, headers, footers, sidebars, notices,
adverts, forms and reader comments, be they elements of their own or words inside a line. Outside of article elements,
containers without a content line whose text stands mostly in links are menus. Where no element but the page itself holds
the content lines, lines before the first and after the last of them stay only in the container of that line, and headings
in front.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunewright.llm.common import beside, text_of, with_results

# Choices of this library.
#: Standard deviation of the smoothing, in lines.
SMOOTH = 1.0
#: Share of the content lines' text that an article element, or any other element, must hold to be the region.
ARTICLE_SHARE, REGION_SHARE = 0.5, 0.95
#: An element hinted at by its class alone is not left out if it holds more than this share of the page's text.
WHOLE_SHARE = 0.6
#: A container without content lines is a menu if links hold more than this share of its text.
LINK_SHARE = 0.6

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style template noscript iframe svg math canvas object audio video map datalist".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table "
    "tbody td tfoot th thead title tr ul".split())
OUTSIDE = frozenset("nav footer aside form button select textarea label fieldset dialog menu search".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar".split())
CONTENT = frozenset(["article", "main"])
PAGE = frozenset(["", "html", "body"])
# A start tag on the left ends open elements on the right that stand above the nearest container.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"},
        "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
HOLDERS = frozenset("ul ol dl table select article section div body main aside nav footer header form".split())
# Words of a class or id that name what is not the article. A name counts if it is made of them and of words for a shape
# or a place alone: "share-bar" does, "share-price" does not.
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notices notification newsletter subscribe subscription paywall popup modal overlay sidebar side rail menu nav "
    "navbar navigation breadcrumb breadcrumbs pagination pager toolbar topbar masthead header footer related recommended "
    "recommendations share sharing social widget widgets login signup search form skip".split())
COMMENTS = frozenset("comment comments commentlist disqus".split())
REPLIES = frozenset("respond replies reviews discussion".split())
SHAPES = frozenset(
    "a area articles bar block body bottom box btn button buttons center col column container content count counter cta "
    "desktop element global group holder icon icons icn inner item items left level line link links list main mobile module "
    "outer page panel posts primary right row secondary section site slot small stories sticky tab text the title toggle "
    "top unit view wrap wrapper zone".split())
_words = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def named_for(names: str, words: frozenset[str]) -> bool:
    """Whether one of the names holds one of the words, and otherwise only words for a shape or a place."""
    for name in names.split():
        parts = {w.lower() for w in _words.findall(name)}
        if parts & words and parts <= words | HINTS | SHAPES:
            return True
    return False


class Lines(HTMLParser):
    """Collects (pieces of text with their element, tags, block element) per line and (parent, tag, left out, hinted) per
    element."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[list[tuple[str, int]], int, int]] = []
        self.elements: list[tuple[int, str, bool, bool]] = [(-1, "", False, False)]
        self.stack: list[tuple[str, int]] = [("", 0)]
        self.text: list[tuple[str, int]] = []
        self.tags = 0
        self.hidden = 0

    def _end_line(self) -> None:
        pieces, self.text = self.text, []
        if any(text and not text.isspace() for text, _ in pieces):
            block = next(number for tag, number in reversed(self.stack) if tag in BLOCKS or not number)
            self.lines.append((pieces, self.tags, block))
            self.tags = 0

    def _close(self, depth: int) -> None:
        """Close open elements from ``depth`` on."""
        if any(tag in BLOCKS for tag, _ in self.stack[depth:]):
            self._end_line()
        for tag, _ in self.stack[depth:]:
            self.hidden -= tag in HIDDEN
        del self.stack[depth:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag == "br":
            self.text.append((" ", self.stack[-1][1]))
            return
        if tag in BLOCKS:
            ended = ENDS.get(tag, frozenset())
            for depth in range(len(self.stack) - 1, 0, -1):
                open_ = self.stack[depth][0]
                if open_ == "p" or open_ in ended:
                    self._close(depth)
                    if open_ == "p" and not ended:
                        break
                elif open_ in HOLDERS:
                    break
            self._end_line()
        if tag in VOID:
            return
        named = dict(attrs)
        names = f"{named.get('class') or ''} {named.get('id') or ''}"
        words = {w.lower() for w in _words.findall(names)}
        invisible = "hidden" in named or (named.get("aria-hidden") or "").lower() == "true" \
            or "display:none" in (named.get("style") or "").replace(" ", "").lower()
        role = (named.get("role") or "").lower()
        whole = tag in CONTENT or tag in ("html", "body")
        talk = bool(words & COMMENTS) or named_for(names, REPLIES)
        out = tag in OUTSIDE or invisible or role in ROLES or (talk and tag not in ("html", "body"))
        hinted = not whole and named_for(names, HINTS)
        kind = "main" if role in ("main", "article") else tag
        self.elements.append((self.stack[-1][1], kind, out, hinted))
        self.stack.append((tag, len(self.elements) - 1))
        self.hidden += tag in HIDDEN

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        # In HTML a slash at the end of a start tag means nothing, but for void elements.
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag == "p" and not any(t == "p" for t, _ in self.stack):
            self._end_line()
            return
        for depth in range(len(self.stack) - 1, 0, -1):
            open_ = self.stack[depth][0]
            if open_ == tag:
                self._close(depth)
                return
            # An inline end tag does not reach out of its block, nor a p or li out of its container.
            if (tag not in BLOCKS and open_ in BLOCKS) or (tag in ("p", "li", "td", "tr") and open_ in HOLDERS):
                return

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.text.append((data, self.stack[-1][1]))

    def close(self) -> None:
        super().close()
        self._end_line()


def smoothed(ratios: np.ndarray, deviation: float = SMOOTH) -> np.ndarray:
    """Gaussian smoothing over lines; the ends repeat."""
    width = max(1, int(np.ceil(2 * deviation)))
    weights = np.exp(-0.5 * (np.arange(-width, width + 1) / deviation) ** 2)
    return np.convolve(np.pad(ratios, width, mode="edge"), weights / weights.sum(), mode="valid")


def main_text(html: str) -> str:
    """Lines of the content region, joined by line feeds; empty if there are none."""
    parser = Lines()
    parser.feed(html)
    parser.close()
    lines, elements = parser.lines, parser.elements
    if not lines:
        return ""
    # Text below each element, and what of it stands in links.
    mass, linked = np.zeros(len(elements)), np.zeros(len(elements))
    for pieces, _, _ in lines:
        for text, at in pieces:
            mass[at] += len(text.strip())
    for number in range(len(elements) - 1, 0, -1):
        if elements[number][1] == "a":
            linked[number] = mass[number]
        mass[elements[number][0]] += mass[number]
        linked[elements[number][0]] += linked[number]
    out = [False] * len(elements)
    article = [False] * len(elements)
    for number in range(1, len(elements)):
        parent, tag, left_out, hinted = elements[number]
        article[number] = article[parent] or tag in CONTENT
        header = tag == "header" and not article[parent]
        small = mass[number] <= WHOLE_SHARE * mass[0]
        out[number] = out[parent] or left_out or header or (hinted and small)

    def in_header(at: int) -> bool:
        """In an article's header only its headings belong to the text."""
        heading = False
        while at > 0:
            heading = heading or elements[at][1] in HEADINGS
            if elements[at][1] == "header":
                return not heading
            at = elements[at][0]
        return False

    texts = [" ".join("".join(text for text, at in pieces if not out[at]).split()) for pieces, _, _ in lines]
    inside = np.array([bool(text) and not out[at] for text, (_, _, at) in zip(texts, lines, strict=True)])
    if not inside.any():
        return ""
    # What is left out weighs with its text too: it is part of the page that the clusters are taken from.
    sizes = np.array([len(text) or sum(len(t.strip()) for t, _ in pieces) for text, (pieces, _, _) in zip(texts, lines, strict=True)])
    ratios = smoothed(sizes / np.maximum([tags for _, tags, _ in lines], 1))
    content = inside & (ratios >= min(ratios.std(), ratios[inside].max()))
    # Text of the content lines below each element.
    held = np.zeros(len(elements))
    for (_, _, at), size, is_content in zip(lines, sizes, content, strict=True):
        held[at] += size * is_content
    for number in range(len(elements) - 1, 0, -1):
        held[elements[number][0]] += held[number]
    region = 0
    semantic = [n for n in range(1, len(elements)) if elements[n][1] in CONTENT and not out[n] and held[n] >= ARTICLE_SHARE * held[0]]
    if semantic:
        region = max(semantic, key=lambda n: (elements[n][1] == "article", n))
    else:
        for number in range(1, len(elements)):
            if held[number] >= REGION_SHARE * held[0] and elements[number][1] in HOLDERS and elements[number][0] == _nearest(elements, number, region):
                region = number
    below = [n == region for n in range(len(elements))]
    for number in range(1, len(elements)):
        below[number] = below[number] or below[elements[number][0]]
    menu = [False] * len(elements)
    if not semantic:
        for number in range(region + 1, len(elements)):
            own = elements[number][1] in HOLDERS and not held[number] and linked[number] > LINK_SHARE * mass[number]
            menu[number] = menu[elements[number][0]] or own
    chosen = [i for i, (_, _, at) in enumerate(lines) if below[at] and inside[i] and not menu[at] and not in_header(at)]
    if not semantic and elements[region][1] in PAGE and content.any():
        # The whole page was chosen: beyond the content lines only what stands in the container of the first or last.
        first, last = np.flatnonzero(content)[[0, -1]]
        holder = [_holder(elements, at) for _, _, at in lines]
        chosen = [i for i in chosen if first <= i <= last or holder[i] == holder[first if i < first else last]
                  or elements[lines[i][2]][1] in HEADINGS and i < first]
    return "\n".join(texts[i] for i in chosen)


def _holder(elements: list[tuple[int, str, bool, bool]], at: int) -> int:
    """The nearest container of an element, itself included."""
    while at > 0 and elements[at][1] not in HOLDERS:
        at = elements[at][0]
    return at


def _nearest(elements: list[tuple[int, str, bool, bool]], number: int, region: int) -> int:
    """The parent if ``number`` lies below ``region``, else no element."""
    at = elements[number][0]
    while at > 0 and at != region:
        at = elements[at][0]
    return elements[number][0] if at == region else -2


def extracted(pages: DataFrame, html_name: str = "html") -> DataFrame:
    """The pages' columns with text and n_chars (code points).

    Null or empty html, or a page without any content line: empty text. Repeated rows: each alike. Empty table: empty
    result. An input column named like a result is replaced by the result. Rows stay in their partitions.
    """
    df = beside(pages, html=text_of(html_name))
    schema = df.select("_row").withColumn("text", F.lit("")).schema

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(html.as_py()) for html in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["_row", "text"])

    out = df.mapInArrow(texts, schema)
    return out.select(*with_results(pages.columns, {"text": F.col("text"), "n_chars": F.length("text").cast("long")}))
