"""Main text of web pages, by parser events and text-to-tag ratios.

The standard library's parser is fed a page piece by piece.  Its events build lines: a line is the text
of one block element, with the number of tags met in it and the elements it stands in.  Elements that hold
no article (menus, scripts, notices, ...) get no text.  Forms and elements with a telling class or id get none
either, unless they hold most of the page's text outside links, or its only article or main element.  The
ratios of text length to tags of the lines with text, cut off at ten times their median, are smoothed with a
Gaussian; lines over a threshold (the ratios' deviation, or half the peak where that is less) are dense,
if not in links alone.  The
content is all main elements, if any line of theirs is dense and they hold half of the text outside links that is left, or all but
``STORY`` letters of it; else all articles, if they do; else the lowest element that holds all dense lines and top headings, and what that stands in below the body
as far as it adds no more text in links than other text.  All lines of the content are the text, short ones too.

Character references are decoded, white space inside a line becomes one space, lines are trimmed, empty
ones go, and the others are joined by newlines in page order.

Edge cases: a null, empty or tag-less page gives its text, or an empty string; a tag that is never closed takes the rest of
the page, as in browsers; open elements are closed as they must be; a page's cost is linear in its length;
repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

import math
import re
import statistics
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import small_batches, table

CHUNK = 1 << 16
SIGMA, REACH = 1.0, 2
#: Letters that are a story: fewer beside an article or main element don't show that it is but a teaser.
STORY = 300

#: Elements by what they do to lines.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table "
    "tbody td tfoot th thead title tr ul".split()
)
NO_ARTICLE = set("aside button canvas dialog footer form head iframe menu nav noscript object script search select style svg template textarea title".split())
CONTAINER = set("article body div main section td".split())
CLOSED_BY_BLOCK = "p"
CLOSED_BY_SAME = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
PAGE = ("", "html", "body")
ARTICLE = ("article", "main")
#: Words of class, id and role that mark what is no article.
NO_ARTICLE_WORDS = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr "
    "login masthead menu modal nav navbar navigation newsletter notice notices overlay pagination pager popup promo promoted promotion related "
    "replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
#: Those of what may be longer than its article; words that say what a page has or lacks.
DISCUSSION_WORDS = set("comment comments disqus related replies reply respond".split())
ABOUT_WORDS = set("has hide no not with without".split())
NO_ARTICLE_ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
_WORD = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_TAG = re.compile(r"<[A-Za-z/!?]|<\Z")


#: How an element is marked: not, by a word or as a form, by a word of discussions, for certain.
PLAIN, MAYBE, DISCUSSION, NONE = range(4)


class Lines(HTMLParser):
    """``lines``: (parts, tags) of each block in page order, a part being (text, element).  Elements are numbered
    from 1 as they open, 0 is the page; ``parent``, ``tag``, ``mark`` and ``link`` (within one) are lists by number."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[list[tuple[str, int]], int]] = []
        self.open: list[tuple[str, int]] = []  # name, element
        self.places: dict[str, list[int]] = {}  # of the open elements of each name
        self.parent, self.tag, self.mark, self.link, self.inside = [0], [""], [PLAIN], [False], [False]  # inside an article or main element
        self.parts: list[tuple[str, int]] = []
        self.tags = 0

    def _at(self) -> int:
        return self.open[-1][1] if self.open else 0

    def _end_line(self) -> None:
        if self.parts:
            self.lines.append((self.parts, self.tags))
        self.parts, self.tags = [], 0

    def _pop_to(self, place: int) -> None:
        for name, _ in self.open[place:]:
            self.places[name].pop()
        del self.open[place:]

    def _last(self, names: set[str]) -> int:
        """Where the innermost open element of one of these names stands, or -1."""
        return max((held[-1] for name in names if (held := self.places.get(name))), default=-1)

    def _close_open(self, names: set[str], within: set[str]) -> None:
        place = self._last(names)
        if place >= 0 and place > self._last(within - names):
            self._pop_to(place)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self._end_line()
            self._close_open({CLOSED_BY_BLOCK}, CONTAINER | {"blockquote", "li", "th", "button"})
            if tag in CLOSED_BY_SAME:
                self._close_open({"dt", "dd"} if tag in ("dt", "dd") else {"td", "th"} if tag in ("td", "th") else {tag}, CLOSED_BY_SAME[tag])
        elif tag == "br":
            self.parts.append((" ", self._at()))
        self.tags += 1
        if tag in VOID:
            return
        up = self._at()
        mark = NONE if tag in NO_ARTICLE and tag != "form" or tag == "header" and not self.inside[up] else PLAIN if tag in ("html", "body", "main") else self._marked(attrs)
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, len(self.parent)))
        self.parent.append(up)
        self.tag.append(tag)
        self.mark.append(max(mark, MAYBE) if tag == "form" else mark)
        self.link.append(tag == "a" or self.link[up])
        self.inside.append(tag in ARTICLE or self.inside[up])

    @staticmethod
    def _marked(attrs: list[tuple[str, str | None]]) -> int:
        mark = PLAIN
        for name, value in attrs:
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and value and _HIDDEN.search(value)):
                return NONE
            if name in ("class", "id") and value:
                for one in value.split():
                    words = {w.lower() for w in _WORD.findall(one)}
                    if words & NO_ARTICLE_WORDS and not words & ABOUT_WORDS:
                        mark = max(mark, DISCUSSION if words & DISCUSSION_WORDS else MAYBE)
            if name == "role" and value and value.lower() in NO_ARTICLE_ROLES:
                if value.lower() != "form":
                    return NONE
                mark = max(mark, MAYBE)
        return mark

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("p", "div", "span", "b", "i", "a"):  # as browsers do, these stay open
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        place = self._last({tag})
        if place < 0:
            return
        if tag in BLOCK or any(name in BLOCK for name, _ in self.open[place + 1 :]):
            self._end_line()
        self.tags += 1
        self._pop_to(place)

    def handle_data(self, data: str) -> None:
        self.parts.append((data, self._at()))

    def read(self, page: str) -> None:
        # no tag that opens after the last ">" ends; the first such takes the rest with it, and none is looked for twice
        cut = _TAG.search(page, page.rfind(">") + 1)
        page = page[: cut.start()] if cut else page
        for at in range(0, len(page), CHUNK):
            self.feed(page[at : at + CHUNK])
        self.close()
        self._end_line()

    def up(self, values: list[int]) -> list[int]:
        """Sums of the values of each element and those within."""
        out = list(values)
        for e in range(len(out) - 1, 0, -1):
            out[self.parent[e]] += out[e]
        return out

    def within(self, chosen: list[bool]) -> list[bool]:
        """Which elements are chosen, or within a chosen one."""
        out = list(chosen)
        for e in range(1, len(out)):
            out[e] = out[e] or out[self.parent[e]]
        return out

    def dropped(self) -> list[bool]:
        """Which elements get no text."""
        never, marked = self.within([m == NONE for m in self.mark]), self.within([m != PLAIN for m in self.mark])
        own, strict = [0] * len(self.parent), [0] * len(self.parent)
        for parts, _ in self.lines:
            for text, e in parts:
                n = 0 if never[e] or self.link[e] else len("".join(text.split()))
                own[e] += n
                strict[e] += 0 if marked[e] else n
        held, strict = self.up(own), self.up(strict)
        article = [t in ARTICLE and held[e] > 0 for e, t in enumerate(self.tag)]
        clear = any(a and strict[e] for e, a in enumerate(article))
        articles = self.up([int(a and self.mark[e] == PLAIN and not never[e]) for e, a in enumerate(article)])

        def stays(e: int) -> bool:
            if self.mark[e] == MAYBE and articles[e] and not clear:
                return True
            return held[e] * 2 > held[0] and (self.mark[e] == MAYBE or not strict[0])

        return self.within([m == NONE or m != PLAIN and not stays(e) for e, m in enumerate(self.mark)])


_KERNEL = [math.exp(-(i * i) / (2 * SIGMA * SIGMA)) for i in range(-REACH, REACH + 1)]


def smoothed(ratios: list[float]) -> list[float]:
    """Gaussian means; at the ends over the lines that are there."""
    out = []
    for i in range(len(ratios)):
        lo, hi = max(0, i - REACH), min(len(ratios), i + REACH + 1)
        weights = _KERNEL[lo - i + REACH : hi - i + REACH]
        out.append(sum(w * r for w, r in zip(weights, ratios[lo:hi])) / sum(weights))
    return out


def main_text(page: str | None) -> str:
    doc = Lines()
    doc.read(page or "")
    dropped = doc.dropped()
    lines = []  # text, its elements, ratio
    for parts, tags in doc.lines:
        parts = [p for p in parts if not dropped[p[1]]]
        if text := " ".join("".join(t for t, _ in parts).split()):
            lines.append((text, {e for t, e in parts if t.strip()}, len(text) / max(1, tags)))
    if not lines:
        return ""
    most = 10 * statistics.median(r for _, _, r in lines)
    ratios = smoothed([min(r, most) for _, _, r in lines])
    mean = sum(ratios) / len(ratios)
    deviation = math.sqrt(sum((r - mean) ** 2 for r in ratios) / len(ratios))
    least = min(deviation, max(ratios) / 2)
    anchors = [0] * len(dropped)
    dense = [elements for (_, elements, _), r in zip(lines, ratios) if r >= least]
    for elements in [d for d in dense if not all(doc.link[e] for e in d)] or dense:
        for e in elements:
            anchors[e] += 1
    words = [0] * len(dropped)  # outside links
    for parts, _ in doc.lines:
        for text, e in parts:
            words[e] += 0 if dropped[e] or doc.link[e] else len("".join(text.split()))
    content = None
    for kind in ("main", "article"):
        chosen = doc.within([t == kind for t in doc.tag])
        inside = sum(n for e, n in enumerate(words) if chosen[e])
        if any(n and chosen[e] for e, n in enumerate(anchors)) and sum(words) - inside <= max(inside, STORY):
            content = chosen
            break
    if content is None:
        heading = doc.within([t == "h1" for t in doc.tag])
        for _, elements, _ in lines:
            for e in elements:
                anchors[e] += heading[e]
        region = _region(doc, anchors, lines)
        content = doc.within([e == region for e in range(len(dropped))])
    out = []
    for parts, _ in doc.lines:
        if text := " ".join("".join(t for t, e in parts if content[e] and not dropped[e]).split()):
            out.append(text)
    return "\n".join(out)


def _region(doc: Lines, anchors: list[int], lines: list[tuple[str, set[int], float]]) -> int:
    """The element that holds all anchors, and what it stands in as far as that is content too."""
    below = doc.up(anchors)
    at = max(e for e, n in enumerate(below) if n == below[0])  # elements within come later
    while at and doc.tag[at] not in CONTAINER:
        at = doc.parent[at]
    words, links = [0] * len(anchors), [0] * len(anchors)
    for text, elements, _ in lines:
        linked = all(doc.link[e] for e in elements)
        (links if linked else words)[min(elements)] += len(text)
    words, links = doc.up(words), doc.up(links)
    while doc.tag[at] not in PAGE and doc.tag[up := doc.parent[at]] not in PAGE and words[up] - words[at] >= links[up] - links[at]:
        at = up
    return at


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text, n_chars of every row."""
    small_batches(pages.sparkSession)

    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages_ in batches:
            yield pages_.map(main_text, na_action=None)

    text = F.pandas_udf(read, "string")(F.coalesce(F.col(html_col).cast("string"), F.lit("")))
    return pages.select(id_col, url_col, text.alias("text")).select(id_col, url_col, "text", F.length("text").cast("bigint").alias("n_chars"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
