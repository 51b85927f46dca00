"""Main text of a web page by the distribution of text over its lines.

Markup is stripped and every block becomes a line. Boilerplate (menus, forms, adverts, comments and the like, by
element, role, class or id) becomes empty lines, unless it holds an article or, where only its name tells, half of the
page's text. The text length summed over a sliding window of lines surges where the article begins and dives to zero where
it ends; the lines between a surge and the next dive are kept. An article element adds weight to its lines: any text
surges there, while text elsewhere must be half as dense as in the article. A dropped block inside the article is a gap:
what follows in the same element goes on.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines per window, and the text in a window that counts as a surge where no element marks the article.
LINES = 3
SURGE = 80

# Elements that are never article text; the content of the first group is not markup.
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_DROPPED = _RAW | frozenset("head button select noscript template svg math object canvas dialog audio video map".split())
# Elements that are no article text unless an article lies in them.
_AROUND = frozenset("nav footer aside form menu".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
_BLOCK = frozenset(
    "address article blockquote body center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hgroup hr html li main ol "
    "p pre section summary table caption tbody thead tfoot tr ul".split()
)
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
# An element closed by the start of another one.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
# Words in a class or id that mark boilerplate.
_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox banner sponsor sponsored sponsors promo promotion cookie cookies consent gdpr notice "
    "notices notification popup modal overlay newsletter subscribe subscription signup login sidebar widget widgets nav navbar navigation menu "
    "menus breadcrumb breadcrumbs header masthead topbar footer comment comments disqus reply replies share sharing social related recommended "
    "recommendations teaser teasers pagination pager search toolbar skip paywall disclaimer copyright form".split()
)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.DOTALL
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|(?<=\s)(hidden)(?=[\s/]|$)""", re.DOTALL)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


# How sure it is that an element is boilerplate: kept, told by its name, by its kind, whatever it holds.
_KEPT, _NAMED, _KIND, _ALWAYS = range(4)


def _boilerplate(name: str, attributes: str, in_article: bool) -> int:
    if name in _DROPPED:
        return _ALWAYS
    sure = _KIND if name in _AROUND or name == "header" and not in_article else _KEPT
    if name == "form":
        sure = _NAMED
    if not attributes or name in ("html", "body", "main", "article") and "comment" not in attributes.lower():
        return sure
    for key, a, b, c, hidden in _ATTRIBUTE.findall(attributes):
        value = a or b or c
        key = key.lower()
        if hidden or key == "hidden" or (key == "aria-hidden" and value == "true"):
            return _ALWAYS
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
            return _ALWAYS
        if key == "role" and value.lower() in _ROLES:
            sure = max(sure, _KIND)
        if key in ("class", "id"):
            names = _NAMES.intersection(w.lower() for w in _WORDS.findall(value))
            # the head of an article is read like its header element
            if names and not (in_article and names == {"header"}):
                sure = max(sure, _NAMED)
    return sure


class _Element:
    """An open or closed element: whether and how surely it is boilerplate, and what it holds."""

    __slots__ = ("name", "sure", "parent", "article", "holds_article", "size", "flagged", "header", "link", "paragraph", "heading", "_gone")

    def __init__(self, name: str, sure: int, parent: _Element | None) -> None:
        self.name, self.sure, self.parent = name, sure, parent
        # 2: in an article, 1: in a main element only
        self.article = 2 if name == "article" else max(parent.article if parent else 0, int(name == "main"))
        self.holds_article = False
        self.size = 0
        # the nearest element around, itself included, that may be boilerplate
        self.flagged: _Element | None = self if sure else parent.flagged if parent else None
        self.header = name == "header" or parent is not None and parent.header
        self.link = name == "a" or parent is not None and parent.link
        self.paragraph = name == "p" or parent is not None and parent.paragraph
        self.heading = name in _HEADING or parent is not None and parent.heading
        self._gone: bool | None = None

    def gone(self, size: int) -> bool:
        """Whether it is dropped from a page of ``size`` characters."""
        chain, at, gone = [], self.flagged, False
        while at is not None and at._gone is None:
            chain.append(at)
            at = at.parent.flagged if at.parent else None
        if at is not None:
            gone = at._gone
        for at in reversed(chain):
            gone = gone or at.sure == _ALWAYS or not at.holds_article and (at.sure == _KIND or 2 * at.size < size)
            at._gone = gone
        return gone


class _Line:
    __slots__ = ("text", "plain", "element", "heading", "gap")

    def __init__(self, text: str, plain: int, element: _Element | None, heading: bool, gap: bool = False) -> None:
        self.text, self.plain, self.element, self.heading, self.gap = text, plain, element, heading, gap


class _Page:
    """Lines of a page: text, the part of it outside links, and the element around it."""

    def __init__(self) -> None:
        self.lines: list[_Line] = []
        self.stack: list[_Element] = []
        self.parts: list[str] = []
        self.linked = 0
        self.size = 0
        self.elements: list[_Element] = []

    def dropped(self) -> bool:
        return bool(self.stack) and self.stack[-1].flagged is not None and self.stack[-1].flagged.sure == _ALWAYS

    def text(self, raw: str) -> None:
        if self.dropped():
            return
        value = _html.unescape(raw)
        self.parts.append(value)
        if self.stack and self.stack[-1].link:
            self.linked += len(value)

    def end_line(self) -> None:
        if self.parts:
            value = " ".join("".join(self.parts).split())
            if value:
                top = self.stack[-1] if self.stack else None
                self.lines.append(_Line(value, max(0, len(value) - self.linked), top, top is not None and top.heading))
                self.size += len(value)
                if top is not None:
                    top.size += len(value)
            self.parts, self.linked = [], 0

    def open(self, name: str, attributes: str) -> None:
        if name in _BLOCK:
            self.end_line()
            while self.stack and self.stack[-1].paragraph and name not in ("tr", "tbody"):
                at = max(k for k, e in enumerate(self.stack) if e.name == "p")
                if any(e.name in _BLOCK or e.name in _DROPPED for e in self.stack[at + 1 :]):
                    break
                del self.stack[at:]
        elif name == "br" or name in ("td", "th"):
            if not self.dropped():
                self.parts.append(" ")
        if name in _VOID:
            return
        if name in _CLOSES:
            for at in range(len(self.stack) - 1, -1, -1):
                if self.stack[at].name in _CLOSES[name]:
                    del self.stack[at:]
                    break
                if self.stack[at].name in ("ul", "ol", "dl", "table", "select", "menu"):
                    break
        parent = self.stack[-1] if self.stack else None
        sure = _boilerplate(name, attributes, parent is not None and parent.article > 0)
        if sure:
            self.end_line()
        element = _Element(name, sure, parent)
        element.holds_article = name in ("article", "main") and not sure
        self.elements.append(element)
        if sure:
            self.lines.append(_Line("", 0, element, False, gap=True))
        self.stack.append(element)

    def close(self, name: str) -> None:
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at].name == name:
                if name in _BLOCK or self.stack[at].sure:
                    self.end_line()
                del self.stack[at:]
                return
        if name in _BLOCK:
            self.end_line()


def page_of(page: str) -> _Page:
    found, at = _Page(), 0
    while True:
        token = _TOKEN.search(page, at)
        if token is None:
            found.text(page[at:])
            break
        if token.start() > at:
            found.text(page[at : token.start()])
        at = token.end()
        if not token[2]:
            continue
        name = token[2].lower()
        if token[1]:
            found.close(name)
            continue
        found.open(name, token[3])
        if name in _RAW:
            # up to the end tag whatever stands between
            end = re.compile(rf"</{re.escape(name)}\s*>", re.IGNORECASE).search(page, at)
            at = end.start() if end else len(page)
    found.end_line()
    # what an element holds counts for those around it
    for element in reversed(found.elements):
        if element.parent is not None:
            element.parent.size += element.size
            element.parent.holds_article |= element.holds_article
    return found


def _container(line: _Line) -> _Element | None:
    """The element around a line's own block."""
    e = line.element
    if e is not None and e.name in ("p", "li", "pre", *_HEADING):
        e = e.parent
    return e


def main_text(page: str | None) -> str:
    """Text of the article, one line per block; empty for a page without any."""
    found = page_of(page or "")
    lines: list[_Line] = []
    for line in found.lines:
        gone = line.element is not None and line.element.gone(found.size)
        if line.gap:
            if gone:
                lines += [line] * LINES
        elif not gone:
            # of a header inside the article only headings and text as long as a paragraph belong to it
            in_head = line.element is not None and line.element.header
            if not in_head or line.heading or line.plain >= SURGE:
                lines.append(line)
    # a main element counts only where there is no article
    most = max((x.element.article for x in lines if x.text and x.element is not None), default=0)
    within = [most > 0 and x.element is not None and x.element.article == most for x in lines]
    weights = [len(x.text) if w else x.plain for x, w in zip(lines, within)]
    windows = [sum(weights[i : i + LINES]) for i in range(len(lines))]
    inner = max((n for n, w in zip(windows, within) if w), default=0)
    outer = max(SURGE, inner // 2)
    if windows and max(windows) < outer and not inner:
        outer = max(1, max(windows))  # a short page: its fullest windows
    kept: list[str] = []
    inside, last = False, None
    for i, line in enumerate(lines):
        surge = 1 if within[i] else outer
        # the surge counts from its first line with text on; the dive is the first window without any
        if not inside and weights[i] and (windows[i] >= surge or last is not None and _container(line) is last):
            inside = True
        elif inside and not windows[i]:
            inside = False
        elif inside and inner and not within[i] and weights[i] and windows[i] < outer and _container(line) is not last:
            inside = False  # out of the article into thinner text
        if inside and line.text and (weights[i] or not inner):
            kept.append(line.text)
            last = _container(line)
    return "\n".join(kept)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, max(1, batch.num_rows), 1000):
            part = batch.slice(at, 1000)
            texts = [main_text(x.as_py()) for x in part.column(2)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["id", "url", "text", "n_chars"],
            )


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) per row: no exchange, one page at a time. A null page is empty; other columns are not read."""
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(_extract, f"id {kind}, url string, text string, n_chars long")


def digest(pages: DataFrame) -> DataFrame:
    """The columns of the query."""
    return extract(pages).withColumnRenamed("id", "page_id")
