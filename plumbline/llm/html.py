"""Main text of web pages by tree scoring.

A forgiving parser turns a page into a tree of block elements and blocks of text. Elements that are never article (menus,
forms, comments, ...) go by tag, role or the words of their class and id. Each block of some length gives points for
its length and commas to its ancestors, less at each step up; an element's points are discounted by its link density.
The best element is the container; it grows to the article around it, and siblings with enough points are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

LEAST_BLOCK = 25
#: Share of a block's points that its parent, grandparent, ... get.
STEPS = (1.0, 0.5, 0.25, 0.125)
SEMANTIC_POINTS = 25.0
SIBLING_SHARE = 0.2
#: A list or box of at least this many links, with so much of its text in links, is a menu.
MENU_LINKS, MENU_DENSITY = 2, 0.7
#: An element named like something else that yet holds more than this share of the paragraph text counts, at a discount.
MOST_TEXT, NAME_DISCOUNT = 0.5, 0.25

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""")
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong "
                    "sub sup time tt u var wbr img br".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg math object video audio canvas select".split())
_NEVER = frozenset("nav footer aside form button dialog menu head fieldset datalist map".split())
_KEPT = frozenset("html body main article".split())
_NEVER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of classes and ids of elements that are not part of an article.
_NEVER_WORDS = frozenset(
    "ad ads adsense advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie "
    "cookies disqus disclaimer donate footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification "
    "overlay pager pagination paywall popover popup promo promoted promotion recommended related reply replies respond sharing "
    "share shares sidebar signup social sponsor sponsored sponsors subscribe subscription taboola teaser toast toolbar "
    "tooltip widget widgets".split())
_SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
                 "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"},
                 "tfoot": {"tr", "td", "th", "tbody"}}
_SCOPES = {"li": {"ul", "ol", "menu"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "dt": {"dl"}, "dd": {"dl"}, "thead": {"table"},
           "tbody": {"table"}, "tfoot": {"table"}}


class Page:
    """A parsed page: block elements in page order, and blocks of text."""

    def __init__(self, source: str):
        self.tags, self.parents, self.never, self.semantic = ["#page"], [-1], [False], [False]
        #: Elements whose class or id has a word that articles do not have.
        self.named = [False]
        #: (element, text, characters in links) of each block of text.
        self.blocks: list[tuple[int, str, int]] = []
        self.links = [0]
        self._stack = [0]
        self._text: list[str] = []
        self._link_chars = 0
        self._in_link = False
        self._open: dict[str, int] = {}
        self._parse(source)

    def _flush(self) -> None:
        if self._text:
            text = " ".join(unescape("".join(self._text)).split())
            if text:
                self.blocks.append((self._stack[-1], text, min(self._link_chars, len(text))))
            self._text, self._link_chars = [], 0

    def _pop(self) -> None:
        self._open[self.tags[self._stack[-1]]] -= 1
        self._stack.pop()

    def _push(self, tag: str, attributes: str) -> None:
        named = {}
        if attributes.strip(" /\n\t\r"):
            for name, value in _ATTRIBUTE.findall(attributes):
                named.setdefault(name.lower(), value.strip("\"'"))
        parent = self._stack[-1]
        role = named.get("role", "").lower()
        words = {w.lower() for w in _NAME_WORD.findall(named.get("class", "") + " " + named.get("id", ""))}
        semantic = tag in ("article", "main") or role in ("main", "article") or named.get("itemprop", "").lower() == "articlebody"
        inside = any(self.semantic[k] for k in self._stack[1:])
        never = (tag in _NEVER or role in _NEVER_ROLES or "hidden" in named or named.get("aria-hidden", "").lower() == "true"
                 or re.search(r"display\s*:\s*none", named.get("style", ""), re.I) is not None
                 or not inside and tag == "header")
        self.tags.append(tag)
        self.parents.append(parent)
        self.never.append(self.never[parent] or never)
        self.named.append(tag not in ("html", "body", "main") and bool(words & _NEVER_WORDS) or not inside and tag not in _KEPT and "header" in words)
        self.semantic.append(semantic)
        self.links.append(0)
        self._stack.append(len(self.tags) - 1)
        self._open[tag] = self._open.get(tag, 0) + 1

    def _start(self, tag: str, attributes: str) -> None:
        self._flush()
        if tag in ("html", "body") and self._open.get(tag):
            return
        if tag == "body" and self._open.get("head"):
            self._close("head")
        if tag in _SELF_CLOSING:
            ends, scope = _SELF_CLOSING[tag], _SCOPES.get(tag, set())
            for depth in range(len(self._stack) - 1, 0, -1):
                name = self.tags[self._stack[depth]]
                if name in ends:
                    while len(self._stack) > depth:
                        self._pop()
                    if tag not in ("tr", "thead", "tbody", "tfoot"):
                        break
                elif name in scope or name not in ("p", "b", "i"):
                    break
        elif self.tags[self._stack[-1]] == "p":
            self._pop()
        self._push(tag, attributes)
        if tag in _VOID:
            self._pop()

    def _close(self, tag: str) -> None:
        if self._open.get(tag):
            self._flush()
            while self.tags[self._stack[-1]] != tag:
                self._pop()
            self._pop()

    def _add(self, text: str) -> None:
        if text:
            self._text.append(text)
            if self._in_link:
                self._link_chars += len(" ".join(unescape(text).split()))

    def _parse(self, source: str) -> None:
        at, n = 0, len(source)
        while at < n:
            token = _TOKEN.search(source, at)
            if token is None:
                self._add(source[at:])
                break
            self._add(source[at:token.start()])
            at = token.end()
            slash, tag, attributes = (token[1], token[2], token[3]) if token[2] else (token[4], token[5], token[6])
            if not tag:
                continue
            tag = tag.lower()
            if tag in _RAW:
                if not slash and not attributes.endswith("/"):
                    end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(source, at)
                    at = end.end() if end else n
            elif tag == "a":
                self._in_link = not slash
                self.links[self._stack[-1]] += not slash
            elif tag == "br":
                self._text.append(" ")
            elif tag in _INLINE:
                pass
            elif slash:
                self._in_link = False
                self._close(tag)
            else:
                self._start(tag, attributes)
        self._flush()


def _unnamed(page: Page) -> tuple[list[bool], list[float]]:
    """Elements that are not part of an article, by tag, role or name, and the discount of each.

    A name removes neither what the page's largest article or main stands in nor, on a page without one,
    what holds most of the paragraph text.
    """
    n = len(page.tags)
    held = [0] * n
    for node, text, link_chars in page.blocks:
        if len(text) >= LEAST_BLOCK and not page.never[node]:
            held[node] += len(text) - link_chars
    for node in range(n - 1, 0, -1):
        held[page.parents[node]] += held[node]
    article = max((k for k in range(n) if page.semantic[k] and held[k]), key=lambda k: (held[k], -k), default=0)
    around = set()
    while article > 0:
        around.add(article)
        article = page.parents[article]
    never, worth = list(page.never), [1.0] * n
    for k in range(1, n):
        never[k] = never[k] or never[page.parents[k]]
        worth[k] = worth[page.parents[k]]
        if page.named[k] and k not in around:
            if not around and held[k] > MOST_TEXT * held[0]:
                worth[k] = NAME_DISCOUNT
            else:
                never[k] = True
    return never, worth


def main_blocks(source: str | None) -> list[str]:
    """The blocks of the main text in page order; names of elements are left aside if they leave nothing."""
    page = Page(source or "")
    return _main(page, *_unnamed(page)) or (_main(page, page.never, [1.0] * len(page.tags)) if any(page.named) else [])


def _main(page: Page, never: list[bool], discount: list[float]) -> list[str]:
    n = len(page.tags)
    chars, linked, links = [0] * n, [0] * n, list(page.links)
    for node, text, link_chars in page.blocks:
        chars[node] += len(text)
        linked[node] += link_chars
    for node in range(n - 1, 0, -1):
        parent = page.parents[node]
        chars[parent] += chars[node]
        linked[parent] += linked[node]
        links[parent] += links[node]
    density = [linked[k] / chars[k] if chars[k] else 0.0 for k in range(n)]
    menu = [False] * n
    for node in range(1, n):
        menu[node] = menu[page.parents[node]] or (page.tags[node] not in _KEPT and page.tags[node] != "p"
                                                  and links[node] >= MENU_LINKS and density[node] >= MENU_DENSITY)
    blocks = [(node, text) for node, text, _ in page.blocks if not never[node] and not menu[node]]
    points = [0.0] * n
    for node, text in blocks:
        if len(text) >= LEAST_BLOCK:
            worth = discount[node] * (1 + text.count(",") + text.count("、") + text.count("，") + min(len(text) / 100, 3))
            # Text that stands in a box itself is a paragraph of the box; a paragraph's points go to what holds it.
            node = node if page.tags[node] in ("div", "section", "td", "article", "main", "body", "html", "#page") else page.parents[node]
            for step in STEPS:
                if node < 0:
                    break
                points[node] += worth * step
                node = page.parents[node]
    total = [(points[k] + (SEMANTIC_POINTS if page.semantic[k] and chars[k] else 0)) * (1 - density[k]) if not never[k] else 0.0 for k in range(n)]
    best = max(range(n), key=lambda k: (total[k], k))
    if total[best] <= 0:
        keep = {0}
    else:
        up = best
        while up > 0:
            if page.semantic[up]:
                best = up
                if page.tags[up] == "article":
                    break
            up = page.parents[up]
        keep = {best}
        if best and not (page.tags[best] in ("main", "body", "html")):
            for k in range(1, n):
                if k != best and page.parents[k] == page.parents[best] and not never[k] and not menu[k]:
                    heading = k < best and page.tags[k] in ("h1", "h2")
                    if heading or total[k] >= SIBLING_SHARE * total[best] or (page.tags[k] in ("p", "blockquote", "pre") and chars[k] >= 80 and density[k] < 0.25):
                        keep.add(k)
    within = [False] * n
    for k in range(n):
        within[k] = k in keep or k > 0 and within[page.parents[k]]
    return [text for node, text in blocks if within[node]]


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every row of ``pages(page_id, url, html)``.

    Blocks are trimmed, with one space for each run of white space, and joined by an empty line. Null and empty pages
    and pages without text give an empty text; repeated rows are reported each; other columns are ignored.
    """
    schema = pages.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["\n\n".join(main_blocks(html.as_py())) for html in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                                             names=schema.names)

    return pages.select("page_id", "url", "html").mapInArrow(run, schema)
