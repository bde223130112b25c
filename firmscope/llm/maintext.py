"""Main text of web pages by composite text density.

Each page becomes a tree of elements (implied end tags as in HTML: a new paragraph closes an open one, and
so on). Furniture goes first: scripts, styles, forms, menus, page headers, footers, sidebars, notices,
adverts and reader comments, told by element, role or class. For every element left, the density is its
characters per tag, adjusted for links; the densities of an element's children are summed, and the element
with the largest sum (or the article around it) holds the main text. The least density on its way up to the
body is the threshold: elements elsewhere that reach it, below parents that reach it, count as main text too.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship_by_value

ship_by_value(__name__)

# Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
DROPPED = frozenset("script style title textarea xmp iframe noembed noframes head template noscript object svg canvas audio video map "
                    "select button input nav footer aside form dialog menu".split())
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                   "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre search section summary table tbody td tfoot th "
                   "thead tr ul".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 "
                   "h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
#: An open element of the set ends where one of these starts, unless one of the element's limits is open between them.
IMPLIED = {**dict.fromkeys(ENDS_P, ("p",)), "li": ("p", "li"), "dd": ("p", "dd"), "dt": ("p", "dd"), "option": ("option",), "tr": ("td", "tr"),
           "td": ("td",), "th": ("td",), "tbody": ("td", "tr", "tbody"), "thead": ("td", "tr", "tbody"), "tfoot": ("td", "tr", "tbody")}
GROUPS = {"p": "p", "li": "li", "dd": "dd", "dt": "dd", "option": "option", "td": "td", "th": "td", "tr": "tr", "tbody": "tbody",
          "thead": "tbody", "tfoot": "tbody"}
LIMITS = {**dict.fromkeys("table td th caption button object template html body".split(), ("p", "li", "dd", "option")),
          "ul": ("li",), "ol": ("li",), "dl": ("dd",), "select": ("option",)}
TABLE_LIMIT = ("td", "tr", "tbody")
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
HINTS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner cookie cookies consent "
                  "gdpr notice notices notification popup modal overlay newsletter subscribe subscription paywall nav navbar navigation menu "
                  "submenu breadcrumb breadcrumbs masthead header footer sidebar aside comment comments reply replies respond disqus share "
                  "sharing social related recommended widget widgets login signin signup search toolbar pagination pager skip".split())
UNLESS = frozenset("has with without no not is".split())

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"'][^\s>]*)?)?""")
_AFTER = re.compile(r"[\s/]*>")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_ZEROS = re.compile(r"&#0{4,}")
_HUGE = re.compile(r"&#[0-9]{8,};?")
_RAW_END = {n: re.compile(rf"</{n}(?=[\s/>])", re.IGNORECASE) for n in RAW}


def _hinted(value: str) -> bool:
    """Whether a class list, or an id, names furniture: one of its words is a hint and none turns it round."""
    for name in value.split():
        parts = [p.lower() for p in _PARTS.findall(name)]
        if parts and parts[0] not in UNLESS and (parts[0] in HINTS or parts[-1] in HINTS):
            return True
    return False


def decoded(text: str) -> str:
    """Character references resolved, as in HTML; numbers beyond any character become U+FFFD."""
    if "&" not in text:
        return text
    return entities.unescape(_HUGE.sub("�", _ZEROS.sub("&#0", text)))


class Page:
    """The elements of one page, parents before children, and its texts in order.

    ``texts`` holds ``(element, characters)``, and None where a block starts or ends.
    """

    def __init__(self, html: str):
        self.names, self.parents, self.marked, self.texts = ["#page"], [-1], [False], []
        #: Open elements: (name, index, places of the nearest open p, li, ... that a new one would end).
        self.open: list[tuple[str, int, dict[str, int]]] = [("#page", 0, {})]
        self.places: dict[str, list[int]] = {}
        self.fences = [0]
        self._read(html)

    def _read(self, html: str) -> None:
        at, n = 0, len(html)
        while at < n:
            lt = html.find("<", at)
            if lt < 0 or lt + 1 >= n:
                self._text(html[at:])
                return
            after = html[lt + 1]
            if after in "!?" or (after == "/" and not _NAME.match(html, lt + 2)):
                self._text(html[at:lt])
                if html.startswith("<!--", lt):
                    end = lt + 4 if html.startswith((">", "->"), lt + 4) else html.find("-->", lt + 4)
                    at = n if end < 0 else html.index(">", end) + 1
                else:
                    end = html.find(">", lt)
                    at = n if end < 0 else end + 1
                continue
            m = _NAME.match(html, lt + 1 + (after == "/"))
            if not m:  # a lone "<" is text
                self._text(html[at:lt + 1])
                at = lt + 1
                continue
            self._text(html[at:lt])
            name, at, furniture = m.group().lower(), m.end(), False
            while not (end := _AFTER.match(html, at)):
                a = _ATTRIBUTE.match(html, at)
                if not a:  # the page ends inside a tag
                    return
                at = a.end()
                if after != "/" and a.group(2) and a.group(1).lower() in ("class", "id", "role"):
                    value = decoded(a.group(2).strip("\"'"))
                    furniture |= value.strip().lower() in ROLES if a.group(1).lower() == "role" else _hinted(value)
            at = end.end()
            if after == "/":
                self._end(name)
                continue
            self._start(name, furniture)
            if name in RAW:
                stop = _RAW_END[name].search(html, at)
                at = stop.start() if stop else n

    def _text(self, chars: str) -> None:
        if chars:
            if self.open[-1][0] == "head" and not chars.isspace():
                self._pop_to(len(self.open) - 1)
            self.texts.append((self.open[-1][1], chars))

    def _pop_to(self, place: int) -> None:
        while len(self.open) > place:
            name, _, _ = self.open.pop()
            self.places[name].pop()
            if self.fences[-1] == len(self.open):
                self.fences.pop()
            if name in BLOCKS:
                self.texts.append(None)

    def _start(self, name: str, furniture: bool) -> None:
        if name in ("html", "body") and self.places.get(name):
            return
        if self.open[-1][0] == "head" and name not in IN_HEAD:
            self._pop_to(len(self.open) - 1)
        for group in IMPLIED.get(name, ()):
            place = self.open[-1][2].get(group, 0)
            if place:
                self._pop_to(place)
        me = len(self.names)
        self.names.append(name)
        self.parents.append(self.open[-1][1])
        self.marked.append(furniture)
        if name in BLOCKS:
            self.texts.append(None)
        if name in VOID:
            if name == "br":
                self.texts.append((self.parents[me], " "))
            return
        near, place = self.open[-1][2], len(self.open)
        if name in LIMITS:
            near = {g: p for g, p in near.items() if g not in LIMITS[name] and not (name == "table" and g in TABLE_LIMIT)}
        if name in GROUPS:
            near = near | {GROUPS[name]: place}
        self.open.append((name, me, near))
        self.places.setdefault(name, []).append(place)
        if name in ("table", "td", "th", "caption", "button", "object", "template"):
            self.fences.append(place)

    def _end(self, name: str) -> None:
        if name == "br":
            self._start("br", False)
            return
        where = self.places.get(name)
        # an end tag inside a table cell does not end an element around the table
        if where and name not in ("html", "body") and (where[-1] >= self.fences[-1] or name in ("table", "tr", "tbody", "thead", "tfoot")):
            self._pop_to(where[-1])

    def furniture(self) -> list[bool]:
        """Which elements go with all they hold."""
        n, names, parents = len(self.names), self.names, self.parents
        holds, inside = [False] * n, [False] * n
        for i in range(n - 1, 0, -1):
            holds[parents[i]] |= holds[i] or names[i] in ("article", "main", "h1")
        gone = [False] * n
        for i in range(1, n):
            p, name = parents[i], names[i]
            inside[i] = inside[p] or name in ("article", "main")
            if name in ("html", "body", "article", "main", "h1"):
                gone[i] = gone[p] or (self.marked[i] and name == "article" and not holds[i])
            elif name == "form":
                gone[i] = gone[p] or not holds[i]
            elif name == "header":
                gone[i] = gone[p] or not inside[p]
            else:
                gone[i] = gone[p] or name in DROPPED or (self.marked[i] and not holds[i])
        return gone


def _density(chars: int, tags: int, linked: int, links: int, body_rate: float) -> float:
    """Characters per tag, times a logarithm that falls with the share of characters and tags in links."""
    if not chars:
        return 0.0
    tags, links = max(tags, 1), max(links, 1)
    unlinked, linked = max(chars - linked, 1), max(linked, 1)
    base = math.log(chars / unlinked * linked + body_rate * chars + math.e)
    return chars / tags * math.log(max(chars / linked * (tags / links), 1.0)) / math.log(base)


def main_elements(page: Page, gone: list[bool]) -> list[bool]:
    """Which elements hold main text: the subtree of the largest density sum, lifted to the article around it,
    and what reaches the threshold of its path elsewhere."""
    n, names, parents = len(page.names), page.names, page.parents
    chars, linked, tags, links = [0] * n, [0] * n, [0] * n, [0] * n
    in_link = [False] * n
    for i in range(1, n):
        in_link[i] = in_link[parents[i]] or names[i] == "a"
    for t in page.texts:
        if t and not gone[t[0]]:
            size = len(t[1].strip())
            chars[t[0]] += size
            linked[t[0]] += size if in_link[t[0]] else 0
    body = next((i for i in range(n) if names[i] == "body"), 0)
    for i in range(n - 1, 0, -1):
        if not gone[i]:
            p = parents[i]
            links[i] += names[i] == "a"
            chars[p] += chars[i]
            linked[p] += linked[i]
            tags[p] += tags[i] + 1
            links[p] += links[i]
    rate = linked[body] / chars[body] if chars[body] else 0.0
    density = [0.0 if gone[i] else _density(chars[i], tags[i], linked[i], links[i], rate) for i in range(n)]
    sums = [0.0] * n
    for i in range(1, n):
        sums[parents[i]] += density[i]
    best = list(range(n))  # of each subtree, the element of the largest sum; the outer one among equals
    for i in range(n - 1, 0, -1):
        p = parents[i]
        if not gone[i] and (sums[best[i]], -best[i]) > (sums[best[p]], -best[p]) and sums[best[i]] > sums[p]:
            best[p] = best[i]
    chosen, up = best[body], best[body]
    while up > body:
        if names[up] in ("article", "main"):
            chosen = up
        up = parents[up]
    threshold, up = density[chosen], chosen
    path = set()
    while up > body:
        path.add(up)
        up = parents[up]
        threshold = min(threshold, density[up])
    path.add(body)
    reaches, main = [False] * n, [False] * n
    for i in range(body, n):
        if gone[i] or (i != body and not reaches[parents[i]] and not main[parents[i]]):
            continue
        reaches[i] = i in path or (density[i] >= threshold and chars[i] > 0)
        main[i] |= i == chosen or (i != body and main[parents[i]])
        if reaches[i] and i not in path:
            main[best[i]] = True
    return main


def main_text(html: str) -> str:
    """The page's main text: blocks in page order, one a line, white space inside a block as one space."""
    page = Page(html)
    gone = page.furniture()
    main = main_elements(page, gone)
    blocks, now = [], []
    for t in [*page.texts, None]:
        if t is None:
            line = " ".join("".join(now).split()) if now else ""
            if line:
                blocks.append(line)
            now = []
        elif main[t[0]] and not gone[t[0]]:
            now.append(decoded(t[1]))
    return "\n".join(blocks)


def extract(pages: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of every row of ``pages`` with ``text`` and ``n_chars`` (its code points).

    A null html is an empty page; a page without main text has an empty text. Repeated rows each count, an
    empty table gives no rows, other columns play no part whatever their names. Time and memory are in
    proportion to a page's length, however long it is and however deep its elements are nested.
    """
    keep = pages.select(*[F.col(f"`{c}`") for c in columns], F.coalesce(F.col("html"), F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                b = whole.slice(i, 500)
                texts = [main_text(h) for h in b.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in columns], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                                                 [*columns, "text", "n_chars"])

    kept = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in columns)
    return keep.mapInArrow(run, f"{kept}, text string, n_chars long")


def op13_rows(pages: DataFrame) -> DataFrame:
    return extract(pages, ["page_id", "url"])
