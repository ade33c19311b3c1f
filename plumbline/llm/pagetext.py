"""Main text of web pages by tree scoring.

Every paragraph gets points for its length and its commas and passes them to its ancestors,
less the farther they are, to the ``REACH`` nearest ones. An ancestor's points are discounted
by its link density. The best container is kept with those siblings that score well or are
paragraphs of prose; where other containers hold a quarter of its own points or more, the
element around all of them stands for it. Within an element that is named as the article the
same scores drop what is little but links. Navigation, page headers and footers, side bars,
notices, adverts, forms, scripts, styles and reader comments are removed before; a name that
merely contains a word which is also used of articles (``meta-analysis``, ``search-results``)
only removes what holds no prose. Parsing and scoring take time in proportion to the page,
however deep it is nested. White space inside a block becomes one space, blocks are joined
by an empty line.

Defined results: null, empty or textless pages give the empty text. Text outside any element
counts as a paragraph of the page, so plain text is its own main text. Unclosed and misnested
tags are closed as browsers do for paragraphs and list items, and otherwise with the element
around them. Of equal scores the first container in page order is kept. Pages are independent
of each other, so repeated rows do not matter, and other columns are passed through.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import named

# Elements of HTML by their part in a page.
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
RAW = frozenset("script style noscript template iframe noembed noframes xmp textarea title".split())
REMOVED = RAW | frozenset(
    "head nav footer aside form button select option datalist input svg canvas object audio "
    "video map dialog menu menuitem".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main nav ol p pre "
    "search section summary table tbody td tfoot th thead tr ul caption".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
CONTAINERS = frozenset(
    "html body main article section div td blockquote center details figure".split()
)
# An open element of the first kind ends where one of the second starts.
ENDED_BY = {
    "p": BLOCKS,
    "li": frozenset({"li"}),
    "dt": frozenset({"dt", "dd"}),
    "dd": frozenset({"dt", "dd"}),
    "tr": frozenset({"tr", "tbody", "tfoot", "thead"}),
    "td": frozenset({"td", "th", "tr", "tbody", "tfoot"}),
    "th": frozenset({"td", "th", "tr", "tbody", "tfoot"}),
    "thead": frozenset({"tbody", "tfoot"}),
    "tbody": frozenset({"tbody", "tfoot"}),
    "option": frozenset({"option", "optgroup"}),
    "head": frozenset({"body"}) | BLOCKS - {"html"},
    **{h: HEADINGS for h in HEADINGS - {"hgroup"}},
}
# Where the search for an element to end stops.
SCOPES = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",),
          "th": ("table",), "p": ("td", "th", "table", "html")}
# Words in a class, id or role that mark what is not the article, and what is.
BAD_WORDS = frozenset(
    "ad ads adsense advert adverts advertisement advertising adbox adslot banner breadcrumb "
    "breadcrumbs byline comment comments commentlist consent contentinfo cookie cookies "
    "copyright disclaimer discussion disqus footer footnav gdpr header hidden legal login "
    "masthead menu menus meta modal nav navbar navigation newsletter notice notices "
    "notification overlay pager pagination paywall popup popover promo promos promotion "
    "recommendation recommendations recommended related reply replies respond responses rss "
    "search share sharebar sharing shoutbox sidebar sidebars signup skip social sponsor "
    "sponsored subscribe subscription tags teaser toolbar topbar trending widget widgets".split()
)
# Of them, those that articles are also named by, beside another word.
DOUBTFUL_WORDS = frozenset(
    "discussion header meta recommended related response responses search share social tags "
    "teaser trending widget widgets".split()
)
GOOD_WORDS = frozenset(
    "article articlebody body content entry hentry main page post story text".split()
)
BAD_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation "
    "search toolbar".split()
)

# A quote opens a value after an equals sign only, and reaches to the next one of its kind,
# however far; without one in the rest of the page it is a stray character. A tag that does
# not end takes the rest of the page, as in browsers.
# Ancestors that a paragraph passes points to, and what counts as prose in a doubtful element.
REACH = 24
_PROSE_CHARS, _PROSE_DENSITY = 120, 0.35
_STRONG = 0.25

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


class Node:
    __slots__ = (
        "name", "parent", "parts", "words", "links", "score", "own", "strong", "removed", "doubtful",
        "around",
    )

    def __init__(self, name: str, parent: Node | None, removed: bool = False):
        self.name, self.parent, self.removed = name, parent, removed
        # The nearest container around it.
        self.around = None
        if parent is not None:
            self.around = parent if parent.name in CONTAINERS else parent.around
        self.parts: list[Node | str] = []
        self.score = self.own = 0.0
        self.links = self.strong = 0
        self.doubtful = False


_GOOD, _DOUBTFUL, _BAD = range(3)


def _judged(name: str, attributes: str, in_article: bool) -> int:
    """Whether an element holds something else than the article, by its names."""
    if name in REMOVED:
        return _BAD
    if name == "header" and not in_article:
        return _BAD
    if not attributes or name in ("html", "body", "article", "main"):
        return _GOOD
    found = {}
    for m in _ATTRIBUTE.finditer(attributes):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true":
        return _BAD
    if re.search(r"(display\s*:\s*none|visibility\s*:\s*hidden)", found.get("style", ""), re.I):
        return _BAD
    if BAD_ROLES & set(found.get("role", "").lower().split()):
        return _BAD
    names = f"{found.get('class', '')} {found.get('id', '')}".split()
    if any(n.lower() in GOOD_WORDS for n in names):
        return _GOOD
    worst = _GOOD
    for n in names:
        words = [w.lower() for w in _WORDS.findall(n)]
        if words and words[0] in ("has", "with", "no", "without", "js"):
            continue
        bad = BAD_WORDS & set(words)
        if bad:
            doubtful = bad <= DOUBTFUL_WORDS and len(set(words)) > len(bad)
            worst = max(worst, _DOUBTFUL if doubtful else _BAD)
    return worst


class _Open:
    """The elements that are open, and where those of each name and kind are among them."""

    def __init__(self, root: Node):
        self.stack = [root]
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.cells: list[int] = []

    def has(self, name: str) -> bool:
        return bool(self.places.get(name))

    def push(self, node: Node) -> None:
        at = len(self.stack)
        self.stack.append(node)
        self.places.setdefault(node.name, []).append(at)
        if node.name in BLOCKS or node.name in ENDED_BY:
            self.blocks.append(at)
        if node.name in ("td", "th"):
            self.cells.append(at)

    def cut(self, at: int) -> None:
        """Closes the element at this place and all inside it."""
        while len(self.stack) > at:
            self.places[self.stack.pop().name].pop()
            here = len(self.stack)
            if self.blocks and self.blocks[-1] == here:
                self.blocks.pop()
            if self.cells and self.cells[-1] == here:
                self.cells.pop()

    def close(self, name: str) -> None:
        """A closing tag does not reach out of a cell or, unless it closes a block, a block."""
        if not self.has(name):
            return
        at = self.places[name][-1]
        if name not in ("tr", "table", "tbody") and self.cells and self.cells[-1] > at:
            return
        if name not in BLOCKS:
            last = next((b for b in reversed(self.blocks) if self.stack[b].name in BLOCKS), 0)
            if last > at:
                return
        self.cut(at)

    def open_block(self, name: str) -> None:
        """Ends the elements that end where one of this name starts."""
        scopes = SCOPES.get(name, ())
        k = len(self.blocks) - 1
        while k >= 0:
            opened = self.stack[self.blocks[k]].name
            if name in ENDED_BY.get(opened, ()):
                self.cut(self.blocks[k])
            elif opened in scopes or opened in BLOCKS and opened not in ENDED_BY:
                return
            k -= 1


def parse(page: str) -> Node:
    """The element tree of a page: text parts are decoded, removed elements are empty."""
    root = Node("html", None)
    node, at = root, 0
    opened = _Open(root)
    end = len(page)

    def text(a: int, b: int) -> None:
        if b > a and not node.removed:
            node.parts.append(html.unescape(page[a:b]))

    while at < end:
        m = _TAG.search(page, at)
        if not m:
            text(at, end)
            break
        text(at, m.start())
        at = m.end()
        name = m[2]
        if not name:
            continue
        closing, name, attributes = m[1], name.lower(), m[3]
        if closing:
            opened.close(name)
            node = opened.stack[-1]
            continue
        if name == "html" or name == "body" and opened.has("body"):
            continue
        if name in BLOCKS or name == "option":
            opened.open_block(name)
            node = opened.stack[-1]
        if name == "br":
            if not node.removed:
                node.parts.append(" ")
            continue
        if name in VOID:
            if name == "hr" and not node.removed:
                node.parts.append(Node("hr", node))
            continue
        judged = _BAD if node.removed else _judged(
            name, attributes, opened.has("article") or opened.has("main")
        )
        child = Node(name, node, judged == _BAD)
        child.doubtful = judged == _DOUBTFUL
        if not child.removed:
            node.parts.append(child)
        if name in RAW:
            close = re.compile(rf"</{name}(?=[\s/>])[^>]*>|\Z", re.I).search(page, at)
            at = close.end()
            continue
        if attributes.rstrip().endswith("/") and name not in BLOCKS:
            continue
        opened.push(child)
        node = child
    return root


def _measure(root: Node) -> list[Node]:
    """All nodes, parents first; ``words`` holds (characters, characters in links), ``links``
    the number of links."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(p for p in reversed(node.parts) if isinstance(p, Node))
    for node in reversed(order):
        chars = links = 0
        node.links = int(node.name == "a")
        for part in node.parts:
            if isinstance(part, str):
                chars += len(" ".join(part.split()))
            else:
                chars += part.words[0]
                links += part.words[1]
                node.links += part.links
        node.words = (chars, chars if node.name == "a" else links)
    return order


def _density(node: Node) -> float:
    chars, links = node.words
    return links / chars if chars else 0.0


def _own_text(node: Node) -> str:
    """The text of a node that no block inside it holds."""
    pieces, todo = [], list(reversed(node.parts))
    while todo:
        part = todo.pop()
        if isinstance(part, str):
            pieces.append(part)
        elif part.name not in BLOCKS:
            todo.extend(reversed(part.parts))
    return " ".join("".join(pieces).split())


def _drop_menus(order: list[Node]) -> None:
    """Lists, tables and sections that are little but links go, and doubtful elements without
    prose."""
    for node in order:
        menu = (
            node.name in ("ul", "ol", "dl", "table", "div", "section", "p")
            and node.words[0] and _density(node) > 0.6 and node.links > 1
        )
        if node.parent and (menu or node.doubtful and not _is_prose(node)):
            node.parts = []
            node.words = (0, 0)


def _is_prose(node: Node) -> bool:
    return node.words[0] >= _PROSE_CHARS and _density(node) <= _PROSE_DENSITY


def _score(order: list[Node]) -> None:
    """``own`` are the points of the paragraphs right inside a container, ``score`` those of
    all of them, less the farther they are."""
    for node in order:
        if node.name not in BLOCKS or node.name in HEADINGS:
            continue
        text = _own_text(node)
        if not text:
            continue
        points = 1.0 + text.count(",") + min(len(text) / 100.0, 3.0)
        holder = node if node.name in CONTAINERS else node.around
        share, level = 1.0, 0
        while holder is not None and level < REACH:
            holder.score += points * share
            if not level:
                holder.own += points
            level += 1
            share = 0.5 if level == 1 else 1.0 / (3.0 * level)
            holder = holder.around


def _value(node: Node) -> float:
    return node.score * (1.0 - _density(node))


def _best(order: list[Node]) -> Node | None:
    found, most = None, 0.0
    for node in order:
        value = _value(node)
        if value > most:
            found, most = node, value
    if found is None:
        return None
    # The element that says it is the article is taken whole when the best part lies in it.
    named_so, around = None, found
    while around is not None:
        if around.name in ("article", "main"):
            named_so = around
        around = around.parent
    if named_so is not None:
        return named_so
    return _around_strong(order, found)


def _around_strong(order: list[Node], best: Node) -> Node:
    """The element around all containers that hold a quarter of the best one's own points."""
    strongest = max(n.own * (1.0 - _density(n)) for n in order if _inside(n, best))
    for node in reversed(order):
        own = node.own * (1.0 - _density(node))
        node.strong = int(own >= _STRONG * strongest and own > 0) + sum(
            p.strong for p in node.parts if isinstance(p, Node)
        )
    found = around = best
    while around.parent is not None:
        if around.parent.strong > found.strong:
            found = around.parent
        around = around.parent
    return found


def _inside(node: Node, best: Node) -> bool:
    """Whether ``node`` is ``best`` or right inside it: no walk to the root."""
    return node is best or node.parent is best


def _kept(best: Node) -> list[Node]:
    """The best container and the siblings that belong to it, in page order."""
    parent = best.parent
    if parent is None or best.name in ("article", "main", "body"):
        return [best]
    least = max(10.0, 0.2 * best.score)
    kept = []
    for part in parent.parts:
        if not isinstance(part, Node):
            continue
        if part is best or _value(part) >= least:
            kept.append(part)
        elif part.name == "p" and part.words[0]:
            text = _own_text(part)
            if _density(part) < 0.25 and (len(text) > 80 or text[-1:] in ".!?"):
                kept.append(part)
        elif part.name in HEADINGS and part.words[0] and _density(part) < 0.25:
            kept.append(part)
    return kept


def _blocks(nodes: list[Node]) -> list[str]:
    blocks: list[str] = []
    run: list[str] = []

    def end() -> None:
        text = " ".join("".join(run).split())
        if text:
            blocks.append(text)
        run.clear()

    for top in nodes:
        todo: list[Node | str | None] = [top]
        while todo:
            part = todo.pop()
            if part is None:
                end()
            elif isinstance(part, str):
                run.append(part)
            else:
                if part.name == "header":
                    inner = [p for p in part.parts if isinstance(p, Node) and p.name in HEADINGS]
                else:
                    inner = part.parts
                if part.name in BLOCKS:
                    end()
                    todo.append(None)
                todo.extend(reversed(inner))
        end()
    return blocks


def main_text(page: str | None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    root = parse(page)
    order = _measure(root)
    _drop_menus(order)
    order = _measure(root)
    _score(order)
    best = _best(order)
    return "\n\n".join(_blocks(_kept(best))) if best else ""


def extract(pages: DataFrame, html_column: str = "html", into: str = "text") -> DataFrame:
    """Adds ``into``, the main text of each page."""

    @F.pandas_udf("string")
    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(p) for p in batch], dtype=object)

    return pages.withColumn(into, text_of(named(pages, html_column)))
