"""Main text of web pages by composite text density (operator 5).

Every element of the page's tree gets its characters per tag, adjusted by the share of characters and tags that stand in
links; an element's density sum adds up the densities of its children that are blocks. The element with the largest sum is the main
content, the smallest density on its path up to the body is the threshold, and other elements beside that path whose
density reaches it are content too. Inside what is chosen, blocks of links that stay below the threshold go. Elements that
cannot hold main text (scripts, menus, form controls, ...) are taken out of the tree first by their names; densities
cannot tell an advert or a reader's comment from a paragraph, so elements that name themselves such by a whole class, id or role go too.
"""

from __future__ import annotations

import html
import math
import re

from pyspark.sql import DataFrame

from lattica.llm.rows import each_text

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(script|style|textarea|title|noscript|iframe|template)\b[^>]*>.*?(?:</\2\s*>|\Z)"
    r"|<(/?)([a-z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-z][^\s/>]*)([^>]*)>",
    re.I | re.S,
)
#: Elements without content of their own.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that never hold main text.
DROPPED = frozenset(
    "head nav header footer aside form button select option menu dialog svg canvas audio video object applet".split()
)
#: Classes, ids and roles that mark what is not main text, alone or as the last of joined words (``cookie-notice``).
MARKED = frozenset(
    "ad ads advert adverts advertisement banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs"
    " header masthead footer sidebar aside widget cookie cookies consent notice alert popup modal newsletter subscribe signup login"
    " share sharing social related recommended comment comments disqus respond replies search toolbar pagination pager copyright"
    " contentinfo complementary dialog".split()
)
WORDS = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
SPLIT = re.compile(r"[^a-z0-9]+")
#: Links in a block, and their share of its characters, from which it can be a list of links.
LINKS, SHARE = 2, 0.8
#: Elements that stand in a line of text.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup"
    " time tt u var wbr td th ruby rt rp math mi mn mo mrow msup msub mfrac msqrt mtext semantics".split()
)
#: What an opening tag ends before it, if that is open and nothing of the second set stands between.
ENDED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HELD = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
SCOPE = frozenset("table td th button object html body article section main div".split())


class Node:
    """An element: its parts in order (texts and elements), and the sums over what is below it."""

    __slots__ = ("chars", "dense", "links", "name", "parts", "skip", "tags", "within")

    def __init__(self, name: str, skip: bool):
        self.name, self.skip, self.parts = name, skip, []
        self.chars = self.links = self.tags = self.within = 0
        self.dense = 0.0


def _skipped(name: str, attributes: str, open_: list[Node]) -> bool:
    if name in DROPPED:
        return name != "header" or not any(x.name == "article" for x in open_)
    if not attributes or name in ("html", "body", "article", "main"):
        return False
    for m in WORDS.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            words = [w for w in SPLIT.split(name) if w]
            if words and words[-1] in MARKED:
                return True
    return False


def tree(page: str) -> Node:
    """The page's elements; wrong nesting is mended the way browsers do it for paragraphs, lists and tables."""
    root = Node("html", False)
    open_, at = [root], 0

    def text(s: str) -> None:
        if s:
            open_[-1].parts.append(html.unescape(s) if "&" in s else s)

    for m in TOKEN.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        if m[1]:
            text(m[1].replace("&", "&amp;"))
        name = (m[4] or m[7] or "").lower()
        if not name:
            continue
        if m[3] or m[6]:
            if name == "p" or name in VOID:
                name = "p" if name == "p" else ""
            for k in range(len(open_) - 1, 0, -1):
                if open_[k].name == name:
                    del open_[k:]
                    break
                if name in INLINE and open_[k].name not in INLINE:
                    break
            continue
        attributes = (m[5] if m[4] else m[8]) or ""
        if name in ("html", "body"):
            root.skip = False
            if name == "body" and any(x.name == "head" for x in open_):
                del open_[1:]
            if name == "html":
                continue
        elif name not in INLINE:  # a block ends an open paragraph
            for k in range(len(open_) - 1, 0, -1):
                if open_[k].name == "p":
                    del open_[k:]
                    break
                if open_[k].name in SCOPE:
                    break
        if name in ENDED:
            for k in range(len(open_) - 1, 0, -1):
                if open_[k].name in HELD[name]:
                    break
                if open_[k].name in ENDED[name]:
                    del open_[k:]
                    break
        node = Node(name, _skipped(name, attributes, open_))
        open_[-1].parts.append(node)
        if name not in VOID and not attributes.endswith("/"):
            open_.append(node)
    text(page[at:])
    return root


def _body(root: Node) -> Node:
    return next((x for x in root.parts if isinstance(x, Node) and x.name == "body"), root)


def measure(root: Node) -> tuple[list[Node], dict[int, Node | None]]:
    """Sets characters, tags, link characters and link tags; elements in page order, and the parent of each."""
    order, parents, stack = [], {id(root): None}, [root]
    while stack:
        node = stack.pop()
        order.append(node)
        below = [x for x in node.parts if isinstance(x, Node) and not x.skip]
        for x in below:
            parents[id(x)] = node
        stack.extend(reversed(below))
    for node in reversed(order):
        for x in node.parts:
            if isinstance(x, str):
                node.chars += len(x) - x.count(" ") - x.count("\n")
            elif not x.skip:
                node.chars += x.chars
                node.links += x.links
                node.tags += x.tags + 1
                node.within += x.within + (x.name == "a")
        if node.name == "a":
            node.links, node.within = node.chars, node.tags
    return order, parents


def densities(order: list[Node], body: Node) -> None:
    """Composite density: characters per tag, times the log of the shares outside links, to a base that grows with them."""
    share = body.links / max(1, body.chars)
    for node in order:
        c, t, lc, lt = node.chars, max(1, node.tags), max(1, node.links), max(1, node.within)
        if not c:
            continue
        base = math.log(c / max(1, c - node.links) * node.links + share * c + math.e)
        top = c / lc * t / lt
        node.dense = c / t * (math.log(top) / math.log(base) if base > 1 + 1e-9 and top > 1 else (math.log(max(top, 1)) if top > 1 else 0.0))


def _of_links(x: Node, least: float) -> bool:
    return x.within >= LINKS and x.links >= SHARE * x.chars and x.dense < least and x.name not in INLINE


def _blocks(parts: list, out: list[str], least: float) -> None:
    """Texts of the blocks in page order without lists of links; white space inside one becomes one space."""
    line: list[str] = []

    def end() -> None:
        if line:
            s = " ".join("".join(line).split())
            if s:
                out.append(s)
            line.clear()

    stack: list = [iter(parts)]
    marks: list[bool] = [False]
    while stack:
        x = next(stack[-1], None)
        if x is None:
            stack.pop()
            if marks.pop():
                end()
        elif isinstance(x, str):
            line.append(x)
        elif not x.skip and not _of_links(x, least):
            block = x.name not in INLINE
            if block:
                end()
            elif x.name in ("br", "td", "th"):
                line.append(" ")
            stack.append(iter(x.parts))
            marks.append(block)
    end()


def main_text(page: str | None) -> str:
    """Main text of a page; empty for null, empty and textless pages."""
    if not page:
        return ""
    root = tree(page)
    body = _body(root)
    order, parents = measure(body)
    if not body.chars:
        return ""
    densities(order, body)
    sums = {
        id(n): sum(x.dense for x in n.parts if isinstance(x, Node) and not x.skip and x.name not in INLINE)
        for n in order
        if n.name not in INLINE
    }
    best = max((n for n in order if id(n) in sums), key=lambda n: sums[id(n)])
    if sums[id(best)] <= 0:
        best = body
    path, least, up = set(), math.inf, best
    while up is not None:
        path.add(id(up))
        least = min(least, up.dense)
        up = parents[id(up)]
    out: list[str] = []

    stack = [iter(body.parts)] if body is not best else []
    if body is best:
        _blocks(best.parts, out, least)
    while stack:  # down the path; what stands beside it is content if it is as dense
        x = next(stack[-1], None)
        if x is None:
            stack.pop()
        elif isinstance(x, Node) and not x.skip:
            if x is best:
                _blocks(x.parts, out, least)
            elif id(x) in path:
                stack.append(iter(x.parts))
            elif x.chars and x.dense >= least and x.name not in INLINE:
                _blocks(x.parts, out, least)
    return "\n\n".join(out)


def extract(df: DataFrame, page: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Kept columns, ``text`` (empty if there is none) and ``n_chars``, its code points, from each whole page.

    Pages are independent of each other, so there is no shuffle; repeated rows stay repeated, null pages count as empty,
    an empty table gives no rows, and only the kept columns and the page are read.
    """

    def run(p):
        s = main_text(p)
        return s, len(s)

    return each_text(df, page, lambda: run, "text string, n_chars long", keep)
