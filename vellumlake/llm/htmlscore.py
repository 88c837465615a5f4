"""HTML main-text extraction by tree scoring.

A page is parsed into a light tree by one scan over its tags, linear in the page however it is nested or quoted.  Each paragraph-like block
passes points for its length and commas to its parent (whole), grandparent (half) and the three ancestors above (a third of the level's
inverse; LEVELS in all); a container's sum is discounted by its link density.
The best container is kept, with siblings that score at least a fifth of it or read like running text.

Defined cases: null, empty and textless pages give a null text, score 0 and no block; unclosed, misnested and unknown tags are
tolerated (p, li and the like close implicitly; the end of the page closes the rest; after a tag with a quote that doesn't close, tags end at
the next >); comments, scripts and styles never count, nor does a comment mark in a script; if all
blocks are short they score all the same, and if there is none the whole body's text is taken; ties between containers go to the first in the page; repeated rows are extracted each; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_CHARS = 25
LEVELS = 5  # so many ancestors of a block get points
_OPEN = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+)>")  # a tag whose values hold no <: looks no further than the next <
_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)")
_STOP = re.compile(r"[>\"']")
_BLANK = re.compile(r"\s+")
_NAMES = re.compile(r"""(?:class|id)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea svg iframe".split())
BLOCKS = frozenset("p td pre blockquote li dd".split())
BREAKS = frozenset("p div article section main li ul ol dl dt dd td tr table pre blockquote h1 h2 h3 h4 h5 h6 br hr figure figcaption header footer nav aside form body".split())
CLOSES_P = frozenset("p div article section main ul ol dl table pre blockquote h1 h2 h3 h4 h5 h6 hr header footer nav aside form figure".split())
SCOPES = frozenset("table ul ol dl div article section body #root".split())  # a start tag closes no element outside the nearest of these
SILENT = frozenset("head title button select".split())  # their text never counts
BOILER = frozenset("nav footer header aside form head title button select".split())
GOOD = re.compile(r"article|body|content|entry|main|page|post|text|story", re.I)
BAD = re.compile(r"\bads?\b|advert|banner|combx|comment|contact|cookie|footer|masthead|menu|meta|nav|promo|related|share|sidebar|sponsor|widget", re.I)


class Node:
    __slots__ = ("tag", "names", "up", "kids", "points", "text", "linked", "commas", "scope", "inside", "boiler")

    def __init__(self, tag: str, names: str, up: "Node | None") -> None:
        self.tag, self.names, self.up = tag, names, up
        self.kids: list = []
        self.points = 0.0
        self.scope = self if up is None or tag in SCOPES else up.scope
        self.inside: dict[str, int] = {}  # of a scope: its open elements


class _Tags:
    """(start, end, closing slash, name, attributes) of a page's tags, comments and the like without a name; linear whatever the quotes."""

    def __init__(self, page: str) -> None:
        self.page, self.open = page, True

    def at(self, i: int):
        """The tag that begins with the < at i; None where there is none."""
        page = self.page
        if m := _OPEN.match(page, i):
            return m.end(), m.group(1), m.group(2).lower(), m.group(3)
        for mark, close in (("<!--", "-->"), ("<![CDATA[", "]]>")):
            if page.startswith(mark, i):
                j = page.find(close, i + len(mark))
                return (j + len(close) if j >= 0 else len(page)), "", "", ""
        if page[i + 1 : i + 2] in ("!", "?"):
            j = page.find(">", i)
            return (j + 1, "", "", "") if j >= 0 else None
        if not (m := _NAME.match(page, i)):
            return None
        j = self._end(m.end()) if self.open else -1
        if j < 0:  # quotes that don't close: once seen, tags of this page end at the next >
            self.open = False
            j = page.find(">", m.end())
        return (j + 1, m.group(1), m.group(2).lower(), page[m.end() : j]) if j >= 0 else None

    def _end(self, i: int) -> int:
        """The > that ends a tag; a quote opens a value only behind =."""
        page = self.page
        while m := _STOP.search(page, i):
            if m.group() == ">":
                return m.start()
            i = m.end()
            k = m.start() - 1
            while k > 0 and page[k].isspace():
                k -= 1
            if page[k] == "=":
                i = page.find(m.group(), i) + 1
                if not i:
                    return -1
        return -1


def parse(page: str) -> Node:
    """The page's elements and texts; never fails, in time linear in the page."""
    root = at = Node("#root", "", None)
    tags, last, seen, end = _Tags(page), 0, 0, len(page)
    opened: dict[str, int] = {}

    def leave(node: Node) -> Node:
        """Close all open elements up to `node`."""
        here = at
        while True:
            opened[here.tag] -= 1
            if here.up is not None and here.scope is not here:
                here.scope.inside[here.tag] -= 1
            if here is node:
                return here.up
            here = here.up

    while (i := page.find("<", seen)) >= 0:
        got = tags.at(i)
        if got is None:
            seen = i + 1
            continue
        if i > last:
            at.kids.append(page[last:i])
        last, slash, tag, rest = got
        seen = last
        if not tag:
            continue
        if slash:
            if opened.get(tag, 0):
                node = at
                while node.tag != tag:
                    node = node.up
                at = leave(node)
            continue
        alone = rest.endswith("/")
        if tag in RAW:
            if not alone:
                stop = re.compile(rf"</{tag}\s*>", re.I).search(page, last)
                last = seen = stop.end() if stop else end
            continue
        for shut in _SHUTS.get(tag, ()):
            if at.scope.inside.get(shut, 0):
                node = at
                while node.tag != shut:
                    node = node.up
                at = leave(node)
                break
        node = Node(tag, " ".join(_NAMES.findall(rest)) if rest else "", at)
        at.kids.append(node)
        if tag not in VOID and not alone:
            at = node
            opened[tag] = opened.get(tag, 0) + 1
            if node.scope is not node:
                node.scope.inside[tag] = node.scope.inside.get(tag, 0) + 1
    if last < end:
        at.kids.append(page[last:])
    return root


#: Open elements that a start tag closes, in its scope.
_SHUTS = {t: ("p",) for t in CLOSES_P} | {t: (t,) for t in ("li", "tr", "option")} | {t: ("dt", "dd") for t in ("dt", "dd")} | {t: ("td", "th") for t in ("td", "th")}


def _measure(root: Node) -> list[Node]:
    """All elements in page order, each with its text length, length in links, commas, and whether boilerplate holds it."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        own = node.tag in BOILER or bool(node.names and BAD.search(node.names) and not GOOD.search(node.names))
        node.boiler = own or (node.up is not None and node.up.boiler)
        stack.extend(k for k in reversed(node.kids) if isinstance(k, Node))
    for node in reversed(order):
        size = linked = commas = 0
        for k in node.kids:
            if isinstance(k, str):
                k = html.unescape(k) if "&" in k else k
                size += len(_BLANK.sub(" ", k).strip())
                commas += k.count(",")
            elif k.tag not in SILENT:
                size += k.text
                linked += k.linked
                commas += k.commas
        node.text, node.linked, node.commas = size, size if node.tag == "a" else linked, commas
    return order


def plain(node: Node) -> str:
    """The text of an element, blocks on lines of their own, blanks collapsed, entities resolved."""
    parts: list[str] = []
    stack: list = [node]
    while stack:
        k = stack.pop()
        if isinstance(k, str):
            parts.append(_BLANK.sub(" ", k))
        elif k is not None and k.tag not in SILENT:
            if k.tag in BREAKS:
                parts.append("\n")
                stack.append("\x00")
            stack.extend(reversed(k.kids))
    lines = "".join(parts).replace("\x00", "\n").split("\n")
    return "\n".join(x for x in (_BLANK.sub(" ", html.unescape(line)).strip() for line in lines) if x)


def density(node: Node) -> float:
    return node.linked / node.text if node.text else 0.0


def _pass_points(order: list[Node], least: int) -> tuple[dict[int, Node], int]:
    """Containers with points, and how many blocks gave them."""
    scored: dict[int, Node] = {}
    blocks = 0
    for node in order:
        own = sum(len(k.strip()) for k in node.kids if isinstance(k, str))
        if not (node.tag in BLOCKS or (node.tag in ("div", "section", "article") and own >= least)) or node.text < least:
            continue
        if node.boiler:
            continue
        blocks += 1
        points = 1 + node.commas + min(3, node.text // 100)
        up, level = node.up, 0
        while up is not None and level < LEVELS:
            if up.tag != "#root" or level == 0:
                if id(up) not in scored:
                    scored[id(up)] = up
                    up.points = _start(up)
                up.points += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            up, level = up.up, level + 1
    return scored, blocks


def extract(page: str | None) -> tuple[str | None, float, int]:
    """(main text, score of the best container, blocks that gave points)."""
    if not page or not page.strip():
        return None, 0.0, 0
    root = parse(page)
    order = _measure(root)
    scored, blocks = _pass_points(order, LEAST_CHARS)
    if not scored:  # only short blocks
        scored, blocks = _pass_points(order, 1)
    if not scored:
        body = next((n for n in order if n.tag == "body"), root)
        return plain(body) or None, 0.0, 0
    place = {id(n): i for i, n in enumerate(order)}
    final = {i: n.points * (1 - density(n)) for i, n in scored.items()}
    best = scored[max(final, key=lambda i: (final[i], -place[i]))]
    top = final[id(best)]
    keep = []
    for k in best.up.kids if best.up is not None else [best]:
        if k is best:
            keep.append(k)
        elif isinstance(k, Node) and k.tag not in BOILER and not BAD.search(k.names):
            d = density(k)
            if final.get(id(k), 0) >= max(10, top * 0.2):
                keep.append(k)
            elif k.tag == "p" and (k.text > 80 and d < 0.25 or 0 < k.text <= 80 and d == 0 and re.search(r"[.!?](?:\s|$)", plain(k))):
                keep.append(k)
    text = "\n".join(x for x in map(plain, keep) if x)
    return text or None, round(top, 6), blocks


def _start(node: Node) -> float:
    """A container's points before any block's."""
    s = {"div": 5, "article": 10, "section": 5, "main": 8, "pre": 3, "td": 3, "blockquote": 3}.get(node.tag, -3 if node.tag in ("ol", "ul", "dl", "form", "address") else -5 if node.tag in BOILER else 0)
    if node.names:
        s += 25 * bool(GOOD.search(node.names)) - 25 * bool(BAD.search(node.names))
    return float(s)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, score, blocks of each row of pages (page_id, url, html)."""

    def run(batches):
        for batch in batches:
            got = [extract(x) for x in batch.column(2).to_pylist()]
            t, s, b = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(t, pa.string()), pa.array(s, pa.float64()), pa.array(b, pa.int32())], ["page_id", "url", "text", "score", "blocks"])

    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return slim.mapInArrow(run, "page_id long, url string, text string, score double, blocks int")
