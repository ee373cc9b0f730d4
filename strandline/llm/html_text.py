"""Main text of a page by composite text density.

The page is parsed into a tree with implied end tags. Every node gets its composite density: characters
per tag, adjusted by the share of characters and tags that belong to links. A node's sum is that of its
block children's densities and its own inline text's. The node with the largest sum is the core; the
smallest density on the path from the body to it is the threshold. From the core the selection widens
upwards as long as at least half of the characters that come in lie in nodes that reach the threshold
and are not few, and drops block nodes that don't reach it; to an enclosing article or main element it
widens in any case. Only then elements and roles that hold no article text (menus, headers,
footers, sidebars, notices, forms, scripts, styles) and, as the weakest sign, names of class or id take
blocks out of what was selected; they also can't be the core themselves.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of HTML: elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that end an open p; and, by element, the elements a start tag ends up to which container.
ENDS_P = BLOCK - frozenset("body caption dd dt html legend li optgroup option select tbody td tfoot th thead tr summary".split()) | frozenset(("li", "dd", "dt"))
SIBLINGS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)), "thead": (("tbody", "thead", "tfoot"), ("table",)), "tfoot": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
}
#: Elements and roles that hold no article text. RAW ones hold no text at all.
PRUNED = frozenset("aside audio button canvas datalist dialog footer form head header iframe input map menu nav noscript object search select svg template textarea video".split()) | RAW
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Names of class or id that hint at none, alone, as the last part of a name, or as its first before a part of PARTS.
WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr header login masthead menu modal nav navbar "
    "navigation newsletter notice notices pager pagination popup promo promoted promotion recommended related responses share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget widgets".split()
)
PARTS = frozenset("area bar block body box button buttons container content form inner item items link links list message outer panel post posts row section slot text unit wrap wrapper".split())
#: First parts that turn a name into a remark about the page.
REMARKS = frozenset("has is no not with without".split())
CORES = frozenset(("article", "main"))
#: Elements deeper than this are not nested further, as in browsers; their text stays.
DEEPEST = 512

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^<>\"']*+)>")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTR = re.compile(r"[\s/]*+([^\s/>=]?[^\s/>=]*+)(\s*+=\s*+)?")
_BARE = re.compile(r"[^\s>]*+")
_PAIR = re.compile(r"([^\s/=]+)(?:\s*+=\s*+([^\s]++))?")
_SPACES = re.compile(r"\s+")
_HIDDEN = re.compile(r"display\s*+:\s*+none")


class Node:
    __slots__ = ("tag", "parent", "items", "chars", "tags", "link_chars", "link_tags", "own", "own_tags", "density", "pruned", "hinted", "dropped")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.items = tag, parent, []  # items: texts and nodes, in page order
        self.density = 0.0
        self.pruned = self.hinted = self.dropped = False


class Lexer:
    """Texts, start and end tags of a page in one pass. A quote that is never closed is no quote."""

    def __init__(self, page: str):
        self.page, self.n = page, len(page)
        self.none_after = {'"': len(page) + 1, "'": len(page) + 1}

    def _closing(self, quote: str, at: int) -> int:
        """Where the quote is closed, or -1; that there is none further on is found once."""
        if at >= self.none_after[quote]:
            return -1
        end = self.page.find(quote, at)
        if end < 0:
            self.none_after[quote] = at
        return end

    def attributes(self, at: int) -> tuple[list[tuple[str, str]], int]:
        """The attributes from a place inside a tag on, and the place after the tag."""
        page, found = self.page, []
        while at < self.n:
            m = _ATTR.match(page, at)
            name, at = m[1], m.end()
            if m[2]:
                quote = page[at : at + 1]
                end = self._closing(quote, at + 1) if quote in ('"', "'") else -1
                if end >= 0:
                    value, at = page[at + 1 : end], end + 1
                else:
                    bare = _BARE.match(page, at)
                    value, at = bare[0], bare.end()
                found.append((name.lower(), value))
            elif name:
                found.append((name.lower(), ""))
            if page[at : at + 1] == ">":
                return found, at + 1
            if not m[0] and at == m.start():  # nothing was read
                at += 1
        return found, self.n

    def tokens(self) -> Iterator[tuple[str, str, list[tuple[str, str]]]]:
        """('text', text, []), ('start', tag, attributes), ('end', tag, [])."""
        page, n, at = self.page, self.n, 0
        while at < n:
            less = page.find("<", at)
            if less < 0:
                yield "text", page[at:], []
                return
            if less > at:
                yield "text", page[at:less], []
            m = _TAG.match(page, less)
            if m:
                at, tag = m.end(), m[2].lower()
                attrs = [(x[1].lower(), x[2] or "") for x in _PAIR.finditer(m[3])] if m[3] and not m[1] else []
                yield "end" if m[1] else "start", tag, attrs
            elif page.startswith("<!--", less):
                end = page.find("--", less + 2 if page.startswith("<!-->", less) else less + 4)
                while end >= 0 and page[end + 2 : end + 3] not in (">", "") and not page.startswith("!>", end + 2):
                    end = page.find("--", end + 1)
                at = n if end < 0 else page.find(">", end) + 1 or n
                tag = ""
            elif page.startswith("<![CDATA[", less):
                end = page.find("]]>", less + 9)
                yield "data", page[less + 9 : n if end < 0 else end], []
                at, tag = (n if end < 0 else end + 3), ""
            elif page[less + 1 : less + 2] in ("!", "?") or page.startswith("</", less) and not _NAME.match(page, less + 2):
                at, tag = page.find(">", less) + 1 or n, ""
            else:
                closes = page.startswith("</", less)
                name = _NAME.match(page, less + 1 + closes)
                if not name:
                    yield "text", "<", []
                    at = less + 1
                    continue
                attrs, at = self.attributes(name.end())
                tag = name[0].lower()
                yield "end" if closes else "start", tag, attrs
            if tag in RAW and page[less + 1] != "/":
                if tag == "plaintext":
                    return
                close = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
                if not close:
                    return
                at = page.find(">", close.start()) + 1 or n


def _named(value: str) -> bool:
    """If a class or id hints at no article text."""
    for name in value.lower().split():
        parts = [p for p in re.split(r"[^a-z]+", name) if p]
        if parts and parts[0] not in REMARKS and (parts[-1] in WORDS or parts[0] in WORDS and all(p in PARTS or p in WORDS for p in parts[1:])):
            return True
    return False


def _marks(node: Node, attrs: list[tuple[str, str]]) -> None:
    node.pruned = node.tag in PRUNED
    if node.tag in ("html", "body"):
        return
    for name, value in attrs:
        if name in ("class", "id"):
            node.hinted = node.hinted or _named(html.unescape(value))
        elif name == "role" and value.strip().lower() in ROLES or name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and _HIDDEN.search(value.lower()):
            node.pruned = True


class Stack:
    """The open elements, with the number of each kind, so that looking for one that isn't open costs nothing."""

    def __init__(self, *nodes: Node):
        self.nodes, self.open = list(nodes), {}
        self.lost: dict[str, int] = {}  # elements beyond the deepest level that are still to be closed

    def push(self, node: Node) -> None:
        if len(self.nodes) < DEEPEST:
            self.nodes.append(node)
            self.open[node.tag] = self.open.get(node.tag, 0) + 1
        else:
            self.lost[node.tag] = self.lost.get(node.tag, 0) + 1

    def cut(self, depth: int) -> None:
        for node in self.nodes[depth:]:
            self.open[node.tag] -= 1
        del self.nodes[depth:]

    def end(self, tags: tuple[str, ...], within: tuple[str, ...]) -> None:
        """Close the nearest open element of tags, unless one of within is nearer."""
        if not any(self.open.get(tag) for tag in tags):
            return
        for depth in range(len(self.nodes) - 1, 1, -1):
            if self.nodes[depth].tag in tags:
                self.cut(depth)
                return
            if self.nodes[depth].tag in within:
                return

    def close(self, tag: str) -> None:
        """An end tag; that of an inline element closes nothing beyond its block."""
        if self.lost.get(tag):
            self.lost[tag] -= 1
        elif self.open.get(tag):
            for depth in range(len(self.nodes) - 1, 1, -1):
                if self.nodes[depth].tag == tag:
                    self.cut(depth)
                    return
                if tag not in BLOCK and self.nodes[depth].tag in BLOCK:
                    return


def parse(page: str) -> Node:
    """The tree below an html node, without the content of RAW elements, comments and markup declarations."""
    root = Node("html", None)
    body = Node("body", root)
    root.items.append(body)
    stack = Stack(root, body)
    for kind, value, attrs in Lexer(page).tokens():
        if kind == "text":
            stack.nodes[-1].items.append(html.unescape(value))
        elif kind == "data":
            stack.nodes[-1].items.append(value)
        elif kind == "start" and value not in ("html", "body"):
            if value in ENDS_P:
                stack.end(("p",), ("article", "aside", "body", "button", "div", "li", "main", "section", "table", "td"))
            if value in SIBLINGS:
                for _ in range(3):
                    stack.end(*SIBLINGS[value])
            node = Node(value, stack.nodes[-1])
            _marks(node, attrs)
            node.parent.items.append(node)
            if value not in VOID and value not in RAW:
                stack.push(node)
        elif kind == "end" and value not in ("html", "body", "br"):
            stack.close(value)
    return root


def _order(root: Node) -> list[Node]:
    """Every node after its parent."""
    found = [root]
    for node in found:
        found += [x for x in node.items if isinstance(x, Node)]
    return found


def measure(root: Node) -> list[Node]:
    """Characters, tags, links and composite density of every node of the whole tree."""
    nodes = _order(root)
    for node in nodes:
        node.chars = node.own = sum(len(_SPACES.sub("", x)) for x in node.items if isinstance(x, str))
        node.tags = node.own_tags = node.link_tags = 0
        node.link_chars = 0
    for node in reversed(nodes):
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.tags + 1
        up = node.parent
        if up is not None:
            up.chars += node.chars
            up.tags += node.tags + 1
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags
            if node.tag not in BLOCK:
                up.own += node.own
                up.own_tags += node.own_tags + 1
    share = root.link_chars / root.chars if root.chars else 0.0
    for node in nodes:
        c, t, lc, lt = node.chars, max(node.tags, 1), max(node.link_chars, 1), max(node.link_tags, 1)
        if c:
            base = log(c / max(c - node.link_chars, 1) * node.link_chars + share * c + e)
            node.density = c / t * max(log(max(c / lc * t / lt, 1.0001)) / log(max(base, 1.0001)), 0.0)
    return nodes


def density_sum(node: Node) -> float:
    """The densities of a node's block children, but those that hold no article text, and of its own inline text."""
    return sum(x.density for x in node.items if isinstance(x, Node) and x.tag in BLOCK and not x.pruned) + node.own / max(node.own_tags, 1)


def select(root: Node) -> Node:
    """The subtree that holds the main text, by density alone; what is no part of it is marked as dropped.

    The core is the node of the largest density sum outside elements that hold no article text. From it
    the selection widens upwards while at least half of the characters that would come in lie in nodes
    that reach the threshold, the smallest density on the path from the body to the core, and these are
    many (WIDER of what there is). Of what comes in, nodes below the threshold are dropped, but for
    headings and unlinked paragraphs; in the core, those that are mostly links. Where it ends, headings
    right above the selection still come in, alone. If the
    core lies in an article or main element, the selection widens to that, less sparse nodes of links.
    """
    nodes = measure(root)
    core, most = root.items[0], -1.0
    outside = {id(root)}
    for node in nodes:
        if node.parent is not None and id(node.parent) in outside and not node.pruned and not node.hinted:
            outside.add(id(node))
            if node.tag in BLOCK and (total := density_sum(node)) > most:
                core, most = node, total
    path = []
    node = core
    while node is not None:
        path.append(node)
        node = node.parent
    threshold = min(x.density for x in path[:-1])
    for node in _order(core)[1:]:  # lists of links are sparse even inside the core
        node.dropped = node.tag in BLOCK and node.density < threshold and node.link_tags >= 3 and 2 * node.link_chars > node.chars
    own = next((x for tag in ("article", "main") for x in path if x.tag == tag), core)
    within = {id(x) for x in path[: path.index(own) + 1]}
    for node, up in zip(path, path[1:], strict=False):
        if up.tag == "html":
            return node
        inside = id(up) in within
        others = [x for x in up.items if isinstance(x, Node) and x is not node and x.tag in BLOCK and not x.pruned and not x.hinted]
        low = [x for x in others if x.density < threshold and x.tag not in HEADINGS and (2 * x.link_chars > x.chars if inside else x.tag != "p" or x.link_chars)]
        around = up.own + sum(x.chars for x in others)
        dense = around - sum(x.chars for x in low)
        if not inside and (2 * dense < around or dense < WIDER * node.chars):
            above = {id(x) for x in up.items[: up.items.index(node)] if isinstance(x, Node) and x.tag in HEADINGS}
            if not above or up.own:
                return node
            for x in others:
                x.dropped = id(x) not in above
            return up
        for x in low:
            x.dropped = True
    return core


#: Block siblings that hold less than this share of the selected characters are no further part of it.
WIDER = 0.2
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())


def spare(root: Node) -> None:
    """Hints and forms don't count where they hold an article or main element, or a form most of the page's unlinked text."""
    nodes = _order(root)
    plain = {id(node): sum(len(_SPACES.sub("", x)) for x in node.items if isinstance(x, str)) if node.tag != "a" else 0 for node in nodes}
    for node in reversed(nodes):
        if node.parent is not None and node.tag != "a":
            plain[id(node.parent)] += plain[id(node)]
    for node in reversed(nodes):
        if node.tag in CORES:
            up = node
            while up is not None and (up is node or up.tag not in CORES):
                up.hinted = False
                up.pruned = up.pruned and up.tag != "form"
                up = up.parent
        if node.tag == "form" and 2 * plain[id(node)] > plain[id(root)]:
            node.pruned = False


def blocks(root: Node, hints: bool = True) -> Iterator[str]:
    """The texts of the blocks in page order, white space made one space, without empty ones and what is no article text."""
    parts: list[str] = []
    work: list = [root]
    while work:
        item = work.pop()
        if isinstance(item, str):
            parts.append(item)
        elif item is None:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                yield text
        elif item.pruned or item.dropped or hints and item.hinted:
            continue
        elif item.tag == "br":
            parts.append(" ")
        else:
            own = item.tag in BLOCK
            work += [None] * own + item.items[::-1] + [None] * own
    text = " ".join("".join(parts).split())
    if text:
        yield text


def main_text(page: str | None) -> str:
    """The main text of a page; empty if there is none."""
    if not page:
        return ""
    root = parse(page)
    spare(root)
    core = select(root)
    return "\n".join(blocks(core)) or "\n".join(blocks(core, False))


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            own = batch.slice(at, 256)
            texts = [main_text(x.as_py()) for x in own.column(2)]
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row; null or empty html gives an empty text. Repeated rows are extracted each; other columns aren't read."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
