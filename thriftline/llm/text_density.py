"""Main text of web pages by composite text density of the nodes of their document tree."""
from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .frames import named, packed, pieces, unpacked

TOKEN = re.compile(
    r"<!--(?s:.*?)(?:-->|\Z)"
    r"|<(?P<close>/)?(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^\"'>]|\"[^\"]*\"|'[^']*')*+)>"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)")
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes")
RAW_END = {name: re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I) for name in RAW}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary "
    "table tbody td tfoot th thead tr ul br".split())
#: Elements that end an open element of the same kind, and those beyond which they don't look.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"),
            "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tbody", "thead", "tr", "td", "th")}
SCOPE = frozenset("ul ol dl select table article section div body html main".split())
# What is never part of an article.
DROPPED = frozenset(
    "head script style noscript template nav header footer aside form iframe object embed applet svg math canvas video audio "
    "button select textarea input dialog menu map xmp noembed noframes title search".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent "
    "cookie cookies disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices overlay "
    "pager pagination popup promo promos promotion related recommended replies respond search share sharing sidebar signup social "
    "sponsor sponsored subscribe subscription toolbar widget".split())
#: What a container that is dropped for its class or id alone doesn't hold.
CONTENT = frozenset(("article", "main", "h1"))
#: Dropped elements that some pages put, or by a missing end tag leave, around their content.
WRAPPERS = frozenset(("form", "header", "nav"))
#: Elements that are dropped for their class or id.
CONTAINERS = frozenset("div section ul ol dl p span table figure details fieldset center li a".split())


@dataclass
class Node:
    name: str
    parent: int
    first: int
    dropped: bool
    doubtful: bool = False
    wrapper: bool = False
    last: int = 0
    chars: int = 0
    tags: int = 0
    link_chars: int = 0
    link_tags: int = 0
    children: list[int] = field(default_factory=list)


def _unwanted(name: str, attributes: str) -> bool:
    """Whether an element with its content is left out, by its name or by what its attributes say.

    A hidden body is one that a script shows.
    """
    if name in DROPPED:
        return name not in WRAPPERS
    if name == "body" or not attributes or attributes.isspace():
        return False
    found = {k.lower(): html.unescape(a or b or c or "") for k, a, b, c in ATTRIBUTE.findall(attributes)}
    if found.get("role", "").lower() in DROPPED_ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true":
        return True
    if re.search(r"display\s*:\s*none", found.get("style", "")):
        return True
    return False


def _doubtful(name: str, attributes: str) -> bool:
    """Whether a token of a container's class or id consists of listed words alone."""
    if name not in CONTAINERS or not attributes or attributes.isspace():
        return False
    found = {k.lower(): html.unescape(a or b or c or "") for k, a, b, c in ATTRIBUTE.findall(attributes)}
    tokens = (found.get("class", "") + " " + found.get("id", "")).lower().split()
    words = [[w for w in re.split(r"[^a-z]+", token) if w] for token in tokens]
    return any(own and DROPPED_WORDS.issuperset(own) for own in words)


class Tree:
    """The document tree of a page without what is never content; ``texts`` are its pieces in page order."""

    def __init__(self, page: str):
        self.nodes = [Node("html", -1, 0, False)]
        self.texts: list[str] = []
        self.open = [0]
        at, raw = 0, None
        while at < len(page):
            if raw:  # everything up to the end tag is text, and none of it shows
                end = RAW_END[raw].search(page, at)
                at, raw = (end.end() if end else len(page)), None
                self._close(len(self.open) - 1)
                continue
            token = TOKEN.search(page, at)
            if token is None:
                self._text(page[at:])
                break
            if token.start() > at:
                self._text(page[at:token.start()])
            at = token.end()
            if name := token["name"]:
                name = name.lower()
                if token["close"]:
                    self._end(name)
                else:
                    self._start(name, token["attributes"])
                    if name in RAW:
                        raw = name
        while self.open:
            self._close(len(self.open) - 1)
        self._settle()

    def _settle(self) -> None:
        """Drop the doubtful containers that don't hold the page's content, then count what is left.

        A form, header or nav outside articles stays if it holds an article or main and no article
        stands outside all doubtful containers; one named by class or id if it
        holds an article, main or h1, or, on a page without articles, more than half of
        the characters, and no article stands outside those named so.  Density
        decides on what stays.  An article's own header stays if it holds an h1.
        """
        nodes = self.nodes
        if any(node.doubtful or node.wrapper for node in nodes):
            chars = [0 if node.dropped else node.chars for node in nodes]
            holds = [0] * len(nodes)  # 1: an h1, 2: an article or main
            inside, doubted, wrapped = ([False] * len(nodes) for _ in range(3))
            for i in range(len(nodes) - 1, 0, -1):
                if not nodes[i].dropped:
                    chars[nodes[i].parent] += chars[i]
                    holds[nodes[i].parent] |= holds[i] | (0 if nodes[i].name not in CONTENT else 1 if nodes[i].name == "h1" else 2)
            for i in range(1, len(nodes)):
                up = nodes[i].parent
                inside[i] = inside[up] or nodes[up].name == "article"
                doubted[i] = doubted[up] or nodes[i].doubtful
                wrapped[i] = wrapped[up] or nodes[i].wrapper
            articles = [i for i, node in enumerate(nodes) if node.name == "article" and not node.dropped]
            named_apart = any(not doubted[i] for i in articles)
            apart = any(not doubted[i] and not wrapped[i] for i in articles)
            for i in range(1, len(nodes)):
                node, up = nodes[i], nodes[nodes[i].parent]
                most = not articles and 2 * chars[i] > chars[0]
                if node.wrapper and inside[i]:
                    content = node.name == "header" and up.name == "article" and bool(holds[i] & 1)
                elif node.wrapper:
                    content = not apart and (bool(holds[i] & 2) or node.name == "form" and most)
                else:
                    content = True
                if node.doubtful:
                    content &= not inside[i] and not named_apart and (bool(holds[i]) or most)
                if up.dropped or node.dropped:
                    node.dropped = True
                elif not content:
                    node.dropped = True
                    self.texts[node.first:node.last] = [""] * (node.last - node.first)
            for node in nodes:
                node.children = [c for c in node.children if not nodes[c].dropped]
        for node in reversed(nodes):
            if node.parent >= 0 and not node.dropped:
                up = nodes[node.parent]
                link = node.name == "a"
                up.chars += node.chars
                up.tags += node.tags + 1
                up.link_chars += node.chars if link else node.link_chars
                up.link_tags += node.link_tags + link

    def _text(self, text: str) -> None:
        node = self.nodes[self.open[-1]]
        if not node.dropped:
            text = html.unescape(text)
            self.texts.append(text)
            if n := len(text.strip()):
                node.chars += n
                if node.name == "a":
                    node.link_chars += n

    def _start(self, name: str, attributes: str) -> None:
        if name in ("html", "body"):  # one of each; the root stands for html
            if name == "html" or any(self.nodes[i].name == "body" for i in self.open):
                return
        if name in BLOCKS:
            if name != "br":
                self._end("p", implied=True)
            self._break()
        for kind in SIBLINGS.get(name, ()):
            self._end(kind, implied=True, scope=SCOPE - {"table"} if name in ("td", "th", "tr", "tbody") else SCOPE)
        parent = self.open[-1]
        dropped = self.nodes[parent].dropped or _unwanted(name, attributes)
        node = Node(name, parent, len(self.texts), dropped, not dropped and _doubtful(name, attributes), not dropped and name in WRAPPERS)
        self.nodes.append(node)
        self.open.append(len(self.nodes) - 1)
        if not dropped:
            self.nodes[parent].children.append(len(self.nodes) - 1)
        if name in VOID or attributes.endswith("/") and name not in BLOCKS and name not in RAW:
            self._close(len(self.open) - 1)

    def _end(self, name: str, implied: bool = False, scope: frozenset = SCOPE) -> None:
        """Close the innermost open element of the name; an inline one isn't looked for beyond a block."""
        if not implied and name in ("html", "body"):
            return
        for depth in range(len(self.open) - 1, 0, -1):
            found = self.nodes[self.open[depth]].name
            if found == name:
                while len(self.open) > depth:
                    self._close(len(self.open) - 1)
                return
            if implied and found in scope or name not in BLOCKS and found in BLOCKS and name not in DROPPED:
                return

    def _close(self, depth: int) -> None:
        node = self.nodes[self.open.pop(depth)]
        if node.name in BLOCKS:
            self._break()
        node.last = len(self.texts)

    def _break(self) -> None:
        if self.texts and self.texts[-1] != " " and not self.nodes[self.open[-1] if self.open else 0].dropped:
            self.texts.append(" ")

    def text(self, ranges: list[tuple[int, int]]) -> str:
        """The texts of ascending ranges; a space stands where one begins beyond the end of the one before."""
        parts = [(" " if i and a > ranges[i - 1][1] else "") + "".join(self.texts[a:b]) for i, (a, b) in enumerate(ranges)]
        return " ".join("".join(parts).split())


def density(node: Node, body: Node) -> float:
    """Composite text density: characters per tag, scaled down by how much of the node is links.

    With C characters and T tags, LC and LT of them in links, the scale is
    ln(C / LC * T / LT) / ln(C / (C - LC) * LC + LC' / C' * C + e), C' and LC'
    being those of the body; at most 1, which is also that of a node without links.
    """
    if not node.chars:
        return 0.0
    tags = max(1, node.tags)
    scale = 1.0
    if node.link_chars:
        plain = max(1, node.chars - node.link_chars)
        base = math.log(node.chars / plain * node.link_chars + body.link_chars / max(1, body.chars) * node.chars + math.e)
        ratio = node.chars / node.link_chars * tags / max(1, node.link_tags)
        scale = min(1.0, max(0.0, math.log(ratio)) / base)
    return node.chars / tags * scale


def main_text(page: str) -> str:
    """The text of the subtree with the largest sum of its children's densities.

    The least density on the path from that node up to the body gives the
    threshold, a half of it.  If the node stands in an article element, that element is the
    content, with the articles beside it that reach the threshold.  Otherwise the path's other children belong to it too where they
    reach the threshold, and headings that directly precede such a child; articles directly in
    the node that don't reach it are left out if one beside them does.
    """
    tree = Tree(page)
    nodes = tree.nodes
    root = next((i for i, n in enumerate(nodes) if n.name == "body" and not n.dropped), 0)
    body = nodes[root]
    densities = [0.0 if n.dropped else density(n, body) for n in nodes]
    # Text of a node's own counts like a child without tags.
    sums = [0.0] * len(nodes)
    for i in range(root, len(nodes)):
        if not nodes[i].dropped:
            own = nodes[i].chars - sum(nodes[c].chars for c in nodes[i].children)
            sums[i] = sum(densities[c] for c in nodes[i].children) + own
    best = max(range(root, len(nodes)), key=lambda i: (sums[i], -i))
    path = [best]
    while path[-1] != root and nodes[path[-1]].parent >= 0:
        path.append(nodes[path[-1]].parent)
    threshold = min(densities[i] for i in path) / 2
    for i in path:
        if nodes[i].name == "article":
            beside = [] if i == root else [c for c in nodes[nodes[i].parent].children if nodes[c].name == "article"]
            return tree.text([(nodes[c].first, nodes[c].last) for c in beside or [i] if c == i or densities[c] >= threshold])
    articles = [c for c in nodes[best].children if nodes[c].name == "article"]
    if any(densities[c] >= threshold for c in articles):
        for c in articles:
            if densities[c] < threshold:
                tree.texts[nodes[c].first:nodes[c].last] = [""] * (nodes[c].last - nodes[c].first)
    kept = [(nodes[best].first, nodes[best].last)]
    for below, above in zip(path, path[1:]):
        heading = None
        for child in nodes[above].children:
            reached = child != below and densities[child] >= threshold
            if (reached or child == below) and heading is not None:
                kept.append((nodes[heading].first, nodes[heading].last))
            heading = None
            if reached:
                kept.append((nodes[child].first, nodes[child].last))
            elif child != below and re.fullmatch("h[1-6]", nodes[child].name):
                heading = child
    return tree.text(sorted(kept))


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with ``text``, the page's main text, and ``n_chars``, its code points.

    Left out are menus, headers, footers, sidebars, notices, adverts, forms,
    scripts, styles and reader comments, by element, role, class or id.  A class
    or id counts only as a whole token of listed words, and not on a container
    outside articles that holds an article, main or h1, or most characters of a
    page without articles, unless an article stands elsewhere; a form, header or
    nav around the only articles stays as well.  Of the remaining tree the subtree with the largest sum of composite densities is
    taken.  Character references are decoded; white space becomes one space.

    Null or empty html, and pages without text, give an empty text.  Pages that
    break off are closed at their end; elements are closed by what follows where
    the standard says so.  A page of any length is read whole.  Repeated rows
    give equal texts, an empty table an empty one.  Input columns named ``text``
    or ``n_chars`` are replaced.
    """
    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1024):
            texts = [main_text(page or "") for page in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["row", "text", "n_chars"])

    rows = packed(pages, html=named(html_col))
    out = rows.mapInArrow(extracted, rows.select("row").schema.add("text", "string").add("n_chars", "long"))
    return unpacked(out, pages.columns, text=F.col("text"), n_chars=F.col("n_chars"))
