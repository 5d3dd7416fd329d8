"""Main text of web pages by composite text density.

A page is read by a tolerant tokenizer into a tree (end tags may be missing, a page may stop anywhere), in time in
proportion to its length, however deep it is. Parts that never are main text go first: scripts, styles, forms, menus,
page headers and footers, sidebars, notices, adverts, comments. A part that goes for the name of its class only stays if
most of the page's text is in it and most of that isn't links, unless the name says adverts or readers' comments.
For every other node the composite text density is computed: characters a tag, adjusted by its link characters and link
tags against those of the body. A node's density sum is the sum of its children's densities. The subtree of the maximum
sum is the core; the smallest density on its path to the body is the threshold. At every node of that path, children
that reach the threshold, headings, and texts of its own that reach it are main text too.

Where the core lies in an article (or main) element, that element is the article of the contract, of which nothing may be
dropped by its density: it is kept whole, with other articles beside it that reach the threshold, and nothing else.

Blocks are joined in page order by one space. Defined results: null, empty and text-free pages give the empty text;
character references are decoded, also those without a semicolon where HTML allows it; a tag cut off at the end of the
page is dropped; of equal density sums the first in page order is the core. Repeated rows give equal rows, rows with a
null id are like others, and columns besides the id, the address and the page are not looked at.
"""

from __future__ import annotations

import bisect
import html
import math
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _util as u

#: Fixed names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
#: A start tag closes these open elements, looked for up to the given boundary.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "thead": ({"tbody"}, {"table"}), "tfoot": ({"tbody", "thead"}, {"table"}),
}
SCOPE = frozenset("table td th caption button object".split())

#: Elements and names that aren't main text.
DROPPED = frozenset("head script style title noscript template nav footer aside form button select textarea input iframe object embed svg canvas audio video menu dialog frameset noframes noembed xmp math map".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar status note".split())
DROPPED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promoted banner cookie cookies consent gdpr notice notices alert disclaimer newsletter subscribe subscription signup login popup modal overlay paywall "
    "sidebar sidebars side rail widget widgets related recommended recommendations share sharing social breadcrumb breadcrumbs pagination pager menu nav navbar navigation topbar toolbar header masthead footer copyright "
    "comment comments commentlist disqus replies reply respond reactions feedback".split()
)
#: Of these names, those that no amount of text makes main text, and words that turn a name into something else.
NEVER_TEXT = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promoted related comment comments commentlist disqus replies reply respond reactions feedback".split())
MODIFIERS = frozenset("has no not with without".split())
HEADED = frozenset("article content entry page post section story".split())
HEADINGS = frozenset({"h1", "h2", "h3"})
KEPT_WHOLE = frozenset({"html", "body", "main", "article"})
#: How far a part is dropped: by the name of its class only, or for good.
BY_NAME, GONE = 1, 2

TOKEN = re.compile(r"""<(?:!--(?:.*?--!?>|.*\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z))""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|\Z)""", re.I)
SPLIT = re.compile(r"[^a-z0-9]+")


class Node:
    __slots__ = ("tag", "parent", "parts", "dropped", "chars", "tags", "link_chars", "link_tags", "density")

    def __init__(self, tag: str, parent: Node | None, dropped: int):
        self.tag, self.parent, self.dropped = tag, parent, dropped
        self.parts: list = []  # child nodes and texts in order
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = 0.0


def layout_words(names: str) -> set[str]:
    """The words of class or id names that speak of layout; a name such as has-sidebar or entry-header doesn't."""
    out = set()
    for name in names.split():
        words = [w for w in SPLIT.split(name) if w]
        if not words or words[0] in MODIFIERS:
            continue
        found = DROPPED_NAMES.intersection(words)
        if words[0] in HEADED:
            found -= {"header"}
        out |= found
    return out


def drop_level(tag: str, attributes: str, tree: _Open) -> int:
    """0, BY_NAME or GONE."""
    if tag in DROPPED or tag == "header" and not tree.has("article", "main"):
        return GONE
    if not attributes or attributes.isspace() or tag in ("html", "body"):
        return 0
    level = 0
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            return GONE
        if name == "role" and not DROPPED_ROLES.isdisjoint(value.split()):
            return GONE
        if name in ("class", "id") and (words := layout_words(value)):
            if words & NEVER_TEXT:
                return GONE
            if tag not in KEPT_WHOLE:
                level = BY_NAME
    return level


class _Open:
    """The open elements: a stack, and where in it each tag stands, so that a miss costs nothing."""

    def __init__(self, root: Node):
        self.stack = [root]
        self.at: dict[str, list[int]] = {root.tag: [0]}
        self.blocks = [0]  # where elements stand that aren't inline

    def push(self, node: Node) -> None:
        k = len(self.stack)
        self.stack.append(node)
        self.at.setdefault(node.tag, []).append(k)
        if node.tag not in INLINE:
            self.blocks.append(k)

    def cut(self, k: int) -> None:
        """Close the k-th element and all in it; the root stays."""
        stack, at = self.stack, self.at
        while len(stack) > max(k, 1):
            tag = stack.pop().tag
            at[tag].pop()
            if tag not in INLINE:
                self.blocks.pop()

    def last(self, tags) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def first_after(self, tags, k: int) -> int:
        """The lowest of these tags above the k-th element; 0 if there is none."""
        found = []
        for t in tags:
            places = self.at.get(t) or []
            if (i := bisect.bisect_right(places, k)) < len(places):
                found.append(places[i])
        return min(found, default=0)

    def has(self, *tags: str) -> bool:
        return any(self.at.get(t) for t in tags)


def parse(page: str) -> Node:
    """The tree of a page. An explicit stack, so that depth has no limit."""
    root = Node("html", None, 0)
    tree = _Open(root)
    stack, opened = tree.stack, tree.at
    at, n, named = 0, len(page), False

    def text(s: str) -> None:
        if s and stack[-1].dropped < GONE:
            stack[-1].parts.append(html.unescape(s) if "&" in s else s)

    while at < n:
        start = page.find("<", at)
        if start < 0:
            text(page[at:])
            break
        m = TOKEN.match(page, start)
        if m is None:  # a lone < is text
            text(page[at : start + 1])
            at = start + 1
            continue
        text(page[at:start])
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, closing, attributes = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if m[5] and at == n and page[-1] != ">":
            break  # cut off
        if closing:
            if tag == "br":
                stack[-1].parts.append(None)
            places = opened.get(tag)
            if places and places[-1] and not (tag in INLINE and tree.blocks[-1] > places[-1]):
                tree.cut(places[-1])
            continue
        if tag in ("html", "body"):
            if tag == "body":
                while len(stack) > 1 and stack[-1].tag in ("head", "title"):
                    tree.cut(len(stack) - 1)
                if not tree.has("body"):
                    node = Node("body", stack[-1], 0)
                    stack[-1].parts.append(node)
                    tree.push(node)
            continue
        if stack[-1].tag == "head" and tag not in RAW and tag not in ("meta", "link", "base", "noscript", "template", "title"):
            tree.cut(len(stack) - 1)
        if tag in CLOSES_P and opened.get("p") and opened["p"][-1] > tree.last(SCOPE):
            tree.cut(opened["p"][-1])
        if tag in IMPLIED:
            ends, bound = IMPLIED[tag]
            k, b = tree.last(ends), tree.last(bound)
            if k > b:  # a row ends cells and the row that holds them
                tree.cut(tree.first_after(ends, b) if tag == "tr" else k)
        parent = stack[-1]
        level = GONE if parent.dropped == GONE else drop_level(tag, attributes, tree)
        named = named or level == BY_NAME
        node = Node(tag, parent, level)
        parent.parts.append(node)
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            if tag not in DROPPED and level < GONE:
                node.parts.append(page[at : close.start() if close else n])
            at = close.end() if close else n
        elif tag not in VOID and not (attributes.endswith("/") and tag in ("path", "circle", "rect")):
            tree.push(node)
    if named:
        _rescue(root)
    return root


def composite_density(node: Node, body: Node) -> float:
    """Characters a tag, raised where few of them are links; zero counts are taken as one."""
    if not node.chars:
        return 0.0
    c, t = node.chars, max(1, node.tags)
    lc, lt = max(1, node.link_chars), max(1, node.link_tags)
    plain = max(1, node.chars - node.link_chars)
    base = math.log(c / plain * node.link_chars + body.link_chars / max(1, body.chars) * c + math.e)
    inner = c / lc * t / lt
    if base <= 1.0:
        base = 1.0 + 1e-9
    return c / t * (math.log(inner) / math.log(base) if inner > 0 else 0.0)


def nodes(root: Node, level: int = BY_NAME) -> list[Node]:
    """All nodes that aren't dropped to this level or further, parents first."""
    out, stack = [], [root]
    while stack:
        x = stack.pop()
        if x.dropped < level:
            out.append(x)
            stack += [p for p in reversed(x.parts) if isinstance(p, Node)]
    return out


def count(order: list[Node], level: int = BY_NAME) -> None:
    """Characters, tags, link characters and link tags of nodes, given parents first."""
    for x in reversed(order):
        x.chars = x.tags = x.link_chars = x.link_tags = 0
        for p in x.parts:
            if isinstance(p, str):
                x.chars += len(" ".join(p.split()))
            elif p is not None and p.dropped < level:
                x.chars += p.chars
                x.tags += p.tags + 1
                x.link_chars += p.link_chars
                x.link_tags += p.link_tags + (p.tag == "a")
        if x.tag == "a":
            x.link_chars = x.chars


def _rescue(root: Node) -> None:
    """Take back what was dropped by name, where it holds most of the page's text and isn't mostly links."""
    every = nodes(root, GONE)
    count(every, GONE)
    for x in every:
        if x.dropped and 2 * x.chars > root.chars and 2 * x.link_chars <= x.chars:
            x.dropped = 0


def run_density(run: list, body: Node) -> float:
    """The density of texts and inline elements that stand in a row, as of one node that holds them."""
    holder = Node("", None, 0)
    holder.parts = run
    count([holder])
    return composite_density(holder, body)


def selected(root: Node) -> tuple[Node | None, Node | None, float]:
    """The body, the core (the first node of the maximum density sum) and the threshold; densities are set on the way."""
    order = nodes(root)
    count(order)
    body = next((x for x in order if x.tag == "body"), root)
    if not body.chars:
        body = root
    if not body.chars:
        return None, None, 0.0
    inside = nodes(body)
    for x in inside:
        x.density = composite_density(x, body)
    core = max(inside, key=lambda x: sum(p.density for p in x.parts if isinstance(p, Node) and not p.dropped))
    threshold, at = core.density, core
    while at is not body and at.parent is not None:
        at = at.parent
        threshold = min(threshold, at.density)
    return body, core, threshold


def main_nodes(root: Node) -> list:
    """The subtrees and texts of the main text, in page order."""
    body, core, threshold = selected(root)
    if body is None:
        return []
    path = [core]
    while path[-1] is not body and path[-1].parent is not None:
        path.append(path[-1].parent)
    reaches = lambda p: isinstance(p, Node) and not p.dropped and p.chars and p.density >= threshold
    marked = [x for x in path if x.tag in ("article", "main")]
    if marked:
        top = marked[-1]
        beside = top.parent.parts if top.parent else [top]
        return [p for p in beside if p is top or reaches(p) and p.tag == "article"]
    kept: deque = deque([None, core, None])
    for inner, outer in zip(path, path[1:], strict=False):
        if len(outer.parts) == 1:
            continue
        at = next(k for k, p in enumerate(outer.parts) if p is inner)
        kept.extendleft(reversed([*_reaching(outer.parts[:at], threshold, body), None]))
        kept.extend([None, *_reaching(outer.parts[at + 1 :], threshold, body)])
    return list(kept)


def _reaching(parts: list, threshold: float, body: Node) -> list:
    """The parts that are main text for themselves. Texts and inline elements in a row are one block: they stay or go
    together."""
    out: list = []
    run: list = []

    for p in [*parts, None]:
        if isinstance(p, str) or p is not None and p.tag in INLINE:
            run.append(p)
        else:
            if run and run_density(run, body) >= threshold:
                out += [*run, None]
            run = []
            if p is not None and not p.dropped and (p.tag in HEADINGS or p.chars and p.density >= threshold):
                out.append(p)
    return out


def block_text(tops: list) -> str:
    """The blocks of subtrees and texts joined by one space. Inline elements don't end a block, a line break does, and so
    does None."""
    blocks: list[str] = []
    run: list[str] = []

    def end() -> None:
        if run:
            if x := " ".join("".join(run).split()):
                blocks.append(x)
            run.clear()

    stack: list = [None, *reversed(tops)]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            run.append(x)
        elif x is None:
            end()
        elif not x.dropped:
            if x.tag in INLINE:
                stack += reversed(x.parts)
            else:
                end()
                stack.append(None)
                stack += reversed(x.parts)
    return " ".join(blocks)


def main_text(page: str | None) -> str:
    return block_text(main_nodes(parse(page))) if page else ""


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in u.pieces(b, 128):
                texts = [main_text(p) for p in x.column(2).to_pylist()]
                yield u.batch(schema, [x.column(0), x.column(1), texts, list(map(len, texts))])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
