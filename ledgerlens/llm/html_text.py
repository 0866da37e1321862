"""Main text of web pages by composite text density.

A page becomes a tree. Elements that never hold article text (scripts, menus, forms)
are left out, and elements whose class, id or role names a menu, advert, notice, comment
list ... if they are short or hold less than half of the page's text or mostly links, no <h1>
and not the node with the largest density sum. Every remaining node gets its link-adjusted
characters per tag, every node the sum of its children's densities. The node with the
largest sum is the main content; the smallest density on its path to the body is the
threshold. Further subtrees that reach it join the content. All blocks of the content
are returned in page order.

Text: character references decoded, white space inside a block as one space, trimmed,
blocks joined by two line feeds. A null or empty page, or one without text, gives "".
Unclosed, stray and cut-off tags are tolerated; time is linear in the page's length.
Repeated rows each get their row, nulls in other columns are carried, extra columns
aren't read. An empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import map_rows

#: Element names of the HTML standard by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg math select option datalist canvas object audio video".split())
DROPPED = RAW | frozenset("head nav header footer aside form button menu dialog fieldset label input legend".split())
BLOCKS = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split())
CLOSES_P = BLOCKS - frozenset("body html td th tr tbody thead tfoot".split())
#: A start tag of the key ends an open element of the value, up to the nearest of the stops.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
        "option": ({"option"}, {"select"})}
INLINE = frozenset("a abbr b big cite code del em font i ins kbd mark q s samp small span strike strong sub sup time tt u var".split())
#: Of the raw elements those that end at once where their end tag is missing, so that they don't take the rest of the page.
SHUT = frozenset("svg math select option datalist canvas object audio video".split())
#: Words in class, id or role that name what isn't the article.
HINTS = frozenset("""ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies
copyright disqus disclaimer discussion feedback footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notification overlay pager
pagination paywall popup privacy promo promoted promotion recommended recommendations related replies reply respond search share sharing sidebar signup skip social
sponsor sponsored subscribe subscription tags teaser toolbar topbar widget widgets complementary contentinfo alert dialog""".split())
KEEPS = frozenset(["html", "body", "main"])
#: Of these words only some tell that an article element isn't the page's article.
ARTICLE_HINTS = frozenset("ad advert advertisement comment promo promoted reply sponsored teaser".split())

#: So many characters are short for an element with such a word, as is less than half of the page's text.
SHORT = 300

_TAG = re.compile(r"<(?:!--|(/?)([A-Za-z][^\s/>\x00]*)|[!?/])")
_ATTRS = re.compile(r"""[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+>""")
_NAMED = re.compile(r"""(?<![\w-])(?:class|id|role|aria-label|hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_SPLIT = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("name", "parent", "items", "out", "hinted", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, name: str, parent: Node | None, out: bool, hinted: bool = False):
        self.name, self.parent, self.items, self.out, self.hinted = name, parent, [], out, hinted


def _left_out(name: str, attrs: str) -> tuple[bool, bool]:
    """Whether an element is left out, and whether a word names something else than the article."""
    if name in DROPPED:
        return True, False
    if name in KEEPS or not attrs or "=" not in attrs and "hidden" not in attrs:
        return False, False
    hinted = False
    for m in _NAMED.finditer(attrs):
        key, value = m[0][:6].lower(), m[1] or m[2] or m[3] or ""
        if key.startswith("hidden") and value.lower() != "false" or key.startswith("style") and _HIDDEN.search(value):
            return True, False
        if not key.startswith("style") and not (ARTICLE_HINTS if name == "article" else HINTS).isdisjoint(x.lower() for x in _SPLIT.split(value)):
            hinted = True
    return False, hinted


def parse(page: str) -> Node:
    """The tree of a page: items of a node are strings and nodes, in order; ``out`` marks subtrees to leave out."""
    root = here = Node("html", None, False)
    at, depth, endless = 0, {}, set()

    def close(names: set | frozenset, stops: set | frozenset) -> None:
        """Closes up to the innermost open element of these names, if none of the stops is nearer."""
        nonlocal here
        if not any(depth.get(n) for n in names):
            return
        node = here
        while node.parent is not None:
            if node.name in names:
                while here is not node:
                    depth[here.name] -= 1
                    here = here.parent
                depth[node.name] -= 1
                here = node.parent
                return
            if node.name in stops:
                return
            node = node.parent

    while True:
        m = _TAG.search(page, at)
        if m is None:
            here.items.append(page[at:])
            return root
        if m.start() > at:
            here.items.append(page[at:m.start()])
        if m[2] is None:
            if m[0] == "<!--":
                end = page.find("-->", m.start() + 2)
                at = len(page) if end < 0 else end + 3
            else:
                end = page.find(">", m.end())
                at = len(page) if end < 0 else end + 1
            continue
        whole = _ATTRS.match(page, m.end())
        at = whole.end() if whole else max(page.find(">", m.end()) + 1, 0) or len(page)
        name = m[2].lower()
        if m[1]:
            if name == "p" and not depth.get("p"):
                continue
            close({name}, BLOCKS if name in INLINE else {"table"} - {name})
            continue
        attrs = page[m.end():at - 1]
        if name in ("html", "body") and (name == "html" or depth.get("body")):
            continue
        if name in CLOSES_P:
            close({"p"}, {"td", "th", "table", "button", "div", "li", "section", "article", "blockquote"})
        if name in ENDS:
            close(*ENDS[name])
        out, hinted = _left_out(name, attrs)
        node = Node(name, here, here.out or out, hinted)
        here.items.append(node)
        if name in VOID or attrs.endswith("/") and name not in BLOCKS:
            continue
        if name in RAW:
            end = None if name in endless else re.compile(rf"</{re.escape(name)}(?![\w-])[^>]*>?", re.I).search(page, at)
            if end is None and name in SHUT:
                endless.add(name)  # no later one has an end either
                continue
            node.items.append(page[at:end.start() if end else len(page)])
            at = end.end() if end else len(page)
            continue
        depth[name] = depth.get(name, 0) + 1
        here = node


def measure(root: Node) -> list[Node]:
    """Sets counts, composite densities and density sums; returns the nodes kept, children first."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [x for x in node.items if isinstance(x, Node) and not x.out]
    order.reverse()
    for node in order:
        kids = [x for x in node.items if isinstance(x, Node) and not x.out]
        own = sum(len(_SPACE.sub("", x)) for x in node.items if isinstance(x, str))
        node.chars = own + sum(k.chars for k in kids)
        node.tags = len(kids) + sum(k.tags for k in kids)
        link = node.name in ("a", "button")
        node.link_chars = node.chars if link else sum(k.link_chars for k in kids)
        node.link_tags = sum(k.link_tags + (k.name in ("a", "button")) for k in kids)
    body = next((n for n in reversed(order) if n.name == "body"), root)
    ratio = body.link_chars / body.chars if body.chars else 0.0
    for node in order:
        c, t, lc, lt = node.chars, max(node.tags, 1), max(node.link_chars, 1), max(node.link_tags, 1)
        if not c:
            node.density = 0.0
        else:
            base = math.log(c * node.link_chars / max(c - node.link_chars, 1) + ratio * c + math.e)
            node.density = c / t * (math.log(max(c / lc * t / lt, 1.0)) / math.log(max(base, 1.0 + 1e-9)))
        kids = [x for x in node.items if isinstance(x, Node) and not x.out]
        own = sum(len(_SPACE.sub("", x)) for x in node.items if isinstance(x, str))
        node.total = sum(k.density for k in kids) + (own if own > node.link_chars else 0)  # own text counts as a child without tags
    return order


def _densest(order: list[Node], root: Node) -> tuple[Node, Node]:
    """The body and its node with the largest density sum."""
    inner = {id(n) for n in order}
    body = next((n for n in reversed(order) if n.name == "body"), root)
    under, todo = [], [body]
    while todo:
        node = todo.pop()
        if node.name not in INLINE:
            under.append(node)
        todo += [x for x in reversed(node.items) if isinstance(x, Node) and id(x) in inner]
    return body, max(under, key=lambda n: n.total, default=body)


def content(root: Node) -> list[Node]:
    """The subtrees of the main content, in page order."""
    order = measure(root)
    body, best = _densest(order, root)
    if any(n.hinted for n in order):
        holds = set()
        for node in (best, *(n for n in order if n.name == "h1")):
            while node is not None and id(node) not in holds:
                holds.add(id(node))
                node = node.parent
        for n in order:
            if n.hinted and id(n) not in holds and (n.chars < max(SHORT, body.chars / 2) or n.link_chars * 2 >= n.chars):
                n.out = True
        order = measure(root)
        body, best = _densest(order, root)
    inner = {id(n) for n in order}
    article = best
    while article is not body and article.name not in ("article", "main"):
        article = article.parent
    if article is not body:  # the page itself names the article's element
        best = article
    threshold, node = best.density, best
    while node is not None and node is not body.parent:
        threshold = min(threshold, node.density)
        node = node.parent
    chosen, above = {id(best)}, set()
    node = best.parent
    while node is not None:
        above.add(id(node))
        node = node.parent
    found, todo = [], [body]
    while todo:
        node = todo.pop()
        if id(node) in chosen or (id(node) not in above and node.density >= threshold):
            found.append(node)
        elif id(node) in above or node.density >= threshold:
            todo += [x for x in reversed(node.items) if isinstance(x, Node) and id(x) in inner]
    return found


def blocks(node: Node) -> list[str]:
    """The texts of the blocks of a subtree, in page order, without what is left out."""
    out, parts = [], []

    def flush() -> None:
        text = " ".join(entities.unescape("".join(parts)).split())
        parts.clear()
        if text:
            out.append(text)

    todo: list = [node]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            parts.append(x)
        elif not x.out:
            if x.name == "br":
                parts.append(" ")
            block = x.name in BLOCKS
            if block:
                flush()
                todo.append(None)
            todo += reversed(x.items)
    flush()
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    return "\n\n".join(b for node in content(parse(page)) for b in blocks(node))


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep``, text and n_chars, for every row."""
    names = [f"k{i}" for i in range(len(keep))]
    schema = ", ".join(f"{n} {pages.schema[c].dataType.simpleString()}" for n, c in zip(names, keep, strict=True))

    def row(*values):
        text = main_text(values[-1])
        return [(*values[:-1], text, len(text))]

    out = map_rows(pages.select(*(F.col(c).alias(n) for n, c in zip(names, keep, strict=True)), F.col(html_col).alias("h")),
                   lambda: row, f"{schema}, text string, n_chars bigint", out_rows=256)
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, keep, strict=True)), "text", "n_chars")
