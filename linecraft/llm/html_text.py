"""HTML extraction by composite text density.

A page is read into a DOM (unclosed, misnested and cut-off markup included). For every node:
C characters and T tags below it, LC characters and LT tags inside links. Its density is

    C / T * log(C * T / (LC * LT)) / log(log(C * LC / nonLC + lbC * C / C_body + e))

with every count at least 1: characters per tag, lowered by links. A node's density sum is the
sum of its children's densities. The node with the largest density sum is the core of the main
text; the smallest density on its path up to the body is the threshold. Every node of at least
that density adds the subtree of largest density sum under it. What the added subtrees have as
their lowest common ancestor (or the article element around it) is the main text.

Elements that are never main text (scripts, navigation, ...) are left out beforehand, and so are
forms, asides, dialogs and elements whose class, id or role is the name of page furniture or reader
comments, as a whole or with a known prefix. Unless these hold the main text: the larger part of what
articles there are, or, on a page without any, most of the characters outside links and labels
(comments excepted).
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import LongType, StringType, StructField, StructType

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset(
    "script style template head title nav footer button select option textarea "
    "input iframe object embed svg canvas audio video map menu".split())
# Dropped as well, unless they hold the main text: some frameworks wrap the whole body in one.
WRAPPERS = frozenset("form aside dialog noscript".split())
LABELS = frozenset("a label legend".split())  # their characters say nothing about where the main text is
BLOCK = frozenset(
    "address article blockquote body caption center dd details div dl dt fieldset figcaption figure "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main ol p pre section summary table tbody td tfoot "
    "th thead tr ul".split())
# A start tag closes these open elements, up to the nearest of the second set.
CLOSED_BY = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
             "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
             "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
             "thead": ({"tr", "td", "th", "thead", "tbody"}, {"table"}),
             "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"})}
ENDS_P = (BLOCK - {"caption", "td", "th", "tr", "tbody", "thead", "tfoot", "body", "html"}) | {"form", "nav",
          "footer", "aside", "menu"}
# Words of a class, id or role that name page furniture or reader comments.
FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion "
    "banner banners sidebar sidebars aside menu menus nav navbar navigation breadcrumb breadcrumbs footer "
    "masthead header topbar toolbar cookie cookies consent gdpr notice notices alert alerts popup modal "
    "overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "recommendations widget widgets comment comments commentlist comments-area disqus respond replies "
    "reply pagination pager search hidden complementary contentinfo".split())
# Words that name furniture with anything behind them (cookie-bar), and with these before them (site-nav).
LEADS = ("ad ads advert advertisement advertising sponsor sponsored promo cookie cookies consent gdpr newsletter "
         "sidebar navbar breadcrumb breadcrumbs pagination social share sharing comment comments disqus popup modal "
         "related-posts related-articles related-links related-stories related-content search-form search-box "
         "search-bar signup login nav menu footer widget toolbar topbar masthead").split()
PLACES = "site page main top bottom left right global primary secondary".split()
_KNOWN = re.compile(f"(?:{'|'.join(LEADS)})(?:[-_].*)?|(?:{'|'.join(PLACES)})[-_](.+)", re.S)
COMMENTS = re.compile(r"(?:comments?|commentlist|disqus|respond|repl(?:y|ies))(?![0-9a-z])")
_NAME = re.compile(r"[^0-9a-z]+")


class Node:
    __slots__ = ("tag", "parent", "children", "drop", "named", "chars", "tags", "link_chars", "link_tags",
                 "density", "total")

    def __init__(self, tag: str, parent: "Node | None", drop: bool = False, named: str = ""):
        self.tag, self.parent, self.children, self.drop, self.named = tag, parent, [], drop, named


def furniture_name(tag: str, attrs: dict) -> str:
    """The tag, class, id or role that names an element as furniture or comments; empty if none does."""
    if tag in ("html", "body", "article", "main"):
        return ""
    for name in " ".join(attrs.get(k) or "" for k in ("class", "id", "role")).lower().split():
        known = _KNOWN.fullmatch(name)
        if name in FURNITURE or known and (known[1] is None or known[1] in FURNITURE):
            return name
    return tag if tag in WRAPPERS else ""


def is_furniture(tag: str, attrs: dict) -> bool:
    if tag in DROPPED:
        return True
    if tag in ("html", "body", "article", "main") and attrs.get("role") not in ("comment",):
        names = attrs.get("class") or ""
        return tag == "article" and bool({"comment", "comments"} & set(_NAME.split(names.lower())))
    return "hidden" in attrs or attrs.get("aria-hidden") == "true"


class _Builder(HTMLParser):
    """Start tags, end tags and text -> tree; implied end tags as the HTML standard has them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", None)

    def updatepos(self, i, j):
        return j  # line numbers are not needed

    def _close(self, names, limit=frozenset()) -> None:
        node = self.at
        while node.parent is not None and node.tag not in limit:
            if node.tag in names:
                self.at = node.parent
                return
            node = node.parent

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body") and any(self._path(tag)):
            return
        if tag in ENDS_P:
            self._close({"p"}, {"td", "th", "caption", "article", "section", "div", "li", "blockquote", "form"})
        if tag in CLOSED_BY:
            names, limit = CLOSED_BY[tag]
            while True:
                before = self.at
                self._close(names, limit)
                if self.at is before:
                    break
        if tag == "body":
            self.at = self.root
        known = dict(attrs)
        node = Node(tag, self.at, is_furniture(tag, known), furniture_name(tag, known))
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("p", "div", "li"):
            self.handle_endtag(tag)

    def _path(self, tag):
        node = self.at
        while node is not None:
            if node.tag == tag and (tag != "html" or node is self.root):
                yield node
            node = node.parent

    def handle_endtag(self, tag):
        if tag not in VOID and tag not in ("html", "body"):
            self._close({tag}, {"table"} if tag not in BLOCK else frozenset())

    def handle_data(self, data):
        if data:
            self.at.children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    drop_named(builder.root)
    return builder.root


def _nodes(root: Node) -> list[Node]:
    """Kept nodes, parents first; no recursion, as pages may nest without bound."""
    out = [root]
    for node in out:
        out += [c for c in node.children if isinstance(c, Node) and not c.drop]
    return out


def drop_named(root: Node) -> None:
    """Drop the elements named as furniture that don't hold the main text."""
    nodes = _nodes(root)
    if not any(n.named for n in nodes):
        return
    # characters outside links and labels, and those of articles, below every node
    size, article = {}, {}
    for n in reversed(nodes):
        kids = [c for c in n.children if isinstance(c, Node) and not c.drop]
        own = sum(sum(map(len, c.split())) for c in n.children if isinstance(c, str))
        size[id(n)] = 0 if n.tag in LABELS else own + sum(size[id(c)] for c in kids)
        article[id(n)] = size[id(n)] if n.tag in ("article", "main") else sum(article[id(c)] for c in kids)
    every, articles = size[id(root)], article[id(root)]
    inside = {id(root): False}
    for n in nodes[1:]:
        inside[id(n)] = inside[id(n.parent)] or n.parent.tag in ("article", "main")
        if not n.named:
            continue
        mine, comments = article[id(n)], bool(COMMENTS.match(n.named))
        if inside[id(n)]:
            n.drop = comments or 2 * size[id(n)] <= every
        elif articles:
            n.drop = mine < articles if comments else 2 * mine <= articles
        else:
            n.drop = comments or 2 * size[id(n)] <= every


def measure(root: Node) -> list[Node]:
    """Fill in the counts, densities and density sums of all kept nodes."""
    nodes = _nodes(root)
    for n in reversed(nodes):
        own = sum(sum(map(len, c.split())) for c in n.children if isinstance(c, str))
        kids = [c for c in n.children if isinstance(c, Node) and not c.drop]
        n.chars = own + sum(c.chars for c in kids)
        n.tags = sum(1 + c.tags for c in kids)
        if n.tag == "a":
            n.link_chars, n.link_tags = n.chars, n.tags + 1
        else:
            n.link_chars, n.link_tags = sum(c.link_chars for c in kids), sum(c.link_tags for c in kids)
    body = next((n for n in nodes if n.tag == "body"), root)
    ratio = body.link_chars / max(1, body.chars)
    for n in reversed(nodes):
        c, t, lc, lt = max(1, n.chars), max(1, n.tags), max(1, n.link_chars), max(1, n.link_tags)
        base = math.log(c * lc / max(1, n.chars - n.link_chars) + ratio * c + math.e)
        n.density = n.chars / t * math.log(max(1.0, c * t / (lc * lt)) + 1) / math.log(base + math.e)
        n.total = sum(k.density for k in n.children if isinstance(k, Node) and not k.drop)
        if not any(isinstance(k, Node) and not k.drop for k in n.children):
            n.total = n.density
    return nodes


def main_node(root: Node) -> Node | None:
    """The subtree that holds the main text; None if no kept node has any text."""
    nodes = [n for n in measure(root) if n.chars]
    if not nodes:
        return None
    core = max(nodes, key=lambda n: n.total)
    path, node = [], core
    while node is not None:
        path.append(node)
        if node.tag == "body":
            break
        node = node.parent
    threshold = min(n.density for n in path)
    chosen, best = [core], {}
    for n in reversed(nodes):  # subtree of largest density sum under every node
        own = [n] + [best[id(c)] for c in n.children if isinstance(c, Node) and id(c) in best]
        best[id(n)] = max(own, key=lambda x: x.total)
    top = path[-1]
    for n in nodes:
        if n.density >= threshold and n.parent is not None and n is not top:
            chosen.append(best[id(n)])
    common = path[::-1]  # top .. core
    depth = {id(n): k for k, n in enumerate(common)}
    deepest = len(common) - 1
    for n in chosen:
        while n is not None and id(n) not in depth:
            n = n.parent
        deepest = min(deepest, depth[id(n)] if n is not None else 0)
    found = common[deepest]
    node = found
    while node is not None:
        if node.tag in ("article", "main"):
            return node
        node = node.parent
    return found


def blocks(node: Node, inside_article: bool) -> list[str]:
    """Texts of the blocks in page order. Outside an article, blocks that are mostly links go."""
    out, run = [], []

    def flush():
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            out.append(text)

    stack = [iter([node])]
    ends = []
    while stack:
        child = next(stack[-1], None)
        if child is None:
            stack.pop()
            if ends and ends.pop():
                flush()
        elif isinstance(child, str):
            run.append(child)
        elif child.drop or (not inside_article and child is not node and child.tag in BLOCK
                            and child.link_chars * 2 > child.chars > 0):
            if child.tag in BLOCK or child.tag in ENDS_P:
                flush()
        elif child.tag == "br":
            run.append(" ")
        elif child.tag not in VOID:
            block = child.tag in BLOCK
            if block:
                flush()
            stack.append(iter(child.children))
            ends.append(block)
        elif child.tag == "hr":
            flush()
    flush()
    return out


def extract(html: str | None) -> str:
    """Main text of a page; empty for a null, empty or text-free page."""
    root = parse(html or "")
    node = main_node(root)
    if node is None:
        return ""
    return "\n\n".join(blocks(node, node.tag in ("article", "main")))


def extract_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """All columns of ``pages`` but the html, with ``text`` and ``n_chars``; no shuffle.

    Repeated rows stay; columns named text or n_chars are replaced.
    """
    keep = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    fields = [pages.schema[c] for c in keep]
    out = StructType([*fields, StructField("text", StringType()), StructField("n_chars", LongType())])

    def run(batches):
        for b in batches:
            texts = [extract(h) for h in b[html].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(b[c] for c in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                [*keep, "text", "n_chars"])

    return pages.select(*keep, html).mapInArrow(run, out)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page from its whole html."""
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
