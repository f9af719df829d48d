"""Main text of web pages: site templates found by counting element subtrees per host, then the article's blocks.

1. Every page is parsed leniently into elements. Each element subtree (tag, class and id, text with white space
   collapsed, children) gets a 64-bit hash.
2. Spark counts the pages of each host that hold a subtree; pages with the same text (by step 4, before templates are
   known) count once, so that copies of a page do not vote its text out. Subtrees on at least MIN_PAGES pages and at
   least SHARE of the host's pages are its template and are deleted. Inside an article or main element
   IN_ARTICLE_SHARE holds instead. On large hosts block elements outside articles are template as well, whatever their
   share, if pages with MANY different longest blocks hold them; near copies mostly share their longest block.
3. Elements that are never main text go as well: menus, page headers, footers, sidebars, notices, adverts, forms,
   scripts, styles, hidden ones, by their tag or role; outside articles also those one of whose classes, or whose id, is
   as a whole a name of NAMES. Inside articles only the names of reader comments and adverts count.
4. What is left of the articles (else of main, else of the body) gives blocks. White space inside a block becomes one
   space, blocks are trimmed and joined by one space in page order.

Parsing takes time in proportion to the page, whatever it holds: each character is passed once, a tag that never ends
is text, and from the first quotation mark that never ends on a tag ends at its next `>`.

Defined results: null or empty html gives an empty text; a page whose host cannot be read takes part in no template;
repeated rows get equal results each; empty tables give empty results; other columns are ignored. Templates of a host
are a bounded list: subtrees on a given share of its pages are at most as many as a page's elements over that share, those
on MANY pages as many as its elements over MANY.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

MIN_PAGES = 5
SHARE = 0.25
IN_ARTICLE_SHARE = 0.8
MANY = 1000
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noframes".split())
DROPPED = frozenset("head script style noscript template nav footer aside form button select option textarea input iframe object svg canvas audio video dialog menu map figure-menu title".split())
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
#: A start tag of the key ends an open element of these at the same level.
ENDS = {t: frozenset({"p"}) for t in "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()} | {
    "li": frozenset({"li", "p"}), "dt": frozenset({"dt", "dd", "p"}), "dd": frozenset({"dt", "dd", "p"}), "tr": frozenset({"tr", "td", "th", "p"}), "td": frozenset({"td", "th", "p"}), "th": frozenset({"td", "th", "p"}),
    "option": frozenset({"option"}), "body": frozenset({"head"}), "tbody": frozenset({"tr", "td", "th", "tbody", "thead"}), "tfoot": frozenset({"tr", "td", "th", "tbody", "thead"}),
}
#: An element that opens here shields what is open outside it.
SCOPES = frozenset("html body table td th ul ol dl article section main div aside nav header footer form blockquote figure".split())
#: Whole classes and ids that name a function of the page.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements banner sponsored promo cookies cookie-banner cookie-bar cookie-consent cookie-notice consent gdpr notice notices site-notice alert alerts popup modal overlay newsletter "
    "newsletter-signup signup subscribe sidebar side-bar menu main-menu nav navbar nav-bar navigation site-nav breadcrumb breadcrumbs header page-header site-header footer page-footer site-footer masthead topbar toolbar share share-buttons "
    "social social-links related-links related-posts recommended recommendations widget login search search-form searchbox pagination pager skip-link toc".split()
)
INNER_NAMES = frozenset("comments comment-list comment-section commentlist comment-form disqus disqus_thread ad ads advert adverts advertisement advertisements adsbygoogle".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
_TAG = re.compile(r"[A-Za-z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


class Node:
    __slots__ = ("tag", "names", "junk", "children", "hash")

    def __init__(self, tag: str, names: str = "", junk: bool = False):
        self.tag, self.names, self.junk = tag, names, junk
        self.children: list[Node | str] = []
        self.hash = 0


def _element(tag: str, attributes: str, inside: bool) -> Node:
    found = {m[1].lower(): html_lib.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(attributes)} if attributes and not attributes.isspace() else {}
    names = f"{found.get('class', '')} {found.get('id', '')}".strip()
    junk = tag in DROPPED or found.get("role", "").lower() in ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    if not junk and names and tag not in ("html", "body", "main"):
        own = names.lower().split()
        junk = not INNER_NAMES.isdisjoint(own) or not inside and tag != "article" and not NAMES.isdisjoint(own)
    return Node(tag, names, junk)


class _Open:
    """The open elements. How many of each tag are open is known for every scope, so that no search for one that is not there walks the stack."""

    def __init__(self, root: Node):
        self.stack = [root]
        self.scopes: list[tuple[int, dict[str, int]]] = [(0, {})]  # where the scope's element stands, and the tags open inside it
        self.all: dict[str, int] = {}

    def push(self, node: Node) -> None:
        self.stack.append(node)
        for counts in (self.scopes[-1][1], self.all):
            counts[node.tag] = counts.get(node.tag, 0) + 1
        if node.tag in SCOPES:
            self.scopes.append((len(self.stack) - 1, {}))

    def pop(self) -> str:
        tag = self.stack.pop().tag
        if tag in SCOPES:
            self.scopes.pop()
        self.scopes[-1][1][tag] -= 1
        self.all[tag] -= 1
        return tag

    def end(self, tag: str) -> None:
        """The end tag of something that is not open here changes nothing."""
        if (self.all if tag in SCOPES else self.scopes[-1][1]).get(tag, 0):
            while self.pop() != tag:
                pass

    def close(self, tags: frozenset[str]) -> None:
        """Ends all open elements of these tags up to the first scope of another tag."""
        while True:
            at, inner = self.scopes[-1]
            if any(inner.get(t, 0) for t in tags):
                while self.pop() not in tags:
                    pass
            elif at and self.stack[at].tag in tags:
                while len(self.stack) > at:
                    self.pop()
            else:
                return


def parse(page: str) -> Node:
    """The root of the page's elements; text is decoded, comments are gone."""
    root = Node("#root")
    opened = _Open(root)
    text, at, end, quotes, last_gt = 0, 0, len(page), True, page.rfind(">")

    def take(stop: int) -> None:
        if stop > text:
            opened.stack[-1].children.append(html_lib.unescape(page[text:stop]))

    while (at := page.find("<", at)) >= 0:
        mark = page[at + 1 : at + 2]
        if mark in ("!", "?"):
            take(at)
            kind, close = next(((k, c) for k, c in (("<!--", "-->"), ("<![CDATA[", "]]>")) if page.startswith(k, at)), ("", ">"))
            stop = page.find(close, at + len(kind or mark))
            if kind == "<![CDATA[":
                opened.stack[-1].children.append(page[at + len(kind) : stop if stop >= 0 else end])
            text = at = stop + len(close) if stop >= 0 else end
            continue
        closing = mark == "/"
        name = _TAG.match(page, at + 1 + closing) if at < last_gt else None
        if name is None:
            at += 1
            continue
        stop, look = -1, name.end()
        while quotes and stop < 0:
            m = _STOP.search(page, look)
            if m is None:
                quotes = False
            elif m[0] == ">":
                stop = m.start()
            elif not page[look : m.start()].rstrip().endswith("="):
                look = m.end()  # a quotation mark that opens no value
            elif (look := page.find(m[0], m.end()) + 1) == 0:
                quotes = False
        if stop < 0:
            stop = page.find(">", name.end())
        take(at)
        attributes = page[name.end() : stop]
        text = at = stop + 1
        tag = name[0].lower()
        if closing:
            opened.end(tag)
            continue
        if tag in ENDS:
            opened.close(ENDS[tag])
        node = _element(tag, attributes, bool(opened.all.get("article")))
        opened.stack[-1].children.append(node)
        if tag in VOID or attributes.endswith("/") and tag not in BLOCKS:
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            node.children.append(page[at : close.start() if close else end])
            text = at = close.end() if close else end
            continue
        opened.push(node)
    take(end)
    return root


def hashed(root: Node) -> list[tuple[Node, bool]]:
    """All elements, children before parents, with their hashes set, and whether they stand inside an article or main."""
    order: list[tuple[Node, bool]] = []
    todo = [(root, False)]
    while todo:
        node, inside = todo.pop()
        order.append((node, inside))
        below = inside or node.tag in ("article", "main")
        todo += [(c, below) for c in node.children if isinstance(c, Node)]
    order.reverse()
    for node, _ in order:
        h = xxhash.xxh3_64(f"<{node.tag} {node.names}>".encode())
        for c in node.children:
            if isinstance(c, Node):
                h.update(b"\x01" + c.hash.to_bytes(8, "little"))
            elif t := " ".join(c.split()):
                h.update(b"\x02" + t.encode("utf-8", "surrogatepass"))
        node.hash = h.intdigest()
    return order


def _signed(h: int) -> int:
    return h - 2**64 if h >= 2**63 else h


def main_text(page: str, template: frozenset[int] = frozenset(), inner_template: frozenset[int] = frozenset()) -> str:
    root = parse(page)
    if template or inner_template:
        for node, inside in hashed(root):
            if _signed(node.hash) in (inner_template if inside else template) and node.tag not in ("html", "body", "article", "main", "#root"):
                node.junk = True
    return " ".join(_page_blocks(root))


def _page_blocks(root: Node) -> list[str]:
    for wanted in ("article", "main", "body", "#root"):
        tops = _tops(root, wanted)
        if tops:
            break
    blocks: list[str] = []
    for top in tops:
        _blocks(top, blocks)
    return blocks


def _tops(root: Node, tag: str) -> list[Node]:
    """Outermost elements of a tag, in page order, outside dropped ones."""
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.junk:
            continue
        if node.tag == tag:
            found.append(node)
        else:
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]
    return found


def _blocks(top: Node, out: list[str]) -> None:
    """Appends the trimmed blocks under top. A page header goes, an article's own header stays."""
    parts: list[str] = []
    in_article = top.tag in ("article", "main")

    def flush() -> None:
        if text := " ".join("".join(parts).split()):
            out.append(text)
        parts.clear()

    todo: list[tuple[Node | str | None, bool]] = [(top, in_article)]
    while todo:
        node, inside = todo.pop()
        if node is None:
            flush()
        elif isinstance(node, str):
            parts.append(node)
        elif not node.junk and (inside or node.tag != "header"):
            block = node.tag in BLOCKS
            if block:
                flush()
                todo.append((None, inside))
            todo += [(c, inside) for c in reversed(node.children)]
    flush()


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The subtrees of each page with hashes of its text and, for blocks outside articles, of its longest block; a row without subtree stands for the page."""
    for b in batches:
        for host, page in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
            root = parse(page or "")
            blocks = _page_blocks(root)
            body, lead = (_signed(xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass"))) for t in (" ".join(blocks), max(blocks, key=len, default="")))
            seen = {(_signed(n.hash), inside, None if inside or n.tag not in BLOCKS else lead) for n, inside in hashed(root) if n.tag != "#root" and not n.junk}
            rows = [(None, None, None), *seen]
            yield pa.RecordBatch.from_arrays([pa.array([host] * len(rows), pa.string()), pa.array([h for h, _, _ in rows], pa.int64()), pa.array([i for _, i, _ in rows], pa.bool_()), pa.array([body] * len(rows), pa.int64()), pa.array([x for _, _, x in rows], pa.int64())], ["host", "subtree", "inside", "body", "lead"])


def templates(pages: DataFrame, url: str = "url", html: str = "html", min_pages: int = MIN_PAGES, share: float = SHARE, in_article_share: float = IN_ARTICLE_SHARE, many: int = MANY) -> DataFrame:
    """(host, outer, inner): hashes of the subtrees to delete outside and inside articles."""
    own = pages.select(host_of(F.col(url)).alias("host"), F.col(html).alias("html")).where("host <> ''")
    found = own.mapInArrow(_subtrees, "host string, subtree long, inside boolean, body long, lead long")
    counts = saved(found.groupBy("host", "subtree", "inside").agg(F.count_distinct("body").alias("n"), F.count_distinct("lead").alias("leads")).where((F.col("n") >= min_pages) | F.col("subtree").isNull()), "subtrees")
    totals = counts.where("subtree is null").select("host", F.col("n").alias("pages"))
    often = counts.where("subtree is not null").join(totals, "host").where((F.col("n") >= F.col("pages") * F.when(F.col("inside"), in_article_share).otherwise(share)) | (F.col("leads") >= many))
    return often.groupBy("host").agg(F.collect_list(F.when(~F.col("inside"), F.col("subtree"))).alias("outer"), F.collect_list(F.when(F.col("inside"), F.col("subtree"))).alias("inner"))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [main_text(page or "", frozenset(outer or ()), frozenset(inner or ())) for page, outer, inner in zip(*(b.column(c).to_pylist() for c in ("html", "outer", "inner")), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages."""
    found = saved(templates(pages, url, html), "templates")
    own = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host_of(F.col(url)).alias("host"))
    return own.join(found, "host", "left").select("page_id", "url", "html", "outer", "inner").mapInArrow(_texts, "page_id long, url string, text string, n_chars long")
