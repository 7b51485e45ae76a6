"""Main text of web pages, with site templates removed.

Every page is parsed once, into the lines of its main text, each with the hashes of the block elements that hold it. Spark counts on how
many different pages of a host each hash occurs; subtrees that recur on at least MIN_PAGES and MIN_SHARE of a host's pages
are the host's template, and lines in them go. The share is low, as a host may have many page templates. Elements
whose tag, role, class or id marks them as menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles or reader
comments are dropped in parsing. A class or id marks by itself (``sidebar``) or as a compound of marks and words of place
(``site-header``, ``ad-slot``); headings, paragraphs and inline elements need a mark by itself, and so do all elements inside an article or a main
element, where headers stay. The html isn't shuffled: templates go to the pages as a broadcast of bounded size, or
beyond that by host and page to the lines.

Defined results: null html gives an empty text; null or malformed URLs have no host, so only marks count; equal
pages of a host count as one, so copies don't make a template; repeated rows give repeated results; an empty table
gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, table
from .url_filters import host_of

MIN_PAGES, MIN_SHARE, BROADCAST = 10, 0.1, 1 << 20  # the most template hashes to be broadcast; with 0.05, repeated lines of articles would go, too

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "caption", "thead", "tbody", "tfoot", "tr", "td", "th", "ul"}
CLOSES_P = BLOCK - {"body", "html", "option", "td", "th", "tr", "thead", "tbody", "tfoot", "caption"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
DROPPED = {"nav", "footer", "aside", "form", "script", "style", "noscript", "iframe", "template", "button", "select", "textarea", "svg", "canvas", "object", "audio", "video", "head", "title", "dialog", "menu", "noembed", "noframes", "applet"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
MARKS = {"ad", "ads", "adbox", "adslot", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "sidebar", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "footer", "header", "masthead", "topbar", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "popup", "modal", "overlay", "newsletter", "subscribe", "comment", "comments", "disqus", "respond", "replies", "share", "sharing", "social", "related", "recommended", "widget", "toolbar", "pagination", "pager", "disclaimer"}
PLACES = {"site", "page", "main", "global", "top", "bottom", "left", "right", "upper", "lower", "inner", "outer", "primary", "secondary", "bar", "box", "area", "list", "wrap", "wrapper", "container", "content", "slot", "unit", "links", "buttons", "posts", "articles", "form", "thread", "block"}
OWN = {"header", "masthead", "banner"}  # an article's own
PLAIN = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "span", "a", "b", "i", "em", "strong", "small", "td", "th", "dt", "dd", "blockquote", "pre", "code", "figcaption", "caption", "font", "u", "mark", "q", "cite"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
KEPT = {"html", "body", "main", "article"}


class Node:
    __slots__ = ("digest", "drop", "holds", "main", "parts", "tag")

    def __init__(self, tag: str, drop: bool, main: bool):
        self.tag, self.drop, self.main, self.holds, self.parts, self.digest = tag, drop, main, main, [], 0


def _attributes(text: str) -> dict[str, str]:
    """By lower-case name; the first of a name counts."""
    out: dict[str, str] = {}
    if text and not text.isspace():
        for name, a, b, c in ATTR.findall(text):
            out.setdefault(name.lower(), entities.unescape(a or b or c))
    return out


def _names(attrs: dict[str, str]) -> list[str]:
    return f"{attrs.get('class', '')} {attrs.get('id', '')}".split()


def _marked(tag: str, attrs: dict[str, str], inside: bool) -> bool:
    """Whether an element is none of the main text; ``inside``: whether an article or main element holds it."""
    if tag in DROPPED:
        return True
    if not attrs or tag in ("html", "body", "main"):
        return False
    if tag == "article":
        return "hidden" in attrs or any({"comment", "comments"} & set(re.split(r"[_-]+", name.lower())) for name in _names(attrs))
    role = attrs.get("role", "").lower()
    if role in ROLES and not (inside and role == "banner") or "hidden" in attrs:
        return True
    for name in _names(attrs):
        parts = re.split(r"[_-]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower())
        if name.lower() in MARKS or len(parts) == 1 and parts[0] in MARKS:
            if not (inside and name.lower() in OWN):
                return True
        elif tag not in PLAIN and len(parts) > 1 and (marks := MARKS.intersection(parts) - (OWN if inside else set())) and all(x in MARKS or x in PLACES or x.isdigit() for x in parts) and (not inside or marks):
            return True
    return False


def parse(page: str) -> Node:
    """A tree of the page. Unknown or unclosed elements close with what holds them; nothing recurses."""
    import xxhash

    root = Node("#root", False, False)
    stack, at, size = [root], 0, len(page)
    open_tags: dict[str, int] = {}
    any_main = [0]  # articles and main elements that are open

    def close(depth: int) -> None:
        while len(stack) > depth:
            node = stack.pop()
            open_tags[node.tag] -= 1
            any_main[0] -= node.main
            stack[-1].holds |= node.holds
            node.digest = xxhash.xxh3_64_intdigest("\x01".join([node.tag, *(f"\x02{x.digest}" if isinstance(x, Node) else " ".join(x.split()) for x in node.parts)]))

    def find(tags: set[str], scope: set[str]) -> int:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                return i
            if stack[i].tag in scope:
                return 0
        return 0

    while at < size:
        m = TAG.search(page, at)
        if not m:
            stack[-1].parts.append(entities.unescape(page[at:]))
            break
        if m.start() > at:
            stack[-1].parts.append(entities.unescape(page[at : m.start()]))
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if open_tags.get(tag) and (i := find({tag}, set())):
                close(i)
            elif tag == "br":
                stack[-1].parts.append("\n")
            continue
        attrs = _attributes(m[3] or m[6])
        if tag in CLOSES_P and open_tags.get("p") and (i := find({"p"}, {"table", "button", "td", "th"})):
            close(i)
        if tag in CLOSES and (i := find(CLOSES[tag], SCOPES[tag])):
            close(i)
        if tag == "br":
            stack[-1].parts.append("\n")
            continue
        drop = _marked(tag, attrs, any_main[0] > 0)
        node = Node(tag, drop, not (drop and tag == "article") and (tag in ("article", "main") or attrs.get("role", "").lower() == "main" or attrs.get("itemprop", "").lower() == "articlebody"))
        stack[-1].parts.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        stack.append(node)
        open_tags[tag] = open_tags.get(tag, 0) + 1
        any_main[0] += node.main
    close(1)
    return root


def _gone(x: Node) -> bool:
    return x.drop and not (x.holds and x.tag not in DROPPED)


def _tops(root: Node) -> tuple[list[Node], bool]:
    """(the elements that hold the main text, in page order; whether these are articles or main elements).

    They are the outermost articles, each main element's headings before its first article with them; else the outermost main elements; else the page.
    """
    articles: list[Node] = []
    mains: list[Node] = []
    waiting: list[Node] = []  # headings of the main element at hand, until its first article
    first = None
    todo: list[tuple[Node | None, Node | None]] = [(root, None)]
    while todo:
        x, main = todo.pop()
        if x.tag == "article" and x.main:
            articles += [*waiting, x]
            waiting, first = [], main
            continue
        if main is not None and x.tag in HEADINGS and main is not first:
            waiting.append(x)
            continue
        if x.main and main is None:
            mains.append(x)
            waiting, main = [], x
        if x.holds or main is not None:
            todo.extend((y, main) for y in reversed(x.parts) if isinstance(y, Node) and not _gone(y) and (main is not None or not (y.tag == "header" and not y.holds)))
    chosen = articles or mains
    return chosen or [root], bool(chosen)


def lines(root: Node) -> list[tuple[str, list[int]]]:
    """The main text's blocks, white space turned to one space, each with the signed hashes of the elements that hold it and may be of a template."""
    tops, within = _tops(root)
    out: list[tuple[str, list[int]]] = []
    held: list[str] = []
    chain: list[int] = []

    def flush() -> None:
        if line := " ".join("".join(held).split()):
            out.append((line, [x - (1 << 64) if x >> 63 else x for x in chain]))
        held.clear()

    for top in tops:
        walk: list = [(top, False)]
        while walk:
            x, ended = walk.pop()
            if isinstance(x, str):
                held.append(x)
                continue
            block = x.tag in BLOCK
            if block:
                flush()
            may = block and not x.holds and x.tag not in KEPT
            if ended:
                if may:
                    chain.pop()
                continue
            if x is not top and (_gone(x) or (x.tag == "header" and not within)):
                continue
            if may:
                chain.append(x.digest)
            walk.append((x, True))
            walk.extend((y, False) for y in reversed(x.parts))
        flush()
    return out


def main_text(root: Node, template: frozenset[int] = frozenset()) -> str:
    """The lines outside of a template, joined by spaces."""
    return " ".join(line for line, chain in lines(root) if not template.intersection(chain))


LINES = "array<struct<line:string,chain:array<long>>>"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("line", pa.string()), ("chain", pa.list_(pa.int64()))]))
    for batch in batches:
        found = [[{"line": line, "chain": chain} for line, chain in lines(parse(x or ""))] for x in batch.column(4).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(found, kind)], ["page_id", "url", "host", "page", "lines"])


def page_lines(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, page, lines), written once; ``page`` is a hash of the html."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), host_of(F.col("url")).alias("host"), F.xxhash64("html").alias("page"), "html")
    return materialize(rows.mapInArrow(_read, f"page_id long, url string, host string, page long, lines {LINES}"), "lines", "zstd")


def site_templates(read: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, hash) of subtrees that recur on enough of their host's different pages."""
    rows = read.filter("host is not null")
    seen = rows.select("host", "page", F.explode(F.array_distinct(F.flatten("lines.chain"))).alias("hash")).distinct()
    found = seen.groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_pages)
    sizes = rows.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages")).filter(F.col("pages") >= min_pages)
    return found.join(sizes, "host").filter(F.col("n") >= min_share * F.col("pages")).select("host", "hash")


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    bounded_batches(pages.sparkSession)
    read = page_lines(pages)
    templates = materialize(site_templates(read, min_pages, min_share), "templates")
    if templates.count() <= BROADCAST:
        rows = read.join(F.broadcast(templates.groupBy("host").agg(F.collect_list("hash").alias("template"))), "host", "left")
    else:
        own = read.filter("host is not null").select("host", "page", F.explode(F.array_distinct(F.flatten("lines.chain"))).alias("hash")).distinct()
        rows = read.join(own.join(templates, ["host", "hash"]).groupBy("host", "page").agg(F.collect_list("hash").alias("template")), ["host", "page"], "left")
    text = F.when(F.col("template").isNull(), F.array_join("lines.line", " ")).otherwise(F.expr("array_join(transform(filter(lines, x -> not arrays_overlap(x.chain, template)), x -> x.line), ' ')"))
    return rows.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


#: For pages whose article is one element without inner boilerplate, as in the synthetic table.
OP9_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS x FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(x, '</?(p|h1|br)>', ' ', 'g'), '<[^>]*>', '', 'g') AS x FROM a),
c AS (SELECT page_id, url, trim(regexp_replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM b)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM c
"""
