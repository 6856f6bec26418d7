"""HTML extraction by site template removal.

Method. A page is parsed into a tree and every element subtree hashed (tag, class, text and children).
Spark counts for each host on how many distinct pages a subtree stands; one that recurs on at least
``min_pages`` pages and ``min_share`` of the host's pages is the site's template and is deleted. Pages of a
host whose text (before template is deleted) is equal are one page in both numbers, whatever their urls:
copies of an article do not make a template of it.
What is boilerplate by its element (nav, aside, footer, form, script, ...) or by a word of its class,
id or role (menu, sidebar, cookie, comments, ad, ...) is deleted on every page, recurring or not. Inside an
article, and for running text and articles anywhere, ids say nothing and only a whole class or role counts
(``ad``, not ``share-price``); there ``math``, ``object``, ``map`` and ``button`` stay. Of the rest the article (``article``, ``main`` or role main; else the whole body) is the text. Blocks of
running text inside the article (headings, paragraphs, list items, ...) are never template: the
same article on many pages of a host, or a license line in many articles, is content.

Distinct (host, subtree, text) are counted by (host, subtree) with partial sums, so a host with a third of all pages is no hot
task. The template goes to the tasks when it has at most ``BROADCAST_SUBTREES`` rows; beyond that it meets the
pages as rows (page, subtree), gathered by page.

Cases. Null html: empty text. Null or odd url: host is empty. Unclosed, crossed or cut-off tags are
closed as a browser would in the common cases. Repeated rows count as one page. A page without text has an
empty text. ``br`` is white space. Other columns pass through unless they bear the name of a result.
"""

from __future__ import annotations

import hashlib
import html as _html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import column, keep, read

MIN_PAGES = 5
MIN_SHARE = 0.2
#: Template subtrees (16 bytes each) that are sent to the tasks; beyond that they meet the pages by a join.
BROADCAST_SUBTREES = 200_000

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?")
_SPACE = re.compile(r"\s+")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption",
         "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre",
         "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
RUNNING = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "pre", "blockquote", "li", "dd", "dt", "td", "th", "figcaption", "summary", "address"}
DROP = {"nav", "aside", "footer", "form", "script", "style", "noscript", "template", "iframe", "head", "title", "svg", "math", "object", "embed",
        "button", "select", "textarea", "input", "dialog", "menu", "canvas", "audio", "video", "map"}
DROP_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "menu", "nav", "navbar",
              "navigation", "breadcrumb", "breadcrumbs", "sidebar", "footer", "cookie", "cookies", "consent", "gdpr", "banner", "notice",
              "notices", "popup", "modal", "overlay", "comment", "comments", "reply", "replies", "disqus", "respond", "share", "sharing", "social",
              "related", "recommended", "newsletter", "subscribe", "subscription", "signup", "login", "search", "widget", "pagination", "pager",
              "masthead", "topbar", "toolbar", "disclaimer", "complementary", "contentinfo", "hidden"}
#: Dropped outside an article only.
PAGE_DROP = {"math", "object", "map", "button"}
COMMENT_WORDS = {"comment", "comments", "reply", "replies", "disqus"}
#: Open elements that end when one of these begins.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "thead": {"tr", "td", "th"}}
_ENDS_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot"}
_SCOPE = {"table", "body", "html", "article", "section", "main", "div", "aside", "nav", "footer", "header", "ul", "ol", "td", "th", "form"}


class Node:
    __slots__ = ("tag", "words", "children", "mark", "hidden", "names", "digest", "holds")

    def __init__(self, tag: str, words: str = "", hidden: bool = False, names: str = ""):
        self.tag, self.words, self.children, self.mark, self.hidden, self.names = tag, words, [], 0, hidden, names
        self.digest, self.holds = b"", False


class _Open:
    """The open elements of a page, and where each tag is among them: ending one looks at no others."""

    def __init__(self, root: Node):
        self.stack = [root]
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def last(self, tags) -> int:
        """The innermost open element with one of ``tags``; 0 without any."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def cut(self, at: int) -> None:
        """End the element at ``at`` and all inside it."""
        while len(self.stack) > at:
            tag = self.stack.pop().tag
            self.places[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()

    def imply(self, tag: str) -> None:
        """End what a new element ends: an open paragraph, list item, row or cell in its scope."""
        ends = CLOSES.get(tag, set())
        tags = ends | {"p"} if tag in _ENDS_P else ends
        while tags:
            at = self.last(tags)
            if not at or any(self.places[t][-1] > at for t in _SCOPE if t not in ends and self.places.get(t)):
                return
            self.cut(at)
            if not ends:
                return

    def close(self, tag: str) -> None:
        at = self.last((tag,))
        if at and (tag in BLOCK or not self.blocks or self.blocks[-1] < at):  # a stray inline end tag does not close a block
            self.cut(at)


def parse(text: str) -> Node:
    """Tree of a page; text is kept as strings among the children, with references decoded."""
    root = Node("#root")
    open_ = _Open(root)
    at = 0
    while True:
        m = _TOKEN.search(text, at)
        end = m.start() if m else len(text)
        if end > at:
            open_.stack[-1].children.append(_html.unescape(text[at:end]))
        if not m:
            return root
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            open_.close(tag)
            continue
        open_.imply(tag)
        attrs = {a[1].lower(): a[2] or a[3] or a[4] or "" for a in _ATTR.finditer(m[3])} if m[3] else {}
        words = " ".join(attrs.get(k, "") for k in ("class", "id", "role")).lower().strip()
        hidden = "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower()
        node = Node(tag, words, hidden, f"{attrs.get('class', '')} {attrs.get('role', '')}".lower() if words else "")
        open_.stack[-1].children.append(node)
        if tag in VOID or m[3].rstrip().endswith("/") and tag in ("svg", "path"):
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(text, at)
            node.children.append(text[at : close.start() if close else len(text)])
            at = close.end() if close else len(text)
            continue
        open_.push(node)


def _elements(node: Node) -> list[Node]:
    return [c for c in node.children if not isinstance(c, str)]


def _boiler(node: Node, inside: bool) -> bool:
    if node.hidden or (node.tag in DROP and not (inside and node.tag in PAGE_DROP)):
        return True
    if node.words and node.tag not in ("html", "body"):
        if _is_main(node):
            return not COMMENT_WORDS.isdisjoint(node.names.split())
        if inside or node.tag in RUNNING:
            return not DROP_WORDS.isdisjoint(node.names.split())
        return not DROP_WORDS.isdisjoint(re.split(r"[^a-z0-9]+", node.words))
    return False


def _header(node: Node) -> bool:
    return node.tag == "header" or bool(node.words) and "header" in re.split(r"[^a-z0-9]+", node.words)


def _is_main(node: Node) -> bool:
    return node.tag in ("article", "main") or "main" in node.words.split()


def prune(root: Node) -> Node:
    """Delete boilerplate by element and by word; page headers go, an article's own header stays."""
    todo = [(root, False)]
    while todo:
        node, inside = todo.pop()
        inside = inside or _is_main(node)
        node.children = [c for c in node.children if isinstance(c, str) or not (_boiler(c, inside) or (not inside and not _is_main(c) and _header(c)))]
        todo += [(c, inside) for c in _elements(node)]
    return root


def mark_subtrees(root: Node) -> list[int]:
    """Hash every element subtree (into ``mark``); the hashes that may be template."""
    out: list[int] = []
    order: list[tuple[Node, bool, bool]] = []
    todo = [(root, False, False)]
    while todo:  # parents before children
        node, running, inside = todo.pop()
        running = running or (inside and node.tag in RUNNING)
        inside = inside or _is_main(node)
        order.append((node, running, inside))
        todo += [(c, running, inside) for c in _elements(node)]
    for node, running, inside in reversed(order):
        h = hashlib.blake2b(f"{node.tag} {node.words}".encode("utf-8", "surrogatepass"), digest_size=8)
        text = node.holds = False
        for c in node.children:
            if isinstance(c, str):
                s = _SPACE.sub(" ", c).strip()
                if s:
                    h.update(b"\0" + s.encode("utf-8", "surrogatepass"))
                    text = True
            else:
                h.update(b"\1" + c.digest)
                text = text or c.mark != 0
                node.holds = node.holds or c.holds or c.tag in RUNNING
        node.digest = h.digest()
        node.mark = int.from_bytes(node.digest, "little", signed=True) if text else 0
        if node.mark and not running and not _is_main(node) and node.tag not in ("#root", "html", "body"):
            if not inside or not node.holds:
                out.append(node.mark)
    return out


def main_text(root: Node, template: set[int]) -> str:
    """Blocks of the article in page order, without template subtrees, joined by an empty line."""
    mains: list[Node] = []
    todo = [root]
    while todo:
        node = todo.pop()
        if _is_main(node):
            mains.append(node)
        else:
            todo += reversed(_elements(node))
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        s = _SPACE.sub(" ", "".join(line)).strip()
        line.clear()
        if s:
            blocks.append(s)

    for article in mains or [root]:
        steps: list = [(article, False)]  # elements to enter, texts, and None where a block ends
        while steps:
            step = steps.pop()
            if step is None:
                flush()
            elif isinstance(step, str):
                line.append(step)
            else:
                node, running = step
                running = running or node.tag in RUNNING
                if node.tag in BLOCK or node.tag == "#root":
                    flush()
                    steps.append(None)
                for c in reversed(node.children):
                    if isinstance(c, str):
                        steps.append(c)
                    elif c.tag == "br":
                        steps.append(" ")
                    elif running or c.mark == 0 or c.mark not in template or _is_main(c):
                        steps.append((c, running))
        flush()
    return "\n\n".join(blocks)


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE,
            broadcast_subtrees: int = BROADCAST_SUBTREES) -> DataFrame:
    """``pages`` (page_id, url, html, more) with ``text`` and ``n_chars``, less ``html``."""
    own = pages.drop(*[c for c in pages.columns if c.lower() in ("text", "n_chars")])
    url, body = column(own, "url", "string"), column(own, "html", "string")
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    framed = own.withColumns({"__host": F.xxhash64(host), "__html": body, "__key": F.xxhash64(column(own, "page_id", "string"), url, body)})

    def subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                marks, page = [], []
                for t in part.column("__html").to_pylist():
                    root = prune(parse(t or ""))
                    # 0 stands for the page itself
                    marks.append(np.unique(np.array([0, *mark_subtrees(root)], np.int64)))
                    page.append(int.from_bytes(hashlib.blake2b(main_text(root, set()).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True))
                size = [len(m) for m in marks]
                row = np.repeat(np.arange(part.num_rows), size)
                flat = np.concatenate(marks) if marks else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([part.column("__host").take(pa.array(row)), part.column("__key").take(pa.array(row)),
                                                  pa.array(np.array(page, np.int64)[row]), pa.array(flat)], names=["host", "key", "page", "mark"])

    marks = framed.select("__host", "__html", "__key").mapInArrow(subtrees, "host long, key long, page long, mark long")
    counted = marks.select("host", "mark", "page").distinct().groupBy("host", "mark").agg(F.count("*").alias("n"))
    counted = keep(counted.where((F.col("mark") == 0) | (F.col("n") >= min_pages)), "counted")
    total = counted.where("mark = 0").select("host", F.col("n").alias("pages"))
    often = counted.where("mark <> 0")
    template = often.join(total, "host").where(F.col("n") >= F.col("pages") * F.lit(min_share)).select("host", "mark")
    template = keep(template, "template")
    by_host: dict[int, set[int]] | None = None
    if template.count() <= broadcast_subtrees:
        by_host = {}
        for r in template.collect():
            by_host.setdefault(r["host"], set()).add(r["mark"])
        joined = framed.withColumn("__marks", F.lit(None).cast("array<long>"))
    else:
        found = marks.join(template, ["host", "mark"]).groupBy("key").agg(F.collect_set("mark").alias("__marks"))
        joined = framed.join(found, framed["__key"] == found["key"], "left").drop("key")
    shipped = pages.sparkSession.sparkContext.broadcast(by_host)
    joined = joined.drop("__key")
    kept = [c for c in own.columns if c.lower() != "html"]
    schema = T.StructType([*own.select(*[F.col(f"`{c}`") for c in kept]).schema.fields, T.StructField("text", T.StringType())])
    names = schema.names
    index = [joined.columns.index(c) for c in kept]

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hosts = shipped.value
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                out = []
                for t, host, own_marks in zip(*(part.column(c).to_pylist() for c in ("__html", "__host", "__marks")), strict=True):
                    root = prune(parse(t or ""))
                    if hosts is not None:
                        own_marks = hosts.get(host)
                    if own_marks:
                        mark_subtrees(root)
                    out.append(main_text(root, set(own_marks or ())))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in index), pa.array(out, pa.string())], names=names)

    return joined.mapInArrow(texts, schema).withColumn("n_chars", F.length("text").cast("long"))


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page of ``pages`` with its main text."""
    return extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
