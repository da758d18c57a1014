"""Web pages: HTML to structured text, tables, links, and breadth-first traversal."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import reduce
from html.parser import HTMLParser
from urllib.parse import quote, urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalex.functions import urls
from stratalex.functions.text import page_formulas
from stratalex.operators.order import with_sum_before
from stratalex.sources.scratch import Scratch, written

# What is removed, and where the main text is looked for.
DROP_TAGS = {"script", "style", "nav", "footer", "header", "aside", "noscript", "iframe"}
DROP_CLASSES = {"nav", "navbar", "sidebar", "footer", "header", "menu", "advertisement", "ad", "comment", "comments"}
MAIN_TAGS = {"article", "main"}
MAIN_CLASSES = {"content", "post-content", "post-body", "entry-content", "article-content", "markdown-body", "doc-content"}
MAIN_IDS = {"content", "main", "article"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
LONGEST = 50_000
# Fixed value: what stands at the end of a text that was cut.
CUT = "\n\n... [内容过长已截断]"


class Node:
    """An element: tag, attributes, children (elements and texts)."""

    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.kids = tag, attrs, []

    def elements(self) -> list[Node]:
        return [k for k in self.kids if isinstance(k, Node)]

    def text(self) -> str:
        out, todo = [], self.kids[::-1]
        while todo:
            k = todo.pop()
            if not isinstance(k, Node):
                out.append(k)
            elif k.tag == "br":
                out.append("\n")
            else:
                todo.extend(reversed(k.kids))
        return "".join(out)

    def find(self, wanted) -> Iterator[Node]:
        """Elements below, in page order."""
        todo = self.elements()[::-1]
        while todo:
            k = todo.pop()
            if wanted(k):
                yield k
            todo.extend(reversed(k.elements()))


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {})
        self.stack, self.open = [self.root], Counter()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        closes = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}}.get(tag, {"p"} if tag in ("div", "ul", "ol", "table", "section", "article", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6") else set())
        while len(self.stack) > 1 and closes and any(n.tag in closes for n in self.stack[-3:]):
            self.open[self.stack.pop().tag] -= 1
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.stack[-1].kids.append(node)
        if tag not in VOID:
            self.stack.append(node)
            self.open[tag] += 1

    def handle_endtag(self, tag: str) -> None:
        ended = not self.open[tag]
        while not ended:
            last = self.stack.pop().tag
            self.open[last] -= 1
            ended = last == tag

    def handle_data(self, data: str) -> None:
        self.stack[-1].kids.append(data)


def parse(html: str) -> Node:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def _classes(n: Node) -> set[str]:
    return set(n.attrs.get("class", "").split())


def _clean(root: Node) -> None:
    dropped = lambda k: isinstance(k, Node) and (k.tag in DROP_TAGS or not DROP_CLASSES.isdisjoint(_classes(k)) or k.attrs.get("role") == "navigation")
    todo = [root]
    while todo:
        n = todo.pop()
        n.kids = [k for k in n.kids if not dropped(k)]
        todo.extend(n.elements())


def _table(table: Node) -> str:
    out, head = "\n", False
    for row in table.find(lambda k: k.tag == "tr"):
        cells = list(row.find(lambda k: k.tag in ("th", "td")))
        if cells:
            out += "|" + "".join(f" {c.text().strip()} |" for c in cells) + "\n"
            if not head:
                out += "|" + " --- |" * len(cells) + "\n"
                head = True
    return out + "\n" if head else ""


def _render(root: Node, out: list[str]) -> None:
    todo = root.elements()[::-1]
    while todo:
        k = todo.pop()
        t = k.tag
        if re.fullmatch("h[1-6]", t):
            out.append(f"\n{'#' * int(t[1])} {k.text().strip()}\n\n")
        elif t == "p":
            out.append(k.text().strip() + "\n\n")
        elif t == "li":
            out.append(f"- {k.text().strip()}\n")
        elif t == "br":
            out.append("\n")
        elif t == "pre":
            out.append(f"```\n{k.text()}\n```\n\n")
        elif t == "code":
            out.append(f"`{k.text()}`")
        elif t == "table":
            out.append(_table(k))
        elif t == "img":
            out.append(f"[图: {k.attrs['alt'].strip()}]\n\n" if k.attrs.get("alt", "").strip() else "")
        elif t == "blockquote":
            out.append("".join(f"> {x.strip()}\n" for x in k.text().strip().split("\n")) + "\n")
        elif t == "hr":
            out.append("---\n\n")
        elif t in ("math", "annotation"):
            out.append(k.text() + "\n")
        elif inner := k.elements():
            todo.extend(reversed(inner))
        elif k.text().strip():
            out.append(k.text().strip() + "\n\n")


def _text(root: Node) -> str:
    """Markdown-like text of a cleaned page's main part; own text beside child elements is left out."""
    body = next(root.find(lambda k: k.tag == "body"), root)
    main = lambda k: k.tag in MAIN_TAGS or k.attrs.get("role") == "main" or not MAIN_CLASSES.isdisjoint(_classes(k)) or k.attrs.get("id") in MAIN_IDS
    title = next(root.find(lambda k: k.tag == "title"), None)
    out = [f"# {title.text().strip()}\n\n"] if title is not None and title.text().strip() else []
    _render(next(body.find(main), body), out)
    text = re.sub("\n{4,}", "\n\n\n", "".join(out))
    text = page_formulas(re.sub("[ \t]{2,}", " ", text))
    return (text[:LONGEST] + CUT if len(text) > LONGEST else text).strip()


def _links(root: Node, url: str | None) -> list[str]:
    return [urljoin(url or "", a.attrs["href"].strip()) for a in root.find(lambda k: k.tag == "a" and "href" in k.attrs)]


def page(url: str | None, html: str | None, columns: Sequence[str] = ("text", "tables", "links"), kept_links_only: bool = True) -> dict:
    """What is asked for of a page, from one parse.

    text: of the main part, empty without a page; tables: all, as text; links: absolute
    targets, with ``kept_links_only`` of those left once menus and the like are gone.
    """
    root, out = parse(html or ""), {}
    if "tables" in columns:
        out["tables"] = [_table(t).strip("\n") for t in root.find(lambda k: k.tag == "table")]
    if "links" in columns and not kept_links_only:
        out["links"] = _links(root, url)
    if "text" in columns or ("links" in columns and kept_links_only):
        _clean(root)
    if "links" in columns and kept_links_only:
        out["links"] = _links(root, url)
    if "text" in columns:
        out["text"] = _text(root) if html else ""
    return out


def page_text(html: str | None) -> str:
    return page(None, html, ["text"])["text"]


def resolve_redirect(url: str, location: str) -> str:
    """Target of a redirect, relative or not, with spaces and non-ASCII escaped."""
    return quote(urljoin(url, location), safe="%/:?#[]@!$&'()*+,;=~-._")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", kept_links_only: bool = True, columns: Sequence[str] = ("text", "tables", "links")) -> DataFrame:
    """For each page: id, url and, of text, tables and links, what is asked for, from one parse."""
    kinds = {"text": ("string", pa.string()), "tables": ("array<string>", pa.list_(pa.string())), "links": ("array<string>", pa.list_(pa.string()))}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [page(u, h, columns, kept_links_only) for u, h in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([f[c] for f in found], kinds[c][1]) for c in columns)], ["page_id", "url", *columns])

    rows = pages.select(F.col(id_col).cast("long"), F.col(url_col), F.col(html_col))
    return rows.mapInArrow(read, ", ".join(["page_id long, url string", *(f"{c} {kinds[c][0]}" for c in columns)]))


def edges_of(extracted: DataFrame) -> DataFrame:
    links = extracted.select(urls.normalise(F.col("url")).alias("src"), F.explode("links").alias("l"))
    return links.select("src", urls.normalise(F.col("l")).alias("dst")).where("dst IS NOT NULL").distinct()


def bfs(edges: DataFrame, seeds: Sequence[str], depth: int = 2, words: Sequence[str] = (), domains: Sequence[str] = (), most: int | None = None) -> DataFrame:
    """url, depth: what is reached from the seeds, each page at its least depth.

    One join for each level; the frontier is written between levels, so a lost executor
    costs no more than its own level.  With ``most`` the crawl ends with that many pages,
    the nearest first and by URL among the equally near.
    """
    spark = edges.sparkSession
    start = spark.createDataFrame([(s,) for s in seeds], "url string").select(urls.normalise(F.col("url")).alias("url")).where("url IS NOT NULL").distinct().withColumn("depth", F.lit(0))
    seen, frontier = start, start
    links = edges.where(urls.in_paths(F.col("dst"), words))
    for level in range(1, depth + 1):
        if most is not None and seen.count() >= most:
            break
        ahead = frontier.where(urls.in_domains(F.col("url"), domains)).select(F.col("url").alias("src"))
        new = links.join(ahead, "src", "left_semi").select(F.col("dst").alias("url")).distinct().join(seen, "url", "left_anti").withColumn("depth", F.lit(level))
        frontier = written(new, "frontier")
        seen = seen.unionByName(frontier)
    return seen if most is None else seen.orderBy("depth", "url").limit(most)


def first_pages(extracted: DataFrame) -> DataFrame:
    """url, text, links: of pages (page_id, url, text, links) with one normal URL the first."""
    known = extracted.select("page_id", urls.normalise(F.col("url")).alias("url"), "text", "links").where("url IS NOT NULL")
    first = known.groupBy("url").agg(F.min("page_id").alias("page_id"))
    return known.join(first, ["url", "page_id"], "left_semi").dropDuplicates(["url"]).drop("page_id")


def crawl(pages: DataFrame, seeds: Sequence[str], most: int, depth: int = 2, words: Sequence[str] = (), domains: Sequence[str] | None = None, least: int = 200) -> DataFrame:
    """url, depth, place, status of each page that a breadth-first queue hands out until ``most`` pages are indexed.

    ``pages``: url (in normal form, each once), text, links in page order.  A page is indexed
    if its text has ``least`` characters and is not that of a page before it; else it is
    short or duplicate, or outside (no domain of the list, by default the seeds' hosts), or
    failed (not among the pages).  Links count once, at their first place, and must fit
    ``words``; those of short and duplicate pages are followed too.

    The queue is kept level by level, in order of (the parent's place, the link's place), so
    it is that of one worker, and each level is a join.  A level is written, so a lost
    executor costs no more than that.
    """
    spark = pages.sparkSession
    start = spark.createDataFrame([(i, s) for i, s in enumerate(seeds)], "seq long, url string").select("seq", urls.normalise(F.col("url")).alias("url"))
    queue = start.where("url IS NOT NULL").groupBy("url").agg(F.min("seq").alias("seq"))
    if domains is None:
        domains = sorted({r["h"] for r in queue.select(urls.host(F.col("url")).alias("h")).collect()})  # a few seeds
    facts = pages.select("url", F.length(F.coalesce("text", F.lit(""))).alias("n"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"), "links")
    known, texts, out, indexed = queue.select("url"), None, [], 0
    with Scratch(spark, "crawl") as scratch:
        facts = scratch.written(facts, "facts")  # no texts, so a level reads lengths, hashes and links
        for level in range(depth + 1):
            inside = urls.in_domains(F.col("url"), domains)
            met = scratch.written(queue.join(facts, "url", "left").withColumn("inside", inside), "level")
            fit = met.where(F.col("inside") & (F.col("n") >= least)).groupBy("hash").agg(F.min("seq").alias("seq"))
            fit = fit if texts is None else fit.join(texts, "hash", "left_anti")
            fit = scratch.written(fit, "indexed")
            status = F.when(~F.col("inside"), "outside").when(F.col("n").isNull(), "failed").when(F.col("_first"), "indexed").when(F.col("n") < least, "short").otherwise("duplicate")
            told = met.join(fit.select("seq", F.lit(True).alias("_first")), "seq", "left").select("url", F.lit(level).alias("depth"), "seq", status.alias("status"))
            found = fit.count()
            if indexed + found >= most:
                last = fit.orderBy("seq").limit(most - indexed).agg(F.max("seq")).first()[0]  # at most ``most`` rows
                out.append(told.where(F.col("seq") <= F.lit(-1 if last is None else last)))
                break
            out.append(told)
            indexed += found
            texts = fit.select("hash") if texts is None else scratch.written(texts.unionByName(fit.select("hash")), "texts")
            if level == depth:
                break
            ahead = met.where(F.col("inside") & F.col("n").isNotNull()).select("seq", F.posexplode("links").alias("place", "link"))
            ahead = ahead.select(F.struct("seq", "place").alias("at"), urls.normalise(F.col("link")).alias("url")).where(F.col("url").isNotNull() & urls.in_paths(F.col("url"), words))
            new = ahead.groupBy("url").agg(F.min("at").alias("at")).join(known, "url", "left_anti")
            queue = scratch.written(new.repartitionByRange("at").sortWithinPartitions("at").select("url", F.monotonically_increasing_id().alias("seq")), "queue")
            if queue.isEmpty():
                break
            known = known.unionByName(queue.select("url"))
        told = scratch.written(reduce(DataFrame.unionByName, out), "told")
        placed = with_sum_before(told, "depth", ["seq"], F.lit(1), "place")
        return written(placed.select("url", "depth", "place", "status"), "crawl")
