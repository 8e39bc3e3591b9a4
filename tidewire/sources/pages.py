"""Pages, feeds and sitemaps as sources: rows of fetched text become rows of their contents.

Fetching is outside the engine; what was fetched lands in a table (url, html). Parsing runs in Arrow batches with
the standard library's parsers.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements whose text is never shown, and roots and blocks of main content.
HIDDEN = frozenset(("script", "style", "noscript", "template", "svg", "canvas"))
ASIDE = frozenset(("nav", "footer", "aside", "header", "form", "figure"))
ROOTS = frozenset(("article", "main"))
BLOCKS = frozenset(("p", "h2", "h3", "li"))
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_SPACE = re.compile(r"\s+")


class _Reader(HTMLParser):
    """roots: names of elements, or class names with a dot before them, in which the report stands."""

    def __init__(self, roots: frozenset = ROOTS):
        super().__init__(convert_charrefs=True)
        self.roots, self.rooted = roots, []
        self.open: list[str] = []
        self.meta: dict[str, str] = {}
        self.title, self.text, self.blocks, self.links, self.data = [], [], [], [], []
        self.block: list[str] | None = None
        self.link: list | None = None
        self.canonical = ""

    def handle_starttag(self, tag, attrs):
        at = {k: v or "" for k, v in attrs}
        if tag == "meta":
            key = (at.get("property") or at.get("name") or at.get("itemprop") or "").lower()
            if key and at.get("content"):
                self.meta.setdefault(key, at["content"].strip())
        elif tag == "link" and at.get("href"):
            self.links.append([at["href"], "", at.get("rel", "").lower()])
            if at.get("rel", "").lower() == "canonical":
                self.canonical = at["href"]
        if tag in VOID:
            return
        named = {f".{x}" for x in at.get("class", "").split()}
        self.rooted.append(tag in self.roots or bool(self.roots & named))
        self.open.append("ld+json" if tag == "script" and at.get("type", "").lower() == "application/ld+json" else tag)
        if tag == "a" and at.get("href"):
            self.link = [at["href"], "", "a"]
        if tag in BLOCKS and any(self.rooted) and not ASIDE.intersection(self.open):
            self.block = []

    def handle_endtag(self, tag):
        if tag == "a" and self.link:
            self.link[1] = _SPACE.sub(" ", self.link[1]).strip()
            self.links.append(self.link)
            self.link = None
        if tag in BLOCKS and self.block is not None:
            line = _SPACE.sub(" ", "".join(self.block)).strip()
            if line:
                self.blocks.append(line)
            self.block = None
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k] == tag or (tag == "script" and self.open[k] == "ld+json"):
                del self.open[k:], self.rooted[k:]
                break

    def handle_data(self, data):
        if "ld+json" in self.open:
            self.data.append(data)
        if HIDDEN.intersection(self.open) or "ld+json" in self.open:
            return
        if self.open[-1:] == ["title"]:
            self.title.append(data)
        if self.block is not None:
            self.block.append(data)
        if self.link:
            self.link[1] += data
        if data.strip():
            self.text.append(_SPACE.sub(" ", data).strip())


def linked_data(texts: list[str]) -> list[dict]:
    """The objects of JSON-LD scripts: lists and @graph are looked into, broken scripts left out."""
    out = []
    for text in texts:
        try:
            found = json.loads(text)
        except ValueError:
            continue
        todo = [found]
        while todo:
            x = todo.pop(0)
            if isinstance(x, list):
                todo[:0] = x
            elif isinstance(x, dict):
                if x.get("@graph"):
                    todo[:0] = [x["@graph"]]
                else:
                    out.append(x)
    return out


def linked_value(objects: list[dict], key: str) -> str:
    """The first text that any object has under the key; of an object or list under it its name."""
    for x in objects:
        value = x.get(key)
        if isinstance(value, list) and value:
            value = value[0]
        if isinstance(value, dict):
            value = value.get("name")
        if isinstance(value, str) and value.strip():
            return _SPACE.sub(" ", value).strip()
    return ""


def read_page(html: str | None, url: str = "", roots: frozenset = ROOTS) -> dict:
    """title, description, author, published, canonical, text, body and links of a page; null or broken pages give what they hold.

    Meta elements go before linked data, and that before the page's own elements; the longer of the root's text and the linked body is the body.
    """
    reader = _Reader(roots)
    reader.feed(html or "")
    reader.close()
    data = linked_data(reader.data)
    meta = lambda *names: next((reader.meta[n] for n in names if reader.meta.get(n)), "")
    body = "\n".join(reader.blocks)
    structured = max((str(x.get("articleBody") or "") for x in data), key=len, default="")
    return {
        "title": meta("og:title") or linked_value(data, "headline") or _SPACE.sub(" ", "".join(reader.title)).strip(),
        "description": meta("description", "og:description") or linked_value(data, "description"),
        "author": meta("author", "article:author") or linked_value(data, "author"),
        "published": meta("article:published_time", "datepublished", "date") or linked_value(data, "datePublished"),
        "canonical": urljoin(url, reader.canonical) if reader.canonical else url,
        "body": structured if len(structured) > len(body) else body,
        "text": " ".join(reader.text),
        "links": [(urljoin(url, a), b, c) for a, b, c in reader.links],
    }


def _rows(pages: DataFrame, schema: str, function) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        kinds = [pa.int32() if x.split()[1] == "int" else pa.string() for x in schema.split(", ")]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = [r for url, text in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)) for r in function(url or "", text or "")]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    return pages.select("url", "html").mapInArrow(run, schema)


def extract_pages(pages: DataFrame, roots: dict[str, frozenset] | None = None) -> DataFrame:
    """Contents of pages (url, html); roots: by host, the elements in which its reports stand (others have the generic ones)."""
    own = roots or {}

    def one(url, html):
        host = url.split("/")[2].lower() if url.count("/") >= 2 else ""
        p = read_page(html, url, own.get(host, ROOTS))
        return [(url, p["title"], p["description"], p["author"], p["published"], p["canonical"], p["body"], len(p["body"].split()))]

    return _rows(pages, "url string, title string, description string, author string, published string, canonical string, body string, words int", one)


def page_links(pages: DataFrame) -> DataFrame:
    return _rows(pages, "url string, href string, label string, rel string, place int", lambda url, html: [(url, *link, k) for k, link in enumerate(read_page(html, url)["links"])])


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1].lower()


def _tree(text: str):
    try:
        return ElementTree.fromstring(text)
    except ElementTree.ParseError:
        return None


def read_feeds(feeds: DataFrame) -> DataFrame:
    """Items of RSS and entries of Atom; a guid serves as link only if it is a permalink. Broken feeds give no rows."""

    def items(url, text):
        out, root = [], _tree(text)
        for node in [] if root is None else root.iter():
            if _local(node.tag) not in ("item", "entry"):
                continue
            f: dict[str, str] = {}
            for child in node:
                name, value = _local(child.tag), (child.text or "").strip()
                if name == "link":
                    if child.get("rel", "alternate") == "alternate":
                        f.setdefault("link", child.get("href") or value)
                elif name == "guid":
                    if child.get("isPermaLink", "true").lower() == "true":
                        f.setdefault("guid", value)
                else:
                    f.setdefault(name, value)
            link = f.get("link") or f.get("guid")
            if link:
                out.append((url, urljoin(url, link), f.get("title", ""), f.get("pubdate") or f.get("published") or f.get("updated") or ""))
        return out

    return _rows(feeds, "url string, link string, title string, published string", items)


def read_sitemaps(sitemaps: DataFrame) -> DataFrame:
    """Entries by their own loc, once each per file; kind tells pages from child sitemaps."""

    def entries(url, text):
        out, seen, root = [], set(), _tree(text)
        for node in [] if root is None else root:
            kind = _local(node.tag)
            f = {_local(c.tag): (c.text or "").strip() for c in node}
            loc = urljoin(url, f.get("loc", ""))
            if kind in ("url", "sitemap") and f.get("loc") and loc not in seen:
                seen.add(loc)
                out.append((url, loc, kind, f.get("lastmod", "")))
        return out

    return _rows(sitemaps, "url string, loc string, kind string, lastmod string", entries)


def _xml(c):
    # characters that XML and HTML reserve, and control characters XML doesn't know
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def as_pages(articles: DataFrame) -> DataFrame:
    """(url, html): a page for each article, with furniture around the report."""
    lines = F.array_join(F.transform(F.split(_xml(F.col("body")), "\n"), lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>"))), "")
    html = F.concat(
        F.lit("<html><head><title>"), _xml(F.col("title")), F.lit(
            '</title><meta name="description" content="'
        ), _xml(F.col("description")), F.lit(
            '"><meta property="article:published_time" content="'
        ), _xml(F.col("published_at")), F.lit('"><meta name="author" content="'), _xml(F.col("author")), F.lit('"><link rel="canonical" href="'), _xml(F.col("canonical_url")),
        F.lit('"></head><body><nav><a href="/">Home</a> <a href="/news">News</a></nav><article>'), lines, F.lit(
            '</article><script>var x = "<p>no</p>";</script><footer><p>End</p></footer></body></html>'
        ),
    )
    return articles.where("canonical_url is not null").select(F.col("canonical_url").alias("url"), html.alias("html"))


def _joined(articles: DataFrame, item, head: str, tail: str) -> DataFrame:
    """One file per source and day of fetching, so no file gathers a whole source."""
    rows = articles.where("canonical_url is not null").select("source_id", F.to_date("fetched_at").alias("day"), F.struct("canonical_url", item.alias("x")).alias("i"))
    files = rows.groupBy("source_id", "day").agg(F.array_join(F.transform(F.array_sort(F.collect_list("i")), lambda r: r["x"]), "").alias("items"))
    return files.select(
        F.concat(F.lit("https://"), "source_id", F.lit(".example/"), F.coalesce(F.col("day").cast("string"), F.lit("undated")), F.lit(".xml")).alias("url"),
        F.concat(F.lit(head), "items", F.lit(tail)).alias("html")
    )


def as_feeds(articles: DataFrame) -> DataFrame:
    item = F.concat(
        F.lit("<item><title>"),
        _xml(F.col("title")),
        F.lit("</title><link>"),
        _xml(F.col("canonical_url")),
        F.lit("</link><pubDate>"),
        _xml(F.col("published_at")),
        F.lit("</pubDate></item>")
    )
    return _joined(articles, item, '<rss version="2.0"><channel>', "</channel></rss>")


def as_sitemaps(articles: DataFrame) -> DataFrame:
    item = F.concat(F.lit("<url><loc>"), _xml(F.col("canonical_url")), F.lit("</loc><lastmod>"), _xml(F.col("updated_at")), F.lit("</lastmod></url>"))
    return _joined(articles, item, '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">', "</urlset>")
