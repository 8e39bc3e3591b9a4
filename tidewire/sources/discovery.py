"""Discovery of candidate addresses in fetched documents: listings, feeds, interfaces and sitemaps of sources.

Documents are rows (source_id, url, html); sources are rows (source_id, homepage and lists). What a document links is
read in Arrow batches; filters, caps and orders are set-based.
"""

from __future__ import annotations

import codecs
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from . import pages

_CHARSET = re.compile(r"charset=([\w\-]+)", re.IGNORECASE)


def decoded(fetched: DataFrame) -> DataFrame:
    """(url, html) of (url, content_type, body binary): the charset that the type names, else UTF-8; unknown names are UTF-8, broken bytes become marks, null bodies empty."""

    def text(kind: str | None, body: bytes | None) -> str:
        named = _CHARSET.search(kind or "")
        try:
            charset = codecs.lookup(named.group(1)).name if named else "utf-8"
        except LookupError:
            charset = "utf-8"
        return (body or b"").decode(charset, "replace")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls, kinds, bodies = (c.to_pylist() for c in batch.columns)
            yield pa.RecordBatch.from_pydict({"url": pa.array(urls, pa.string()), "html": pa.array([text(k, b) for k, b in zip(kinds, bodies)], pa.string())})

    return fetched.select("url", "content_type", F.col("body").cast("binary")).mapInArrow(run, "url string, html string")


def robots_sitemaps(robots: DataFrame) -> DataFrame:
    """(url, sitemap, place) of each sitemap line of robots files (url, html); relative ones are completed."""
    found = robots.select("url", F.posexplode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"(?im)^\s*sitemap:\s*(\S+)"), F.lit(1))).alias("place", "named"))
    return found.select("url", F.coalesce(U.canonicalize(F.col("named"), F.col("url")), F.col("named")).alias("sitemap"), "place")


def sitemap_entries(sitemaps: DataFrame) -> DataFrame:
    """(url, loc, kind, lastmod, published, title, is_news): entries by their own loc, once each per file; kind tells pages from child sitemaps, is_news files that name the news scheme."""

    def entries(url, text):
        out, seen, root = [], set(), pages._tree(text)
        if root is None:
            return []
        news = any(pages._local(n.tag) == "news" for n in root.iter())
        index = pages._local(root.tag) == "sitemapindex"
        for node in root:
            own = next((c.text for c in node if pages._local(c.tag) == "loc"), "") or ""
            loc = pages.urljoin(url, own.strip())
            if not own.strip() or loc in seen:
                continue
            seen.add(loc)
            f = {pages._local(c.tag): " ".join("".join(c.itertext()).split()) for c in node.iter()}
            out.append((url, loc, "sitemap" if index else "url", f.get("lastmod", ""), f.get("publication_date", ""), f.get("title", ""), int(news)))
        return out

    rows = pages._rows(sitemaps, "url string, loc string, kind string, lastmod string, published string, title string, is_news int", entries)
    return rows.withColumn("is_news", F.col("is_news") == 1)


def children_to_read(entries: DataFrame, most: int) -> DataFrame:
    """(url, loc): of each index the newest `most` child sitemaps; undated ones last."""
    w = Window.partitionBy("url").orderBy(F.desc("lastmod"), "loc")
    return entries.where("kind = 'sitemap'").withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).select("url", "loc")


def sitemap_candidates(entries: DataFrame, homepages: DataFrame) -> DataFrame:
    """(source_id, url, published, title, is_news) of pages of the source's own site, news files before others where both have an address.

    entries carry source_id; homepages: (source_id, homepage).
    """
    own = entries.where("kind = 'url'").join(homepages, "source_id").where(U.same_site_page(F.col("loc"), F.col("homepage")))
    first = F.min_by(F.struct(F.coalesce(T.nonblank(F.col("published")), F.col("lastmod")).alias("published"), "title", "is_news"), F.struct(~F.col("is_news"), F.col("url")))
    return own.groupBy("source_id", F.col("loc").alias("url")).agg(first.alias("f")).select("source_id", "url", "f.published", "f.title", "f.is_news")


def wordpress_posts(answers: DataFrame) -> DataFrame:
    """(url, link, title, body, description, published) of posts in answers of the interface; posts without a link or body, and answers that are no list, give none."""

    def posts(url, text):
        try:
            listed = json.loads(text)
        except ValueError:
            return []
        out = []
        for item in listed if isinstance(listed, list) else []:
            if not isinstance(item, dict):
                continue
            part = lambda k: fragment_text(str((item.get(k) if isinstance(item.get(k), dict) else {}).get("rendered", "")))
            link, body = pages.urljoin(url, str(item.get("link", "") or "")), part("content")
            if item.get("link") and link.startswith(("http://", "https://")) and body:
                out.append((url, link, part("title"), body, part("excerpt"), str(item.get("date_gmt") or item.get("date") or "")))
        return out

    return pages._rows(answers, "url string, link string, title string, body string, description string, published string", posts)


class _Fragment(pages.HTMLParser):
    """Text of paragraphs, headings and list items of a fragment, each once, without asides; of all text where there are none."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.blocks: list[str] = []
        self.every: list[str] = []
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag not in pages.VOID:
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open.pop() != tag:
                pass

    def handle_data(self, data):
        if {"script", "style", "noscript", "template", "svg", "figure", "aside", "nav", "footer"}.intersection(self.open):
            return
        self.every.append(data)
        if pages.BLOCKS.intersection(self.open):
            self.blocks.append(data)


def fragment_text(html: str) -> str:
    found = _Fragment(html)
    return " ".join(" ".join(found.blocks or found.every).split())


def feed_items(feeds: DataFrame, homepages: DataFrame, least_words: int = 100) -> DataFrame:
    """(source_id, url, title, published, body) of feed items on the source's own site; a body only if the feed gives the full text of at least `least_words` words.

    feeds: (source_id, url, html), homepages: (source_id, homepage).
    """

    def items(url, text):
        out, root = [], pages._tree(text)
        for node in [] if root is None else root.iter():
            if pages._local(node.tag) not in ("item", "entry"):
                continue
            f: dict[str, str] = {}
            for child in node:
                name, value = pages._local(child.tag), (child.text or "").strip()
                if name == "link":
                    if child.get("rel", "alternate") == "alternate":
                        f.setdefault("link", child.get("href") or value)
                elif name != "guid" or child.get("isPermaLink", "true").lower() == "true":
                    f.setdefault(name, value)
            link = f.get("link") or f.get("guid")
            if link:
                body = fragment_text(f.get("encoded") or f.get("content") or f.get("description") or "")
                when = f.get("pubdate") or f.get("published") or f.get("date") or f.get("updated") or ""
                out.append((url, pages.urljoin(url, link), " ".join(f.get("title", "").split())[:500], when, body if len(body.split()) >= least_words else None))
        return out

    read = pages._rows(feeds, "url string, link string, title string, published string, body string", items).withColumnRenamed("url", "feed")
    owned = read.join(feeds.select("source_id", F.col("url").alias("feed")).dropDuplicates(), "feed").join(homepages, "source_id")
    return owned.where(U.same_site_page(F.col("link"), F.col("homepage"))).select("source_id", U.canonicalize(F.col("link")).alias("url"), "title", "published", "body")


def _links(listings: DataFrame) -> DataFrame:
    read = pages.page_links(listings.select("url", "html"))
    return read.join(listings.select("source_id", "url").dropDuplicates(), "url")


def announced_feeds(listings: DataFrame) -> DataFrame:
    """(source_id, feed) of feeds that listings announce as alternates, each once."""
    found = pages._rows(
        listings.select("url", "html"),
        "url string, feed string",
        lambda url, html: [
            (url, pages.urljoin(url, h)) for h in re.findall(
                r"""(?is)<link\b(?=[^>]*\brel=["']?[^"'>]*alternate)(?=[^>]*\btype=["']?[^"'>]*(?:rss|atom|feed))[^>]*\bhref=["']([^"']+)""",
                html
            )
        ]
    )
    return found.join(listings.select("source_id", "url").dropDuplicates(), "url").select("source_id", "feed").dropDuplicates()


def listing_candidates(listings: DataFrame, homepages: DataFrame, per_endpoint: int = 50, lists: dict[str, Column] | None = None) -> DataFrame:
    """(source_id, url, title, endpoint, place): links of listing pages to pages of the source's own site that its lists allow, each at its first place; at most `per_endpoint` of a listing page."""
    links = _links(listings).where("rel = 'a'").join(homepages, "source_id")
    links = links.withColumn("target", U.canonicalize(F.col("href")))
    kept = links.where(F.col("target").isNotNull() & U.same_site_page(F.col("target"), F.col("homepage")))
    if lists:
        kept = kept.where(U.allowed(F.col("target"), F.col("label"), **lists))
    first = kept.groupBy("source_id", "target").agg(F.min(F.struct("url", "place", "label")).alias("f")).select("source_id", F.col("target"), "f.url", "f.place", "f.label")
    k = F.row_number().over(Window.partitionBy("source_id", "url").orderBy("place"))
    return first.withColumn("k", k).where(F.col("k") <= per_endpoint).select(
        "source_id",
        F.col("target").alias("url"),
        F.substring("label", 1, 500).alias("title"),
        F.col("url").alias("endpoint"),
        F.col("k").alias("place")
    )


def homepage_candidates(listings: DataFrame, homepages: DataFrame, most: int) -> DataFrame:
    """(source_id, url, title, place): links of homepages that may be articles, in order of their first place, at most `most` of a source."""
    links = _links(listings).where("rel = 'a'").join(homepages, "source_id").withColumn("target", U.canonicalize(F.col("href")))
    kept = links.where(F.col("target").isNotNull() & U.is_candidate(F.col("target"), F.col("homepage"), T.word_count(F.col("label"))))
    first = kept.groupBy("source_id", "target").agg(F.min(F.struct("url", "place", "label")).alias("f"))
    k = F.row_number().over(Window.partitionBy("source_id").orderBy("f.url", "f.place"))
    return first.withColumn("k", k).where(F.col("k") <= most).select(
        "source_id",
        F.col("target").alias("url"),
        F.substring("f.label", 1, 500).alias("title"),
        F.col("k").alias("place")
    )
