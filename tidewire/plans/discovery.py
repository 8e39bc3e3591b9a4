"""Discovery queries over hand-written documents whose results are written out by hand in the SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import discovery as D
from .registry import query, sql_values

HOME = [("s1", "https://site.example/"), ("s2", "https://www.other.example/")]
ROBOTS = [
    ("https://site.example/robots.txt", "User-agent: *\nSitemap: https://site.example/news.xml\n  sitemap:   /all.xml\nDisallow: /x\n# Sitemap: no"),
    ("https://www.other.example/robots.txt", None)
]
SITEMAPS = [
    (
        "s1",
        "https://site.example/news.xml",
        '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:news="n"><url><loc>https://site.example/a</loc><lastmod>2026-01-02</lastmod><news:news><news:publication_date>2026-01-01</news:publication_date><news:title>A  story</news:title></news:news><image><loc>https://cdn.example/a.jpg</loc></image></url><url><loc>https://site.example/a</loc></url><url><loc>https://elsewhere.example/b</loc></url></urlset>'
    ),
    (
        "s1",
        "https://site.example/all.xml",
        "<sitemapindex><sitemap><loc>/old.xml</loc><lastmod>2025-01-01</lastmod></sitemap><sitemap><loc>/new.xml</loc><lastmod>2026-01-01</lastmod></sitemap><sitemap><loc>/undated.xml</loc></sitemap></sitemapindex>"
    ),
    (
        "s1",
        "https://site.example/new.xml",
        "<urlset><url><loc>https://sub.site.example/c</loc><lastmod>2026-01-03</lastmod></url><url><loc>https://site.example/a</loc><lastmod>2026-01-05</lastmod></url><url><loc>https://site.example/pic.png</loc></url></urlset>"
    ), ("s2", "https://www.other.example/broken.xml", "<urlset><url>"),
]
LONG = "word " * 100
FEEDS = [
    (
        "s1",
        "https://site.example/rss",
        f'<rss><channel><item><title> One  title </title><link>https://site.example/1?utm_source=rss</link><pubDate>Tue, 10 Feb 2026 00:00:00 GMT</pubDate><description>{LONG}</description></item><item><title>Two</title><guid isPermaLink="false">x</guid></item><item><title>Three</title><guid>https://site.example/3</guid><description>short</description></item><item><link>https://elsewhere.example/4</link></item></channel></rss>'
    ),
    (
        "s2",
        "https://www.other.example/atom",
        '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>Five</title><link rel="enclosure" href="/x.mp3"/><link href="/5"/><updated>2026-02-01</updated></entry></feed>'
    ),
]
POSTS = [
    (
        "https://site.example/wp-json",
        '[{"link":"/p1","title":{"rendered":"T &amp; one"},"content":{"rendered":"<p>First <b>part</b>.</p><aside><p>no</p></aside><ul><li>Item</li></ul>"},"excerpt":{"rendered":"Short"},"date_gmt":"2026-01-01T00:00:00"},{"link":"/p2","content":{"rendered":""}},{"content":{"rendered":"<p>x</p>"}},"odd"]'
    ),
    ("https://site.example/error", '{"code":"no"}'),
    ("https://site.example/html", "<html>")
]
LISTINGS = [
    (
        "s1",
        "https://site.example/",
        '<html><head><link rel="alternate" type="application/rss+xml" href="/rss"><link type="application/atom+xml" href="atom" rel="alternate"><link rel="stylesheet" href="/a.css"></head><body><a href="/news/one">First story of the day</a><a href="/news/one?utm_medium=x">Again</a><a href="https://elsewhere.example/n">Off</a><a href="/logo.png">Logo</a><a href="/tag/x/news/">Tag</a><a href="/about">About us</a><a href="/swiat/two.html#c">Two</a><a href="mailto:a@b">Mail</a></body></html>'
    ),
    ("s1", "https://site.example/world", '<a href="/world/three-long">Six words are in this title</a><a href="/news/one">First</a><a href="/quiz/four.html">Quiz of the week</a>'),
]
FETCHED = [("u1", "text/html; charset=iso-8859-2", "b3f364bc"), ("u2", "text/html", "c582c3b364c5ba"), ("u3", "text/html; charset=unknown-8", "61ff"), ("u4", None, None)]


def _frame(t, rows, schema):
    return t("sources").sparkSession.createDataFrame(rows, schema)


def _homes(t):
    return _frame(t, HOME, "source_id string, homepage string")


@query("select * from " + sql_values([("u1", "łódź"), ("u2", "łódź"), ("u3", "a�"), ("u4", "")]) + " v(url, html)")
def decoded_pages(t):
    rows = [(u, c, None if b is None else bytearray.fromhex(b)) for u, c, b in FETCHED]
    return D.decoded(_frame(t, rows, "url string, content_type string, body binary"))


@query("select * from " + sql_values([("https://site.example/robots.txt", "https://site.example/news.xml", 0), ("https://site.example/robots.txt", "https://site.example/all.xml", 1)]) + " v(url, sitemap, place)")
def robots_sitemaps(t):
    return D.robots_sitemaps(_frame(t, ROBOTS, "url string, html string"))


@query("select * from " + sql_values([("https://site.example/all.xml", "https://site.example/new.xml"), ("https://site.example/all.xml", "https://site.example/old.xml")]) + " v(url, loc)")
def sitemap_children(t):
    """The newest two children of an index."""
    return D.children_to_read(D.sitemap_entries(_frame(t, SITEMAPS, "source_id string, url string, html string")), 2)


@query("select * from " + sql_values([("s1", "https://site.example/a", "2026-01-01", "A story", True), ("s1", "https://sub.site.example/c", "2026-01-03", "", False)]) + " v(source_id, url, published, title, is_news)")
def sitemap_candidates(t):
    files = _frame(t, SITEMAPS, "source_id string, url string, html string")
    return D.sitemap_candidates(D.sitemap_entries(files).join(files.select("source_id", "url"), "url"), _homes(t))


@query("select * from " + sql_values([("https://site.example/wp-json", "https://site.example/p1", "T & one", "First part . Item", "Short", "2026-01-01T00:00:00")]) + " v(url, link, title, body, description, published)")
def wordpress_posts(t):
    return D.wordpress_posts(_frame(t, POSTS, "url string, html string"))


@query("select source_id, url, title, published, words from " + sql_values([("s1", "https://site.example/1", "One title", "Tue, 10 Feb 2026 00:00:00 GMT", 100), ("s1", "https://site.example/3", "Three", "", 0), ("s2", "https://www.other.example/5", "Five", "2026-02-01", 0)]) + " v(source_id, url, title, published, words)")
def feed_candidates(t):
    """Items of feeds on the source's own site; only a full text counts as a body."""
    items = D.feed_items(_frame(t, FEEDS, "source_id string, url string, html string"), _homes(t))
    return items.select("source_id", "url", "title", "published", F.when(F.col("body").isNotNull(), F.size(F.split("body", " "))).otherwise(0).alias("words"))


@query("select * from " + sql_values([("s1", "https://site.example/atom"), ("s1", "https://site.example/rss")]) + " v(source_id, feed)")
def announced_feeds(t):
    return D.announced_feeds(_frame(t, LISTINGS, "source_id string, url string, html string"))


@query("select * from " + sql_values([
    ("s1", "https://site.example/news/one", "First story of the day", "https://site.example/", 1), ("s1", "https://site.example/tag/x/news/", "Tag", "https://site.example/", 2), ("s1", "https://site.example/about", "About us", "https://site.example/", 3), (
        "s1",
        "https://site.example/world/three-long",
        "Six words are in this title",
        "https://site.example/world",
        1
    ),
]) + " v(source_id, url, title, endpoint, place)")
def listing_candidates(t):
    """Links of listing pages, three of each at most; quizzes are excluded by the source's list."""
    none = F.array().cast("array<string>")
    lists = {"include_hosts": none, "include_paths": none, "exclude_paths": none, "exclude_titles": F.array(F.lit("^quiz"))}
    return D.listing_candidates(_frame(t, LISTINGS, "source_id string, url string, html string"), _homes(t), 3, lists)


@query("select * from " + sql_values([("s1", "https://site.example/news/one", "First story of the day", 1), ("s1", "https://site.example/swiat/two.html", "Two", 2), ("s1", "https://site.example/world/three-long", "Six words are in this title", 3)]) + " v(source_id, url, title, place)")
def homepage_candidates(t):
    """Links that may be articles, the first three."""
    return D.homepage_candidates(_frame(t, LISTINGS, "source_id string, url string, html string"), _homes(t), 3)
