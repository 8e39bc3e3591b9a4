"""Addresses: resolution, canonical form, site comparison and the candidate filter, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the candidate filter: suffixes of files that are no pages, parts of paths that hold no articles, openings of account paths,
# signs of an article in a path, parts of the names of asset hosts.
ASSET_SUFFIXES = ".avif .css .gif .ico .jpeg .jpg .js .m4v .mp3 .mp4 .png .svg .webm .webp .xml .json .txt".split()
IGNORED_PARTS = "/tag/ /tags/ /author/ /authors/ /category/ /categories/ /search /newsletter /podcast /video/ /wideo/ /live/ /na-zywo/ /transmisja/ /transmisje/ /gallery/ /galeria/ /slideshow/".split()
ACCOUNT_PARTS = "/login /account /subscribe".split()
ARTICLE_HINTS = r"/(?:news|article|story|politic|world|business|econom|politics|aktualnosci|202[0-9]|20[0-9]{2})[/\-_]|/(?:wiadomosci|polityka|swiat|gospodarka|biznes)/"
ASSET_HOSTS = "static image images cdn".split()
# Query keys that only track.
TRACKING_KEYS = "utm_source utm_medium utm_campaign utm_term utm_content gclid fbclid".split()

_SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.-]*):"


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def _without_dots(p: Column) -> Column:
    """A path with its . and .. segments resolved; a path that ends in one ends in a slash."""
    kept = F.aggregate(
        F.split(p, "/"),
        F.array().cast("array<string>"),
        lambda out, x: F.when(
            x == "..",
            F.when(F.size(out) > 1, F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(out)
        ).when(x == ".", out).otherwise(F.concat(out, F.array(x))),
    )
    return F.concat(F.array_join(kept, "/"), F.when(p.rlike(r"(?:^|/)\.{1,2}$"), "/").otherwise(""))


def resolve(url: Column, base: Column) -> Column:
    """A reference against the address of its page: whole addresses stay, //host, /path, ?query and relative paths are completed."""
    u, b = F.trim(url), F.coalesce(base, F.lit(""))
    scheme, origin = F.regexp_extract(b, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1), F.regexp_extract(b, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    own, rest = F.regexp_extract(u, r"^([^?#]*)", 1), F.regexp_extract(u, r"^[^?#]*(.*)$", 1)
    folder = F.regexp_extract(path(b), r"^(.*/)[^/]*$", 1)
    folder = F.when(folder == "", "/").otherwise(folder)
    return (
        F.when(u.rlike(_SCHEME) | (origin == ""), u)
        .when(u.startswith("//"), F.concat(scheme, u))
        .when(own.startswith("/"), F.concat(origin, _without_dots(own), rest))
        .when(own != "", F.concat(origin, _without_dots(F.concat(folder, own)), rest))
        .when(u.startswith("?"), F.concat(origin, path(b), rest))
        .otherwise(b)
    )


def _form_encoded(text: Column) -> Column:
    plain = F.coalesce(F.try_url_decode(text), text)
    return F.replace(F.replace(F.url_encode(plain), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _query_without(url: Column, dropped) -> Column:
    """?query with every pair re-encoded, blank values kept, without the pairs whose key `dropped` says so of; nothing if none is left."""
    pairs = F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda p: p != "")
    split = F.transform(
        pairs,
        lambda p: F.struct(_form_encoded(F.regexp_extract(p, r"^([^=]*)", 1)).alias("k"), _form_encoded(F.regexp_extract(p, r"^[^=]*=?(.*)$", 1)).alias("v"))
    )
    kept = F.filter(split, lambda p: ~dropped(F.lower(p["k"])))
    return F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(F.transform(kept, lambda p: F.concat(p["k"], F.lit("="), p["v"])), "&"))).otherwise("")


def canonicalize(url: Column, base: Column | None = None) -> Column:
    """http(s) only, completed by its page's address, lower-case host, a path, no tracking keys, no fragment; other addresses have none."""
    full = F.trim(url) if base is None else resolve(url, base)
    scheme = F.lower(F.regexp_extract(full, r"^([a-zA-Z]+)://", 1))
    out = F.concat(scheme, F.lit("://"), host(full), F.when(path(full) == "", "/").otherwise(path(full)), _query_without(full, lambda k: k.isin(*TRACKING_KEYS)))
    return F.when(scheme.isin("http", "https") & (host(full) != ""), out)


def strip_query_keys(url: Column, keys: Column) -> Column:
    """Without the query keys of a per-source list (trimmed, letter case aside); no key given, no change."""
    own = F.transform(F.coalesce(keys, F.array().cast("array<string>")), lambda k: F.lower(F.trim(k)))
    own = F.filter(own, lambda k: k != "")
    out = F.concat(F.regexp_extract(url, r"^([^?#]*)", 1), _query_without(url, lambda k: F.array_contains(own, k)))
    return F.when(F.size(own) > 0, out).otherwise(url)


def same_site(a: Column, b: Column) -> Column:
    x, y = F.regexp_replace(host(a), r"^www\.", ""), F.regexp_replace(host(b), r"^www\.", "")
    return (x == y) | F.endswith(x, F.concat(F.lit("."), y)) | F.endswith(y, F.concat(F.lit("."), x))


def _any(values: list[str], test) -> Column:
    out = F.lit(False)
    for v in values:
        out = out | test(F.lit(v))
    return out


def same_site_page(url: Column, homepage: Column) -> Column:
    """An address of the site that is no asset."""
    p = F.lower(path(url))
    return same_site(url, homepage) & (host(url) != "") & ~_any(ASSET_SUFFIXES, lambda x: F.endswith(p, x))


def hinted(p: Column) -> Column:
    return p.rlike("(?i)" + ARTICLE_HINTS)


def is_candidate(url: Column, homepage: Column, title_words: Column) -> Column:
    p = F.lower(path(url))
    good = same_site(url, homepage) & ~p.isin("", "/") & ~_any(ASSET_SUFFIXES, lambda x: F.endswith(p, x)) & ~_any(IGNORED_PARTS, lambda x: F.contains(p, x)) & ~_any(
        ACCOUNT_PARTS,
        lambda x: F.startswith(p, x)
    )
    return good & (~_any(ASSET_HOSTS, lambda x: F.contains(host(url), x)) | hinted(p)) & (hinted(p) | p.rlike(r"/20[0-9]{2}/") | F.endswith(p, F.lit(".html")) | (title_words >= 6))


def _matches(text: Column, patterns: Column) -> Column:
    return F.exists(F.coalesce(patterns, F.array().cast("array<string>")), lambda p: F.regexp(text, F.concat(F.lit("(?i)"), p)))


def allowed(url: Column, title: Column, include_hosts: Column, include_paths: Column, exclude_paths: Column, exclude_titles: Column) -> Column:
    """Per-source pattern lists, letter case aside: host and path each need one of their includes where any is given, and neither path nor title an exclude."""
    none = lambda patterns: F.size(F.coalesce(patterns, F.array().cast("array<string>"))) == 0
    ok = (none(include_hosts) | _matches(host(url), include_hosts)) & (none(include_paths) | _matches(path(url), include_paths))
    return ok & ~_matches(path(url), exclude_paths) & ~_matches(F.coalesce(title, F.lit("")), exclude_titles)
