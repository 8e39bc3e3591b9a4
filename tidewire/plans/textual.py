"""Text, address, claim and page queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..operators import ledger
from ..sources import pages
from .registry import ARTICLES, articles, query, sql_folded, sql_values

_SP = r"regexp_replace({}, '\s+', ' ', 'g')"
_HOST = "lower(regexp_extract({0}, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1))"
_PATH = "regexp_extract({0}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_URL = "original_url"


#: Addresses that the tables don't hold: (id, address, page it stands on, title).
PLANTED_URLS = [("u01", "/news/a b?x=1&utm_source=q", "https://site.example/dir/page.html", "t"), ("u02", "other.html#top", "https://site.example/dir/page.html", "t"), ("u03", "../up/./x?UTM_Medium=1&q=a%20b+c&utm_extra=2", "https://Site.example/a/b/c", "t"),
    (
        "u04",
        "//cdn.site.example/news/1",
        "https://site.example/",
        "t"
    ), ("u05", "HTTPS://SITE.example", "https://site.example", "t"), ("u06", "mailto:a@b.example", "https://site.example", "t"), ("u07", "?p=2&blank=&novalue", "https://site.example/list/", "t"), ("u08", "", "https://site.example/list/", "t"),
    (
        "u09",
        "https://sub.site.example/na-zywo/mecz-1",
        "https://www.site.example/",
        "one two three four five six"
    ), ("u10", "https://sub.site.example/kraj/one.html", "https://site.example/", "t"), ("u11", "https://site.example/search?q=1", "https://site.example/", "one two three four five six"),
    (
        "u12",
        "https://images.site.example/kraj/plain",
        "https://site.example/",
        "one two three four five six"
    ), ("u13", "https://images.site.example/swiat/plain", "https://site.example/", "t"), ("u14", "https://other.example/2026/x", "https://site.example/", "t"),
    ("u15", "https://site.example/wideo/one.html", "https://site.example/", "t"), (
        "u16",
        "https://site.example/data/feed.txt",
        "https://site.example/",
        "one two three four five six"
    ), ("u17", "https://example/2025/x", "https://site.example/", "t"), ("u18", "https://site.example/kraj/amp=1/x.html", "https://site.example/", "t"),
    ("u19", "https://site.example/kraj/quiz.html", "https://site.example/", "Quiz: what do you know"), ("u20", "https://site.example/a%zz?b=%zz", "https://site.example/", "t")]
_URLS = f"(select article_id as id, original_url as url, homepage as base, title from {ARTICLES} a join (select source_id, homepage from sources) s on s.source_id = a.source_id union all select * from {sql_values(PLANTED_URLS)} v(id, url, base, title))"


def _urls(t):
    a = articles(t).join(t("sources").select("source_id", "homepage"), "source_id").select(
        F.col("article_id").alias("id"),
        F.col("original_url").alias("url"),
        F.col("homepage").alias("base"),
        "title"
    )
    return a.union(a.sparkSession.createDataFrame(PLANTED_URLS, "id string, url string, base string, title string"))


def _sql_path(p: str) -> str:
    """A path with . and .. resolved, in SQL: segments are folded one by one."""
    fold = f"list_reduce(list_prepend([''], list_transform(string_split({p}, '/')[2:], lambda x: [x])), lambda a, x: case when x[1] = '..' then case when len(a) > 1 then a[1:len(a) - 1] else a end when x[1] = '.' then a else list_concat(a, x) end)"
    return f"(array_to_string({fold}, '/') || case when regexp_matches({p}, '(?:^|/)\\.{{1,2}}$') then '/' else '' end)"


_RESOLVED = f"""(select *, case when regexp_matches(u, '^[a-zA-Z][a-zA-Z0-9+.-]*:') or origin = '' then u when starts_with(u, '//') then regexp_extract(base, '^([a-zA-Z][a-zA-Z0-9+.-]*:)', 1) || u
    when starts_with(own, '/') then origin || {_sql_path("own")} || rest when own <> '' then origin || {_sql_path("(folder || own)")} || rest
        when starts_with(u, '?') then origin || bp || rest else base end as whole
    from (select *, case when f = '' then '/' else f end as folder from (select *, trim(url) as u, regexp_extract(base,
        '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) as origin, regexp_extract(trim(url), '^([^?#]*)', 1) as own,
        regexp_extract(trim(url), '^[^?#]*(.*)$', 1) as rest,
    {_PATH.format("base")} as bp, regexp_extract({_PATH.format("base")}, '^(.*/)[^/]*$', 1) as f from {_URLS})))"""
_ENCODE = "replace(url_encode(case when regexp_matches(replace({0}, '+', ' '), '%(?:[^0-9A-Fa-f]|.[^0-9A-Fa-f]|.?$)') then {0} else url_decode(replace({0}, '+', ' ')) end), '%20', '+')"


@query(f"""with r as (select id, whole, lower(regexp_extract(whole, '^([a-zA-Z]+)://', 1)) s, {_HOST.format("whole")} h,
    {_PATH.format("whole")} p, list_filter(string_split(regexp_extract(whole, '\\?([^#]*)', 1), '&'), lambda x: x <> '') q
    from {_RESOLVED}),
    k as (select *, list_filter(list_transform(q, lambda x: list_value({_ENCODE.format("regexp_extract(x, '^([^=]*)', 1)")},
        {_ENCODE.format("regexp_extract(x, '^[^=]*=?(.*)$', 1)")})), lambda y: lower(y[1]) not in ({", ".join(f"'{k}'" for k in U.TRACKING_KEYS)})) z
        from r)
    select id, case when s in ('http', 'https') and h <> '' then s || '://' || h || case when p = '' then '/' else p end || case
        when len(z) > 0 then '?' || array_to_string(list_transform(z, lambda y: y[1] || '=' || y[2]), '&') else '' end end as url
        from k""")
def url_canonicalize(t):
    """Addresses completed by the page they stand on, in canonical form: five utm keys, gclid and fbclid go, the rest is re-encoded."""
    return _urls(t).select("id", U.canonicalize(F.col("url"), F.col("base")).alias("url"))


@query(f"""with s as (select id, regexp_replace({_HOST.format("url")}, '^www\\.', '') x, regexp_replace({_HOST.format("base")}, '^www\\.', '') y from {_URLS})
    select id, x = y or ends_with(x, '.' || y) or ends_with(y, '.' || x) as own from s""")
def url_same_site(t):
    """The same host but for www., or a sub- or superdomain of it."""
    return _urls(t).select("id", U.same_site(F.col("url"), F.col("base")).alias("own"))


_LISTS = {"include_hosts": [], "include_paths": [r"/(?:news|politics|svit|kraj|monde|mondo|mundo|wetter|swiat)/"], "exclude_paths": [r"amp=1"], "exclude_titles": [r"^quiz"]}
_HINT = f"regexp_matches(p, '(?i){U.ARTICLE_HINTS}')"
_any = lambda f, column, values: "(" + " or ".join(f"{f}({column}, '{v}')" for v in values) + ")"


@query(f"""with w as (select id, title, {_HOST.format("url")} h, lower({_PATH.format("url")}) p, regexp_replace({_HOST.format("url")},
    '^www\\.', '') x, regexp_replace({_HOST.format("base")}, '^www\\.', '') y, len(list_filter(string_split(regexp_replace(coalesce(title,
    ''), '\\s+', ' ', 'g'), ' '), lambda z: z <> '')) n from {_URLS})
    select id from w where (x = y or ends_with(x, '.' || y) or ends_with(y, '.' || x)) and p not in ('', '/') and not {_any("ends_with", "p", U.ASSET_SUFFIXES)}
        and not {_any("contains", "p", U.IGNORED_PARTS)} and not {_any("starts_with", "p", U.ACCOUNT_PARTS)}
    and (not {_any("contains", "h", U.ASSET_HOSTS)} or {_HINT}) and ({_HINT} or regexp_matches(p, '/20[0-9]{{2}}/') or ends_with(p, '.html') or n >= 6)
    and regexp_matches(p, '(?i){_LISTS["include_paths"][0]}') and not regexp_matches(p, '(?i)amp=1') and not regexp_matches(coalesce(title, ''), '(?i)^quiz')""")
def url_candidate_filter(t):
    """Addresses that may be articles and pass their source's lists: hosts and paths to include, paths and titles to exclude."""
    lists = {k: F.array(*map(F.lit, v)).cast("array<string>") for k, v in _LISTS.items()}
    return _urls(t).where(U.is_candidate(F.col("url"), F.col("base"), T.word_count(F.col("title"))) & U.allowed(F.col("url"), F.col("title"), **lists)).select("id")


@query(f"select article_id, substr(sha256(source_id || chr(31) || canonical_url), 1, 24) as own_id from {ARTICLES}")
def stable_ids(t):
    return articles(t).select("article_id", T.stable_id(F.col("source_id"), F.col("canonical_url")).alias("own_id"))


_CLEAN_BODY = "trim(regexp_replace(replace(replace(replace(replace(replace(replace(body, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&amp;', '&'), '[\\s\\x{00A0}]+', ' ', 'g'))"


@query(f"""with k as (select article_id, substr(array_to_string((string_split(regexp_replace({_CLEAN_BODY}, '([.!?…]) ', '\\1\n', 'g'), '\n'))[1:2], ' '), 1, 1600) x from {ARTICLES})
    select article_id, case when trim(x) <> '' then substr(sha256({sql_folded("x")}), 1, 32) end as fingerprint from k""")
def opening_fingerprint(t):
    return articles(t).select("article_id", T.opening_fingerprint(F.col("body")).alias("fingerprint"))


@query(f"""with w as (select article_id, http_status, title, body, case when trim({_SP.format("coalesce(body, '')")}) = ''
    then 0 else len(string_split(trim({_SP.format("body")}), ' ')) end n from {ARTICLES})
    select article_id, cast(n as int) as words, case when n = 0 and http_status in (401, 403, 429) then 'CHALLENGE'
        when n = 0 and http_status >= 400 then 'UNKNOWN' when n > 0 and n < 100 then 'TOO_SHORT' when n >= 100 then 'ARTICLE'
        else 'UNKNOWN' end as kind from w""")
def word_count_gate(t):
    n = F.col("words")
    kind = F.when(
        (n == 0) & F.col("http_status").isin(401, 403, 429),
        "CHALLENGE"
    ).when((n == 0) & (F.col("http_status") >= 400), "UNKNOWN").when((n > 0) & (n < 100), "TOO_SHORT").when(n >= 100, "ARTICLE").otherwise("UNKNOWN")
    return articles(t).select("article_id", "http_status", T.word_count(F.col("body")).alias("words")).select("article_id", "words", kind.alias("kind"))


@query(f"select doc_id, array_to_string(string_split(trim({_SP.format('text')}), ' ')[1:12], ' ') as opening from documents where text is not null")
def first_words(t):
    return t("documents").where("text is not null").select("doc_id", T.first_words(F.col("text"), 12).alias("opening"))


_BASE = f"regexp_replace(translate(replace(lower(w), 'ß', 'ss'), '{T.ACCENTED}', '{T.PLAIN}'), '[^a-z0-9]+', '', 'g')"
_STEM_OF = "case " + " ".join(f"when b like '%{x}' and length(b) - {len(x)} >= 5 then substr(b, 1, length(b) - {len(x)})" for x in T.SUFFIXES) + " else b end"
_COMMON = "(" + ", ".join(f"'{w}'" for w in T.NON_DISTINCTIVE) + ")"
#: Headlines with words without distinction, in several forms, and with letters that have no ASCII base.
PLANTED_HEADLINES = [
    ("h1", "Prezydent i minister: nowe informacje z Polski"),
    ("h2", "Straße nach Łódź, według świata"),
    ("h3", "Europejskiego Trumpa raporty Ångström"),
    ("h4", "Ukrainski wydarzenia energetyczny energia")
]
_HEADLINES = f"(select topic_id, headline_pl from topics union all select * from {sql_values(PLANTED_HEADLINES)} v(topic_id, headline_pl))"


def _headlines(t):
    h = t("topics").select("topic_id", "headline_pl")
    return h.union(h.sparkSession.createDataFrame(PLANTED_HEADLINES, "topic_id string, headline_pl string"))




@query(f"""with w as (select topic_id, unnest(regexp_extract_all(headline_pl, '[\\p{{L}}][\\p{{L}}\\p{{N}}_''-]{{2,}}')) w from {_HEADLINES}), b as (select topic_id, {_BASE} b from w)
    select b as base, count(distinct topic_id) as topics from b where length(b) >= 4 and b not in {_COMMON} and {_STEM_OF} not in {_COMMON} group by b""")
def token_document_frequency(t):
    rows = _headlines(t).select("topic_id", F.explode(T.bases(F.col("headline_pl"))).alias("base"))
    return rows.groupBy("base").agg(F.count_distinct("topic_id").alias("topics"))


@query(f"""with w as (select distinct w from (select unnest(regexp_extract_all(headline_pl, '[\\p{{L}}][\\p{{L}}\\p{{N}}_''-]{{2,}}')) w from {_HEADLINES})), b as (select distinct {_BASE} b from w)
    select b as base, {_STEM_OF} as stem from b where length(b) >= 4 and b not in {_COMMON} and {_STEM_OF} not in {_COMMON}""")
def token_stems(t):
    bases = _headlines(t).select(F.explode(T.bases(F.col("headline_pl"))).alias("base")).distinct()
    return bases.select("base", T.stem(F.col("base")).alias("stem"))


@query("""select topic_id, trim(regexp_replace(regexp_replace(lower(headline_pl), '^\\s*\\[[^\\]]+\\]\\s*', ''),
    '[^\\p{L}\\p{N}]+', ' ', 'g')) as headline_key, regexp_extract(headline_pl, '^\\[([^\\]]+)\\]', 1) as place,
    contains(headline_pl, ',') and headline_pl like '[%' as composite from topics where headline_pl is not null""")
def headline_keys(t):
    h = F.col("headline_pl")
    return t("topics").where(h.isNotNull()).select(
        "topic_id",
        T.headline_key(h).alias("headline_key"),
        F.regexp_extract(h, r"^\[([^\]]+)\]", 1).alias("place"),
        (F.contains(h, F.lit(",")) & h.startswith("[")).alias("composite")
    )


@query("select topic_id, regexp_replace(headline_pl, '^\\[[^\\]]+\\]', '[Europa]') as headline from topics where headline_pl is not null")
def geo_prefix_replace(t):
    return t("topics").where("headline_pl is not null").select("topic_id", F.regexp_replace("headline_pl", r"^\[[^\]]+\]", "[Europa]").alias("headline"))


@query(f"select article_id from {ARTICLES} where regexp_matches(title, '\\p{{Cyrillic}}')")
def cyrillic_titles(t):
    return articles(t).where(T.is_cyrillic(F.col("title"))).select("article_id")


_CLAIM = f"""(select doc_id, source, regexp_replace(trim(regexp_replace(replace(lower(title), 'ß', 'ss'), '[\\s\\x{{00A0}}]+', ' ', 'g')), '[. ]+$', '') as k from documents where title is not null)"""


@query(f"select k as fact_key, 'fact_' || substr(sha256(k), 1, 24) as fact_id, count(distinct doc_id) as support, count(distinct source) as sources from {_CLAIM} where k <> '' group by k")
def fact_dedupe(t):
    """Facts by normalised text with the union of their support."""
    d = t("documents").where("title is not null").select("doc_id", "source", T.text_key(F.col("title")).alias("fact_key")).where("fact_key <> ''")
    by = d.groupBy("fact_key").agg(F.count_distinct("doc_id").alias("support"), F.count_distinct("source").alias("sources"))
    return by.withColumn("fact_id", F.concat(F.lit("fact_"), F.substring(F.sha2("fact_key", 256), 1, 24)))


_STOP = "(" + ", ".join(f"'{w}'" for w in T.CLAIM_STOP) + ")"
_TOKENS = f"list_distinct(list_transform(list_filter(regexp_extract_all(translate(replace(lower(headline_pl), 'ß', 'ss'), '{T.ACCENTED}ł', '{T.PLAIN}l'), '\\p{{L}}{{4,}}'), lambda x: x not in {_STOP}), lambda x: substr(x, 1, 6)))"


@query(f"""with c as (select topic_id, {_TOKENS} a, list_distinct(regexp_extract_all(headline_pl, '\\d+(?:[.,:]\\d+)*')) n,
    regexp_matches(headline_pl, '{ledger.NEGATION}') neg, regexp_replace(trim(regexp_replace(replace(lower(headline_pl),
    'ß', 'ss'), '[\\s\\x{{00A0}}]+', ' ', 'g')), '[. ]+$', '') k from topics where headline_pl is not null),
    p as (select distinct least(trim(topic_id_a), trim(topic_id_b)) x, greatest(trim(topic_id_a), trim(topic_id_b)) y from pairs where trim(topic_id_a) <> trim(topic_id_b))
    select x, y, cast(len(list_intersect(l.a, r.a)) as int) as shared, len(list_intersect(l.a, r.a)) >= least(2,
        len(l.a), len(r.a)) and len(l.a) > 0 and len(r.a) > 0 and len(list_intersect(l.a, r.a)) * 1.0 / least(len(l.a),
        len(r.a)) >= 0.35 as related,
    l.k = r.k or (len(l.n) = len(r.n) and len(list_intersect(l.n, r.n)) = len(l.n) and l.neg = r.neg and len(list_intersect(l.a,
        r.a)) >= least(2, len(l.a), len(r.a)) and len(l.a) > 0 and len(r.a) > 0 and len(list_intersect(l.a, r.a)) * 1.0 / least(len(l.a),
        len(r.a)) >= 0.35) as compatible from p join c l on l.topic_id = x join c r on r.topic_id = y""")
def related_claims(t):
    """Pairs of claims: shared stems, whether they are related, and whether they may be one (numbers and polarity the same too)."""
    c = t("topics").where("headline_pl is not null").select("topic_id", F.col("headline_pl").alias("h"))
    p = t("pairs").select(
        F.trim("topic_id_a").alias("x"),
        F.trim("topic_id_b").alias("y")
    ).where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    j = p.join(c.select(F.col("topic_id").alias("x"), F.col("h").alias("lh")), "x").join(c.select(F.col("topic_id").alias("y"), F.col("h").alias("rh")), "y")
    a, b = T.claim_tokens(F.col("lh")), T.claim_tokens(F.col("rh"))
    return j.select(
        "x",
        "y",
        F.size(F.array_intersect(a, b)).alias("shared"),
        ledger.related(a, b).alias("related"),
        ledger.compatible(F.col("lh"), F.col("rh")).alias("compatible")
    )


_STEMS4 = f"list_distinct(list_transform({_TOKENS}, lambda x: substr(x, 1, 4)))"


@query(f"""with d as (select doc_id, section, list_distinct(list_transform(list_filter(regexp_extract_all(translate(replace(lower(title),
    'ß', 'ss'), '{T.ACCENTED}ł', '{T.PLAIN}l'), '\\p{{L}}{{4,}}'), lambda x: x not in {_STOP}), lambda x: substr(x,
    1, 6))) a from documents where title is not null and section is not null),
    h as (select section, arg_min(a, doc_id) h from d group by section)
    select section, arg_max(doc_id, (len(list_intersect(a, h)), -doc_id)) as doc_id from d join h using (section) group by section""")
def primary_fact(t):
    """Of a source's titles, the one whose stems cover most of its topic's; ties go to the smaller id."""
    d = t("documents").where("title is not null and section is not null").select("doc_id", "section", T.claim_tokens(F.col("title")).alias("a"))
    heads = d.groupBy("section").agg(F.min_by("a", "doc_id").alias("h"))
    j = d.join(heads, "section").select("section", "doc_id", F.size(F.array_intersect("a", "h")).alias("n"))
    return j.groupBy("section").agg(F.max_by("doc_id", F.struct("n", -F.col("doc_id"))).alias("doc_id"))


_SQUEEZED = "trim(regexp_replace(regexp_replace(coalesce({0}, ''), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g'), '[\\s\\x{{0085}}\\x{{00A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+', ' ', 'g'))"
_STRIPPED = "regexp_replace(coalesce({0}, ''), '^[\\s\\x{{00A0}}]+|[\\s\\x{{00A0}}]+$', '', 'g')"
_PAGES = f"(select * from {ARTICLES} where canonical_url is not null)"
_FILE = "'https://' || source_id || '.example/' || coalesce(cast(cast(fetched_at as date) as varchar), 'undated') || '.xml'"


@query(f"""with p as (select canonical_url as url, {_SQUEEZED.format('title')} as title, {_STRIPPED.format('description')} as description,
    {_STRIPPED.format('author')} as author, {_STRIPPED.format('published_at')} as published, canonical_url as canonical,
        array_to_string(list_filter(list_transform(string_split(coalesce(body, ''), chr(10)), lambda x: {_SQUEEZED.format('x')}), lambda x: x <> ''), chr(10)) as body from {_PAGES})
    select *, cast(len(list_filter(string_split(regexp_replace(body, '\\s+', ' ', 'g'), ' '), lambda x: x <> '')) as int) as words from p""")
def page_extract(t):
    """Pages rebuilt from articles, read back: title, description, author, canonical address and text of the main root."""
    return pages.extract_pages(pages.as_pages(articles(t)))


@query(f"""with p as (select canonical_url as url, regexp_extract(canonical_url, '^([a-zA-Z]+://[^/?#]*)', 1) as site from {_PAGES})
    select url, url as href, '' as label, 'canonical' as rel, 0 as place from p union all select url, site || '/',
        'Home', 'a', 1 from p union all select url, site || '/news', 'News', 'a', 2 from p""")
def link_extract(t):
    return pages.page_links(pages.as_pages(articles(t)))


@query(f"select {_FILE} as url, canonical_url as link, {_STRIPPED.format('title')} as title, {_STRIPPED.format('published_at')} as published from {_PAGES} where source_id is not null")
def feed_items(t):
    return pages.read_feeds(pages.as_feeds(articles(t)))


@query(f"""select url, loc, 'url' as kind, min(lastmod) as lastmod from (select {_FILE} as url, canonical_url as loc,
    {_STRIPPED.format('updated_at')} as lastmod from {_PAGES} where source_id is not null) group by 1, 2""")
def sitemap_entries(t):
    return pages.read_sitemaps(pages.as_sitemaps(articles(t)))


@query("select topic_id, cast(timezone('Europe/Warsaw', first_seen_at) as date) as local_day from topics")
def warsaw_day(t):
    return t("topics").select("topic_id", F.to_date(F.from_utc_timestamp("first_seen_at", "Europe/Warsaw")).alias("local_day"))
