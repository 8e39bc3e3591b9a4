"""Projections of topics, articles and sources, stored summaries and the functions on titles and generated texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import topics as P
from ..functions import urls as U
from ..operators import ledger
from .registry import ARTICLES, articles, query, sql_values

_TITLE = P.TITLE.replace("{", "{{").replace("}", "}}")
_SQ = "trim(regexp_replace(coalesce({0}, ''), '[\\s\\x{{00A0}}]+', ' ', 'g'))"
#: Titles in every form, with a title to fall back on.
PLANTED_TITLES = [("p01", "[Polska] Temat bez tytułu", "Sejm przyjął ustawę"), ("p02", "Połączony temat nr 3", "[Francja] Strajk kolei"), ("p03", "[Bośnia i Hercegowina] Wybory", ""), ("p04", "[Polska i Niemcy] Szczyt", ""), ("p05", "[Polska/Czechy]  Most", ""), ("p06", "", "Neutralna nazwa wydarzenia."),
    ("p07", None, None), ("p08", "Bez miejsca", "x"), ("p09", "[Niemcy Zły nawias", "[a] b"), ("p10", "[UK]  Konkretny tytuł!", "Brytyjski rząd upadł"), ("p11", "[A] za krótkie", "y"), ("p12", "Wymaga doprecyzowania tematu", "temat bez tytułu")]
_TITLES = f"(select topic_id, headline_pl, cast(null as varchar) as other from topics union all select * from {sql_values(PLANTED_TITLES)} v(topic_id, headline_pl, other))"
_CORE = f"(case when regexp_matches({_SQ}, '{_TITLE}') then trim(regexp_extract({_SQ}, '{_TITLE}', 2)) else {_SQ} end)"
_PH_KEY = f"regexp_replace(lower({_CORE}), '[.!?]+$', '')"
_PLACEHOLDER = f"({_SQ} = '' or {_PH_KEY} in ({', '.join(repr(x) for x in P.PLACEHOLDERS)}) or " + " or ".join(
    f"starts_with({_PH_KEY}, '{x}')" for x in P.PLACEHOLDER_OPENINGS
) + ")"
_PLACE = "lower(trim(regexp_replace(regexp_extract(trim(coalesce({0}, '')), '" + _TITLE + "', 1), '[\\s\\x{{00A0}}]+', ' ', 'g')))"


def _with_place(x: str, current: str) -> str:
    cut = f"substr({_SQ.format(x)}, 1, 300)"
    own = f"regexp_extract(trim(coalesce({current}, '')), '{P.TITLE}', 1)"
    return f"(case when {cut} = '' or {_PLACEHOLDER.format(cut)} then '' when regexp_matches({cut}, '{P.TITLE}') then {cut} when starts_with({cut}, '[') then '' else substr('[' || case when {own} <> '' then {own} else 'Świat' end || '] ' || {cut}, 1, 300) end)"


def _usable(x: str) -> str:
    return f"(regexp_matches(trim(coalesce({x}, '')), '{P.TITLE}') and not {_PLACEHOLDER.format(x)})"


def _titles(t):
    rows = t("topics").select("topic_id", "headline_pl", F.lit(None).cast("string").alias("other"))
    return rows.union(rows.sparkSession.createDataFrame(PLANTED_TITLES, "topic_id string, headline_pl string, other string"))


@query(f"""with c as (select *, {_with_place('headline_pl', 'headline_pl')} as a, {_with_place('other', 'headline_pl')} as b from {_TITLES})
    select topic_id, {_PLACEHOLDER.format('headline_pl')} as placeholder, {_usable('headline_pl')} as usable, {_PLACE.format('headline_pl')} <> ''
        and {_PLACE.format('headline_pl')} not in ({', '.join(repr(x) for x in P.SINGLE_COUNTRIES)}) and regexp_matches({_PLACE.format('headline_pl')},
        '{P.COMPOSITE}') as composite,
    case when {_usable('a')} then a when {_usable('b')} then b end as title from c""")
def title_predicates(t):
    """Placeholders, usable titles, lists of places, and the title to show: the own one in its form, or the first that can be made into one."""
    h = F.col("headline_pl")
    return _titles(t).select(
        "topic_id",
        P.is_placeholder(h).alias("placeholder"),
        P.is_usable(h).alias("usable"),
        P.has_composite_place(h).alias("composite"),
        P.fallback_title(h, F.col("other")).alias("title")
    )


_CASES = "case " + " ".join(f"when upper({_SQ.format('x')}) = '{k}' then '{v}'" for k, v in P.CATEGORIES.items()) + " end"
PLANTED_CATEGORIES = [("k1", "world;Politics; polityka;HEALTH;economy"), ("k2", "ŚWIAT;świat"), ("k3", ""), ("k4", "Kultura  i Sport;unknown"), ("k5", None)]
_CATS = f"(select source_id as id, string_agg(distinct section, ';' order by section) as given from {ARTICLES} where section is not null group by 1 union all select * from {sql_values(PLANTED_CATEGORIES)} v(id, given))"


@query(f"""with x as (select id, given, unnest(string_split(coalesce(given, ''), ';')) as x, generate_subscripts(string_split(coalesce(given,
    ''), ';'), 1) as k from {_CATS}), c as (select id, {_CASES} as c, k from x), d as (select id, c, min(k) as k
    from c where c is not null group by 1, 2),
    e as (select *, row_number() over (partition by id order by k) as r from d)
    select i.id, coalesce(string_agg(e.c, ';' order by e.r) filter (where e.r <= 3), '') as categories, min(e.c) filter (where e.r = 1) as main from {_CATS} i left join e on e.id = i.id group by 1""")
def topic_categories(t):
    """Known categories by any of their names, each once, the first three in order, and the first alone."""
    own = t("articles").where("section is not null").groupBy(F.col("source_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("section")), ";").alias("given"))
    rows = own.union(own.sparkSession.createDataFrame(PLANTED_CATEGORIES, "id string, given string"))
    c = P.categories(F.split(F.coalesce("given", F.lit("")), ";"))
    return rows.select("id", F.array_join(c, ";").alias("categories"), F.when(F.size(c) > 0, F.element_at(c, 1)).alias("main"))


@query(f"""with n as (select section as topic, substr(title, 1, 220) as title, row_number() over (partition by section
    order by fetched_at desc, article_id desc) k from {ARTICLES} where section is not null and trim(title) <> '')
    select t.topic_id, substr(coalesce(t.headline_pl, ''), 1, 220) as headline_pl, 'Tytuł wątku: ' || substr(trim(coalesce(t.headline_pl,
        '')), 1, 300) || chr(10) || 'Opis: ' || substr(coalesce(trim(n.title), ''), 1, 650) as merge_text
    from topics t left join n on n.k = 1 and n.topic = lower(regexp_extract(t.headline_pl, '^\\[([^\\]]+)\\]', 1))""")
def merge_records(t):
    """Compact records of topics to compare, and the text they are embedded by: title, and a description or else the newest title that belongs to it."""
    k = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("fetched_at"), F.desc("article_id")))
    n = articles(t).where("section is not null and trim(title) <> ''").select(
        F.col("section").alias("topic"),
        "title",
        "fetched_at",
        "article_id"
    ).withColumn("k", k).where("k = 1").select("topic", F.substring("title", 1, 220).alias("title"))
    rows = t("topics").select("topic_id", "headline_pl", F.lower(F.regexp_extract("headline_pl", r"^\[([^\]]+)\]", 1)).alias("topic")).join(n, "topic", "left")
    return rows.select(
        "topic_id",
        F.substring(F.coalesce("headline_pl", F.lit("")), 1, 220).alias("headline_pl"),
        P.merge_text(F.col("headline_pl"), F.lit(None), F.array("title")).alias("merge_text")
    )


@query(f"""select article_id, cast(json_object('article_id', article_id, 'title_original', title, 'source_id', source_id,
    'source_profile', coalesce(source_profile, 'UNCLASSIFIED'), 'language', coalesce(original_language, ''), 'published_at',
    coalesce(published_at, '')) as varchar) as payload,
    array_to_string((string_split(trim(regexp_replace(coalesce(body, ''), '\\s+', ' ', 'g')), ' '))[1:40], ' ') as excerpt from {ARTICLES} where title is not null""")
def request_payloads(t):
    """What is sent of an article: named fields without hash and address, and an excerpt of forty words."""
    fields = F.struct(
        "article_id",
        F.col("title").alias("title_original"),
        "source_id",
        F.coalesce("source_profile", F.lit("UNCLASSIFIED")).alias("source_profile"),
        F.coalesce("original_language", F.lit("")).alias("language"),
        F.coalesce("published_at", F.lit("")).alias("published_at")
    )
    return articles(t).where("title is not null").select("article_id", F.to_json(fields).alias("payload"), T.first_words(F.coalesce("body", F.lit("")), 40).alias("excerpt"))


@query("""with r as (select distinct on (incoming_id) incoming_id, batch_no, coalesce(length(body), 0) as n from incoming_articles order by incoming_id, fetched_at desc, batch_no desc)
    select batch_no, count(*) as rows, sum(n) as chars, case when sum(n) <= 300000 then 'whole' else 'in parts' end as mode from r group by 1""")
def bounded_inputs(t):
    """Inputs of a request: rows by id, the last of repeated ones, their size, and whether they go whole or in parts (never cut)."""
    from ..operators import state

    r = state.latest(
        t("incoming_articles").select("incoming_id", "batch_no", "fetched_at", F.coalesce(F.length("body"), F.lit(0)).alias("n")),
        ["incoming_id"],
        [F.desc("fetched_at"), F.desc("batch_no")]
    )
    return r.groupBy("batch_no").agg(F.count("*").alias("rows"), F.sum("n").alias("chars")).withColumn("mode", F.when(F.col("chars") <= 300000, "whole").otherwise("in parts"))


#: Stored summaries in every format they ever had.
STORED = [
    (
        "s1",
        3,
        '{"base_summary":{"summary_pl":"Base","topic":{"t":1}},"updates":[{"update_id":"u1","status":"NEW_INFORMATION","new_information_pl":"One","generated_at":"2026-01-01T10:00:00+00:00","novelty_audit":{"x":1}},{"run_id":"r2","status":"NO_NEW_INFORMATION","generated_at":"2026-01-02T10:00:00+00:00"},{"update_id":"u1","status":"NEW_INFORMATION","new_information_pl":"One again","generated_at":"2026-01-03T10:00:00+00:00"}]}'
    ),
    ("s2", 2, '{"summary_pl":"Old form","update":{"what_changed_pl":"Legacy\\\\nchange}","run_id":"r9","generated_at":"2026-02-01T10:00:00Z"}}'),
    (
        "s3",
        1,
        '{"base_summary":{"summary_pl":"B3"},"latest_update":{"status":"NEW_INFORMATION","new_information_pl":"Latest <br/> one","update_id":"u7","generated_at":"2026-03-01T10:00:00+00:00"}}'
    ), ("s4", 1, '{"current_summary":{"summary_pl":"C4"}}'), ("s5", 1, "not json"), ("s6", 1, None), ("topic_perspectives_x", 1, '{"perspective_version":1,"updates":[]}'),
]
_STORED = f"(select topic_id, version, case when json_valid(s) then cast(s as json) end as j from {sql_values(STORED)} v(topic_id, version, s))"
_UPDATES = "array<struct<update_id:string,run_id:string,status:string,new_information_pl:string,what_changed_pl:string,generated_at:string>>"


def _stored(t):
    s = t("topics").sparkSession.createDataFrame(STORED, "topic_id string, version int, s string")
    j = lambda p: F.get_json_object("s", p)
    one = F.from_json(F.coalesce(j("$.latest_update"), j("$.update")), _UPDATES[6:-1])
    listed = F.from_json(j("$.updates"), _UPDATES)
    text = F.trim(F.coalesce(T.nonblank(one["new_information_pl"]), T.nonblank(one["what_changed_pl"]), F.lit("")))
    updates = F.when(F.size(F.coalesce(listed, F.array().cast(_UPDATES))) > 0, listed).when(text != "", F.array(one)).otherwise(F.array().cast(_UPDATES))
    return s.withColumn("base", F.coalesce(j("$.base_summary.summary_pl"), j("$.summary_pl"), j("$.current_summary.summary_pl"), F.lit(""))).withColumn("updates", updates)


_PLAIN = "regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace({0}, '\\r\\n', chr(10)), '\\n', chr(10)), '\\r', chr(10)), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '(?i)<\\s*/?\\s*br\\s*/?\\s*>', chr(10), 'g'), '\\s*\\}}+\\s*$', ''), '^\\s+|\\s+$', '', 'g')"
_ALL_UPDATES = f"""(select topic_id, version, case when len(coalesce(json_extract(j, '$.updates[*]'), [])) > 0 then json_extract(j, '$.updates[*]') when trim(coalesce(nullif(coalesce(j->'latest_update', j->'update')->>'new_information_pl', ''), coalesce(j->'latest_update', j->'update')->>'what_changed_pl', '')) <> '' then [coalesce(j->'latest_update', j->'update')] else [] end as u, j from {_STORED})"""


@query(f"""select topic_id, version, coalesce(j->'base_summary'->>'summary_pl', j->>'summary_pl', j->'current_summary'->>'summary_pl',
    '') as base, cast(len(u) as int) as updates, cast(len(list_filter(u, lambda x: coalesce(x->>'status', '') <> 'NO_NEW_INFORMATION')) as int) as prior_updates,
    case when starts_with(topic_id, 'topic_perspectives_') or cast(j->>'perspective_version' as int) = 1 then 'perspectives' else 'legacy' end as generation from {_ALL_UPDATES}""")
def stored_summaries(t):
    """Stored summaries of any format: the base text, the updates (a single legacy one counts), those sent as context, and the generation."""
    s = _stored(t)
    prior = F.filter("updates", lambda x: F.coalesce(x["status"], F.lit("")) != "NO_NEW_INFORMATION")
    new = F.col("topic_id").startswith("topic_perspectives_") | (F.get_json_object("s", "$.perspective_version").try_cast("int") == 1)
    return s.select(
        "topic_id",
        "version",
        "base",
        F.size("updates").alias("updates"),
        F.size(prior).alias("prior_updates"),
        F.when(F.coalesce(new, F.lit(False)), "perspectives").otherwise("legacy").alias("generation")
    )


@query(f"""with x as (select topic_id, version, unnest(u) as u from {_ALL_UPDATES}), y as (select topic_id, {_PLAIN.format("coalesce(nullif(u->>'new_information_pl', ''), u->>'what_changed_pl', '')")} as text,
    case when u->>'update_id' is not null then 'update:' || (u->>'update_id') when u->>'run_id' is not null then 'run:' || (u->>'run_id')
    else 'legacy:' end as identity,
    cast(replace(u->>'generated_at', 'Z', '+00:00') as timestamptz) as seen, version, u->>'status' as status from x)
    select topic_id, identity, text from (select *, row_number() over (partition by topic_id, identity order by seen desc nulls last,
        version desc, text) k from y where text <> '' and coalesce(status, '') <> 'NO_NEW_INFORMATION') where k = 1""")
def collected_updates(t):
    """Updates of all snapshots, the newest of each identity, with their text made plain; updates without news are none."""
    u = _stored(t).select("topic_id", "version", F.explode("updates").alias("u"))
    text = P.plain_generated(F.coalesce(F.when(F.col("u.new_information_pl") != "", F.col("u.new_information_pl")), F.col("u.what_changed_pl"), F.lit("")))
    identity = F.when(
        F.col("u.update_id").isNotNull(),
        F.concat(F.lit("update:"), "u.update_id")
    ).when(F.col("u.run_id").isNotNull(), F.concat(F.lit("run:"), "u.run_id")).otherwise("legacy:")
    at = F.try_to_timestamp(F.replace("u.generated_at", F.lit("Z"), F.lit("+00:00")))
    rows = u.select(
        "topic_id",
        "version",
        text.alias("text"),
        identity.alias("identity"),
        at.alias("at"),
        F.col("u.status").alias("status")
    ).where("text <> '' and coalesce(status, '') <> 'NO_NEW_INFORMATION'")
    w = Window.partitionBy("topic_id", "identity").orderBy(F.desc_nulls_last("at"), F.desc("version"), "text")
    return rows.withColumn("k", F.row_number().over(w)).where("k = 1").select("topic_id", "identity", "text")


#: Generated texts with what a model leaves in them.
PLANTED_GENERATED = [
    ("g1", "Jedno\\nDrugie<br>Trzecie}}"),
    ("g2", "  Według agencji Kurier Lipny: rząd upadł "),
    ("g3", "USA (Stany Zjednoczone Ameryki) i NATO (sojusz) oraz UE ( Unia Europejska )"),
    ("g4", "Czytaj także:"),
    ("g5", None),
    ("g6", "100%_sure*\\"),
    ("g7", "a\r\nb\rc < / BR > d } "),
    ("g8", "Unia Europejska"),
    ("g9", "UE (Unia Europejska.)")
]


@query(f"""select id, {_PLAIN.format("coalesce(x, '')")} as plain, regexp_replace(coalesce(x, ''), '{P.EXPLAINED}',
    '\\1', 'g') as unexplained, regexp_replace(coalesce(x, ''), '(?im)^[ \\t]*Według[ \\t]+(?:(?:agencji|portalu|dziennika|redakcji)[ \\t]+)?(?:Kurier Lipny|La Vega)[ \\t]*[:,][ \\t]*',
    '', 'g') as unattributed,
    regexp_replace(lower({_SQ.format('x')}), '^[ :–—\\-\\t]+|[ :–—\\-\\t]+$', '', 'g') in ({', '.join(repr(x) for x in P.GENERIC_HEADLINES)}) as generic,
        replace(replace(replace(replace(coalesce(x, ''), '\\', '\\\\'), '%', '\\%'), '_', '\\_'), '*', '\\*') as escaped
    from (select topic_id as id, headline_pl as x from topics union all select * from {sql_values(PLANTED_GENERATED)} v(id, x))""")
def generated_texts(t):
    """Generated texts made plain, without needless explanations and publishers; headings that are no titles; and escaped for a pattern."""
    rows = t("topics").select(F.col("topic_id").alias("id"), F.col("headline_pl").alias("x"))
    rows = rows.union(rows.sparkSession.createDataFrame(PLANTED_GENERATED, "id string, x string"))
    x = F.coalesce("x", F.lit(""))
    return rows.select(
        "id",
        P.plain_generated(x).alias("plain"),
        P.without_explanations(x).alias("unexplained"),
        P.without_publishers(x, ["Kurier Lipny", "La Vega"]).alias("unattributed"),
        P.is_generic_headline(x).alias("generic"),
        P.escaped_like(x).alias("escaped")
    )


#: Sources that the table doesn't hold: (id, language, region, profile, kind, enabled, controlled by a state).
PLANTED_SOURCES = [
    ("x1", "", "Ukraine", "", "STATE_MEDIA", True, False),
    ("x2", None, "Nowhere", "state_aligned", "PORTAL", True, False),
    ("x3", "PL_pl", "Germany", "LEFT", "PORTAL", None, None),
    ("x4", None, "Polska", None, None, True, True),
    ("x5", "de", None, " center ", "AGENCY", False, False),
    ("x6", "polski/en", "x", "UNCLASSIFIED", "", True, None)
]
_SRC = f"(select source_id, language, region, editorial_profile, source_type, enabled, false as controlled from sources union all select * from {sql_values(PLANTED_SOURCES)} v(source_id, language, region, editorial_profile, source_type, enabled, controlled))"


@query(f"""select source_id, case when coalesce(language, '') <> '' then language else case lower(coalesce(region,
    '')) {' '.join(f"when '{k}' then '{v}'" for k, v in P.REGION_LANGUAGES.items())} else 'en/original' end end as language,
    coalesce(enabled, true) and not coalesce(controlled, false) and upper(coalesce(source_type, '')) <> 'STATE_MEDIA' as enabled,
        upper(trim(coalesce(editorial_profile, ''))) in ('STATE_ALIGNED', 'STATE_MEDIA', 'STATE') or upper(trim(coalesce(source_type,
        ''))) = 'STATE_MEDIA' as state,
    case when upper(trim(coalesce(editorial_profile, ''))) in ('', 'UNCLASSIFIED') then 'UNCLASSIFIED' else upper(trim(editorial_profile)) end as profile from {_SRC}""")
def source_traits(t):
    """Language (given, or by the region), whether a source is read, whether it is a state's, and its profile."""
    s = t("sources").select("source_id", "language", "region", "editorial_profile", "source_type", "enabled", F.lit(False).alias("controlled"))
    s = s.union(
        s.sparkSession.createDataFrame(
            PLANTED_SOURCES,
            "source_id string, language string, region string, editorial_profile string, source_type string, enabled boolean, controlled boolean"
        )
    )
    kind = F.upper(F.coalesce("source_type", F.lit("")))
    profile = F.upper(F.trim(F.coalesce("editorial_profile", F.lit(""))))
    return s.select(
        "source_id", P.source_language(F.col("language"), F.col("region")).alias("language"), (
            F.coalesce("enabled", F.lit(True)) & ~F.coalesce("controlled", F.lit(False)) & (kind != "STATE_MEDIA")
        ).alias("enabled"),
        F.coalesce(
            ledger.side(F.col("editorial_profile"), F.col("source_type")) == "STATE",
            F.lit(False)
        ).alias("state"), F.when(profile.isin("", "UNCLASSIFIED"), "UNCLASSIFIED").otherwise(profile).alias("profile"),
    )


@query(f"""select title_key, bool_or(not (upper(trim(coalesce(source_profile, ''))) in ('STATE_ALIGNED', 'STATE_MEDIA', 'STATE') or upper(trim(coalesce(source_type, ''))) = 'STATE_MEDIA')) as independent from {ARTICLES} group by 1""")
def independent_sources(t):
    """Whether any source of a title isn't a state's."""
    state = F.coalesce(ledger.side(F.col("source_profile"), F.col("source_type")) == "STATE", F.lit(False))
    return t("articles").groupBy("title_key").agg(F.bool_or(~state).alias("independent"))


@query(f"""with f as (select source_id, count(*) as items, count(*) filter (where trim(coalesce(body, '')) <> '') as bodies,
    count(*) filter (where trim(coalesce(title, '')) <> '') as titles, count(*) filter (where trim(coalesce(author,
    '')) <> '') as authors, round(avg(word_count) filter (where word_count > 0), 1) as avg_words,
        bool_or(regexp_matches(coalesce(body, ''), '{P.CAPTCHA}')) as captcha from {ARTICLES} where fetch_method = 'BROWSER' group by 1)
    select *, case when bodies >= 5 then 'FULL' when items > 0 and bodies > 0 then 'PARTIAL' when captcha then 'CAPTCHA' when items > 0 then 'METADATA_ONLY' else 'FAILED' end as status from f""")
def source_probe(t):
    """What a source's samples gave: successes by field, mean words, signs of a human check, and the technical status."""
    has = lambda c: F.count(F.when(F.trim(F.coalesce(c, F.lit(""))) != "", 1))
    f = articles(t).where("fetch_method = 'BROWSER'").groupBy("source_id").agg(
        F.count("*").alias("items"),
        has("body").alias("bodies"),
        has("title").alias("titles"),
        has("author").alias("authors"),
        F.round(F.avg(F.when(F.col("word_count") > 0, F.col("word_count"))), 1).alias("avg_words"),
        F.bool_or(F.coalesce("body", F.lit("")).rlike(P.CAPTCHA)).alias("captcha")
    )
    return f.withColumn("status", P.technical_status(F.col("items"), F.col("bodies"), F.lit(False), F.col("captcha")))


@query(f"""with d as (select doc_id, list_distinct(regexp_extract_all(coalesce(title, ''), '\\d+(?:[.,:]\\d+)*')) a,
    list_distinct(regexp_extract_all(coalesce(text, ''), '\\d+(?:[.,:]\\d+)*')) b from documents)
    select doc_id, cast(len(a) as int) as numbers, len(list_filter(a, lambda x: not list_contains(b, x))) = 0 as supported from d where len(a) > 0""")
def number_subset(t):
    """Titles all of whose numbers stand in the text."""
    a, b = T.numbers(F.col("title")), T.numbers(F.col("text"))
    return t("documents").select("doc_id", F.size(a).alias("numbers"), (F.size(F.array_except(a, b)) == 0).alias("supported")).where("numbers > 0")


@query(f"""select topic_id, 'topic_perspectives_' || substr(sha256('{{"article_ids":["' || array_to_string(ids,
    '","') || '"],"title":"' || topic_id || '"}}'), 1, 24) as stable_id, 'topic_merge_' || substr(sha256('{{"topic_ids":["' || array_to_string(ids,
    '","') || '"]}}'), 1, 24) as merged_id
    from (select trim(topic_id_a) as topic_id, list_sort(list(distinct trim(topic_id_b))) as ids from pairs where trim(topic_id_a) <> '' and trim(topic_id_b) <> '' group by 1)""")
def digests(t):
    """Ids from the digest of a canonical JSON document: keys in order, compact, members sorted."""
    g = t("pairs").where("trim(topic_id_a) <> '' and trim(topic_id_b) <> ''").groupBy(F.trim("topic_id_a").alias("topic_id")).agg(
        F.array_sort(F.collect_set(F.trim("topic_id_b"))).alias("ids")
    )
    digest = lambda x: F.substring(F.sha2(F.to_json(x), 256), 1, 24)
    return g.select(
        "topic_id",
        F.concat(F.lit("topic_perspectives_"), digest(F.struct(F.col("ids").alias("article_ids"), F.col("topic_id").alias("title")))).alias("stable_id"),
        F.concat(F.lit("topic_merge_"), digest(F.struct(F.col("ids").alias("topic_ids")))).alias("merged_id")
    )


@query(f"""with q as (select article_id, regexp_extract(original_url, '^([^?#]*)', 1) as head, list_filter(string_split(regexp_extract(original_url,
    '\\?([^#]*)', 1), '&'), lambda x: x <> '' and lower(regexp_extract(x, '^([^=]*)', 1)) not in ('lang', 'ref')) as kept
    from {ARTICLES})
    select article_id, head || case when len(kept) > 0 then '?' || array_to_string(list_transform(kept, lambda x: case
        when contains(x, '=') then x else x || '=' end), '&') else '' end as url from q""")
def stripped_addresses(t):
    """Addresses without the query keys that a source's list names."""
    return articles(t).select("article_id", U.strip_query_keys(F.col("original_url"), F.array(F.lit("Lang "), F.lit("ref"), F.lit(""))).alias("url"))


@query("""select topic_id, epoch_us(last_seen_at) // 1000 as at_ms, case when last_seen_at >= timestamptz '2026-07-01 00:00:00+00'
    then 'second' else 'first' end as model from topics where last_seen_at is not null""")
def activity_times(t):
    """A topic's time read back from its ISO text (without a zone: UTC), and the model in force by then."""
    text = F.date_format("last_seen_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    at = F.try_to_timestamp(F.replace(text, F.lit("Z"), F.lit("+00:00")))
    return t("topics").where("last_seen_at is not null").select(
        "topic_id",
        F.unix_millis(at).alias("at_ms"),
        F.when(at >= F.to_timestamp(F.lit("2026-07-01 00:00:00+00:00")), "second").otherwise("first").alias("model")
    )


@query(f"""select article_id, case when content_status = 'CAPTCHA' then 'CHALLENGE/CAPTCHA' when trim(coalesce(body,
    '')) = '' and http_status in (401, 403, 406, 407, 408, 429, 451) then 'CHALLENGE/BLOCKED' when trim(coalesce(body,
    '')) = '' and http_status >= 400 then 'UNKNOWN/FAILED'
    when word_count > 0 and word_count < 100 then 'TOO_SHORT/TOO_SHORT' when trim(coalesce(body, '')) <> '' and content_status = 'COMPLETE'
        then 'ARTICLE/COMPLETE' when trim(coalesce(title, '')) <> '' and coalesce(word_count, 0) >= 100 then 'ARTICLE_EXCERPT/EXCERPT'
    when http_status in (401, 403, 406, 407, 408, 429, 451) then 'CHALLENGE/BLOCKED' when trim(coalesce(title, '')) <> ''
        then 'UNKNOWN/METADATA_ONLY' else 'UNKNOWN/FAILED' end as kind from {ARTICLES}""")
def item_kinds(t):
    """Kind and status of what was fetched, by the first rule that holds."""
    blank = F.trim(F.coalesce("body", F.lit(""))) == ""
    title = F.trim(F.coalesce("title", F.lit(""))) != ""
    blocked = F.coalesce(F.col("http_status").isin(401, 403, 406, 407, 408, 429, 451), F.lit(False))
    words = F.coalesce("word_count", F.lit(0))
    kind = (
        F.when(
            F.col("content_status") == "CAPTCHA",
            "CHALLENGE/CAPTCHA"
        ).when(blank & blocked, "CHALLENGE/BLOCKED").when(blank & (F.col("http_status") >= 400), "UNKNOWN/FAILED").when((words > 0) & (words < 100), "TOO_SHORT/TOO_SHORT")
        .when(
            ~blank & (F.col("content_status") == "COMPLETE"),
            "ARTICLE/COMPLETE"
        ).when(title & (words >= 100), "ARTICLE_EXCERPT/EXCERPT").when(blocked, "CHALLENGE/BLOCKED").when(title, "UNKNOWN/METADATA_ONLY").otherwise("UNKNOWN/FAILED")
    )
    return articles(t).select("article_id", kind.alias("kind"))


#: Lists of ids as typed: separators, repetitions, too few, too many, signs that no id has.
PLANTED_LISTS = [("l1", "a, b  a\nc"), ("l2", "one"), ("l3", " x , y "), ("l4", "a,b!"), ("l5", ""), ("l6", ",".join(f"t{k}" for k in range(21))), ("l7", "t-1,t_2"), ("l8", None)]


@query(f"""with s as (select id, list_filter(string_split(regexp_replace(trim(regexp_replace(coalesce(x, ''), '\\s+',
    ' ', 'g')), '[ ,]+', ',', 'g'), ','), lambda y: y <> '') as parts from {sql_values(PLANTED_LISTS)} v(id, x)),
    u as (select id, unnest(parts) as p, generate_subscripts(parts, 1) as k from s), d as (select id, p, min(k) as k
    from u group by 1, 2)
    select s.id, coalesce(string_agg(d.p, ',' order by d.k), '') as ids, count(d.p) between 2 and 20 and bool_and(regexp_matches(d.p,
        '^[A-Za-z0-9_-]{{1,128}}$')) as valid from s left join d on d.id = s.id group by 1""")
def parsed_ids(t):
    """Lists of ids as typed: each once, in order; valid are two to twenty of letters, digits, _ and -."""
    rows = t("topics").sparkSession.createDataFrame(PLANTED_LISTS, "id string, x string")
    ids = F.array_distinct(F.filter(F.split(F.coalesce("x", F.lit("")), r"[\s,]+"), lambda y: y != ""))
    good = F.size(ids).between(2, 20) & F.forall(ids, lambda y: y.rlike(r"^[A-Za-z0-9_-]{1,128}$"))
    return rows.select("id", F.array_join(ids, ",").alias("ids"), good.alias("valid"))


@query(f"""select 'articles' as name, count(*) as rows, count(*) - count(distinct article_id) as repeated, count(*) filter (where trim(coalesce(body, '')) = '') as blank from articles union all
    select 'incoming_articles', count(*), count(*) - count(distinct incoming_id), count(*) filter (where trim(coalesce(body, '')) = '') from incoming_articles union all
    select 'documents', count(*), count(*) - count(distinct doc_id), count(*) filter (where trim(coalesce(text, '')) = '') from documents""")
def snapshot_checks(t):
    """What a snapshot is checked for: rows, repeated or missing ids, blank texts."""
    out = None
    for name, key, text in (("articles", "article_id", "body"), ("incoming_articles", "incoming_id", "body"), ("documents", "doc_id", "text")):
        row = t(name).agg(
            F.lit(name).alias("name"),
            F.count("*").alias("rows"),
            (F.count("*") - F.count_distinct(key)).alias("repeated"),
            F.count(F.when(F.trim(F.coalesce(text, F.lit(""))) == "", 1)).alias("blank")
        )
        out = row if out is None else out.unionByName(row)
    return out


@query("""with i as (select distinct on (incoming_id) incoming_id, batch_no, source_id, canonical_url, body from incoming_articles),
    k as (select distinct source_id, canonical_url, true as known from articles)
    select batch_no, count(*) as fetched, count(*) filter (where known) as known, count(*) filter (where known is null
        and trim(coalesce(body, '')) <> '') as fresh, 'fetched: ' || count(*) || ', known: ' || count(*) filter (where known) as line
        from i left join k on k.source_id = i.source_id and k.canonical_url = i.canonical_url group by 1""")
def run_counters(t):
    """Counters of each run and the line that reports them."""
    k = t("articles").select("source_id", "canonical_url", F.lit(True).alias("known")).distinct()
    i = t("incoming_articles").dropDuplicates(["incoming_id"]).select(
        "incoming_id",
        "batch_no",
        "source_id",
        "canonical_url",
        (F.trim(F.coalesce("body", F.lit(""))) != "").alias("filled")
    )
    by = i.join(k, ["source_id", "canonical_url"], "left").groupBy("batch_no").agg(
        F.count("*").alias("fetched"),
        F.count("known").alias("known"),
        F.count(F.when(F.col("known").isNull() & F.col("filled"), 1)).alias("fresh")
    )
    return by.withColumn("line", F.concat(F.lit("fetched: "), "fetched", F.lit(", known: "), "known"))


@query("""with x as (select doc_id, coalesce(text, '') as raw from documents)
    select doc_id, case when length(raw) > 400 then cast(json_object('parsed', false, 'raw_response', substr(raw, 1, 20000)) as varchar)
        else cast(json_object('parsed', true, 'raw_response', '') as varchar) end as stored from x""")
def stored_responses(t):
    """Answers as they are stored: the parsed form, or of one that couldn't be read (here a text of over 400 signs) its first 20 000 signs."""
    raw = F.coalesce("text", F.lit(""))
    failed = F.struct(F.lit(False).alias("parsed"), F.substring(raw, 1, 20000).alias("raw_response"))
    whole = F.struct(F.lit(True).alias("parsed"), F.lit("").alias("raw_response"))
    return t("documents").select("doc_id", F.to_json(F.when(F.length(raw) > 400, failed).otherwise(whole)).alias("stored"))


@query("""with b as (select source_id, batch_no, string_agg(distinct incoming_id, ',' order by incoming_id) as ids
    from incoming_articles where batch_no is not null group by 1, 2), l as (select source_id, list(ids order by batch_no) as l,
    list(batch_no order by batch_no) as n from b group by 1)
    select source_id, cast(len(l) as int) as batches, list_reduce(list_prepend('', l), lambda a, x: sha256(a || '|' || x)) as context from l""")
def carried_context(t):
    """Batches folded in order, each with the context that the ones before left (a source has a batch a run, so the fold is short)."""
    b = t("incoming_articles").where("batch_no is not null").groupBy("source_id", "batch_no").agg(F.array_join(F.array_sort(F.collect_set("incoming_id")), ",").alias("ids"))
    l = b.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("batch_no", "ids"))).alias("l"))
    return l.select("source_id", F.size("l").alias("batches"), F.aggregate("l", F.lit(""), lambda a, x: F.sha2(F.concat(a, F.lit("|"), x["ids"]), 256)).alias("context"))


@query(f"""with x as (select topic_id, version, unnest(u) as u, generate_subscripts(u, 1) as k from {_ALL_UPDATES}),
    y as (select *, case when u->>'update_id' is not null then 'update:' || (u->>'update_id') when u->>'run_id' is not null
    then 'run:' || (u->>'run_id') else 'legacy:' end as identity, coalesce(u->>'new_information_pl', '') as text
    from x)
    select topic_id, version, string_agg(case when identity in ('update:u1', 'run:r9') then 'rewritten ' || identity else text end, ';' order by k) as texts from y group by 1, 2""")
def rewritten_updates(t):
    """Stored updates with the text of some identities replaced, everything else as it was and in its order."""
    spark = t("topics").sparkSession
    new = spark.createDataFrame([("update:u1", "rewritten update:u1"), ("run:r9", "rewritten run:r9")], "identity string, fresh string")  # a few rows
    u = _stored(t).select("topic_id", "version", F.posexplode("updates").alias("k", "u"))
    identity = F.when(
        F.col("u.update_id").isNotNull(),
        F.concat(F.lit("update:"), "u.update_id")
    ).when(F.col("u.run_id").isNotNull(), F.concat(F.lit("run:"), "u.run_id")).otherwise("legacy:")
    rows = u.withColumn("identity", identity).join(F.broadcast(new), "identity", "left").select(
        "topic_id",
        "version",
        F.struct("k", F.coalesce("fresh", "u.new_information_pl", F.lit("")).alias("x")).alias("e")
    )
    return rows.groupBy("topic_id", "version").agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["x"]), ";").alias("texts"))


_CLAIM_TOKENS = f"list_distinct(list_transform(list_filter(regexp_extract_all(translate(replace(lower(headline_pl), 'ß', 'ss'), '{T.ACCENTED}ł', '{T.PLAIN}l'), '\\p{{L}}{{4,}}'), lambda x: x not in ({', '.join(repr(x) for x in T.CLAIM_STOP)})), lambda x: substr(x, 1, 6)))"


@query(f"""with c as (select topic_id, {_CLAIM_TOKENS} a from topics where headline_pl is not null), p as (select distinct trim(topic_id_a) x,
    trim(topic_id_b) y from pairs where trim(topic_id_a) <> trim(topic_id_b)),
    s as (select p.x, p.y, len(list_intersect(l.a, r.a)) as shared from p join c l on l.topic_id = p.x join c r on r.topic_id = p.y)
    select x as topic_id, y as known_id, shared, k as place from (select *, row_number() over (partition by x order by shared desc, y) k from s) where k <= 8""")
def nearest_facts(t):
    """The eight known claims nearest to each candidate, by shared stems, among those it was scored with."""
    c = t("topics").where("headline_pl is not null").select("topic_id", T.claim_tokens(F.col("headline_pl")).alias("a"))
    p = t("pairs").select(F.trim("topic_id_a").alias("x"), F.trim("topic_id_b").alias("y")).where("x <> y").distinct()
    j = p.join(c.select(F.col("topic_id").alias("x"), F.col("a").alias("la")), "x").join(c.select(F.col("topic_id").alias("y"), F.col("a").alias("ra")), "y")
    k = F.row_number().over(Window.partitionBy("x").orderBy(F.desc("shared"), "y"))
    return j.select(
        "x",
        "y",
        F.size(F.array_intersect("la", "ra")).cast("bigint").alias("shared")
    ).withColumn("place", k.cast("bigint")).where("place <= 8").select(F.col("x").alias("topic_id"), F.col("y").alias("known_id"), "shared", "place")
