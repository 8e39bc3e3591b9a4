"""Ledger queries: claims, lanes, updates, read marks and usage sums."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ledger, state
from .registry import ARTICLES, articles, query, sql_values

_KEY = "regexp_replace(trim(regexp_replace(replace(lower(title), 'ß', 'ss'), '[\\s\\x{00A0}]+', ' ', 'g')), '[. ]+$', '')"
#: Claims that the tables don't hold: (topic, text, kind, article, profile, kind of source), so that every lane has some.
PLANTED_CLAIMS = [("mixed", "Left says.", "FACT", "x1", "LEFT", "PORTAL"), ("mixed", "Right says", "FACT", "x2", "CENTER_RIGHT", "PORTAL"), ("mixed", "both say", "FACT", "x1", "LEFT", "PORTAL"), ("mixed", "Both  say.", "EDITORIAL", "x2", "RIGHT", "PORTAL"),
    ("mixed", "State says", "FACT", "x3", "STATE_MEDIA", "PORTAL"), ("mixed", "Opinion", "EDITORIAL", "x1", "LEFT", "PORTAL"), (
        "one side",
        "Left alone",
        "FACT",
        "y1",
        "CENTER_LEFT",
        "AGENCY"
    ), ("one side", "State too", "FACT", "y2", "CENTER", "STATE_MEDIA"),
    ("center", "Center says", "FACT", "z1", "CENTER", "PORTAL"), ("center", "Left says", "FACT", "z2", "LEFT", "PORTAL"), ("center", "", "FACT", "z3", "LEFT", "PORTAL")]


def _claims(t):
    kind = F.when(F.col("section").isin("opinion", "opinie", "meinung", "opinioni", "idees"), "EDITORIAL").otherwise("FACT")
    return articles(t).select(
        F.col("source_type").alias("topic"),
        F.col("title").alias("text"),
        kind.alias("kind"),
        "article_id",
        F.col("source_profile").alias("profile"),
        "source_type"
    )


_CLAIMS = f"""(select source_type as topic, title, case when section in ('opinion', 'opinie', 'meinung', 'opinioni',
    'idees') then 'EDITORIAL' else 'FACT' end as kind, article_id, source_profile as profile, source_type from {ARTICLES}
    union all select * from {sql_values(PLANTED_CLAIMS)} v(topic, title, kind, article_id, profile, source_type))"""


@query(f"""with c as (select topic, {_KEY} as fact_key, title, kind, article_id, case when upper(trim(coalesce(profile,
    ''))) in ('STATE_ALIGNED', 'STATE_MEDIA', 'STATE') or upper(trim(coalesce(source_type, ''))) = 'STATE_MEDIA'
    then 'STATE'
        when upper(trim(profile)) in ('LEFT', 'CENTER_LEFT') then 'LEFT' when upper(trim(profile)) in ('RIGHT',
            'CENTER_RIGHT') then 'RIGHT' when upper(trim(profile)) = 'CENTER' then 'CENTER' end as side from {_CLAIMS}),
    k as (select * from c where fact_key <> '' and side is not null),
    m as (select topic, count(distinct side) filter (where side <> 'STATE') = 1 as single from k group by 1),
    g as (select topic, fact_key, arg_min(title, (article_id, title, kind)) as text, arg_min(kind, (article_id,
        title, kind)) as kind, bool_or(side = 'LEFT') as l, bool_or(side = 'RIGHT') as r, bool_or(side = 'CENTER') as c,
        count(distinct article_id) as support from k group by 1, 2)
    select g.topic, 'fact_' || substr(sha256(fact_key), 1, 24) as fact_id, fact_key, text, kind, case when kind = 'EDITORIAL'
        then 'EDITORIAL' when not (l or r or c) then 'STATE' when c or (l and r) or single then 'COMMON' when l
        then 'LEFT' else 'RIGHT' end as lane, support
    from g join m on m.topic = g.topic""")
def lane_routing(t):
    """Claims by lane: with the center, with both sides or where one side reports alone common, else the side's own."""
    planted = t("articles").sparkSession.createDataFrame(PLANTED_CLAIMS, "topic string, text string, kind string, article_id string, profile string, source_type string")
    return ledger.route_claims(_claims(t).unionByName(planted))


@query(f"""with f as (select source_type as topic, {_KEY} as k, article_id from {ARTICLES}), m as (select case when topic = 'PORTAL'
    then 'NEWSPAPER' else topic end as topic, k as fact_key, article_id from f where k <> '')
    select topic, fact_key, count(distinct article_id) as support, min(article_id) as first_article from m group by 1, 2""")
def publication_merge(t):
    facts = _claims(t).select("topic", T.text_key(F.col("text")).alias("fact_key"), "article_id").where("fact_key <> ''")
    mapping = t("articles").sparkSession.createDataFrame([("PORTAL", "NEWSPAPER")], "old string, canonical string")
    return ledger.merge_publications(facts, mapping)


@query(f"""select a.source_id, a.article_id from {ARTICLES} a where a.fetched_at >= timestamptz '2026-06-01 00:00:00+00' and {_KEY.replace('title', 'a.title')} not in
    (select {_KEY} from articles where fetched_at < timestamptz '2026-06-01 00:00:00+00')""")
def novelty_newness(t):
    """Claims that no earlier publication has."""
    a = articles(t).select("source_id", "article_id", "fetched_at", T.text_key(F.col("title")).alias("k"))
    edge = F.to_timestamp(F.lit("2026-06-01 00:00:00+00:00"))
    return a.where(F.col("fetched_at") >= edge).join(a.where(F.col("fetched_at") < edge).select("k"), "k", "left_anti").where("k is not null").select("source_id", "article_id")


#: Claims with the forms that are no claims, and with negations, quantities and times.
PLANTED_TEXTS = [("c01", "Brak"), ("c02", "Ile to ma 12? kosztować"), ("c03", "Start o 12:? jutro"), ("c04", "Tak/nie? nie wiadomo"), ("c05", "Bez nowych informacji w sprawie"), ("c06", "Dodał prokurator, że"), ("c07", "Stwierdziłem to wczoraj"),
    ("c08", "Nie zginął nikt"), ("c09", "Zginęło 1,5 tysiąca osób"), ("c10", "Spotkanie o 12:30 w Łodzi"), ("c11", "Kto to?? nie wiadomo"), ("c12", "On sam nie przyszedł"), ("c13", "Niebo bezchmurne dziś")]
_OPEN = ledger.OPEN_CLAIM.replace("(?<![\\p{L}\\p{N}_])", "(?:^|[^\\p{L}\\p{N}_])").replace("(?![\\p{L}\\p{N}_])", "(?:$|[^\\p{L}\\p{N}_])")
_CONT = ledger.CONTINUES.replace("(?![\\p{L}\\p{N}_])", "(?:$|[^\\p{L}\\p{N}_])")


@query(f"""with h as (select topic_id, headline_pl as x from topics where headline_pl is not null union all select * from {sql_values(PLANTED_TEXTS)} v(topic_id, x))
    select topic_id, len(list_filter(string_split(regexp_replace(trim(x), '\\s+', ' ', 'g'), ' '), lambda y: y <> '')) >= 2
        and not regexp_matches(trim(x), '{_OPEN}') and not regexp_matches(trim(x), '{_CONT}') as usable,
    regexp_matches(x, '{ledger.NEGATION}') as negated, array_to_string(list_sort(list_distinct(regexp_extract_all(x, '\\d+(?:[.,:]\\d+)*'))), ';') as numbers from h""")
def claim_predicates(t):
    h = F.col("x")
    rows = t("topics").where("headline_pl is not null").select("topic_id", F.col("headline_pl").alias("x"))
    rows = rows.union(rows.sparkSession.createDataFrame(PLANTED_TEXTS, "topic_id string, x string"))
    return rows.select("topic_id", ledger.usable_claim(h).alias("usable"), ledger.negated(h).alias("negated"), F.array_join(F.array_sort(T.numbers(h)), ";").alias("numbers"))


@query("select distinct on (user_id, event_type) user_id, event_type, event_id, value from events order by user_id, event_type, ts desc, event_id desc")
def newest_per_identity(t):
    return state.latest(t("events").select("user_id", "event_type", "event_id", "value", "ts"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).drop("ts")


@query("""with v as (select user_id, max(ts) filter (where event_type = 'view') as seen from events group by 1)
    select e.user_id, count(*) filter (where v.seen is null or e.ts > v.seen) as unread, case when max(v.seen) is null
        then 'NEVER_READ' when count(*) filter (where e.ts > v.seen) > 0 then 'UPDATED' else 'READ' end as mark
        from events e join v on v.user_id = e.user_id group by e.user_id""")
def read_marks(t):
    e = t("events").select("user_id", "ts", "event_type")
    seen = e.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "view", F.col("ts"))).alias("seen"))
    later = F.col("ts") > F.col("seen")
    return e.join(seen, "user_id").groupBy("user_id").agg(
        F.count(
            F.when(F.col("seen").isNull() | later, 1)
        ).alias("unread"), F.when(F.max("seen").isNull(), "NEVER_READ").when(F.count(F.when(later, 1)) > 0, "UPDATED").otherwise("READ").alias("mark")
    )


#: Prices for a million tokens of input, cached input and output by model; a model that isn't listed has none.
PRICES = [("view", 2.0, 0.5, 8.0), ("purchase", 1.0, 0.25, 4.0), ("click", 0.5, 0.1, 2.0)]


@query(f"""with u as (select user_id, event_type || case when event_id % 2 = 0 then '-2026-03-01' else '' end as model,
    cast(floor(value) as bigint) as input, cast(json_extract_string(props, '$.k') as bigint) as cached, cast(floor(value / 4) as bigint) as output
    from events),
    p as (select u.*, least(coalesce(cached, 0), input) as c, price, cached_price, output_price from u left join {sql_values(PRICES)} v(model,
        price, cached_price, output_price) on v.model = regexp_replace(u.model, '-\\d{{4}}-\\d{{2}}-\\d{{2}}$',
        '')),
    k as (select *, ((input - c) * price + c * cached_price + output * output_price) / 1000000 as cost from p)
    select user_id, sum(input) as input_tokens, sum(cached) as cached_tokens, sum(output) as output_tokens, round(coalesce(sum(cost),
        0), 9) as known_cost, bool_and(cost is not null) as cost_complete from k group by user_id""")
def usage_sums(t):
    """Token sums and their cost, cached input apart; dated names of a model have its price, an unknown model none, which makes the cost incomplete."""
    prices = t("events").sparkSession.createDataFrame(PRICES, "base string, price double, cached_price double, output_price double")  # a few rows
    dated = F.when(F.col("event_id") % 2 == 0, F.concat("event_type", F.lit("-2026-03-01"))).otherwise(F.col("event_type"))
    u = t("events").select(
        "user_id",
        F.regexp_replace(dated, r"-\d{4}-\d{2}-\d{2}$", "").alias("base"),
        F.floor("value").alias("input"),
        F.get_json_object("props", "$.k").try_cast("bigint").alias("cached"),
        F.floor(F.col("value") / 4).alias("output")
    )
    c = F.least(F.coalesce("cached", F.lit(0)), F.col("input"))
    cost = ((F.col("input") - c) * F.col("price") + c * F.col("cached_price") + F.col("output") * F.col("output_price")) / 1_000_000
    k = u.join(F.broadcast(prices), "base", "left").withColumn("cost", cost)
    return k.groupBy("user_id").agg(
        F.sum("input").alias("input_tokens"),
        F.sum("cached").alias("cached_tokens"),
        F.sum("output").alias("output_tokens"),
        F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 9).alias("known_cost"),
        F.bool_and(F.col("cost").isNotNull()).alias("cost_complete")
    )


@query("with p as (select trim(topic_id_a) a, list(distinct trim(topic_id_b)) as e from pairs where trim(topic_id_a) is not null and trim(topic_id_b) is not null group by 1), s as (select distinct trim(topic_id_b) b from pairs where \"current\" >= 0.9 and not isnan(\"current\")) select a as topic_id from p where exists (select 1 from s where list_contains(p.e, s.b))")
def saved_by_evidence(t):
    """Topics whose evidence holds any saved id: exploded and semi-joined, not compared list by list."""
    p = t("pairs").select(F.trim("topic_id_a").alias("topic_id"), F.trim("topic_id_b").alias("b"), "current").where("topic_id is not null and b is not null")
    return p.join(
        p.where("current >= 0.9 and not isnan(current)").select("b").distinct().union(
            t("pairs").where("current >= 0.9 and not isnan(current)").select(F.trim("topic_id_b"))
        ),
        "b",
        "left_semi"
    ).select("topic_id").distinct()


@query("select event_id, cast(json(props) as varchar) as object from events")
def answer_objects(t):
    """Objects read from answers with talk and fences around them (built here from the event properties)."""
    wrapped = F.concat(F.lit("Sure {here}:\n```json\n"), "props", F.lit("\n``` done"))
    return ledger.with_first_json(t("events").select("event_id", wrapped.alias("answer")), "answer", ["event_id"])


@query(f"""with recursive i as (select source_id || '/' || cast(cast(fetched_at as date) as varchar) as grp, article_id,
    coalesce(length(body), 0) as n from {ARTICLES} where source_id is not null and fetched_at is not null), k as (select *,
    row_number() over (partition by grp order by article_id) k from i),
    r as (select grp, article_id, k, cast(0 as bigint) as batch_no, cast(n as bigint) as filled, cast(1 as bigint) as held from k where k = 1
        union all select k.grp, k.article_id, k.k, case when filled + n > 12000 or held >= 8 then batch_no + 1 else batch_no end,
            case when filled + n > 12000 or held >= 8 then n else filled + n end, case when filled + n > 12000 or held >= 8
            then 1 else held + 1 end from r join k on k.grp = r.grp and k.k = r.k + 1)
    select grp, article_id, cast(batch_no as int) as batch_no from r""")
def article_batches(t):
    """Whole articles in request batches by source and day: up to 12 000 characters and 8 articles."""
    rows = articles(t).where("source_id is not null and fetched_at is not null").select(
        F.concat_ws("/", "source_id", F.to_date("fetched_at")).alias("grp"),
        "article_id",
        F.length("body").alias("chars")
    )
    return ledger.ordered_batches(rows, "grp", "article_id", "chars", 12000, 8)


@query(f"""select t.title_key, t.n as article_count, t.n = 1 and bool_and(a.author is null or trim(a.author) = '') as needs_review
    from (select title_key, count(*) n from {ARTICLES} group by 1) t join {ARTICLES} a on a.title_key = t.title_key
    group by 1, 2""")
def review_marks(t):
    return articles(t).groupBy("title_key").agg(
        F.count("*").alias("article_count"),
        F.bool_and(F.col("author").isNull() | (F.trim("author") == "")).alias("bare")
    ).select("title_key", "article_count", ((F.col("article_count") == 1) & F.col("bare")).alias("needs_review"))
