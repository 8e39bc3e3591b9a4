"""Joins, set operations, state tables and time windows of the store."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import state
from .registry import ARTICLES, INCOMING, articles, query, sql_folded, sql_values


@query(f"""select i.incoming_id, coalesce(min(a.article_id), min(al.duplicate_of_article_id)) as article_id from {INCOMING} i
    left join {ARTICLES} a on a.source_id = i.source_id and a.canonical_url = i.canonical_url
    left join article_url_aliases al on al.source_id = i.source_id and al.candidate_url = i.canonical_url group by 1""")
def alias_lookup(t):
    """The article of an address, directly or else by an alias."""
    i = t("incoming_articles").dropDuplicates(["incoming_id"]).select("incoming_id", "source_id", F.col("canonical_url").alias("url"))
    own = t("articles").groupBy("source_id", F.col("canonical_url").alias("url")).agg(F.min("article_id").alias("own"))
    other = t("article_url_aliases").groupBy("source_id", F.col("candidate_url").alias("url")).agg(F.min("duplicate_of_article_id").alias("other"))
    return i.join(own, ["source_id", "url"], "left").join(other, ["source_id", "url"], "left").select("incoming_id", F.coalesce("own", "other").alias("article_id"))


_BODY = "trim(regexp_replace(replace(replace(replace(replace(replace(replace(body, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&amp;', '&'), '[\\s\\x{00A0}]+', ' ', 'g'))"
_OPENING = f"substr(array_to_string((string_split(regexp_replace({_BODY}, '([.!?…]) ', '\\1\n', 'g'), '\n'))[1:2], ' '), 1, 1600)"


#: Copies that the tables don't hold: (id, source, title key, body, status), all seen at one time.
PLANTED_COPIES = [
    ("c1", "s", "k", "First sentence here. Second one follows! Then more.", "COMPLETE"),
    ("c2", "s", "k", "FIRST  sentence\u00a0here. second one follows! Other text.", "EXCERPT"),
    ("c3", "t", "k", "First sentence here. Second one follows! Then more.", "COMPLETE"),
    ("c4", "s", "other", "First sentence here. Second one follows! Then more.", "COMPLETE"),
    ("c5", "s", "k", "First sentence here. Second one follows! Then more.", "FAILED"),
    ("c6", "s", "k", "Straße… And &amp; more. Tail", "COMPLETE"),
    ("c7", "s", "k", "STRASSE... and & more. tail", "COMPLETE"),
    ("c8", "s", "k", " ", "COMPLETE"),
    ("c9", "s", "k", " ", "COMPLETE"),
]
_COPIES = f"""(select article_id, source_id, title_key, body, content_status, first_seen_at from {ARTICLES}
    union all select *, timestamptz '2026-01-01 00:00:00+00' from {sql_values(PLANTED_COPIES)} v(article_id, source_id, title_key, body, content_status))"""


@query(f"""with a as (select article_id, source_id, title_key, sha256({sql_folded(_OPENING)}) as opening, first_seen_at from {_COPIES}
        where content_status in ('COMPLETE', 'EXCERPT') and title_key <> '' and trim({_BODY}) <> '' and source_id is not null)
    select article_id, canonical_id from (select article_id, first_value(article_id) over (partition by source_id,
        title_key, opening order by first_seen_at nulls last, article_id) as canonical_id from a) where article_id <> canonical_id""")
def logical_duplicates(t):
    """Articles of one source, title key and opening (two sentences, case and spacing aside), complete or excerpts; the first seen stands for the rest."""
    a = articles(t).select("article_id", "source_id", "title_key", "body", "content_status", "first_seen_at")
    planted = a.sparkSession.createDataFrame(PLANTED_COPIES, "article_id string, source_id string, title_key string, body string, content_status string")
    return _logical(a.unionByName(planted.withColumn("first_seen_at", F.to_timestamp(F.lit("2026-01-01 00:00:00+00:00")))))


def _logical(a):
    a = a.where("article_id is not null and source_id is not null and title_key <> '' and content_status in ('COMPLETE', 'EXCERPT')")
    a = a.select("article_id", "source_id", "title_key", T.opening_fingerprint(F.col("body")).alias("opening"), "first_seen_at").where("opening is not null")
    first = a.groupBy("source_id", "title_key", "opening").agg(F.min(F.struct(F.col("first_seen_at").isNull(), "first_seen_at", "article_id")).alias("m"))
    return a.join(first, ["source_id", "title_key", "opening"]).select("article_id", F.col("m.article_id").alias("canonical_id")).where("article_id <> canonical_id")


@query(f"""select incoming_id from (select incoming_id, row_number() over (order by fetched_at, incoming_id) as k from {INCOMING} a
    where fetched_at >= (select max(fetched_at) from incoming_articles) - interval 24 hour and not exists (select 1
        from article_url_aliases x where x.source_id = a.source_id and x.candidate_url = a.canonical_url)
    and not starts_with(coalesce(title, ''), 'AI_EXCLUDED:') and not starts_with(coalesce(title, ''), 'AI_REVIEW:OPENAI_CONTENT_POLICY:')) where k <= 200""")
def pending_antijoin(t):
    """The queue: not older than 24 hours before the newest, not known by an alias, not marked as excluded; the first 200 in order of fetching."""
    a = t("incoming_articles").dropDuplicates(["incoming_id"]).select("incoming_id", "source_id", "canonical_url", "fetched_at", F.coalesce("title", F.lit("")).alias("hint"))
    fresh = a.crossJoin(F.broadcast(a.agg(F.max("fetched_at").alias("m")))).where(F.col("fetched_at") >= F.col("m") - F.expr("interval 24 hours"))
    fresh = fresh.where(~F.col("hint").startswith("AI_EXCLUDED:") & ~F.col("hint").startswith("AI_REVIEW:OPENAI_CONTENT_POLICY:"))
    pending = fresh.join(t("article_url_aliases").select("source_id", F.col("candidate_url").alias("canonical_url")), ["source_id", "canonical_url"], "left_anti")
    return pending.orderBy("fetched_at", "incoming_id").limit(200).select("incoming_id")


@query("select topic_id from topics t where not exists (select 1 from pairs p where trim(p.topic_id_a) = t.topic_id or trim(p.topic_id_b) = t.topic_id)")
def missing_links(t):
    ids = t("pairs").select(F.trim("topic_id_a").alias("topic_id")).union(t("pairs").select(F.trim("topic_id_b"))).where("topic_id is not null")
    return t("topics").select("topic_id").join(ids, "topic_id", "left_anti")


@query("""with seen as (select distinct source_id, canonical_url from articles union select distinct source_id, candidate_url from article_url_aliases)
    select distinct incoming_id from incoming_articles i where not exists (select 1 from seen s where s.source_id = i.source_id and s.canonical_url = i.canonical_url)""")
def seen_then_append(t):
    seen = t("articles").select("source_id", "canonical_url").unionByName(t("article_url_aliases").select("source_id", F.col("candidate_url").alias("canonical_url")))
    return t("incoming_articles").join(seen, ["source_id", "canonical_url"], "left_anti").select("incoming_id").distinct()


@query(f"""select i.incoming_id, a.article_id from {INCOMING} i join {ARTICLES} a on a.source_id = i.source_id and a.canonical_url = i.canonical_url
    where i.content_hash is distinct from a.content_hash""")
def changed_hash(t):
    """Known addresses with other content; a missing hash is a change too."""
    i = t("incoming_articles").dropDuplicates(["incoming_id"]).select("incoming_id", "source_id", "canonical_url", F.col("content_hash").alias("h"))
    return i.join(
        articles(t).select("article_id", "source_id", "canonical_url", "content_hash"),
        ["source_id", "canonical_url"]
    ).where(~F.col("h").eqNullSafe(F.col("content_hash"))).select("incoming_id", "article_id")


_CHANGES = "(select distinct on (doc_id) doc_id, 'late' as lang, source from (select doc_id + 7 as doc_id, source, n_chars from documents) order by doc_id, n_chars desc nulls last, source)"


@query(f"select doc_id, lang, source from documents where doc_id not in (select doc_id from {_CHANGES}) union all select doc_id, lang, source from {_CHANGES}")
def upsert_rewrite(t):
    d = t("documents").select("doc_id", "lang", "source")
    changes = t("documents").select((F.col("doc_id") + 7).alias("doc_id"), F.lit("late").alias("lang"), "source", "n_chars")
    return state.upsert(d, changes, ["doc_id"], [F.desc_nulls_last("n_chars"), F.asc_nulls_last("source")])


@query(f"select doc_id, lang, source from documents union all select doc_id, lang, source from {_CHANGES} c where doc_id not in (select doc_id from documents)")
def insert_ignore(t):
    d = t("documents").select("doc_id", "lang", "source")
    rows = t("documents").select((F.col("doc_id") + 7).alias("doc_id"), F.lit("late").alias("lang"), "source", "n_chars")
    return state.insert_ignore(d, rows, ["doc_id"], [F.desc_nulls_last("n_chars"), F.asc_nulls_last("source")])


@query("select t.topic_id, t.headline_pl, case when x.topic_id is not null then 'LINKED' else t.status end as status from topics t left join (select distinct trim(topic_id_a) topic_id from pairs where \"current\" >= 0.9 and not isnan(\"current\")) x on x.topic_id = t.topic_id")
def conditional_update(t):
    linked = t("pairs").where("current >= 0.9 and not isnan(current)").select(
        F.trim("topic_id_a").alias("topic_id"),
        F.lit("LINKED").alias("status")
    ).where("topic_id is not null").distinct()
    return state.update_from(t("topics").select("topic_id", "headline_pl", "status"), linked, ["topic_id"], ["status"])


@query("select topic_id, status from topics where not coalesce(needs_review and article_count < 2, false)")
def delete_by_predicate(t):
    return state.delete_where(
        t("topics").select("topic_id", "status", "needs_review", "article_count"),
        F.col("needs_review") & (F.col("article_count") < 2)
    ).select("topic_id", "status")


@query("select o_orderkey from orders o where exists (select 1 from lineitem l where l.l_orderkey = o.o_orderkey and l.l_returnflag = 'R')")
def exists_semi(t):
    return t("orders").join(t("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi").select("o_orderkey")


@query("select o_orderkey from orders o where not exists (select 1 from lineitem l where l.l_orderkey = o.o_orderkey and l.l_discount > 0.05)")
def not_exists_anti(t):
    return t("orders").join(t("lineitem").where("l_discount > 0.05").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti").select("o_orderkey")


@query("""select c.c_custkey, o.o_orderkey from customer c left join (select o_custkey, o_orderkey, row_number() over (partition by o_custkey
    order by o_totalprice desc, o_orderkey) k from orders) o on o.o_custkey = c.c_custkey and o.k <= 3""")
def left_lateral_topk(t):
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    top = t("orders").select("o_custkey", "o_orderkey", "o_totalprice").withColumn("k", k).where("k <= 3").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return t("customer").select("c_custkey").join(top, "c_custkey", "left")


@query("select a.s_suppkey as a, b.s_suppkey as b from supplier a join supplier b on a.s_nationkey = b.s_nationkey and a.s_suppkey < b.s_suppkey")
def theta_triangle(t):
    s = t("supplier").select("s_suppkey", "s_nationkey")
    return s.alias("x").join(s.alias("y"), "s_nationkey").where("x.s_suppkey < y.s_suppkey").select(F.col("x.s_suppkey").alias("a"), F.col("y.s_suppkey").alias("b"))


@query("select n_nationkey, r_name, limit_value from nation join region on n_regionkey = r_regionkey cross join (values (10), (20)) s(limit_value)")
def cross_settings(t):
    settings = t("nation").sparkSession.createDataFrame([(10,), (20,)], "limit_value int")  # two rows
    return t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).crossJoin(F.broadcast(settings)).select("n_nationkey", "r_name", "limit_value")


@query("select o_orderkey, l_linenumber from orders join lineitem on l_orderkey = o_orderkey where l_shipdate >= o_orderdate + interval 100 day or l_shipdate < o_orderdate")
def residual_time_join(t):
    late = (F.col("l_shipdate") >= F.col("o_orderdate") + F.expr("interval 100 days")) | (F.col("l_shipdate") < F.col("o_orderdate"))
    return t("orders").select("o_orderkey", "o_orderdate").join(
        t("lineitem").select("l_orderkey", "l_linenumber", "l_shipdate"),
        F.col("l_orderkey") == F.col("o_orderkey")
    ).where(late).select("o_orderkey", "l_linenumber")


@query("select n_nationkey, coalesce(v.name, n_name) as name from nation left join (values (0, 'first'), (3, 'fourth')) v(k, name) on v.k = n_nationkey")
def values_join_update(t):
    v = t("nation").sparkSession.createDataFrame([(0, "first"), (3, "fourth")], "n_nationkey int, name string")  # two rows
    return t("nation").join(F.broadcast(v), "n_nationkey", "left").select("n_nationkey", F.coalesce("name", "n_name").alias("name"))


@query("select d.doc_id from documents d join documents e on e.doc_id = d.doc_id + 1 where d.lang is distinct from e.lang")
def null_safe_diff(t):
    d = t("documents").select("doc_id", "lang")
    return d.join(d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("lang").alias("other")), "doc_id").where(~F.col("lang").eqNullSafe(F.col("other"))).select("doc_id")


@query("""with p as (select trim(topic_id_a) a, min(trim(topic_id_b)) as target from pairs where "current" >= 0.95 and not isnan("current") and trim(topic_id_b) < trim(topic_id_a) group by 1)
    select t.topic_id, coalesce(p.target, t.topic_id) as shown_id from topics t left join p on p.a = t.topic_id""")
def redirect_one_hop(t):
    p = t("pairs").where("current >= 0.95 and not isnan(current)").select(
        F.trim("topic_id_a").alias("topic_id"),
        F.trim("topic_id_b").alias("target")
    ).where("target < topic_id").groupBy("topic_id").agg(F.min("target").alias("target"))
    return t("topics").select("topic_id").join(p, "topic_id", "left").select("topic_id", F.coalesce("target", "topic_id").alias("shown_id"))


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def json_path_projection(t):
    return t("events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


@query(f"""select article_id, cast(pos as int) as pos, part from (select article_id, unnest(string_split(canonical_url, '/')) as part, generate_subscripts(string_split(canonical_url, '/'), 1) - 1 as pos from {ARTICLES}) where pos >= 3""")
def array_explode_ordinality(t):
    return articles(t).select("article_id", F.posexplode(F.split("canonical_url", "/")).alias("pos", "part")).where("pos >= 3")


@query("""select event_id, je.key as name, je.value as value from (select event_id, unnest(json_keys(props)) as key, props from events) e, lateral (select e.key as key, json_extract_string(e.props, '$.' || e.key) as value) je""")
def json_each(t):
    return t("events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("name", "value"))


@query(f"""select x.topic_id, x.is_current from (select t.topic_id, t.last_seen_at >= m.m - interval 24 hour as is_current from topics t, (select max(last_seen_at) m from topics) m) x""")
def current_vs_history(t):
    """as_of is the newest time in the table: no clock is read."""
    edge = t("topics").agg(F.max("last_seen_at").alias("m"))
    return t("topics").crossJoin(F.broadcast(edge)).select("topic_id", (F.col("last_seen_at") >= F.col("m") - F.expr("interval 24 hours")).alias("is_current"))


@query("""select topic_id, source_count, article_count from topics where headline_pl is not null and contains(lower(headline_pl),
    'strajk') order by source_count desc nulls last, article_count desc nulls last, topic_id""")
def topic_feed_sorted(t):
    hit = F.contains(F.lower("headline_pl"), F.lit("strajk"))
    return t("topics").where(F.col("headline_pl").isNotNull() & hit).select("topic_id", "source_count", "article_count").orderBy(
        F.desc_nulls_last("source_count"),
        F.desc_nulls_last("article_count"),
        "topic_id"
    )


@query("select source_id from sources intersect select source_id from articles")
def set_intersection(t):
    return t("sources").select("source_id").intersect(t("articles").select("source_id"))


@query("select source_id from article_url_aliases except select source from mix_targets")
def set_difference(t):
    return t("article_url_aliases").select("source_id").subtract(t("mix_targets").select(F.col("source").alias("source_id")))


_STREAMS = """(select source_id, 1 as priority, canonical_url as url from articles union all select source_id, 2, candidate_url from article_url_aliases union all select source_id, 3, canonical_url from incoming_articles)"""


@query(f"select source_id, url, min(priority) as priority, count(*) as sightings from {_STREAMS} where url is not null group by 1, 2")
def union_with_priority(t):
    """Streams of candidates in order of priority; an address counts for the first stream that has it."""
    streams = [
        t("articles").select("source_id", F.lit(1).alias("priority"), F.col("canonical_url").alias("url")),
        t("article_url_aliases").select("source_id", F.lit(2).alias("priority"), F.col("candidate_url").alias("url"))
    ]
    rows = streams[0].unionByName(streams[1]).unionByName(t("incoming_articles").select("source_id", F.lit(3).alias("priority"), F.col("canonical_url").alias("url")))
    return rows.where("url is not null").groupBy("source_id", "url").agg(F.min("priority").alias("priority"), F.count("*").alias("sightings"))


@query(f"""with e as (select article_id, sha256('3|extract|' || source_type || '|' || coalesce(body, '')) as h from {ARTICLES} where source_type is not null) select h as cache_key, count(*) as uses, min(article_id) as first_id from e group by h having count(*) > 1""")
def extraction_cache(t):
    """Cached results by a key of version, model, topic (here the kind of source) and body."""
    key = F.sha2(F.concat_ws("|", F.lit("3"), F.lit("extract"), "source_type", F.coalesce("body", F.lit(""))), 256)
    return articles(t).where("source_type is not null").groupBy(key.alias("cache_key")).agg(F.count("*").alias("uses"), F.min("article_id").alias("first_id")).where("uses > 1")


@query("select s.source_id, coalesce(nullif(trim(s.region), ''), 'unknown') as region, coalesce(m.target_share, 0) as target_share from sources s left join mix_targets m on m.source = s.source_id")
def config_overlay(t):
    m = t("mix_targets").select(F.col("source").alias("source_id"), "target_share")
    return t("sources").join(m, "source_id", "left").select(
        "source_id",
        F.coalesce(T.nonblank(F.trim("region")), F.lit("unknown")).alias("region"),
        F.coalesce("target_share", F.lit(0.0)).alias("target_share")
    )


@query("""select cast(time_bucket(interval 1 hour, ts) as timestamp) as hour, event_type, count(*) as events, round(sum(value), 6) as total from events group by 1, 2""")
def hourly_windows(t):
    """Batch form of the stream's tumbling windows."""
    return t("events").groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 6).alias("total"))


@query("""with g as (select user_id, ts, event_id, case when ts - lag(ts) over w <= interval 30 minute then 0 else 1 end as fresh from events window w as (partition by user_id order by ts, event_id)),
    s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts, event_id) as session_no from g)
    select user_id, cast(session_no as bigint) as session_no, count(*) as events, min(ts) as first_ts, max(ts) as last_ts from s group by 1, 2""")
def sessions(t):
    return state.sessions(t("events"), "user_id", "ts", "event_id", "30 minutes")
