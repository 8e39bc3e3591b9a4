"""Aggregations, facets, windows, top-k and order."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import ledger, state
from ..session import cut_lineage
from .registry import ARTICLES, articles, query, sql_values


@query(f"""select title_key, count(distinct article_id) as article_count, count(distinct source_id) as source_count,
    case when count(distinct source_id) >= 2 then 'MULTI_SOURCE' when count(distinct article_id) >= 2 then 'SINGLE_SOURCE' else 'SINGLE_ARTICLE' end as coverage_status
    from {ARTICLES} group by title_key""")
def topic_coverage(t):
    n, s = F.count_distinct("article_id"), F.count_distinct("source_id")
    return t("articles").groupBy("title_key").agg(n.alias("article_count"), s.alias("source_count")).withColumn(
        "coverage_status", F.when(F.col("source_count") >= 2, "MULTI_SOURCE").when(F.col("article_count") >= 2, "SINGLE_SOURCE").otherwise("SINGLE_ARTICLE")
    )


@query("""select s.source_id, max(s.name) as source_name, count(distinct a.article_id) as articles,
    count(distinct a.article_id) filter (where a.content_status = 'COMPLETE') as complete_articles,
    count(distinct a.article_id) filter (where a.item_kind = 'ARTICLE_EXCERPT') as excerpts,
    count(distinct a.section) filter (where a.http_status = 200) as live_sections
    from sources s left join articles a on a.source_id = s.source_id group by s.source_id""")
def source_coverage_filtered(t):
    own = t("articles").groupBy("source_id").agg(
        F.count_distinct("article_id").alias("articles"),
        F.count_distinct(F.when(F.col("content_status") == "COMPLETE", F.col("article_id"))).alias("complete_articles"),
        F.count_distinct(F.when(F.col("item_kind") == "ARTICLE_EXCERPT", F.col("article_id"))).alias("excerpts"),
        F.count_distinct(F.when(F.col("http_status") == 200, F.col("section"))).alias("live_sections"),
    )
    # aggregated before the join, so at most one row per source meets the dimension
    return t("sources").select("source_id", F.col("name").alias("source_name")).join(own, "source_id", "left").na.fill(0)


@query(f"select title_key, min(article_id) as article_id from {ARTICLES} group by title_key having count(*) = 1")
def singletons_having(t):
    return articles(t).groupBy("title_key").agg(F.min("article_id").alias("article_id"), F.count("*").alias("n")).where("n = 1").drop("n")


@query("select source_id, string_agg(section, ',' order by section) as sections from (select distinct source_id, section from articles where section is not null) group by source_id")
def categories_ordered_array(t):
    return t("articles").where("section is not null").groupBy("source_id").agg(F.array_join(F.array_sort(F.collect_set("section")), ",").alias("sections"))


@query("""select user_id, string_agg(distinct event_type, ',' order by event_type) filter (where value > 50) as strong_types, max(value) as top_value, bool_or(event_type = 'error') as had_error
    from events group by user_id""")
def assignment_evidence(t):
    kinds = F.array_join(F.array_sort(F.collect_set(F.when(F.col("value") > 50, F.col("event_type")))), ",")
    return t("events").groupBy("user_id").agg(
        F.when(kinds != "", kinds).alias("strong_types"),
        F.max("value").alias("top_value"),
        F.bool_or(F.col("event_type") == "error").alias("had_error")
    )


@query("select title_key, string_agg(distinct source_name, '; ' order by source_name) as source_names from articles group by title_key")
def sources_string_agg(t):
    return t("articles").groupBy("title_key").agg(F.array_join(F.array_sort(F.collect_set("source_name")), "; ").alias("source_names"))


@query(f"""select source_id, '[' || string_agg('{{"id":"' || article_id || '","words":' || word_count || '}}', ',' order by word_count desc nulls last, article_id) || ']' as items
    from {ARTICLES} where item_kind = 'ARTICLE_EXCERPT' group by source_id""")
def nested_json_export(t):
    item = F.struct(F.col("article_id").alias("id"), F.col("word_count").alias("words"))
    keyed = F.struct((-F.col("word_count")).alias("k"), F.col("article_id").alias("i"), F.to_json(item).alias("j"))
    rows = articles(t).where("item_kind = 'ARTICLE_EXCERPT'")
    return rows.groupBy("source_id").agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(keyed)), lambda x: x["j"]), ","), F.lit("]")).alias("items"))


@query("""select user_id, count(*) as runs, round(avg(value), 6) as avg_value, max(value) as max_value
    from events where ts >= (select max(ts) from events) - interval 14 day group by user_id""")
def run_source_timings(t):
    e = t("events")
    edge = e.agg(F.max("ts").alias("edge"))  # one row
    recent = e.crossJoin(F.broadcast(edge)).where(F.col("ts") >= F.col("edge") - F.expr("interval 14 days"))
    return recent.groupBy("user_id").agg(F.count("*").alias("runs"), F.round(F.avg("value"), 6).alias("avg_value"), F.max("value").alias("max_value"))


@query(f"select content_status, count(*) as articles from {ARTICLES} group by content_status")
def status_histogram(t):
    return articles(t).groupBy("content_status").agg(F.count("*").alias("articles"))


@query("""with r as (select user_id, count(*) as runs, round(avg(value) / 1000, 4) as mean_s, max(value) as longest_ms, avg(value) as m from events
    where ts >= (select max(ts) from events) - interval 14 day and value is not null group by user_id)
    select user_id, runs, mean_s, longest_ms, row_number() over (order by m desc, user_id) as place from r""")
def slow_source_rank(t):
    """The slowest sources of the last 14 days by their mean time (here the events' values as milliseconds)."""
    e = t("events").where("value is not null")
    recent = e.crossJoin(F.broadcast(t("events").agg(F.max("ts").alias("edge")))).where(F.col("ts") >= F.col("edge") - F.expr("interval 14 days"))
    by = recent.groupBy("user_id").agg(F.count("*").alias("runs"), F.avg("value").alias("m"), F.max("value").alias("longest_ms"))
    # a rank over all sources from ranks in ranges, so that no task holds them all
    place = by.orderBy(F.desc("m"), "user_id").withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id())
    place = cut_lineage(place)
    parts = place.groupBy("__part").agg(F.count("*").alias("n"))
    before = parts.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy("__row"))
    return place.join(before, "__part").select("user_id", "runs", F.round(F.col("m") / 1000, 4).alias("mean_s"), "longest_ms", (F.col("before") + inside).alias("place"))


@query(f"""with c as (select source_profile, count(*) n from {ARTICLES} group by 1), s as (select source_profile, n * 100 as x, sum(n) over () as total from c),
    f as (select source_profile, x // total as base, x % total as rest, total from s),
    r as (select *, row_number() over (order by rest desc, source_profile) as k, 100 - sum(base) over () as spare from f)
    select source_profile, cast(base + case when k <= spare then 1 else 0 end as bigint) as percent from r""")
def profile_share_largest_remainder(t):
    c = articles(t).groupBy("source_profile").agg(F.count("*").alias("n"))  # a row per profile
    every = Window.partitionBy()
    f = c.withColumn("total", F.sum("n").over(every)).select("source_profile", F.expr("n * 100 div total").alias("base"), F.expr("n * 100 % total").alias("rest"))
    r = f.withColumn("k", F.row_number().over(Window.orderBy(F.desc("rest"), "source_profile"))).withColumn("spare", F.lit(100) - F.sum("base").over(every))
    return r.select("source_profile", (F.col("base") + F.when(F.col("k") <= F.col("spare"), 1).otherwise(0)).alias("percent"))


_TAGS = f"(select title_key, section from {ARTICLES} where section is not null)"


@query(f"select section, count(distinct title_key) as topics from {_TAGS} group by section")
def facet_counts_any(t):
    return t("articles").where("section is not null").groupBy("section").agg(F.count_distinct("title_key").alias("topics"))


@query("""with picked as (select source_id from articles where section in ('weather', 'culture') group by source_id having count(distinct section) = 2)
    select section, count(distinct source_id) as sources from articles where section is not null and source_id in (select source_id from picked) group by section""")
def facet_counts_all(t):
    """Facets under the selection that needs all of two categories."""
    tags = t("articles").where("section is not null").select("source_id", "section")
    picked = tags.where(F.col("section").isin("weather", "culture")).groupBy("source_id").agg(F.count_distinct("section").alias("n")).where("n = 2")
    return tags.join(picked, "source_id", "left_semi").groupBy("section").agg(F.count_distinct("source_id").alias("sources"))


@query("""with e as (select max(fetched_at) m from articles)
    select count(distinct article_id) filter (where fetched_at >= m - interval 24 hour) as current_articles,
    count(distinct article_id) filter (where fetched_at < m - interval 24 hour) as past_articles, count(distinct source_id) as sources from articles, e""")
def header_stats(t):
    a = t("articles").select("article_id", "source_id", "fetched_at")
    x = a.crossJoin(F.broadcast(a.agg(F.max("fetched_at").alias("m"))))
    recent = F.col("fetched_at") >= F.col("m") - F.expr("interval 24 hours")
    return x.agg(
        F.count_distinct(F.when(recent, F.col("article_id"))).alias("current_articles"),
        F.count_distinct(F.when(~recent, F.col("article_id"))).alias("past_articles"),
        F.count_distinct("source_id").alias("sources")
    )


@query(f"""select source_id, cast(fetched_at as date) as day, article_id from (select *, row_number() over (partition by source_id, cast(fetched_at as date) order by fetched_at, article_id) k from {ARTICLES}) where k <= 3""")
def daily_cap(t):
    """The first three of a source and day: the running count stays under the cap."""
    day = F.to_date("fetched_at")
    w = Window.partitionBy("source_id", "day").orderBy("fetched_at", "article_id")
    return articles(t).select(
        "source_id",
        day.alias("day"),
        "fetched_at",
        "article_id"
    ).withColumn("k", F.row_number().over(w)).where("k <= 3").select("source_id", "day", "article_id")


@query("select user_id, cast(ts as date) as day, coalesce(sum(value) filter (where event_type = 'purchase'), 0) as purchases from events group by 1, 2")
def daily_sums(t):
    return t("events").groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.coalesce(F.sum(F.when(F.col("event_type") == "purchase", F.col("value"))), F.lit(0.0)).alias("purchases")
    )


@query("select event_id, user_id, event_type from events order by ts desc, event_id desc limit 1")
def latest_row(t):
    return t("events").orderBy(F.desc("ts"), F.desc("event_id")).limit(1).select("event_id", "user_id", "event_type")


@query("select distinct on (user_id) user_id, event_id, event_type from events order by user_id, ts desc, event_id desc")
def latest_per_key(t):
    return state.latest(t("events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


_PAIRS = """(select distinct least(trim(topic_id_a), trim(topic_id_b)) a, greatest(trim(topic_id_a), trim(topic_id_b)) b, "current" c, coalesce(threshold, 0.78) th from pairs
    where trim(topic_id_a) <> trim(topic_id_b) and "current" is not null and not isnan("current") and (threshold is null or not isnan(threshold)))"""


def _pairs(t):
    p = t("pairs").select(F.trim("topic_id_a").alias("x"), F.trim("topic_id_b").alias("y"), F.col("current").alias("c"), F.coalesce("threshold", F.lit(0.78)).alias("th"))
    return p.where("x <> y and c is not null and not isnan(c) and not isnan(th)").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "c", "th").distinct()


_BUCKET = "case when c >= th + 0.03 then 'SELECTED_HIGH_SCORE' when c >= th then 'SELECTED_NEAR_THRESHOLD' when c >= th - 0.03 then 'BELOW_THRESHOLD' else 'FAR' end"


@query(f"""select bucket, a, b, round(c, 9) as score, k as place from (select *, row_number() over (partition by bucket
    order by abs(c - th), a, b, c) k from (select *, {_BUCKET} as bucket from {_PAIRS})) where k <= 5""")
def topk_per_bucket(t):
    p = _pairs(t).withColumn("bucket", F.expr(_BUCKET))
    k = F.row_number().over(Window.partitionBy("bucket").orderBy(F.abs(F.col("c") - F.col("th")), "a", "b", "c"))
    return p.withColumn("place", k.cast("bigint")).where("place <= 5").select("bucket", "a", "b", F.round("c", 9).alias("score"), "place")


@query(f"select cast(floor(c * 50) as bigint) as band, count(*) as pairs, round(min(c), 9) as lowest from {_PAIRS} group by 1")
def score_histogram(t):
    return _pairs(t).groupBy(F.floor(F.col("c") * 50).alias("band")).agg(F.count("*").alias("pairs"), F.round(F.min("c"), 9).alias("lowest"))


@query(f"""with bands as (select n as band from generate_series(30, 49) g(n)), s as (select cast(floor(c * 50) as bigint) band,
    a, b, c, row_number() over (partition by floor(c * 50) order by c, a, b) k from {_PAIRS})
    select bands.band, s.a, s.b, round(s.c, 9) as score from bands left join s on s.band = bands.band and s.k <= 5""")
def score_band_samples(t):
    """The five lowest scores of each band; bands without pairs keep an empty row (a left lateral top-k)."""
    spark = t("pairs").sparkSession
    bands = spark.range(30, 50).withColumnRenamed("id", "band")
    p = _pairs(t).withColumn("band", F.floor(F.col("c") * 50))
    k = F.row_number().over(Window.partitionBy("band").orderBy("c", "a", "b"))
    top = p.withColumn("k", k).where("k <= 5").select("band", "a", "b", F.round("c", 9).alias("score"))
    return bands.join(top, "band", "left")


@query("select event_type, event_id, count(*) over (partition by event_type) as of_type, count(value) over () as valued from events")
def count_over_partition(t):
    e = t("events")
    # totals are joined, not windowed: an unpartitioned window would put all rows into one task
    totals = e.groupBy("event_type").agg(F.count("*").alias("of_type"), F.count("value").alias("v"))
    every = totals.agg(F.sum("v").alias("valued"))
    return e.select("event_type", "event_id").join(totals.drop("v").crossJoin(every), "event_type")


@query("""select user_id, event_id, row_number() over w as version, event_type is distinct from lag(event_type) over w
    or row_number() over w = 1 as changed from events window w as (partition by user_id order by ts, event_id)""")
def version_numbering(t):
    return state.versions(t("events"), ["user_id"], "ts", "event_id", "event_type").select("user_id", "event_id", F.col("version").cast("bigint").alias("version"), "changed")


@query(f"select section, article_id from (select section, article_id, row_number() over (partition by section order by fetched_at desc, article_id) k from {ARTICLES}) where k <= 4")
def first_n_per_section(t):
    k = F.row_number().over(Window.partitionBy("section").orderBy(F.desc("fetched_at"), "article_id"))
    return articles(t).select("section", "article_id", "fetched_at").withColumn("k", k).where("k <= 4").select("section", "article_id")


@query(f"""with r as (select title_key, author, section, source_profile, row_number() over (partition by title_key order by fetched_at, article_id) k from {ARTICLES})
    select title_key, min_by(author, k) filter (where trim(author) <> '') as author, min_by(section, k) filter (where trim(section) <> '') as section,
        min_by(source_profile, k) filter (where trim(source_profile) <> '') as source_profile from r group by title_key""")
def keep_first_enrichment(t):
    """The order is a struct inside the aggregate, so values are combined before the shuffle and no group is sorted."""
    r = articles(t).select("title_key", "author", "section", "source_profile", F.struct("fetched_at", "article_id").alias("k"))
    return state.keep_first_values(r, ["title_key"], "k", ["author", "section", "source_profile"])


@query(f"select article_id, source_id from {ARTICLES} order by fetched_at desc, article_id limit 500")
def newest_window_cap(t):
    return articles(t).select("article_id", "source_id", "fetched_at").orderBy(F.desc("fetched_at"), "article_id").limit(500).select("article_id", "source_id")


@query(f"""with c as (select source_id, count(*) n from {ARTICLES} group by 1) select source_id, n as articles, round(n * 1.0 / max(n) over (), 6) as share_of_max from c""")
def source_share_of_max(t):
    c = articles(t).groupBy("source_id").agg(F.count("*").alias("articles"))  # a row per source
    return c.withColumn("share_of_max", F.round(F.col("articles") / F.max("articles").over(Window.partitionBy()), 6))


@query("""select coalesce(nullif(trim(source), ''), 'none') as source, count(*) as documents, coalesce(sum(n_chars), 0) as chars, count(*) filter (where lang is null) as unlabelled,
    bool_and(coalesce(n_chars, 0) > 0) as all_filled from documents group by 1""")
def run_totals(t):
    key = F.coalesce(F.when(F.trim("source") != "", F.trim("source")), F.lit("none"))
    return t("documents").groupBy(key.alias("source")).agg(
        F.count("*").alias("documents"),
        F.coalesce(F.sum("n_chars"), F.lit(0)).alias("chars"),
        F.count(F.when(F.col("lang").isNull(), 1)).alias("unlabelled"),
        F.bool_and(F.coalesce("n_chars", F.lit(0)) > 0).alias("all_filled")
    )


@query("""select o_orderpriority, count(distinct o_custkey) as customers, max_by(o_orderkey, (o_totalprice, o_orderkey)) as dearest, round(sum(o_totalprice), 2) as total from orders group by 1""")
def max_by_totals(t):
    return t("orders").groupBy("o_orderpriority").agg(
        F.count_distinct("o_custkey").alias("customers"),
        F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("dearest"),
        F.round(F.sum("o_totalprice"), 2).alias("total")
    )


#: Topics that the tables don't hold: state media with one side, with both, alone, and a publisher without a profile.
PLANTED_SIDES = [("planted one", "STATE", "PORTAL"), ("planted one", "LEFT", "PORTAL"), ("planted two", "STATE_MEDIA", None), ("planted two", "CENTER_LEFT", "PORTAL"), ("planted two", "RIGHT", "PORTAL"), ("planted three", "CENTER", "STATE_MEDIA"),
    ("planted four", "CENTER_RIGHT", "PORTAL"), ("planted four", "UNCLASSIFIED", "PORTAL"), ("planted five", " center ", "AGENCY")]
_SIDES = f"""(select title_key, case when upper(trim(coalesce(source_profile, ''))) in ('STATE_ALIGNED', 'STATE_MEDIA', 'STATE') or upper(trim(coalesce(source_type, ''))) = 'STATE_MEDIA' then 'STATE'
    when upper(trim(source_profile)) in ('LEFT', 'CENTER_LEFT') then 'LEFT' when upper(trim(source_profile)) in ('RIGHT',
        'CENTER_RIGHT') then 'RIGHT' when upper(trim(source_profile)) = 'CENTER' then 'CENTER' end as side
    from (select title_key, source_profile, source_type from articles union all select * from {sql_values(PLANTED_SIDES)} v(title_key, source_profile, source_type)))"""


@query(f"""with g as (select title_key, list(distinct side) filter (where side <> 'STATE') as free from {_SIDES} where side is not null group by 1)
    select title_key, case when coalesce(len(free), 0) = 0 then 'STATE_ONLY' when len(free) = 1 then 'SINGLE_' || free[1] else 'MIXED' end as coverage_mode from g""")
def coverage_mode(t):
    """Which sides report on a title; the state's doesn't count beside another. Publishers without an approved profile have no side."""
    a = t("articles").select("title_key", "source_profile", "source_type")
    a = a.union(a.sparkSession.createDataFrame(PLANTED_SIDES, "title_key string, source_profile string, source_type string"))
    rows = a.select("title_key", ledger.side(F.col("source_profile"), F.col("source_type")).alias("side")).where("side is not null")
    # at most four sides a title
    return rows.groupBy("title_key").agg(ledger.coverage_mode(F.collect_set("side")).alias("coverage_mode"))


@query(f"select title_key from {ARTICLES} where source_profile <> 'STATE' group by 1 having count(distinct source_id) >= 2")
def shared_support(t):
    return t("articles").where("source_profile <> 'STATE'").groupBy("title_key").agg(F.count_distinct("source_id").alias("n")).where("n >= 2").select("title_key")
