"""Queues, windows of candidates, samples and states of the store."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import state
from .registry import ARTICLES, INCOMING, articles, query, sql_values

_ITEMS = f"""(select i.incoming_id as item_id, i.source_id, i.original_url as candidate_url, i.canonical_url, trim(regexp_replace(lower(replace(coalesce(i.title,
    ''), 'ß', 'ss')), '[\\s\\x{{00A0}}]+', ' ', 'g')) as title_key,
    nullif(md5(coalesce(substr(trim(i.body), 1, 400), '')), md5('')) as opening, case when trim(coalesce(i.body,
        '')) = '' then 0 else len(list_filter(string_split(regexp_replace(i.body, '\\s+', ' ', 'g'), ' '), lambda x: x <> '')) end as words
        from {INCOMING} i)"""
_KNOWN = f"(select article_id, source_id, canonical_url, title_key, nullif(md5(coalesce(substr(trim(body), 1, 400), '')), md5('')) as opening, content_status, first_seen_at from {ARTICLES})"


def _items(t):
    opening = F.md5(F.coalesce(F.substring(F.trim("body"), 1, 400), F.lit("")))
    i = t("incoming_articles").dropDuplicates(["incoming_id"])
    return i.select(
        F.col("incoming_id").alias("item_id"),
        "source_id",
        F.col("original_url").alias("candidate_url"),
        "canonical_url",
        T.lower_key(F.coalesce("title", F.lit(""))).alias("title_key"),
        F.when(opening != F.md5(F.lit("")), opening).alias("opening"),
        T.word_count(F.col("body")).alias("words"),
        F.lit("ARTICLE").alias("kind")
    )


def _known(t):
    opening = F.md5(F.coalesce(F.substring(F.trim("body"), 1, 400), F.lit("")))
    return articles(t).select(
        "article_id",
        "source_id",
        "canonical_url",
        "title_key",
        F.when(opening != F.md5(F.lit("")), opening).alias("opening"),
        "content_status",
        "first_seen_at"
    )


# one item after the other, with the addresses and keys that the ones before have brought in
@query(f"""with recursive d as materialized (select i.*, (select min(article_id) from {_KNOWN} a where a.source_id = i.source_id and a.canonical_url = i.canonical_url) as direct,
        (select min(duplicate_of_article_id) from article_url_aliases a where a.source_id = i.source_id and a.candidate_url = i.canonical_url) as by_alias,
        (select arg_min(article_id, (first_seen_at, article_id)) from {_KNOWN} a where a.source_id = i.source_id
            and a.title_key = i.title_key and a.opening = i.opening and a.title_key <> '' and a.content_status in ('COMPLETE',
            'EXCERPT')) as logical,
        i.source_id || '|' || i.canonical_url as u, i.source_id || '|' || nullif(i.title_key, '') || '|' || i.opening as lk, row_number() over (order by item_id) k from {_ITEMS} i),
    r as (select cast(0 as bigint) k, cast([] as varchar[]) us, cast([] as varchar[]) ut, cast([] as varchar[]) ks,
        cast([] as varchar[]) kt, cast(null as varchar) item_id, cast(null as varchar) outcome, cast(null as varchar) target
        union all
        select k, case when outcome in ('duplicate', 'inserted') then list_append(us, u) else us end, case when outcome in ('duplicate', 'inserted') then list_append(ut, target) else ut end,
            case when outcome = 'inserted' and lk is not null then list_append(ks, lk) else ks end, case when outcome = 'inserted'
                and lk is not null then list_append(kt, target) else kt end, item_id, outcome, target from
        (select *, case outcome when 'rejected' then null when 'existing' then coalesce(direct, by_alias, ut[coalesce(list_position(us,
            u), 0)]) when 'duplicate' then coalesce(logical, kt[coalesce(list_position(ks, lk), 0)]) else 'new:' || item_id end as target
            from
        (select d.k, d.item_id, d.u, d.lk, d.direct, d.by_alias, d.logical, us, ut, ks, kt, case when words < 100
            then 'rejected' when direct is not null or by_alias is not null or coalesce(list_contains(us, d.u),
            false) then 'existing'
            when logical is not null or coalesce(list_contains(ks, d.lk), false) then 'duplicate' else 'inserted' end as outcome from r join d on d.k = r.k + 1)))
    select item_id, outcome, target as target_id from r where k > 0""")
def save_outcomes(t):
    """What saving each fetched record does: rejected, existing, duplicate or inserted, and the article it ends at."""
    none = t("articles").select("source_id", "canonical_url").where(F.lit(False))
    saved = state.save_items(_items(t), _known(t), t("article_url_aliases").select("source_id", "candidate_url", "duplicate_of_article_id"), none)
    return saved.select("item_id", "outcome", "target_id")


@query(f"""select a.article_id, epoch_us(greatest(a.last_seen_on_homepage_at, max(i.fetched_at))) as last_seen_us from {ARTICLES} a join incoming_articles i on i.source_id = a.source_id and i.canonical_url = a.canonical_url group by a.article_id, a.last_seen_on_homepage_at""")
def touched_articles(t):
    """Articles seen again, with the time of their last sight."""
    seen = t("incoming_articles").groupBy("source_id", "canonical_url").agg(F.max("fetched_at").alias("at"))
    return articles(t).select("article_id", "source_id", "canonical_url", "last_seen_on_homepage_at").join(seen, ["source_id", "canonical_url"]).select(
        "article_id",
        F.unix_micros(F.greatest("last_seen_on_homepage_at", "at")).alias("last_seen_us")
    )


@query(f"""select i.batch_no, a.article_id, max(case when trim(coalesce(i.body, '')) <> '' then 1 else 0 end) as fetched_now from incoming_articles i join {ARTICLES} a on a.source_id = i.source_id and a.canonical_url = i.canonical_url group by 1, 2""")
def run_sightings(t):
    """One row a run and article; a later mere sighting doesn't undo that the run fetched it."""
    i = t("incoming_articles").select("batch_no", "source_id", "canonical_url", F.when(F.trim(F.coalesce("body", F.lit(""))) != "", 1).otherwise(0).alias("now"))
    return i.join(
        articles(t).select("article_id", "source_id", "canonical_url"),
        ["source_id", "canonical_url"]
    ).groupBy("batch_no", "article_id").agg(F.max("now").alias("fetched_now"))


#: Rejections and records that the tables don't hold: (source, address, words at the rejection, words now).
PLANTED_REJECTED = [("r", "u://1", 20, 30), ("r", "u://2", 20, 150), ("r", "u://3", 150, 30), ("r", "u://4", None, 30)]


@query(f"""with p as (select * from {sql_values(PLANTED_REJECTED)} v(source_id, canonical_url, before, now)),
    r as (select source_id, canonical_url, max(word_count) as words, min(first_seen_at) as first_seen
        from articles where content_status in ('FAILED', 'METADATA_ONLY', 'CAPTCHA') or word_count < 100 group by 1, 2
        union all select source_id, canonical_url, before, timestamptz '2026-01-01 00:00:00+00' from p),
    i as (select item_id, source_id, canonical_url, words from {_ITEMS} union all select canonical_url, source_id, canonical_url, now from p)
    select i.item_id, coalesce(r.words < 100 and i.words < 100, false) as skipped, epoch_us(r.first_seen) as first_seen_us from i join r on r.source_id = i.source_id and r.canonical_url = i.canonical_url""")
def rejected_cache(t):
    """Addresses rejected before: skipped while they are still too short, tried again when they now come with enough words; the first sight stays."""
    rejected = t("articles").where("content_status in ('FAILED', 'METADATA_ONLY', 'CAPTCHA') or word_count < 100")
    r = rejected.groupBy("source_id", "canonical_url").agg(F.max("word_count").alias("before"), F.min("first_seen_at").alias("first_seen"))
    p = r.sparkSession.createDataFrame(PLANTED_REJECTED, "source_id string, canonical_url string, before int, words int")
    r = r.unionByName(p.select("source_id", "canonical_url", "before", F.to_timestamp(F.lit("2026-01-01 00:00:00+00:00")).alias("first_seen")))
    items = _items(t).select("item_id", "source_id", "canonical_url", "words")
    items = items.unionByName(p.select(F.col("canonical_url").alias("item_id"), "source_id", "canonical_url", "words"))
    short = (F.col("before") < 100) & (F.col("words") < 100)
    return items.join(r, ["source_id", "canonical_url"]).select("item_id", F.coalesce(short, F.lit(False)).alias("skipped"), F.unix_micros("first_seen").alias("first_seen_us"))


@query("""select topic_id, case when topic_id = 'gone' then 'missing' when article_count % 5 = 0 then 'already_applied'
    when article_count % 3 = 0 then 'changed' when article_count % 7 = 0 then 'invalid' else 'applied' end as outcome,
    case when topic_id = 'gone' then null when article_count % 5 = 0 or article_count % 3 = 0 or article_count % 7 = 0 then headline_pl else headline_pl || ' (new)' end as payload
    from (select topic_id, article_count, headline_pl from topics where article_count is not null and headline_pl is not null union all select 'gone', 1, 'x')""")
def compare_and_swap(t):
    """Replacements that apply only to what is as expected; here some topics changed meanwhile, some have the new state already, some would change a version."""
    rows = t("topics").where("article_count is not null and headline_pl is not null").select(
        "topic_id",
        F.col("article_count").alias("version"),
        F.col("headline_pl").alias("payload")
    )
    more = rows.union(rows.sparkSession.createDataFrame([("gone", 1, "x")], rows.schema))
    n = F.col("version")
    expected = more.select("topic_id", "version", F.when(n % 3 == 0, "stale").otherwise(F.col("payload")).alias("payload"))
    new = more.select(
        "topic_id",
        F.when((n % 5 != 0) & (n % 7 == 0), n + 1).otherwise(n).alias("version"),
        F.when(n % 5 == 0, F.col("payload")).otherwise(F.concat("payload", F.lit(" (new)"))).alias("payload")
    )
    none = rows.select("topic_id", "version", F.lit("r").alias("run_id"), F.array(F.lit("a")).alias("article_ids"), "payload").where(F.lit(False))
    after, _, outcomes = state.replace_if_unchanged(rows, none, expected, new, none, none)
    return outcomes.join(after.select("topic_id", "payload"), "topic_id", "left")


@query(f"""select incoming_id, case when batch_no >= (select max(batch_no) - 1 from incoming_articles) then 'backup' else 'kept' end as place from {INCOMING} where batch_no is not null""")
def reset_last_runs(t):
    """The rows of the last two runs go to a backup; the rest stays."""
    i = t("incoming_articles").dropDuplicates(["incoming_id"]).where("batch_no is not null").select("incoming_id", "batch_no")
    last = i.select("batch_no").distinct().orderBy(F.desc("batch_no")).limit(2)
    kept, backup, _ = state.reset({"incoming": i}, last, "batch_no")
    return kept["incoming"].select("incoming_id", F.lit("kept").alias("place")).unionByName(backup["incoming"].select("incoming_id", F.lit("backup").alias("place")))


_POLISH = "(split_part(replace(lower(trim(language)), '_', '-'), '/', 1) in ('pl', 'pl-pl', 'polish', 'polski') or ((language is null or language = '') and replace(lower(trim(region)), '_', '-') in ('poland', 'polska', 'pl')))"


def _is_polish(language, region):
    named = F.split_part(F.replace(F.lower(F.trim(language)), F.lit("_"), F.lit("-")), F.lit("/"), F.lit(1)).isin("pl", "pl-pl", "polish", "polski")
    return F.when(F.coalesce(language, F.lit("")) != "", named).otherwise(
        F.coalesce(F.replace(F.lower(F.trim(region)), F.lit("_"), F.lit("-")).isin("poland", "polska", "pl"), F.lit(False))
    )


@query(f"""select article_id, source_id from (select a.article_id, a.source_id, row_number() over (partition by a.source_id order by a.fetched_at desc, a.article_id) k, case when {_POLISH} then 15 else 10 end as n from {ARTICLES} a join sources s on s.source_id = a.source_id) where k <= n""")
def top_windows(t):
    """Each source's newest candidates: ten, of Polish sources fifteen."""
    s = t("sources").select("source_id", F.when(_is_polish(F.col("language"), F.col("region")), 15).otherwise(10).alias("n"))
    k = F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("fetched_at"), "article_id"))
    # the widest window first, so that ranks are cut before the shuffle
    first = articles(t).select("article_id", "source_id", "fetched_at").withColumn("k", k).where("k <= 15")
    return first.join(s, "source_id").where("k <= n").select("article_id", "source_id")


@query(f"""with c as (select article_id, source_id, coalesce(word_count, 0) < 100 as short, row_number() over (partition by source_id order by fetched_at desc, article_id) k from {ARTICLES}),
    r as (select *, sum(case when short then 1 else 0 end) over (partition by source_id order by k rows between unbounded preceding and 1 preceding) as before from c),
    f as (select source_id, min(k) filter (where k > 10 and coalesce(before, 0) < k - 10) as stop from r where k <= 20 group by 1)
    select r.article_id, r.source_id, r.k > 10 as followup from r join f on f.source_id = r.source_id where k <= 20 and (stop is null or k < stop)""")
def short_followups(t):
    """Ten candidates of each source; every short one is replaced by the next, by one extra window of ten at most.

    The candidate at place p behind the window is taken if as many short ones stand before it as it needs; the first that isn't ends the queue.
    """
    by = Window.partitionBy("source_id")
    c = articles(t).select("article_id", "source_id", (F.coalesce("word_count", F.lit(0)) < 100).alias("short"), "fetched_at")
    c = c.withColumn("k", F.row_number().over(by.orderBy(F.desc("fetched_at"), "article_id"))).where("k <= 20")
    before = F.coalesce(F.sum(F.col("short").cast("int")).over(by.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    r = c.withColumn("before", before).withColumn("stop", F.min(F.when((F.col("k") > 10) & (F.col("before") < F.col("k") - 10), F.col("k"))).over(by))
    return r.where("stop is null or k < stop").select("article_id", "source_id", (F.col("k") > 10).alias("followup"))


@query("""select topic_id, row_number() over (order by article_count desc nulls last, last_seen_at desc nulls last,
    topic_id) as place from topics where status = 'ACTIVE' and article_count >= 2 order by 2 limit 200""")
def summary_queue(t):
    """Topics to summarise: most articles first, then the last seen."""
    w = Window.orderBy(F.desc_nulls_last("article_count"), F.desc_nulls_last("last_seen_at"), "topic_id")
    top = t("topics").where("status = 'ACTIVE' and article_count >= 2").orderBy(F.desc_nulls_last("article_count"), F.desc_nulls_last("last_seen_at"), "topic_id").limit(200)
    # at most 200 rows are ranked
    return top.select("topic_id", F.row_number().over(w).cast("bigint").alias("place"))


@query("select topic_id from topics where status = 'ACTIVE' order by last_seen_at desc nulls last, topic_id desc limit 50")
def recent_topics_cap(t):
    return t("topics").where("status = 'ACTIVE'").orderBy(F.desc_nulls_last("last_seen_at"), F.desc("topic_id")).limit(50).select("topic_id")


@query(f"""select section, string_agg(substr(title, 1, 300), ' | ' order by fetched_at desc, article_id desc) as titles from (select *, row_number() over (partition by section order by fetched_at desc, article_id desc) k from {ARTICLES} where section is not null) where k <= 5 and trim(title) <> '' group by 1""")
def recent_titles(t):
    """The five newest titles of each section, newest first."""
    k = F.row_number().over(Window.partitionBy("section").orderBy(F.desc("fetched_at"), F.desc("article_id")))
    top = articles(t).where("section is not null").select("section", "title", "fetched_at", "article_id").withColumn("k", k).where("k <= 5 and trim(title) <> ''")
    return top.groupBy("section").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.substring("title", 1, 300).alias("x")))), lambda r: r["x"]), " | ").alias("titles")
    )


_SCORED = """(select a, b, max(c) as c, 0.78 as th from (select least(trim(topic_id_a), trim(topic_id_b)) a, greatest(trim(topic_id_a), trim(topic_id_b)) b, "current" c from pairs where trim(topic_id_a) <> trim(topic_id_b) and not isnan("current") and "current" is not null) group by 1, 2)"""
_WHICH = "case when c >= th + 0.03 then 'SELECTED_HIGH_SCORE' when c >= th then 'SELECTED_NEAR_THRESHOLD' when c >= th - 0.03 then 'BELOW_THRESHOLD' end"


@query(f"""with p as (select *, {_WHICH} as bucket from {_SCORED}), x as (select *, row_number() over (partition by bucket order by abs(c - th), a, b) k from p where bucket is not null),
    y as (select *, row_number() over (partition by bucket, k <= 10 order by case when k > 10 then sha256('["' || a || '","' || b || '"]') end, a, b) d from x)
    select bucket, a, b, k <= 10 as boundary from y where k <= 10 or d <= 10""")
def boundary_samples(t):
    """Of each bucket of scores the ten nearest the threshold, and ten of the others in order of a digest: the same on every run."""
    p = t("pairs").where("trim(topic_id_a) <> trim(topic_id_b) and not isnan(current) and current is not null").groupBy(
        F.least(F.trim("topic_id_a"), F.trim("topic_id_b")).alias("a"),
        F.greatest(F.trim("topic_id_a"), F.trim("topic_id_b")).alias("b")
    ).agg(F.max("current").alias("c"))
    p = p.withColumn("th", F.lit(0.78)).withColumn("bucket", F.expr(_WHICH)).where("bucket is not null")
    near = p.withColumn(
        "k",
        F.row_number().over(Window.partitionBy("bucket").orderBy(F.abs(F.col("c") - F.col("th")), "a", "b"))
    ).where("k <= 10").select("bucket", "a", "b", F.lit(True).alias("boundary"))
    digest = F.sha2(F.concat(F.lit('["'), "a", F.lit('","'), "b", F.lit('"]')), 256)
    rest = p.join(near.select("a", "b"), ["a", "b"], "left_anti").withColumn("d", F.row_number().over(Window.partitionBy("bucket").orderBy(digest, "a", "b"))).where("d <= 10")
    return near.unionByName(rest.select("bucket", "a", "b", F.lit(False).alias("boundary")))


@query("select title_key, count(distinct coalesce(nullif(trim(source_id), ''), nullif(trim(source_name), ''))) as sources from articles group by 1")
def distinct_source_keys(t):
    key = F.coalesce(T.nonblank(F.trim("source_id")), T.nonblank(F.trim("source_name")))
    return t("articles").groupBy("title_key").agg(F.count_distinct(key).alias("sources"))


@query(f"""with e as (select source_id, article_id from {ARTICLES} where content_status = 'COMPLETE'), r as (select distinct source_id, duplicate_of_article_id as article_id from article_url_aliases)
    select e.source_id, count(*) as expected, count(r.article_id) as referenced, string_agg(case when r.article_id is null then e.article_id end, ',' order by e.article_id) is null as none_missing,
    case when count(*) = count(r.article_id) then 'COMPLETE_REFERENCES' else 'MISSING_REFERENCES' end as status
        from e left join r on r.source_id = e.source_id and r.article_id = e.article_id group by 1""")
def reference_coverage(t):
    """How many of the expected items are referred to, by source."""
    r = t("article_url_aliases").select("source_id", F.col("duplicate_of_article_id").alias("article_id"), F.lit(1).alias("hit")).distinct()
    by = articles(t).where("content_status = 'COMPLETE'").select("source_id", "article_id").join(r, ["source_id", "article_id"], "left").groupBy("source_id").agg(
        F.count("*").alias("expected"),
        F.count("hit").alias("referenced")
    )
    whole = F.col("expected") == F.col("referenced")
    return by.select("source_id", "expected", "referenced", whole.alias("none_missing"), F.when(whole, "COMPLETE_REFERENCES").otherwise("MISSING_REFERENCES").alias("status"))


_REASON = "case when status <> 'ACTIVE' then 'not active' when last_seen_at is null then 'no date' when last_seen_at < m - interval 36 hour then 'outside the window' when coalesce(article_count, 0) < 2 then 'one article' when coalesce(source_count, 0) < 2 then 'one source' else 'queued' end"


@query(f"select reason, count(*) as topics from (select {_REASON} as reason from topics, (select max(last_seen_at) as m from topics)) group by 1")
def skip_reasons(t):
    """Why topics are left out of the queue, each for the first reason that holds."""
    edge = t("topics").agg(F.max("last_seen_at").alias("m"))
    return t("topics").crossJoin(F.broadcast(edge)).groupBy(F.expr(_REASON.replace("interval 36 hour", "interval 36 hours")).alias("reason")).agg(F.count("*").alias("topics"))


@query(f"""select source_id, '{{' || string_agg('"' || section || '":' || n, ',' order by section) || '}}' as sizes from (select source_id, section, count(*) n from {ARTICLES} where section is not null group by 1, 2) group by 1""")
def section_sizes(t):
    """Sizes of a source's sections as one map."""
    n = articles(t).where("section is not null").groupBy("source_id", "section").agg(F.count("*").alias("n"))
    return n.groupBy("source_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("section", "n"))))).alias("sizes"))


@query("""with r as (select batch_no, min(fetched_at) as started_at from incoming_articles group by 1), c as (select batch_no,
    source_id, count(distinct incoming_id) as n from incoming_articles group by 1, 2)
    select c.source_id, r.batch_no, epoch_us(r.started_at) as started_us, c.n as fetched, sum(c.n) over (partition by c.source_id order by r.started_at, r.batch_no) as so_far from c join r on r.batch_no = c.batch_no""")
def run_results(t):
    """Results joined with their runs, with the running sum of each source over its runs (a row a run)."""
    i = t("incoming_articles")
    r = i.groupBy("batch_no").agg(F.min("fetched_at").alias("started_at"))
    c = i.groupBy("batch_no", "source_id").agg(F.count_distinct("incoming_id").alias("fetched"))
    return c.join(r, "batch_no").select(
        "source_id",
        "batch_no",
        F.unix_micros("started_at").alias("started_us"),
        "fetched",
        F.sum("fetched").over(Window.partitionBy("source_id").orderBy("started_at", "batch_no")).alias("so_far")
    )


@query(f"""with a as (select section as topic, article_id, source_id, title, fetched_at from {ARTICLES} where section is not null)
    select topic, count(*) as article_count, count(distinct source_id) as source_count, epoch_us(min(fetched_at)) as first_seen_us,
        epoch_us(max(fetched_at)) as last_seen_us, string_agg(distinct source_id, ',' order by source_id) as sources, arg_max(title,
        (fetched_at, article_id)) as newest_title from a group by 1""")
def topic_model(t):
    """A topic with what belongs to it, from links, articles and sources joined."""
    a = articles(t).where("section is not null").select(F.col("section").alias("topic"), "article_id", "source_id", "title", "fetched_at")
    return a.groupBy("topic").agg(
        F.count("*").alias("article_count"),
        F.count_distinct("source_id").alias("source_count"),
        F.unix_micros(F.min("fetched_at")).alias("first_seen_us"),
        F.unix_micros(F.max("fetched_at")).alias("last_seen_us"),
        F.array_join(F.array_sort(F.collect_set("source_id")), ",").alias("sources"),
        F.max_by("title", F.struct("fetched_at", "article_id")).alias("newest_title"),
    )


@query("""select user_id, string_agg(event_type, '>' order by ts, event_id) as kinds from (select user_id, event_type,
    min(ts) ts, arg_min(event_id, (ts, event_id)) event_id from events group by 1, 2) group by 1""")
def ordered_distinct(t):
    """Distinct values in order of their first occurrence."""
    first = t("events").groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("at"))
    # a few kinds a user
    return first.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "event_type"))), lambda x: x["event_type"]), ">").alias("kinds"))


@query("""select trim(topic_id_a) as topic_id, count(distinct trim(topic_id_b)) as others, bool_or(coalesce(same_generation, false)) as same_generation, max("current") filter (where not isnan("current")) as best from pairs where trim(topic_id_a) <> '' group by 1""")
def coalesced_groups(t):
    """Repeated groups of one topic as one: members united, any flag, the best score."""
    p = t("pairs").where("trim(topic_id_a) <> ''")
    return p.groupBy(F.trim("topic_id_a").alias("topic_id")).agg(
        F.count_distinct(F.trim("topic_id_b")).alias("others"),
        F.bool_or(F.coalesce("same_generation", F.lit(False))).alias("same_generation"),
        F.max(F.when(~F.isnan("current"), F.col("current"))).alias("best")
    )


@query(f"""select article_id from {ARTICLES} where coalesce(fetched_at, first_seen_at) >= (select max(fetched_at) from articles) - interval 24 hour""")
def still_fresh(t):
    """Fetched (or else first seen) within a day of the newest; undated ones aren't."""
    a = articles(t).select("article_id", "fetched_at", F.coalesce("fetched_at", "first_seen_at").alias("at"))
    return a.crossJoin(F.broadcast(a.agg(F.max("fetched_at").alias("m")))).where(F.col("at") >= F.col("m") - F.expr("interval 24 hours")).select("article_id")


#: Proposals to merge, with ids of one candidate group, of two, and an unknown one.
_EDGE = 'select least(trim(topic_id_a), trim(topic_id_b)) a, greatest(trim(topic_id_a), trim(topic_id_b)) b from pairs where trim(topic_id_a) <> trim(topic_id_b) and trim(topic_id_a) <> \'\' and trim(topic_id_b) <> \'\' and "current" >= 0.9 and not isnan("current")'


@query(f"""with recursive e as (select distinct * from ({_EDGE})), g as (select a, b from e union all select b,
    a from e), r(n, m) as (select a, a from g union select g.b, r.m from r join g on g.a = r.n where r.m < g.b),
    c as (select n, min(m) c from r group by n),
    p as (select distinct least(trim(topic_id_a), trim(topic_id_b)) a, greatest(trim(topic_id_a), trim(topic_id_b)) b from pairs where trim(topic_id_a) <> trim(topic_id_b))
    select p.a, p.b, x.c is not null and y.c is not null and x.c = y.c as in_scope from p left join c x on x.n = p.a left join c y on y.n = p.b""")
def scope_guard(t):
    """A proposal counts only if all its ids are of one candidate group."""
    from .graph import _linked

    c = _linked(t)
    p = t("pairs").select(
        F.trim("topic_id_a").alias("x"),
        F.trim("topic_id_b").alias("y")
    ).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    j = p.join(
        c.select(F.col("node").alias("a"), F.col("component").alias("ca")),
        "a",
        "left"
    ).join(c.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
    return j.select("a", "b", F.coalesce(F.col("ca") == F.col("cb"), F.lit(False)).alias("in_scope"))


#: Topics at the edges of the window, later than those of the tables.
PLANTED_TOPICS = [
    ("z1", "ACTIVE", "2027-06-01 00:00:00+00:00", 3),
    ("z2", "ACTIVE", "2027-05-30 12:00:00+00:00", 2),
    ("z3", "ACTIVE", "2027-05-30 11:59:59+00:00", 2),
    ("z4", "MERGED", "2027-06-01 00:00:00+00:00", 4),
    ("z5", "ACTIVE", "2027-05-31 00:00:00+00:00", 1),
    ("z6", "ACTIVE", None, 5),
]


@query(f"""with t as (select topic_id, status, last_seen_at, article_count from topics union all
        select topic_id, status, cast(seen as timestamptz), n from {sql_values(PLANTED_TOPICS)} v(topic_id, status, seen, n))
    select topic_id from t where status = 'ACTIVE' and last_seen_at >= (select max(last_seen_at) from t) - interval 36 hour and article_count >= 2""")
def rebuild_selection(t):
    """Topics whose updates are rebuilt: active, seen within 36 hours of the newest, with two updates or more."""
    rows = t("topics").select("topic_id", "status", "last_seen_at", "article_count")
    planted = rows.sparkSession.createDataFrame(PLANTED_TOPICS, "topic_id string, status string, seen string, article_count int")
    rows = rows.unionByName(planted.withColumn("last_seen_at", F.to_timestamp("seen")).drop("seen"))
    edge = rows.agg(F.max("last_seen_at").alias("m"))
    fresh = rows.crossJoin(F.broadcast(edge)).where(F.col("last_seen_at") >= F.col("m") - F.expr("interval 36 hours"))
    return fresh.where("status = 'ACTIVE' and article_count >= 2").select("topic_id")


@query("""with l as (select distinct duplicate_of_article_id as article_id from article_url_aliases union select 'absent'), h as (select distinct article_id from articles) select l.article_id, h.article_id is null as missing from l left join h on h.article_id = l.article_id""")
def missing_sources(t):
    """Stored references and whether what they refer to is still there; any missing one is an error to report with its id."""
    l = t("article_url_aliases").select(F.col("duplicate_of_article_id").alias("article_id"))
    l = l.union(l.sparkSession.createDataFrame([("absent",)], "article_id string")).distinct()
    return l.join(t("articles").select("article_id", F.lit(True).alias("there")).distinct(), "article_id", "left").select("article_id", F.col("there").isNull().alias("missing"))


@query(f"""select md5(coalesce(headline_pl, '')) as key, min(topic_id) as first_topic, count(*) as uses from topics group by 1""")
def input_variants(t):
    """Each distinct input once, with the topics that use it counted."""
    return t("topics").groupBy(F.md5(F.coalesce("headline_pl", F.lit(""))).alias("key")).agg(F.min("topic_id").alias("first_topic"), F.count("*").alias("uses"))


_GUARD = sql_values([("Kurier Lipny",), ("KURIER LIPNY ",), ("nobody",), ("",)])


@query(f"""select q.q as asked, count(s.source_id) as hits, case when count(s.source_id) = 1 then min(s.source_id) end as source_id from (select * from {_GUARD} v(q)) q left join sources s on trim(q.q) <> '' and (lower(trim(q.q)) = lower(s.source_id) or lower(trim(q.q)) = lower(trim(s.name))) group by 1""")
def source_lookup(t):
    """A source by its id or name, letter case aside; only a single hit counts."""
    asked = t("sources").sparkSession.createDataFrame([("Kurier Lipny",), ("KURIER LIPNY ",), ("nobody",), ("",)], "asked string")
    s = t("sources").select(
        "source_id",
        F.array_distinct(F.array(F.lower("source_id"), F.lower(F.trim("name")))).alias("names")
    ).select("source_id", F.explode("names").alias("key"))
    keyed = asked.withColumn("key", T.nonblank(F.lower(F.trim("asked"))))
    return keyed.join(s, "key", "left").groupBy("asked").agg(F.count("source_id").alias("hits"), F.min("source_id").alias("one")).select(
        "asked",
        "hits",
        F.when(F.col("hits") == 1, F.col("one")).alias("source_id")
    )
