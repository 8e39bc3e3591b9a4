"""Similarity, grouping and merge queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import cluster, similarity
from ..session import cut_lineage
from .registry import query
from .textual import _COMMON, _HEADLINES, _headlines

PAIRS_AT, GROUPS_AT = 0.30, 0.40
_UNIT = "(select vec_id, list_transform(embedding, lambda x: cast(x as double)) v from embeddings where embedding is not null)"
_COS = f"(select x.vec_id a, y.vec_id b, list_cosine_similarity(x.v, y.v) s from {_UNIT} x join {_UNIT} y on x.vec_id < y.vec_id)"


def _round(df):
    return df.select("a", "b", F.round("similarity", 6).alias("similarity"))


@query(f"select a, b, round(s, 6) as similarity from {_COS} where s >= {PAIRS_AT}")
def cosine_all_pairs(t):
    return _round(similarity.cosine_pairs(t("embeddings"), PAIRS_AT))


@query(f"select a, b, round(s, 6) as similarity from {_COS} where s >= {PAIRS_AT} and (a % 20 = 0 or b % 20 = 0)")
def cosine_focus_pairs(t):
    """New vectors (here ids divisible by 20) against all."""
    return _round(similarity.cosine_pairs(t("embeddings"), PAIRS_AT, focus=t("embeddings").where("vec_id % 20 = 0")))


@query(f"""select id, other, row_number() over (partition by id order by s desc, other desc) as place from (select a as id, b as other, round(s, 6) s from {_COS} where s >= {PAIRS_AT} and a % 20 = 0
    union all select b, a, round(s, 6) from {_COS} where s >= {PAIRS_AT} and b % 20 = 0)""")
def neighbour_rank(t):
    """All neighbours of the vectors asked for (ids divisible by 20) by rank: similarity, ties by the larger id."""
    from pyspark.sql import Window

    asked = F.col("id") % 20 == 0
    p = _round(similarity.cosine_pairs(t("embeddings"), PAIRS_AT, focus=t("embeddings").where("vec_id % 20 = 0")))
    both = p.select(F.col("a").alias("id"), F.col("b").alias("other"), "similarity").unionByName(
        p.select(F.col("b").alias("id"), F.col("a").alias("other"), "similarity")
    ).where(asked)
    return both.select("id", "other", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), F.desc("other"))).cast("bigint").alias("place"))


@query(f"select cast(floor(round(s, 9) * 50) as bigint) as band, count(*) as pairs from {_COS} where s >= {PAIRS_AT} group by 1")
def pair_bands(t):
    p = similarity.cosine_pairs(t("embeddings"), PAIRS_AT)
    return p.groupBy(F.floor(F.round("similarity", 9) * 50).alias("band")).agg(F.count("*").alias("pairs"))


@query("select vec_id, cast(len(embedding) as int) as width, round(sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * x))), 5) as norm from embeddings where embedding is not null")
def vector_validation(t):
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return t("embeddings").where("embedding is not null").select("vec_id", F.size("embedding").alias("width"), F.round(norm, 5).alias("norm"))


def _edges(t):
    return similarity.cosine_pairs(t("embeddings"), GROUPS_AT).withColumnRenamed("similarity", "score")


_REACH = f"""with recursive e as (select a, b from {_COS} where s >= {GROUPS_AT}), g as (select a, b from e union all select b, a from e),
    r(n, m) as (select a, a from g union select g.b, r.m from r join g on g.a = r.n where r.m < g.b), c as (select n, min(m) c from r group by n)"""


@query(f"{_REACH} select n as node, c as component from c")
def connected_components(t):
    return cluster.components(_edges(t))


@query(f"""{_REACH} select c.c as component, count(*) as members, min(n) as canonical, string_agg(distinct cast(label as varchar),
    ',' order by cast(label as varchar)) as labels from c join embeddings on vec_id = n group by c.c""")
def merge_remap_recount(t):
    """Counters after the groups are merged into their canonical member."""
    c = cluster.components(_edges(t)).join(t("embeddings").select(F.col("vec_id").alias("node"), "label"), "node")
    return c.groupBy("component").agg(
        F.count("*").alias("members"),
        F.min("node").alias("canonical"),
        F.array_join(F.array_sort(F.collect_set(F.col("label").cast("string"))), ",").alias("labels")
    )


_LINKED = """with recursive e as (select distinct least(trim(topic_id_a), trim(topic_id_b)) a, greatest(trim(topic_id_a),
    trim(topic_id_b)) b from pairs where trim(topic_id_a) <> trim(topic_id_b) and trim(topic_id_a) <> '' and trim(topic_id_b) <> ''
    and "current" >= 0.9 and not isnan("current")),
    g as (select a, b from e union all select b, a from e), r(n, m) as (select a, a from g union select g.b, r.m
        from r join g on g.a = r.n where r.m < g.b), c as (select n, min(m) c from r group by n)"""


def _linked(t):
    p = t("pairs").where("current >= 0.9 and not isnan(current)").select(F.trim("topic_id_a").alias("a"), F.trim("topic_id_b").alias("b"))
    return cluster.components(p.where("a <> b and a <> '' and b <> ''"))


@query(f"""{_LINKED} select c as component, arg_min(n, (coalesce(needs_review, true), first_seen_at is null, coalesce(first_seen_at, timestamptz '9999-12-31 23:59:59+00'), -coalesce(article_count, 0), n)) as canonical from c left join topics on topic_id = n group by c""")
def canonical_choice(t):
    """The topic that a merged group keeps: one with a reviewed synthesis before others, then the first seen, the one of most articles, the smallest id."""
    x = _linked(t).join(t("topics").withColumnRenamed("topic_id", "node"), "node", "left")
    key = F.struct(
        F.coalesce("needs_review", F.lit(True)),
        F.col("first_seen_at").isNull(),
        F.coalesce("first_seen_at", F.to_timestamp(F.lit("9999-12-31 23:59:59+00:00"))),
        -F.coalesce("article_count", F.lit(0)),
        F.col("node")
    )
    return x.groupBy("component").agg(F.min_by("node", key).alias("canonical"))


@query(f"""{_LINKED}, k as (select c, arg_min(n, (coalesce(needs_review, true), first_seen_at is null, coalesce(first_seen_at,
    timestamptz '9999-12-31 23:59:59+00'), -coalesce(article_count, 0), n)) as canonical from c left join topics on topic_id = n
    group by c)
    select canonical as topic_id, epoch_us(min(first_seen_at)) as first_seen_us, epoch_us(max(last_seen_at)) as last_seen_us, bool_or(coalesce(needs_review,
        false)) as needs_review, sum(coalesce(article_count, 0)) as article_count, count(*) as merged from c join k using (c)
        left join topics on topic_id = n group by 1 having count(*) >= 2""")
def merged_topics(t):
    """Groups merged into their canonical topic: earliest and latest sight, any review, articles together."""
    x = _linked(t).join(t("topics").withColumnRenamed("topic_id", "node"), "node", "left")
    return x.groupBy("component").agg(
        F.min_by(
            "node",
            F.struct(
                F.coalesce("needs_review", F.lit(True)),
                F.col("first_seen_at").isNull(),
                F.coalesce("first_seen_at", F.to_timestamp(F.lit("9999-12-31 23:59:59+00:00"))),
                -F.coalesce("article_count", F.lit(0)),
                F.col("node")
            )
        ).alias("topic_id"),
        F.unix_micros(F.min("first_seen_at")).alias("first_seen_us"), F.unix_micros(F.max("last_seen_at")).alias("last_seen_us"), F.bool_or(
            F.coalesce("needs_review", F.lit(False))
        ).alias("needs_review"), F.sum(F.coalesce("article_count", F.lit(0))).alias("article_count"), F.count("*").alias("merged"),
    ).where("merged >= 2").drop("component")


@query(f"""{_LINKED}, f as (select distinct topic_id from topics where status = 'ACTIVE' and article_count >= 5) select distinct coalesce(c.c, f.topic_id) as topic_id from f left join c on c.n = f.topic_id""")
def focus_after_merge(t):
    """A focus set follows merges: merged members are replaced by their group's id."""
    f = t("topics").where("status = 'ACTIVE' and article_count >= 5").select(F.col("topic_id").alias("node")).distinct()
    return f.join(_linked(t), "node", "left").select(F.coalesce("component", "node").alias("topic_id")).distinct()


_ADJACENT = "j as (select th, n, list(m) l from (select th, a n, b m from e union all select th, b, a from e) group by 1, 2)"
# one edge after another, strongest first, with the list of nodes taken so far
_ANCHORED = f"""with recursive w as (select th, a, b, round(s, 12) s from {_COS}, (values (0.36), (0.40), (0.44),
    (0.48)) v(th) where s >= th - 1e-12 and s >= 0.35), e as (select *, row_number() over (partition by th order by s desc,
    a, b) k from w), {_ADJACENT},
    r as (select th, cast(0 as bigint) k, cast([] as bigint[]) used, cast([] as bigint[]) mem, cast(null as bigint) a, cast(null as bigint) b, cast(null as double) s from (select distinct th from e)
        union all select e.th, e.k, case when not list_contains(used, e.a) and not list_contains(used, e.b) then list_concat(used,
            [e.a, e.b], list_filter(list_intersect(x.l, y.l), lambda m: not list_contains(used, m))) else used end,
        case when not list_contains(used, e.a) and not list_contains(used, e.b) then list_concat([e.a, e.b], list_filter(list_intersect(x.l,
            y.l), lambda m: not list_contains(used, m))) else [] end, e.a, e.b, e.s
        from r join e on e.th = r.th and e.k = r.k + 1 join j x on x.th = e.th and x.n = e.a join j y on y.th = e.th and y.n = e.b),
    g as (select th, k, a, b, s, list_min(mem) as group_id, unnest(mem) as member from r where len(mem) > 0)"""


@query(f"""{_ANCHORED}, l as (select g.*, least(p.s, q.s) as near from g left join e p on p.th = g.th and p.a = least(g.a,
    g.member) and p.b = greatest(g.a, g.member) left join e q on q.th = g.th and q.a = least(g.b, g.member) and q.b = greatest(g.b,
    g.member) where g.th = {GROUPS_AT})
    select group_id, member, member in (a, b) as is_anchor, round(s, 6) as anchor_score, round(least(s, min(case
        when member not in (a, b) then near end) over (partition by k)), 6) as least_score from l""")
def anchored_groups(t):
    return cluster.anchored_groups(_edges(t), GROUPS_AT).withColumn("anchor_score", F.round("anchor_score", 6)).withColumn("least_score", F.round("least_score", 6))


# the edges of each component as one list; the rule then goes on step by step
_LISTED = f"{_REACH}, z as (select c.c as component, list({{'a': e.a, 'b': e.b, 's': round(e.s, 12)}}) as edges from (select a, b, s from {_COS} where s >= {GROUPS_AT}) e join c on c.n = e.a group by 1)"
_FREE_END = "lambda e: list_contains(g, e.a) <> list_contains(g, e.b)"


@query(f"""{_LISTED}, k as (select component, cast(0 as int) as no, edges as rest, cast([] as bigint[]) as g, false as closed from z
        union all
        select component, case when closed then no + 1 else no end, case when closed then list_filter(rest, lambda e: not (list_contains(g, e.a) and list_contains(g, e.b))) else rest end,
            case when closed then [] when len(g) = 0 then [best.a, best.b] when next is not null and len(g) < 6 then list_append(g, next) else g end,
            case when closed or len(g) = 0 then false else not (next is not null and len(g) < 6) end
        from (select *, list_sort(list_transform(rest, lambda e: {{'s': e.s, 'a': e.a, 'b': e.b}}), 'DESC')[1] as best,
            (list_sort(list_transform(list_distinct(list_transform(list_filter(rest, {_FREE_END}), lambda e: case when list_contains(g, e.a) then e.b else e.a end)),
                lambda m: {{'s': list_sum(list_transform(list_filter(rest, lambda e: (e.a = m and list_contains(g, e.b)) or (e.b = m and list_contains(g, e.a))), lambda e: e.s)),
                    'n': len(list_filter(rest, lambda e: (e.a = m and list_contains(g, e.b)) or (e.b = m and list_contains(g, e.a)))), 'm': m}}), 'DESC')[1]).m as next
            from k where len(rest) > 0))
    select component, no as group_no, unnest(g) as member from k where closed""")
def edge_cover_groups(t):
    """Overlapping groups of six at most that hold every edge: the strongest edge left, and who adds most to it, one after the other."""
    return cluster.edge_cover(_edges(t), 6)


_DEGREE = "len(list_filter(edges, lambda e: (e.a = {0} and list_contains(free, e.b)) or (e.b = {0} and list_contains(free, e.a))))"


@query(f"""{_LISTED}, k as (select component, edges, list_distinct(flatten(list_transform(edges, lambda e: [e.a, e.b]))) as free, cast([] as bigint[]) as queue, cast([] as bigint[]) as seen,
            cast([] as bigint[]) as chunk, cast([] as bigint[][]) as chunks, cast([] as bigint[]) as alone from z
        union all
        select component, edges, case when walking then list_filter(free, lambda n: n <> queue[1]) else free end,
            case when walking then list_concat(queue[2:], fresh) when len(chunk) > 0 then [] else [dense] end,
            case when walking then list_concat(seen, fresh) when len(chunk) > 0 then [] else [dense] end,
            case when walking then list_append(chunk, queue[1]) else [] end,
            case when not walking and len(chunk) > 1 then list_append(chunks, chunk) else chunks end,
            case when not walking and len(chunk) = 1 then list_concat(alone, chunk) else alone end
        from (select *, len(queue) > 0 and len(chunk) < 5 as walking, (list_sort(list_transform(free, lambda n: {{'d': {_DEGREE.format('n')}, 'n': n}}), 'DESC')[1]).n as dense,
            list_transform(list_sort(list_transform(list_filter(free, lambda m: m <> queue[1] and not list_contains(seen, m) and len(list_filter(edges, lambda e: (e.a = m and e.b = queue[1]) or (e.b = m and e.a = queue[1]))) > 0),
                lambda m: {{'d': -len(list_filter(edges, lambda e: (e.a = m and e.b <> queue[1] and list_contains(free, e.b)) or (e.b = m and e.a <> queue[1] and list_contains(free, e.a)))), 'm': m}})), lambda x: x.m) as fresh
            from k where len(free) > 0 or len(chunk) > 0)),
    f as (select component, chunks, alone from k where len(free) = 0 and len(chunk) = 0),
    x as (select component, chunks, list_transform(range(0, cast(len(alone) as bigint), 5), lambda i: alone[i + 1:i + 5]) as extra, alone from f),
    y as (select component, case when len(extra) > 1 and len(extra[len(extra)]) = 1 then list_concat(chunks, extra[1:len(extra) - 2], [extra[len(extra) - 1][1:4], list_prepend(extra[len(extra) - 1][5], extra[len(extra)])])
        else list_concat(chunks, list_filter(extra, lambda c: len(c) > 1)) end as parts from x),
    u as (select component, unnest(parts) as part, generate_subscripts(parts, 1) - 1 as no from y)
    select component, cast(no as int) as chunk_no, unnest(part) as member from u""")
def bounded_chunks(t):
    """Disjoint chunks of five at most, walked from the densest node; what is left alone is gathered in chunks of its own."""
    return cluster.bounded_chunks(_edges(t), 5)


@query(f"{_REACH} select n as member, c as merged_id from c")
def overlapping_groups(t):
    """Groups that overlap become one, so those that cover all edges become the components."""
    return cluster.merged_groups(cluster.edge_cover(_edges(t), 6).select(F.concat_ws("-", "component", "group_no").alias("g"), "member"), "g", "member")


@query(f"{_ANCHORED} select cast(th as double) as threshold, count(distinct group_id) as groups, count(*) as nodes from g group by th")
def threshold_sweep(t):
    """Number of groups and grouped nodes at each threshold; the pairs are computed once and kept."""
    e = cut_lineage(similarity.cosine_pairs(t("embeddings"), 0.35).withColumnRenamed("similarity", "score"))
    out = None
    for at in (0.36, 0.40, 0.44, 0.48):
        g = cluster.anchored_groups(e, at)
        row = g.agg(F.lit(at).alias("threshold"), F.count_distinct("group_id").alias("groups"), F.count("*").alias("nodes")).where("nodes > 0")
        out = row if out is None else out.unionByName(row)
    return out


_FOLD = f"regexp_replace(translate(replace(lower(x), 'ß', 'ss'), '{T.ACCENTED}', '{T.PLAIN}'), '[^a-z0-9]+', '', 'g')"
_STEM = "case " + " ".join(f"when b like '%{x}' and length(b) - {len(x)} >= 5 then substr(b, 1, length(b) - {len(x)})" for x in T.SUFFIXES) + " else b end"


@query(f"""with r as (select topic_id, regexp_extract_all(headline_pl, '[\\p{{L}}][\\p{{L}}\\p{{N}}_''-]{{2,}}') l
    from {_HEADLINES} where topic_id is not null), w as (select topic_id, unnest(l) x, generate_subscripts(l, 1) i
    from r),
    b as (select topic_id, i, {_FOLD} b from w), s as (select topic_id, i, b, {_STEM} s from b where length(b) >= 4
        and b not in {_COMMON} and {_STEM} not in {_COMMON}), q as (select topic_id, b, s, lead(s) over (partition by topic_id
        order by i) n from s),
    n as (select count(distinct topic_id) n from {_HEADLINES}), t as (select distinct 's' kind, topic_id, s t from q
        union all select distinct 'p', topic_id, s || ' ' || n from q where n is not null and n <> s),
    f as (select kind, t from t, n group by kind, t, n.n having count(*) > 1 and count(*) <= case when kind = 's'
        then greatest(8, least(30, case when n.n // 5 = 0 then 1 else n.n // 5 end)) else greatest(5, least(20,
        case when n.n // 10 = 0 then 1 else n.n // 10 end)) end),
    k as (select t.* from t join f using (kind, t)),
    e as (select x.topic_id a, y.topic_id b, count(*) filter (where x.kind = 's') as stems, count(*) filter (where x.kind = 'p') as phrases
        from k x join k y on x.kind = y.kind and x.t = y.t and x.topic_id < y.topic_id group by 1, 2),
    g as (select topic_id, list(distinct b) l from s group by 1)
    select e.a, e.b, stems, phrases, len(list_intersect(x.l, y.l)) as exact, stems + 2.0 * phrases + 0.25 * len(list_intersect(x.l,
        y.l)) as score from e join g x on x.topic_id = e.a join g y on y.topic_id = e.b where stems >= 3 or phrases >= 1""")
def lexical_pairs(t):
    return similarity.lexical_edges(_headlines(t), "topic_id", ["headline_pl"])


# Words that don't tell topics apart.
STOP = """artykuł artykuły artykułów temat tematy sprawa sprawy wydarzenie wydarzenia świat polska polskie polski światowy pierwszy pierwsza pierwsze nowy nowa nowe ważny ważne aktualizacja aktualizacje
    informacje wiadomości sytuacja komentarze historyczny historyczne kontekst wyniki during first latest news update world""".split()
_STOPPED = "(" + ", ".join(f"'{w}'" for w in STOP) + ")"


@query(f"""with k as (select topic_id, list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(lower(coalesce(headline_pl,
    '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' '), lambda w: length(w) >= 4 and w not in {_STOPPED}))) t from topics
    where topic_id is not null),
    w as (select topic_id, unnest(t) w from k), m as (select l.topic_id, r.topic_id as other from w l join w r on l.w = r.w and l.topic_id <> r.topic_id group by 1, 2 having count(*) >= 2),
    c as (select t, min(topic_id) as class_id from k group by t)
    select k.topic_id as id, c.class_id, (select count(*) from m where m.topic_id = k.topic_id) as links from k join c on c.t = k.t""")
def token_pairs(t):
    """Topics that share two words of their headlines or more, without any cut by frequency: each topic's class of equal word sets, and its number of links."""
    words = F.filter(F.split(F.trim(F.regexp_replace(F.lower(F.coalesce("headline_pl", F.lit(""))), r"[^\p{L}\p{N}]+", " ")), " "), lambda w: (F.length(w) >= 4) & ~w.isin(*STOP))
    return similarity.token_set_links(t("topics").select("topic_id", words.alias("t")), "topic_id", "t")


@query(f"""with h as (select topic_id, trim(regexp_replace(regexp_replace(lower(headline_pl), '^\\s*\\[[^\\]]+\\]\\s*',
    ''), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) hk, regexp_extract_all(regexp_replace(headline_pl, '^\\[[^\\]]+\\]\\s*',
    ''), '[\\p{{L}}][\\p{{L}}\\p{{N}}_''-]{{2,}}') l from topics where headline_pl is not null),
    w as (select topic_id, unnest(l) x, generate_subscripts(l, 1) i from h), b as (select topic_id, i, {_FOLD} b
        from w), s as (select topic_id, i, {_STEM} s from b where length(b) >= 4 and b not in {_COMMON} and {_STEM} not in {_COMMON}),
    q as (select topic_id, s, lead(s) over (partition by topic_id order by i) n from s), g as (select topic_id,
        list_distinct(list(s)) st, list_distinct(list(s || ' ' || n) filter (where n <> s)) ph from q group by 1),
    p as (select distinct least(trim(topic_id_a), trim(topic_id_b)) a, greatest(trim(topic_id_a), trim(topic_id_b)) b from pairs where trim(topic_id_a) <> trim(topic_id_b))
    select p.a, p.b, case when x.hk = y.hk then x.hk <> '' else coalesce(len(list_intersect(gx.st, gy.st)), 0) >= 2
        and len(list_filter(list_intersect(gx.st, gy.st), lambda z: z not in ('trump', 'putin', 'ukrain', 'rosji',
        'rosja', 'wojna', 'wojny', 'macron', 'francji', 'francja'))) > 0
        and (coalesce(len(list_intersect(gx.ph, gy.ph)), 0) > 0 or len(list_intersect(gx.st, gy.st)) * 1.0 / greatest(1, least(len(gx.st), len(gy.st))) >= 0.45) end as same_event
    from p join h x on x.topic_id = p.a join h y on y.topic_id = p.b left join g gx on gx.topic_id = p.a left join g gy on gy.topic_id = p.b""")
def same_event_anchor(t):
    """Whether two scored topics have an event in common: the same headline, or two shared stems, one of them not broad, and a shared phrase or 45 in 100 of the shorter's stems."""
    h = F.col("headline_pl")
    s = T.stems(F.regexp_replace(h, r"^\[[^\]]+\]\s*", ""))
    c = t("topics").where("headline_pl is not null").select("topic_id", T.headline_key(h).alias("hk"), F.array_distinct(s).alias("st"), T.phrases(s).alias("ph"))
    side = lambda x: c.select(F.col("topic_id").alias(x), *[F.col(n).alias(f"{n}_{x}") for n in ("hk", "st", "ph")])
    p = t("pairs").select(
        F.trim("topic_id_a").alias("x"),
        F.trim("topic_id_b").alias("y")
    ).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    shared = F.array_intersect("st_a", "st_b")
    meaningful = F.filter(shared, lambda z: ~z.isin("trump", "putin", "ukrain", "rosji", "rosja", "wojna", "wojny", "macron", "francji", "francja"))
    close = (F.size(F.array_intersect("ph_a", "ph_b")) > 0) | (F.size(shared) / F.greatest(F.lit(1), F.least(F.size("st_a"), F.size("st_b"))) >= 0.45)
    same = F.when(F.col("hk_a") == F.col("hk_b"), F.col("hk_a") != "").otherwise((F.size(shared) >= 2) & (F.size(meaningful) > 0) & close)
    return p.join(side("a"), "a").join(side("b"), "b").select("a", "b", same.alias("same_event"))
