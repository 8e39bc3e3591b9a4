"""Timestamps: the queries of written times, and SQL that reads every form one by one."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import instants
from .registry import ARTICLES, articles, query

_S = r"[\s\x{00A0}]"
_TIME = r"(\d{1,2})[:.hH](\d{2})(?:[:.](\d{2})(?:[.,]\d{1,9})?)?"
_ZONE = rf"(?:{_S}*(Z|[A-Za-z]{{2,4}}|(?:GMT|UTC)?[+\-−]\d{{2}}(?::?\d{{2}})?)(?:\[[\w/+\-]+\])?)?"
_GAP = rf"(?:,?{_S}+(?:um|at|à|alle|a las|o|об|в|о|kl\.?)?{_S}*|{_S}*[,·|–—-]{_S}*)"
_HALF = rf"(?:{_S}*([AaPp])\.?[Mm]\.?)?"
_DAY_NAME = rf"(?:\p{{L}}{{2,12}}\.?,?{_S}+)?"
_LEAD = rf"^(?:\p{{L}}[\p{{L}} ]{{0,24}}:{_S}*|(?:publié|pubblicato|publicado|opublikowano|published|veröffentlicht|опубліковано|опубликовано|actualizado|mis à jour|updated){_S}+(?:le|il|el|on|am)?{_S}*)?(?:\p{{L}}{{2,12}}\.?,{_S}*)?"
# each form with the names of its groups, in the order in which they are tried
_FORMS = [
    (rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})(?:[Tt]|{_S}+|$)(?:{_TIME}{_ZONE})?$", "y m d h n s z"),
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}})(?:[Tt ]?(\d{{2}})(\d{{2}})(\d{{2}})?(?:[.,]\d{{1,9}})?{_ZONE})?$", "y m d h n s z"),
    (rf"^(\d{{1,2}})([/.\-])(\d{{1,2}})([/.\-])(\d{{4}})(?:{_GAP}{_TIME}{_HALF}(?:{_S}*Uhr)?{_ZONE})?$", "a q b r y h n s p z"),
    (
        rf"^{_DAY_NAME}(\d{{1,2}})(?:\.|er|º|-го)?[\s\x{{00A0}}-]+(?:de{_S}+)?(\p{{L}}{{3,12}})\.?[\s\x{{00A0}}-]+(?:de{_S}+)?(\d{{4}})(?:{_S}*(?:r\.|р\.|г\.|року|года|roku))?(?:{_GAP}{_TIME}{_HALF}(?:{_S}*Uhr)?{_ZONE})?$",
        "d w y h n s p z"
    ),
    (rf"^{_DAY_NAME}(\p{{L}}{{3,12}})\.?{_S}+(\d{{1,2}})(?:st|nd|rd|th)?,?{_S}+(\d{{4}})(?:{_GAP}{_TIME}{_HALF}{_ZONE})?$", "w d y h n s p z"),
]


def epochs_sql(relation: str, keep: str) -> str:
    """A subquery with the columns `keep` and epoch_s of the rows of `relation` (keep, x: text, tz, ord)."""
    parts = []
    for k, (pattern, names) in enumerate(_FORMS):
        listed = ", ".join(f"'{n}'" for n in names.split())
        parts.append(f"case when regexp_matches(t, '(?i){pattern}') then regexp_extract(t, '(?i){pattern}', [{listed}]) end as f{k}")
    have = {n: [k for k, (_, names) in enumerate(_FORMS) if n in names.split()] for n in "y m d h n s z w p a b q r".split()}
    # the first form that matches counts, the one of all digits with two signs only if they are the same
    which = "case when f0 is not null then 0 when f1 is not null then 1 when f2 is not null and f2.q = f2.r then 2 when f3 is not null then 3 when f4 is not null then 4 end"
    get = lambda n: "case form " + " ".join(f"when {k} then nullif(f{k}.{n}, '')" for k in have[n]) + " end"
    month = "case " + " ".join(f"when lower(w) in ({', '.join(repr(x) for x in names.split())}) then {m}" for m, names in instants.MONTHS.items()) + " end"
    zones = "case zz " + " ".join(f"when '{z}' then {m}" for z, m in instants.ABBREVIATIONS.items()) + " end"
    offset = "(epoch(timezone(tz, to_timestamp({0}))) - ({0}))"
    return f"""(with t0 as (select {keep}, trim(regexp_replace(regexp_replace(x, '^{_S}+|{_S}+$', '', 'g'), '(?i){_LEAD}',
    '')) as t, regexp_replace(x, '^{_S}+|{_S}+$', '', 'g') as whole, coalesce(tz, 'UTC') as tz, coalesce(ord, 'DMY') as ord
    from {relation} where x is not null),
        t1 as (select *, {', '.join(parts)} from t0), t2 as (select *, {which} as form from t1),
        t3 as (select {keep}, whole, tz, ord, form, {', '.join(f"{get(n)} as {n}" for n in "y m d h n s z w p a b q".split())} from t2),
        t4 as (select *, cast(y as int) yy, case when form = 2 then case when q = '/' and ord = 'MDY' then cast(a as int)
            else cast(b as int) end when form in (3, 4) then {month} else cast(m as int) end mm,
            case when form = 2 then case when q = '/' and ord = 'MDY' then cast(b as int) else cast(a as int) end
                else cast(d as int) end dd, coalesce(cast(h as int), 0) h0, coalesce(cast(n as int), 0) nn, coalesce(cast(s as int),
                0) ss, upper(replace(replace(coalesce(z, ''), '−', '-'), ':', '')) zz from t3),
        t5 as (select *, case when p is null then h0 when h0 between 1 and 12 then h0 % 12 + case when lower(p) = 'p' then 12 else 0 end end hh,
            case when mm in (4, 6, 9, 11) then 30 when mm = 2 then case when (yy % 4 = 0 and yy % 100 <> 0) or yy % 400 = 0 then 29 else 28 end else 31 end longest from t4),
        t6 as (select *, case when yy >= 1000 and mm between 1 and 12 and dd between 1 and longest and hh between 0
            and 23 and nn <= 59 and ss <= 60 then cast(epoch(make_date(yy, mm, dd)) as bigint) + hh * 3600 + nn * 60 + least(ss,
            59) end as loc,
            regexp_extract(zz, '([+-])\\d{{2,4}}$', 1) sg, regexp_extract(zz, '[+-](\\d{{2,4}})$', 1) dg from t5),
        t7 as (select *, case when loc is not null and zz = '' then cast({offset.format("loc - 86400")} as bigint) end o1,
            case when loc is not null and zz = '' then cast({offset.format("loc + 86400")} as bigint) end o2 from t6)
        select {keep}, cast(case when regexp_matches(whole, '^\\d{{9,10}}(?:\\.\\d+)?$') then cast(regexp_extract(whole,
            '^(\\d+)', 1) as bigint) when form is null and regexp_matches(whole, '^\\d{{12,13}}$') then cast(whole as bigint) // 1000
            when form is null and regexp_matches(whole, '^\\d{{15,16}}$') then cast(whole as bigint) // 1000000
            when zz <> '' and dg <> '' then loc - (case sg when '-' then -1 else 1 end) * (cast(substr(dg, 1, 2) as int) * 3600 + coalesce(try_cast(nullif(substr(dg,
                3, 2), '') as int), 0) * 60) when zz <> '' then loc - {zones} * 60
            when o1 = o2 or {offset.format("loc - o1")} = o1 or {offset.format("loc - o2")} <> o2 then loc - o1 else loc - o2 end as bigint) as epoch_s from t7)"""


_WRITTEN = f"(select a.article_id, f.field, case f.field when 'published_at' then a.published_at else a.updated_at end as x, s.time_zone as tz, s.date_order as ord from {ARTICLES} a cross join (values ('published_at'), ('updated_at')) f(field) left join sources s on s.source_id = a.source_id where a.article_id is not null)"


@query(f"select article_id, field, epoch_s from {epochs_sql(_WRITTEN, 'article_id, field')} where epoch_s is not null")
def p7_found(t):
    return instants.found_instants(t("articles"), t("sources"))


_URL_DAY = "regexp_extract(coalesce(canonical_url, ''), '(20\\d{2}[/-]\\d{2}[/-]\\d{2})(?:[/_-]|$)', 1)"
_DATES = f"""(select article_id, source_id, u.k, case u.k when 1 then published_at when 2 then updated_at else nullif({_URL_DAY}, '') end as x, cast(null as varchar) as tz, cast(null as varchar) as ord from {ARTICLES} cross join (values (1), (2), (3)) u(k) where article_id is not null)"""


@query(f"""with e as (select article_id, source_id, coalesce(arg_min(epoch_s, k) filter (where epoch_s is not null), 0) as epoch_s from {epochs_sql(_DATES, 'article_id, source_id, k')} group by 1, 2),
    a as (select article_id, source_id, coalesce(e.epoch_s, 0) as epoch_s from (select article_id, source_id from {ARTICLES} where article_id is not null) left join e using (article_id, source_id))
    select article_id, source_id, epoch_s, place from (select *, row_number() over (partition by source_id order by epoch_s desc, article_id) as place from a) where place <= 500""")
def candidate_timestamp_order(t):
    """Each source's articles, newest first, undated ones last: by published_at in any written form, else updated_at, else a date in the address.

    Times without a zone are UTC. The place is that within the first 500, the most that a harvest takes of a source.
    """
    url = F.regexp_extract(F.coalesce("canonical_url", F.lit("")), r"(20\d{2}[/-]\d{2}[/-]\d{2})(?:[/_-]|$)", 1)
    a = articles(t).where("article_id is not null").select("article_id", "source_id", "published_at", "updated_at", url.alias("dated"), F.lit(None).cast("string").alias("zone"))
    for text, out in (("published_at", "first"), ("updated_at", "second"), ("dated", "third")):
        a = instants.with_epoch(a, text, "zone", "zone", out)
    k = F.coalesce("first", "second", "third", F.lit(0))
    w = Window.partitionBy("source_id").orderBy(F.desc("epoch_s"), "article_id")
    # a top-k by source: ranks are cut before the shuffle
    return a.select(
        "article_id",
        "source_id",
        k.alias("epoch_s")
    ).withColumn("place", F.row_number().over(w)).where("place <= 500").withColumn("place", F.col("place").cast("bigint"))
