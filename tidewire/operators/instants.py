"""Normalise publisher timestamps to UTC instants.

All accepted forms are compiled into one regular expression with named groups. One
`regexp_replace` pulls every component out of the text at once; month names, zones and
offsets become numbers through literal maps; calendar ranges are checked; the instant is
put together with integer day arithmetic. Everything stays in generated JVM code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Months by name in the supported languages (genitive and nominative) and abbreviations.
MONTHS = {
    1: "january jan janvier janv januar jänner gennaio gen enero ene styczeń stycznia sty січень січня січ январь января янв",
    2: "february feb février févr fév fevrier februar febbraio febrero luty lutego lut лютий лютого лют февраль февраля фев",
    3: "march mar mars märz mär maerz marzo marzec marca березень березня бер март марта мар",
    4: "april apr avril avr aprile abril abr kwiecień kwietnia kwi квітень квітня кві апрель апреля апр",
    5: "may mai maggio mag mayo maj maja травень травня тра май мая",
    6: "june jun juin juni giugno giu junio czerwiec czerwca cze червень червня чер июнь июня июн",
    7: "july jul juillet juil juli luglio lug julio lipiec lipca lip липень липня лип июль июля июл",
    8: "august aug août aout agosto ago sierpień sierpnia sie серпень серпня сер август августа авг",
    9: "september sep sept septembre settembre set septiembre wrzesień września wrz вересень вересня вер сентябрь сентября сен сент",
    10: "october oct octobre oktober okt ottobre ott octubre październik października paź жовтень жовтня жов октябрь октября окт",
    11: "november nov novembre novembre noviembre listopad listopada lis листопад листопада лис ноябрь ноября ноя нояб",
    12: "december dec décembre déc decembre dezember dez dicembre dic diciembre grudzień grudnia gru грудень грудня гру декабрь декабря дек",
}
# Offsets of zone abbreviations in minutes.
ABBREVIATIONS = {"GMT": 0, "UTC": 0, "UT": 0, "Z": 0, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180, "BST": 60, "EST": -300, "EDT": -240}

_LEAD = r"[\s ]*(?:\p{L}[\p{L} ]{0,24}:[\s ]*|(?:publié|pubblicato|publicado|opublikowano|published|veröffentlicht|опубліковано|опубликовано|actualizado|mis à jour|updated)\s+(?:le|il|el|on|am)?\s*)?(?:\p{L}{2,12}\.?,[\s ]*)?"
_TIME = r"(?<h{i}>\d{{1,2}})[:.hH](?<n{i}>\d{{2}})(?:[:.](?<s{i}>\d{{2}})(?:[.,]\d{{1,9}})?)?"
_ZONE = r"(?:[\s ]*(?<z{i}>Z|[A-Za-z]{{2,4}}(?![A-Za-z])|(?:GMT|UTC)?[+\-−]\d{{2}}(?::?\d{{2}})?)(?:\[[\w/+\-]+\])?)?"
_GAP = r"(?:,?[\s ]+(?:um|at|à|alle|a las|o|об|в|о|kl\.?)?[\s ]*|[\s ]*[,·|–—-][\s ]*)"


def _alternatives() -> list[str]:
    """The written forms; the index i keeps group names apart, as a name may stand only once in a pattern."""
    t = lambda i: _TIME.format(i=i) + _ZONE.format(i=i)
    day_name = r"(?:\p{L}{2,12}\.?,?[\s ]+)?"
    return [
        # 2026-02-10T01:00:00.123+01:00[Europe/Paris], 2026/02/10 01:00, 2026-02-10
        r"(?<y0>\d{4})[-/.](?<m0>\d{1,2})[-/.](?<d0>\d{1,2})(?:[Tt]|[\s ]+|$)(?:" + t(0) + ")?",
        # 20260210T010000Z, 20260210
        r"(?<y1>\d{4})(?<m1>\d{2})(?<d1>\d{2})(?:[Tt ]?(?<h1>\d{2})(?<n1>\d{2})(?<s1>\d{2})?(?:[.,]\d{1,9})?" + _ZONE.format(i=1) + ")?",
        # 10/02/2026 01:00, 10.02.2026, 01:00, 02/10/2026 7:00 PM
        r"(?<a2>\d{1,2})(?<q2>[/.\-])(?<b2>\d{1,2})\k<q2>(?<y2>\d{4})(?:" + _GAP + _TIME.format(i=2) + r"(?:[\s ]*(?<p2>[AaPp])\.?[Mm]\.?)?(?:[\s ]*Uhr)?" + _ZONE.format(i=2) + ")?",
        # 10 February 2026, 01:00; Tue, 10 Feb 2026 00:00:00 GMT; 10. Februar 2026, 01:00 Uhr
        day_name + r"(?<d3>\d{1,2})(?:\.|er|º|-го)?[\s -]+(?:de[\s ]+)?(?<w3>\p{L}{3,12})\.?[\s -]+(?:de[\s ]+)?(?<y3>\d{4})(?:[\s ]*(?:r\.|р\.|г\.|року|года|roku))?(?:" + _GAP + _TIME.format(i=3) + r"(?:[\s ]*(?<p3>[AaPp])\.?[Mm]\.?)?(?:[\s ]*Uhr)?" + _ZONE.format(i=3) + ")?",
        # Feb 10, 2026, 7:00 PM
        day_name + r"(?<w4>\p{L}{3,12})\.?[\s ]+(?<d4>\d{1,2})(?:st|nd|rd|th)?,?[\s ]+(?<y4>\d{4})(?:" + _GAP + _TIME.format(i=4) + r"(?:[\s ]*(?<p4>[AaPp])\.?[Mm]\.?)?" + _ZONE.format(i=4) + ")?",
        # 1770893034, 1770681600473
        r"(?<e5>\d{9,10})(?:\.\d+)?|(?<k5>\d{12,13})|(?<u5>\d{15,16})",
    ]


PATTERN = r"(?iu)^" + _LEAD + "(?:" + "|".join(f"(?:{a})" for a in _alternatives()) + r")[\s ]*$"
# Component order of the replacement; each field is filled by whichever alternative matched.
_FIELDS = {
    "year": "y0 y1 y2 y3 y4", "month": "m0 m1", "day": "d0 d1 d3 d4", "hour": "h0 h1 h2 h3 h4", "minute": "n0 n1 n2 n3 n4",
    "second": "s0 s1 s2 s3 s4", "zone": "z0 z1 z2 z3 z4", "word": "w3 w4", "first": "a2", "sep": "q2", "next": "b2", "half": "p2 p3 p4",
    "epoch": "e5", "millis": "k5", "micros": "u5",
}
_MARK = "\x1f"
_REPLACEMENT = _MARK + _MARK.join("".join("${" + g + "}" for g in names.split()) for names in _FIELDS.values())


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date, in integers only."""
    yy = F.when(m <= 2, y - 1).otherwise(y)
    era = F.floor(yy / 400)
    yoe = yy - era * 400
    doy = F.floor((F.lit(153) * (m + F.when(m > 2, -3).otherwise(9)) + 2) / 5) + d - 1
    doe = yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + doy
    return (era * 146097 + doe - 719468).cast("long")


def _literal_map(pairs: dict[str, int]) -> Column:
    return F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), F.lit(v))])


def with_epoch(df: DataFrame, text: str, zone: str, order: str, out: str) -> DataFrame:
    """Adds `out` (bigint): whole seconds since 1970-01-01 UTC of the column `text`, null where it gives no valid date.

    `zone` names a column with the IANA zone for times without one (null or unknown: UTC),
    `order` one with DMY or MDY for all-number dates with slashes. A local time that occurs
    twice or not at all is read with the offset in force before the change. Nulls, blanks,
    and texts that match no form or hold impossible parts give null.
    """
    index = {name: k + 1 for k, name in enumerate(_FIELDS)}
    names = {w: k for k, ws in MONTHS.items() for w in ws.split()}
    own = lambda n: f"__{out}_{n}"
    col = lambda n: F.col(own(n))
    parts = F.split(F.regexp_replace(F.col(text), F.lit(PATTERN), F.lit(_REPLACEMENT)), _MARK)
    df = df.withColumn(own("parts"), parts)
    df = df.withColumn(own("has"), F.coalesce(F.size(col("parts")) == len(_FIELDS) + 1, F.lit(False)))
    get = lambda n: F.when(col("has"), F.get(col("parts"), F.lit(index[n])))
    num = lambda n: get(n).try_cast("int")
    zone_text = F.upper(F.translate(get("zone"), "−:", "-"))
    # each step is a projection of its own, so that no expression is expanded into the ones that use it
    df = df.withColumns(
        {own(n): num(n) for n in ("year", "month", "day", "hour", "minute", "second", "first", "next")}
        | {own("word"): F.element_at(_literal_map(names), F.lower(get("word"))), own("half"): F.lower(get("half")), own("z"): F.coalesce(zone_text, F.lit(""))}
        | {own("mdy"): (get("sep") == "/") & ((F.coalesce(F.col(order), F.lit("DMY")) == "MDY"))}
        | {own("epoch"): F.coalesce(get("epoch").try_cast("long"), F.floor(get("millis").try_cast("long") / 1000), F.floor(get("micros").try_cast("long") / 1000000))}
    )
    swap = F.coalesce(col("mdy"), F.lit(False))
    hour = F.coalesce(col("hour"), F.lit(0))
    df = df.withColumns({
        own("m"): F.coalesce(col("month"), col("word"), F.when(swap, col("first")).otherwise(col("next"))),
        own("d"): F.coalesce(col("day"), F.when(swap, col("next")).otherwise(col("first"))),
        own("h"): F.when(col("half") == "", hour).when(hour.between(1, 12), hour % 12 + F.when(col("half") == "p", 12).otherwise(0)),
        own("n"): F.coalesce(col("minute"), F.lit(0)),
        own("s"): F.coalesce(col("second"), F.lit(0)),
        own("zs"): F.regexp_extract(col("z"), r"([+-])\d{2,4}$", 1),
        own("zd"): F.regexp_extract(col("z"), r"[+-](\d{2,4})$", 1),
    })
    y, m, d, h = col("year"), col("m"), col("d"), col("h")
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    longest = F.when(m.isin(4, 6, 9, 11), 30).when(m == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    minutes = F.substring(col("zd"), 1, 2).try_cast("int") * 60 + F.coalesce(F.substring(col("zd"), 3, 2).try_cast("int"), F.lit(0))
    df = df.withColumns({
        own("valid"): (y >= 1000) & m.between(1, 12) & (d >= 1) & (d <= longest) & h.between(0, 23) & (col("n") <= 59) & (col("s") <= 60),
        own("days"): days_from_civil(y, m, d),
        own("offset"): F.coalesce(F.when(col("zd") != "", F.when(col("zs") == "-", -minutes).otherwise(minutes)), F.element_at(_literal_map(ABBREVIATIONS), col("z"))),
    })
    df = df.withColumn(own("local"), F.when(col("valid"), col("days") * 86400 + h * 3600 + col("n") * 60 + F.least(col("s"), F.lit(59))))
    zoned = F.to_utc_timestamp(F.timestamp_seconds(col("local")), F.coalesce(F.col(zone), F.lit("UTC"))).cast("long")
    civil = F.when(col("z") == "", zoned).otherwise(col("local") - col("offset") * 60)
    kept = [c for c in df.columns if not c.startswith(f"__{out}_")]
    return df.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(col("epoch"), civil).cast("long").alias(out))


def found_instants(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """article_id, field, epoch_s for published_at and updated_at; repeated articles count once.

    The sources table is a dimension of a few rows per publisher; Spark broadcasts it when its
    measured size allows, else it is a normal equi join.
    """
    src = sources.select(F.col("source_id").alias("__sid"), F.col("time_zone").alias("__tz"), F.col("date_order").alias("__order")).dropDuplicates(["__sid"])
    rows = articles.select(
        "article_id",
        "source_id",
        F.explode(F.create_map(F.lit("published_at"), F.col("published_at"), F.lit("updated_at"), F.col("updated_at"))).alias("field", "__text")
    )
    rows = rows.where(F.col("__text").isNotNull() & (F.trim("__text") != ""))
    rows = rows.join(src, F.col("source_id") == F.col("__sid"), "left")
    rows = with_epoch(rows, "__text", "__tz", "__order", "epoch_s")
    # repeated articles are copies, so any of their values will do; filtering after the aggregate keeps the long expression from being evaluated twice
    once = rows.groupBy("article_id", "field").agg(F.max("epoch_s").alias("epoch_s"))
    return once.where(F.col("epoch_s").isNotNull() & F.col("article_id").isNotNull())
