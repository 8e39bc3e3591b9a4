"""Titles, categories, profiles and generated texts of topics, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# The form of a title with its place, lists of places in one, single countries whose names look like such a list, titles that stand for none.
TITLE = r"^\[([^\]\r\n]{2,80})\]\s+(\S.*)$"
COMPOSITE = r"(?i),|/|&|\s+(?:i|oraz)\s+"
SINGLE_COUNTRIES = ("antigua i barbuda", "bośnia i hercegowina", "trynidad i tobago", "wyspy świętego tomasza i książęca")
PLACEHOLDERS = (
    "neutralna nazwa wydarzenia",
    "neutralny wspólny tytuł",
    "temat bez tytułu",
    "połączony temat",
    "konkretny tytuł",
    "konkretny tytuł wydarzenia",
    "wymaga doprecyzowania tematu"
)
PLACEHOLDER_OPENINGS = ("neutralna nazwa", "neutralny wspólny", "temat bez tytułu", "połączony temat")
# Category names and what else they are called.
CATEGORIES = {
    "POLSKA": "POLSKA", "POLAND": "POLSKA", "POLITYKA": "POLITYKA", "POLITICS": "POLITYKA", "SWIAT": "SWIAT", "ŚWIAT": "SWIAT", "WORLD": "SWIAT", "GOSPODARKA": "GOSPODARKA", "ECONOMY": "GOSPODARKA",
    "SPOLECZENSTWO": "SPOLECZENSTWO", "SPOŁECZEŃSTWO": "SPOLECZENSTWO", "SOCIETY": "SPOLECZENSTWO", "TECHNOLOGIA": "TECHNOLOGIA", "TECHNOLOGY": "TECHNOLOGIA", "ZDROWIE": "ZDROWIE", "HEALTH": "ZDROWIE",
    "KULTURA_SPORT": "KULTURA_SPORT", "KULTURA I SPORT": "KULTURA_SPORT", "CULTURE_AND_SPORT": "KULTURA_SPORT", "CULTURE_SPORT": "KULTURA_SPORT",
}
# Languages by region where none is given; headings that are no titles; signs of a human check.
REGION_LANGUAGES = {"poland": "pl", "germany": "de", "france": "fr", "italy": "it", "spain": "es", "china": "en/original", "russia": "ru/en", "ukraine": "uk/en"}
GENERIC_HEADLINES = ("redakcja poleca", "polecane", "czytaj także", "czytaj rownież", "czytaj również")
CAPTCHA = r"(?i)verify you are human|are you a robot|access denied|security check|security verification|human verification|checking your browser|human challenge"
# Names that need no explanation in brackets, and the explanations.
EXPLAINED = r"(?i)\b(USA|US|UE|EU|UK|RP|ONZ|NATO)\s*\((?:stany zjednoczone(?: ameryki)?|stanów zjednoczonych(?: ameryki)?|united states(?: of america)?|unia europejska|unii europejskiej|european union|wielka brytania|united kingdom|rzeczpospolita polska|organizacj[ai] narodów zjednoczonych|north atlantic treaty organization|sojusz północnoatlantycki)[. ]*\)"


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\s ]+", " "))


def core(c: Column) -> Column:
    """A title without its place."""
    text = squeezed(c)
    return F.when(text.rlike(TITLE), F.trim(F.regexp_extract(text, TITLE, 2))).otherwise(text)


def is_placeholder(c: Column) -> Column:
    key = F.regexp_replace(F.lower(core(c)), r"[.!?]+$", "")
    openings = F.lit(False)
    for x in PLACEHOLDER_OPENINGS:
        openings = openings | key.startswith(x)
    return (squeezed(c) == "") | key.isin(*PLACEHOLDERS) | openings


def is_usable(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))).rlike(TITLE) & ~is_placeholder(c)


def has_composite_place(c: Column) -> Column:
    place = F.lower(squeezed(F.regexp_extract(F.trim(F.coalesce(c, F.lit(""))), TITLE, 1)))
    return (place != "") & ~place.isin(*SINGLE_COUNTRIES) & place.rlike(COMPOSITE)


def with_place(candidate: Column, current: Column) -> Column:
    """A candidate title in the form with a place: its own, else the current title's, else the world; nothing for placeholders and broken forms."""
    text = F.substring(squeezed(candidate), 1, 300)
    place = F.regexp_extract(F.trim(F.coalesce(current, F.lit(""))), TITLE, 1)
    made = F.substring(F.concat(F.lit("["), F.when(place != "", place).otherwise("Świat"), F.lit("] "), text), 1, 300)
    return F.when((text == "") | is_placeholder(text), "").when(text.rlike(TITLE), text).when(text.startswith("["), "").otherwise(made)


def fallback_title(current: Column, *others: Column) -> Column:
    """The first candidate that makes a usable title, the current one first; null if none does."""
    made = [with_place(c, current) for c in (current, *others)]
    return F.coalesce(*[F.when(is_usable(m), m) for m in made])


def categories(values: Column) -> Column:
    """At most three known categories, each once, in order."""
    known = F.create_map(*[F.lit(x) for pair in CATEGORIES.items() for x in pair])
    found = F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.element_at(known, F.upper(squeezed(x))))
    return F.slice(F.array_distinct(F.filter(found, lambda x: x.isNotNull())), 1, 3)


def source_language(language: Column, region: Column) -> Column:
    by_region = F.create_map(*[F.lit(x) for pair in REGION_LANGUAGES.items() for x in pair])
    return F.when(F.coalesce(language, F.lit("")) != "", language).otherwise(F.coalesce(F.element_at(by_region, F.lower(F.coalesce(region, F.lit("")))), F.lit("en/original")))


def plain_generated(c: Column) -> Column:
    """Generated text with real line breaks (escaped ones and break tags too) and without closing braces left at its end."""
    text = F.coalesce(c, F.lit(""))
    for mark in ("\\r\\n", "\\n", "\\r", "\r\n", "\r"):
        text = F.replace(text, F.lit(mark), F.lit("\n"))
    text = F.regexp_replace(text, r"(?i)<\s*/?\s*br\s*/?\s*>", "\n")
    return F.regexp_replace(F.regexp_replace(text, r"\s*\}+\s*$", ""), r"^\s+|\s+$", "")


def without_explanations(c: Column) -> Column:
    return F.regexp_replace(c, EXPLAINED, "$1")


def without_publishers(c: Column, names: list[str]) -> Column:
    """Without openings of lines that only name the publisher."""
    listed = "|".join(sorted((n.replace(".", r"\.") for n in names if n.strip()), key=len, reverse=True))
    return F.regexp_replace(c, rf"(?im)^[ \t]*Według[ \t]+(?:(?:agencji|portalu|dziennika|redakcji)[ \t]+)?(?:{listed})[ \t]*[:,][ \t]*", "") if listed else c


def is_generic_headline(c: Column) -> Column:
    return F.regexp_replace(F.lower(squeezed(c)), r"^[ :–—\-\t]+|[ :–—\-\t]+$", "").isin(*GENERIC_HEADLINES)


def escaped_like(c: Column) -> Column:
    for mark in ("\\", "%", "_", "*"):
        c = F.replace(c, F.lit(mark), F.lit("\\" + mark))
    return c


def technical_status(items: Column, bodies: Column, paywall: Column, captcha: Column) -> Column:
    return F.when(bodies >= 5, "FULL").when(
        (items > 0) & (bodies > 0),
        "PARTIAL"
    ).when(captcha, "CAPTCHA").when(paywall & (bodies == 0), "PAYWALL").when(items > 0, "METADATA_ONLY").otherwise("FAILED")


def merge_text(title: Column, description: Column, titles: Column) -> Column:
    """What two topics are compared by: the title, and the description or else the first title of an article."""
    first = F.element_at(F.filter(F.transform(F.coalesce(titles, F.array().cast("array<string>")), F.trim), lambda x: x != ""), F.lit(1))
    said = F.trim(F.coalesce(description, F.lit("")))
    said = F.when(said != "", said).otherwise(
        F.coalesce(F.when(F.size(F.filter(F.coalesce(titles, F.array().cast("array<string>")), lambda x: F.trim(x) != "")) > 0, first), F.lit(""))
    )
    return F.concat(F.lit("Tytuł wątku: "), F.substring(F.trim(F.coalesce(title, F.lit(""))), 1, 300), F.lit("\nOpis: "), F.substring(said, 1, 650))


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("annotations", "Column", "F", "T")]
