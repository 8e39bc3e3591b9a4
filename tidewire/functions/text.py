"""Text functions as column expressions; all but Unicode normalisation stay in generated JVM code."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _folded_letters() -> tuple[str, str]:
    """Latin letters whose decomposition is one ASCII letter with marks, and that letter. A letter without decomposition, as the Polish l with stroke, has none."""
    pairs = []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        bare = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)).casefold()
        if len(bare) == 1 and bare.isascii() and bare.isalpha():
            pairs.append((chr(code), bare))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _folded_letters()
# Words without distinction as folded letters (so the l with stroke is missing), function words first, then words of the newsroom,
# common English ones, and places and institutions. Words of under four letters never count and aren't listed.
NON_DISTINCTIVE = tuple(
    """albo gdzie jego jest jako jeden jedna jedno inne inny innych ktora ktore ktory miedzy nowe nowy nowa oraz przed przez swoje swoim takze temat tylko
    tytu tytul wedlug wedug wobec
    aktualizacja aktualizacje artykul artyku decyzja decyzje dzis dzisiaj dzisiejszy dzisiejsza dzisiejsze doniesienia informacja informacje komentarz kontekst
    kraj kraju minister najnowze najnowsze nowosci polityka prezydent prezydenci wspolna wspolne wspolny powiedzial powiedzia reakcja reakcje relacja relacje
    raport sprawa sprawie sytuacja slowa sowa wazne wiadomosci wydarzenie wydarzenia wystapienie zapowiedzial zapowiedzia zobacz zobaczcie
    about after also been before from have into latest more news over said says that their these this today what when where which while with will would
    government president
    afryka ameryka azja brytania chiny chin china europa europejski europejska iran izrael izraelski niemcy niemiecki nato polska polski polskie rosja
    rosyjski ukraina ukrainski unii unia unijne swiat swiata wielka wegry wegierski""".split()
)
# Inflection endings, tried in this order; a stem keeps at least five letters.
SUFFIXES = (
    "owego",
    "owej",
    "owych",
    "owym",
    "owie",
    "ami",
    "ach",
    "ania",
    "enie",
    "enia",
    "eniu",
    "owy",
    "owa",
    "owe",
    "owi",
    "em",
    "om",
    "ie",
    "ia",
    "iu",
    "a",
    "e",
    "i",
    "y",
    "u",
    "o"
)
WORD = r"(\p{L}[\p{L}\p{N}_'-]{2,})"


def nonblank(c: Column) -> Column:
    """Null and blank are one: no value."""
    return F.when(F.trim(c) != "", c)


def clean_text(c: Column) -> Column:
    """The common entities decoded, white space collapsed."""
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(c, r"[\s\u00a0]+", " "))


def _fold_array(a: pa.Array) -> pa.Array:
    return pa.array([x if x is None else x.lower() if x.isascii() else unicodedata.normalize("NFKC", x).casefold() for x in a.to_pylist()], pa.string())


_compatible = F.arrow_udf(_fold_array, StringType())


def folded(c: Column) -> Column:
    """Unicode compatibility form without letter case (NFKC, casefold), which no built-in function gives."""
    return _compatible(c)


def title_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(folded(c), r"[\s\u00a0]+", " "))


def lower_key(c: Column) -> Column:
    """Spaces collapsed, lower case: the key of short generated texts, which hold no compatibility characters."""
    return F.trim(F.regexp_replace(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), r"[\s\u00a0]+", " "))


def headline_key(c: Column) -> Column:
    """Without a [prefix]; anything but letters and digits is a blank."""
    bare = F.regexp_replace(F.lower(c), r"^\s*\[[^\]]+\]\s*", "")
    return F.trim(F.regexp_replace(bare, r"[^\p{L}\p{N}]+", " "))


def word_count(c: Column) -> Column:
    text = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(F.size(F.split(text, " ")))


def first_words(c: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " "), 1, n), " ")


def opening(c: Column, sentences: int = 2, chars: int = 1600) -> Column:
    """The first sentences, cut after . ! ? or an ellipsis and white space."""
    text = clean_text(c)
    parts = F.split(F.regexp_replace(text, r"([.!?…]) ", "$1\n"), "\n")
    return F.substring(F.array_join(F.slice(parts, 1, sentences), " "), 1, chars)


def stable_id(*columns: Column, length: int = 24) -> Column:
    return F.substring(F.sha2(F.concat_ws("\x1f", *columns), 256), 1, length)


def opening_fingerprint(c: Column) -> Column:
    """32 hex digits for the first two sentences, letter case and spacing aside; blank texts have none."""
    key = title_key(opening(c))
    return F.when(key != "", F.substring(F.sha2(key, 256), 1, 32))


def token_base(c: Column) -> Column:
    """ASCII letters and digits of a word without marks; what has no ASCII base, as the l with stroke, is dropped, ß is ss."""
    return F.regexp_replace(F.translate(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), ACCENTED, PLAIN), "[^a-z0-9]+", "")


def distinctive(base: Column) -> Column:
    """Four letters or more, and neither the base nor its stem is a word without distinction."""
    return (F.length(base) >= 4) & ~base.isin(*NON_DISTINCTIVE) & ~stem(base).isin(*NON_DISTINCTIVE)


def stem(base: Column) -> Column:
    """The base without its first matching ending."""
    out = base
    for suffix in reversed(SUFFIXES):
        fits = base.endswith(suffix) & (F.length(base) - len(suffix) >= 5)
        out = F.when(fits, F.substring(base, F.lit(1), F.length(base) - len(suffix))).otherwise(out)
    return out


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(1))


def stems(c: Column) -> Column:
    """Stems of the distinctive words, in order."""
    return F.transform(bases(c), stem)


def bases(c: Column) -> Column:
    return F.filter(F.transform(words(F.coalesce(c, F.lit(""))), token_base), distinctive)


def phrases(stem_array: Column) -> Column:
    """Pairs of successive different stems."""
    pairs = F.zip_with(
        F.slice(stem_array, F.lit(1), F.greatest(F.size(stem_array) - 1, F.lit(0))),
        F.slice(stem_array, F.lit(2), F.greatest(F.size(stem_array) - 1, F.lit(0))),
        lambda a, b: F.when(a != b, F.concat(a, F.lit(" "), b))
    )
    return F.array_distinct(F.filter(pairs, lambda x: x.isNotNull()))


def numbers(c: Column) -> Column:
    """Quantities, times and dates as written: 1,5 and 12:30 are one each."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(\d+(?:[.,:]\d+)*)"), F.lit(1)))


# Stop words of claims, folded.
CLAIM_STOP = "przez ktory ktora ktore tego jest oraz jako bylo jego przed takze wedlug zostal zostala powiedzial".split()


def claim_tokens(c: Column) -> Column:
    """Six-letter stems of words of four or more letters without stop words; here the Polish l with stroke counts as l."""
    text = F.translate(F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("ß"), F.lit("ss")), ACCENTED + "ł", PLAIN + "l")
    kept = F.filter(F.regexp_extract_all(text, F.lit(r"(\p{L}{4,})"), F.lit(1)), lambda w: ~w.isin(*CLAIM_STOP))
    return F.array_distinct(F.transform(kept, lambda w: F.substring(w, 1, 6)))


def text_key(c: Column) -> Column:
    return F.regexp_replace(lower_key(c), r"[. ]+$", "")


def is_cyrillic(c: Column) -> Column:
    return c.rlike(r"\p{IsCyrillic}")
