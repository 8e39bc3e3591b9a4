"""Queries of the corpus operators, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, table
from . import boilerplate, components, incremental, langid, mixing, packing, repeats, residue, sentences, tokens


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    articles = table(spark, d, "articles")
    return langid.missing_languages(articles, langid.fit_model(articles))


def p1_paragraph_languages(spark: SparkSession, d: str) -> DataFrame:
    articles = table(spark, d, "articles")
    return langid.segment_languages(articles, langid.fit_model(articles))


def p1_document_languages(spark: SparkSession, d: str) -> DataFrame:
    articles = table(spark, d, "articles")
    return langid.paragraph_languages(articles, langid.fit_model(articles)).withColumn("shares", F.to_json("shares"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    articles = table(spark, d, "articles")
    return boilerplate.furniture_lines(articles, boilerplate.fit_model(articles))


def p2_reports(spark: SparkSession, d: str) -> DataFrame:
    articles = table(spark, d, "articles")
    return boilerplate.main_bodies(articles, boilerplate.fit_model(articles))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return repeats.repeated_lines(table(spark, d, "articles"))


def p3_repeated(spark: SparkSession, d: str) -> DataFrame:
    """The same over all bodies, residue too."""
    return repeats.repeated_lines(table(spark, d, "articles"), skip_residue=False)


def p3_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return repeats.without_repeated_lines(table(spark, d, "articles").select("article_id", "source_id", "body"))


def p3_cleaned_by_share(spark: SparkSession, d: str) -> DataFrame:
    """A line goes only if it stands in a hundredth of its source's documents too."""
    return repeats.without_repeated_lines(table(spark, d, "articles").select("article_id", "source_id", "body"), share=0.01)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return components.topic_groups(table(spark, d, "pairs"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue_articles(table(spark, d, "articles"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return incremental.duplicates(table(spark, d, "incoming_articles"), table(spark, d, "articles"), table(spark, d, "article_url_aliases"))


def _capacities(spark: SparkSession, d: str) -> list[int]:
    return [r["capacity_tokens"] for r in table(spark, d, "pack_capacities").collect()]  # a fixed table of a few rows


def _sized(spark: SparkSession, d: str) -> DataFrame:
    return cut_lineage(tokens.with_tokens(table(spark, d, "documents"), "text", ["doc_id"]))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """All permitted capacities jointly."""
    return packing.pack(_sized(spark, d), _capacities(spark, d))


def p8_containers_each(spark: SparkSession, d: str) -> DataFrame:
    """A packing for each capacity alone."""
    return packing.pack_each(_sized(spark, d), _capacities(spark, d))


def _mixture(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents").withColumn("text_hash", F.sha2("text", 256))
    sized = tokens.with_tokens(documents, "text", ["doc_id", "source", "text_hash"])
    targets = {r["source"]: (r["target_share"], r["max_repeats"]) for r in table(spark, d, "mix_targets").collect()}  # a fixed table of a few rows
    return mixing.mixture(sized, targets)


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d)


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.reached_shares(_mixture(spark, d), table(spark, d, "mix_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_rows(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: f for name, f in sorted(globals().items()) if name[0] == "p" and name[1:2].isdigit()
}

_CLEAN = "nullif(regexp_replace({}, '^[\\s\\x{{00A0}}]+|[\\s\\x{{00A0}}]+$', '', 'g'), '')"
_SPACES = "[\\s\\x{0085}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x1c-\\x1f]+"
ORACLES: dict[str, str] = {
    "p3_repeated": f"""
        with a as (select distinct on (article_id) article_id, coalesce(source_id, '') as source, body from articles where article_id is not null and body <> ''),
        l as (select article_id, source, unnest(string_split(body, chr(10))) as line, generate_subscripts(string_split(body, chr(10)), 1) as no from a),
        k as (select article_id, source, no,
            regexp_replace(replace(lower(regexp_replace(trim(regexp_replace(line, '{_SPACES}', ' ', 'g')), '[0-9]+', '0', 'g')), 'ß', 'ss'), '[ .,:;!?…]+$', '') as key from l),
        f as (select source, key from k where key <> '' group by 1, 2 having count(distinct article_id) >= 5)
        select article_id, cast(no as int) as line_no from k join f using (source, key)""",
    "p4_found": f"""
        with recursive raw as (
            select {_CLEAN.format('topic_id_a')} a, {_CLEAN.format('topic_id_b')} b, "current" c, coalesce(case when isnan(threshold) then 0.78 else threshold end, 0.78) t from pairs),
        e as (select distinct least(a, b) u, greatest(a, b) v from raw where a is not null and b is not null and a <> b and c is not null and not isnan(c) and c >= t),
        both_ways as (select u, v from e union select v, u from e),
        reach(n, m) as (select u, u from both_ways union select b.v, r.m from reach r join both_ways b on b.u = r.n where r.m < b.v)
        select n as topic_id, min(m) as group_id from reach group by n""",
}
