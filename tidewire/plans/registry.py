"""Registration of queries with the SQL that states the same result, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of a table reader `t(name)` under its own name."""

    def add(function):
        QUERIES[function.__name__] = lambda spark, d: function(lambda name: table(spark, d, name))
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add


# SQL fragments: one row per article or document id, as repeated rows are exact copies.
ARTICLES = "(select distinct on (article_id) * from articles)"
INCOMING = "(select distinct on (incoming_id) * from incoming_articles)"


def articles(t) -> DataFrame:
    return t("articles").dropDuplicates(["article_id"])


# SQL of T.title_key for the characters that stand in texts: spaces, ellipses, ß and the signs of full width.
def sql_folded(x: str) -> str:
    for a, b in (("ß", "ss"), ("…", "..."), ("！", "!"), ("（", "("), ("）", ")"), ("，", ","), ("：", ":"), ("；", ";"), ("？", "?")):
        x = f"replace({x}, '{a}', '{b}')"
    return f"trim(regexp_replace(lower({x}), '[\\s\\x{{00A0}}]+', ' ', 'g'))"


def sql_values(rows: list[tuple]) -> str:
    """Rows of plain values as (values ...)."""

    def literal(v) -> str:
        return "null" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'"

    return "(values " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + ")"
