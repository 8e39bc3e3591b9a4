"""Reading and writing the state of the store: pulls, restored rows, exports of documents, pushes in order of reference, additive columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import state


class MissingRows(RuntimeError):
    """Rows that are referred to and can't be found; `ids` are the first of them, in order."""

    def __init__(self, what: str, ids: list[str], count: int):
        super().__init__(f"{what}: {count} missing, {', '.join(map(str, ids))}")
        self.ids, self.count = ids, count


def require_present(wanted: DataFrame, rows: DataFrame, key: str, what: str, shown: int = 20) -> None:
    """Raises MissingRows if a wanted key (null ones aside) has no row; only a few ids come to the driver."""
    missing = wanted.where(F.col(key).isNotNull()).select(key).join(rows.select(key), key, "left_anti").dropDuplicates([key])
    first = [r[0] for r in missing.orderBy(key).limit(shown).collect()]
    if first:
        raise MissingRows(what, first, missing.count())


def pull_state(local: dict[str, DataFrame], remote: dict[str, DataFrame], keys: dict[str, list[str]]) -> dict[str, DataFrame]:
    """Local tables with the remote rows taken over by key: a remote row replaces the local one, tables without a remote stay, unknown ones are added."""
    out = dict(local)
    for name, rows in remote.items():
        have = local.get(name)
        if have is None:
            out[name] = rows.dropDuplicates(keys[name])
            continue
        taken = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast(dict(have.dtypes)[c]).alias(c) for c in have.columns])
        out[name] = state.upsert(have, taken, keys[name], [F.col(c) for c in keys[name]])
    return out


def hydrate(local: DataFrame, wanted: DataFrame, archive: DataFrame, key: str) -> DataFrame:
    """The local rows and, from the archive, exactly the wanted ones they lack; all or nothing: a wanted key that is in neither raises MissingRows."""
    lacking = wanted.where(F.col(key).isNotNull()).select(key).dropDuplicates([key]).join(local.select(key), key, "left_anti")
    require_present(lacking, archive, key, "rows to restore")
    restored = archive.join(lacking, key, "left_semi").dropDuplicates([key])
    return local.unionByName(restored.select(*local.columns))


def push_run(run_id: str, local: dict[str, DataFrame], remote: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], list[str]]:
    """The remote tables after a run is pushed, and the order in which they have to be written (what is referred to first).

    local: runs (run_id, started_at), articles (article_id, first_seen_at), run_articles (run_id, article_id, fetched_now), results (run_id, source_id).
    Only the run's own rows go; of the articles those fetched now or first seen since its start. Links to articles that aren't there raise MissingRows.
    """
    run = local["runs"].where(F.col("run_id") == run_id)
    links = local["run_articles"].where(F.col("run_id") == run_id)
    require_present(links, local["articles"], "article_id", "articles of the run")
    started = run.select(F.col("started_at").alias("__started"))  # one row
    own = local["articles"].join(links.select("article_id", F.col("fetched_now").alias("__now")).dropDuplicates(["article_id"]), "article_id").crossJoin(F.broadcast(started))
    fresh = own.where((F.col("__now") == 1) | (F.col("first_seen_at") >= F.col("__started"))).drop("__now", "__started")
    parts = {
        "runs": (run, ["run_id"]),
        "articles": (fresh, ["article_id"]),
        "run_articles": (links, ["run_id", "article_id"]),
        "results": (local["results"].where(F.col("run_id") == run_id), ["run_id", "source_id"])
    }
    out = dict(remote)
    for name, (rows, keys) in parts.items():
        out[name] = state.upsert(remote[name], rows.select(*remote[name].columns), keys, [F.col(c) for c in keys])
    return out, list(parts)


def load_export(spark: SparkSession, path: str, payload_schema: str) -> DataFrame:
    """Payloads of an export: CSV (a first byte-order mark and quoted line ends allowed) or a JSON list; a payload may be an object or a text that holds one.

    An export without rows is an error, as an empty one never replaces what is there.
    """
    if path.lower().endswith(".csv"):
        rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8").csv(path)
        rows = rows.toDF(*[c.lstrip("﻿") for c in rows.columns]).select(F.col("payload").alias("text"))
    else:
        rows = spark.read.option("multiLine", True).option("primitivesAsString", True).schema("payload string").json(path).select(F.col("payload").alias("text"))
    parsed = rows.where("text is not null").select(F.from_json("text", payload_schema).alias("payload")).select("payload.*")
    if parsed.isEmpty():
        raise ValueError("the export has no rows")
    return parsed


def backfilled(articles: DataFrame, title: str = "title", body: str = "body") -> DataFrame:
    """Additive columns of older tables: title key and opening fingerprint are added where they are missing or empty; given ones stay."""
    derived: dict[str, Column] = {"title_key": T.title_key(F.coalesce(F.col(title), F.lit(""))), "opening_fingerprint": F.coalesce(T.opening_fingerprint(F.col(body)), F.lit(""))}
    for name, value in derived.items():
        articles = articles.withColumn(name, F.coalesce(T.nonblank(F.col(name)), value) if name in articles.columns else value)
    return articles


class ReadOnly:
    """Tables of a store that can be read and not written."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._folder}/{name}")

    def __getattr__(self, name: str):
        raise PermissionError(f"{name}: this store is read only")
