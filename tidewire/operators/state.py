"""State tables without MERGE: every change is a rewrite by set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in the given order (make it total)."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def upsert(target: DataFrame, changes: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Changed rows replace those of the same key, the last of several changes wins; the rest stays. Null keys never match."""
    new = latest(changes, keys, order)
    return target.join(new.select(*keys), keys, "left_anti").unionByName(new.select(*target.columns))


def insert_ignore(target: DataFrame, rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Only rows of unknown keys are added."""
    return target.unionByName(latest(rows, keys, order).join(target.select(*keys), keys, "left_anti").select(*target.columns))


def update_from(target: DataFrame, values: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Columns of matching rows take the other table's values; others stay. `values` has each key once."""
    renamed = values.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__hit"))
    joined = target.join(renamed, keys, "left")
    return joined.select(*[F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in target.columns])


def delete_where(target: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is true go; null counts as not true."""
    return target.where(~F.coalesce(condition, F.lit(False)))


def _days(rows: DataFrame, keys: list[str], time: str, aggregates: dict[str, Column]) -> DataFrame:
    """One row per key and day; what windows over a key's days hold is bounded by the calendar, however many rows a key has."""
    return rows.groupBy(*keys, F.to_date(time).alias("__day")).agg(*[c.alias(n) for n, c in aggregates.items()])


def versions(rows: DataFrame, keys: list[str], time: str, order: str, payload: str) -> DataFrame:
    """Numbers the versions of each key in order of (time, order) and marks those whose payload differs from the one before.

    A key is split by day: a window holds one day of a key, and each day starts with the number and the payload that the days before end with.
    """
    at = F.struct(time, order)
    days = _days(rows, keys, time, {"__n": F.count("*"), "__last": F.max_by(F.struct(payload), at)})
    w = Window.partitionBy(*keys).orderBy("__day")
    carried = days.select(
        *keys,
        "__day",
        F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
        F.lag("__last").over(w).alias("__carried")
    )
    inside = Window.partitionBy(*keys, "__day").orderBy(time, order)
    joined = rows.withColumn("__day", F.to_date(time)).join(carried, [*keys, "__day"])
    number = F.row_number().over(inside)
    previous = F.coalesce(F.lag(F.struct(payload)).over(inside), F.col("__carried"))
    numbered = joined.withColumn("version", F.col("__before") + number).withColumn("__previous", previous)
    return numbered.withColumn(
        "changed",
        F.col("__previous").isNull() | ~F.col(payload).eqNullSafe(F.col(f"__previous.{payload}"))
    ).drop("__day", "__before", "__carried", "__previous")


def sessions(rows: DataFrame, key: str, time: str, order: str, gap: str) -> DataFrame:
    """(key, session_no, events, first_ts, last_ts): a session ends where the next event is more than the gap away. Split by day as `versions`."""
    days = _days(rows, [key], time, {"__end": F.max(time)})
    w = Window.partitionBy(key).orderBy("__day")
    carried = days.select(key, "__day", F.lag("__end").over(w).alias("__carried"))
    inside = Window.partitionBy(key, "__day").orderBy(time, order)
    joined = rows.select(key, time, order, F.to_date(time).alias("__day")).join(carried, [key, "__day"])
    fresh = F.when(F.col(time) - F.coalesce(F.lag(time).over(inside), F.col("__carried")) <= F.expr(f"interval {gap}"), 0).otherwise(1)
    marked = joined.withColumn("__fresh", fresh)
    marked = marked.withColumn("__inside", F.sum("__fresh").over(inside))
    by = marked.groupBy(key, "__day", "__inside").agg(F.count("*").alias("events"), F.min(time).alias("first_ts"), F.max(time).alias("last_ts"))
    # a day's first rows may go on with the last session of the days before: its number there is 0
    starts = by.groupBy(key, "__day").agg(F.max("__inside").alias("__n")).select(
        key,
        "__day",
        F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before")
    )
    numbered = by.join(starts, [key, "__day"]).withColumn("session_no", F.col("__before") + F.col("__inside"))
    return numbered.groupBy(key, "session_no").agg(F.sum("events").alias("events"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))


def keep_first_values(rows: DataFrame, keys: list[str], rank: str, columns: list[str]) -> DataFrame:
    """For each key and column the first value in order of rank that isn't blank."""
    return rows.groupBy(*keys).agg(*[F.min_by(c, F.when(F.trim(F.col(c).cast("string")) != "", F.col(rank))).alias(c) for c in columns])


def save_items(items: DataFrame, articles: DataFrame, aliases: DataFrame, rejected: DataFrame, least_words: int = 100) -> DataFrame:
    """(item_id, outcome, target_id, alias_reason) of fetched items (item_id, source_id, candidate_url, canonical_url, title_key, opening, words, kind).

    Outcomes: `rejected` when the kind is no article or the words are too few; `existing` when the address is known, directly or by an alias;
    `duplicate` when source, title key and opening are those of an accepted article (complete or an excerpt), the oldest; else `inserted`.
    The items come in order of item_id: the first with a new address or a new key is inserted, the later ones find it. A rejected
    address stays rejected only until it comes with enough words. Articles: (article_id, source_id, canonical_url, title_key, opening, content_status,
    first_seen_at); aliases: (source_id, candidate_url, duplicate_of_article_id); rejected: (source_id, canonical_url).
    """
    good = F.col("kind").isin("ARTICLE", "ARTICLE_EXCERPT") & (F.col("words") >= least_words)
    known = rejected.select("source_id", "canonical_url", F.lit(True).alias("was_rejected")).dropDuplicates(["source_id", "canonical_url"])
    seen = items.join(known, ["source_id", "canonical_url"], "left").withColumn("good", F.coalesce(good, F.lit(False)))
    direct = articles.groupBy("source_id", "canonical_url").agg(F.min("article_id").alias("direct"))
    by_alias = aliases.groupBy("source_id", F.col("candidate_url").alias("canonical_url")).agg(F.min("duplicate_of_article_id").alias("by_alias"))
    keyed = articles.where("title_key <> '' and opening is not null and content_status in ('COMPLETE', 'EXCERPT')")
    oldest = keyed.groupBy("source_id", "title_key", "opening").agg(F.min_by("article_id", F.struct("first_seen_at", "article_id")).alias("logical"))
    x = seen.join(direct, ["source_id", "canonical_url"], "left").join(by_alias, ["source_id", "canonical_url"], "left").join(oldest, ["source_id", "title_key", "opening"], "left")
    fresh = x.where("good and direct is null and by_alias is null")
    # among new items the first of an address, and of those the first of a key, is inserted
    first_url = fresh.groupBy("source_id", "canonical_url").agg(F.min("item_id").alias("first_url"))
    leaders = fresh.where("logical is null").join(first_url, ["source_id", "canonical_url"]).where("item_id = first_url and title_key <> '' and opening is not null")
    first_key = leaders.groupBy("source_id", "title_key", "opening").agg(F.min("item_id").alias("first_key"))
    y = x.join(first_url, ["source_id", "canonical_url"], "left").join(first_key, ["source_id", "title_key", "opening"], "left")
    # an address whose first item repeats a key belongs to that key's article
    article = F.coalesce("logical", F.concat(F.lit("new:"), F.coalesce("first_key", "item_id")))
    owner = y.where("item_id = first_url").select("source_id", "canonical_url", article.alias("owner")).dropDuplicates(["source_id", "canonical_url"])
    z = y.join(owner, ["source_id", "canonical_url"], "left")
    outcome = (
        F.when(~F.col("good"), "rejected")
        .when(F.col("direct").isNotNull() | F.col("by_alias").isNotNull(), "existing")
        .when(F.col("item_id") != F.col("first_url"), "existing")
        .when(F.col("logical").isNotNull(), "duplicate")
        .when(F.col("first_key") < F.col("item_id"), "duplicate")
        .otherwise("inserted")
    )
    target = F.when(F.col("outcome") == "rejected", None).otherwise(F.coalesce("direct", "by_alias", "owner"))
    reason = F.when(
        (F.col("outcome") == "existing") & (F.col("candidate_url") != F.col("canonical_url")),
        "REDIRECTS_TO_EXISTING_CANONICAL"
    ).when(F.col("outcome") == "duplicate", "SAME_TITLE_AND_FIRST_TWO_SENTENCES")
    return z.withColumn("outcome", outcome).select("item_id", "outcome", target.alias("target_id"), reason.alias("alias_reason"))


def replace_if_unchanged(
    current: DataFrame,
    history: DataFrame,
    expected: DataFrame,
    replacement: DataFrame,
    expected_history: DataFrame,
    new_history: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Compare and swap of versioned documents: (current, history, outcome by topic).

    current, expected and replacement: (topic_id, version, payload); the histories: (topic_id, version, run_id, article_ids, payload). A topic's outcome is
    `already_applied` when its state is the replacement's (so a retry changes nothing), `missing` when it isn't stored, `changed` when its
    state isn't the expected one, `invalid` when the replacement changes a version, a run or its articles or a number of versions, else `applied`:
    only then its payloads are replaced. Versions stay.
    """

    def state(rows: DataFrame, out: str) -> DataFrame:
        # the versions of one topic, which are few
        return rows.groupBy("topic_id").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("version", "run_id", "article_ids", "payload")))), 256).alias(out))

    def identity(rows: DataFrame, out: str) -> DataFrame:
        return rows.groupBy("topic_id").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("version", "run_id", "article_ids")))), 256).alias(out))

    mark = lambda rows, out: rows.select("topic_id", F.sha2(F.to_json(F.struct("version", "payload")), 256).alias(out), F.col("version").alias(f"{out}_version"))
    x = mark(replacement, "new").join(mark(expected, "old"), "topic_id", "left").join(mark(current, "now"), "topic_id", "left")
    for rows, out in ((history, "now_h"), (expected_history, "old_h"), (new_history, "new_h")):
        x = x.join(state(rows, out), "topic_id", "left")
    x = x.join(identity(expected_history, "old_i"), "topic_id", "left").join(identity(new_history, "new_i"), "topic_id", "left")
    outcome = (
        F.when(F.col("now").isNull(), "missing")
        .when(F.col("now").eqNullSafe(F.col("new")) & F.col("now_h").eqNullSafe(F.col("new_h")), "already_applied")
        .when(~F.col("now").eqNullSafe(F.col("old")) | ~F.col("now_h").eqNullSafe(F.col("old_h")), "changed")
        .when(~F.col("new_version").eqNullSafe(F.col("old_version")) | ~F.col("old_i").eqNullSafe(F.col("new_i")), "invalid")
        .otherwise("applied")
    )
    outcomes = x.select("topic_id", outcome.alias("outcome"))
    applied = outcomes.where("outcome = 'applied'").select("topic_id")
    swapped = update_from(current, replacement.join(applied, "topic_id", "left_semi"), ["topic_id"], ["payload"])
    swapped_history = update_from(history, new_history.join(applied, "topic_id", "left_semi"), ["topic_id", "version"], ["payload"])
    return swapped, swapped_history, outcomes


def reset(tables: dict[str, DataFrame], keys: DataFrame, key: str) -> tuple[dict[str, DataFrame], dict[str, DataFrame], dict[str, int]]:
    """Removes the rows of the given keys from every table: (what stays, the backup, removed rows by table).

    Nothing is removed unless what stays and the backup together are the table, which is counted; a restore is `restored`. Null keys stay.
    """
    keys = keys.select(key).dropDuplicates([key])
    backup = {name: rows.join(keys, key, "left_semi") for name, rows in tables.items()}
    kept = {name: rows.join(keys, key, "left_anti") for name, rows in tables.items()}
    removed = {}
    for name, rows in tables.items():
        removed[name] = backup[name].count()
        if removed[name] + kept[name].count() != rows.count():
            raise RuntimeError(f"{name}: the backup doesn't hold what would be removed; nothing is changed")
    return kept, backup, removed


def restored(kept: DataFrame, backup: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of a backup put back, unless newer ones of the same keys have come since."""
    return kept.unionByName(backup.join(kept.select(*keys), keys, "left_anti"))
