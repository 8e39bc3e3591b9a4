"""Sinks: the public snapshot of topic pages with completeness checks, and report files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check_complete(topics: DataFrame, links: DataFrame, articles: DataFrame) -> DataFrame:
    """Problems (kind, id): repeated or null topic ids, and links whose topic or article is missing. Empty: the snapshot is whole."""
    repeated = topics.groupBy("topic_id").agg(F.count("*").alias("n")).where("n > 1 or topic_id is null").select(F.lit("topic").alias("kind"), F.col("topic_id").alias("id"))
    no_topic = links.join(topics.select("topic_id"), "topic_id", "left_anti").select(F.lit("link without topic").alias("kind"), F.col("topic_id").alias("id"))
    no_article = links.join(articles.select("article_id"), "article_id", "left_anti").select(F.lit("link without article").alias("kind"), F.col("article_id").alias("id"))
    return repeated.unionByName(no_topic).unionByName(no_article)


def snapshot(topics: DataFrame, links: DataFrame, articles: DataFrame) -> DataFrame:
    """(topic_id, payload): one JSON document per topic with its articles in order of id; topics without articles have an empty list."""
    columns = [c for c in articles.columns if c != "body"]
    item = F.struct(*[F.col(f"a.{c}").alias(c) for c in sorted(columns, key=lambda c: (c != "article_id", c))])
    own = links.alias("l").join(articles.alias("a"), F.col("l.article_id") == F.col("a.article_id")).groupBy("l.topic_id").agg(F.array_sort(F.collect_list(item)).alias("articles"))
    rows = topics.join(own, "topic_id", "left")
    payload = F.to_json(F.struct(*[F.col(c) for c in sorted(topics.columns)], F.coalesce("articles", F.array().cast(dict(own.dtypes)["articles"])).alias("articles")))
    return rows.select("topic_id", payload.alias("payload"))


def generation(documents: DataFrame) -> str:
    """A content address of a snapshot: the same documents in any order or partitioning give the same."""
    row = documents.agg(F.count("*").alias("n"), F.sum(F.xxhash64("topic_id", "payload").cast("decimal(38,0)")).alias("s")).first()
    return f"{row['n']:x}-{int(row['s'] or 0) & (2**64 - 1):016x}"


def write_snapshot(documents: DataFrame, folder: str) -> str:
    """Writes the documents under their generation and returns its path; an existing generation is left as it is."""
    path = f"{folder}/{generation(documents)}"
    documents.write.mode("ignore").json(path)
    return path


def publish(spark, folder: str, documents: DataFrame, index: dict) -> str:
    """Writes a snapshot and then lets the index name it: readers see the old or the new one, never a part. Without documents nothing changes.

    The index is renamed into its place by the file system that holds the folder; returns the snapshot's path.
    """
    import json

    if documents.isEmpty():
        raise ValueError("nothing to publish; what is there stays")
    path = write_snapshot(documents, folder)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    new, final = fs_path(f"{folder}/index.json.tmp"), fs_path(f"{folder}/index.json")
    out = fs.create(new, True)
    out.write(bytearray(json.dumps({**index, "snapshot": path.rsplit("/", 1)[-1]}, ensure_ascii=False).encode()))
    out.close()
    options = spark._jvm.java.lang.reflect.Array.newInstance(spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
    options[0] = spark._jvm.java.lang.Enum.valueOf(spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), "OVERWRITE")
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri() if new.toUri().getScheme() else fs.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(new), fs.makeQualified(final), options)
    return path
