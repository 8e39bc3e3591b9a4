"""Structured Streaming forms of the time queries: watermarked windows, sessions and deduplication of seen addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_events(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 8) -> DataFrame:
    """A stream over a folder of parquet files; times without zone are taken as UTC, as a watermark needs instants."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def hourly(stream: DataFrame, late: str = "2 hours") -> DataFrame:
    w = F.window("ts", "1 hour")
    return stream.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total")).select(
        F.col("w.start").alias("hour"),
        "event_type",
        "events",
        F.round("total", 6).alias("total")
    )


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("events")).select(
        "user_id",
        F.col("w.start").alias("first_ts"),
        "events"
    )


def unseen(stream: DataFrame, keys: list[str], late: str = "2 hours") -> DataFrame:
    """The first row of each key within the watermark; state is dropped behind it."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def append_new(stream: DataFrame, target: str, keys: list[str], checkpoint: str):
    """Writes rows of unknown keys to the parquet folder `target`, batch by batch; a batch that is run again writes nothing twice.

    Each batch has a folder of its own, overwritten on a retry; known keys come from the other batches' folders.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(keys)
        try:
            known = spark.read.parquet(target).where(F.col("batch") != number).select(*keys)
            new = new.join(known, keys, "left_anti")
        except Exception as error:  # no folder yet
            if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
                raise
        new.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
