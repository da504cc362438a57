"""Structured Streaming forms of the event queries: counts by hour with late corrections, and who is active now.

Rows of events are event_id, user_id, event_type, ts, value. Rows without a ts
fall in no window. State is bounded by the watermark: what comes later than
``late`` after the newest event is left out of its window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def event_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    """Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def hourly_counts(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """hour, event_type, events, value: a row per hour and type, batch or stream alike."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type")
    counts = rows.agg(F.count("*").alias("events"), F.sum("value").alias("value"))
    return counts.select(F.col("window.start").alias("hour"), "event_type", "events", "value")


def active_users(events: DataFrame, within: str = "30 minutes", every: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """until, event_type, users: about how many users (within two hundredths) were active in each sliding window."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", within, every), "event_type")
    return rows.agg(F.approx_count_distinct("user_id", 0.02).alias("users")).select(F.col("window.end").alias("until"), "event_type", "users")


def distinct_events(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Each event once, however often it is delivered within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def write_partitions(counts: DataFrame, path: str, checkpoint: str, keys: tuple[str, ...] = ("hour", "event_type"), day: str = "day") -> StreamingQuery:
    """Keeps a table of corrected counts: a batch replaces the rows of its own keys, in the days that it touches only.

    A new version of those days is written beside the old one, so readers never see half of it, and a repeated batch
    writes the same again."""

    def upsert(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch = batch.withColumn(day, F.to_date(keys[0])).persist()  # read for its days, then for its rows
        days = [r[0] for r in fresh.select(day).distinct().collect()]  # the days within the watermark
        if not days:
            batch.unpersist()
            return
        before = current(spark, path)
        if before is not None:
            old = before.where(F.col(day).isin(days)).join(fresh.select(*keys), list(keys), "left_anti")
            fresh = fresh.unionByName(old.select(*fresh.columns))
        fresh.withColumn("batch", F.lit(number)).repartition(day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", day).parquet(path)
        batch.unpersist()

    return counts.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(upsert).start()


def current(spark: SparkSession, path: str, day: str = "day") -> DataFrame | None:
    """The newest version of each day of a table that write_partitions() keeps; None before its first batch."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    newest = rows.groupBy(day).agg(F.max("batch").alias("batch"))
    return rows.join(F.broadcast(newest), [day, "batch"]).drop("batch")  # a row per day
