"""Extensions over the event stream (the reference workload has no streams): windows, sessions, last value before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) by window; on a stream state older than the watermark goes."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "1 hour", step: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.window("ts", width, step).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def last_before(events: DataFrame, kind: str, of: str) -> DataFrame:
    """Each event of ``kind`` with the same user's latest value of ``of`` at or before it: one ordered pass, no range join."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    both = events.where(F.col("event_type").isin(kind, of))
    seen = both.withColumn("last_value", F.last(F.when(F.col("event_type") == of, F.col("value")), ignorenulls=True).over(w))
    return seen.where(F.col("event_type") == kind).select("event_id", "user_id", "ts", "last_value")
