"""Extension: first occurrences and windowed counts over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream(spark: SparkSession, path: str, schema, files_at_once: int = 8) -> DataFrame:
    """A stream over the Parquet files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def first_seen(events: DataFrame, subject: str, condition: str, date: str) -> DataFrame:
    """(subject, condition, first_date), kept up to date; its state has a row for each pair, as the result has."""
    dated = events.filter(F.col(subject).isNotNull() & F.col(condition).isNotNull() & F.col(date).isNotNull())
    return dated.groupBy(subject, condition).agg(F.min(date).alias("first_date"))


def windowed_counts(events: DataFrame, date: str, keys: list[str], width: str, late: str) -> DataFrame:
    """(start, keys, n) in windows of a width; events later than `late` are dropped, and so is the state of old windows."""
    timed = events.withColumn("__at", F.col(date).cast("timestamp")).withWatermark("__at", late)
    out = timed.groupBy(F.window("__at", width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), *keys, "n")
