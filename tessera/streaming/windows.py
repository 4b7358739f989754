"""Streaming extensions over event tables: windowed counts, sessions, and newest rows. They have no counterpart to match."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events(spark: SparkSession, folder: str, table: str = "events", per_trigger: int = 1) -> DataFrame:
    """A stream over the files of a table; the pattern in its path also fits a table that is one file."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(f"{folder}/{table}.parque[t]")


def windowed(stream: DataFrame, time: str, keys: list[str], length: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts per window and key; rows later than ``late`` are left out of closed windows."""
    rows = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    span = F.window(time, length, slide) if slide else F.window(time, length)
    return rows.groupBy(span.alias("span"), *keys).agg(F.count("*").alias("count")).select(F.col("span.start").alias("start"), F.col("span.end").alias("end"), *keys, "count")


def sessions(stream: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Rows of a key without a longer gap, as sessions."""
    rows = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return rows.groupBy(F.session_window(time, gap).alias("span"), key).agg(F.count("*").alias("count")).select(key, F.col("span.start").alias("start"), F.col("span.end").alias("end"), "count")
