"""Request logs as streams: the resumable part of an acquisition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import LOG


def log_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New entries of a folder of JSONL log files."""
    return spark.readStream.schema(LOG).json(folder)


def first_per_url(log: DataFrame, delay: str = "7 days") -> DataFrame:
    """The first valid entry of each url; state is dropped beyond the watermark."""
    timed = log.where("valid AND status = 200").withColumn("ts", F.to_timestamp("received_at_utc"))
    return timed.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["url"])


def statuses(log: DataFrame) -> DataFrame:
    """Counts per kind and status, for complete mode."""
    return log.groupBy("kind", "status").agg(F.count("*").alias("n"))
