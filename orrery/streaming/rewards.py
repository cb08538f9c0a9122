"""Streams of rewards and memories: an extension of the ordered batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def events(spark: SparkSession, folder: str, files_at_once: int = 1) -> DataFrame:
    """Events from Parquet files as they arrive in a folder."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def windowed_rewards(stream: DataFrame, late: str = "1 hour", width: str = "1 day", slide: str | None = None) -> DataFrame:
    """n and mean of each arm in windows of event time; events later than the watermark are left out."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return stream.withWatermark("ts", late).groupBy(w, F.col("event_type").alias("arm")).agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "arm", "n", "mean")


def append_once(stream: DataFrame, path: str, checkpoint: str, key: str, change: Callable[[DataFrame], DataFrame] = lambda df: df):
    """Writes a stream so that a repeated batch adds no row twice: each batch has a folder of its own."""
    def write(batch: DataFrame, batch_id: int) -> None:
        change(batch.dropDuplicates([key])).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def running_arms(stream: DataFrame) -> DataFrame:
    """n, total and mean reward of each arm over all events so far."""
    return stream.groupBy(F.col("event_type").alias("arm")).agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.avg("value").alias("mean"))
