"""Streams of captured pages and of events: duplicates with bounded state, windows of activity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text

PAGES = "page_id long, url string, html string, ts timestamp"


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """Captured pages as they arrive in a folder of Parquet files."""
    return spark.readStream.schema(PAGES).parquet(path)


def without_duplicates(articles: DataFrame, late: str = "1 hour") -> DataFrame:
    """articles(…, plain, ts) without later ones of the same normalised text; state is dropped behind the watermark."""
    return articles.withColumn("content_hash", text.content_hash(F.col("plain"))).withWatermark("ts", late).dropDuplicatesWithinWatermark(["content_hash"])


def activity(events: DataFrame, width: str = "10 minutes", slide: str = "5 minutes", late: str = "1 hour", threshold: int = 5) -> DataFrame:
    """Counts of events(ts) in sliding windows, and whether a window is quiet."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", width, slide)).agg(F.count("*").alias("n"))
    return counted.select("window", "n", (F.col("n") <= threshold).alias("stable"))


def stability(events: DataFrame, partition: str, seconds: int = 1, threshold: int = 5) -> DataFrame:
    """Batch: for each event how many the trailing window holds, itself included, and whether that is quiet."""
    from pyspark.sql import Window

    at = F.unix_micros(F.col("ts").cast("timestamp"))
    trailing = Window.partitionBy(partition).orderBy(at).rangeBetween(-seconds * 1_000_000, 0)
    n = F.count("*").over(trailing)
    return events.withColumn("recent", n).withColumn("stable", F.col("recent") <= threshold)
