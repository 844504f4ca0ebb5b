"""Feed configuration and landed pages as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from listwright import config as C
from listwright.schemas import PAGES

FEED_COLUMNS = (
    "name string, adapter string, base_url string, search_url string, "
    "max_pages int, poll_interval_minutes int, enabled boolean, states array<string>"
)


def default_feeds(spark: SparkSession, feeds: Sequence[C.Feed] = C.FEEDS) -> DataFrame:
    rows = [
        (f.name, f.adapter, f.base_url, f.search_url, f.max_pages, f.poll_minutes, f.enabled, list(f.states))
        for f in feeds
    ]
    return spark.createDataFrame(rows, FEED_COLUMNS)


def read_feeds(spark: SparkSession, path: str) -> DataFrame:
    """Feeds of a JSON document ``{"sources": [{name, adapter, baseUrl, ...}]}``."""
    item = (
        "struct<name:string,adapter:string,baseUrl:string,searchUrl:string,"
        "pollIntervalMinutes:int,maxPages:int,enabled:boolean>"
    )
    states = F.array(*(F.lit(s) for s in C.FEED_STATES))
    doc = spark.read.schema(f"sources array<{item}>").json(path, multiLine=True)
    return doc.select(F.explode("sources").alias("s")).select(
        F.col("s.name").alias("name"),
        F.col("s.adapter").alias("adapter"),
        F.col("s.baseUrl").alias("base_url"),
        F.col("s.searchUrl").alias("search_url"),
        F.col("s.maxPages").alias("max_pages"),
        F.col("s.pollIntervalMinutes").alias("poll_interval_minutes"),
        F.coalesce("s.enabled", F.lit(False)).alias("enabled"),
        F.when(F.col("s.adapter").isin("item_list", C.ITEM_FEED), states)
        .otherwise(F.array().cast("array<string>"))
        .alias("states"),
    )


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed raw pages; fetching them is not this package's business."""
    return spark.read.schema(PAGES).parquet(path)


def stream_pages(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return (
        spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    )
