"""Fetching pages and keeping what a crawl has collected."""

from __future__ import annotations

import time
import urllib.request
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.urls import page_key

# Fixed values.
FETCH_TIMEOUT_S = 45.0
CRAWL_DELAY_S, MIN_CRAWL_DELAY_S = 0.5, 0.1

Transport = Callable[[str, float], str | None]


def http_get(url: str, timeout: float) -> str | None:
    """A page's text; None on any failure, so one page never fails a crawl."""
    try:
        with urllib.request.urlopen(url, timeout=timeout) as answer:  # noqa: S310
            return answer.read().decode(answer.headers.get_content_charset() or "utf-8", errors="ignore")
    except Exception:  # a page that can't be had is a row with a null page
        return None


def fetcher(transport: Transport = http_get, delay: float = CRAWL_DELAY_S, timeout: float = FETCH_TIMEOUT_S) -> Callable[[DataFrame], DataFrame]:
    """Fetches a frontier's urls, a host in one task and with a pause between its pages."""
    pause = max(MIN_CRAWL_DELAY_S, delay)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = []
            for url in batch.column("url").to_pylist():
                if pages:
                    time.sleep(pause)
                pages.append(transport(url, timeout))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pages, pa.string())], [*batch.schema.names, "html"])

    def fetch(frontier: DataFrame) -> DataFrame:
        host = F.lower(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1))
        rows = frontier.select("url", "level", "priority").repartition(host)
        return rows.mapInArrow(run, "url string, level int, priority double, html string")

    return fetch


class PageStore:
    """Collected pages by their key.  A key's newest page counts; each save is one new folder, so none can be half replaced."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def save(self, pages: DataFrame) -> None:
        """Adds accepted pages ``url, text``."""
        rows = pages.select(page_key(F.col("url")).alias("page_key"), "url", "text", F.unix_micros(F.current_timestamp()).alias("saved"))
        rows.write.parquet(f"{self.path}/batch={uuid.uuid4()}")

    def pages(self) -> DataFrame:
        rows = self.spark.read.parquet(self.path)
        newest = rows.groupBy("page_key").agg(F.max_by(F.struct("url", "text", "saved"), "saved").alias("row"))
        return newest.select("page_key", "row.*")

    def lookup(self) -> DataFrame:
        """``page_key, url``."""
        return self.spark.read.parquet(self.path).select("page_key", "url").distinct()

    def files(self) -> DataFrame:
        """All pages as files for the index, also those of earlier crawls."""
        name = F.concat("page_key", F.lit(".md"))
        return self.pages().select(
            F.concat(F.lit(f"{self.path}/"), name).alias("source_path"), name.alias("filename"), (F.col("saved") / 1e6).alias("mtime"), F.col("url").alias("original_url"), "text"
        )
