"""Streaming ingestion, in place of polling modification times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.plans.search import SearchEngine

FILE_SCHEMA = "source_path string, filename string, mtime double, original_url string, text string"


def ingest_stream(engine: SearchEngine, files: DataFrame, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Each micro-batch of files replaces its sources in the chunk table; re-running a batch changes nothing."""

    def upsert(batch: DataFrame, _epoch: int) -> None:
        newest = batch.groupBy("source_path").agg(F.max_by(F.struct(*batch.columns), "mtime").alias("row")).select("row.*")
        engine.add_files(newest)

    writer = files.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def file_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Parquet drops of files in the schema of ``scan_files``."""
    return spark.readStream.schema(FILE_SCHEMA).parquet(folder)


def activity_windows(events: DataFrame, size: str = "1 hour", lateness: str = "30 minutes") -> DataFrame:
    """Events a window and type; works on streams, where late rows beyond ``lateness`` are left out, and on tables."""
    rows = events.withWatermark("ts", lateness) if events.isStreaming else events
    grouped = rows.groupBy(F.window("ts", size).alias("w"), "event_type")
    return grouped.agg(F.count(F.lit(1)).alias("n_events"), F.round(F.sum("value"), 4).alias("total")).select(
        F.col("w.start").alias("window_start"), "event_type", "n_events", "total"
    )
