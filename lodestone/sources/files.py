"""Reading document files into tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions import urls as U

# Fixed values.
ALLOWED_EXTENSIONS = (".md", ".markdown", ".txt", ".html", ".htm")
MTIME_TOLERANCE = 0.1


def is_hidden(relative_path: Column) -> Column:
    """A part of the path starts with a dot."""
    return relative_path.rlike(r"(^|/)\.")


def decoded(content: Column) -> Column:
    """UTF-8 with invalid bytes left out; texts whose start holds a replacement character are read as Latin-1."""
    text = F.replace(F.try_validate_utf8(content.cast("string")), F.lit("\u0000"), F.lit(""))
    lenient = F.regexp_replace(F.make_valid_utf8(content.cast("string")), "�", "")
    utf8 = F.coalesce(text, lenient)
    return F.when(F.contains(F.substring(utf8, 1, 1000), F.lit("�")), F.decode(content, "ISO-8859-1")).otherwise(utf8)


def scan_files(spark: SparkSession, root: str, managed_dir: str | None = None, internal: bool = False) -> DataFrame:
    """``source_path, filename, mtime, original_url, text`` of all documents below a folder or of one file.

    Hidden files and folders and other extensions are left out.  Files of the crawler's own folder are
    blocked unless the caller is the crawler.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace("path", r"^file:/+", "/")
    start = root.rstrip("/") + "/"
    rows = files.select(path.alias("source_path"), F.col("modificationTime").cast("double").alias("mtime"), "content")
    relative = F.when(F.startswith("source_path", F.lit(start)), F.substring("source_path", len(start) + 1, 1 << 20)).otherwise(F.element_at(F.split("source_path", "/"), -1))
    rows = rows.filter(X.extension(F.col("source_path")).isin(*ALLOWED_EXTENSIONS) & ~is_hidden(relative))
    if managed_dir is not None and not internal:
        rows = rows.filter(~is_managed(F.col("source_path"), managed_dir))
    return rows.select(
        "source_path",
        F.element_at(F.split("source_path", "/"), -1).alias("filename"),
        "mtime",
        F.lit(None).cast("string").alias("original_url"),
        decoded(F.col("content")).alias("text"),
    )


def is_managed(path: Column, managed_dir: str) -> Column:
    return F.startswith(path, F.lit(managed_dir.rstrip("/") + "/"))


def with_urls(files: DataFrame, lookup: DataFrame) -> DataFrame:
    """Files of crawled pages get the url that ``lookup`` (``page_key, url``) has for their name."""
    key = F.when(U.is_page_file(F.col("filename")), F.lower(F.substring("filename", 1, 16)))
    keyed = files.withColumn("page_key", key).join(lookup.withColumnRenamed("url", "looked_up"), "page_key", "left")
    return keyed.withColumn("original_url", F.coalesce("looked_up", "original_url")).drop("page_key", "looked_up")


def changed_files(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Files that the chunk table doesn't hold at (nearly) the same modification time."""
    stored = chunks.select(F.coalesce("original_url", "source_path").alias("stored_id"), F.col("mtime").alias("stored_mtime")).distinct()
    same = (F.coalesce("original_url", "source_path") == F.col("stored_id")) & (F.abs(F.col("mtime") - F.col("stored_mtime")) < MTIME_TOLERANCE)
    return files.join(stored, same, "left_anti")


def scan_counters(files: DataFrame, stored: DataFrame) -> DataFrame:
    """Per folder: files seen, those skipped because the store holds them unchanged, those that failed (no text), and those left to chunk."""
    number = files.withColumn("folder", F.regexp_replace("source_path", "/[^/]*$", ""))
    new = changed_files(files, stored).select("source_path", F.lit(True).alias("is_new")).distinct()
    rows = number.join(new, "source_path", "left")
    fresh, blank = F.coalesce("is_new", F.lit(False)), F.trim(F.coalesce("text", F.lit(""))) == ""
    return rows.groupBy("folder").agg(
        F.count(F.lit(1)).alias("processed"), F.count_if(~fresh).alias("skipped"), F.count_if(fresh & blank).alias("failed"), F.count_if(fresh & ~blank).alias("changed")
    )
