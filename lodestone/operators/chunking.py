"""Documents to chunks: split, filter, number and name them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions.html import page_text
from lodestone.functions.split import CHUNK_OVERLAP, CHUNK_SIZE, SEPARATORS, clamp_overlap, split_text

MIN_CHUNK_CHARS = 30
#: Bytes of texts that a task holds as Python's strings at once.
PIECE_BYTES = 1 << 20


def prepared(files: DataFrame) -> DataFrame:
    """``text`` as the splitter gets it, by the extension of ``filename``, and the ``processing_mode`` that applied."""
    mode = X.processing_mode(F.col("filename"))
    # The condition stands inside too: Spark gives a Python function every row, whatever is asked of its result.
    page = F.when(mode == "html", page_text(F.when(mode == "html", F.col("text"))))
    made = files.withColumn("processing_mode", mode).withColumn("page", page)
    body = (
        F.when(F.col("page.mode") == "html", X.clean_lines(F.col("page.text")))
        .when(F.col("processing_mode") == "markdown/text", X.normalize_newlines(F.col("text")))
        .otherwise(F.col("text"))
    )
    return made.withColumns({"text": X.strip_links(body), "processing_mode": F.coalesce("page.mode", "processing_mode")}).drop("page")


def _pieces(texts: pa.Array, most: int) -> Iterator[list[str | None]]:
    """The texts of an Arrow batch, as many at a time as hold about ``most`` bytes (a longer one alone)."""
    sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64))
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + most, side="right")))
        yield texts.slice(start, stop - start).to_pylist()
        start = stop


def split_column(text: Column, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> Column:
    """The raw chunks of a text, in order; Arrow batches carry texts to the splitter and chunks back, about ``PIECE_BYTES`` at a time."""

    @F.arrow_udf("array<string>")
    def split(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for texts in _pieces(batch, PIECE_BYTES):
                yield pa.array([[c.strip() for c in split_text(t or "", size, overlap, separators)] for t in texts], pa.list_(pa.string()))

    return split(text)


def chunk_documents(
    files: DataFrame,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    min_chars: int = MIN_CHUNK_CHARS,
    separators: tuple[str, ...] = SEPARATORS,
) -> DataFrame:
    """Chunks of files ``source_path, filename, mtime, original_url, text`` in the schema of the chunk table.

    ``original_chunk_index`` counts the splitter's chunks, ``filtered_chunk_index`` those that are kept.  Numbering
    needs no shuffle: a file's chunks are one array until they are exploded.
    """
    overlap = clamp_overlap(size, overlap)
    ready = prepared(files).filter(F.trim("text") != "")
    raw = F.transform(split_column(F.col("text"), size, overlap, separators), lambda c, i: F.struct(i.alias("index"), c.alias("text")))
    kept = F.filter(
        "raw", lambda c: (F.trim(c["text"]) != "") & (X.effective_length(c["text"]) >= min_chars) & ~X.is_repetitive(c["text"])
    )
    rows = ready.withColumn("raw", raw).select(
        "source_path", "filename", "mtime", "original_url", "processing_mode", F.posexplode(kept).alias("filtered_chunk_index", "chunk")
    )
    text = F.col("chunk.text")
    source = F.coalesce("original_url", "source_path")
    return rows.select(
        X.chunk_id(source, F.col("filtered_chunk_index"), text).alias("chunk_id"),
        "source_path",
        "filename",
        "mtime",
        "original_url",
        F.col("chunk.index").alias("original_chunk_index"),
        "filtered_chunk_index",
        F.length(text).alias("chunk_char_length"),
        X.effective_length(text).cast("int").alias("effective_length"),
        "processing_mode",
        text.alias("text"),
    )


def fixed_windows(docs: DataFrame, size: int, step: int) -> DataFrame:
    """Windows of ``size`` characters every ``step``: ``doc_id, window_index, chunk``."""
    last = F.greatest(F.lit(0), F.ceil((F.length("text") - size) / F.lit(step))).cast("int")
    at = F.explode(F.sequence(F.lit(0), last)).alias("window_index")
    return docs.filter(F.length("text") > 0).select("doc_id", "text", at).select(
        "doc_id", "window_index", F.substring("text", F.col("window_index") * step + 1, F.lit(size)).alias("chunk")
    )


def renumbered(chunks: DataFrame) -> DataFrame:
    """``filtered_chunk_index`` counted anew within each document, in the order of the original index."""
    order = W.partitionBy("source_path").orderBy("original_chunk_index", "chunk_id")
    return chunks.withColumn("filtered_chunk_index", F.row_number().over(order) - 1)
