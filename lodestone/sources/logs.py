"""The query log (JSON lines) and the export of folders."""

from __future__ import annotations

import tarfile
import time
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as X

# Fixed values.
LOGGED_DEBUG_KEYS = (
    "retrieval_time", "llm_generation_time", "total_query_processing_time", "vector_initial_results", "bm25_initial_results",
    "final_selected_chunk_count", "query_embedding_time", "final_context_content_token_count", "estimated_full_prompt_tokens",
)
UNLOGGED_DEBUG_KEYS = ("raw_llm_output", "final_selected_chunk_details")


def logged_chunk(chunk: Column) -> Column:
    """The logged part of a chunk struct with ``id, score, source_path, filename, original_chunk_index, document``."""
    return F.struct(
        *(chunk[c].alias(c) for c in ("id", "score", "source_path", "filename", "original_chunk_index")), X.preview(chunk["document"]).alias("text_preview")
    )


def logged_debug(debug: Column, full: bool = False) -> Column:
    """The logged entries of a map of debug values."""
    if full:
        return F.map_filter(debug, lambda k, _: ~k.isin(*UNLOGGED_DEBUG_KEYS))
    return F.map_filter(debug, lambda k, _: k.isin(*LOGGED_DEBUG_KEYS))


def append_log(results: DataFrame, path: str, full: bool = False) -> None:
    """Appends results ``query, chunks, response, debug_info`` as JSON lines."""
    chunks = F.col("chunks") if full else F.transform("chunks", logged_chunk)
    results.select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        "query",
        chunks.alias("chunks_retrieved_details"),
        "response",
        logged_debug(F.col("debug_info"), full).alias("debug_info"),
    ).write.mode("append").json(path)


def export_folders(folders: list[str], target: str | None = None) -> str:
    """A ``.tar.gz`` of the folders that exist; an error if none does.  Runs on the driver, for its local folders."""
    present = [Path(f) for f in folders if Path(f).is_dir()]
    if not present:
        raise ValueError("none of the folders exists")
    target = target or f"export-{time.strftime('%Y%m%d-%H%M%S')}.tar.gz"
    with tarfile.open(target, "w:gz") as tar:
        for folder in present:
            tar.add(folder, arcname=folder.name)
    return target
