"""Background tasks over a search engine: crawl and index, index, remove, search."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from lodestone.operators import crawl as C
from lodestone.plans.search import SearchEngine
from lodestone.sources.logs import append_log
from lodestone.sources.pages import PageStore


def crawl_and_index(engine: SearchEngine, pages: PageStore, fetch: C.Fetcher, roots: DataFrame, target: int, max_depth: int = 1, **settings) -> tuple[int, DataFrame]:
    """Crawls, keeps the pages, and indexes all kept pages; chunks added and the failures ``url, reason``."""
    done, failed = C.crawl(fetch, roots, target, max_depth, **settings)
    if done.isEmpty():
        return 0, failed
    pages.save(done.select("url", "text"))
    return engine.add_files(pages.files()), failed


class Service:
    """Runs tasks on a few threads, each as a job group of its own, so that one can be cancelled."""

    def __init__(self, engine: SearchEngine, log_path: str | None = None, workers: int = 2) -> None:
        self.engine, self.log_path, self.pool = engine, log_path, ThreadPoolExecutor(workers)

    def submit(self, task: Callable, *args, done: Callable[[object, Exception | None], None] | None = None) -> tuple[str, Future]:
        """The task's group and its future; ``done`` gets its result or its error."""
        context, group = self.engine.spark.sparkContext, str(uuid.uuid4())

        def run():
            context.setJobGroup(group, task.__name__, interruptOnCancel=True)
            try:
                result = task(*args)
            except Exception as error:
                if done:
                    done(None, error)
                raise
            if done:
                done(result, None)
            return result

        return group, self.pool.submit(inheritable_thread_target(self.engine.spark)(run))

    def cancel(self, group: str) -> None:
        self.engine.spark.sparkContext.cancelJobGroup(group)

    def search(self, query: str) -> Row:
        """Answers one query and logs it."""
        rows = self.engine.search(query)
        if self.log_path:
            rows = rows.persist()
            chunk = lambda s, text: F.struct(s["id"], s["score"], s["source_path"], s["filename"], s["original_chunk_index"], text.alias("document"))
            chunks = F.coalesce(F.zip_with("sources", "retrieved_context", chunk), F.array())
            debug = F.create_map(F.lit("final_selected_chunk_count"), F.col("n_context").cast("string"), F.lit("final_context_content_token_count"), F.col("context_tokens").cast("string"))
            append_log(rows.select("query", chunks.alias("chunks"), "response", debug.alias("debug_info")), self.log_path)
        return rows.first()

    def close(self) -> None:
        self.pool.shutdown(wait=True)
        self.engine.spark.catalog.clearCache()
