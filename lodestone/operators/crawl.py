"""Crawling as a loop over frontier tables.

A frontier row is a url with its level and priority (smaller is better).  A
round takes the best rows, joins them with what the fetcher returns, keeps acceptable pages,
and makes their links the next rows: resolved, normalised, filtered, scored, and
anti-joined with all urls seen.  Tables grow on the cluster; the driver sees counts.

What has been queued and what has been taken are tables that a round only appends to; every ``MERGE_EVERY``
rounds their pieces are written as one.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import urls as U
from lodestone.functions.html import page_links, page_text
from lodestone.session import saved

# Fixed values.
MIN_PAGE_CHARS = 10
SEED_PRIORITY = 100.0
TIME_LIMIT_S, STALL_S = 1800.0, 90.0

MERGE_EVERY = 16
_log = logging.getLogger(__name__)

Fetcher = Callable[[DataFrame], DataFrame]


def table_fetcher(pages: DataFrame, normalize: bool = True) -> Fetcher:
    """Serves pages ``url, html`` from a table; urls that it lacks come back with a null page."""
    # Written once: every round reads it.
    known = saved(pages.select((U.normalize_url(F.col("url")) if normalize else F.col("url")).alias("url"), "html").dropDuplicates(["url"]))
    return lambda frontier: frontier.join(known, "url", "left")


#: Why a fetched page isn't accepted, in the order in which it is decided.
REASONS = ("write_error", "processing_error", "fetch_error", "not_success", "no_markdown", "not_string", "too_short", "unknown")


def failure_reason(page: Column, text: Column, success: Column | None = None, error: Column | None = None, accepted: Column | None = None) -> Column:
    """One of ``REASONS`` for a fetched page that isn't accepted; null for one that is.

    ``success``: what the fetcher says.  ``error``: the step that failed (write_error, processing_error or fetch_error), null if none
    did.  ``accepted``: a caller's own verdict.  Texts with NUL characters are no strings but other content.
    """
    none = F.lit(None).cast("string")
    error = none if error is None else error
    return (
        F.when(error.isin("write_error", "processing_error", "fetch_error"), error)
        .when(F.lit(False) if success is None else ~F.coalesce(success, F.lit(True)), F.lit("not_success"))
        .when(page.isNull(), F.lit("fetch_error"))
        .when(text.isNull(), F.lit("no_markdown"))
        .when(F.contains(text, F.lit("\0")), F.lit("not_string"))
        .when(F.length(F.trim(text)) <= MIN_PAGE_CHARS, F.lit("too_short"))
        .when(error.isNotNull() | (F.lit(False) if accepted is None else ~F.coalesce(accepted, F.lit(False))), F.lit("unknown"))
    )


def links_of(pages: DataFrame, keywords: tuple[str, ...] = U.RELEVANCE_KEYWORDS) -> DataFrame:
    """Every link of pages ``url, html, level``: source, normalised target, text, level and priority."""
    links = pages.select(F.col("url").alias("source_url"), "level", F.explode(page_links(F.col("html"))).alias("link")).select("source_url", "level", "link.*")
    links = links.repartition("source_url", "href")  # else all links of a page stay in its task
    url = U.normalize_url(U.absolute_link(U.page_base(F.col("source_url"), F.col("base")), F.col("href")))
    # Exploded: what filters ask of a url is then asked of the one that was made, and not of copies of its expression.
    found = links.select("source_url", F.explode(F.array(url)).alias("url"), "text", (F.col("level") + 1).alias("level"))
    return found.filter("url <> ''").withColumn("priority", U.link_priority(F.col("url"), F.col("text"), keywords))


class _Pieces:
    """A table that grows by written pieces, merged into one every ``MERGE_EVERY`` of them."""

    def __init__(self, save: Callable[[DataFrame], DataFrame]) -> None:
        self.save, self.held = save, []

    def add(self, piece: DataFrame) -> DataFrame:
        piece = self.save(piece)
        self.held.append(piece)
        if len(self.held) > MERGE_EVERY:
            self.held = [self.save(self.all())]
        return piece

    def all(self) -> DataFrame:
        # Renewed columns: a checkpoint may keep constraints on columns that it has not, on which a union trips.
        return reduce(DataFrame.unionByName, [p.select(*(F.col(c).alias(c) for c in p.columns)) for p in self.held])


def crawl(
    fetch: Fetcher,
    roots: DataFrame,
    target: int,
    max_depth: int = 1,
    batch: int = 1000,
    keywords: tuple[str, ...] = U.RELEVANCE_KEYWORDS,
    accept: Column | None = None,
    save: Callable[[DataFrame], DataFrame] = saved,
    abort: Callable[[], bool] = lambda: False,
    time_limit: float = TIME_LIMIT_S,
    stall: float = STALL_S,
    ended: Callable[[str], None] = lambda why: None,
) -> tuple[DataFrame, DataFrame]:
    """Accepted pages ``page_key, url, level, priority, html, text`` and failures ``url, reason``.

    ``batch`` urls are fetched a round, best first; 1 is strict best-first order.  ``ended`` hears why the crawl ended: ``target`` pages
    are there, the frontier is ``empty``, ``abort`` said so, or ``time_limit`` seconds have passed; both are asked before a round, and what was
    collected until then is returned.  ``stall`` seconds without a new page only give a warning.
    ``accept`` says which targets to follow (a condition on ``url``); by default content pages on the roots' hosts.
    """
    roots = roots.select(U.normalize_url(F.col("url")).alias("url")).filter("url <> ''").distinct()
    hosts = roots.select(F.lower(U.url_part(F.col("url"), 2)).alias("root")).distinct()
    queued, taken, done, failed = (_Pieces(save) for _ in range(4))
    queued.add(roots.select("url", F.lit(1).alias("level"), F.lit(SEED_PRIORITY).alias("priority")))
    begun = progress = time.monotonic()
    n_done = 0
    while True:
        frontier = queued.all().join(taken.all(), "url", "left_anti") if taken.held else queued.all()
        waiting, room = frontier.count(), min(batch, target - n_done)
        why = "target" if n_done >= target else "empty" if not waiting else "abort" if abort() else "time_limit" if time.monotonic() - begun > time_limit else None
        if why:
            ended(why)
            break
        now = save(frontier if waiting <= room else frontier.orderBy("priority", "level", "url").limit(room))
        taken.add(now.select("url"))
        fetched = fetch(now).withColumn("text", F.when(F.col("html").isNotNull(), page_text(F.col("html"))["text"]))
        success = F.col("success") if "success" in fetched.columns else None
        error = F.col("error") if "error" in fetched.columns else None
        fetched = save(fetched.withColumn("reason", failure_reason(F.col("html"), F.col("text"), success, error)))
        good = done.add(fetched.filter("reason is null").select(U.page_key(F.col("url")).alias("page_key"), "url", "level", "priority", "html", "text"))
        failed.add(fetched.filter("reason is not null").select("url", "reason"))
        n_new = good.count()
        n_done += n_new
        if n_new:
            progress = time.monotonic()
        elif time.monotonic() - progress > stall:
            _log.warning("no new page for %.0f s, %d urls wait", time.monotonic() - progress, waiting)
            progress = time.monotonic()
        links = links_of(good.filter(F.col("level") <= max_depth), keywords)
        if accept is None:
            wanted = links.filter(U.is_content_page(F.col("url"))).withColumn("host", F.lower(U.url_part(F.col("url"), 2)))
            wanted = wanted.join(F.broadcast(hosts), U.host_within(F.col("host"), F.col("root")), "left_semi")  # the stated roots
        else:
            wanted = links.filter(accept)
        # Links to one url become one row before they are moved, as most pages may link to a few.
        fresh = wanted.groupBy("url").agg(F.min("level").alias("level"), F.min("priority").alias("priority")).join(queued.all().select("url"), "url", "left_anti")
        queued.add(fresh.select("url", "level", "priority"))
    if not done.held:
        empty = roots.sparkSession.createDataFrame
        return empty([], "page_key string, url string, level int, priority double, html string, text string"), empty([], "url string, reason string")
    return done.all(), failed.all()


def reachable(edges: DataFrame, seeds: DataFrame, max_level: int, save: Callable[[DataFrame], DataFrame] = saved) -> DataFrame:
    """``node, level``: the fewest steps from a seed, up to ``max_level``, over edges ``src, dst``."""
    found = save(seeds.select("node").distinct().withColumn("level", F.lit(0)))
    new = found
    for level in range(1, max_level + 1):
        ahead = edges.join(new.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        new = save(ahead.join(found.select("node"), "node", "left_anti").withColumn("level", F.lit(level)))
        if new.isEmpty():
            break
        found = found.unionByName(new)
    return found
