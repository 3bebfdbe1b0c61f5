"""Crawl to index, page store, settings and background tasks."""

from lodestone.operators import crawl
from lodestone.plans.search import SearchEngine
from lodestone.plans.service import Service, crawl_and_index
from lodestone.sources.pages import PageStore, fetcher
from lodestone.sources.settings import Settings

PAGES = {
    "http://r.org/": "<body><main><p>Welcome to the site about sharks and their habits in the deep sea.</p></main><a href='x'></a><a href=\"/guide\">guide</a></body>",
    "http://r.org/guide/": "<body><article><p>This guide explains how sharks hunt at night near the coral reefs.</p></article></body>",
}


def get(url, timeout):
    return PAGES.get(url)


def test_crawl_and_index(spark, tmp_path):
    engine, pages = SearchEngine(spark, str(tmp_path / "store")), PageStore(spark, str(tmp_path / "pages"))
    roots = spark.createDataFrame([("r.org",)], "url string").selectExpr("concat('http://', url) as url")
    n, failed = crawl_and_index(engine, pages, fetcher(get, delay=0), roots, 5, 1)
    assert n == 2 and failed.count() == 0 and pages.lookup().count() == 2
    assert {r["identifier"] for r in engine.sources().collect()} == set(PAGES)
    assert crawl_and_index(engine, pages, fetcher(get, delay=0), roots, 5, 1)[0] == 2 and engine.store.count() == 2  # a page crawled again is replaced, not lost
    service, seen = Service(engine, str(tmp_path / "log")), []
    _, future = service.submit(service.search, "sharks hunt", done=lambda r, e: seen.append((r, e)))
    assert "coral" in future.result().retrieved_context[0] and seen[0][1] is None
    assert spark.read.json(str(tmp_path / "log")).first()["query"] == "sharks hunt"
    _, future = service.submit(engine.remove_source, "http://r.org/")
    assert future.result() and engine.store.count() == 1
    _, future = service.submit(lambda: 1 / 0, done=lambda r, e: seen.append((r, e)))
    assert isinstance(future.exception(), ZeroDivisionError) and isinstance(seen[-1][1], ZeroDivisionError)
    service.close()


def test_failures(spark):
    roots = spark.createDataFrame([("http://gone.org/",)], "url string")
    done, failed = crawl.crawl(fetcher(get, delay=0), roots, 3)
    assert done.count() == 0 and [tuple(r) for r in failed.collect()] == [("http://gone.org/", "fetch_error")]


def test_settings(tmp_path):
    path = str(tmp_path / "s.json")
    settings = Settings.load(path)
    settings.set("index", "/elsewhere")
    settings.save(path)
    (tmp_path / "s.json").write_text((tmp_path / "s.json").read_text().replace("{", '{"unknown": 1,', 1))
    assert Settings.load(path) == settings
