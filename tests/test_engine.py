"""Operators and plans against small fixtures and brute force."""

import math
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.functions.models import HashingEmbedder
from lodestone.operators import bm25, chunking, crawl, fusion, selection, vector
from lodestone.operators.chunking import chunk_documents
from lodestone.plans import catalogue
from lodestone.plans.search import SearchEngine
from lodestone.sources import files as files_in
from lodestone.sources import logs, store
from lodestone.streaming.ingest import FILE_SCHEMA, activity_windows, file_stream, ingest_stream


def corpus(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, text string")


def ask(spark, docs, text, mode="and", n=2):
    queries = spark.createDataFrame([(1, text)], "query_id long, text string")
    return [r["chunk_id"] for r in bm25.top_k(bm25.bm25_scores(docs, queries, mode=mode), n).orderBy("rank").collect()]


def test_bm25_maintenance(spark):
    docs = corpus(spark, [("doc1", "The quick brown fox"), ("doc2", "jumps over the lazy dog"), ("doc3", "A quick test document")])
    assert set(ask(spark, docs, "quick")) == {"doc1", "doc3"}
    assert ask(spark, docs, "fox", n=1) == ["doc1"]
    left = store.without(docs, corpus(spark, [("doc1", "")]))
    assert left.count() == 2 and ask(spark, left, "fox") == [] and ask(spark, left, "quick") == ["doc3"]
    versioned = left.withColumn("version", F.lit(1))
    new = corpus(spark, [("doc2", "new content for dog document")]).withColumn("version", F.lit(2))
    updated = store.upserted(versioned, new).drop("version")
    assert updated.count() == 2 and ask(spark, updated, "new content") == ["doc2"]
    assert ask(spark, updated, "dog document", n=1) == ["doc2"]
    assert ask(spark, updated, "the of and") == []


def test_bm25_scores(spark):
    texts = {"a": "spark spark sql", "b": "spark engine", "c": "query engine plans", "d": ""}
    docs = corpus(spark, list(texts.items()))
    queries = spark.createDataFrame([(1, "spark engine")], "query_id long, text string")
    got = {r["chunk_id"]: r["score"] for r in bm25.bm25_scores(docs, queries, mode="or").collect()}
    avg = sum(len(t.split()) for t in texts.values()) / 4

    def score(text):
        words, total = text.split(), 0.0
        for term in ("spark", "engine"):
            tf, df = words.count(term), sum(term in t.split() for t in texts.values())
            if tf:
                total += (math.log(4 / (df + 1)) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / avg))
        return total

    assert got.keys() == {"a", "b", "c"} and all(abs(got[k] - score(texts[k])) < 1e-9 for k in got)


def test_nearest_blocks(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(60)] + [(60, [0.0] * 8), (61, None)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    queries = vectors.filter("vec_id % 20 = 0 and vec_id < 60").select(F.col("vec_id").alias("query_id"), "embedding")
    one = sorted(map(tuple, vector.nearest(vectors, queries, 3).select("query_id", "vec_id", "rank").collect()))
    many = sorted(map(tuple, vector.nearest(vectors, queries, 3, max_query_bytes=64).select("query_id", "vec_id", "rank").collect()))
    assert one == many and [r for r in one if r[2] == 1] == [(q, q, 1) for q in (0, 20, 40)]


def test_vector_scan_is_bounded(spark, monkeypatch):
    """Neither many queries nor many vectors widen what a task holds, and it sends a query's best once, not once a batch."""
    rng, scans = np.random.default_rng(3), []
    vectors = rng.standard_normal((6000, 8)).astype(np.float32)
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors[:3000])], "query_id long, embedding array<float>")
    base = spark.createDataFrame([(0, vectors[0].tolist())], "vec_id long, embedding array<float>")
    monkeypatch.setattr(type(base), "mapInArrow", lambda df, scan, schema: scans.append(scan) or spark.createDataFrame([], schema))
    vector.nearest(base, asked, 5)
    batches = [pa.RecordBatch.from_pydict({"key": pa.array(range(i, i + 3000)), "embedding": pa.array(vectors[i : i + 3000].tolist(), pa.list_(pa.float32()))}) for i in (0, 3000)]
    tracemalloc.start()
    found = pa.Table.from_batches(scans[0](iter(batches)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.num_rows == 15_000 and peak < 60 << 20
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    got = {}
    for q, v in zip(found["query_id"].to_pylist(), found["vec_id"].to_pylist()):
        got.setdefault(q, set()).add(v)
    assert all(got[q] == set(np.argsort(-(unit @ unit[q]))[:5].tolist()) for q in range(0, 3000, 100))


def test_made_up_scores_hold_the_best(spark):
    ids = [*range(0, 3000, 7), *range(300), -1, -15, -700, 5, 5]
    asked = [0, 1, 100, 101, 202, 2020, -1, -30]
    scores = catalogue._made_up_scores(spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame([(i,) for i in asked], "query_id long"), 10)
    rest = lambda i, q: int(math.fmod(i * 7 + q, 101))
    want = {(q, n + 1, i) for q in asked for n, i in enumerate(sorted(ids, key=lambda i: (rest(i, q), i))[:10])}
    assert {(r["query_id"], r["rank"], r["id"]) for r in bm25.top_k(scores, 10, "id").collect()} == want
    assert scores.filter("query_id >= 0 and id >= 0").count() == 10 * 6


def test_fusion(spark):
    assert fusion.leg_sizes(3) == fusion.leg_sizes(5) == (14, 10) and fusion.leg_sizes(10) == (29, 20)
    near = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id long, chunk_id string, rank int")
    words = spark.createDataFrame([(1, "b", 1), (1, "c", 2)], "query_id long, chunk_id string, rank int")
    got = fusion.ranked(fusion.fuse(near, words)).orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == ["b", "a", "c"]
    assert abs(got[0]["score"] - (0.6 / 62 + 0.4 / 61)) < 1e-12


def test_similarity():
    assert selection.too_similar("apple banana cherry grape", "apple banana cherry date", 0.85)
    assert not selection.too_similar("apple banana cherry", "apple banana kiwi", 0.90)
    assert not selection.too_similar("apple banana cherry", "dog cat bird", 0.80)
    assert not selection.too_similar("", "x") and not selection.too_similar("x", "")


def test_greedy_and_budget(spark):
    rows = [(1, r, "the same text here" if r % 2 else f"something else {r * 'xyz'}") for r in range(1, 10)]
    pool = spark.createDataFrame(rows, "query_id long, rank int, text string")
    chosen = selection.greedy_distinct(pool, 3).filter("selected is not null").orderBy("selected").collect()
    assert [r["rank"] for r in chosen][:2] == [1, 2] and len(chosen) == 3
    tokens = spark.createDataFrame([(1, i, t) for i, t in enumerate([5, 4, 9, 1])], "query_id long, rank int, token_count int")
    assert [r["rank"] for r in selection.within_budget(tokens, F.lit(10)).orderBy("rank").collect()] == [0, 1]
    assert selection.max_generated(128_000) == 512 and selection.generation_reserve(128_000) == 8000


def files_of(spark, rows):
    return spark.createDataFrame([(f"/d/{n}", n, 1.0, None, t) for n, t in rows], FILE_SCHEMA)


def test_chunk_modes(spark):
    long = "A sentence that is long enough to be kept as a chunk of its own. "
    rows = [("a.md", f"See [this]({'u' * 9}) now. {long * 20}"), ("b.html", f"<nav>Menu</nav><main><p>{long}</p></main>"), ("c.xyz", long), ("d.txt", "  \n "), ("e.txt", "=====\n" * 30)]
    got = chunk_documents(files_of(spark, rows), 200, 20, 30).collect()
    by = {n: [r for r in got if r["filename"] == n] for n, _ in rows}
    assert len(by["a.md"]) > 1 and all("](" not in r["text"] for r in got)
    assert [r["filtered_chunk_index"] for r in by["a.md"]] == list(range(len(by["a.md"])))
    assert by["b.html"][0]["processing_mode"] == "html" and "Menu" not in by["b.html"][0]["text"]
    assert by["c.xyz"][0]["processing_mode"] == "unknown_fallback_raw" and not by["d.txt"] and not by["e.txt"]


def test_scan_files(spark, tmp_path):
    (tmp_path / "sub" / ".hidden").mkdir(parents=True)
    (tmp_path / "raw").mkdir()
    for name, data in (("a.MD", b"alpha"), ("b.png", b"x"), ("sub/c.txt", b"caf\xc3\xa9 \xff!"), ("sub/.hidden/d.md", b"x"), ("raw/e.md", b"managed")):
        (tmp_path / name).write_bytes(data)
    got = {r["filename"]: r["text"] for r in files_in.scan_files(spark, str(tmp_path), managed_dir=str(tmp_path / "raw")).collect()}
    assert got == {"a.MD": "alpha", "c.txt": "café !"}
    assert files_in.scan_files(spark, str(tmp_path), str(tmp_path / "raw"), internal=True).count() == 3


def test_engine(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "fox.md").write_text("The quick brown fox jumps over the lazy dog near the river bank.")
    (docs / "spark.md").write_text("Spark plans queries with a cost based optimizer and runs them on executors.")
    engine = SearchEngine(spark, str(tmp_path / "store"), embedder=HashingEmbedder(32))
    assert engine.add_source(str(docs)) == (2, False)
    assert engine.add_source(str(docs)) == (0, False)  # nothing has changed
    assert engine.add_source(str(docs), managed_dir=str(docs)) == (0, True)
    row = engine.search("quick fox").first()
    assert row["status"] == "ok" and "fox" in row["retrieved_context"][0] and row["response"]
    assert engine.sources().count() == 2
    assert engine.remove_source(str(docs / "fox.md")) and not engine.remove_source(str(docs / "fox.md"))
    assert engine.store.count() == 1
    assert SearchEngine(spark, str(tmp_path / "empty")).search("anything").first()["response"] == selection.NO_HITS


def test_replace_keeps_old_on_empty(spark, tmp_path):
    engine = SearchEngine(spark, str(tmp_path / "s"))
    text = "A first version of a text that is long enough to keep."
    assert engine.add_files(files_of(spark, [("a.md", text)])) == 1
    assert engine.add_files(files_of(spark, [("a.md", "")])) == 0 and engine.store.count() == 1
    assert engine.add_files(files_of(spark, [("a.md", text + " Changed.")])) == 1 and engine.store.count() == 1


def test_crawl(spark):
    page = lambda *links: "<body><p>enough text on this page</p>" + "".join(f'<a href="{h}">{t}</a>' for h, t in links) + "</body>"
    rows = [
        ("http://r.org/", page(("/guide", "guide"), ("/b", "b"), ("http://other.org/", "x"), ("/pic.png", "p"))),
        ("http://r.org/guide/", page(("/deep", "deep"))),
        ("http://r.org/b/", "<p>tiny</p>"),
        ("http://r.org/deep/", page(("/deeper", "d"))),
    ]
    pages = spark.createDataFrame(rows, "url string, html string")
    roots = pages.limit(1).select("url")
    done, failed = crawl.crawl(crawl.table_fetcher(pages), roots, target=10, max_depth=1, batch=1)
    assert {r["url"]: r["level"] for r in done.collect()} == {"http://r.org/": 1, "http://r.org/guide/": 2}
    assert {r["url"]: r["reason"] for r in failed.collect()} == {"http://r.org/b/": "too_short"}
    done, _ = crawl.crawl(crawl.table_fetcher(pages), roots, target=2, max_depth=5, batch=1)
    assert {r["url"] for r in done.collect()} == {"http://r.org/", "http://r.org/guide/"}  # best first


def test_logs_and_export(spark, tmp_path):
    rows = [("q", [("c", 0.5, "/p", "f", 1, "x" * 200)], "r", {"retrieval_time": "1", "raw_llm_output": "z"})]
    schema = "query string, chunks array<struct<id: string, score: double, source_path: string, filename: string, original_chunk_index: int, document: string>>, response string, debug_info map<string,string>"
    logs.append_log(spark.createDataFrame(rows, schema), str(tmp_path / "log"))
    row = spark.read.json(str(tmp_path / "log")).first()
    assert row["chunks_retrieved_details"][0]["text_preview"] == "x" * 150 + "..." and row["debug_info"].asDict() == {"retrieval_time": "1"}
    (tmp_path / "data").mkdir()
    (tmp_path / "data" / "f").write_text("1")
    assert logs.export_folders([str(tmp_path / "data"), str(tmp_path / "none")], str(tmp_path / "o.tar.gz")).endswith("o.tar.gz")


def test_streams(spark, tmp_path):
    engine = SearchEngine(spark, str(tmp_path / "store"))
    files_of(spark, [("a.md", "A streamed text that is long enough to be kept.")]).write.parquet(str(tmp_path / "in"))
    ingest_stream(engine, file_stream(spark, str(tmp_path / "in")), str(tmp_path / "cp")).awaitTermination()
    assert engine.store.count() == 1
    events = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:20:00", "a", 2.0)], "ts string, event_type string, value double")
    events = events.withColumn("ts", F.to_timestamp("ts"))
    assert [(r["n_events"], r["total"]) for r in activity_windows(events).collect()] == [(2, 3.0)]


def test_store_versions(spark, tmp_path):
    """A reader's version stays whole while others write; the second of two writers starts again; a damaged manifest stops reads and writes until it is dropped."""
    text = "A text that is long enough to be kept as one chunk, number "
    engine = SearchEngine(spark, str(tmp_path / "store"))
    chunks = lambda *names: engine_chunks(engine, files_of(spark, [(n, text + n) for n in names]))
    engine.store.replace_sources(chunks("a.md", "b.md"))
    before = engine.store.read()
    other = store.ChunkStore(spark, str(tmp_path / "store"))
    publish, lost = other._publish, []

    def overtaken(version, manifest):
        if not lost:  # somebody else commits between the read and the commit of this writer
            lost.append(engine.store.replace_sources(chunks("c.md")))
        return publish(version, manifest)

    other._publish = overtaken
    other.replace_sources(chunks("d.md"))
    assert {r["filename"] for r in engine.store.read().collect()} == {"a.md", "b.md", "c.md", "d.md"}
    assert {r["filename"] for r in before.collect()} == {"a.md", "b.md"}
    (tmp_path / "store" / "manifests" / "000000000099").write_text("{broken")
    for broken in (engine.store.count, lambda: engine.remove_source("/docs/a.md"), lambda: engine.store.replace_sources(chunks("e.md"))):
        with pytest.raises(store.Damaged):
            broken()
    assert engine.store.drop_damaged() == 1 and engine.store.drop_damaged() == 0
    assert engine.store.count() == 4 and engine.remove_source("/docs/a.md" if before.filter("source_path = '/docs/a.md'").count() else before.first()["source_path"])
    assert engine.store.count() == 3 and not engine.remove_source("/nowhere.md")
    assert engine.store.vacuum(keep=1) > 0 and engine.store.count() == 3


@pytest.mark.parametrize("when", ["before", "after"])
def test_no_update_is_lost(spark, tmp_path, when):
    """A second writer commits while the first one's manifest is written but has no number yet, or just got it."""
    path = str(tmp_path / "store")
    engine = SearchEngine(spark, path)
    chunks = lambda name: engine_chunks(engine, files_of(spark, [(name, "A text that is long enough to be kept as one chunk, number " + name)]))
    engine.store.replace_sources(chunks("x.md"))
    inside = []

    def commit(session, source, target):
        won = store.renamed(session, source, target) if when == "after" else None
        if not inside:
            inside.append(store.ChunkStore(spark, path).replace_sources(chunks("z.md")))
        return store.renamed(session, source, target) if won is None else won

    store.ChunkStore(spark, path, commit=commit).replace_sources(chunks("y.md"))
    assert inside and {r["filename"] for r in engine.store.read().collect()} == {"x.md", "y.md", "z.md"}
    source, target = (f"{path}/manifests/{n:012d}" for n in (1, 2))
    assert not store.renamed(spark, source, target) and engine.store.count() == 3
    assert not [p for p in (tmp_path / "store" / "manifests").iterdir() if p.name.startswith("_")]


def engine_chunks(engine, files):
    from lodestone.functions import models

    return chunk_documents(files, *engine.chunking).withColumns({"embedding": models.embedded(F.col("text"), engine.embedder), "tokens": bm25.analyzed(F.col("text"))})


def test_search_reads_stored_vectors(spark, tmp_path):
    engine = SearchEngine(spark, str(tmp_path / "store"))
    engine.add_files(files_of(spark, [("a.md", "Stored vectors and tokens are read, so that no chunk is embedded again."), ("b.md", "Nothing but filler is written here, at some length.")]))
    plan = engine.store.read()._jdf.queryExecution().toString()
    assert "ArrowEvalPython" not in plan and {"embedding", "tokens"} <= set(engine.store.read().columns)
    assert all(len(r["embedding"]) == engine.embedder.dimension and r["tokens"] for r in engine.store.read().collect())
    found = engine.search("stored vectors").first()
    assert found["status"] == "ok" and "Stored vectors" in found["response"]


def test_answer_states(spark):
    from lodestone.functions import models
    from lodestone.plans.search import answered

    class Broken:
        info = models.ExtractiveModel().info

        def generate(self, prompt, max_tokens=512, **settings):
            if "fail" in prompt:
                raise RuntimeError("no memory")
            return "" if "empty" in prompt else prompt

    rows = spark.createDataFrame([(1, "ok", "x"), (2, "ok", "fail"), (3, "ok", "empty"), (4, "no_hits", "fail"), (5, "no_context", ""), (6, "prompt_too_long", "")], "query_id int, status string, prompt string")
    got = {r["query_id"]: (r["status"], r["response"]) for r in answered(rows, Broken()).collect()}
    assert got[1] == ("ok", "x") and got[2] == ("llm_error", "LLM Error: no memory") and got[3] == ("empty_response", selection.EMPTY_RESPONSE)
    assert got[4] == ("no_hits", selection.NO_HITS) and got[5] == ("no_context", selection.NO_CONTEXT) and got[6][0] == "prompt_too_long"
    stopped = {r["query_id"]: r["status"] for r in answered(rows, Broken(), cancelled=True).collect()}
    assert [stopped[i] for i in range(1, 5)] == ["cancelled", "cancelled", "cancelled", "no_hits"]


def test_crawl_ends(spark):
    page = "<body><p>enough text on this page</p><a href='/x'>x</a></body>".replace("'", '"')
    pages = spark.createDataFrame([("http://r.org/", page)], "url string, html string")
    roots, why = pages.select("url"), []
    crawl.crawl(crawl.table_fetcher(pages), roots, target=1, ended=why.append)
    done, failed = crawl.crawl(crawl.table_fetcher(pages), roots, target=5, ended=why.append)
    assert done.count() == 1 and [r["reason"] for r in failed.collect()] == ["fetch_error"]
    assert crawl.crawl(crawl.table_fetcher(pages), roots, target=5, abort=lambda: True, ended=why.append)[0].count() == 0
    assert crawl.crawl(crawl.table_fetcher(pages), roots, target=5, time_limit=-1.0, ended=why.append)[0].count() == 0
    assert why == ["target", "empty", "abort", "time_limit"]


def test_dimensions_and_keywords():
    from lodestone.functions import models
    from lodestone.functions.urls import parsed_keywords

    class Probed:
        def embed(self, texts):
            return np.zeros((len(texts), 7), np.float32)

    assert models.embedding_dimension(HashingEmbedder(32)) == 32 and models.embedding_dimension(HashingEmbedder(32, 8)) == 8 and models.embedding_dimension(Probed()) == 7
    assert parsed_keywords('api "user guide" x') == ["api", "user guide", "x"] and parsed_keywords('open "quote') == ["open", '"quote']


def test_splitter_gets_pieces_and_parser_only_pages(spark):
    """Texts come to the splitter a few at a time, and none but HTML to the page parser, which Spark would otherwise run on each row."""
    texts = pa.array(["a" * 40, None, "b" * 200, "", "c" * 30, "d" * 30])
    held = list(chunking._pieces(texts, 100))
    assert [t for part in held for t in part] == texts.to_pylist() and [len(part) for part in held] == [2, 1, 3]
    files = spark.createDataFrame([("/d/a.md", "a.md", 1.0, None, "word " * 900), ("/d/b.html", "b.html", 1.0, None, f"<p>{'page ' * 900}</p>")], "source_path string, filename string, mtime double, original_url string, text string")
    assert "extract(CASE WHEN" in chunking.prepared(files)._jdf.queryExecution().analyzed().toString()
    rows = chunking.chunk_documents(files).groupBy("processing_mode").count().collect()
    assert {(r["processing_mode"], r["count"] > 1) for r in rows} == {("markdown/text", True), ("html", True)}


def test_crawl_makes_a_url_once(spark):
    """Filters ask a link's url for its value; pushed below the step that makes it, they would hold that step's expression many times over.  A table's urls are normalised once, not each round."""
    pages = spark.createDataFrame([("http://r.org/", "<a href='/a/../x'>x</a><a href='x/'>guide</a><a href='mailto:x'>m</a>", 1)], "url string, html string, level int")
    links = crawl.links_of(pages)
    assert sorted((r["url"], r["text"], r["level"]) for r in links.collect()) == [("http://r.org/x/", "guide", 2), ("http://r.org/x/", "x", 2)]
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(links).count("regexp_extract") < 60
    assert "regexp" not in plan(crawl.table_fetcher(pages)(pages.select("url")))
