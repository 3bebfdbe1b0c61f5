"""Hybrid retrieval as one plan over a batch of queries, and the engine's facade."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import models as M
from lodestone.functions import text as X
from lodestone.functions.split import CHUNK_OVERLAP, CHUNK_SIZE, engine_limits
from lodestone.operators import bm25, fusion, selection, vector
from lodestone.operators.chunking import MIN_CHUNK_CHARS, chunk_documents
from lodestone.operators.inverted import InvertedIndex, term_clauses
from lodestone.operators.vector_index import N_PROBE, VectorIndex
from lodestone.sources import files as files_in
from lodestone.sources.store import ChunkStore

DERIVED = ("embedding", "tokens")  # what a chunk's text is searched by
#: Queries whose candidates are broadcast.
MAX_BROADCAST_QUERIES = 20_000

PROMPT = """Answer the question from the context alone, in one clear sentence and a short explanation.
If the context lacks the answer, say so.

### Context
{context}
### User Question
{query}
"""


def prompt_of(context, query):
    head, _, rest = PROMPT.partition("{context}")
    middle, _, tail = rest.partition("{query}")
    return F.concat(F.lit(head), context, F.lit(middle), query, F.lit(tail))


def few(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """Some rows a query, to be broadcast unless the queries are very many."""
    return F.broadcast(rows) if queries.count() <= MAX_BROADCAST_QUERIES else rows


def retrieve(
    chunks: DataFrame,
    queries: DataFrame,
    k: int,
    embedder: M.Embedder,
    mode: str = "and",
    index: InvertedIndex | None = None,
    vectors: VectorIndex | None = None,
    n_probe: int = N_PROBE,
) -> DataFrame:
    """Fused candidates ``query_id, chunk_id, score, vector_rank, bm25_rank, rank`` of queries ``query_id, text``.

    ``chunks`` has ``chunk_id, text, embedding``.  Texts and vectors join last, for candidates only.  With an ``index`` of the chunks the keyword leg
    reads its queries' terms from there, and no chunk; with ``vectors``, an index of theirs by ``xxhash64(chunk_id)``, the other leg reads the
    ``n_probe`` lists nearest to each query.
    """
    n_vector, n_bm25 = fusion.leg_sizes(k)
    asked = queries.select("query_id", M.embedded(F.col("text"), embedder).alias("embedding"))
    keyed = chunks.select(F.xxhash64("chunk_id").alias("vec_id"), "chunk_id", "embedding")
    near = vector.nearest(keyed.select("vec_id", "embedding"), asked, n_vector) if vectors is None else vectors.search(asked, n_vector, n_probe)
    # A few rows a query: chunks are read past them, and neither their names nor (in hydrated) their texts are shuffled.
    near = few(near, queries).join(keyed.select("vec_id", "chunk_id"), "vec_id")
    texts = "tokens" if "tokens" in chunks.columns else "text"
    if index is None:
        words = bm25.best(chunks.select("chunk_id", texts), queries, n_bm25, mode=mode)
    else:
        words = bm25.top_k(index.search(term_clauses(queries, mode)).withColumnRenamed("key", "chunk_id"), n_bm25)
    return few(fusion.candidates(fusion.fuse(near, words), k), queries)


def hydrated(candidates: DataFrame, chunks: DataFrame) -> DataFrame:
    """Candidates with their chunks' rows and whole texts; blank ones go."""
    return candidates.join(chunks.drop(*DERIVED), "chunk_id").filter(F.trim("text") != "")


def query_counters(candidates: DataFrame, chosen: DataFrame, queries: DataFrame) -> DataFrame:
    """Per query: hits of either leg among the candidates, distinct candidates, how many were skipped as similar, and how many were selected.

    ``chosen`` are the candidates with their place among the distinct ones in ``selected``.
    """
    legs = candidates.groupBy("query_id").agg(
        F.count("vector_rank").alias("vector_results"), F.count("bm25_rank").alias("bm25_results"), F.count(F.lit(1)).alias("combined_results")
    )
    picked = chosen.groupBy("query_id").agg(F.count("selected").alias("selected_chunks"), F.count_if(F.col("selected").isNull()).alias("skipped_chunks"))
    rows = queries.select("query_id").join(legs, "query_id", "left").join(picked, "query_id", "left")
    return rows.na.fill(0)


def assemble(candidates: DataFrame, chunks: DataFrame, queries: DataFrame, k: int, context_length: int) -> DataFrame:
    """One row a query: its context, sources, prompt and status."""
    chosen = selection.greedy_distinct(hydrated(candidates, chunks), k).filter("selected is not null")
    shell = X.estimated_tokens(prompt_of(F.lit(""), F.col("question")))
    asked = queries.select("query_id", F.col("text").alias("question")).withColumn("budget", selection.context_budget(context_length, shell))
    chosen = chosen.join(asked.select("query_id", "budget"), "query_id").withColumns(
        {
            "token_count": X.estimated_tokens(F.concat("text", F.lit("\n\n"))),
            "source": X.display_source(F.col("original_url"), F.col("source_path")),
        }
    )
    fitting = selection.within_budget(chosen, F.col("budget"), order="selected")
    parts = fitting.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_context"),
        F.sum("token_count").alias("context_tokens"),
        F.array_sort(
            F.collect_list(
                F.struct(F.col("selected").alias("rank"), F.col("chunk_id").alias("id"), "score", "token_count", "source", "original_chunk_index", "original_url", "source_path", "filename", "text")
            )
        ).alias("held"),
    )
    hits = candidates.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_hits"))
    rows = asked.join(hits, "query_id", "left").join(parts, "query_id", "left")
    context = F.coalesce(F.rtrim(F.array_join(F.transform("held", lambda h: h["text"]), "\n\n")), F.lit(""))
    rows = rows.withColumn("context", context).withColumn("prompt", prompt_of(F.col("context"), F.col("question")))
    rows = rows.withColumn("prompt_tokens", X.estimated_tokens(F.col("prompt")))
    return rows.select(
        "query_id",
        F.col("question").alias("query"),
        selection.result_status(F.col("n_hits"), F.col("n_context"), F.col("prompt_tokens"), context_length).alias("status"),
        F.coalesce("n_hits", F.lit(0)).alias("n_candidates"),
        F.coalesce("n_context", F.lit(0)).alias("n_context"),
        F.coalesce("context_tokens", F.lit(0)).alias("context_tokens"),
        F.transform("held", lambda h: h["text"]).alias("retrieved_context"),
        F.transform("held", lambda h: h.dropFields("text")).alias("sources"),
        "prompt",
    )


def answered(rows: DataFrame, model: M.LanguageModel, max_tokens: int = 512, cancelled: bool = False) -> DataFrame:
    """Assembled rows with ``response``, their ``status`` after it; the model runs only where there is a context, and not at all once cancelled."""
    ready = (F.col("status") == "ok") & F.lit(not cancelled)
    made = rows.withColumn("made", F.when(ready, M.generated(F.when(ready, F.col("prompt")), model, max_tokens)))
    made = made.withColumn("status", selection.answer_status(F.col("status"), F.col("made.response"), F.col("made.error"), cancelled))
    return made.withColumn("response", selection.answer_text(F.col("status"), F.col("made.response"))).drop("made")


class SearchEngine:
    """Sources in, answers out: the chunk table, its maintenance, and batched search."""

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        embedder: M.Embedder = M.HashingEmbedder(),
        model: M.LanguageModel = M.ExtractiveModel(),
        chunk_size: int = CHUNK_SIZE,
        overlap: int = CHUNK_OVERLAP,
        min_chars: int = MIN_CHUNK_CHARS,
        max_results: int = 3,
        indexed: bool = False,
        n_probe: int = N_PROBE,
    ) -> None:
        """``indexed``: keep indexes of terms and of vectors beside the chunks, for collections too large to be read for each batch of queries."""
        self.spark, self.store, self.embedder, self.model = spark, ChunkStore(spark, path), embedder, model
        self.index = InvertedIndex(spark, f"{path.rstrip('/')}/index") if indexed else None
        self.vectors, self.n_probe = VectorIndex(spark, f"{path.rstrip('/')}/vectors") if indexed else None, n_probe
        self.chunking, self.max_results = engine_limits(chunk_size, overlap, min_chars), max_results

    def add_source(self, path: str, managed_dir: str | None = None, internal: bool = False) -> tuple[int, bool]:
        """Chunks added from a file or folder, and whether it was blocked; unchanged files are left as they are."""
        if managed_dir and not internal and (path.rstrip("/") + "/").startswith(managed_dir.rstrip("/") + "/"):
            return 0, True
        found = files_in.changed_files(files_in.scan_files(self.spark, path, managed_dir, internal), self.store.read())
        return self.add_files(found), False

    def add_files(self, files: DataFrame) -> int:
        """New chunks are embedded and analysed once, here; searches read both from the store."""
        chunks = chunk_documents(files, *self.chunking)
        n = self.store.replace_sources(chunks.withColumns({"embedding": M.embedded(F.col("text"), self.embedder), "tokens": bm25.analyzed(F.col("text"))}))
        self._reindex()
        return n

    def remove_source(self, source: str) -> bool:
        removed = self.store.remove_source(source)
        self._reindex()
        return removed

    def _reindex(self) -> None:
        """Brings the indexes up to the store, from whatever it held."""
        if self.index is not None:
            self.index.sync(self.store.read().select(F.col("chunk_id").alias("key"), "text"))
            self.vectors.sync(self.store.read().select(F.xxhash64("chunk_id").alias("key"), "embedding"))

    def sources(self) -> DataFrame:
        return self.store.sources()

    def search(self, queries: DataFrame | str, max_new_tokens: int = 512) -> DataFrame:
        """One row a query with ``response``; the model runs only for queries that have a context."""
        if isinstance(queries, str):
            queries = self.spark.createDataFrame([(1, queries)], "query_id long, text string")
        chunks = self.store.read()
        length = self.model.info.context_length
        rows = assemble(retrieve(chunks, queries, self.max_results, self.embedder, index=self.index, vectors=self.vectors, n_probe=self.n_probe), chunks, queries, self.max_results, length)
        return answered(rows, self.model, selection.max_generated(length, max_new_tokens))
