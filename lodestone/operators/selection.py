"""From ranked candidates to a query's context: near-duplicates out, token budget, assembled text."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import text as X

# Fixed values.
SIMILARITY = 0.85
TEMPLATE_OVERHEAD, MIN_RESERVATION, RESERVED_PART = 50, 200, 16
TOO_LONG_SLACK = 15
NO_HITS = "Could not find relevant information."
NO_CONTEXT = "Error: Could not build context from selected chunks."
EMPTY_RESPONSE = "Error: The model returned an empty response."
CANCELLED = "LLM generation cancelled during shutdown."


def too_similar(a: str, b: str, threshold: float = SIMILARITY) -> bool:
    """The matcher's default heuristics apply, as they do in the results this engine is to reproduce."""
    return bool(a and b) and SequenceMatcher(None, a, b).ratio() > threshold


def greedy_distinct(candidates: DataFrame, k: int, threshold: float = SIMILARITY) -> DataFrame:
    """In order of ``rank``, each query's first ``k`` candidates that resemble none taken before.

    Order-dependent, so a group is a Python loop; groups hold the few candidates of one query, never a
    share of the corpus.  ``selected`` is null for the candidates that weren't taken.
    """

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank", kind="stable")
        taken: list[str] = []
        place: list[int | None] = []
        for text in rows["text"]:
            usable = len(taken) < k and bool(text and text.strip())
            if usable and not any(too_similar(text, old, threshold) for old in taken):
                taken.append(text)
                place.append(len(taken))
            else:
                place.append(None)
        return rows.assign(selected=pd.array(place, dtype="Int32"))

    schema = ", ".join(f"`{n}` {t}" for n, t in candidates.dtypes)
    return candidates.groupBy("query_id").applyInPandas(choose, f"{schema}, selected int")


def generation_reserve(context_length: int) -> int:
    return max(MIN_RESERVATION, context_length // RESERVED_PART)


def context_budget(context_length: int, shell_tokens: Column) -> Column:
    return F.greatest(F.lit(0), F.lit(context_length - TEMPLATE_OVERHEAD - generation_reserve(context_length)) - shell_tokens)


def max_generated(context_length: int, asked: int = 512) -> int:
    return min(asked, generation_reserve(context_length))


def prompt_too_long(context_length: int, prompt_tokens: Column) -> Column:
    return prompt_tokens + TEMPLATE_OVERHEAD >= context_length - generation_reserve(context_length) + TOO_LONG_SLACK


def within_budget(rows: DataFrame, budget: Column, group: str = "query_id", order: str = "rank", tokens: str = "token_count") -> DataFrame:
    """The rows of each group, in order, up to the first that would exceed the budget.

    Token counts are positive, so a running sum says the same as stopping there.
    """
    window = W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn("running", F.sum(tokens).over(window)).filter(F.col("running") <= budget).drop("running")


def in_order(order: str, *values: str | Column) -> Column:
    """The group's values as an array in the order of a column."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), *values))), lambda x: x)


def header_html() -> Column:
    """The line above a context chunk: rank, score, source, file and chunk number."""
    file = F.when(
        F.col("filename").isNotNull() & ~F.col("source").eqNullSafe(F.col("source_path")), F.concat(F.lit(" | File: "), X.escape_html(F.col("filename")))
    ).otherwise(F.lit(""))
    return F.concat(
        F.lit("<b>Rank "), F.col("rank").cast("string"), F.lit("</b> (Score: "), F.format_string("%.4f", F.col("score")), F.lit(") | Source: "),
        X.escape_html(F.col("source")), file, F.lit(" | Chunk: "), F.coalesce(F.col("original_chunk_index").cast("string"), F.lit("N/A")),
    )


def result_status(n_hits: Column, n_context: Column, prompt_tokens: Column, context_length: int) -> Column:
    return (
        F.when(F.coalesce(n_hits, F.lit(0)) == 0, F.lit("no_hits"))
        .when(F.coalesce(n_context, F.lit(0)) == 0, F.lit("no_context"))
        .when(prompt_too_long(context_length, prompt_tokens), F.lit("prompt_too_long"))
        .otherwise(F.lit("ok"))
    )


def answer_status(status: Column, response: Column, error: Column, cancelled: bool = False) -> Column:
    """The state of a query once the model has run: what stood in its way before, else how the model ended."""
    ran = status == "ok"
    return (
        F.when(~ran, status)
        .when(F.lit(cancelled), F.lit("cancelled"))
        .when(error.isNotNull(), F.lit("llm_error"))
        .when(F.trim(F.coalesce(response, F.lit(""))) == "", F.lit("empty_response"))
        .otherwise(F.lit("ok"))
    )


def answer_text(status: Column, response: Column) -> Column:
    """What a query's asker reads, by its state."""
    return (
        F.when(status == "no_hits", F.lit(NO_HITS))
        .when(status == "cancelled", F.lit(CANCELLED))
        .when(status == "empty_response", F.lit(EMPTY_RESPONSE))
        .when(status.isin("ok", "llm_error"), response)
        .otherwise(F.lit(NO_CONTEXT))
    )
