"""Weighted reciprocal rank fusion of a vector and a keyword leg."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed values.
RRF_K = 60
VECTOR_WEIGHT, BM25_WEIGHT = 0.6, 0.4
MIN_CANDIDATES, CANDIDATES_PER_RESULT, SELECTION_PER_RESULT = 25, 5, 3


def leg_sizes(k: int, vector_weight: float = VECTOR_WEIGHT, bm25_weight: float = BM25_WEIGHT) -> tuple[int, int]:
    """How many hits to ask of the vector and of the keyword leg for ``k`` results."""
    pool = max(CANDIDATES_PER_RESULT * k, MIN_CANDIDATES)
    share = vector_weight / (vector_weight + bm25_weight + 1e-9)
    return max(1, int(pool * share)), max(1, int(pool * (1 - share)))


def fuse(vector: DataFrame, keyword: DataFrame, key: str = "chunk_id", vector_weight: float = VECTOR_WEIGHT, bm25_weight: float = BM25_WEIGHT) -> DataFrame:
    """``query_id, key, score, vector_rank, bm25_rank``: the legs' weights over ``60 + rank``, summed.

    A union and one grouping, where a full outer join would need both legs sorted.
    """
    legs = vector.select("query_id", key, F.col("rank").alias("vector_rank"), F.lit(None).cast("int").alias("bm25_rank")).unionByName(
        keyword.select("query_id", key, F.lit(None).cast("int").alias("vector_rank"), F.col("rank").alias("bm25_rank"))
    )
    both = legs.groupBy("query_id", key).agg(F.min("vector_rank").alias("vector_rank"), F.min("bm25_rank").alias("bm25_rank"))
    part = lambda rank, weight: F.coalesce(F.lit(weight) / (F.lit(float(RRF_K)) + F.col(rank)), F.lit(0.0))
    return both.withColumn("score", part("vector_rank", vector_weight) + part("bm25_rank", bm25_weight))


def ranked(fused: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Best first; equal scores keep the order of the vector leg, then of the keyword leg."""
    order = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vector_rank"), F.asc_nulls_last("bm25_rank"), key)
    return fused.withColumn("rank", F.row_number().over(order))


def candidates(fused: DataFrame, k: int, key: str = "chunk_id") -> DataFrame:
    """The first ``3 k`` a query."""
    return ranked(fused, key).filter(F.col("rank") <= SELECTION_PER_RESULT * k)
