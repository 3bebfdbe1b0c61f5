"""Exact nearest neighbours by cosine distance, for a stated set of query vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAX_QUERY_BYTES = 64 << 20
#: Bytes of a row that is kept for a query, with those of its like while they are sorted.
_KEPT_BYTES = 64
#: Queries of a tile, vectors of a slice, and how many of these are held against a tile at first and at most.
_TILE, _SLICE, _FIRST, _LOOK = 1024, 10_000, 256, 2048


def cosine_distance(a: Column, b: Column) -> Column:
    """In double precision, without leaving the JVM."""
    dot = lambda x, y: F.aggregate(
        F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v
    )
    return F.lit(1.0) - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten().cast(pa.float64()))
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


class _Best:
    """Each query's best ``k`` keys so far, by distance to 6 digits and then by key."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.query, self.keys, self.distance = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.worst = np.full(n, np.inf)

    def add(self, query: np.ndarray, keys: np.ndarray, distance: np.ndarray) -> None:
        query, keys, distance = (np.concatenate(x) for x in ((self.query, query), (self.keys, keys), (self.distance, distance)))
        order = np.lexsort((keys, np.round(distance, 6), query))
        query, keys, distance = query[order], keys[order], distance[order]
        nth = np.arange(len(query)) - np.searchsorted(query, query)
        last, keep = nth == self.k - 1, nth < self.k
        self.worst[query[last]] = distance[last]
        self.query, self.keys, self.distance = query[keep], keys[keep], distance[keep]


def _offer(best: _Best, matrix: np.ndarray, keys: np.ndarray, unit: np.ndarray) -> None:
    """Holds vectors against a tile of queries, a few at first, so that later looks find less that may be near enough."""
    at, look = 0, _FIRST
    while at < len(keys):
        some = slice(at, at + look)
        cosine = matrix @ unit[some].T
        # Distances that agree to 6 digits are less than that apart; also what is no number goes on, and is sorted last.
        q, v = np.nonzero(~(cosine < (1.0 - 1e-6 - best.worst)[:, None]))
        best.add(q, keys[some][v], 1.0 - cosine[q, v])
        at += look
        look = min(2 * look, _LOOK)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", max_query_bytes: int = MAX_QUERY_BYTES) -> DataFrame:
    """``query_id, key, distance, rank`` of each query's ``k`` nearest vectors; equal distances (to 6 digits) go by key.

    Query vectors go to the workers in blocks of ``max_query_bytes`` with the rows kept for them.  A task holds tiles of queries against slices of
    an Arrow batch, so its memory doesn't grow with either, keeps each query's best over all its batches and sends on ``k`` rows a query.
    """
    spark = vectors.sparkSession
    n, dims = queries.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    n_blocks = max(1, -(-(n or 0) * ((dims or 1) * 8 + k * _KEPT_BYTES) // max_query_bytes))
    base = vectors.filter(F.size("embedding") > 0).select(F.col(key).cast("long").alias("key"), "embedding")
    legs = []
    for block in range(n_blocks):
        part = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == block) if n_blocks > 1 else queries
        rows = part.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding")).toArrow()
        column = rows["embedding"].combine_chunks()
        column = column if isinstance(column, pa.ListArray) else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.list_(pa.float64()))
        asked = spark.sparkContext.broadcast((rows["query_id"].to_numpy(), _unit(_matrix(column))))

        def scan(batches: Iterator[pa.RecordBatch], asked=asked) -> Iterator[pa.RecordBatch]:
            ids, matrix = asked.value
            tiles = [(at, _Best(len(matrix[at : at + _TILE]), k)) for at in range(0, len(ids), _TILE)]
            for batch in batches:
                for start in range(0, len(batch), _SLICE):
                    piece = batch.slice(start, _SLICE)
                    keys, unit = np.asarray(piece.column("key")), _unit(_matrix(piece.column("embedding")))
                    for at, best in tiles:
                        _offer(best, matrix[at : at + _TILE], keys, unit)
            for at, best in tiles:
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(ids[at + best.query], pa.int64()), key: pa.array(best.keys), "distance": pa.array(best.distance)})

        legs.append(base.mapInArrow(scan, f"query_id long, {key} long, distance double"))
    found = legs[0]
    for leg in legs[1:]:
        found = found.unionByName(leg)
    order = W.partitionBy("query_id").orderBy(F.round("distance", 6), key)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
