"""A stored index of vectors in inverted lists: upserts, deletions, merges, and searches that read only the lists near a query.

Centres are fitted by k-means (cosine) on a bounded sample, the ``max_fit`` vectors of the smallest hashed keys; every vector is filed under its nearest
centre.  A list's angle is the largest between its centre and a member.  ``search`` reads the ``n_probe`` lists whose centres are nearest to a query
(approximate); with ``exact`` it then reads each further list that by its angle may hold a nearer vector than the worst found, so that the
result is that of a whole scan.  ``list_places`` tells at which place the list of each true neighbour comes, and so which ``n_probe`` a recall needs.

Distance is cosine distance, in double precision, on vectors stored as 32-bit floats.  Defined results: vectors that are null, all zero, of another
length than the centres, or that hold a null or a non-finite component take no part, and supersede what their key had; such queries
find nothing; of a key that one addition repeats the vector of the largest hash counts; keys are never null; equal distances (to 6 digits) go by key.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.operators.vector import MAX_QUERY_BYTES, _matrix, _unit
from lodestone.session import ensure_checkpoint_dir, saved
from lodestone.sources.segments import Segments

MAX_LISTS, MAX_FIT, N_PROBE = 4096, 200_000, 16
_QUERIES_AT_ONCE, _TASK_BYTES = 256, 8 << 20
#: What an angle and a distance may be off by, rounding to 6 digits included.
_ANGLE_SLACK, _DISTANCE_SLACK = 1e-6, 2e-6
_VECTORS = "key long, embedding array<float>, angle double, segment long, list int"
_LISTS = "list int, angle double, n long"


def usable(embedding: Column) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(embedding) > 0) & finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def _angles(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(_unit(rows) @ centres.T, -1.0, 1.0))


def _nearest_of(distance: np.ndarray, keys: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the ``k`` smallest distances to 6 digits, then keys; only what may be among them is sorted."""
    rounded = np.round(distance, 6)
    if len(rounded) > k:
        at = np.flatnonzero(rounded <= np.partition(rounded, k - 1)[k - 1])
    else:
        at = np.arange(len(rounded))
    return at[np.lexsort((keys[at], rounded[at]))[:k]]


def _best(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.round("distance", 6), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


class VectorIndex(Segments):
    """An index of ``key, embedding`` in a folder; ``documents`` are known by their lists."""

    KEY, HELD = "long", "list"

    def __init__(self, spark: SparkSession, path: str, n_lists: int | None = None, max_fit: int = MAX_FIT) -> None:
        """``n_lists``: the square root of the number of vectors at the time of a fit, up to ``MAX_LISTS``, unless given."""
        super().__init__(spark, path)
        self.n_lists, self.max_fit = n_lists, max_fit

    # Centres

    def _fitted(self, vectors: DataFrame) -> np.ndarray:
        n = vectors.count()
        if not n:
            return np.zeros((0, 0))
        n_lists = self.n_lists or min(MAX_LISTS, math.isqrt(n - 1) + 1)
        sample = vectors.orderBy(F.xxhash64("key"), "key").limit(self.max_fit)
        sample = saved(sample.select(F.transform("embedding", lambda x: x.cast("double")).alias("embedding")))
        dims = sample.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()[0]
        sample = sample.filter(F.size("embedding") == dims)
        if n_lists == 1 or sample.distinct().limit(2).count() < 2:
            return _unit(np.array([sample.first()[0]]))
        rows = sample.select(array_to_vector("embedding").alias("features"))
        model = KMeans(k=n_lists, distanceMeasure="cosine", initMode="random", maxIter=10, seed=1).fit(rows)
        centres = _unit(np.array(model.clusterCenters(), np.float64))
        return centres[np.linalg.norm(centres, axis=1) > 0]

    def _centres(self) -> np.ndarray:
        """Centres of the latest whole segment, at most ``MAX_LISTS`` or the given number."""
        whole = [n for n in self._segments() if self._kinds[n] == "whole"]
        rows = self.spark.read.parquet(f"{self._folder(whole[-1], 'whole')}/centres").orderBy("list").collect() if whole else []
        return np.array([r["centre"] for r in rows], np.float64) if rows else np.zeros((0, 0))

    # Writing

    def _assigned(self, vectors: DataFrame, centres: np.ndarray) -> DataFrame:
        """``key, embedding, angle, list`` of ``key, embedding``."""
        sent = self.spark.sparkContext.broadcast(centres)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    angles = _angles(_matrix(batch.column("embedding")), sent.value)
                    lists = angles.argmin(axis=1)
                    nearest = angles[np.arange(len(lists)), lists]
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest), pa.array(lists.astype(np.int32))], ["key", "embedding", "angle", "list"])

        return vectors.mapInArrow(assign, "key long, embedding array<float>, angle double, list int")

    def _write(self, docs: DataFrame, kind: str) -> None:
        """A segment of ``key, embedding``, a row a key; a whole one fits its own centres."""
        number = self._next()
        folder, mark = self._folder(number, kind), F.lit(number).cast("long").alias("segment")
        used = docs.filter(usable(F.col("embedding")))
        centres = self._fitted(used) if kind == "whole" else self._centres()
        if kind == "whole":
            rows = [(i, c.tolist()) for i, c in enumerate(centres)]
            self.spark.createDataFrame(rows, "list int, centre array<double>").write.mode("overwrite").parquet(f"{folder}/centres")
        placed = self._assigned(used.filter(F.size("embedding") == centres.shape[1]), centres) if len(centres) else self.spark.createDataFrame([], _VECTORS)
        # A large list is written by several tasks, in ranges of keys.
        rows = placed.select("key", "embedding", "angle", mark, "list").repartitionByRange("list", "key").sortWithinPartitions("list", "key")
        rows.write.mode("overwrite").partitionBy("list").parquet(f"{folder}/vectors")
        written = self.spark.read.schema(_VECTORS).parquet(f"{folder}/vectors")
        written.groupBy("list").agg(F.max("angle").alias("angle"), F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{folder}/lists")
        self._complete(number, kind, docs.select("key").join(written.select("key", "list"), "key", "left"))

    def add(self, docs: DataFrame) -> None:
        """Indexes ``key, embedding``; keys that are there already are superseded."""
        rows = docs.select(F.col("key").cast("long").alias("key"), F.col("embedding").cast("array<float>").alias("embedding")).filter("key is not null")
        rows = saved(rows.groupBy("key").agg(F.max_by("embedding", F.xxhash64("embedding")).alias("embedding")))
        self._write(rows, "added" if len(self._centres()) else "whole")

    def merge(self) -> None:
        """All segments as one under centres fitted anew; what is superseded or deleted goes."""
        self._write(saved(self.live().select("key", "embedding")), "whole")

    # Reading

    def live(self, lists: list[int] | None = None) -> DataFrame:
        """The vectors there are, of all lists or of some: those of superseded and deleted keys are left out."""
        paths = self._paths("vectors")
        rows = self.spark.createDataFrame([], _VECTORS)
        for path in paths:
            rows = rows.unionByName(self.spark.read.schema(_VECTORS).parquet(path))
        if lists is not None:
            rows = rows.filter(F.col("list").isin(lists))
        if len(self._segments()) <= 1:
            return rows
        latest = self._all_documents().groupBy("key").agg(F.max("segment").alias("s"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        return rows.join(latest.select("key", "s"), "key", "left").filter("s is null or s = segment").drop("s")

    def list_sizes(self) -> DataFrame:
        """``list, angle, n``: a row a list that holds vectors; superseded ones count until ``merge``."""
        paths = self._paths("lists")
        rows = self.spark.read.schema(_LISTS).parquet(*paths) if paths else self.spark.createDataFrame([], _LISTS)
        return rows.groupBy("list").agg(F.max("angle").alias("angle"), F.sum("n").alias("n"))

    def _probed(self, queries: DataFrame, n_probe: int | None, skip: int = 0) -> DataFrame:
        """``query_id, embedding, within, lists``: the nearest ``n_probe`` lists (None: all), nearest first.

        With ``skip``, ``queries`` has ``within``, the largest distance of interest: of the lists after the nearest ``skip`` those that may hold a vector so near.
        """
        centres = self._centres()
        widths = {r["list"]: r["angle"] for r in self.list_sizes().collect()}  # a row a list
        there = np.array(sorted(widths), np.int64)
        sent = self.spark.sparkContext.broadcast((centres[there] if len(there) else centres, there, np.array([widths[i] for i in there])))

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            near, names, wide = sent.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                chosen = []
                angles = _angles(_matrix(batch.column("embedding")), near)
                within = np.asarray(batch.column("within"))
                for i, row in enumerate(angles):
                    order = np.argsort(row, kind="stable")
                    if skip:
                        order = order[skip:]
                        limit = np.arccos(np.clip(1.0 - within[i] - _DISTANCE_SLACK, -1.0, 1.0)) + _ANGLE_SLACK
                        order = order[row[order] - wide[order] <= limit]
                    chosen.append(names[order[:n_probe]].astype(np.int32))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chosen, pa.list_(pa.int32()))], ["query_id", "embedding", "within", "lists"])

        asked = queries if skip else queries.withColumn("within", F.lit(2.0))
        asked = asked.select("query_id", "embedding", "within").filter(usable(F.col("embedding")) & (F.size("embedding") == (centres.shape[1] if len(there) else -1)))
        return asked.mapInArrow(probe, "query_id long, embedding array<double>, within double, lists array<int>").filter("size(lists) > 0")

    def _scanned(self, probed: DataFrame, k: int, max_query_bytes: int) -> DataFrame:
        """``query_id, vec_id, distance``: of each task and query the ``k`` nearest in the lists asked, no farther than ``within``."""
        probed = saved(probed)
        n, size = probed.agg(F.count(F.lit(1)), F.sum(F.size("embedding") * 8 + F.size("lists") * 4)).first()
        n_blocks = max(1, -(-(size or 0) // max_query_bytes))
        found = self.spark.createDataFrame([], "query_id long, vec_id long, distance double")
        sizes = {r["list"]: r["n"] for r in self.list_sizes().collect()}  # a row a list
        for block in range(n_blocks if n else 0):
            rows = probed.filter(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == block).orderBy("query_id").collect()  # max_query_bytes
            if not rows:
                continue
            asking: dict[int, list[int]] = {}
            for i, row in enumerate(rows):
                for name in row["lists"]:
                    asking.setdefault(name, []).append(i)
            ids, matrix = np.array([r["query_id"] for r in rows], np.int64), _unit(np.array([r["embedding"] for r in rows], np.float64))
            within = np.array([r["within"] for r in rows]) + _DISTANCE_SLACK
            sent = self.spark.sparkContext.broadcast((ids, matrix, within, {name: np.array(at) for name, at in asking.items()}))

            def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                ids, matrix, within, asking = sent.value
                limit, held = within.copy(), {}
                for batch in batches:
                    lists, keys = np.asarray(batch.column("list")), np.asarray(batch.column("key"))
                    vectors = _unit(_matrix(batch.column("embedding")))
                    for name in np.unique(lists):
                        at = np.flatnonzero(lists == name)
                        for queries in np.array_split(asking[int(name)], -(-len(asking[int(name)]) // _QUERIES_AT_ONCE)):
                            distances = 1.0 - matrix[queries] @ vectors[at].T
                            for q, distance in zip(queries, distances, strict=True):
                                near = np.flatnonzero(distance <= limit[q])
                                if not len(near):
                                    continue
                                old_keys, old = held.get(q, (keys[:0], distance[:0]))
                                all_keys, found = np.concatenate([old_keys, keys[at][near]]), np.concatenate([old, distance[near]])
                                best = _nearest_of(found, all_keys, k)
                                held[q] = all_keys[best], found[best]
                                if len(best) == k:
                                    limit[q] = min(limit[q], found[best].max() + _DISTANCE_SLACK)
                if held:
                    columns = (np.concatenate([np.full(len(n), ids[q]) for q, (n, _) in held.items()]), *(np.concatenate([h[i] for h in held.values()]) for i in (0, 1)))
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "distance"])

            # Each task sends k rows a query, so tasks are made by bytes of vectors, not by files.
            n_tasks = max(1, -(-sum(sizes.get(name, 0) for name in asking) * matrix.shape[1] * 4 // _TASK_BYTES))
            part = self.live(sorted(asking)).select("key", "embedding", "list").coalesce(n_tasks).mapInArrow(scan, "query_id long, vec_id long, distance double")
            found = found.unionByName(part)
        return found

    def search(self, queries: DataFrame, k: int, n_probe: int = N_PROBE, exact: bool = False, max_query_bytes: int = MAX_QUERY_BYTES) -> DataFrame:
        """``query_id, vec_id, distance, rank`` of the ``k`` nearest found of each query ``query_id, embedding``.

        Queries are a stated set: their vectors go to the workers in blocks of ``max_query_bytes``.
        """
        asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        first = _best(self._scanned(self._probed(asked, n_probe), k, max_query_bytes), k)
        if not exact:
            return first
        first = saved(first.drop("rank"))
        # Where fewer than k were found every list is of interest.
        worst = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).alias("within"))
        rest = asked.join(worst, "query_id", "left").withColumn("within", F.coalesce("within", F.lit(2.0)))
        return _best(first.unionByName(self._scanned(self._probed(rest, None, skip=n_probe), k, max_query_bytes)), k)

    def list_places(self, queries: DataFrame, k: int) -> DataFrame:
        """``query_id, vec_id, place``: the place from 1 at which the list of each of the ``k`` true neighbours comes.

        The share of rows with ``place <= p`` is the recall of a search with ``n_probe=p``.
        """
        asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        true = self.search(asked, k, exact=True).select("query_id", F.col("vec_id").alias("key"))
        placed = true.join(self.documents().select("key", "list"), "key").join(self._probed(asked, None).select("query_id", "lists"), "query_id")
        return placed.select("query_id", F.col("key").alias("vec_id"), F.array_position("lists", F.col("list")).alias("place"))

    def probes_for(self, queries: DataFrame, k: int, recall: float = 0.95) -> int:
        """The least ``n_probe`` that finds this share of the true ``k`` neighbours of ``queries``."""
        places = self.list_places(queries, k).groupBy("place").agg(F.count(F.lit(1)).alias("n"))
        running = places.select("place", F.sum("n").over(W.orderBy("place")).alias("found"), F.sum("n").over(W.partitionBy()).alias("all"))  # a row a list at most
        return int(running.filter(F.col("found") >= F.lit(recall) * F.col("all")).agg(F.min("place")).first()[0] or 1)

    def recall(self, queries: DataFrame, k: int, n_probe: int = N_PROBE) -> DataFrame:
        """``query_id, found, true_neighbours, share_read``: what a search with ``n_probe`` finds of the true ``k``, and the share of vectors it reads."""
        places = self.list_places(queries, k).groupBy("query_id").agg(F.count_if(F.col("place") <= n_probe).alias("found"), F.count(F.lit(1)).alias("true_neighbours"))
        sizes = self.documents().groupBy("list").agg(F.count(F.lit(1)).alias("n"))
        asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        probes = self._probed(asked, n_probe).select("query_id", F.explode("lists").alias("list"))
        read = probes.join(sizes, "list").groupBy("query_id").agg(F.sum("n").alias("n"))
        total = self.documents().count()
        return places.join(read, "query_id").select("query_id", "found", "true_neighbours", F.round(F.col("n") / F.lit(total), 6).alias("share_read"))


def temporary_vector_index(spark: SparkSession, docs: DataFrame, n_lists: int | None = None) -> VectorIndex:
    """An index of ``key, embedding`` in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    index = VectorIndex(spark, f"{spark.sparkContext.getCheckpointDir()}/vectors-{uuid.uuid4()}", n_lists)
    index.add(docs)
    return index
