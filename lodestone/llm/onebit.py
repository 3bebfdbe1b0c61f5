"""Nearest neighbours by inner product, through randomly rotated one-bit codes.

1. *Codes.*  A vector less the centre is turned by a random rotation and keeps the signs of its components, packed eight to a byte,
   with two correction scalars: its length over the inner product of the unit vector and its code, and the width of
   the estimate's error.  Rows go into blocks by where they are read, not by value; the index of blocks is written once.
2. *Search.*  Queries are dealt into blocks, the index into parts of bounded size, and each block meets each part in one task.  The packed bits
   give estimates of all inner products there.  A candidate whose estimate and error bound reach the query's
   worst kept score is reranked, by its original vector in double precision; others aren't among the nearest, but for the
   bound's chance of failing (``epsilon``).
3. *Check.*  With the worst kept scores that leaves, one product of the original vectors, with a slack for its rounding, finds
   what a bound failed; that is reranked too, so the result is exact whatever ``epsilon`` is.
4. *Merge.*  Each task sends ``k`` rows a query; the best of those over the parts are the result.

The centre is the mean of the ``FIT_ROWS`` vectors whose hashes are lowest; it affects the estimates' width only, and every row is
indexed.  A part has ``part_bytes`` and a block ``block_rows`` queries at most; so a search reads the index once for a block.

Defined results: a score is the sum of the components' products, in their order, in double precision; vectors that are null, empty, zero or hold a null or
a component that isn't finite take no part, nor do rows without an id; vectors of other lengths than the query's are no candidates of it; rows
with the query's id are no candidates; rows repeated in id and vector are one query and several candidates; a query without
candidates gets no rows.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lodestone.llm._spark import checkpointed, pieces, shuffle_width

FIT_ROWS = 4096
#: How many deviations the error bound is wide; an estimate fails it about once in 35 times, on one side, and is left to the check.
EPSILON = 1.9
PART_BYTES = 64 << 20
BLOCK_ROWS, MOST_BLOCK_ROWS = 512, 65_536
_INDEX_ROWS = 4096
_FIRST = 256
_PAIRS = 1 << 16
_SIDE = 1024
_INDEX = "block long, dim int, n int, ids binary, codes binary, scalars binary, vectors binary"
_NAMES = [c.split()[0] for c in _INDEX.split(", ")]
_TYPES = [pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4]


@lru_cache(maxsize=4)
def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix: the Q of a Gaussian one, with the signs that make it uniform."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))  # NaN is not below infinity
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _by_length(column: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Lengths with the rows that have them and these rows' vectors."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        yield int(dim), rows, column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), dim)


def encode(vectors: np.ndarray, centre: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs of the turned residuals, and of each vector: factor, error width (for ``epsilon`` 1 and a query of length 1), product with the centre less the centre's own."""
    dim = len(centre)
    exact = vectors.astype(np.float64)
    rest = exact - centre
    length = np.linalg.norm(rest, axis=1)
    turned = rest @ rotation(dim, seed).T
    on = turned >= 0
    with np.errstate(divide="ignore", invalid="ignore"):
        shared = np.where(length > 0, np.abs(turned).sum(axis=1) / (np.sqrt(dim) * length), 1.0)  # of the unit vector and its code; at least 1 / sqrt(dim)
    factor = length / (shared * np.sqrt(dim))
    width = length * np.sqrt(np.maximum(0.0, 1 - shared**2)) / shared / np.sqrt(max(1, dim - 1))
    return np.packbits(on, axis=1), np.column_stack((factor, width, exact @ centre - centre @ centre)).astype(np.float32)


def _index(centres: dict[int, np.ndarray], kind: type, seed: int):
    """Blocks of codes and vectors, numbered by partition and place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, len(batch), _INDEX_ROWS):
                piece = batch.slice(at, _INDEX_ROWS)
                ids = piece.column("vec_id").to_numpy()
                for dim, rows, vectors in _by_length(piece.column("embedding")):
                    codes, scalars = encode(vectors, centres.get(dim, np.zeros(dim)), seed)
                    row = [block, dim, len(rows), ids[rows].tobytes(), codes.tobytes(), scalars.tobytes(), vectors.astype(kind).tobytes()]
                    yield pa.RecordBatch.from_pydict({n: pa.array([v], t) for n, v, t in zip(_NAMES, row, _TYPES)})
                    block += 1

    return run


def centres_of(vectors: DataFrame, rows: int = FIT_ROWS) -> dict[int, np.ndarray]:
    """The mean of each length's vectors among the ``rows`` whose hashes are lowest; only these pass the driver."""
    sample = vectors.select("embedding", F.xxhash64("vec_id", "embedding").alias("order")).orderBy("order", "embedding").limit(rows).select("embedding").toArrow()
    column = sample["embedding"].combine_chunks()
    column = column if isinstance(column, pa.ListArray) else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.list_(pa.float64()))
    return {dim: found.astype(np.float64).mean(axis=0) for dim, _, found in _by_length(column)}


def vector_index(vectors: DataFrame, seed: int = 7, fit_rows: int = FIT_ROWS) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """The blocks of all rows of ``vec_id, embedding`` (usable ones), written once, and the centres."""
    centres = centres_of(vectors, fit_rows)
    kind = np.float64 if vectors.schema["embedding"].dataType.elementType == DoubleType() else np.float32
    return checkpointed(vectors.mapInArrow(_index(centres, kind, seed), _INDEX)), centres


class _Best:
    """The best ``k`` rows of each query so far: scores, ids, and the worst score kept (or minus infinity)."""

    def __init__(self, n: int, k: int) -> None:
        self.n, self.k = n, k
        self.query, self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.worst = np.full(n, -np.inf)

    def add(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        query, ids, scores = (np.concatenate(x) for x in ((self.query, query), (self.ids, ids), (self.scores, scores)))
        order = np.lexsort((ids, -scores, query))
        query, ids, scores = query[order], ids[order], scores[order]
        first = np.searchsorted(query, np.arange(self.n))
        nth = np.arange(len(query)) - first[query]
        keep = nth < self.k
        last = nth == self.k - 1
        self.worst[query[last]] = scores[last]
        self.query, self.ids, self.scores = query[keep], ids[keep], scores[keep]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows, summed in the order of the components."""
    return np.cumsum(a * b, axis=1)[:, -1]


def search_block(ids: np.ndarray, vectors: np.ndarray, blocks: list[tuple], centre: np.ndarray, k: int, epsilon: float, seed: int) -> tuple[_Best, int]:
    """The best candidates of some queries among some blocks (ids, codes, scalars, vectors), and how many were reranked.

    The first look at a block is short: the scores it gives let later looks rerank less.
    """
    dim = len(centre)
    rest = vectors - centre
    turned = (rest @ rotation(dim, seed).T).astype(np.float32)
    length, norm = (np.linalg.norm(x, axis=1).astype(np.float32) for x in (rest, vectors))
    level = (vectors @ centre).astype(np.float32)
    best, reranked, look = _Best(len(ids), k), 0, _FIRST

    def rerank(query: np.ndarray, found: np.ndarray, held: np.ndarray, originals: np.ndarray, rough: np.ndarray, slack: np.ndarray) -> int:
        for i in range(0, len(query), _PAIRS):
            q, f = query[i : i + _PAIRS], found[i : i + _PAIRS]
            near = ~(np.einsum("ij,ij->i", rough[q], originals[f]) < best.worst[q] - slack[q])
            q, f = q[near], f[near]
            best.add(q, held[f], products(vectors[q], originals[f].astype(np.float64)))
        return len(query)

    for held, codes, scalars, originals in blocks:
        rough = vectors.astype(originals.dtype)
        # What rounding can take from an estimate or a rough product.
        slack = norm * np.float32(2e-7 * (dim + 16) * (np.linalg.norm(originals, axis=1).max() + np.linalg.norm(centre)))
        at = 0
        while at < len(held):
            piece = slice(at, at + look)
            signs = np.unpackbits(codes[piece], axis=1, count=dim).astype(np.float32) * 2 - 1
            factor, width, base = scalars[piece].T
            reach = (turned @ signs.T) * factor
            reach += np.outer(length, width * np.float32(epsilon))
            reach += base
            reach += (level + slack)[:, None]
            other = held[piece][None, :] != ids[:, None]
            by_code = ~(reach < best.worst[:, None]) & other  # also what no estimate fits
            reranked += rerank(*np.nonzero(by_code), held[piece], originals[piece], rough, slack)
            # What the bound of an estimate failed: products are short of the true ones by no more than the slack.
            by_product = ~(rough @ originals[piece].T < (best.worst - slack)[:, None]) & other & ~by_code
            reranked += rerank(*np.nonzero(by_product), held[piece], originals[piece], rough, slack)
            at += look
            look = min(2 * look, _INDEX_ROWS)
    return best, reranked


def _search(centres: dict[int, np.ndarray], kind: type, k: int, epsilon: float, seed: int):
    def run(_key: tuple, queries: pa.Table, index: pa.Table) -> pa.Table:
        out = {"query_id": [], "mark": [], "vec_id": [], "score": []}
        if queries.num_rows and index.num_rows:
            column = queries["embedding"].combine_chunks()
            column = column if isinstance(column, pa.ListArray) else pa.concat_arrays(column.chunks)
            all_ids, marks = queries["vec_id"].to_numpy(), queries["mark"].to_numpy()
            for dim, rows, vectors in _by_length(column):
                blocks = [
                    (
                        np.frombuffer(b["ids"].as_py(), np.int64),
                        np.frombuffer(b["codes"].as_py(), np.uint8).reshape(-1, (dim + 7) // 8),
                        np.frombuffer(b["scalars"].as_py(), np.float32).reshape(-1, 3),
                        np.frombuffer(b["vectors"].as_py(), kind).reshape(-1, dim),
                    )
                    for b in (dict(zip(index.column_names, r)) for r in zip(*index.columns))
                    if b["dim"].as_py() == dim
                ]
                for i in range(0, len(rows), _SIDE):
                    some = rows[i : i + _SIDE]
                    best, _ = search_block(all_ids[some], vectors[i : i + _SIDE].astype(np.float64), blocks, centres.get(dim, np.zeros(dim)), k, epsilon, seed)
                    asked = some[best.query]
                    for name, values in zip(out, (all_ids[asked], marks[asked], best.ids, best.scores)):
                        out[name].append(values)
        return pa.table({n: pa.array(np.concatenate(v) if v else [], t) for (n, v), t in zip(out.items(), (pa.int64(), pa.int64(), pa.int64(), pa.float64()))})

    return run


def nearest_vectors(
    vectors: DataFrame,
    every: int = 20,
    k: int = 20,
    epsilon: float = EPSILON,
    seed: int = 7,
    fit_rows: int = FIT_ROWS,
    part_bytes: int = PART_BYTES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: of each row whose ``vec_id`` is divisible by ``every`` the ``k`` nearest among all others."""
    spark = vectors.sparkSession
    element = vectors.schema["embedding"].dataType.elementType
    kind, target = (np.float64, "array<double>") if element == DoubleType() else (np.float32, "array<float>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(target).alias("embedding"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    index, centres = vector_index(rows, seed, fit_rows)
    queries = rows.filter(F.pmod("vec_id", F.lit(every)) == 0).dropDuplicates()
    n_bytes, n_queries = index.agg(F.sum(F.octet_length("codes") + F.octet_length("vectors") + 20 * F.col("n"))).first()[0] or 0, queries.count()
    n_parts = pieces(n_bytes, part_bytes)
    # Blocks that keep all cores busy on small inputs; on large ones, blocks of as many queries as a task holds.
    n_blocks = max(pieces(n_queries, MOST_BLOCK_ROWS), min(pieces(n_queries, block_rows), shuffle_width(spark)))
    asked = queries.withColumn("mark", F.xxhash64("embedding")).withColumn("side", F.pmod(F.xxhash64("vec_id", "mark", F.lit(1)), F.lit(n_blocks)))
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))))
    held = index.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(n_parts)).cast("int")).withColumn("side", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))
    found = (
        asked.select("side", "part", "vec_id", "mark", "embedding")
        .groupBy("side", "part")
        .cogroup(held.select("side", "part", "dim", "ids", "codes", "scalars", "vectors").groupBy("side", "part"))
        .applyInArrow(_search(centres, kind, k, epsilon, seed), "query_id long, mark long, vec_id long, score double")
    )
    rank = F.row_number().over(W.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
