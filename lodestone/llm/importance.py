"""Importance resampling: documents drawn by how much their word runs look like a target's.

1. *Features.*  Every run of one to three consecutive words, joined by one space, falls into the bucket of its CRC-32
   modulo ``n_buckets``.  A batch's texts are one byte array: a table classifies and folds its bytes, differences of the
   classes give the words' borders, and the CRC registers of all runs advance together, two bytes a step by a
   table of 65,536 registers.  The register after a run is where the runs that it starts go on, so that no byte of a word is
   read more than three times.
2. *Gains.*  Each task sums its buckets and sends one row a bucket; the driver sees ``n_buckets`` sums of the documents and of
   the target.  A bucket's gain is a thousand times the logarithm of its smoothed shares' ratio, rounded down.
3. *Draw.*  A document's score is the sum of its features' gains plus Gumbel noise from its id, so that the highest scores are a
   sample without replacement by those weights.  Documents of too few words are never drawn.
4. *Ranks.*  Of the digests (no texts) those above an approximate cut are dealt by ranges of their order; a range's first rank is the
   sum of those before it.  Equal digests are counted before they are dealt.

Defined results: null and blank texts have no features and weight 0; a null id has the noise of an empty one and comes last among ties;
rows that agree in all that is returned share their ranks in no particular order, each its own; an empty target or table gives no error;
of an extra column whose name is one of those added, the added one gets an underscore.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lodestone.llm._spark import checkpointed, free_names, pieces, shuffle_width
from lodestone.llm._words import PLAIN_LOWER, row_of, split_words, text_slices, utf8

N_BUCKETS = 10_000
LONGEST = 3
_POLYNOMIAL = 0xEDB88320
_CHUNK = 1 << 20
_BLOCK = 1 << 18
#: Words of more bytes advance one by one.
_STEPPED = 64
_COPIES = 4096
_SLACK, _ACCURACY = 0.01, 1000


def _registers(bits: int) -> np.ndarray:
    """What becomes of every register of so many bits when that many bits have gone through it."""
    table = np.arange(1 << bits, dtype=np.uint32)
    for _ in range(bits):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(_POLYNOMIAL), table >> 1).astype(np.uint32)
    return table


_ONE, _TWO = _registers(8), _registers(16)


def _over_byte(state: np.ndarray, byte: np.ndarray | int) -> np.ndarray:
    return _ONE[(state ^ byte) & 0xFF] ^ (state >> np.uint32(8))


class _Words:
    """Words of a byte array, longest first, so that those a step still concerns are the first ones."""

    def __init__(self, folded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        self.bytes = folded
        padded = np.concatenate((folded, np.zeros(1, np.uint8)))
        self.pairs = np.ndarray((len(folded),), "<u2", padded, strides=(1,))
        self.starts, self.sizes = starts, ends - starts
        self.order = np.argsort(-self.sizes, kind="stable")

    def advance(self, state: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The registers after the words ``at`` (in ``order``), from one register each."""
        starts, sizes = self.starts[at], self.sizes[at]
        n_long = int(np.searchsorted(-sizes, -_STEPPED, side="left"))
        state = state.copy()
        for i in range(n_long):
            state[i] = zlib.crc32(self.bytes[starts[i] : starts[i] + sizes[i]], int(state[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
        starts, sizes, rest = starts[n_long:], sizes[n_long:], state[n_long:]
        for k in range(0, _STEPPED, 2):
            n = int(np.searchsorted(-sizes, -(k + 2), side="right"))
            if not n:
                break
            rest[:n] = _TWO[(rest[:n] ^ self.pairs[starts[:n] + k]) & 0xFFFF] ^ (rest[:n] >> np.uint32(16))
        odd = np.flatnonzero(sizes & 1)
        rest[odd] = _over_byte(rest[odd], self.bytes[starts[odd] + sizes[odd] - 1])
        return state


def run_buckets(folded: np.ndarray, starts: np.ndarray, ends: np.ndarray, follows: np.ndarray, n_buckets: int) -> list[np.ndarray]:
    """For each length of run the bucket of the run that starts at each word, or -1 where the text ends before it does.

    ``follows``: whether a word has another of its text before it.
    """
    words = _Words(folded, starts, ends)
    state = np.empty(len(starts), np.uint32)
    state[words.order] = words.advance(np.full(len(starts), 0xFFFFFFFF, np.uint32), words.order)
    reached = np.ones(len(starts), bool)
    out = [((state ^ np.uint32(0xFFFFFFFF)) % n_buckets).astype(np.int64)]
    for length in range(1, LONGEST):
        reached = follows & np.concatenate(([False], reached[:-1]))  # words that end a run of one more word than before
        last = words.order[reached[words.order]]
        first = last - length
        state[first] = words.advance(_over_byte(state[first], 0x20), last)
        bucket = np.full(len(starts), -1, np.int64)
        bucket[first] = (state[first] ^ np.uint32(0xFFFFFFFF)) % n_buckets
        out.append(bucket)
    return out


def text_buckets(column: pa.Array | pa.ChunkedArray, n_buckets: int = N_BUCKETS) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Blocks of words: the row of each, and the buckets of the runs that it starts."""
    raw, bounds = utf8(column)
    row, n = 0, len(bounds) - 1
    while row < n:
        stop = max(row + 1, int(np.searchsorted(bounds, bounds[row] + _CHUNK, side="right")) - 1)
        local = bounds[row : stop + 1] - bounds[row]
        starts, ends, folded = split_words(raw[bounds[row] : bounds[stop]], local, PLAIN_LOWER)
        rows = row_of(np.searchsorted(starts, local))
        follows = np.concatenate(([False], rows[1:] == rows[:-1])) if len(rows) else np.zeros(0, bool)
        for at in range(0, len(starts), _BLOCK):
            end = at + _BLOCK
            ahead = slice(at, end + LONGEST - 1)
            linked = follows[ahead].copy()
            linked[0] = False
            found = run_buckets(folded, starts[ahead], ends[ahead], linked, n_buckets)
            yield rows[at:end] + row, [b[:_BLOCK] for b in found]
        row = stop


def bucket_counts(texts: DataFrame, text: str = "text", n_buckets: int = N_BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(n_buckets, np.int64)
        for batch in text_slices(batches, column="body"):
            for _, buckets in text_buckets(batch.column("body"), n_buckets):
                for b in buckets:
                    counts += np.bincount(b[b >= 0], minlength=n_buckets)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(used, pa.int32()), "n": pa.array(counts[used], pa.int64())})

    found = texts.select(F.col(text).cast("string").alias("body")).mapInArrow(run, "bucket int, n long")
    rows = found.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # n_buckets rows at most
    counts = np.zeros(n_buckets, np.int64)
    counts[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return counts


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the logarithm of a bucket's share of the target over its share of the source, one added to each bucket, rounded down."""
    n = len(source)
    s, t = source.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weigh_texts(docs: DataFrame, gains: np.ndarray, names: list[str], text: str = "text") -> DataFrame:
    """``docs`` with three longs under ``names``: words, features and the sum of the features' gains."""
    shared = docs.sparkSession.sparkContext.broadcast(np.append(gains, 0))  # the last stands for the bucket -1, no run
    n_buckets = len(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in text_slices(batches, column=text):
            n = len(batch)
            words, features, weight = (np.zeros(n, np.int64) for _ in range(3))
            for rows, buckets in text_buckets(batch.column(text), n_buckets):
                words += np.bincount(rows, minlength=n)
                low, most = int(rows[0]), int(rows[-1]) - int(rows[0]) + 1
                for b in buckets:
                    features += np.bincount(rows[b >= 0], minlength=n)
                    weight[low : low + most] += np.rint(np.bincount(rows - low, known[b], most)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x) for x in (words, features, weight))], [*batch.schema.names, *names])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *(StructField(n, LongType()) for n in names)]))


def noise(doc_id: Column, seed: int = 42) -> Column:
    """Gumbel noise of an id, in thousandths, rounded down."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    share = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296
    return F.floor(-1000 * F.log(-F.log(share))).cast("long")


def scored_texts(docs: DataFrame, target: DataFrame, seed: int = 42, n_buckets: int = N_BUCKETS, carry: list[str] | None = None) -> DataFrame:
    """The carried columns (all, unless named; ``doc_id`` is) of ``docs`` with ``n_words, n_features, weight, score``."""
    names = docs.columns if carry is None else carry
    added = free_names(docs.columns, ["n_words", "n_features", "weight", "score"])
    gains = bucket_gains(bucket_counts(docs, n_buckets=n_buckets), bucket_counts(target, n_buckets=n_buckets))
    needed = docs.select(*names, *([] if "text" in names else ["text"])).withColumn("text", F.col("text").cast("string"))
    found = weigh_texts(needed, gains, added[:3])
    return found.select(*names, *added[:3], (F.col(added[2]) + noise(F.col("doc_id"), seed)).alias(added[3]))


def _highest(scored: DataFrame, percent: int, least_words: int) -> tuple[DataFrame, int, int]:
    """Distinct digests that can be drawn, ``first`` (rows before them) and ``copies`` with each; how many rows are drawn; the cut of scores."""
    fit = scored.filter(F.col("n_words") >= least_words)
    cut, n = fit.agg(F.percentile_approx("score", F.lit(max(0.0, 1 - percent / 100 - _SLACK)), F.lit(_ACCURACY)), F.count(F.lit(1))).first()
    n_drawn = percent * n // 100
    if cut is None or fit.filter(F.col("score") >= cut).count() < n_drawn:
        cut = -(1 << 62)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), *(F.asc(c) for c in scored.columns if c not in ("score", "doc_id"))]
    top = fit.filter(F.col("score") >= cut).groupBy(*scored.columns).agg(F.count(F.lit(1)).alias("copies"))
    width = pieces(n_drawn * 64, 32 << 20, shuffle_width(scored.sparkSession))
    dealt = checkpointed(top.repartitionByRange(width, *order).withColumn("range", F.spark_partition_id()))
    ranges = dealt.groupBy("range").agg(F.sum("copies").alias("held"))
    before = F.coalesce(F.sum("held").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row a range
    earlier = F.coalesce(F.sum("copies").over(W.partitionBy("range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = dealt.withColumn("earlier", earlier).join(F.broadcast(ranges.select("range", before.alias("before"))), "range")
    return placed.select(*scored.columns, (F.col("before") + F.col("earlier")).alias("first"), "copies"), n_drawn, cut


def importance_ranks(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` for every row of ``docs``; the rank is null for what is not drawn."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = checkpointed(scored_texts(plain, target, seed, carry=["doc_id"]))
    top, n_drawn, cut = _highest(scored, percent, least_words)
    # Copies are laid out in two steps, so that no array grows with their number.
    lots = top.withColumn("lot", F.explode(F.expr(f"sequence(0L, (copies - 1) div {_COPIES})")))
    rows = lots.withColumn("copy", F.explode(F.expr(f"sequence(lot * {_COPIES}, least(copies, (lot + 1) * {_COPIES}) - 1)")))
    rank = F.col("first") + F.col("copy") + 1
    kept = ["doc_id", "n_features", "weight", "score"]
    ranked = rows.select(*kept, F.when(rank <= n_drawn, rank).alias("rank"))
    others = scored.filter((F.col("n_words") < least_words) | (F.col("score") < cut)).select(*kept, F.lit(None).cast("long").alias("rank"))
    return ranked.unionByName(others)


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """The drawn rows of ``docs``, whole, with ``n_words, n_features, weight, score``.

    Only the last drawn digest is looked up: what scores more is drawn, and of the rows that agree with it as many as there is room for.
    """
    names = ["n_words", "n_features", "weight", "score"]
    added = free_names(docs.columns, names)
    found = scored_texts(docs, target, seed)
    digests = checkpointed(found.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(a).alias(n) for a, n in zip(added, names))))
    top, n_drawn, _ = _highest(digests, percent, least_words)
    last = top.filter((F.col("first") < n_drawn) & (F.col("first") + F.col("copies") >= n_drawn)).first()
    fit = found.filter(F.col(added[0]) >= least_words)
    if last is None:
        return fit.limit(0)
    key, score = F.col("doc_id").cast("long"), F.col(added[3])
    # Places in the order of the draw: by score, then id (nulls last), then words, features and weight.
    ours = [-score, key.isNull().cast("int"), F.coalesce(key, F.lit(0)), *(F.col(a) for a in added[:3])]
    theirs = [-last["score"], int(last["doc_id"] is None), last["doc_id"] or 0, *(last[n] for n in names[:3])]
    mine, cut = F.struct(*(c.cast("long").alias(f"k{i}") for i, c in enumerate(ours))), F.struct(*(F.lit(v).cast("long").alias(f"k{i}") for i, v in enumerate(theirs)))
    return fit.filter(mine < cut).unionByName(fit.filter(mine == cut).limit(n_drawn - last["first"]))
