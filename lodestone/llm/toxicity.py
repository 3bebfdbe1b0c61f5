"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashed words, word pairs and pairs with one
or two words between.  Training keeps a step size of its own for every
coordinate, and its L1 term leaves most coordinates at exactly zero, so the
model is a short list of (coordinate, weight) that every task receives.

The classifier is fitted in one task on at most ``max_rows`` labelled documents with ``max_bytes`` of text (in the
order of a hash of their ids, each once), bounds that don't grow with the corpus; every document
is scored over its whole text.  The scorer sees the text alone.

Defined results: a null or empty text has no features and scores the bias; a
label row without a label, or of an unknown document, teaches nothing; of
repeated label rows the larger label counts; without any usable label every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lodestone.llm._spark import checkpointed
from lodestone.llm._words import PLAIN_LOWER, U64, mix, text_slices, utf8, word_hashes

BITS = 24
#: Bounds of what is learned from: labelled documents, and bytes of their texts.
MAX_ROWS, MAX_BYTES = 16_000, 64 << 20
#: Bytes of texts that are hashed at once.
SLICE_BYTES = 1 << 20
#: Multipliers of the first word of a pair, by the number of words between the two.
_GAPS = {1: 0x9E3779B97F4A7C15, 2: 0xC2B2AE3D27D4EB4F, 3: 0x165667B19E3779F9}


@dataclass(frozen=True)
class Settings:
    """Learning rate and its floor, L1 and L2 terms, passes over the sample."""

    alpha: float = 4.0
    beta: float = 1.0
    l1: float = 6.0
    l2: float = 0.0
    epochs: int = 5


def features(words: np.ndarray) -> np.ndarray:
    """Sorted distinct coordinates of one text's words, word pairs and skip-grams."""
    parts = [words]
    for gap, factor in _GAPS.items():
        if len(words) > gap:
            parts.append(mix(words[:-gap] * U64(factor) + words[gap:]))
    found = np.sort(np.concatenate(parts) >> U64(64 - BITS))
    return (found[np.concatenate(([True], found[1:] != found[:-1]))] if len(found) else found).astype(np.int32)


def _sigmoid(x: float) -> float:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


def fit(rows: list[tuple[np.ndarray, int]], settings: Settings) -> tuple[np.ndarray, np.ndarray, float]:
    """Coordinates and weights that aren't zero, and the bias."""
    z, n = np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.float32)
    a, b, l1, l2 = settings.alpha, settings.beta, settings.l1, settings.l2

    def weights(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zs) <= l1, 0.0, (np.sign(zs) * l1 - zs) / ((b + np.sqrt(ns)) / a + l2))

    bias_z = bias_n = bias = 0.0
    for _ in range(settings.epochs):
        for at, label in rows:
            zs, ns = z[at], n[at]
            w = weights(zs, ns)
            g = _sigmoid(w.sum() + bias) - label
            step = (np.sqrt(ns + g * g) - np.sqrt(ns)) / a
            z[at] = zs + g - step * w
            n[at] = ns + g * g
            bias_z += g - (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / a * bias
            bias_n += g * g
            bias = -bias_z / ((b + np.sqrt(bias_n)) / a)
    used = np.flatnonzero((z > l1) | (z < -l1))
    return used, weights(z[used], n[used]), float(bias)


def _fit_rows(settings: Settings, max_bytes: int):
    """Fits a model to the rows as they come, up to the first whose text would go beyond ``max_bytes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[np.ndarray, int]] = []
        left = max_bytes
        for batch in text_slices(batches, SLICE_BYTES):
            sizes = np.cumsum(np.diff(utf8(batch.column("text"))[1]))
            fits = int(np.searchsorted(sizes, left, side="right"))
            words, bounds = word_hashes(batch.column("text").slice(0, fits), PLAIN_LOWER)
            labels = batch.column("label").to_pylist()
            rows += [(features(words[i:j]).astype(np.int32), y) for i, j, y in zip(bounds[:-1], bounds[1:], labels)]
            if fits < len(sizes):
                break
            left -= int(sizes[-1])
        if rows:
            at, weights, bias = fit(rows, settings)
            yield pa.RecordBatch.from_pydict(
                {
                    "at": pa.array([at.astype(np.int64).tobytes()], pa.binary()),
                    "weights": pa.array([weights.astype(np.float64).tobytes()], pa.binary()),
                    "bias": pa.array([bias]),
                }
            )

    return run


class Model:
    """Sparse weights; on the workers also one byte a coordinate that says which are in use."""

    def __init__(self, at: np.ndarray, weights: np.ndarray, bias: float | None) -> None:
        self.at, self.weights, self.bias = at, weights, bias
        self._used: np.ndarray | None = None

    def __getstate__(self) -> tuple:
        return self.at, self.weights, self.bias

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def score(self, words: np.ndarray) -> float:
        if self.bias is None:
            return 0.0
        if self._used is None:
            self._used = np.zeros(1 << BITS, bool)
            self._used[self.at] = True
        parts = [words] + [mix(words[:-gap] * U64(factor) + words[gap:]) for gap, factor in _GAPS.items() if len(words) > gap]
        found = (np.concatenate(parts) >> U64(64 - BITS)).astype(np.int64)
        hits = np.unique(found[self._used[found]])
        return float(_sigmoid(self.weights[np.searchsorted(self.at, hits)].sum() + self.bias))


def learnable(doc_id: Column) -> Column:
    """Whether a document's label may be learned; the others are held out."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(5)) != 0


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES, settings: Settings = Settings()) -> Model:
    """A model of at most ``max_rows`` labelled documents with ``max_bytes`` of text, held-out ones excepted.

    Documents are taken in the order of their ids' hashes; of those that repeat an id the least text is taken.
    """
    order = F.xxhash64("id")
    taught = (
        labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("label"))
        .filter(F.col("id").isNotNull() & F.col("label").isNotNull() & learnable(F.col("id")))
        .groupBy("id")
        .agg(F.max("label").alias("label"))
        .orderBy(order, "id")
        .limit(max_rows)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    rows = (
        texts.join(F.broadcast(checkpointed(taught)), "id")  # max_rows ids and labels
        .groupBy("id", "label")
        .agg(F.min("text").alias("text"))
        .repartition(1)
        .sortWithinPartitions(order, "id")
        .select("text", "label")
    )
    found = rows.mapInArrow(_fit_rows(settings, max_bytes), "at binary, weights binary, bias double").collect()  # one row of at most 2 ** BITS weights
    if not found:
        return Model(np.zeros(0, np.int64), np.zeros(0), None)
    return Model(np.frombuffer(found[0]["at"], np.int64), np.frombuffer(found[0]["weights"], np.float64), found[0]["bias"])


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with a column ``toxicity_score`` (one of that name is replaced)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    plain = docs.select(*[c for c in docs.columns if c != "toxicity_score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in text_slices(batches, SLICE_BYTES):
            words, bounds = word_hashes(batch.column("text"), PLAIN_LOWER)
            scores = [known.score(words[i:j]) for i, j in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "toxicity_score"])

    return plain.mapInArrow(run, StructType([*plain.schema.fields, StructField("toxicity_score", DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **settings) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``."""
    model = train(docs, labels, **settings)
    score = F.col("toxicity_score")
    return score_texts(docs.select("doc_id", "text"), model).select(
        "doc_id", (~learnable(F.col("doc_id"))).alias("held_out"), score.alias("score"), (score >= threshold).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **settings) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with their columns."""
    model = train(docs, labels, **settings)
    plain = docs.toDF(*("text" if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)))
    kept = score_texts(plain, model).filter(F.col("toxicity_score") < threshold)
    return kept.drop("toxicity_score").toDF(*docs.columns)
