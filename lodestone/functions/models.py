"""Model interfaces, and stand-ins for them that need no weights.

``HashingEmbedder`` and ``ExtractiveModel`` are deterministic stand-ins for tests and offline
use; they do not equal any trained model.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import embed_input


@dataclass(frozen=True)
class ModelInfo:
    model_id: str
    model_engine: str
    description: str
    context_length: int


class Embedder(Protocol):
    dimension: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class LanguageModel(Protocol):
    info: ModelInfo

    def generate(self, prompt: str, max_tokens: int = 512, temperature: float = 0.7, top_p: float = 0.9, repeat_penalty: float = 1.0) -> str: ...


@dataclass(frozen=True)
class HashingEmbedder:
    """Signed hashing of lower-cased words, scaled to length 1."""

    dimension: int = 64
    truncate_dim: int | None = None

    def embed(self, texts: list[str]) -> np.ndarray:
        words = [(text or "").lower().split() for text in texts]
        held = list(dict.fromkeys(w for found in words for w in found))
        code = np.fromiter((zlib.crc32(w.encode()) for w in held), np.int64, len(held))
        place = dict(zip(held, range(len(held))))
        each = code[np.fromiter((place[w] for found in words for w in found), np.int64)]
        cell = np.repeat(np.arange(len(words)), [len(found) for found in words]) * self.dimension + each % self.dimension
        out = np.bincount(cell, np.where(each >> 31, 1.0, -1.0), len(words) * self.dimension).reshape(-1, self.dimension).astype(np.float32)
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norms, out=out, where=norms > 0)


@dataclass(frozen=True)
class ExtractiveModel:
    """Answers with the first sentences of the prompt's context."""

    info: ModelInfo = ModelInfo("extractive-stand-in", "none", "returns the start of its context", 128_000)

    def generate(self, prompt: str, max_tokens: int = 512, temperature: float = 0.7, top_p: float = 0.9, repeat_penalty: float = 1.0) -> str:
        context = prompt.partition("### Context\n")[2].partition("\n### User Question")[0]
        return " ".join(context.split()[: min(max_tokens, 60)])


def embedding_dimension(embedder: Embedder) -> int:
    """Of the vectors that are kept: ``truncate_dim`` wins, then what the embedder states, else what it makes of a probe."""
    for name in ("truncate_dim", "dimension"):
        size = getattr(embedder, name, None)
        if size:
            return int(size)
    return int(np.asarray(embedder.embed(["probe"])).shape[1])


def truncated(embedding: Column, dimension: int) -> Column:
    return F.slice(embedding, 1, dimension)


def embedded(text: Column, embedder: Embedder, batch: int = 16) -> Column:
    """``array<float>`` of each text; the embedder is loaded once a worker and sees ``batch`` texts at a time, in order."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            held = texts.fillna("").tolist()
            rows = [r for i in range(0, len(held), batch) for r in embedder.embed(held[i : i + batch])]
            yield pd.Series(rows, index=texts.index, dtype=object)

    return truncated(embed(embed_input(text)), embedding_dimension(embedder))


def generated(prompt: Column, model: LanguageModel, max_tokens: int = 512) -> Column:
    """``struct<response, error>``: a failing prompt reports its error and doesn't fail the others."""

    @F.pandas_udf("response string, error string")
    def generate(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for prompts in batches:
            rows = []
            for p in prompts:
                if p is None:  # not asked
                    rows.append((None, None))
                    continue
                try:
                    rows.append((model.generate(p, max_tokens=max_tokens), None))
                except Exception as error:  # any model's errors are answers here
                    rows.append((f"LLM Error: {error}", str(error)))
            yield pd.DataFrame(rows, columns=["response", "error"])

    return generate(prompt)
