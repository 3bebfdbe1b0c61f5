"""Vectorised word splitting and hashing over Arrow string columns.

A whole batch of documents is handled as one byte array: a table folds each
byte, another says which bytes belong to words, and a word's bytes are taken eight at
a time and mixed in by bijections, for all words at once.  Words longer than that pays
for get a BLAKE2 digest.  A word has two independent 64-bit hashes: the first does
for candidates, and both together where equality is decided.  Words never cross document borders.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_CHUNK = 1 << 20
#: Words of up to this many bytes are hashed in lanes of eight, longer ones one by one.
_LANED = 32
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=U64)


@dataclass(frozen=True)
class WordClass:
    """Which bytes form words, after folding."""

    fold: np.ndarray
    member: np.ndarray


def _word_class(lower: bool, letters_only: bool) -> WordClass:
    fold = np.arange(256, dtype=np.uint8)
    if lower:
        fold[65:91] += 32
    code = np.arange(256)
    if letters_only:
        member = (code >= 0x80) | ((code >= 0x30) & (code <= 0x39)) | ((code >= 0x61) & (code <= 0x7A))
    else:
        member = ~((code == 0x20) | ((code >= 0x09) & (code <= 0x0D)))
    return WordClass(fold, member)


#: Words between ASCII white space, as they are.
SPACED = _word_class(False, False)
#: Words between ASCII white space, A-Z lower-cased.
SPACED_LOWER = _word_class(True, False)
#: Runs of a-z, 0-9 and non-ASCII characters, A-Z lower-cased.
PLAIN_LOWER = _word_class(True, True)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that all bits of a hash depend on all bits before it."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    bounds = np.frombuffer(offsets, np.int64, n + 1 + column.offset)[column.offset :]
    first, last = int(bounds[0]), int(bounds[-1])
    raw = np.frombuffer(data, np.uint8, last - first, first) if last > first else np.zeros(0, np.uint8)
    return raw, bounds - first


def text_slices(batches: Iterator[pa.RecordBatch], limit: int = 8 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts of each have about ``limit`` bytes at most; a longer text is a batch of its own."""
    for batch in batches:
        _, bounds = utf8(batch.column(column))
        row = 0
        while row < len(batch):
            stop = max(row + 1, int(np.searchsorted(bounds, bounds[row] + limit, side="right")) - 1)
            yield batch.slice(row, stop - row)
            row = stop


def split_words(raw: np.ndarray, bounds: np.ndarray, kind: WordClass) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts and ends (byte offsets), and the folded bytes they stand in."""
    folded = kind.fold[raw]
    member = kind.member[folded]
    n = len(raw)
    before, after = np.empty(n, bool), np.empty(n, bool)
    if n:
        before[0], before[1:] = False, member[:-1]
        after[-1], after[:-1] = False, member[1:]
        cuts = bounds[(bounds > 0) & (bounds < n)]
        before[cuts] = False
        after[cuts - 1] = False
    return np.flatnonzero(member & ~before), np.flatnonzero(member & ~after) + 1, folded


def _hashed(folded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each word."""
    sizes = ends - starts
    padded = np.concatenate((folded, np.zeros(8, np.uint8)))
    lanes = np.ndarray((len(folded) + 1,), "<u8", padded, strides=(1,))
    one = mix(sizes.astype(U64) * U64(0x9E3779B97F4A7C15))
    two = mix(sizes.astype(U64) * U64(0xD6E8FEB86659FD93) + U64(1))
    at = np.flatnonzero(sizes <= _LANED)
    for offset in range(0, _LANED, 8):
        at = at[sizes[at] > offset]
        if not len(at):
            break
        lane = lanes[starts[at] + offset] & _MASKS[np.minimum(sizes[at] - offset, 8)]
        one[at] = mix(one[at] ^ lane)
        two[at] = mix((two[at] + U64(0xA0761D6478BD642F)) * U64(0xE7037ED1A0B428DB) + lane)
    for i in np.flatnonzero(sizes > _LANED):
        one[i], two[i] = np.frombuffer(hashlib.blake2b(folded[starts[i] : ends[i]].tobytes(), digest_size=16).digest(), U64)
    return one, two


def wide_hashes(column: pa.Array | pa.ChunkedArray, kind: WordClass) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both hashes of all words of all rows, and the offsets of each row's words."""
    raw, bounds = utf8(column)
    parts, counts, row, n = [], [], 0, len(bounds) - 1
    while row < n:
        stop = max(row + 1, int(np.searchsorted(bounds, bounds[row] + _CHUNK, side="right")) - 1)
        local = bounds[row : stop + 1] - bounds[row]
        starts, ends, folded = split_words(raw[bounds[row] : bounds[stop]], local, kind)
        parts.append(_hashed(folded, starts, ends))
        counts.append(np.diff(np.searchsorted(starts, local)))
        row = stop
    one, two = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, U64), np.zeros(0, U64))
    at = np.zeros(n + 1, np.int64)
    if counts:
        np.cumsum(np.concatenate(counts), out=at[1:])
    return one, two, at


def word_hashes(column: pa.Array | pa.ChunkedArray, kind: WordClass) -> tuple[np.ndarray, np.ndarray]:
    """The first hash of all words of all rows, and the offsets of each row's words."""
    one, _, at = wide_hashes(column, kind)
    return one, at


def _weights(k: int) -> np.ndarray:
    return mix(np.arange(1, k + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words that start at each position (``len(words) - k + 1`` of them)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out, weights = np.zeros(n, U64), _weights(k)
    for j in range(k):
        out += words[j : j + n] * weights[j]
    return mix(out + U64(k))


def windows_at(words: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """As ``window_hashes``, at the given starts only."""
    out, weights = np.zeros(len(starts), U64), _weights(k)
    for j in range(k):
        out += words[starts + j] * weights[j]
    return mix(out + U64(k))


def row_of(bounds: np.ndarray) -> np.ndarray:
    """For each item the row that holds it."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
