"""Removal of word passages that an earlier document already holds.

A window is ``window`` consecutive words of one document.  Every word goes that
lies in a window whose word sequence also starts in a document with a smaller
id.  Windows are judged on the input, never on what is left of it.

Method: difference-cover anchors.  Positions of a document whose remainder
modulo ``period`` is in a difference cover carry an anchor of
``window - period + 1`` words.  Any two equal windows share an anchor at
the same place within them (that is what the cover guarantees), so

1. blocks of documents send each bucket their distinct anchor hashes,
2. buckets answer with one bit an anchor: does another block hold it?
3. blocks extend the shared anchors to the whole windows around them, and send
   the distinct hashes of those with the smallest document of the block,
4. buckets answer with the windows that an earlier block's document holds,
5. blocks remove the words those windows cover.

An anchor's hash only proposes places.  A window is known by 128 bits, two independent hashes of its words, and
what is removed is decided on all of them.

Texts cross the network once: all three passes over them read one exchange.
A hash is sent once a block, however often it occurs, so that a passage that
a third of all documents share costs a bucket one entry a block.

Defined results: a null or blank text has no words; a null ``doc_id`` counts as
smaller than every other; rows with equal ids are not smaller than one another,
so neither removes from the other; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._spark import pieces, shuffle_width, text_bytes
from lodestone.llm._words import SPACED, U64, row_of, wide_hashes, window_hashes, windows_at, word_hashes

#: Difference covers: for any two remainders there is a shift that moves both into the cover.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9)}
#: Text a block holds: the first as long as blocks number no more than ``MANY_BLOCKS``, then up to the second.
BLOCK_BYTES, MOST_BLOCK_BYTES = 8 << 20, 64 << 20
MANY_BLOCKS = 32_768
_SMALLEST = np.iinfo(np.int64).min


def _period(window: int) -> int:
    """The longest period with a known cover that leaves anchors of at least half a window."""
    return max(p for p in COVERS if p == 1 or window - p + 1 >= max(2, window // 2))


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(_SMALLEST).to_numpy().astype(np.int64)


def _ordered(table: pa.Table) -> pa.Table:
    return table.take(pa.array(np.argsort(_ids(table["doc_id"]), kind="stable")))


def _bucket(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> U64(32)) * U64(n)) >> U64(32)


def _distinct(ordered: np.ndarray) -> np.ndarray:
    return ordered[np.concatenate(([True], ordered[1:] != ordered[:-1]))] if len(ordered) else ordered


def _repeated(ordered: np.ndarray) -> np.ndarray:
    """The values that a sorted array holds more than once."""
    return _distinct(ordered[1:][ordered[1:] == ordered[:-1]]) if len(ordered) else ordered


def _within(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _pair_starts(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Where the value changes in a row of 128-bit values."""
    return np.concatenate(([True], (one[1:] != one[:-1]) | (two[1:] != two[:-1]))) if len(one) else np.zeros(0, bool)


def _pairs_within(one: np.ndarray, two: np.ndarray, known_one: np.ndarray, known_two: np.ndarray) -> np.ndarray:
    """Which 128-bit values occur among the known ones, which are sorted by their first half."""
    found = np.zeros(len(one), bool)
    if not len(known_one):
        return found
    at = np.searchsorted(known_one, one)
    left = np.arange(len(one))
    while len(left):
        left = left[at[left] < len(known_one)]
        left = left[known_one[at[left]] == one[left]]
        same = known_two[at[left]] == two[left]
        found[left[same]] = True
        left = left[~same]
        at[left] += 1
    return found


class _Anchors:
    """Anchor positions of a block and their keys: the bucket above, 32 bits of the hash below."""

    def __init__(self, words: np.ndarray, bounds: np.ndarray, window: int, n_buckets: int) -> None:
        period = _period(window)
        size = window - period + 1
        n_words = np.diff(bounds)
        inside = np.arange(len(words)) - np.repeat(bounds[:-1], n_words)
        left = np.repeat(n_words, n_words) - inside
        covered = np.zeros(period, bool)
        covered[list(COVERS[period])] = True
        long_enough = np.repeat(n_words >= window, n_words)
        self.at = np.flatnonzero(covered[inside % period] & (left >= size) & long_enough)
        hashes = windows_at(words, self.at, size)
        self.keys = (_bucket(hashes, n_buckets) << U64(32)) | (hashes & U64(0xFFFFFFFF))
        self.reach = period - 1
        self.long_enough, self.left, self.inside = long_enough, left, inside

    def candidates(self, shared: np.ndarray, window: int) -> np.ndarray:
        """Starts of the windows that hold a shared anchor."""
        hits = self.at[shared]
        cover = np.zeros(len(self.left) + 1, np.int32)
        np.add.at(cover, np.maximum(hits - self.reach, hits - self.inside[hits]), 1)
        np.add.at(cover, hits + 1, -1)
        return np.flatnonzero((np.cumsum(cover[:-1]) > 0) & (self.left >= window))


def _slices(keys: np.ndarray, shift: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of sorted keys whose bits from ``shift`` up are the bucket."""
    buckets = (keys >> U64(shift)).astype(np.int64)
    cuts = np.flatnonzero(np.concatenate(([True], buckets[1:] != buckets[:-1]))) if len(keys) else np.zeros(0, np.int64)
    ends = np.append(cuts[1:], len(keys))
    return [(int(buckets[a]), int(a), int(b)) for a, b in zip(cuts, ends)]


def _block_of(table: pa.Table) -> int:
    return table["block"][0].as_py()


def _send_anchors(window: int, n_buckets: int):
    def send(table: pa.Table) -> pa.Table:
        words, bounds = word_hashes(table["text"], SPACED)
        keys = _distinct(np.sort(_Anchors(words, bounds, window, n_buckets).keys))
        cuts = _slices(keys, 32)
        low = keys.astype(np.uint32)
        return pa.table(
            {
                "bucket": pa.array([b for b, _, _ in cuts], pa.int32()),
                "block": pa.array([_block_of(table)] * len(cuts), pa.int32()),
                "entries": pa.array([low[i:j].tobytes() for _, i, j in cuts], pa.binary()),
            }
        )

    return send


def _answer_anchors(table: pa.Table) -> pa.Table:
    """For each block of the bucket one bit an entry: does another block hold it too?"""
    blobs = [np.frombuffer(x.as_buffer(), np.uint32) for x in table["entries"]]
    shared = _repeated(np.sort(np.concatenate(blobs)))
    return pa.table(
        {
            "block": table["block"],
            "bucket": table["bucket"],
            "entries": pa.array([np.packbits(_within(x, shared)).tobytes() for x in blobs], pa.binary()),
        }
    )


def _send_windows(window: int, n_buckets: int):
    def send(_key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        out: dict[str, list] = {"bucket": [], "block": [], "entries": [], "checks": [], "smallest": []}
        if docs.num_rows:
            docs = _ordered(docs)
            ids = _ids(docs["doc_id"])
            words, seconds, bounds = wide_hashes(docs["text"], SPACED)
            anchors = _Anchors(words, bounds, window, n_buckets)
            ordered = np.sort(anchors.keys)
            keys = _distinct(ordered)
            elsewhere = np.zeros(len(keys), bool)
            replies = dict(zip(answers["bucket"].to_pylist(), answers["entries"].to_pylist()))
            for bucket, i, j in _slices(keys, 32):
                elsewhere[i:j] = np.unpackbits(np.frombuffer(replies[bucket], np.uint8), count=j - i).astype(bool)
            shared = np.sort(np.concatenate((keys[elsewhere], _repeated(ordered))))
            starts = anchors.candidates(_within(anchors.keys, shared), window)
            one, two = windows_at(words, starts, window), windows_at(seconds, starts, window)
            order = np.lexsort((two, one))  # of equal windows, that of the smallest document comes first
            one, two = one[order], two[order]
            first = _pair_starts(one, two)
            owner = ids[row_of(bounds)[starts[order[first]]]]
            one, two = one[first], two[first]
            buckets = _bucket(one, n_buckets).astype(np.int64)
            edges = np.flatnonzero(np.concatenate(([True], buckets[1:] != buckets[:-1]))) if len(buckets) else []
            for i, j in zip(edges, [*edges[1:], len(buckets)]):
                out["bucket"].append(int(buckets[i]))
                out["block"].append(_block_of(docs))
                out["entries"].append(one[i:j].tobytes())
                out["checks"].append(two[i:j].tobytes())
                out["smallest"].append(owner[i:j].tobytes())
        kinds = {"bucket": pa.int32(), "block": pa.int32()}
        return pa.table({k: pa.array(v, kinds.get(k, pa.binary())) for k, v in out.items()})

    return send


def _answer_windows(table: pa.Table) -> pa.Table:
    """For each block the windows that a document smaller than all of the block's own holds."""
    read = lambda name, kind: [np.frombuffer(x.as_buffer(), kind) for x in table[name]]
    firsts, seconds, owners = read("entries", U64), read("checks", U64), read("smallest", np.int64)
    one, two, owner = (np.concatenate(x) for x in (firsts, seconds, owners))
    row = np.repeat(np.arange(table.num_rows), [len(x) for x in firsts])
    again = np.flatnonzero(_within(one, _repeated(np.sort(one))))
    order = again[np.lexsort((owner[again], two[again], one[again]))]
    first = _pair_starts(one[order], two[order])
    least = owner[order[first]][np.cumsum(first) - 1] if len(order) else np.zeros(0, np.int64)
    late = order[owner[order] > least]
    late = late[np.argsort(row[late], kind="stable")]
    cuts = np.searchsorted(row[late], np.arange(table.num_rows + 1))
    sent = lambda values: pa.array([values[late[i:j]].tobytes() for i, j in zip(cuts[:-1], cuts[1:])], pa.binary())
    return pa.table({"block": table["block"], "bucket": table["bucket"], "entries": sent(one), "checks": sent(two)})


def removed_words(ids: np.ndarray, words: tuple[np.ndarray, np.ndarray], bounds: np.ndarray, elsewhere: tuple[np.ndarray, np.ndarray], window: int) -> np.ndarray:
    """Which words of a block go; rows come in the order of their ids, and ``elsewhere`` in that of its first half."""
    n = len(words[0])
    cover = np.zeros(n + 1, np.int32)
    one = window_hashes(words[0], window)
    if len(one):
        n_words = np.diff(bounds)
        left = np.repeat(bounds[1:], n_words) - np.arange(n)
        starts = np.flatnonzero(left[: len(one)] >= window)
        one = one[starts]
        here = _within(one, _repeated(np.sort(one)))
        near = np.flatnonzero(here | _within(one, elsewhere[0]))
        starts, one, here = starts[near], one[near], here[near]
        two = windows_at(words[1], starts, window)
        gone = _pairs_within(one, two, *elsewhere)
        again = np.flatnonzero(here)
        order = again[np.lexsort((two[again], one[again]))]
        if len(order):
            owner = ids[row_of(bounds)[starts[order]]]
            first = _pair_starts(one[order], two[order])
            least = owner[np.flatnonzero(first)][np.cumsum(first) - 1]
            gone[order[owner > least]] = True
        np.add.at(cover, starts[gone], 1)
        np.add.at(cover, starts[gone] + window, -1)
    return np.cumsum(cover[:-1]) > 0


def _finish(window: int):
    def finish(_key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        docs = _ordered(docs)
        ids = _ids(docs["doc_id"])
        *words, bounds = wide_hashes(docs["text"], SPACED)
        read = lambda name: np.concatenate([np.zeros(0, U64), *(np.frombuffer(x.as_buffer(), U64) for x in answers[name])])
        one, two = read("entries"), read("checks")
        order = np.argsort(one, kind="stable")
        gone = removed_words(ids, words, bounds, (one[order], two[order]), window)
        total = np.concatenate(([0], np.cumsum(gone)))
        n_removed = total[bounds[1:]] - total[bounds[:-1]]
        kept = []
        for row, text in enumerate(docs["text"]):
            parts = (text.as_py() or "").encode().split()
            if n_removed[row]:
                keep = ~gone[bounds[row] : bounds[row + 1]]
                parts = [parts[i] for i in np.flatnonzero(keep)]
            kept.append(b" ".join(parts))
        return pa.table(
            {
                "doc_id": docs["doc_id"],
                "n_words": pa.array(np.diff(bounds), pa.int64()),
                "n_removed": pa.array(n_removed, pa.int64()),
                "kept": pa.array(kept, pa.binary()),
            }
        )

    return finish


def _digest(finish):
    def digest(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        out = finish(key, docs, answers)
        sums = [hashlib.sha256(x.as_buffer()).hexdigest() for x in out["kept"]]
        return out.drop_columns("kept").append_column("kept_sha256", pa.array(sums, pa.string()))

    return digest


def _kept_text(finish):
    def kept_text(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        out = finish(key, docs, answers)
        return out.drop_columns("kept").append_column("kept_text", out["kept"].cast(pa.string()))

    return kept_text


def remove_repeats(docs: DataFrame, window: int = 13, block_bytes: int = BLOCK_BYTES, texts: bool = True) -> DataFrame:
    """``doc_id, n_words, n_removed`` and the kept words, joined by one space: ``kept_text``, or ``kept_sha256`` if not ``texts``.

    ``block_bytes`` bounds what a task holds of the texts at once; blocks and buckets grow in number with the input.  A
    block sends each bucket one row, so buckets are fewer than blocks (anchors and windows are a fraction of the texts), and on very
    large inputs blocks are larger; a partition then holds several, one after another.
    """
    spark = docs.sparkSession
    _, n_bytes = text_bytes(docs)
    width = shuffle_width(spark)
    each = max(block_bytes, min(MOST_BLOCK_BYTES, n_bytes // MANY_BLOCKS))
    n_blocks = pieces(n_bytes, each, width)
    n_buckets = max(width, n_blocks // 4)
    blocks = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).cast("int"))  # by both: an id may repeat
        .repartition(min(n_blocks, max(width, MANY_BLOCKS)), "block")
    )
    anchors = blocks.groupBy("block").applyInArrow(_send_anchors(window, n_buckets), "bucket int, block int, entries binary")
    answers = anchors.groupBy("bucket").applyInArrow(_answer_anchors, "block int, bucket int, entries binary")
    windows = (
        blocks.groupBy("block")
        .cogroup(answers.groupBy("block"))
        .applyInArrow(_send_windows(window, n_buckets), "bucket int, block int, entries binary, checks binary, smallest binary")
    )
    earlier = windows.groupBy("bucket").applyInArrow(_answer_windows, "block int, bucket int, entries binary, checks binary")
    finish = _finish(window)
    kept, name = (_kept_text(finish), "kept_text") if texts else (_digest(finish), "kept_sha256")
    return (
        blocks.groupBy("block")
        .cogroup(earlier.groupBy("block"))
        .applyInArrow(kept, f"doc_id long, n_words long, n_removed long, {name} string")
    )
