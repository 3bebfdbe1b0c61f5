"""Jaccard self-join of documents on their word n-grams, with adaptive multi-match prefixes.

A document's set holds its distinct ``n``-word shingles.  Two documents link
when ``100 * intersection >= percent * union``; the result names each document's
connected component.

1. *Digests.*  One pass gives each text its set size and a 128-bit digest of
   its word sequence (equal sequences are one class from here on), and counts the
   shingles that several texts of a batch hold.  The most frequent ones of the corpus, with these
   counts, go to all workers.
2. *Prefixes.*  All tokens have one global order: tokens without a count by hash,
   then those with one by it.  A set of ``n`` tokens that must share ``t`` of them with
   any partner sends its first ``n - t + l`` tokens, and partners whose
   leads are ``l`` and ``m`` must have ``min(l, m)`` of those in common.  Each set's lead is
   chosen for it: from the counts of its tokens follows, for every lead, how many tokens its
   prefix is matched with and how many candidates can be left to verify, and the cheapest lead is taken (``leads``),
   but none under a tenth of the set (``guarded``).
   A set of rare tokens sends a short prefix, one whose tokens many texts hold a longer one
   that asks more of its candidates.
3. *Runs.*  Tokens of up to ``run`` documents count their pairs.  Dearer tokens
   count none: they only tell each document how many of its prefix tokens are
   dear, and lower by that what its pairs must show.  A document that holds as many dear
   tokens as its lead gets an edge to each of those instead of pairs, and so do
   the documents that could be its partners through them.
4. *Candidate groups.*  The components of those edges.  Every candidate's whole
   set travels once, to its group's task, where exact intersections are
   counted.  Texts of groups beyond ``group_tokens`` or ``group_rows`` first go through steps 2 and 3 among themselves, again while that
   helps, with the counts of tokens among them: passages that many of them share then come last in the order, and groups that only such passages held together fall apart.
   What stays large are mostly copies of one text: a few pivots are held against all of a group, and then what they left unconnected, block by block.
   A block has half of ``group_tokens`` or ``block_rows`` sets at most.

Nothing is dropped: counts change the order, the leads and the route, not the result.
Only broadcast: the counted tokens, at most ``max_frequent``, and the candidates'
ids where they number at most ``max_broadcast_rows``; beyond that they are joined.

Defined results: a null or blank text has an empty set and links with nothing; a
text of fewer words than ``n`` has one shingle, its whole sequence; rows without an id link
with nothing and get a null component; of a repeated id every text takes part, and its rows get
the smallest component that any of them reaches.  Equality of texts is decided by 128 bits.  Shingles are compared as 64-bit
hashes of both hashes of their words, under a key drawn for each run: no text can be made so that its shingles agree with another's.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._spark import checkpointed, free_names, pieces
from lodestone.llm._words import SPACED_LOWER, U64, WordClass, mix, text_slices, wide_hashes, window_hashes
from lodestone.llm.components import connected_components

RUN = 32
#: As ``RUN``, for shingles: a row of a pair is as dear as that of a dear token, and a run of r tokens has r (r - 1) / 2 pairs.
SHINGLE_RUN = 16
GROUP_TOKENS, GROUP_ROWS = 4_000_000, 250
#: Sets of a block: each goes to as many tasks as there are blocks to hold it against, so small blocks multiply what is sent.
BLOCK_ROWS = 4096
MAX_FREQUENT = 200_000
#: How often a batch must hold a token for it to be counted.
REPEATED = 4
#: Prefix tokens a bucket holds: the first as long as buckets number no more than ``MANY_BUCKETS``, then up to the second.
#: A task works through its bucket by slices of ``SLICE_TOKENS``, and a pair is one row of a bucket, whatever the number of its common tokens there.
BUCKET_BYTES, MOST_BUCKET_BYTES, MANY_BUCKETS = 32 << 20, 128 << 20, 32_768
SLICE_TOKENS = 1 << 20
#: Tokens of large groups that one task counts.
COUNTED_BYTES = 32 << 20
MAX_BROADCAST_ROWS = 500_000
_PIVOTS = 16
_BLOCK_PIVOTS = 8


def shingle_sets(words: np.ndarray, bounds: np.ndarray, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    hashes = window_hashes(words, n)
    out = []
    for i, j in zip(bounds[:-1], bounds[1:]):
        if j - i >= n:
            ordered = np.sort(hashes[i : j - n + 1])
            out.append(ordered[np.concatenate(([True], ordered[1:] != ordered[:-1]))])
        else:
            out.append(window_hashes(words[i:j], int(j - i)) if j > i else np.zeros(0, U64))
    return out


def _digest(one: np.ndarray, two: np.ndarray) -> tuple[int, int]:
    """A 128-bit digest of a word sequence, from both hashes of its words, as two signed longs."""
    raw = hashlib.blake2b(one.tobytes() + two.tobytes(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def keyed(one: np.ndarray, two: np.ndarray, key: tuple[int, int]) -> np.ndarray:
    """64 bits of both hashes of each word under a secret key: which words agree in them can't be known beforehand.

    Words that differ in one hash only never agree.
    """
    return mix(one ^ U64(key[0])) + mix(two ^ U64(key[1])) * U64(0x9E3779B97F4A7C15)


def shingle_builder(n: int, kind: WordClass = SPACED_LOWER, key: tuple[int, int] | None = None):
    """A function from a text column to each row's set and the digest of its word sequence; shingles are hashed under ``key``, by default one drawn here."""
    key = key or (secrets.randbits(64), secrets.randbits(64))

    def build(column: pa.Array) -> tuple[list[np.ndarray], list[tuple]]:
        words, seconds, bounds = wide_hashes(column, kind)
        keys = [_digest(words[i:j], seconds[i:j]) if j > i else (None, None) for i, j in zip(bounds[:-1], bounds[1:])]
        return shingle_sets(keyed(words, seconds, key), bounds, n), keys

    return build


def least_overlap(size: int, percent: int) -> int:
    """The least intersection of a set of this size with any partner."""
    return (percent * size + 99) // 100


@dataclass(frozen=True)
class CostModel:
    """What decides a lead, in units of one prefix token sent and matched.

    ``rare``: texts besides itself that hold a token without a count, on average.  ``verify``: cost of one token of a
    candidate's set.  ``least``, ``most``: the shortest and the longest lead, as shares of the set.
    """

    rare: float = 0.02
    verify: float = 0.1
    least: float = 0.1
    most: float = 0.4


def leads(counts: np.ndarray, percent: int, model: CostModel, run: int) -> tuple[int, float]:
    """The cheapest lead of a set and its estimated cost, from the counts of its tokens in the global order (0: none known).

    A prefix of ``w`` tokens is sent and matched with all their holders (dear tokens, of more than ``run``, match with none).
    Of those, at most a share of one in ``lead`` can show ``lead`` tokens and is verified, whole sets of about this size.
    """
    size = len(counts)
    base = size - least_overlap(size, percent)
    most = max(1, min(size - base, int(np.ceil(model.most * size))))
    others = np.where(counts > run, 0.0, np.where(counts > 1, counts - 1.0, model.rare))
    held = np.cumsum(others)[base : base + most]
    lead = np.arange(1, most + 1)
    cost = base + lead + held + model.verify * size * held / lead
    best = int(np.argmin(cost))
    return best + 1, float(cost[best])


def guarded(lead: int, size: int, percent: int, model: CostModel) -> int:
    """A lead of at least the share ``least`` of the set.

    Tokens without a count may be dear after all, and dear ones cost nothing in ``leads``.  A set with a short lead holds as
    many dear tokens as that soon, and then all holders of any of them are its candidates.
    """
    return max(lead, min(least_overlap(size, percent), int(np.ceil(model.least * size))))


def _runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of each run of equal values."""
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(ordered)))


def _digests(build):
    """Rows of documents (token null) and of tokens that several classes of a batch hold (token set, size its count)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            sets, keys = build(batch.column("text"))
            rows = len(sets)
            classes = list({k: s for k, s in zip(keys, sets)}.values())
            tokens = np.sort(np.concatenate(classes)) if classes else np.zeros(0, U64)
            first, length = _runs(tokens)
            repeated = length >= REPEATED
            found = tokens[first[repeated]].view(np.int64)
            none = [None] * len(found)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.concat_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(none, pa.int64())]),
                    "k1": pa.array([k[0] for k in keys] + none, pa.int64()),
                    "k2": pa.array([k[1] for k in keys] + none, pa.int64()),
                    "size": pa.array(np.concatenate(([len(s) for s in sets], length[repeated])).astype(np.int64)),
                    "token": pa.concat_arrays([pa.nulls(rows, pa.int64()), pa.array(found, pa.int64())]),
                }
            )

    return run


def _bucket(tokens: np.ndarray, n: int) -> np.ndarray:
    return (((tokens & U64(0xFFFFFFFF)) * U64(n)) >> U64(32)).astype(np.int64)


def _counts_of(tokens: np.ndarray, known: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The known count of each token, else 0."""
    if not len(known):
        return np.zeros(len(tokens), np.int64)
    at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
    return np.where(known[at] == tokens, counts[at], 0)


def band_limits(percent: int, longest: int = 1 << 40) -> np.ndarray:
    """Where bands of set sizes start: partners of a set in one band lie in it or the next."""
    starts = [1]
    while starts[-1] < longest:
        starts.append(starts[-1] * 100 // percent + 1)
    return np.array(starts, np.int64)


def banded(tokens: np.ndarray, size: int, percent: int, limits: np.ndarray) -> np.ndarray:
    """A set's tokens as they stand in its own band of sizes and, if it can have partners there, in the next."""
    band = int(np.searchsorted(limits, size, side="right")) - 1
    bands = [band, band + 1] if size * 100 // percent >= limits[band + 1] else [band]
    return np.concatenate([mix(tokens + U64((b + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) for b in bands])


def _prefixes(build, percent: int, model: CostModel, run_limit: int, n_buckets: int, by_size: bool, frequent):
    """Each batch's prefix tokens, one row a bucket: the tokens' upper halves, and of each set the node, size, lead and count."""
    limits = band_limits(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = (np.frombuffer(x, k) for x, k in zip(frequent.value, (U64, np.int64)))
        for batch in text_slices(batches):
            sets, keys = build(batch.column("text"))
            valid = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            seen: set[tuple] = set()
            nodes, sizes, lead, picked = [], [], [], []
            for row, tokens in enumerate(sets):
                if not len(tokens) or not valid[row] or keys[row] in seen:
                    continue
                seen.add(keys[row])
                held = _counts_of(tokens, known, counts)
                if held.any():
                    order = np.argsort(held, kind="stable")
                    tokens, held = tokens[order], held[order]
                size = len(tokens)
                own = guarded(leads(held, percent, model, run_limit)[0], size, percent, model)
                nodes.append(keys[row][0])
                sizes.append(size)
                lead.append(own)
                tokens = tokens[: size - least_overlap(size, percent) + own]
                picked.append(banded(tokens, size, percent, limits) if by_size else tokens)
            if not nodes:
                continue
            tokens = np.concatenate(picked)
            owner = np.repeat(np.arange(len(nodes)), [len(x) for x in picked])
            bucket = _bucket(tokens, n_buckets)
            order = np.argsort(bucket, kind="stable")
            tokens, owner, bucket = (tokens[order] >> U64(32)).astype(np.uint32), owner[order], bucket[order]
            node_of, size_of, lead_of = np.array(nodes, np.int64), np.array(sizes, np.int32), np.array(lead, np.int32)
            out: dict[str, list] = {"bucket": [], "tokens": [], "nodes": [], "sizes": [], "leads": [], "counts": []}
            for i, m in zip(*_runs(bucket)):
                own = owner[i : i + m]
                first, length = _runs(own)
                out["bucket"].append(int(bucket[i]))
                out["tokens"].append(tokens[i : i + m].tobytes())
                out["nodes"].append(node_of[own[first]].tobytes())
                out["sizes"].append(size_of[own[first]].tobytes())
                out["leads"].append(lead_of[own[first]].tobytes())
                out["counts"].append(length.astype(np.int32).tobytes())
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int32() if k == "bucket" else pa.binary()) for k, v in out.items()})

    return run


def _joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in column])


def _once(tokens: np.ndarray, nodes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Which records of a bucket stay: a class sends the same tokens from every batch that holds it.

    Records are compared by node and tokens, so that two classes of one node both stay.
    """
    starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
    mark = np.add.reduceat(mix(tokens.astype(U64) + U64(1)), starts) if len(counts) else np.zeros(0, U64)
    order = np.lexsort((mark, nodes))
    same = np.zeros(len(nodes), bool)
    same[1:] = (nodes[order][1:] == nodes[order][:-1]) & (mark[order][1:] == mark[order][:-1])
    keep = np.ones(len(nodes), bool)
    keep[order[same]] = False
    return keep


def _merged(a: np.ndarray, b: np.ndarray, least: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, ...]:
    """One record a pair: the lesser lead and the sum of what is common."""
    order = np.lexsort((b, a))
    a, b, least, common = a[order], b[order], least[order], common[order]
    at = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))) if len(a) else np.zeros(0, np.int64)
    return a[at], b[at], np.minimum.reduceat(least, at) if len(at) else least, np.add.reduceat(common, at) if len(at) else common


def _slice_pairs(tokens: np.ndarray, node: np.ndarray, size: np.ndarray, lead: np.ndarray, percent: int, limit: int) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """Pairs with their lesser lead and common tokens from the short runs of some tokens; tokens, nodes and leads of the long ones."""
    ordered = np.sort(tokens)
    first, length = _runs(ordered)
    repeated = ordered[first[length > 1]]
    if len(repeated):
        again = repeated[np.minimum(np.searchsorted(repeated, tokens), len(repeated) - 1)] == tokens
        tokens, node, size, lead = tokens[again], node[again], size[again], lead[again]
    else:
        tokens, node, size, lead = tokens[:0], node[:0], size[:0], lead[:0]
    order = np.lexsort((node, size, tokens))
    tokens, node, size, lead = tokens[order], node[order], size[order].astype(np.int64), lead[order].astype(np.int64)
    first, length = _runs(tokens)
    long = np.repeat(length > limit, length)
    few_t, few_n, few_s, few_l = tokens[~long], node[~long], size[~long], lead[~long]
    a, b, least = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for step in range(1, min(limit, int(length.max(initial=0)), len(few_t))):
        hit = (few_t[step:] == few_t[:-step]) & (100 * few_s[:-step] >= percent * few_s[step:]) & (few_n[step:] != few_n[:-step])
        i = np.flatnonzero(hit)
        a.append(np.minimum(few_n[i], few_n[i + step]))
        b.append(np.maximum(few_n[i], few_n[i + step]))
        least.append(np.minimum(few_l[i], few_l[i + step]))
    a, b, least = (np.concatenate(x) for x in (a, b, least))
    return _merged(a, b, least, np.ones(len(a), np.int64)), (tokens[long], node[long], lead[long])


def _count_runs(percent: int, limit: int):
    """Pairs, their common tokens and lesser lead, of the short runs; of the long ones (node, token) rows with a null ``common``."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        tokens = _joined(table["tokens"], np.uint32)
        counts = _joined(table["counts"], np.int32)
        per_node = [_joined(table[c], k) for c, k in (("nodes", np.int64), ("sizes", np.int32), ("leads", np.int32))]
        keep = _once(tokens, per_node[0], counts)
        tokens = tokens[np.repeat(keep, counts)]
        owner = np.repeat(np.flatnonzero(keep).astype(np.int32), counts[keep])
        n_slices = pieces(len(tokens), SLICE_TOKENS)
        slice_of = ((tokens.astype(U64) * U64(n_slices)) >> U64(32)).astype(np.int32)
        found, dear = [], []
        for nth in range(n_slices):
            here = np.flatnonzero(slice_of == nth)
            pairs, long = _slice_pairs(tokens[here], *(x[owner[here]] for x in per_node), percent, limit)
            found.append(pairs)
            dear.append(long)
        a, b, least, common = _merged(*(np.concatenate(x) for x in zip(*found)))
        long_t, long_n, long_l = (np.concatenate(x) for x in zip(*dear))
        dear = ((long_t.astype(np.int64) << 24) ^ bucket) | np.int64(-(1 << 62))
        return pa.table(
            {
                "a": pa.array(np.concatenate((a, long_n))),
                "b": pa.array(np.concatenate((b, dear))),
                "lead": pa.array(np.concatenate((least, long_l.astype(np.int64)))),
                "common": pa.concat_arrays([pa.array(common), pa.nulls(len(dear), pa.int64())]),
            }
        )

    return run


def _texts(build):
    """Texts of the candidates, with the upper half of their digest; a row whose text isn't that of its class goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            _, keys = build(batch.column("text"))
            want = zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist())
            rows = pa.array([r for r, k in enumerate(want) if keys[r] == k], pa.int64())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("rep").take(rows), "text": batch.column("text").take(rows)})

    return run


def _repeats(build):
    """Tokens that several classes of a whole partition hold, with their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        held = []
        for batch in text_slices(batches):
            for tokens, key in zip(*build(batch.column("text"))):
                if len(tokens) and key not in seen:
                    seen.add(key)
                    held.append(tokens)
        if held:
            tokens = np.sort(np.concatenate(held))
            first, length = _runs(tokens)
            several = length > 1
            yield pa.RecordBatch.from_pydict({"token": pa.array(tokens[first[several]].view(np.int64)), "size": pa.array(length[several].astype(np.int64))})

    return run


def _sets(build):
    """Whole sets of the candidates; a row whose text isn't that of its class goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            sets, keys = build(batch.column("text"))
            want = zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist())
            keep = [r for r, k in enumerate(want) if keys[r] == k]
            rows = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_pydict(
                {
                    "part": batch.column("part").take(rows),
                    "rep": batch.column("rep").take(rows),
                    "tokens": pa.array([sets[r].tobytes() for r in keep], pa.binary()),
                }
            )

    return run


class _Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)

    def roots(self) -> np.ndarray:
        return np.array([self.root(x) for x in range(len(self.up))], np.int64)


class _Counter:
    """Exact intersections of any set with all sets of a group, through the tokens that several of them hold."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        tokens = np.concatenate(sets)
        sizes = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(tokens, kind="stable")
        self.owners = owner[order]
        self.first, self.length = _runs(tokens[order])
        run_of = np.empty(len(tokens), np.int64)
        run_of[order] = np.repeat(np.arange(len(self.first)), self.length)
        cuts = np.concatenate(([0], np.cumsum(sizes)))
        self.runs = [run_of[i:j] for i, j in zip(cuts[:-1], cuts[1:])]
        self.sizes = sizes

    def links(self, x: int, percent: int) -> np.ndarray:
        runs = self.runs[x][self.length[self.runs[x]] > 1]
        length = self.length[runs]
        at = np.repeat(self.first[runs] - np.concatenate(([0], np.cumsum(length)[:-1])), length) + np.arange(length.sum())
        common = np.bincount(self.owners[at], minlength=len(self.sizes))
        found = 100 * common >= percent * (self.sizes + self.sizes[x] - common)
        found[x] = False
        return np.flatnonzero(found)

    def spread(self) -> np.ndarray:
        """How much of each set others hold too; the text that copies were made from has most."""
        return np.array([self.length[r].sum() / max(1, len(r)) for r in self.runs])


def link_group(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set of a group the smallest index that links reach from it.

    The most widely held sets go first; what they don't connect to the largest component is then held
    against all sets.  A link between two components has an end outside the largest, so none is missed.
    """
    forest, counter = _Forest(len(sets)), _Counter(sets)
    pivots = np.argsort(-counter.spread(), kind="stable")[:_PIVOTS]
    for x in pivots:
        for y in counter.links(int(x), percent):
            forest.join(int(x), int(y))
    roots = forest.roots()
    largest = np.bincount(roots).argmax()
    done = set(pivots.tolist())
    for x in np.flatnonzero(roots != largest):
        if int(x) not in done:
            for y in counter.links(int(x), percent):
                forest.join(int(x), int(y))
    return forest.roots()


def _link_parts(percent: int):
    """Streams groups in order of ``part``; gives each member its root."""

    def flush(reps: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        order = np.argsort(np.array(reps, np.int64), kind="stable")
        ids = np.array(reps, np.int64)[order]
        roots = ids[link_group([sets[i] for i in order], percent)]
        return pa.RecordBatch.from_pydict({"rep": pa.array(ids), "root": pa.array(roots)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, reps, sets = None, [], []
        for batch in batches:
            for p, rep, tokens in zip(batch.column("part").to_pylist(), batch.column("rep").to_pylist(), batch.column("tokens")):
                if p != part:
                    if len(reps) > 1:
                        yield flush(reps, sets)
                    part, reps, sets = p, [], []
                reps.append(rep)
                sets.append(np.frombuffer(tokens.as_py(), U64))
        if len(reps) > 1:
            yield flush(reps, sets)

    return run


def _link_blocks(percent: int):
    """Links between the sets of a block of queries and a block of the group, as a forest."""

    def run(_key: tuple, queries: pa.Table, block: pa.Table) -> pa.Table:
        a, b = [], []
        if queries.num_rows and block.num_rows:
            ids = queries["rep"].to_pylist() + block["rep"].to_pylist()
            sets = [np.frombuffer(x, U64) for x in queries["tokens"].to_pylist() + block["tokens"].to_pylist()]
            counter, forest = _Counter(sets), _Forest(len(sets))
            for x in range(queries.num_rows):
                for y in counter.links(x, percent):
                    forest.join(x, int(y))
            roots = forest.roots()
            a, b = [ids[i] for i in range(len(ids)) if roots[i] != i], [ids[r] for i, r in enumerate(roots) if r != i]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _match(queries: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Links of the queries with all members of their groups, block against block."""
    of = lambda df, name: df.groupBy("part").agg(F.max("block").alias(name))
    asked = queries.join(of(members, "n_other"), "part").withColumn("other", F.explode(F.sequence(F.lit(0), "n_other")))
    held = members.join(of(queries, "n_other"), "part").withColumn("other", F.explode(F.sequence(F.lit(0), "n_other")))
    left = asked.select("part", F.col("block").alias("q"), F.col("other").alias("d"), "rep", "tokens")
    right = held.select("part", F.col("other").alias("q"), F.col("block").alias("d"), "rep", "tokens").toDF("part", "q", "d", "rep", "tokens")
    return left.groupBy("part", "q", "d").cogroup(right.groupBy("part", "q", "d")).applyInArrow(_link_blocks(percent), "a long, b long")


def _link_large(sets: DataFrame, percent: int, group_tokens: int, block_rows: int) -> DataFrame:
    """``rep, root`` of groups too large for one task: a few pivots against all blocks, then what they left unconnected."""
    half = max(1, group_tokens // 2)

    def blocked(some: DataFrame) -> DataFrame:
        """In blocks by tokens and rows, as many as these sets need."""
        blocks = some.groupBy("part").agg(F.greatest(F.ceil(F.sum("size") / half), F.ceil(F.count(F.lit(1)) / block_rows)).alias("n_blocks"))
        return checkpointed(some.join(blocks, "part").select("part", "rep", "tokens", "size", F.pmod(F.xxhash64("rep"), F.col("n_blocks")).cast("int").alias("block")))

    sets = blocked(sets.withColumn("size", F.octet_length("tokens") / 8))
    # Pivots: the smallest of each of a few classes of a hash, so any aggregation of them is bounded.
    pivots = sets.groupBy("part", F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(_BLOCK_PIVOTS)).alias("nth")).agg(F.min("rep").alias("rep")).drop("nth")
    queries = sets.join(pivots, ["part", "rep"], "left_semi").withColumn("block", F.lit(0))
    first = checkpointed(_match(queries, sets, percent))
    roots = connected_components(first)
    state = checkpointed(sets.select("part", "rep").join(roots, F.col("rep") == F.col("node"), "left").select("part", "rep", F.coalesce("root", "rep").alias("root")))
    count = state.groupBy("part", "root").count()
    largest = count.groupBy("part").agg(F.max_by("root", F.struct("count", "root")).alias("root"))
    rest = state.join(largest, ["part", "root"], "left_anti").select("part", "rep")
    second = _match(blocked(sets.drop("block").join(rest, ["part", "rep"], "left_semi")), sets, percent)
    return connected_components(first.unionByName(second)).select(F.col("node").alias("rep"), "root")


def ngram_components(docs: DataFrame, n: int = 5, percent: int = 80, run: int = SHINGLE_RUN, **settings) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``; settings as for ``set_components``."""
    found = set_components(docs, shingle_builder(n), percent, run=run, **settings)
    return found.select("doc_id", F.col("size").alias("n_shingles"), "component_id")


def set_components(
    docs: DataFrame,
    build,
    percent: int,
    model: CostModel = CostModel(),
    run: int = RUN,
    group_tokens: int = GROUP_TOKENS,
    group_rows: int = GROUP_ROWS,
    block_rows: int = BLOCK_ROWS,
    max_frequent: int = MAX_FREQUENT,
    max_broadcast_rows: int = MAX_BROADCAST_ROWS,
    by_size: bool = False,
) -> DataFrame:
    """``doc_id, size, component_id``: the self-join of the sets that ``build`` makes of the texts.

    ``model``: what leads are chosen by.  ``run``: documents a token may have for its pairs to be counted.
    ``max_frequent``: how many tokens have a count.  ``by_size``: sets meet only in partitions by their size, each in
    its own and as a guest in the next.  None of these changes the result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = checkpointed(docs.mapInArrow(_digests(build), "doc_id long, k1 long, k2 long, size long, token long"))
    digests = found.filter("token is null").drop("token")
    n_tokens = digests.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    classes = checkpointed(digests.filter("size > 0 and doc_id is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.max("size").alias("size")))
    twins = checkpointed(classes.groupBy("k1").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("k1").alias("a"), F.col("k1").alias("b")))  # classes that share a node

    def grouped(texts: DataFrame, tokens: DataFrame, n_tokens: int) -> DataFrame:
        """``node, root``: the components of candidates among the texts, by leads that these tokens' counts choose."""
        often = tokens.groupBy("token").agg(F.sum("size").alias("count")).orderBy(F.desc("count"), "token").limit(max_frequent).toArrow()
        known = often["token"].to_numpy().astype(np.int64).view(U64)
        order = np.argsort(known)
        frequent = spark.sparkContext.broadcast((known[order].tobytes(), often["count"].to_numpy().astype(np.int64)[order].tobytes()))
        # A batch sends each bucket one row, so on very large inputs buckets grow in size rather than in number.
        each = max(BUCKET_BYTES, min(MOST_BUCKET_BYTES, n_tokens * 4 // MANY_BUCKETS))
        n_buckets = pieces(n_tokens * 4, each, 2 * spark.sparkContext.defaultParallelism)
        prefixes = texts.mapInArrow(
            _prefixes(build, percent, model, run, n_buckets, by_size, frequent), "bucket int, tokens binary, nodes binary, sizes binary, leads binary, counts binary"
        )
        counted = checkpointed(prefixes.repartition(n_buckets, "bucket").groupBy("bucket").applyInArrow(_count_runs(percent, run), "a long, b long, lead long, common long"))
        dear = counted.filter("common is null").select(F.col("a").alias("node"), F.col("b").alias("token"), "lead")
        held = checkpointed(dear.groupBy("node").agg(F.count(F.lit(1)).alias("dear"), F.min("lead").alias("lead")))
        pairs = counted.filter("common is not null").groupBy("a", "b").agg(F.sum("common").alias("common"), F.min("lead").alias("lead"))
        for side in ("a", "b"):
            pairs = pairs.join(held.select(F.col("node").alias(side), F.col("dear").alias(f"dear_{side}")), side, "left")
        shown = F.col("lead") - F.least(F.coalesce("dear_a", F.lit(0)), F.coalesce("dear_b", F.lit(0)))
        pairs = pairs.filter(F.col("common") >= F.greatest(F.lit(1), shown))
        # A link whose common prefix tokens are all dear has an end with as many dear ones as its lead; the other end has as many as that lead too.
        placed = checkpointed(dear.select("node", "token").join(held, "node"))
        floors = placed.filter("dear >= lead").groupBy("token").agg(F.min("lead").alias("floor"))
        attached = placed.join(floors, "token").filter("dear >= floor").select(F.col("node").alias("a"), F.col("token").alias("b"))
        return connected_components(pairs.select("a", "b").unionByName(attached).unionByName(twins))

    def sized(members: DataFrame) -> DataFrame:
        """Members of groups of several, and whether their group is too large for one task."""
        wide = members.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("tokens")).filter("n > 1")
        return checkpointed(members.join(wide.select("part", ((F.col("tokens") > group_tokens) | (F.col("n") > group_rows)).alias("large")), "part"))

    def texts_of(some: DataFrame, n: int) -> DataFrame:
        return docs.join(F.broadcast(some) if n <= max_broadcast_rows else some, F.col("doc_id") == F.col("rep")).select("text", "rep", "k1", "k2", "part", "large")

    groups = grouped(docs, found.filter("token is not null"), n_tokens)
    members = sized(groups.join(classes, F.col("node") == F.col("k1")).select(F.col("root").alias("part"), "rep", "k1", "k2", "size"))
    # Of large groups the texts are grouped again, by the counts of tokens among themselves, as long as a tenth of them leaves large groups.
    n_before = None
    while True:
        large = members.filter("large")
        n_large, tokens = large.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
        if not n_large or (n_before is not None and n_large > 0.9 * n_before):
            break
        n_before = n_large
        again = checkpointed(texts_of(large, n_large).mapInArrow(_texts(build), "doc_id long, text string").repartition(pieces(tokens * 8, COUNTED_BYTES), "doc_id"))
        groups = grouped(again, again.mapInArrow(_repeats(build), "token long, size long"), tokens)
        finer = groups.join(large.drop("part", "large"), F.col("node") == F.col("k1")).select(F.col("root").alias("part"), "rep", "k1", "k2", "size")
        members = checkpointed(members.filter("not large").unionByName(sized(finer).select(*members.columns)))
    n_members, any_large = members.agg(F.count(F.lit(1)), F.coalesce(F.max("large"), F.lit(False))).first()
    sets = texts_of(members, n_members)

    def whole(large: bool) -> DataFrame:
        return sets.filter(F.col("large") == large).mapInArrow(_sets(build), "part long, rep long, tokens binary")

    linked = whole(False).repartition("part").sortWithinPartitions("part", "rep").mapInArrow(_link_parts(percent), "rep long, root long")
    if any_large:
        linked = linked.unionByName(_link_large(whole(True).dropDuplicates(), percent, group_tokens, block_rows))
    linked = checkpointed(linked.groupBy("rep").agg(F.min("root").alias("root")))
    roots = classes.select("k1", "k2", "rep").join(linked, "rep", "left").select("k1", "k2", F.coalesce("root", "rep").alias("root"))
    return (
        digests.join(checkpointed(roots), ["k1", "k2"], "left")
        .select("doc_id", F.col("size"), F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).alias("component_id"))
    )


def _with_row_ids(docs: DataFrame, name: str, max_broadcast_rows: int) -> DataFrame:
    """One row of each document, with an id of its own in the column ``name``.

    Rows of one id and one text are one document; of those the row whose other columns hash lowest stands for it.  The first text
    of an id, by digest, has the id itself.  Further texts of it, and texts without an id, get unused numbers.  Rows with
    neither an id nor a word get null.  Tables whose ids are all there and all different are only counted.
    """
    number, digest, whole, row = free_names([*docs.columns, name], ["number", "digest", "whole", "row"])
    key = F.col("doc_id").cast("long")
    repeated = checkpointed(docs.groupBy(key.alias(number)).agg(F.count(F.lit(1)).alias("n")).filter(f"n > 1 or {number} is null").select(number))
    n_repeated = repeated.count()
    if not n_repeated:
        return docs.withColumn(name, key)
    side = repeated.filter(F.col(number).isNotNull())
    side = F.broadcast(side) if n_repeated <= max_broadcast_rows else side
    named, nameless = docs.filter(key.isNotNull()), docs.filter(key.isNull())
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    odd = named.join(side, key == F.col(number), "left_semi").unionByName(nameless.filter(worded))
    others = F.sha2(F.to_json(F.struct(*(c for c in docs.columns if c not in ("doc_id", "text")), F.lit(0).alias(whole))), 256)
    one = odd.groupBy(key.alias(number), F.sha2(F.coalesce("text", F.lit("")), 256).alias(digest), F.col("text").isNull().alias(whole)).agg(
        F.min_by(F.struct(*docs.columns), others).alias(row)
    )
    one = checkpointed(one.withColumn(digest, F.when(F.col(whole), "").otherwise(F.col(digest))).withColumn(whole, F.monotonically_increasing_id()))
    first = one.filter(F.col(number).isNotNull()).groupBy(F.col(number).alias(f"{number}_")).agg(F.min(digest).alias(f"{digest}_"))
    low, high = docs.agg(F.coalesce(F.min(key), F.lit(0)), F.coalesce(F.max(key), F.lit(0))).first()
    unused = F.lit(high + 1) + F.col(whole) if high < 1 << 62 else F.lit(low - 1) - F.col(whole)
    own = F.when(F.col(digest) == F.col(f"{digest}_"), F.col(number)).otherwise(unused)
    one = one.join(first, F.col(number) == F.col(f"{number}_"), "left").select(f"{row}.*", own.alias(name))
    plain = named.join(side, key == F.col(number), "left_anti").withColumn(name, key)
    blank = nameless.filter(~worded).withColumn(name, F.lit(None).cast("long"))
    return plain.unionByName(one).unionByName(blank)


def keep_one_of_each(docs: DataFrame, max_broadcast_rows: int = MAX_BROADCAST_ROWS, **settings) -> DataFrame:
    """One row of each group of near copies, that of the smallest id, and all other documents.

    It is decided by row: of rows that repeat an id and a text one stays, of an id with several texts each text is
    judged by itself, and a text without an id stays only if no copy of it has one.  Rows without words all stay, but for
    repeats of an id.
    """
    name, gone = free_names(docs.columns, ["row_id", "dropped_id"])
    rows = _with_row_ids(docs, name, max_broadcast_rows)
    found = ngram_components(rows.select(F.col(name).alias("doc_id"), "text"), max_broadcast_rows=max_broadcast_rows, **settings)
    dropped = checkpointed(found.filter("doc_id <> component_id").select(F.col("doc_id").alias(gone)).distinct())
    few = dropped.count() <= max_broadcast_rows
    return rows.join(F.broadcast(dropped) if few else dropped, F.col(name) == F.col(gone), "left_anti").select(*docs.columns)
