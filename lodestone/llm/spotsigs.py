"""SpotSigs: fingerprints from chains of content words that follow common-word anchors.

At every anchor (a common function word) stands a signature: the anchor and the
next ``chain`` content words after it.  Running prose is full of anchors, while
navigation, tables and boilerplate have few, so the set of a text's signatures follows its
prose.  A fingerprint lists the sorted 32-bit hashes of that set in hexadecimal; likeness is the
Jaccard similarity of two such sets, pruned by their sizes where a least likeness is asked for.

``spot_components`` finds near copies among all documents.  Sets are partitioned by their length, such that sets of a
likeness of ``percent`` lie in the same partition or in neighbouring ones: each goes to its own, and to the next if partners of it can be there.
Within a partition sets meet through their rarest signatures, and only those of like sizes; what meets is compared by exact
Jaccard (the prefix join of ``ngram_join``).

``fingerprint_edits`` gives each
document's own fingerprint, that of its text with the latter half replaced by the start
of the next document, both likenesses, and the component from ``spot_components``.  For that, documents are dealt to ranges of ids of
about equal size; the first document of a range also goes to the range before, so each task holds
all neighbours it needs, and texts cross the network once.  Components are rows of the same exchange, ahead of their documents.

Defined results: a text with words but no anchor before a content word (tables, lists, other
languages) has a signature for each run of ``chain`` words, or for all of them if they are fewer; a text without words one, its bytes; a null or empty text none, and two empty
fingerprints are alike (1).  Null ids come first; rows of equal id are ordered by text.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm._spark import pieces, shuffle_width, text_bytes
from lodestone.llm._words import PLAIN_LOWER, U64, mix, utf8, window_hashes, word_hashes
from lodestone.llm.ngram_join import CostModel, set_components

CHAIN = 3
MODEL = CostModel(least=0.0)  # sets are small: the cheapest lead is taken as it is
GROUP_ROWS = 10_000  # signature sets are a fraction of the texts, so that many make a task
COMPONENT, DOCUMENT, GUEST = range(3)  # kinds of rows in a range
#: Text of a range of ids, and how many ranges there are at most (beyond that they hold more; a task reads its range in pieces of 1 MB).
PART_BYTES, MAX_RANGES = 16 << 20, 32_768
#: Function words that anchor signatures.
ANCHORS = (
    "a an the is are was were that this there of to in "
    "der die das ein eine ist sind war und den dem zu "
    "le la les un une est sont des du et que en "
    "el los las una es son del y por con"
).split()
#: Further common words that are no content.
COMMON = (
    "and or but if then for on at by with from as it its be been he she they we you i his her their our not no have has had will would can could "
    "im in mit von auf nicht sich auch für als an aus bei nach oder aber wie wir sie er es ich dass wird "
    "il elle nous vous ils ce cette ces dans pour par sur avec pas plus qui ou mais au aux se sa son ne "
    "de que se su sus al lo como más pero para no o si ya este esta"
).split()


def _hashes(words: list[str]) -> np.ndarray:
    return np.sort(np.unique(word_hashes(pa.array(words), PLAIN_LOWER)[0]))


_ANCHORS = _hashes(ANCHORS)
_COMMON = _hashes([*ANCHORS, *COMMON])


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def spot_sets(column: pa.Array, chain: int = CHAIN) -> list[np.ndarray]:
    """Each row's sorted distinct signatures (64-bit hashes)."""
    words, bounds = word_hashes(column, PLAIN_LOWER)
    anchors = np.flatnonzero(_among(words, _ANCHORS))
    content = np.flatnonzero(~_among(words, _COMMON))
    stop = np.repeat(bounds[1:], np.diff(bounds))[anchors] if len(anchors) else anchors
    first = np.searchsorted(content, anchors)
    total = mix(words[anchors]) if len(anchors) else np.zeros(0, U64)
    follows = np.zeros(len(anchors), bool)
    for step in range(chain):
        at = np.minimum(first + step, max(0, len(content) - 1))
        if not len(content):
            break
        place = content[at]
        inside = (first + step < len(content)) & (place < stop)
        follows |= inside
        total = mix(total * U64(0x9E3779B97F4A7C15) + np.where(inside, words[place], U64(0)))
    anchors, total = anchors[follows], total[follows]
    cuts = np.searchsorted(anchors, bounds)
    raw, offsets = None, None
    out = []
    for row in range(len(bounds) - 1):
        found = np.unique(total[cuts[row] : cuts[row + 1]])
        if not len(found):
            own = words[bounds[row] : bounds[row + 1]]
            if len(own):
                found = np.unique(window_hashes(own, min(chain, len(own))))
            else:
                if raw is None:
                    raw, offsets = utf8(column)
                data = raw[offsets[row] : offsets[row + 1]].tobytes()
                if data:
                    found = np.frombuffer(hashlib.blake2b(data, digest_size=8).digest(), U64)
        out.append(found)
    return out


def spot_builder(chain: int = CHAIN):
    """Sets and digests for the set join; texts with equal signature sets are one class."""

    def build(column: pa.Array) -> tuple[list[np.ndarray], list[tuple]]:
        sets = spot_sets(column, chain)
        keys = []
        for held in sets:
            raw = hashlib.blake2b(held.tobytes(), digest_size=16).digest()
            keys.append((int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)) if len(held) else (None, None))
        return sets, keys

    return build


def spot_components(docs: DataFrame, percent: int = 80, chain: int = CHAIN, **settings) -> DataFrame:
    """``doc_id, n_signatures, component_id``: documents whose signature sets have a Jaccard similarity of ``percent`` or more are linked."""
    found = set_components(docs, spot_builder(chain), percent, by_size=True, **({"group_rows": GROUP_ROWS, "model": MODEL} | settings))
    return found.select("doc_id", F.col("size").alias("n_signatures"), "component_id")


def as_fingerprint(signatures: np.ndarray) -> np.ndarray:
    return np.unique((signatures >> U64(32)).astype(np.uint32))


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity of two sorted sets; 0 without looking further where their sizes rule ``least`` out."""
    small, large = sorted((len(a), len(b)))
    if not large:
        return 1.0
    if small < least * large:
        return 0.0
    common = small + large - len(np.union1d(a, b))
    return common / (small + large - common)


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of the following text."""
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


def _compare(chain: int):
    def rows(held: list[tuple[int | None, str, int | None]], after: str) -> pa.RecordBatch:
        texts = [t for _, t, _ in held]
        following = [*texts[1:], after]
        changed = [edited(t, f) for t, f in zip(texts, following)]
        prints = [as_fingerprint(s) for s in spot_sets(pa.array([*texts, after, *changed], pa.large_string()), chain)]
        own, other = prints[: len(texts) + 1], prints[len(texts) + 1 :]
        text_of = lambda p: p.astype(">u4").tobytes().hex()
        return pa.RecordBatch.from_pydict(
            {
                "doc_id": pa.array([i for i, _, _ in held], pa.int64()),
                "n_chars": pa.array([len(t) for t in texts], pa.int64()),
                "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
                "fingerprint": pa.array([text_of(p) for p in own[:-1]]),
                "edited_fingerprint": pa.array([text_of(p) for p in other]),
                "near_edited": pa.array([likeness(p, q) for p, q in zip(own, other)], pa.float64()),
                "near_next": pa.array([likeness(p, q) for p, q in zip(own[:-1], own[1:])], pa.float64()),
                "component_id": pa.array([c for _, _, c in held], pa.int64()),
            }
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, closed, size, component = None, [], False, 0, (None, None)
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("part", "doc_id", "text", "kind", "component_id"))
            for p, doc_id, text, kind, root in zip(*columns):
                if p != part:
                    part, held, closed, size = p, [], False, 0
                if kind == COMPONENT:
                    component = (doc_id, root)
                    continue
                text = text or ""
                if kind == GUEST:
                    if held and not closed:  # the first guest is the next document of the range's last
                        yield rows(held, text)
                    held, closed = [], True
                    continue
                if size > 1 << 20:
                    yield rows(held, text)
                    held, size = [], 0
                held.append((doc_id, text, None if doc_id is None else component[1] if component[0] == doc_id else doc_id))
                size += len(text)

    return run


def _range_of(order: Column, cuts: list[int]) -> Column:
    """How many cuts are at or below a value; looked up in two steps, so ranges may be many."""
    wide = max(1, int(len(cuts) ** 0.5))
    coarse, fine = _constant(cuts[::wide]), _constant(cuts)
    block = F.greatest(F.size(F.filter(coarse, lambda c: c <= order)) - 1, F.lit(0)) * wide
    return block + F.size(F.filter(F.slice(fine, block + 1, F.lit(wide)), lambda c: c <= order))


def _constant(values: list[int]) -> Column:
    """One literal, however many values."""
    return F.from_json(F.lit(json.dumps(values)), "array<bigint>")


def fingerprint_edits(docs: DataFrame, chain: int = CHAIN, part_bytes: int = PART_BYTES, percent: int = 80, **settings) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, component_id`` for every row.

    ``component_id`` is the smallest document that links by signature sets of a Jaccard similarity of ``percent`` or more lead to.
    """
    spark = docs.sparkSession
    lowest = -(1 << 63)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("order", F.coalesce("doc_id", F.lit(lowest)))
    n_parts = min(MAX_RANGES, pieces(text_bytes(rows)[1], part_bytes, shuffle_width(spark)))
    parts = [i / n_parts for i in range(1, n_parts)] or [0.5]
    percentages = F.from_json(F.lit(json.dumps(parts)), "array<double>")
    first, found = rows.agg(F.min("order"), F.percentile_approx("order", percentages, F.lit(max(10_000, 4 * n_parts)))).first()
    cuts = sorted({c for c in found or [] if c > first}) or [first if first is not None else 0]
    # A cut is an id that occurs: the first of its range.  Ranges are [.., cut 0), [cut 0, cut 1), ...
    part = _range_of(F.col("order"), cuts)
    at_cut = F.when(F.col("part") > 0, F.element_at(_constant(cuts), F.col("part")) == F.col("order"))
    homes = F.array_compact(
        F.array(
            F.struct(F.col("part").alias("part"), F.lit(DOCUMENT).alias("kind")),
            F.when(at_cut, F.struct((F.col("part") - 1).alias("part"), F.lit(GUEST).alias("kind"))),
            F.when(F.col("order") == F.lit(first), F.struct(F.lit(len(cuts)).alias("part"), F.lit(GUEST).alias("kind"))),
        )
    )
    dealt = rows.withColumn("part", part).withColumn("home", F.explode(homes)).select("home.part", "home.kind", "order", "doc_id", "text", F.lit(None).cast("long").alias("component_id"))
    linked = spot_components(rows, percent, chain, **settings).filter("component_id <> doc_id").select("doc_id", "component_id").distinct()
    linked = linked.withColumn("order", F.col("doc_id")).withColumn("part", part)
    linked = linked.select("part", F.lit(COMPONENT).alias("kind"), "order", "doc_id", F.lit(None).cast("string").alias("text"), "component_id")
    # Within a range: documents in order, each after the row with its component; guests last.
    laid = dealt.unionByName(linked).repartitionById(len(cuts) + 1, F.col("part").cast("int"))
    laid = laid.sortWithinPartitions("part", F.col("kind") == GUEST, "order", "kind", "text")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, component_id long"
    return laid.select("part", "kind", "doc_id", "text", "component_id").mapInArrow(_compare(chain), schema)
