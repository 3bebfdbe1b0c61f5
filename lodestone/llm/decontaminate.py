"""Benchmark decontamination with one Aho-Corasick automaton over normalised test items.

Texts and items are normalised alike: A-Z lower-cased, every run of other ASCII
characters than a-z and 0-9 one space, a space at either end.  A window is
``window`` consecutive words of an item; an item of fewer words, but not none, is
one window.  The automaton holds all windows with their outer spaces, so that it finds
whole words only and overlapping windows share them.  A text is scanned once, and a
match's end gives its words and, for reports, its place in the original text.

The items are a stated query set that is held against all documents.  They reach the workers in
blocks of at most ``block_bytes`` of text; a table of items beyond one block
takes one more pass over the documents a block, so no size of it is refused.

Defined results: null, empty or wordless texts have no words and aren't
contaminated; wordless items have no window; items that repeat an id count once;
a null item id reads as the empty string.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.llm._spark import free_names, pieces
from lodestone.llm._words import text_slices

BLOCK_BYTES = 4 << 20
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


class _Automaton:
    """The windows of a block of items: each with its number of words and the items that hold it."""

    def __init__(self, items: list[tuple[str, str]], window: int) -> None:
        owners: dict[bytes, set[str]] = defaultdict(set)
        for item, text in items:
            words = normal_words(text)
            for start in range(max(1, len(words) - window + 1) if words else 0):
                owners[b" ".join(words[start : start + window])].add(item)
        self.scan = ahocorasick.Automaton()
        for phrase, held in owners.items():
            self.scan.add_word(f" {phrase.decode('latin-1')} ", (phrase.count(b" ") + 1, tuple(sorted(held))))
        self.empty = not owners
        if owners:
            self.scan.make_automaton()

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word intervals of all occurrences, and the items they come from."""
        if self.empty or not words:
            return [], set()
        line = b" %b " % b" ".join(words)
        found = list(self.scan.iter(line.decode("latin-1")))
        if not found:
            return [], set()
        spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        ends = np.searchsorted(spaces, [end for end, _ in found])
        return [(int(e) - n, int(e)) for e, (_, (n, _)) in zip(ends, found)], {x for _, (_, held) in found for x in held}


_built: dict[tuple, _Automaton] = {}


def _automaton(shared, window: int) -> _Automaton:
    """Built once a worker process and block."""
    key = (shared.value[0], window)
    if key not in _built:
        _built.clear()
        _built[key] = _Automaton(shared.value[1], window)
    return _built[key]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching intervals as one, in order."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def original_spans(text: str, spans: list[tuple[int, int]]) -> list[list[int]]:
    """Word intervals as code point offsets in the text they were found in."""
    raw = text.encode()
    at = [m.span() for m in _WORD.finditer(raw.translate(_FOLD))]
    chars = lambda n: len(raw[:n].decode(errors="ignore"))
    return [[chars(at[a][0]), chars(at[b - 1][1])] for a, b in spans]


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_FOUND = [("words", pa.int64()), ("spans", _SPANS), ("items", pa.list_(pa.string()))]


def _scan(shared, window: int, width: int, first: bool):
    """Appends or extends the columns that hold a text's words, hit intervals and items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(shared, window)
        for batch in text_slices(batches, column="c0"):
            rows: tuple[list, list, list] = ([], [], [])
            before = [None] * len(batch) if first else list(zip(*(batch.column(width + i).to_pylist() for i in (1, 2))))
            for text, old in zip(batch.column(0), before):
                words = normal_words(text.as_py())
                spans, items = automaton.find(words)
                if old is not None:
                    spans += [(s["start"], s["end"]) for s in old[0]]
                    items |= set(old[1])
                rows[0].append(len(words))
                rows[1].append([{"start": a, "end": b} for a, b in merged(spans)])
                rows[2].append(sorted(items))
            found = [pa.array(x, kind) for x, (_, kind) in zip(rows, _FOUND)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *found], [f"c{i}" for i in range(width + 3)])

    return run


def _item_blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    items = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    n_blocks = pieces(int(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0), block_bytes)
    for block in range(n_blocks):
        part = items.filter(F.pmod(F.xxhash64("text"), F.lit(n_blocks)) == block) if n_blocks > 1 else items
        yield [(r["id"], r["text"]) for r in part.orderBy("id", "text").collect()]  # about block_bytes


def scan_documents(docs: DataFrame, items: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with ``hit_words`` (words of the text), ``hit_spans`` (word intervals) and ``hit_items`` appended.

    Columns of ``docs`` keep their order, names and values; where one of those three names is taken, the appended column gets an underscore.
    """
    spark = docs.sparkSession
    at = docs.columns.index("text")
    order = [at, *(i for i in range(len(docs.columns)) if i != at)]
    width = len(order)
    state = docs.toDF(*(f"c{i}" for i in range(width))).select(*(f"c{i}" for i in order)).toDF(*(f"c{i}" for i in range(width)))
    added = StructType.fromDDL("words long, spans array<struct<start: long, end: long>>, items array<string>")
    kept = list(state.schema.fields)
    schema = StructType([*kept, *(f for f in added.fields)])
    for k, f in enumerate(schema.fields):
        f.name = f"c{k}"
    for number, block in enumerate(_item_blocks(items, block_bytes)):
        name = hashlib.sha256(repr(block).encode()).hexdigest()
        state = state.mapInArrow(_scan(spark.sparkContext.broadcast((name, block)), window, width, number == 0), schema)
    back = [f"c{order.index(i)}" for i in range(width)]
    return state.select(*back, *(f"c{width + i}" for i in range(3))).toDF(*docs.columns, *free_names(docs.columns, ["hit_words", "hit_spans", "hit_items"]))


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES, offsets: bool = True) -> DataFrame:
    """One row a document: words, hit words, items with windows in it, their digest, and whether any occurs.

    With ``offsets`` also ``spans``: where the hit words stand in the original text, in code points.
    """
    found = scan_documents(docs.select("doc_id", "text"), items, window, block_bytes)
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    out = [
        F.col("doc_id"),
        F.col("hit_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"),
    ]
    return found.select(*out, _places().alias("spans")) if offsets else found.select(*out)


def _places() -> Column:
    """Word intervals as offsets in the original text; only hit texts are looked at again."""

    @F.pandas_udf("array<array<long>>")
    def places(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([original_spans(t, [(s["start"], s["end"]) for s in x]) if len(x) else [] for t, x in zip(texts, spans)])

    return F.transform(places("text", "hit_spans"), lambda s: F.struct(s[0].alias("start"), s[1].alias("end")))


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` in which no window of an item occurs."""
    at = len(docs.columns)
    found = scan_documents(docs, items, window, block_bytes)
    plain = found.toDF(*(f"c{i}" for i in range(at + 3)))
    return plain.filter(F.size(f"c{at + 1}") == 0).select(*(f"c{i}" for i in range(at))).toDF(*docs.columns)
