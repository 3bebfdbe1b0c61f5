"""How filters of documents interact: what each removes, alone and after others, for every order of them.

1. *Flags.*  One pass gives each document five flags: A, few words; B, few of them distinct; C, many capitals; D, a mark that prose
   lacks; E, a copy of the text of a smaller id.  Copies are found without moving texts: of each digest and part the rows are counted, and how many of
   them have the smallest id, so that a third of all rows with one text meet as a few sums.
2. *Cube.*  ``GROUP BY CUBE`` over the part and the five flags, of those sums.  A row of a grouping set whose selected flags are all
   false counts the documents that survive this subset of the filters.
3. *Steps.*  A step of an order goes from one subset of filters to the subset with one more: its figures are differences of two
   survivors' rows, joined by part and subset.

Defined results: a null text is an empty one, a null source the empty part; a row without an id is nobody's copy and makes none; rows of the smallest id
itself are no copies; labels of an id that has several count if any says so; empty tables give no rows.  Texts are equal when
their SHA-256 is.
"""

from __future__ import annotations

import json
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm._spark import checkpointed

FILTERS = "ABCDE"
_FLAGS = [f.lower() for f in FILTERS]
_SUMS = ["docs", "good", "toxic"]


def own_flags(text: Column) -> list[Column]:
    """The failure conditions A to D of a text that isn't null."""
    spaced = F.split(F.translate(text, "\t\n\x0b\f\r", "     "), " ")
    words = F.array_remove(spaced, "")
    n_words, n_distinct = F.size(words), F.size(F.array_distinct(words))
    n_chars = F.length(text)
    capitals = n_chars - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return [n_words < 50, 100 * n_distinct < 65 * n_words, 100 * capitals > 5 * n_chars, text.rlike(r"[#$%&*|]")]


def flagged_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, a, b, c, d, e`` and how many documents, good ones and toxic ones have these flags."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        *(flag.alias(name) for name, flag in zip(_FLAGS, own_flags(text))),
    )
    keys = ["digest", "part", *_FLAGS[:4]]
    rows = rows.groupBy("doc_id", *keys).agg(F.count(F.lit(1)).alias("n"))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    rows = rows.join(marks.filter("doc_id is not null"), "doc_id", "left").na.fill(0, ["good", "toxic"])
    lots = rows.groupBy(*keys, "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("nameless"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least"),
    )
    # A digest has a row for each part and pair of labels, whatever the number of its copies.
    first = F.col("least.doc_id") == F.min("least.doc_id").over(W.partitionBy("digest"))
    own = F.col("nameless") + F.when(first, F.col("least.n")).otherwise(0)
    either = F.array(F.struct(F.lit(False).alias("e"), F.col("own").alias("x")), F.struct(F.lit(True).alias("e"), (F.col("n") - F.col("own")).alias("x")))
    split = lots.withColumn("own", own).select("part", *_FLAGS[:4], "good", "toxic", F.inline(either)).filter("x > 0")
    sums = [F.sum("x"), F.sum(F.col("x") * F.col("good")), F.sum(F.col("x") * F.col("toxic"))]
    return split.groupBy("part", *_FLAGS).agg(*(s.alias(name) for name, s in zip(_SUMS, sums)))


def survivors(counts: DataFrame) -> DataFrame:
    """``part, mask`` and the sums of the documents that fail no filter of the mask (bit i: filter i), from the cube; subsets without any are missing."""
    cube = counts.cube("part", *_FLAGS).agg(F.grouping("part").alias("all_parts"), *(F.grouping(f).alias(f"any_{f}") for f in _FLAGS), *(F.sum(s).alias(s) for s in _SUMS))
    mask = sum(((1 - F.col(f"any_{f}").cast("int")) * (1 << i) for i, f in enumerate(_FLAGS)), F.lit(0))
    clean = F.lit(True)
    for f in _FLAGS:
        clean = clean & ((F.col(f"any_{f}") == 1) | ~F.col(f))
    return cube.filter((F.col("all_parts") == 0) & clean).select("part", mask.alias("mask"), *_SUMS)


def _steps(spark: SparkSession) -> DataFrame:
    """``filter_order, step, before, place`` of every step of every order: the mask before it and its filter's place."""
    rows = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, place in enumerate(order, 1):
            rows.append({"filter_order": "".join(FILTERS[i] for i in order), "step": step, "before": before, "place": place})
            before |= 1 << place
    listed = F.from_json(F.lit(json.dumps(rows)), "array<struct<filter_order string, step int, before int, place int>>")
    return spark.range(1).select(F.inline(listed))


def _moves(found: DataFrame) -> DataFrame:
    """For every part and pair of subsets that differ by one filter: ``kept`` after it, what it takes, and the filter's figures over all pairs."""
    every = (1 << len(FILTERS)) - 1
    pairs = [{"before": b, "place": i, "after": b | 1 << i} for b in range(every + 1) for i in range(len(FILTERS)) if not b >> i & 1]
    listed = F.from_json(F.lit(json.dumps(pairs)), "array<struct<before int, place int, after int>>")
    moves = found.filter("mask = 0").select("part", F.inline(listed))
    for mask, side in (("before", "was"), ("after", "now")):
        moves = moves.join(found.select("part", F.col("mask").alias(mask), F.struct(*_SUMS).alias(side)), ["part", mask], "left")
    left = {(side, s): F.coalesce(F.col(f"{side}.{s}"), F.lit(0)) for side in ("was", "now") for s in _SUMS}
    lost = [(left["was", s] - left["now", s]).alias(f"lost_{s}") for s in _SUMS]
    moves = moves.select("part", "before", "after", "place", left["now", "docs"].alias("kept"), *lost)
    orders = F.element_at(F.array(*(F.lit(factorial(k) * factorial(len(FILTERS) - 1 - k)) for k in range(len(FILTERS)))), F.bit_count("before") + 1)
    one = W.partitionBy("part", "place")
    failing = F.max(F.when(F.col("before") == 0, F.col("lost_docs"))).over(one)
    return moves.select(
        "part", "before", "place", "kept", F.col("lost_docs").alias("removed"), (failing - F.col("lost_docs")).alias("redundant"),
        F.max(F.when(F.col("after") == every, F.col("lost_docs"))).over(one).alias("unique_fails"),
        F.col("lost_good").alias("good_lost"), F.col("lost_toxic").alias("toxic_lost"), F.sum(F.col("lost_docs") * orders).over(one).alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for every part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    moves = _moves(checkpointed(survivors(flagged_counts(docs, labels))))
    figures = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    steps = F.broadcast(_steps(docs.sparkSession))  # 600 rows
    return moves.join(steps, ["before", "place"]).select("part", "filter_order", "step", *figures)
