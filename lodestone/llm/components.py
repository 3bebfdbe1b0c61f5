"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step replaces a node's edges by edges to the smallest neighbour, so the
number of edges never grows, and a few rounds (about the logarithm of the
longest path) turn every component into a star around its smallest node.  Edges
stay distributed; the driver sees a count and a checksum a round.

A graph of at most ``max_task_edges`` edges (16 bytes each) is solved by one task instead, with the same
result: a dozen rounds of shuffles of a few thousand rows cost more than their work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._spark import checkpointed


MAX_TASK_EDGES = 1_000_000


def smallest_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted nodes of the edges, and for each the smallest node it reaches: labels fall to the least at either end, and jump to their labels' labels."""
    nodes, place = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = place[: len(a)], place[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        for ends in (a, b, label[a], label[b]):
            np.minimum.at(new, ends, least)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
    if held:
        nodes, roots = smallest_reachable(*(np.concatenate(x) for x in zip(*held)))
        yield pa.RecordBatch.from_pydict({"node": pa.array(nodes, pa.int64()), "root": pa.array(roots, pa.int64())})


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v > m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, max_task_edges: int = MAX_TASK_EDGES) -> DataFrame:
    """``node, root`` for every node of the edges ``a, b`` (longs): the root is the smallest node reachable.

    Self-loops and repeated edges are allowed; an edge with a null end joins nothing and is left out.
    """
    current = checkpointed(
        edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a is not null and b is not null").distinct()
    )
    if current.count() <= max_task_edges:
        return checkpointed(current.coalesce(1).mapInArrow(_in_one_task, "node long, root long"))
    loops = current.select(F.col("a").alias("node"))
    stars, before = current.filter("a <> b"), None
    while True:
        row = stars.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if row["n"] == 0 or (row["n"], row["x"]) == before:
            break
        before = (row["n"], row["x"])
        stars = checkpointed(_small_star(_large_star(stars)))
    roots = stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
    alone = loops.unionByName(stars.select(F.col("b").alias("node"))).distinct().join(roots.select("node"), "node", "left_anti")
    return roots.unionByName(alone.select("node", F.col("node").alias("root")))
