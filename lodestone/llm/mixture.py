"""Mixing sources to target weights: hierarchical budgets over a domain, language, source tree.

1. *Supply.*  Tokens (words between ASCII white space) of every leaf, one aggregation.
2. *Budgets.*  A budget of tokens goes down the tree.  A node's children share its
   budget by their target weights; none gets more than its subtree can give
   (``max_epochs`` times its tokens), and what one can't take is dealt again among its
   siblings by their weights.  As a node is never given more than its subtree can take, a
   shortage passes to an ancestor's siblings only when all nearer siblings are full.
3. *Selection.*  A leaf takes whole epochs of its documents, and of one more epoch the
   longest prefix, in an order seeded by seed, epoch and document, that fits the rest.  The prefix is
   found without sorting a leaf: token sums over the first digits of the order's key
   say in which slice the cut falls, and only that slice is summed row by row.

Only a row a leaf joins the documents, so no text is shuffled; it is broadcast
where leaves number at most ``max_broadcast_rows``, and joined with salt beyond.

Defined results: null languages and sources are leaves of their own (the empty
name); weights that aren't given are 1; documents without words belong to an epoch like
others; a leaf without any word is selected not at all; documents of equal id stay together.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm._spark import checkpointed, free_names

LEVELS = ("domain", "lang", "source")
MAX_BROADCAST_ROWS = 20_000
_SALTS = 32
_DIGITS = 3


def domain_of(source: Column, n: int = 4) -> Column:
    """The tables name no domain: sources are dealt to ``n`` of them by the MD5 of their names."""
    digits = F.substring(F.md5(F.coalesce(source, F.lit(""))), 1, 8)
    return F.concat(F.lit("domain"), F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(n)).cast("string"))


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def _weight(level: str, weights: dict[str, dict[str, float]]) -> Column:
    given = F.from_json(F.lit(json.dumps(weights.get(level, {}))), "map<string,double>")
    return F.coalesce(F.element_at(given, F.col(level)), F.lit(1.0))


def _share(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """Deals each parent's ``budget`` to its children by ``weight``, up to their ``room``; what doesn't fit is dealt again.

    Sorted by room for their weight, the children that fill up come first.  With the first k full, the others get
    what is left by weight; that is the solution for the first k at which the next child doesn't fill up.
    Levels only fall from there on, so the largest open one is the first.
    """
    order = W.partitionBy(*parent).orderBy(F.col("room") / F.col("weight"), nodes.columns[len(parent)])
    until, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    filled = F.coalesce(F.sum("room").over(until), F.lit(0.0))
    level = (F.col("budget") - filled) / F.sum("weight").over(after)
    dealt = nodes.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= F.col("room"))
    first = F.max(F.when(F.col("open"), F.col("level"))).over(W.partitionBy(*parent))
    given = F.least(F.col("room"), F.coalesce(first, F.lit(float("inf"))) * F.col("weight"))
    return dealt.withColumn("given", given).drop("level", "open")


def leaf_budgets(leaves: DataFrame, budget: float | None, max_epochs: int, weights: dict[str, dict[str, float]]) -> DataFrame:
    """``domain, lang, source, tokens, target`` of every leaf; without a budget, all tokens there are."""
    leaves = leaves.withColumn("room", (F.col("tokens") * max_epochs).cast("double"))
    total = leaves.agg(F.least(F.sum("room"), F.lit(float("inf") if budget is None else float(budget))).alias("b"), F.sum("tokens").cast("double").alias("t"))
    total = total.select(F.least("b", "t") if budget is None else F.col("b")).toDF("budget")
    given = None
    for depth, level in enumerate(LEVELS):
        keys = list(LEVELS[: depth + 1])
        nodes = leaves.groupBy(*keys).agg(F.sum("room").alias("room")).withColumn("weight", _weight(level, weights))
        if given is None:
            nodes = nodes.withColumn("root", F.lit(0)).select("root", *keys, "room", "weight").join(F.broadcast(total))  # one row
            parent = ["root"]
        else:
            nodes = nodes.join(given, keys[:-1])
            parent = keys[:-1]
        nodes = nodes.select(*parent, *(k for k in keys if k not in parent), "room", "weight", "budget")
        given = _share(nodes, parent).select(*keys, F.col("given").alias("budget"))
    return leaves.join(given, list(LEVELS)).select(*LEVELS, "tokens", F.col("budget").alias("target"))


def mix_sources(
    docs: DataFrame,
    budget: float | None = None,
    max_epochs: int = 2,
    weights: dict[str, dict[str, float]] | None = None,
    seed: int = 23,
    domain: Column | None = None,
    max_broadcast_rows: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """``docs`` with ``mix_domain`` and ``mix_epoch`` appended (with underscores where names are taken): a row for each epoch that selects the document."""
    if any(w <= 0 for level in (weights or {}).values() for w in level.values()):
        raise ValueError("weights must be positive; leave a source out of the documents to give it nothing")
    names = docs.columns
    domain = domain_of(F.col("source").cast("string")) if domain is None else domain
    leaf = [
        domain.alias("domain"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
    ]
    skeleton = checkpointed(docs.select(*leaf, F.col("doc_id").alias("id"), token_count(F.col("text").cast("string")).alias("tokens")))
    supply = skeleton.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    targets = leaf_budgets(supply, budget, max_epochs, weights or {})
    goal = F.floor(F.col("target") + 1e-6).cast("long")
    plan = targets.filter("tokens > 0").select(
        *LEVELS, F.floor(goal / F.col("tokens")).cast("long").alias("whole"), (goal % F.col("tokens")).alias("rest")
    )
    plan = checkpointed(plan)
    n_leaves = plan.count()

    def with_plan(df: DataFrame, table: DataFrame) -> DataFrame:
        if n_leaves <= max_broadcast_rows:
            return df.join(F.broadcast(table), list(LEVELS))
        salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        return df.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(_SALTS)).cast("int")).join(salted, [*LEVELS, "salt"]).drop("salt")

    asked = with_plan(skeleton, plan).filter("rest > 0").withColumn("key", order_key(seed, F.col("whole"), F.col("id")))
    slices = asked.groupBy(*LEVELS, "rest", F.substring("key", 1, _DIGITS).alias("slice")).agg(F.sum("tokens").alias("tokens"))
    run = W.partitionBy(*LEVELS).orderBy("slice")
    slices = slices.withColumn("through", F.sum("tokens").over(run)).filter("through > rest")
    cut = slices.groupBy(*LEVELS).agg(F.min("slice").alias("slice"), F.min(F.struct("slice", (F.col("through") - F.col("tokens")).alias("before")))["before"].alias("before"))
    cut = checkpointed(cut)
    near = with_plan(asked, cut).filter(F.substring("key", 1, _DIGITS) == F.col("slice"))
    summed = near.withColumn("through", F.col("before") + F.sum("tokens").over(W.partitionBy(*LEVELS).orderBy("key")))
    last = summed.filter("through <= rest").groupBy(*LEVELS).agg(F.max("key").alias("last"))
    cuts = plan.join(cut.join(last, list(LEVELS), "left").select(*LEVELS, F.coalesce("last", "slice").alias("last")), list(LEVELS), "left")
    cuts = checkpointed(cuts.select(*LEVELS, "whole", F.coalesce("last", F.lit("")).alias("last")))

    placed = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), *leaf, F.col("doc_id").alias("id"))
    chosen = with_plan(placed, cuts).withColumn("times", F.col("whole") + (order_key(seed, F.col("whole"), F.col("id")) <= F.col("last")).cast("long"))
    epochs = chosen.filter("times > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)))
    return epochs.select("row.*", "domain", "epoch").toDF(*names, *free_names(names, ["mix_domain", "mix_epoch"]))
