"""Global shuffle of records into shards, in two passes.

Pass one scatters the records uniformly into buckets by a seeded hash of their
content; buckets are small enough for a task's memory, and their number follows from
the bytes there are.  Pass two Fisher-Yates shuffles each bucket (Spark's own
``shuffle``).  Buckets one after another make one uniform order of all records; the record at
place ``p`` goes to shard ``p mod n`` at slot ``p div n``.  So shards differ by one row at
most (law ``rows``), and slots have no gaps.

Equal records are counted, not listed, before the first shuffle, and each copy is scattered by
its own number: a record that makes up a third of the input fills no bucket.  The
hash depends on the content alone, so a task that is run again scatters alike.
Bucket ``b`` is partition ``b`` (``repartitionById``), which seeds its shuffle: the result
depends on the content, the seed and the number of buckets, not on the layout of the input.

Where each bucket starts is a small table (a row a bucket, ``MAX_BUCKETS`` at most, and larger buckets beyond) that is broadcast; the driver sees one number.

Defined results: a null text has no bytes (size 8, CRC 0); null ids scatter as a value of their own;
an empty table gives no rows; columns that rows can't be grouped by (maps) are told apart by a digest of their JSON; where a carried
column has the name of one that is added, the added one gets an underscore.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm._spark import free_names, groupable, pieces

BUCKET_BYTES = 32 << 20
MIN_BUCKETS, MAX_BUCKETS = 64, 1_000_000
_RANGE = 1000  # buckets whose starts one task sums
_ROW_BYTES = 64
_MANY = 4096


def shard_records(
    records: DataFrame,
    n_shards: int = 24,
    seed: int = 17,
    carry: list[str] | None = None,
    text: str = "text",
    bucket_bytes: int = BUCKET_BYTES,
    min_buckets: int = MIN_BUCKETS,
) -> DataFrame:
    """The carried columns (all, unless named) of every record with ``size, text_crc32, law, shard, slot, grown_shard``."""
    at = list(range(len(records.columns))) if carry is None else [records.columns.index(c) for c in carry]
    names = [records.columns[i] for i in at]
    plain = records.toDF(*(f"c{i}" for i in range(len(records.columns))))
    source = F.col(f"c{records.columns.index(text)}").cast("string")
    has_text = records.columns.index(text) in at
    others = [i for i in at if records.columns[i] != text]
    loose = [f"c{i}" for i in others if not groupable(plain.schema[i].dataType)]  # known by a digest, carried like the text
    keys = [f"c{i}" for i in others if f"c{i}" not in loose]
    digest = [
        (F.coalesce(F.octet_length(source), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(source), F.lit(0)).cast("long").alias("crc"),
        F.xxhash64(source).alias("mark"),
        source.isNull().alias("no_text"),
    ]
    digest += [F.sha2(F.to_json(F.struct(c)), 256).alias(f"{c}_mark") for c in loose]
    bodies = [*loose, *(["body"] if has_text else [])]
    rows = plain.select(*keys, *digest, *loose, *([source.alias("body")] if has_text else []))
    by = [*keys, "size", "crc", "mark", "no_text", *(f"{c}_mark" for c in loose)]

    weight = (F.col("size") if has_text else F.lit(0)) + _ROW_BYTES
    total = plain.select(*digest).agg(F.sum(weight)).first()[0] or 0
    n_buckets = pieces(int(total), max(bucket_bytes, int(total) // MAX_BUCKETS), min_buckets)

    def scattered(df: DataFrame, *kept) -> DataFrame:
        """A row a copy, with its bucket; copies are laid out in two steps, so no array grows with their number."""
        lots = df.withColumn("lot", F.explode(F.expr(f"sequence(0L, (n - 1) div {_MANY})")))
        copies = lots.withColumn("copy", F.explode(F.expr(f"sequence(lot * {_MANY}, least(n, (lot + 1) * {_MANY}) - 1)")))
        bucket = F.pmod(F.xxhash64(F.lit(seed), *(F.col(c) for c in by), F.col("copy")), F.lit(n_buckets)).cast("int")
        return copies.select(bucket.alias("bucket"), *by, "copy", *kept)

    sizes = scattered(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))).groupBy("bucket").agg(F.count(F.lit(1)).alias("held"))
    sizes = sizes.withColumn("range", F.expr(f"bucket div {_RANGE}"))
    earlier = F.coalesce(F.sum("held").over(W.partitionBy("range").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = sizes.groupBy("range").agg(F.sum("held").alias("held"))
    through = F.coalesce(F.sum("held").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("range", through.alias("first"))  # MAX_BUCKETS / _RANGE rows at most
    starts = sizes.withColumn("earlier", earlier).join(F.broadcast(ranges), "range").select("bucket", (F.col("first") + F.col("earlier")).alias("before"))

    copies = scattered(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(F.first(c).alias(c) for c in bodies)), *bodies)
    fields = [F.xxhash64(*by, "copy").alias("order"), *(F.col(c) for c in by), F.col("copy"), *(F.col(c) for c in bodies)]
    buckets = copies.repartitionById(n_buckets, F.col("bucket")).groupBy("bucket").agg(F.collect_list(F.struct(*fields)).alias("held"))
    # Maps can't be compared: with them, only the order's hash is.
    by_hash = lambda a, b: F.when(a["order"] < b["order"], -1).when(a["order"] > b["order"], 1).otherwise(0)
    in_order = F.array_sort("held", by_hash) if loose else F.array_sort("held")
    placed = buckets.join(F.broadcast(starts), "bucket").select("before", F.posexplode(F.shuffle(in_order, F.lit(seed))).alias("pos", "r"))
    placed = placed.withColumn("place", F.col("before") + F.col("pos"))
    out = [F.col("r.body" if records.columns[i] == text else f"r.c{i}") for i in at]
    return placed.select(
        *out,
        F.col("r.size"),
        F.col("r.crc"),
        F.lit("rows"),
        (F.col("place") % n_shards).cast("int"),
        F.expr(f"place div {n_shards}"),
        F.lit(None).cast("int"),
    ).toDF(*names, *free_names(names, ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard, rows in the order of their slots within each file; files hold ranges of slots."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
