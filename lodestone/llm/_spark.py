"""Spark helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from lodestone.session import ensure_checkpoint_dir
from lodestone.session import saved as checkpointed

__all__ = ["ascii_lower", "checkpointed", "ensure_checkpoint_dir", "free_names", "groupable", "pieces", "shuffle_width", "text_bytes"]


def free_names(taken: list[str], wanted: list[str]) -> list[str]:
    """The wanted names, each with as many underscores as it takes to differ (also without case) from those taken and from one another."""
    used, out = {n.lower() for n in taken}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def groupable(kind: DataType) -> bool:
    """Whether rows can be grouped by a column of this type."""
    if isinstance(kind, ArrayType):
        return groupable(kind.elementType)
    if isinstance(kind, StructType):
        return all(groupable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (MapType, VariantType))


def text_bytes(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Rows and UTF-8 bytes of a text column, over all rows."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.col(text))).alias("b")).first()
    return int(row["n"] or 0), int(row["b"] or 0)


def pieces(n_bytes: int, each: int, least: int = 1) -> int:
    """How many pieces of about ``each`` bytes hold ``n_bytes``."""
    return max(least, -(-n_bytes // each))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased; every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
