"""Numbered segments in a folder: what the stored indexes share.

A segment is a folder of data and, written last, a small table ``documents`` with a row a key: what the key's data is known by, null for
a key that is deleted.  A later segment supersedes an earlier one's keys, and one of kind ``whole`` stands for all before it.  One writer at
a time; readers see a segment once its table of documents is there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import saved


class Segments:
    #: Type of the keys, and name and type of the column that is null for deletions.
    KEY, HELD, HELD_TYPE = "string", "held", "int"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._kinds: dict[int, str] = {}

    def _segments(self) -> list[int]:
        """Numbers of the complete segments that count."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        found = {}
        for name in names:
            number, _, kind = name.partition("-")
            done = fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/documents/_SUCCESS"))
            if number.isdigit() and done:
                found[int(number)] = kind
        first = max((n for n, kind in found.items() if kind == "whole"), default=0)
        self._kinds = found
        return sorted(n for n in found if n >= first)

    def _folder(self, number: int, kind: str) -> str:
        return f"{self.path}/{number:09d}-{kind}"

    def _next(self) -> int:
        return max(self._segments(), default=0) + 1

    def _paths(self, table: str) -> list[str]:
        return [f"{self._folder(n, self._kinds[n])}/{table}" for n in self._segments() if table == "documents" or self._kinds[n] != "gone"]

    def _complete(self, number: int, kind: str, docs: DataFrame) -> None:
        """Writes the documents ``key`` and what they are known by; the segment counts from then on."""
        docs.select("key", self.HELD, F.lit(number).cast("long").alias("segment")).write.mode("overwrite").parquet(f"{self._folder(number, kind)}/documents")

    def _all_documents(self) -> DataFrame:
        paths, schema = self._paths("documents"), f"key {self.KEY}, {self.HELD} {self.HELD_TYPE}, segment long"
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def documents(self) -> DataFrame:
        """The documents there are: of each key the latest row, unless that is a deletion."""
        rows = self._all_documents()
        if len(self._segments()) > 1:
            rows = rows.groupBy("key").agg(F.max_by(self.HELD, "segment").alias(self.HELD), F.max("segment").alias("segment"))
        return rows.filter(F.col(self.HELD).isNotNull())

    def add(self, docs: DataFrame) -> None:
        raise NotImplementedError

    def delete(self, keys: DataFrame) -> None:
        """Takes the documents of ``key`` out."""
        gone = keys.select(F.col("key").cast(self.KEY).alias("key"), F.lit(None).cast(self.HELD_TYPE).alias(self.HELD)).distinct()
        self._complete(self._next(), "gone", gone)

    def sync(self, docs: DataFrame) -> None:
        """Makes the index hold just ``docs``, whose keys change with their contents: what lacks is added, what is gone deleted."""
        docs = docs.withColumn("key", F.col("key").cast(self.KEY))
        there = saved(self.documents().select("key"))
        gone = saved(there.join(docs.select("key"), "key", "left_anti"))
        new = docs.join(there, "key", "left_anti")
        if not gone.isEmpty():
            self.delete(gone)
        if not new.isEmpty():
            self.add(new)
