"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's documents; what a stage has read is deleted once its own result is written.

All stages keep the columns of ``docs``, also those with names that a stage uses itself, take texts of any length, and give no rows
for an empty table.  What they do with nulls, repeated rows and ties is stated at each.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm._spark import ensure_checkpoint_dir
from lodestone.llm.decontaminate import drop_contaminated
from lodestone.llm.mixture import mix_sources
from lodestone.llm.ngram_join import keep_one_of_each
from lodestone.llm.sharding import shard_records
from lodestone.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more go.

    A null or empty text scores the classifier's bias; rows are judged one by one, so repeated ones fare alike; without any
    usable label all stay.
    """
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by their five-word shingles, that of the smallest id stays.

    Of rows that repeat an id and a text one stays, of an id with several texts each is judged by itself; a text without an id stays only
    if no copy of it has one, and then in one row.  Null, empty and blank texts are linked with nothing.
    """
    return keep_one_of_each(docs, n=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item, or all of a shorter one, go.

    Null and empty texts, and items without words, match nothing; rows are judged one by one.
    """
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as there are, dealt evenly down the tree, of two epochs of a leaf at most; a row an epoch.

    Null languages and sources are leaves of their own; a leaf without any word is selected not at all; rows of equal id, and those without one,
    stay together, for the order within a leaf is by id.
    """
    return mix_sources(docs, max_epochs=2).select(*docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All records in one global random order, dealt to 24 shards.

    Null texts have no bytes; repeated rows are scattered like others, each by its number.
    """
    return shard_records(docs, n_shards=24)


STAGES = [
    ("toxicity", toxicity),
    ("ngram_jaccard_join", near_duplicates),
    ("decontamination", decontamination),
    ("source_mixture", mixing),
    ("sharding", sharding),
]

#: The classifier is not expressible in SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; what each returns is written to the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4()}"
    docs, read = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if read is not None:
            _delete(spark, read)
        read = f"{folder}/{name}"
        docs = spark.read.parquet(read)
    return STAGES[-1][1](spark, docs, sf_dir)
