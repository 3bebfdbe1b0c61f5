"""The chunk table: upsert, delete, rollup.  Vectors and tokens stand beside each chunk, and statistics are derived from them, so nothing can drift apart."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.session import saved

CHUNK_SCHEMA = (
    "chunk_id string, source_path string, filename string, mtime double, original_url string, original_chunk_index int, "
    "filtered_chunk_index int, chunk_char_length int, effective_length int, processing_mode string, text string, embedding array<float>, tokens array<string>"
)
#: Parts of a table that are replaced as wholes, by the hash of a source's identifier, and files a part is written to at most.
N_PARTS, SPREAD = 64, 16
_TRIES = 20


def upserted(current: DataFrame, new: DataFrame, key: str = "chunk_id", version: str = "version") -> DataFrame:
    """Both tables' rows, of each key the one with the largest version; of equal versions a new row, and of those the one with the largest hash."""
    order = W.partitionBy(key).orderBy(F.desc(version), F.desc("is_new"), F.desc(F.xxhash64(*[c for c in current.columns if c != key])))
    current, new = current.withColumn("is_new", F.lit(0)), new.withColumn("is_new", F.lit(1))
    both = current.unionByName(new).withColumn("nth", F.row_number().over(order))
    return both.filter("nth = 1").drop("nth", "is_new")


def without(current: DataFrame, ids: DataFrame, key: str = "chunk_id") -> DataFrame:
    return current.join(ids.select(key).distinct(), key, "left_anti")


def identifier() -> Column:
    """What a chunk's source is known by: its url, else its path."""
    return F.coalesce(F.when(F.trim("original_url") != "", F.trim("original_url")), F.when(F.trim("source_path") != "", F.trim("source_path")))


def source_rollup(chunks: DataFrame) -> DataFrame:
    """A row a source: identifier, url, path, file name, chunks, latest modification time, and whether it is a url."""
    rows = chunks.withColumn("identifier", identifier()).filter("identifier is not null")
    first = lambda c: F.min_by(c, F.struct("filtered_chunk_index", "chunk_id"))
    return rows.groupBy("identifier").agg(
        F.max(F.when(F.trim("original_url") != "", F.trim("original_url"))).alias("original_url"),
        first("source_path").alias("source_path"),
        first("filename").alias("filename"),
        F.count(F.lit(1)).alias("chunk_count"),
        F.max("mtime").alias("mtime"),
        F.max(F.coalesce(F.trim("original_url") != "", F.lit(False))).alias("is_url_source"),
    )


class Conflict(RuntimeError):
    """Another writer has committed first, again and again."""


class Damaged(RuntimeError):
    """A manifest that can't be read."""


def renamed(spark: SparkSession, source: str, target: str) -> bool:
    """Gives a file another name unless that is taken, in one step; whether it did."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    source, target = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    fs = source.getFileSystem(conf)
    try:
        if fs.getUri().getScheme() == "file":  # there a rename replaces, but a link doesn't
            local = lambda p: jvm.java.nio.file.Path.of(fs.makeQualified(p).toUri())
            jvm.java.nio.file.Files.createLink(local(target), local(source))
        else:
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
            context.rename(source, target, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        return True
    except Py4JJavaError:
        if fs.exists(target):
            return False
        raise


class ChunkStore:
    """A chunk table in a folder, in parts by the hash of the source.

    A write makes new folders for the parts that it changes, and then one manifest, a small file with the
    next number that names every part's folder.  It is written whole under another name and then given its number in one step
    that fails where the number is taken (``commit``), and is never changed: a reader takes the one of the highest number and sees one version
    whole; of two writers the second starts again from the version that it lost to.

    ``commit`` takes the session and both names and says whether it got the number.  The default renames, or links in a local
    folder; a store whose renames aren't atomic needs one of its own.  A newest manifest that can't be read was damaged later:
    reads and writes fail until ``drop_damaged`` is called, which goes back to the version before.
    """

    def __init__(self, spark: SparkSession, path: str, n_parts: int = N_PARTS, commit: Callable[[SparkSession, str, str], bool] | None = None) -> None:
        self.spark, self.path, self.n_parts, self.commit = spark, path.rstrip("/"), n_parts, commit or renamed

    def _hadoop(self, path: str):
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return found, found.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        folder, fs = self._hadoop(f"{self.path}/manifests")
        names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted((int(n) for n in names if n.isdigit()), reverse=True)

    def _read(self, version: int) -> dict:
        rows = self.spark.read.text(f"{self.path}/manifests/{version:012d}").collect()  # one line
        try:
            found = json.loads(rows[0][0])
            return {"n_parts": int(found["n_parts"]), "parts": dict(found["parts"])}
        except (IndexError, KeyError, TypeError, ValueError) as error:
            raise Damaged(f"{self.path}/manifests/{version:012d}") from error

    def _manifest(self) -> tuple[int, dict]:
        """The number to write next, and the newest manifest: its number of parts and their folders."""
        versions = self._versions()
        return (versions[0] + 1, self._read(versions[0])) if versions else (1, {"n_parts": self.n_parts, "parts": {}})

    def drop_damaged(self) -> int:
        """Deletes the newest manifests that can't be read, down to one that can; how many went.  Not while others write."""
        gone = 0
        for version in self._versions():
            try:
                self._read(version)
                break
            except Damaged:
                path, fs = self._hadoop(f"{self.path}/manifests/{version:012d}")
                fs.delete(path, False)
                gone += 1
        return gone

    def _folders(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(CHUNK_SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], CHUNK_SCHEMA)

    def read(self) -> DataFrame:
        return self._folders(sorted(self._manifest()[1]["parts"].values()))

    def _publish(self, version: int, manifest: dict) -> bool:
        """Whether this writer got the number."""
        written = f"{self.path}/manifests/_{uuid.uuid4()}"
        path, fs = self._hadoop(written)
        out = fs.create(path, False)
        out.write(bytearray(json.dumps(manifest).encode() + b"\n"))
        out.close()
        try:
            return self.commit(self.spark, written, f"{self.path}/manifests/{version:012d}")
        finally:
            fs.delete(path, False)

    def _part(self, n_parts: int) -> Column:
        return F.pmod(F.xxhash64(identifier()), F.lit(n_parts)).cast("int")

    def _update(self, sources: DataFrame, new: DataFrame | None, needs_old: bool = False) -> bool:
        """Takes the rows of ``sources`` (``identifier``) out, puts ``new`` in, and touches only the parts where either is.

        False, and nothing is written, where ``needs_old`` and there was no row to take out.
        """
        for _ in range(_TRIES):
            version, manifest = self._manifest()
            n_parts, parts = manifest["n_parts"], manifest["parts"]
            touched = [r[0] for r in sources.select(F.pmod(F.xxhash64("identifier"), F.lit(n_parts)).cast("int").alias("p")).distinct().collect()]  # n_parts at most
            current = self._folders([parts[str(p)] for p in touched if str(p) in parts]).withColumn("identifier", identifier())
            if needs_old and current.join(sources, "identifier", "left_semi").isEmpty():
                return False
            rows = current.join(sources, "identifier", "left_anti").drop("identifier")
            if new is not None:
                rows = rows.unionByName(new.dropDuplicates(["chunk_id"]), allowMissingColumns=True)
            folder = f"{self.path}/data/{uuid.uuid4()}"
            placed = rows.withColumn("part", self._part(n_parts)).repartition("part", F.pmod(F.xxhash64("chunk_id"), F.lit(SPREAD)))
            placed.sortWithinPartitions("part", "source_path", "filtered_chunk_index").write.partitionBy("part").parquet(folder)
            path, fs = self._hadoop(folder)
            written = {f.getPath().getName()[5:] for f in fs.listStatus(path) if f.getPath().getName().startswith("part=")}
            kept = {p: f for p, f in parts.items() if int(p) not in touched}
            if self._publish(version, {"n_parts": n_parts, "parts": kept | {p: f"{folder}/part={p}" for p in written}}):
                return True
            fs.delete(path, True)
        raise Conflict(self.path)

    def replace_sources(self, chunks: DataFrame) -> int:
        """New chunks take the place of all chunks of their sources; sources without any new chunk keep theirs."""
        chunks = saved(chunks)
        n = chunks.count()
        if n:
            self._update(chunks.select(identifier().alias("identifier")).distinct(), chunks)
        return n

    def remove_source(self, source: str) -> bool:
        """Whether there was such a source (a url or a path); its chunks are gone afterwards."""
        return self._update(self.spark.range(1).select(F.lit(source).alias("identifier")), None, needs_old=True)

    def vacuum(self, keep: int = 2) -> int:
        """Deletes all manifests but the newest ``keep`` and the folders that none of those names; how many folders went.  Not while others write."""
        versions = self._versions()
        used = set()
        for version in versions[:keep]:
            rows = self.spark.read.text(f"{self.path}/manifests/{version:012d}").collect()
            used |= {f.rsplit("/", 1)[0].rsplit("/", 1)[1] for f in json.loads(rows[0][0])["parts"].values()} if rows else set()
        for version in versions[keep:]:
            path, fs = self._hadoop(f"{self.path}/manifests/{version:012d}")
            fs.delete(path, False)
        folder, fs = self._hadoop(f"{self.path}/data")
        old = [f.getPath() for f in fs.listStatus(folder) if f.getPath().getName() not in used] if fs.exists(folder) else []
        for path in old:
            fs.delete(path, True)
        return len(old)

    def sources(self) -> DataFrame:
        return source_rollup(self.read())

    def count(self) -> int:
        return self.read().count()
