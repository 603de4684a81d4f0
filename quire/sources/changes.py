"""Scans of a folder that read only the files which are new or changed since the last one.

A scan lists the names of a folder in one task, as a folder is one list; other tasks look up their lengths and times,
which are joined to the listing of the last committed scan. Contents of changed files are then read by all tasks.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from fnmatch import fnmatchcase
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.operators.overlay import with_keys
from quire.sources.store import Store
from quire.sources.uri import located

LISTING = "path string, file_name string, length long, mtime timestamp"


#: Names that a task gives on at once, and bytes of contents.
_NAMES, _GIVEN_ON = 10_000, 4 << 20


def _located(folder: str) -> tuple[fs.FileSystem, str]:
    """As located, for paths as Hadoop writes them too (file:/a)."""
    return located(folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder)


def _names(store: fs.FileSystem, base: str) -> Iterator[str]:
    if isinstance(store, fs.LocalFileSystem):
        with os.scandir(base) as found:
            yield from (x.name for x in found)
    else:
        yield from (x.base_name for x in store.get_file_info(fs.FileSelector(base)))


def _spread(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def listing(spark: SparkSession, folder: str, glob: str = "*.[tT][xX][tT]") -> DataFrame:
    """(path, file_name, length, mtime) of the files in a folder, not below it and not hidden; a missing folder has none."""
    at = Store(spark, folder)
    if not at.exists():
        return spark.createDataFrame([], LISTING)
    whole = at.qualified()

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = (n for n in _names(*_located(whole)) if fnmatchcase(n, glob) and not n.startswith(".") and ("=" in n or not n.startswith("_")))
            for _ in range(b.num_rows):
                while part := list(islice(kept, _NAMES)):
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.string())], names=["file_name"])

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _located(whole)
        for b in batches:
            found = [x for x in store.get_file_info([f"{base}/{n}" for n in b.column(0).to_pylist()]) if x.type == fs.FileType.File]
            # times to the millisecond, as file systems of all kinds tell them
            columns = [[f"{whole}/{x.base_name}" for x in found], [x.base_name for x in found], [x.size for x in found], [x.mtime_ns // 1_000_000 * 1000 for x in found]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.timestamp("us", "UTC")))], names=["path", "file_name", "length", "mtime"])

    return spark.range(0, 1, 1, 1).mapInArrow(names, "file_name string").repartition(_spread(spark)).mapInArrow(told, LISTING)


def contents(files: DataFrame) -> DataFrame:
    """files (path, ...) with content, dealt to all tasks and read by them; a file that has gone meanwhile is null."""
    names = files.columns
    at = names.index("path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: dict[str, tuple[fs.FileSystem, str]] = {}
        for b in batches:
            held, size, first = [], 0, 0
            for i, path in enumerate(b.column(at).to_pylist()):  # files are given on in batches of a few MB
                folder, _, name = path.rpartition("/")
                if folder not in places:
                    places[folder] = _located(folder)
                store, base = places[folder]
                try:
                    with store.open_input_stream(f"{base}/{name}") as f:
                        held.append(f.read())
                except FileNotFoundError:
                    held.append(None)
                size += len(held[-1] or b"")
                if size >= _GIVEN_ON or i + 1 == b.num_rows:
                    yield pa.RecordBatch.from_arrays([*b.slice(first, len(held)).columns, pa.array(held, pa.binary())], names=[*names, "content"])
                    held, size, first = [], 0, i + 1

    spread = files.repartition(_spread(files.sparkSession))
    return spread.mapInArrow(read, T.StructType([*files.schema.fields, T.StructField("content", T.BinaryType())]))


class Scans:
    """The scans of one folder; their listings lie in a state folder, each whole or not there."""

    def __init__(self, spark: SparkSession, folder: str, state: str):
        self.spark, self.folder, self.store = spark, folder, Store(spark, state)

    def last(self) -> DataFrame:
        """The listing of the last committed scan, empty before the first."""
        done = [n for n in self.store.names() if n.endswith(".scan")]
        return self.spark.read.schema(LISTING).parquet(self.store.at(self.store.read(done[-1]))) if done else self.spark.createDataFrame([], LISTING)

    def changes(self) -> tuple[str, DataFrame]:
        """(ticket, changes): changes has path, file_name, length, mtime and change, ``new``, ``changed`` or ``gone``, of this scan against the last
        committed one. Length and time tell; commit(ticket) makes this scan the last, once its changes have been taken in."""
        ticket = f"listing-{uuid.uuid4().hex}"
        listing(self.spark, self.folder).write.parquet(self.store.at(ticket))
        now = self.spark.read.schema(LISTING).parquet(self.store.at(ticket))
        old = self.last().select("path", *[F.col(c).alias(f"_{c}") for c in ("file_name", "length", "mtime")])
        both = now.join(old, "path", "full_outer")
        change = F.when(F.col("_length").isNull(), F.lit("new")).when(F.col("length").isNull(), F.lit("gone")).when((F.col("length") != F.col("_length")) | (F.col("mtime") != F.col("_mtime")), F.lit("changed"))
        rows = both.withColumn("change", change).where("change is not null")
        return ticket, rows.select("path", *[F.coalesce(c, f"_{c}").alias(c) for c in ("file_name", "length", "mtime")], "change")

    def commit(self, ticket: str) -> None:
        """Make a scan the last one and delete what earlier scans and unfinished ones left."""
        done = [n for n in self.store.names() if n.endswith(".scan")]
        if not self.store.commit(f"{len(done) and int(done[-1][:-5]) + 1:020d}.scan", ticket):
            raise RuntimeError("another scan was committed meanwhile")
        for name in self.store.names():
            if name in done or name.startswith("listing-") and name != ticket:
                self.store.delete(name)


def changed_chapters(changes: DataFrame, work_id: str) -> DataFrame:
    """(work_id, file_name, change, text, mtime, prefix, ord, chapter_key): the new and changed chapters of a scan with their texts, those that have gone with null."""
    there = contents(changes.where("change <> 'gone'")).withColumn("text", F.decode("content", "UTF-8")).drop("content")
    rows = there.unionByName(changes.where("change = 'gone'").withColumn("text", F.lit(None).cast("string")))
    return with_keys(rows.select(F.lit(work_id).alias("work_id"), "file_name", "change", "text", "mtime"))
