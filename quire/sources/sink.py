"""A sink that writes each row as a file of exactly the name it carries, to any file system that Arrow knows.

Spark's writers choose their own file names. This one is a Python data source for tables
(file_name string, part_no long, content binary): tasks write into a staging folder below the target,
which must be shared by all executors, and a list of its files beside them. When all tasks have succeeded the driver
writes the names of these lists into the staging folder, and a second job moves the files, a list in a task. So a
driver that dies between two moves leaves what ``finish`` completes; a job that fails leaves the target as it was.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from quire.sources.uri import located

STAGE = ".stage-"
#: In a staging folder: all its files are whole and belong to the target; the names of lists of moves, or moves.
MOVES = "_moves.json"
#: Files of a list, which a task moves.
LISTED = 10_000


@dataclass
class _Written(WriterCommitMessage):
    lists: list[str]  # files in the staging folder, of pairs of staged name and final name


class _Writer(DataSourceWriter):
    def __init__(self, folder: str, stage: str):
        self.folder, self.stage = folder, stage

    def write(self, iterator) -> WriterCommitMessage:
        store, base = located(self.folder)
        store.create_dir(f"{base}/{self.stage}", recursive=True)
        names, lists, last, out = [], [], None, None

        def note() -> None:
            lists.append(f"_list-{uuid.uuid4().hex}.json")
            with store.open_output_stream(f"{base}/{self.stage}/{lists[-1]}") as f:
                f.write(json.dumps(names).encode())
            names.clear()

        for row in iterator:
            if out is not None and row.part_no is not None and row.file_name == last[0] and row.part_no > last[1]:
                out.write(bytes(row.content or b""))
                last = (row.file_name, row.part_no)
                continue
            if os.path.basename(row.file_name) != row.file_name or row.file_name in ("", ".", ".."):
                raise ValueError(f"not a plain file name: {row.file_name!r}")
            staged = uuid.uuid4().hex  # a task that runs twice never meets its own files
            if out is not None:
                out.close()
            out, last = store.open_output_stream(f"{base}/{self.stage}/{staged}"), (row.file_name, row.part_no)
            out.write(bytes(row.content or b""))
            names.append((staged, row.file_name))
            if len(names) == LISTED:
                note()
        if out is not None:
            out.close()
        if names:
            note()
        return _Written(lists)

    def commit(self, messages) -> None:
        store, base = located(self.folder)
        store.create_dir(f"{base}/{self.stage}", recursive=True)
        with store.open_output_stream(f"{base}/{self.stage}/{MOVES}") as f:
            f.write(json.dumps([x for m in messages if m for x in m.lists]).encode())

    def abort(self, messages) -> None:
        _gone(*located(self.folder), self.stage)


def _gone(store: fs.FileSystem, base: str, stage: str) -> None:
    if store.get_file_info(f"{base}/{stage}").type != fs.FileType.NotFound:
        store.delete_dir(f"{base}/{stage}")


def _read(store: fs.FileSystem, path: str) -> list:
    with store.open_input_stream(path) as f:
        return json.loads(f.read())


def _move(store: fs.FileSystem, base: str, stage: str, moves: list) -> None:
    """Move staged files to their names; those that are moved already are not there."""
    for staged, name in moves:
        try:
            store.move(f"{base}/{stage}/{staged}", f"{base}/{name}")
        except OSError:
            if store.get_file_info(f"{base}/{stage}/{staged}").type != fs.FileType.NotFound:
                raise


def _moved(store: fs.FileSystem, base: str, stage: str) -> None:
    """Move the files of a whole staging folder to their names."""
    for x in _read(store, f"{base}/{stage}/{MOVES}"):
        _move(store, base, stage, _read(store, f"{base}/{stage}/{x}") if isinstance(x, str) else [x])
    _gone(store, base, stage)


def finish(folder: str) -> None:
    """Complete what a job that died while it moved its files left behind, and delete what failed jobs staged; no job may be writing."""
    store, base = located(folder)
    for x in store.get_file_info(fs.FileSelector(base, allow_not_found=True)):
        if x.base_name.startswith(STAGE):
            whole = store.get_file_info(f"{base}/{x.base_name}/{MOVES}").type == fs.FileType.File
            _moved(store, base, x.base_name) if whole else _gone(store, base, x.base_name)


class NamedFiles(DataSource):
    """Format quire_files; options path, the target folder, and stage, the name of its staging folder. Neighbouring rows of one name with rising part_no are one file."""

    @classmethod
    def name(cls) -> str:
        return "quire_files"

    def schema(self) -> str:
        return "file_name string, part_no long, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], self.options["stage"])


def write_files(files: DataFrame, folder: str) -> None:
    """Write files (file_name, content string or binary) into a shared folder, by path or URI; equal names: one of them stays."""
    _save(files.selectExpr("file_name", "cast(null as long) as part_no", "cast(content as binary) as content"), folder)


def write_parts(parts: DataFrame, folder: str, by: str = "work_id") -> None:
    """Write files of which parts (by, file_name, part_no, content) are the bytes in order, one file for each ``by``; equal names: one of them stays.

    A task holds one part at a time, of however large a file.
    """
    ordered = parts.repartition("file_name").sortWithinPartitions("file_name", by, "part_no")
    _save(ordered.selectExpr("file_name", "cast(part_no as long) as part_no", "cast(content as binary) as content"), folder)


def _save(files: DataFrame, folder: str) -> None:
    spark = files.sparkSession
    spark.dataSource.register(NamedFiles)
    store, base = located(folder)
    store.create_dir(base, recursive=True)
    stage = f"{STAGE}{uuid.uuid4().hex}"
    files.write.format("quire_files").option("path", folder).option("stage", stage).mode("append").save()

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, at = located(folder)
            for x in b.column(0).to_pylist():
                _move(own, at, stage, _read(own, f"{at}/{stage}/{x}"))
            yield b

    lists = _read(store, f"{base}/{stage}/{MOVES}")
    if lists:
        spark.createDataFrame([(x,) for x in lists], "list string").repartition(len(lists)).mapInArrow(move, "list string").foreach(lambda _: None)
    _gone(store, base, stage)
