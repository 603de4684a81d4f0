"""Small files of a store that Spark can reach: listing, reading and committing them through Hadoop's FileSystem, on the driver."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Store:
    """A folder of any file system that Spark's session knows, by its URI or path."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str) -> str:
        return f"{self.folder}/{name}" if name else self.folder

    def qualified(self) -> str:
        """The folder as file systems name it, with its scheme."""
        return self._fs.makeQualified(self._path(self.folder)).toString()

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(self.at(name)))

    def names(self, name: str = "") -> list[str]:
        """Names in a folder, in order; none if it does not exist."""
        if not self.exists(name):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(self.at(name))))

    def files(self, name: str = "") -> list[tuple[str, int]]:
        """(path below the folder, bytes) of all files under a name."""
        if not self.exists(name):
            return []
        found, walk = [], self._fs.listFiles(self._path(self.at(name)), True)
        base = self._fs.makeQualified(self._path(self.folder)).toString() + "/"
        while walk.hasNext():
            s = walk.next()
            found.append((s.getPath().toString().removeprefix(base), s.getLen()))
        return sorted(found)

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(self.at(name)))
        try:
            return bytes(self.spark._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)).decode()
        finally:
            stream.close()

    def commit(self, name: str, text: str) -> bool:
        """Make a file whole or not at all: written aside, then renamed. False if the name is taken."""
        aside = self._path(self.at(f".{uuid.uuid4().hex}"))
        out = self._fs.create(aside, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        target = self._path(self.at(name))
        self._fs.mkdirs(target.getParent())
        done = not self._fs.exists(target) and self._fs.rename(aside, target)
        if not done:
            self._fs.delete(aside, False)
        return done

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(self.at(name)), True)
