"""Folders by path or URI, as Python workers reach them: local, or any file system that Arrow knows (file:, hdfs:, s3:, ...)."""

from __future__ import annotations

from pyarrow import fs


def located(folder: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it) of a folder."""
    store, base = fs.FileSystem.from_uri(folder) if folder.startswith("file:") or "://" in folder else (fs.LocalFileSystem(), folder)
    return store, base.rstrip("/")
