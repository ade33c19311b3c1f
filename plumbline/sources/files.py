"""The few file operations a driver does: listing, checking and removing folders, small texts."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Folder:
    """Paths of any file system Spark can write to."""

    def __init__(self, spark: SparkSession):
        self._context = spark.sparkContext

    def _open(self, path):
        where = self._context._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self._context._jsc.hadoopConfiguration()), where

    def exists(self, path: str) -> bool:
        fs, where = self._open(path)
        return fs.exists(where)

    def children(self, path: str) -> list[str]:
        fs, where = self._open(path)
        if not fs.exists(where):
            return []
        return [status.getPath().getName() for status in fs.listStatus(where)]

    def read_text(self, path: str) -> str:
        fs, where = self._open(path)
        stream = fs.open(where)
        try:
            return self._context._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_text(self, path: str, text: str) -> None:
        """A new file that others see once it is complete."""
        part = f"{path}.{uuid.uuid4().hex}.tmp"
        fs, unfinished = self._open(part)
        stream = fs.create(unfinished)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if not fs.rename(unfinished, self._open(path)[1]):
            fs.delete(unfinished, False)
            raise FileExistsError(path)

    def size(self, path: str) -> int:
        """Bytes of all files in a folder."""
        fs, where = self._open(path)
        return fs.getContentSummary(where).getLength()

    def remove(self, path: str) -> None:
        fs, where = self._open(path)
        fs.delete(where, True)

    def remove_uri(self, uri: str) -> None:
        """A folder as Spark reports it in file metadata, with escaped characters."""
        fs, where = self._open(self._context._jvm.java.net.URI(uri))
        fs.delete(where, True)
