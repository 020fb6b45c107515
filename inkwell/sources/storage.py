"""Files on any file system that Spark reaches, from the driver; bulk data are moved by Spark jobs, not by this."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession

CHUNK = 1 << 20


class Store:
    """Reads, writes, renames and deletes files by path, with the schemes that the session knows."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        where = self.jvm.org.apache.hadoop.fs.Path(path)
        fs = where.getFileSystem(self.conf)
        if fs.getScheme() == "file":
            fs = fs.getRaw()  # without checksum files, which would refuse a page that somebody edits by hand
        return fs, where

    def exists(self, path: str) -> bool:
        fs, where = self._at(path)
        return fs.exists(where)

    def names(self, folder: str) -> list[str]:
        """Names in a folder, in order; none if it is not there."""
        fs, where = self._at(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []

    def read(self, path: str) -> str:
        fs, where = self._at(path)
        stream = fs.open(where)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, parts: str | Iterable[str]) -> None:
        """Write a text, or its parts one after another; the folders above are made."""
        fs, where = self._at(path)
        stream, held, size = fs.create(where, True), [], 0
        try:
            for part in [parts] if isinstance(parts, str) else parts:
                held.append(part.encode())
                size += len(held[-1])
                if size >= CHUNK:
                    stream.write(b"".join(held))
                    held, size = [], 0
            stream.write(b"".join(held))
        finally:
            stream.close()

    def rename(self, old: str, new: str) -> None:
        """Move a file to a name that is free; the folders above it are made."""
        fs, src = self._at(old)
        dst = self.jvm.org.apache.hadoop.fs.Path(new)
        fs.mkdirs(dst.getParent())
        if not fs.rename(src, dst):
            raise OSError(f"cannot move {old} to {new}")

    def delete(self, path: str) -> bool:
        """Delete a file, or a folder with all in it; False if nothing was there."""
        fs, where = self._at(path)
        return fs.delete(where, True)
