"""Streaming sources over files that change in place: lines of growing logs, and names that appear in a folder.

Both are Python data sources: ``tail`` follows files that are appended to, which Spark's own file source, made
for files that are complete when they appear, does not; ``listing`` follows a folder. Their paths are ones that the
driver and the executors mount, since a growing file has to be opened where it is written.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

BLOCK, SPLIT = 1 << 16, 1 << 26


def whole_lines(path: str) -> int:
    """Bytes of a file up to its last line end; 0 for a file without one or one that is not there."""
    try:
        with open(path, "rb") as f:
            at = f.seek(0, os.SEEK_END)
            while at > 0:
                low = max(0, at - BLOCK)
                f.seek(low)
                found = f.read(at - low).rfind(b"\n")
                if found >= 0:
                    return low + found + 1
                at = low
    except FileNotFoundError:
        pass
    return 0


@dataclass
class Bytes(InputPartition):
    """The lines of a file that begin within some bytes of a range that starts at a line."""

    path: str
    start: int
    begin: int
    end: int


class TailReader(DataSourceStreamReader):
    """Offsets are, for each file, the bytes that have been read; they always end a line."""

    def __init__(self, options: dict):
        self.pattern = options["path"]
        self.split = int(options.get("split", SPLIT))
        self.at_end = options.get("startingfrom", "start") == "end"

    def _paths(self) -> list[str]:
        found = glob.glob(f"{glob.escape(self.pattern)}/*") if os.path.isdir(self.pattern) else glob.glob(self.pattern)
        return sorted(p for p in found if os.path.isfile(p) and not os.path.basename(p).startswith((".", "_")))

    def initialOffset(self) -> dict:
        return self.latestOffset() if self.at_end else {}

    def latestOffset(self) -> dict:
        return {p: whole_lines(p) for p in self._paths()}

    def partitions(self, start: dict, end: dict) -> list[Bytes]:
        parts = []
        for path, most in sorted(end.items()):
            low = start.get(path, 0)
            if most < low:  # the file was replaced by a shorter one
                low = 0
            parts += [Bytes(path, low, k, min(k + self.split, most)) for k in range(low, most, self.split)]
        return parts

    def read(self, part: Bytes) -> Iterator[tuple]:
        with open(part.path, "rb") as f:
            at = f.seek(max(part.begin - 1, part.start))
            if part.begin > part.start:
                at += len(f.readline())  # it began in the bytes before
            while at < part.end:
                line = f.readline()
                if not line.endswith(b"\n"):
                    return
                yield part.path, at, line.rstrip(b"\r\n").decode("utf-8", "replace")
                at += len(line)


class TailSource(DataSource):
    """path, pos (the byte at which the line begins), value of whole lines, each once, also after a restart."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "path string, pos long, value string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)


@dataclass
class Names(InputPartition):
    folder: str
    names: list[str]


class ListingReader(DataSourceStreamReader):
    """Offsets are the names that have been seen; a folder of logs has few."""

    def __init__(self, options: dict):
        self.folder, self.pattern = options["path"], options.get("pattern", "*")
        self.before = [x for x in options.get("before", "").split("\n") if x]

    def initialOffset(self) -> dict:
        return {"names": self.before}

    def latestOffset(self) -> dict:
        return {"names": sorted(os.path.basename(p) for p in glob.glob(f"{glob.escape(self.folder)}/{self.pattern}"))}

    def partitions(self, start: dict, end: dict) -> list[Names]:
        known = {x.lower() for x in start["names"]}
        fresh = [x for x in end["names"] if x.lower() not in known]
        return [Names(self.folder, fresh)] if fresh else []

    def read(self, part: Names) -> Iterator[tuple]:
        for name in part.names:
            try:
                s = os.stat(f"{part.folder}/{name}")
            except FileNotFoundError:
                continue
            yield name, f"{part.folder}/{name}", datetime.fromtimestamp(s.st_mtime, timezone.utc), s.st_size


class ListingSource(DataSource):
    """name, path, modificationTime, length of files whose name, whatever its case, was not there before."""

    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return "name string, path string, modificationTime timestamp, length long"

    def streamReader(self, schema) -> ListingReader:
        return ListingReader(self.options)


def tail(spark: SparkSession, path: str, from_end: bool = False, split: int = SPLIT) -> DataFrame:
    """Lines of a growing file, of those that match a pattern, or of those in a folder, as a stream."""
    spark.dataSource.register(TailSource)
    return spark.readStream.format("tail").option("split", split).option("startingFrom", "end" if from_end else "start").load(path)


def new_files(spark: SparkSession, folder: str, pattern: str = "*", before: list[str] | None = None) -> DataFrame:
    """Files that appear in a folder beside those named ``before``, as a stream."""
    spark.dataSource.register(ListingSource)
    return spark.readStream.format("listing").option("pattern", pattern).option("before", "\n".join(before or [])).load(folder)
