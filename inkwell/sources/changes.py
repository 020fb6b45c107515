"""Changes to several files that take effect together or not at all.

New files are written below ``.changes`` in the base folder first. When all are there, a manifest names every file
to put, replace or delete; then files are renamed: an old one to the change's folder, a new one to its place.
A mark says that all is in place, and the change's folder is deleted. If a step fails, the renames are
undone in reverse; if the driver dies, :func:`recover` does so at the next start, or only cleans up if the mark is
there. So readers find the old state or the new one, but for the moments between the renames of a commit.

One writer at a time is assumed for a base folder. Renaming must be one step, as on HDFS and mounted file
systems. Files keep the usual mode, as they are made without temporary names of the operating system.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from urllib.parse import unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Store

FOLDER = ".changes"


class Changes:
    """Collects changes below ``base``; :meth:`commit` makes them. Targets are paths on the file system of ``base``."""

    def __init__(self, store: Store, base: str):
        self.store, self.root = store, f"{base.rstrip('/')}/{FOLDER}/{uuid.uuid4().hex}"
        self.steps: list[dict] = []

    def put(self, target: str, text: str | Iterable[str]) -> None:
        """Write a text that the driver has, or its parts."""
        staged = f"{self.root}/new/{len(self.steps)}"
        self.store.write(staged, text)
        self.adopt(target, staged)

    def adopt(self, target: str, staged: str) -> None:
        """A file that is written already, below the change's folder, goes to its place at the commit."""
        self.steps.append({"target": target, "staged": staged})

    def delete(self, target: str) -> None:
        self.steps.append({"target": target, "staged": None})

    def files_by_key(self, df: DataFrame, folder: str, key: str, text: str, suffix: str) -> int:
        """One file per row, named by its key, byte for byte its text; returns their number.

        Spark's text writer writes the files, a folder for each key, so any file system will do and a failed task
        leaves nothing behind. That writer ends a row with a line separator: texts are written without their last
        character, by last character, and that is the separator. Null keys or texts, keys that are no file
        names, and keys named twice are refused before the first write.
        """
        rows = df.select(F.col(key).cast("string").alias("_key"), F.col(text).alias("value")).cache()
        try:
            odd = F.col("_key").isNull() | F.col("value").isNull() | F.col("_key").isin("", ".", "..") | F.col("_key").rlike(r"[/\\]")
            if bad := rows.filter(odd).select("_key", F.col("value").isNull().alias("empty")).take(5):
                raise ValueError("no file for " + ", ".join(f"{r[0]!r}{' without text' if r[1] else ''}" for r in bad))
            if bad := rows.groupBy("_key").count().filter("count > 1").take(5):
                raise ValueError("named twice: " + ", ".join(r[0] for r in bad))
            last = rows.select(F.substring("value", -1, 1).alias("c")).distinct()
            before = len(self.steps)
            for c in sorted(r.c for r in last.toLocalIterator()):
                some, at = rows.filter(F.substring("value", -1, 1) == c), f"{self.root}/keyed-{len(self.steps)}"
                if c == "":
                    for r in some.select("_key").toLocalIterator():
                        self.put(f"{folder}/{r[0]}{suffix}", "")
                    continue
                body = some.withColumn("value", F.substr("value", F.lit(1), F.length("value") - 1))
                body.repartition("_key").write.partitionBy("_key").option("lineSep", c).text(at)
                for name in self.store.names(at):
                    if name.startswith("_key="):
                        [part] = [p for p in self.store.names(f"{at}/{name}") if p.startswith("part-")]
                        self.adopt(f"{folder}/{unquote(name.removeprefix('_key='))}{suffix}", f"{at}/{name}/{part}")
            return len(self.steps) - before
        finally:
            rows.unpersist()

    def commit(self) -> None:
        """Make all changes, or none: what fails before the mark is undone, and raised."""
        targets = [s["target"] for s in self.steps]
        if len(set(targets)) < len(targets):
            self.abandon()
            raise ValueError("a file is changed twice")
        try:
            for k, s in enumerate(self.steps):
                s |= {"old": f"{self.root}/old/{k}", "existed": self.store.exists(s["target"])}
            self.store.write(f"{self.root}/manifest.tmp", json.dumps(self.steps))
            self.store.rename(f"{self.root}/manifest.tmp", f"{self.root}/manifest.json")
            for s in self.steps:
                if s["existed"]:
                    self.store.rename(s["target"], s["old"])
                if s["staged"]:
                    self.store.rename(s["staged"], s["target"])
            self.store.write(f"{self.root}/done.tmp", "")
            self.store.rename(f"{self.root}/done.tmp", f"{self.root}/done")
        except BaseException:
            _settle(self.store, self.root)
            raise
        self.store.delete(self.root)

    def abandon(self) -> None:
        """Forget the changes before their commit."""
        self.store.delete(self.root)

    def __enter__(self) -> Changes:
        return self

    def __exit__(self, kind, *_) -> None:
        """Commit at the end of a block, unless it failed."""
        if kind is None:
            self.commit()
        else:
            self.abandon()


def _settle(store: Store, root: str) -> bool:
    """Bring one change to its old state, or to its new one if it was done; True if it was undone."""
    done, undone = store.exists(f"{root}/done"), False
    if not done and store.exists(f"{root}/manifest.json"):
        for s in reversed(json.loads(store.read(f"{root}/manifest.json"))):
            moved = s["staged"] and not store.exists(s["staged"])
            if store.exists(s["old"]):
                if moved:
                    store.delete(s["target"])
                store.rename(s["old"], s["target"])
                undone = True
            elif moved and not s["existed"]:
                undone = store.delete(s["target"]) or undone
    store.delete(root)
    return undone


def recover(store: Store, base: str) -> int:
    """Settle changes that a driver left unfinished; returns how many were undone. To be called before a new change."""
    folder = f"{base.rstrip('/')}/{FOLDER}"
    return sum(_settle(store, f"{folder}/{name}") for name in store.names(folder))
