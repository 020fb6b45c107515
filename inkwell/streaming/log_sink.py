"""A streaming sink that appends lines to one text log, each with the time at which it was written.

Tasks stamp their lines and write them beside the log; the commit of a batch appends those files to it. What the log
holds after a batch is noted with the batch's number: a batch that is written again after a restart is not
appended twice, and half of an append is cut off before the next.
"""

from __future__ import annotations

import json
import os
import shutil
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage
from pyspark.sql.streaming import DataStreamWriter

from ..sources.sinks import put


@dataclass
class Written(WriterCommitMessage):
    part: str


class LogWriter(DataSourceStreamWriter):
    def __init__(self, options: dict):
        self.path, self.stamp = options["path"], options.get("stamp", "[%H:%M:%S] ")

    def write(self, rows: Iterator) -> Written:
        part = f"{os.path.dirname(self.path)}/.{os.path.basename(self.path)}.{uuid.uuid4().hex}"
        os.makedirs(os.path.dirname(self.path), exist_ok=True)
        with open(part, "w", encoding="utf-8", newline="") as f:
            for r in rows:
                f.write(f"{time.strftime(self.stamp)}{r[0]}\n")
        return Written(part)

    def _noted(self) -> dict:
        try:
            with open(f"{self.path}.state", encoding="utf-8") as f:
                return json.load(f)
        except FileNotFoundError:
            return {"batch": -1, "bytes": 0}

    def commit(self, messages: list, batchId: int) -> None:
        noted = self._noted()
        if batchId > noted["batch"]:
            with open(self.path, "ab") as log:
                log.truncate(noted["bytes"])
                for m in messages:
                    if m is not None:
                        with open(m.part, "rb") as f:
                            shutil.copyfileobj(f, log)
                log.flush()
                size = log.seek(0, os.SEEK_END)
            put(f"{self.path}.state", json.dumps({"batch": batchId, "bytes": size}))
        self.abort(messages, batchId)

    def abort(self, messages: list, batchId: int) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.part):
                os.unlink(m.part)


class LogSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log"

    def streamWriter(self, schema, overwrite: bool) -> LogWriter:
        return LogWriter(self.options)


def append_log(lines: DataFrame, path: str, checkpoint: str, column: str = "line", stamp: str = "[%H:%M:%S] ") -> DataStreamWriter:
    """A writer that appends a stream's lines to the log; one task a batch, so that they keep their order."""
    lines.sparkSession.dataSource.register(LogSink)
    out = lines.select(column).coalesce(1).writeStream.format("log").option("path", path).option("stamp", stamp)
    return out.outputMode("append").option("checkpointLocation", checkpoint)


