"""Streaming forms of the event logs: summary lines, watching a run, counts by window."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.events import summary_lines, terminal
from ..sources.sinks import keep_raw
from .log_sink import append_log
from .tail import new_files


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of files that arrive in a folder."""
    return spark.readStream.text(folder)


def summarise(lines: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write summary lines as files in append mode; stateless, so without watermark.

    The query's progress has, under ``lines``, how many lines there were and how many are no events.
    """
    query = summary_lines(lines, "lines").writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return query.outputMode("append").trigger(availableNow=True).start()


def line_counts(query: StreamingQuery) -> tuple[int, int]:
    """Lines that a query has read in the batches it still reports, and those among them that are no events."""
    seen = [p.observedMetrics["lines"] for p in query.recentProgress if "lines" in p.observedMetrics]
    return sum(s.n for s in seen), sum(s.dropped for s in seen)


def summary_log(lines: DataFrame, path: str, checkpoint: str, every: str = "1 second") -> StreamingQuery:
    """Append summary lines to a text log as they come, each with the time it was written."""
    return append_log(summary_lines(lines, "lines"), path, checkpoint).trigger(processingTime=every).start()


def raw_log(lines: DataFrame, table: str, run: str, checkpoint: str, every: str = "1 second") -> StreamingQuery:
    """Append a run's lines to the raw table as they come; a batch that is repeated after a restart adds no row."""
    out = lines.writeStream.foreachBatch(lambda batch, number: keep_raw(batch, table, run, number))
    return out.option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def wait_for_file(spark: SparkSession, folder: str, before: list[str], checkpoint: str, pattern: str = "*-summary.log", seconds: float = 30, every: str = "1 second") -> str | None:
    """Path of the newest file that was not there before, looked for once a second for a bounded time; None without one."""
    found: list[str] = []
    there = threading.Event()

    def look(batch: DataFrame, _: int) -> None:
        if top := batch.orderBy(F.desc("modificationTime"), "path").take(1):
            found.append(top[0].path)
            there.set()

    query = new_files(spark, folder, pattern, before).writeStream.foreachBatch(look).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
    try:
        _wait(query, there, seconds)
    finally:
        query.stop()
    return found[0] if found else None


def follow(lines: DataFrame, show: Callable[[str], None], checkpoint: str, seconds: float | None = None, every: str = "1 second") -> bool:
    """Show the lines of a log (pos, value) as they come, until one ends the run; True if one did within the time given.

    Lines after the one that ends the run are not shown. The query is stopped from outside its batches.
    """
    ended = threading.Event()

    def look(batch: DataFrame, _: int) -> None:
        for r in batch.select("value", terminal(F.col("value")).alias("ends"), "path", "pos").orderBy("path", "pos").toLocalIterator():
            if ended.is_set():
                return
            show(r.value)
            if r.ends:
                ended.set()

    query = lines.writeStream.foreachBatch(look).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
    try:
        _wait(query, ended, seconds)
    finally:
        query.stop()
    return ended.is_set()


def _wait(query: StreamingQuery, event: threading.Event, seconds: float | None) -> None:
    """Until the event, the end of the time, or the end of the query, whose error is raised."""
    left = seconds
    while not event.wait(0.1 if left is None else min(0.1, max(left, 0))):
        if not query.isActive:
            query.awaitTermination()
            return
        if left is not None:
            left -= 0.1
            if left <= 0:
                return


def stop_query(spark: SparkSession, query_id: str, grace: float = 2) -> bool:
    """Stop a running query by its id; True if none of that id runs after the grace time."""
    query = spark.streams.get(query_id)
    if query is None:
        return True
    query.stop()
    query.awaitTermination(max(1, int(grace)))
    return not query.isActive


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Events per type and window with a watermark; ``ts`` must be a timestamp."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"))
