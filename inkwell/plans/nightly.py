"""The scheduled run as a driver procedure: run, record, retry once after a limit, tidy up.

What touches the outside is an argument: ``run`` starts the work and writes its event lines to the file it is
given, ``clock`` tells the time, ``sleep`` waits, ``send`` posts to the webhook. Everything read from a run's
lines is a Spark query over the captured file, so a long log is not held by the driver.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import minutes_since
from ..operators import catalog as C
from ..operators import events, runs
from ..schemas import EOF_MARK
from ..sources import readers, sinks
from ..streaming import summary
from ..streaming.tail import tail

Run = Callable[[str, str], int]
Clock = Callable[[], datetime]


@dataclass
class Outcome:
    """exit_code 0: the run, or its second attempt, did its work."""

    exit_code: int
    reason: str
    attempts: int


def control_line(folder: str, now: datetime, text: str) -> None:
    """One line with date and time in the control log."""
    sinks.append_line(f"{folder}/control.log", f"[{now:%Y-%m-%d %H:%M:%S}] {text}")


def prepare(spark: SparkSession, folder: str, template: str, n: int) -> str:
    """Fill the prompt and write it; returns its path."""
    text = runs.prompt(readers.template(spark, template), n).first().value
    sinks.put(f"{folder}/prompt.txt", text)
    return f"{folder}/prompt.txt"


def attempt(spark: SparkSession, folder: str, prompt: str, run: Run, clock: Clock, number: int) -> DataFrame:
    """One attempt: run, while a stream writes its summary log line by line; keep the raw lines; returns the outcome row."""
    name = f"{clock():%Y%m%d-%H%M%S}-{number}"
    captured, log = f"{folder}/captured/{name}.jsonl", f"{folder}/{name}-summary.log"
    for path in (captured, log):
        sinks.put(path, "")
    sinks.put(f"{folder}/run.pid", str(os.getpid()))
    written = summary.summary_log(tail(spark, captured), log, f"{folder}/checkpoints/{name}")
    try:
        code = run(prompt, captured)
        _end_line(captured)
        written.processAllAvailable()
    finally:
        sinks.remove([f"{folder}/run.pid"])
        written.stop()
    lines = readers.lines(spark, captured)
    sinks.keep_raw(lines.drop("path"), f"{folder}/raw", name)
    n, dropped = summary.line_counts(written)
    control_line(folder, clock(), f"{n} lines, {dropped} of them no events")
    return events.run_outcome(lines, code)


def _end_line(path: str) -> None:
    """A line end after what a run wrote last, where it wrote none; lines are followed to their ends."""
    with open(path, "rb+") as f:
        if f.seek(0, os.SEEK_END) and f.seek(-1, os.SEEK_END) >= 0 and f.read(1) != b"\n":
            f.write(b"\n")


def wait_until(until: datetime, clock: Clock, sleep: Callable[[float], None], tell: Callable[[str], None], poll: float = 30, every: float = 600) -> None:
    """Look at the clock every ``poll`` seconds until a wall-clock time; says every ``every`` seconds how long it takes."""
    told = None
    while (now := clock()) < until:
        if told is None or (now - told) >= timedelta(seconds=every):
            tell(f"{-(-int((until - now).total_seconds()) // 60)} minutes until the next attempt")
            told = now
        sleep(min(poll, (until - now).total_seconds()))


def nightly(
    spark: SparkSession, folder: str, template: str, n: int, run: Run, clock: Clock, sleep: Callable[[float], None],
    url: str | None, send: sinks.Transport, no_retry: bool = False,
) -> Outcome:
    """The whole procedure. The run marker is written first, so that a run that fails is not taken for a missed one."""
    tell = lambda text: control_line(folder, clock(), text)
    sinks.put(f"{folder}/last-run", f"{clock():%Y-%m-%d}")
    prompt = prepare(spark, folder, template, n)
    for number in (1, 2):
        tell(f"attempt {number}")
        done = events.retry_at(attempt(spark, folder, prompt, run, clock, number), f"{clock():%Y-%m-%d %H:%M:%S}", no_retry or number == 2).first()
        if not done.failed:
            tell(EOF_MARK)
            return Outcome(0, "", number)
        tell(f"失敗: {done.reason}")
        if done.retry_at is None:
            sinks.alert(send, url, f"the run failed: {done.reason}")
            return Outcome(1, done.reason, number)
        wait_until(done.retry_at, clock, sleep, tell)
    raise AssertionError("the second attempt ends the run")


def delete_stale_batches(spark: SparkSession, status: str, folder: str) -> list[str]:
    """Delete untracked batch files that version-control status lines name; returns those that were there."""
    names = C.stale_batches(readers.status_lines(spark, status)).orderBy("pos")
    return sinks.remove([f"{folder}/{r.name}" for r in names.toLocalIterator()])


def delete_newest_logs(spark: SparkSession, folder: str, n: int = 4, pattern: str = "*.log") -> list[str]:
    """Delete the newest log files, those of a run that was stopped."""
    newest = C.newest(readers.listing(spark, folder, pattern).select("name", "path", "modificationTime"), n).collect()
    return sinks.remove([f"{folder}/{r.name}" for r in newest])


@dataclass
class Stopped:
    """exit_code 1: the process outlived the grace time, and its record stays. ``lines`` are the last of the newest summary log."""

    exit_code: int
    ended: bool
    minutes: float | None = None
    log: str | None = None
    lines: tuple[str, ...] = ()


def stop(
    spark: SparkSession, folder: str, processes: Callable[[], DataFrame], end: Callable[[int], None], clock: Clock, sleep: Callable[[float], None], grace: float = 2,
) -> Stopped:
    """End the recorded process if it still runs, and see that it has ended; processes: pid, started."""
    record, text = f"{folder}/run.pid", readers.cell_text(f"{folder}/run.pid")
    asked = spark.createDataFrame([(int(text),)] if text and text.isdigit() else [], "pid long")
    since = minutes_since(F.col("started"), F.lit(clock()))
    found = processes().join(asked, "pid", "left_semi").select("pid", since.alias("minutes")).first()
    if found is None:
        sinks.remove([record])
        return Stopped(0, False)
    end(found.pid)
    sleep(grace)
    if runs.alive(asked, processes()).take(1):
        return Stopped(1, False, found.minutes)
    sinks.remove([record])
    newest = C.newest(readers.listing(spark, folder, "*-summary.log"), 1).first()
    if newest is None:
        return Stopped(0, True, found.minutes)
    last = readers.last_lines(readers.lines(spark, newest.path), 10).collect()
    return Stopped(0, True, found.minutes, newest.path, tuple(r.value for r in last))
