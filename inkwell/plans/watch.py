"""Start a run and show its log until it ends."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

from ..operators import runs
from ..sources import readers
from ..sources.storage import Store
from ..streaming import summary
from ..streaming.tail import tail

PATTERN = "*-summary.log"


def watch(
    spark: SparkSession, folder: str, start: Callable[[list[str]], None], show: Callable[[str], None], model: str = "", effort: str = "",
    wait: float = 30, seconds: float | None = None,
) -> int:
    """Start a run in the background, wait for its summary log, and show that line by line; an exit code.

    0: a line has ended the run. 1: no new log came within ``wait`` seconds, or the run did not end within ``seconds``.
    ``start`` gets the run's options.
    """
    store = Store(spark)
    known = [r.name for r in readers.listing(spark, folder, PATTERN).select("name").collect()] if store.names(folder) else []
    show(f"モデル: {model or runs.DEFAULT} / 推論レベル: {effort or runs.DEFAULT}")
    start(runs.options(model, effort))
    state = f"{folder}/checkpoints/watch-{uuid.uuid4().hex}"
    path = summary.wait_for_file(spark, folder, known, f"{state}/files", PATTERN, wait)
    if path is None:
        show("no log file came; see whether the run was started")
        return 1
    return 0 if summary.follow(tail(spark, path), show, f"{state}/lines", seconds) else 1
