"""Scheduled runs: missed days, notify-once, quotas and prompts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import missed_run


def run_gaps(runs: DataFrame, key: list[str], day: str = "day") -> DataFrame:
    """Adds missed: days without a run since the one before; null for none."""
    before = F.lag(day).over(Window.partitionBy(*key).orderBy(day))
    return runs.withColumn("missed", missed_run(before, F.col(day)))


def due_notice(state: DataFrame) -> DataFrame:
    """From last_run_date, notified_date, today: the runs to report, once per last run."""
    last, today = F.col("last_run_date").cast("date"), F.col("today").cast("date")
    return state.withColumn("missed", missed_run(last, today)).filter(
        F.col("missed").isNotNull() & ~F.col("last_run_date").eqNullSafe(F.col("notified_date"))
    )


def notices(checks: DataFrame, key: str = "key") -> DataFrame:
    """From checks (key, last_run_date, today): one row per key and last run that was missed, of the first day that shows it."""
    last, today = F.col("last_run_date").cast("date"), F.col("today").cast("date")
    due = checks.withColumn("missed", missed_run(last, today)).filter("missed IS NOT NULL")
    return due.groupBy(key, "last_run_date").agg(F.min("today").alias("today"), F.min_by("missed", "today").alias("missed"))


def quotas(n: int) -> tuple[int, int]:
    return n, math.ceil(n * 1.5)


def within_quota(candidates: DataFrame, n: int, *order) -> DataFrame:
    """The best candidates, as many as a run may take."""
    return candidates.orderBy(*order).limit(quotas(n)[1])


def alive(pids: DataFrame, processes: DataFrame, pid: str = "pid") -> DataFrame:
    """Recorded processes that still run."""
    return pids.join(processes.select(pid).distinct(), pid, "left_semi")


def final_report(done: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Per key, from slug, is_foreign, ok: records, those from foreign sources, and whether all succeeded."""
    return done.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if("is_foreign").alias("n_foreign"), F.bool_and("ok").alias("all_ok")
    )


def prompt(template: DataFrame, n: int, column: str = "value") -> DataFrame:
    """Fill the placeholders of a prompt, whatever their case."""
    low, high = quotas(n)
    text = F.regexp_replace(column, r"(?i)\{\{MIN_COUNT\}\}", str(low))
    return template.withColumn(column, F.regexp_replace(text, r"(?i)\{\{MAX_COUNT\}\}", str(high)))


#: What is shown for an option that was not given.
DEFAULT = "既定"


def options(model: str = "", effort: str = "") -> list[str]:
    """Command-line options; empty ones are left out."""
    return [x for name, value in (("--model", model), ("--effort", effort)) if value for x in (name, value)]
