"""Keyed state over streams: notices that are given once, and the last result of every run.

Both work batch by batch and keep a small value per key; their batch forms are ``operators.runs.notices`` and
``operators.events.last_result``. State lies in groups of keys, since a call for each key costs more than its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.times import missed_run
from ..operators.events import is_result, terminal

_NOTICE = "key string, last_run_date string, today string, missed int"
_RESULT = "run string, pos long, is_error boolean, result string, closed boolean"
_NO_RESULT = (None, None, None, False, 0)
#: Groups of keys, as many as the calls of a batch. A group holds its share of the live keys and is written anew when one of
#: them changes, so very many live keys want more groups. A checkpoint keeps the number it was begun with.
GROUPS = 1024


def _group(key: str, groups: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(groups)).alias("group")


def _rows(pieces: Iterator[pd.DataFrame], *names: str) -> Iterator[tuple]:
    for rows in pieces:
        yield from zip(*(rows[c].tolist() for c in names), strict=True)


def notices(checks: DataFrame, groups: int = GROUPS) -> DataFrame:
    """From checks (key, last_run_date, today) of a stream: missed days, once per key and last run, however often it is seen.

    The state of a key is the list of last runs that were reported, one a day at most.
    """
    last, today = F.col("last_run_date").cast("date"), F.col("today").cast("date")
    due = checks.select(
        _group("key", groups), F.col("key").cast("string").alias("key"), "last_run_date", "today", missed_run(last, today).cast("int").alias("missed")
    ).filter("missed IS NOT NULL")

    def report(_: tuple, pieces: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        told = {key: set(days) for key, days in zip(*state.get, strict=True)} if state.exists else {}
        fresh: dict[tuple, tuple] = {}
        for key, last, today, missed in _rows(pieces, *names):
            if last not in told.get(key, ()) and ((key, last) not in fresh or today < fresh[key, last][0]):
                fresh[key, last] = today, missed
        if fresh:
            for key, last in fresh:
                told.setdefault(key, set()).add(last)
            state.update((list(told), [sorted(days) for days in told.values()]))
            yield pd.DataFrame([(*at, *row) for at, row in fresh.items()], columns=names, dtype=object)

    names = ["key", "last_run_date", "today", "missed"]
    return due.groupBy("group").applyInPandasWithState(
        report, _NOTICE, "key array<string>, told array<array<string>>", "append", GroupStateTimeout.NoTimeout
    )


def last_results(lines: DataFrame, late: str = "1 hour", groups: int = GROUPS) -> DataFrame:
    """From lines (run, ts, pos, value) of a stream: the last result event of every run, anew when it changes (update mode).

    ``closed`` is true once a line has ended the run, or the watermark has passed all of its lines by another
    ``late``; the state of a run that is silent so long is removed. Only results and ending lines reach the state.
    """
    found = F.from_json("value", "is_error boolean, result string")
    kept = lines.filter(is_result() | terminal(F.col("value"))).withWatermark("ts", late).select(
        _group("run", groups), F.col("run").cast("string").alias("run"), "ts", F.coalesce(F.unix_millis("ts"), F.lit(0)).alias("at"),
        F.coalesce("pos", F.lit(0)).cast("long").alias("pos"), found["is_error"].alias("is_error"), found["result"].alias("result"),
        (is_result() & F.col("pos").isNotNull()).alias("is_result"), terminal(F.col("value")).alias("ends"),
    )
    wait = int(pd.Timedelta(late).total_seconds() * 1000)

    def follow(_: tuple, pieces: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        before = {run: row for run, *row in zip(*state.get, strict=True)} if state.exists else {}
        live = dict(before)
        for run, at, pos, is_error, result, is_result, ends in _rows(pieces, "run", "at", "pos", "is_error", "result", "is_result", "ends"):
            *top, closed, due = live.get(run, _NO_RESULT)
            if is_result and (top[0] is None or pos > top[0]):
                top = pos, is_error, result
            live[run] = *top, closed or ends, max(due, max(at, now) + wait)
        silent = [run for run in live if live[run][-1] < now]
        out = [(run, *row[:4]) for run, row in live.items() if (row[0], row[3]) != (before.get(run, _NO_RESULT)[0], before.get(run, _NO_RESULT)[3])]
        for run in silent:
            *top, closed, _due = live.pop(run)
            if not closed:
                out.append((run, *top, True))
        if live:
            state.update(tuple(map(list, zip(*((run, *row) for run, row in live.items()), strict=True))))
            state.setTimeoutTimestamp(min(row[-1] for row in live.values()))
        else:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["run", "pos", "is_error", "result", "closed"], dtype=object)

    held = "run array<string>, pos array<long>, is_error array<boolean>, result array<string>, closed array<boolean>, due array<long>"
    return kept.groupBy("group").applyInPandasWithState(follow, _RESULT, held, "update", GroupStateTimeout.EventTimeTimeout)
