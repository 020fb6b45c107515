"""Agent event logs: the same transformation serves batch and streaming tables of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import first_present, lookup, strip, truncate
from ..functions.times import reset_time, seconds
from ..schemas import EOF_MARK, FAILURE_MARK, TOOL_LABEL
from ..sources.readers import events


def summary_lines(lines: DataFrame, observe: str | Observation | None = None) -> DataFrame:
    """The columns of ``lines`` besides value, with block (place in the event) and line.

    Tool calls become a label with a detail, texts are stripped and cut, results report turns and seconds. ``observe``
    counts the lines that are no events, see :func:`~inkwell.sources.readers.events`.
    """
    rest = [c for c in lines.columns if c != "value"]
    kind = F.lower("event.type")
    some = F.when(kind == "assistant", F.col("event.message.content"))
    each = events(lines, observe).select(*rest, "event", F.posexplode_outer(some).alias("block", "b"))
    i = lambda f: F.col(f"b.input.{f}")
    detail = F.concat(F.lit(" - "), first_present(*map(i, ("description", "command", "file_path", "query", "url"))))
    said = strip(F.col("b.text"))
    line = (
        F.when(kind == "result", F.concat(
            F.lit("処理完了。ターン数: "), F.coalesce(F.col("event.num_turns").cast("string"), F.lit("")), F.lit(" / 所要時間: "),
            F.coalesce(seconds(F.col("event.duration_ms")).cast("string"), F.lit("0")), F.lit("秒")))
        .when(F.lower("b.type") == "tool_use", F.concat(
            F.lit("  → "), F.coalesce(lookup(TOOL_LABEL, F.col("b.name"), fold=True), F.lit("")), truncate(F.coalesce(detail, F.lit("")), 100)))
        .when((F.lower("b.type") == "text") & (said != ""), F.concat(F.lit("  💬 "), truncate(said, 200)))
    )
    return each.select(*rest, F.coalesce("block", F.lit(0)).alias("block"), line.alias("line")).filter("line IS NOT NULL")


def _last(keep: Column) -> list[Column]:
    """Aggregates: the last value among those to keep, and its place."""
    at = F.when(keep, F.col("pos"))
    return [F.max_by(F.when(keep, F.col("value")), at).alias("value"), F.max(at).alias("pos")]


def is_result() -> Column:
    return F.col("value").rlike('(?i)"type":"result"')


_RESULT = "is_error boolean, result string"


def last_result(lines: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Per key: pos, is_error and result of the last result event; one row of nulls without keys and events."""
    found = lines.filter(is_result()).groupBy(*keys).agg(*_last(is_result()))
    return found.select(*keys, "pos", F.from_json("value", _RESULT).alias("r")).select(*keys, "pos", "r.*")


def classify(exit_code: Column, is_error: Column, error_text: Column, mark: Column, output: Column) -> Column:
    """struct<failed, reason>: exit code, then error flag, then failure mark, then empty output."""
    reason = (
        F.when(exit_code != 0, F.concat(F.lit("exit code "), exit_code.cast("string")))
        .when(F.coalesce(is_error, F.lit(False)), F.concat(F.lit("error: "), F.coalesce(error_text, F.lit(""))))
        .when(F.coalesce(mark, F.lit("")) != "", mark)
        .when(F.coalesce(output, F.lit("")) == "", F.lit("no output"))
    )
    return F.struct(reason.isNotNull().alias("failed"), F.coalesce(reason, F.lit("")).alias("reason"))


def run_outcome(lines: DataFrame, exit_code: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Per run (all lines, or those of each key): failed, reason, error_text."""
    mark = F.regexp_extract("value", f"(?i){FAILURE_MARK}", 1)
    whole = lines.groupBy(*keys).agg(
        F.min_by(mark, F.when(mark != "", F.col("pos"))).alias("mark"), F.max(F.col("value")).alias("output"), _last(is_result())[0]
    ).withColumn("r", F.from_json("value", _RESULT))
    done = classify(F.lit(exit_code), F.col("r.is_error"), F.col("r.result"), F.col("mark"), F.col("output"))
    return whole.select(*keys, done.alias("o"), F.col("r.result").alias("error_text")).select(*keys, "o.*", "error_text")


def retry_at(outcome: DataFrame, now: str, no_retry: bool = False) -> DataFrame:
    """Adds retry_at: when to try once more, or null."""
    at = reset_time(F.concat_ws(" ", "reason", "error_text"), F.lit(now).cast("timestamp"))
    return outcome.withColumn("retry_at", F.when(F.col("failed") & ~F.lit(no_retry), at))


def terminal(line: Column) -> Column:
    """Whether a log line ends a run."""
    return F.coalesce(F.contains(line, F.lit(EOF_MARK)) | line.rlike(r"^\[.*\] 失敗: "), F.lit(False))
