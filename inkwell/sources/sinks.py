"""Sinks. Plans stay pure; these functions carry out what a plan decided.

Pages, metadata, catalog and lists go through :class:`~inkwell.sources.changes.Changes`, to any file system. Small
files of the running process (state cells, control log) are local paths. ``send`` is the transport of a webhook, a
function of URL and JSON text that returns (ok, body); tests give their own.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def put(path: str, text: str) -> None:
    """Write beside the target, then rename, so readers never see half a file."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    name = f"{os.path.dirname(path)}/.{uuid.uuid4().hex}"
    try:
        with open(name, "w", encoding="utf-8", newline="") as f:
            f.write(text)
        os.replace(name, path)
    except BaseException:
        if os.path.exists(name):
            os.unlink(name)
        raise


def json_texts(df: DataFrame, key: str) -> DataFrame:
    """key, text: each row as JSON with two-space indents and a line end; null fields are left out."""

    @F.pandas_udf("string")
    def indented(rows):
        return rows.map(lambda r: json.dumps(json.loads(r), ensure_ascii=False, indent=2) + "\n")

    return df.select(F.col(key), indented(F.to_json(F.struct(*df.columns))).alias("text"))


def pretty(value: dict) -> str:
    clean = lambda x: {k: clean(v) for k, v in x.items() if v is not None} if isinstance(x, dict) else [clean(v) for v in x] if isinstance(x, list) else x
    return json.dumps(clean(value), ensure_ascii=False, indent=2) + "\n"


def remove(paths: Iterable[str]) -> list[str]:
    """Delete files; returns those that were there."""
    gone = []
    for p in paths:
        try:
            os.unlink(p)
            gone.append(p)
        except FileNotFoundError:
            pass
    return gone


def ordered_lines(df: DataFrame, order: str, line: str = "line", head: str = "") -> Iterator[str]:
    """A head and ordered lines, as the parts of one text file; the driver holds one partition of the sorted rows at a time."""
    yield head
    for r in df.orderBy(order).select(line).toLocalIterator():
        yield f"{r[0]}\n"


def keep_raw(lines: DataFrame, table: str, run: str, batch: int = 0) -> None:
    """Append the lines of a run to the raw table. A batch of a run that is written again takes the place of itself."""
    tagged = lines.withColumns({"run": F.lit(run), "batch": F.lit(batch)})
    tagged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run", "batch").parquet(table)


def append_line(path: str, line: str) -> None:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "a", encoding="utf-8") as f:
        f.write(line + "\n")


Transport = Callable[[str, str], tuple[bool, str]]


def notify(send: Transport, url: str, text: str) -> int:
    """Post a message; exit code 0 if the service took it."""
    ok, body = send(url, json.dumps({"text": text}, ensure_ascii=False))
    return 0 if ok and body == "ok" else 1


def alert(send: Transport, url: str | None, text: str, skip: bool = False) -> bool:
    """Best effort: nothing is sent when suppressed or without URL, and failures are not raised."""
    if skip or not url:
        return False
    try:
        return send(url, json.dumps({"text": text}, ensure_ascii=False))[0]
    except Exception:  # noqa: BLE001  an alert must not break the run that it reports
        return False
