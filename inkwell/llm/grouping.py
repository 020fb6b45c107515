"""Groups of rows inside a task, for rows that Spark has dealt and sorted by key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame


def sorted_groups(batches: Iterator, keys: list[str]) -> Iterator:
    """(table, first rows of its groups and its end): every group of equal long keys lies in one table."""
    import pyarrow as pa

    carry = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([carry, t]) if carry is not None else t
        if not len(t):
            continue
        k = np.stack([t[c].to_numpy() for c in keys])
        starts = np.flatnonzero(np.append(True, (k[:, 1:] != k[:, :-1]).any(0)))
        if len(starts) > 1:
            yield t.slice(0, starts[-1]), starts
        carry = t.slice(starts[-1])
    if carry is not None and len(carry):
        yield carry, np.array([0, len(carry)])


def map_groups(df: DataFrame, keys: list[str], work: Callable, schema: str) -> DataFrame:
    """Deal rows by ``keys`` and sort them; ``work(table, bounds)`` yields a record batch for its groups."""

    def run(batches: Iterator) -> Iterator:
        for t, bounds in sorted_groups(batches, keys):
            yield work(t, bounds)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)
