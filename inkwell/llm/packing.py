"""Operator 7: hierarchical packing into context windows of several lengths.

Every task packs the documents it reads, in one pass and with bounded memory: the tokens of a document
are cut into full long windows and a rest, and the rest is routed to the tier of the smallest context
size that holds it. Whenever a step group's worth of tokens has come together, the tiers are packed from
the longest down: each rest of a long tier opens a window of that tier, and the gap is filled with pieces
of the shorter tiers, cut where needed. What is left waits for the next group; at the end of the task it
is laid out in windows whose lengths are powers of two, so nothing is padded. The sequences of a group
are dealt to steps of about equal numbers of tokens, the longest first, each to the emptiest step.

Nothing is shuffled and no key matters, so hot keys cost nothing; a lost task is repeated with the same
result as long as its input partition is the same.

Defined cases: a null text is empty and yields the end token alone; a null or repeated doc_id is packed
like any other row; an empty table gives an empty result; other columns are ignored. A long text is held
by one task as a whole, with four bytes a token.
"""

from __future__ import annotations

import heapq
import zlib
from collections import deque
from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tokens import TokenBytes, default_path
from .workspace import table

WINDOW = 1024
TIERS = (1024, 512, 256, 128)
END = b"\0\0\0\0"
COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length", "step_id"]


class Packer:
    """Packs the documents of one task; pieces are (doc_id, start, doc_tokens, ids as bytes)."""

    def __init__(self, window: int, tiers: tuple[int, ...], base: int, step_tokens: int):
        self.window, self.tiers, self.step_tokens = window, sorted(tiers, reverse=True), step_tokens
        self.waiting: dict[int, deque] = {t: deque() for t in self.tiers}
        self.next_sequence = self.next_step = base
        self.pending, self.done = 0, []

    def add(self, doc_id, ids: bytes) -> None:
        total, size, at = len(ids) // 4, 4 * self.window, 0
        while len(ids) - at >= size:
            self.done.append([(doc_id, at // 4, total, ids[at : at + size])])
            at += size
        if at < len(ids):
            self._route((doc_id, at // 4, total, ids[at:]))
        self.pending += total

    def _route(self, piece: tuple) -> None:
        n = len(piece[3]) // 4
        self.waiting[min(t for t in self.tiers if t >= n)].append(piece)

    def _take(self, gap: int, most: int):
        """A waiting piece of at most ``gap`` tokens from tiers up to ``most``, cut if none is that short."""
        for t in self.tiers:
            if t <= min(gap, most) and self.waiting[t]:
                return self.waiting[t].popleft()
        for t in reversed(self.tiers):
            if t <= most and self.waiting[t]:
                doc_id, start, total, ids = self.waiting[t].popleft()
                if len(ids) > 4 * gap:
                    self._route((doc_id, start + gap, total, ids[4 * gap :]))
                return doc_id, start, total, ids[: 4 * gap]
        return None

    def pack(self, last: bool = False) -> Iterator[tuple]:
        """Rows of all sequences that are complete; with ``last``, of everything."""
        rest: list[tuple] = []
        for t in self.tiers:
            while self.waiting[t]:
                pieces, gap = [], t
                while gap and (p := self._take(gap, t)):
                    pieces.append(p)
                    gap -= len(p[3]) // 4
                if gap:
                    rest += pieces
                else:
                    self.done.append(pieces)
        if last:
            self.done += self._powers(rest)
        else:
            for p in rest:
                self._route(p)
        yield from self._rows()
        self.pending = 0

    def _powers(self, pieces: list[tuple]) -> Iterator[list[tuple]]:
        """Windows whose lengths are the powers of two that add up to the tokens left."""
        left, total = deque(pieces), sum(len(p[3]) // 4 for p in pieces)
        while total:
            size = min(self.window, 1 << (total.bit_length() - 1))
            gap, out = size, []
            while gap:
                doc_id, start, n, ids = left.popleft()
                if len(ids) > 4 * gap:
                    left.appendleft((doc_id, start + gap, n, ids[4 * gap :]))
                    ids = ids[: 4 * gap]
                out.append((doc_id, start, n, ids))
                gap -= len(ids) // 4
            yield out
            total -= size

    def _rows(self) -> Iterator[tuple]:
        sized = sorted(((sum(len(p[3]) for p in s) // 4, s) for s in self.done), key=lambda x: -x[0])
        steps = max(1, -(-sum(n for n, _ in sized) // self.step_tokens))
        loads = [(0, self.next_step + k) for k in range(steps)]
        for n, pieces in sized:
            load, step = heapq.heappop(loads)
            heapq.heappush(loads, (load + n, step))
            offset = 0
            for doc_id, start, total, ids in pieces:
                length = len(ids) // 4
                yield doc_id, start, length, zlib.crc32(ids), total, self.next_sequence, offset, n, step
                offset += length
            self.next_sequence += 1
        self.next_step += steps if sized else 0
        self.done = []


def pack_documents(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
    tiers: tuple[int, ...] = TIERS,
    path: str | None = None,
    step_tokens: int = 65_536,
    group_tokens: int = 1 << 20,
) -> DataFrame:
    """One row per piece: see COLUMNS. Sequence and step ids are unique over all tasks."""
    path = path or default_path()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encode = TokenBytes(path)
        packer = Packer(window, tiers, TaskContext.get().partitionId() << 40, step_tokens)
        kind = pa.int64()

        def rows_of(last: bool = False) -> Iterator:
            columns = list(zip(*packer.pack(last), strict=True)) or [()] * len(COLUMNS)
            kinds = [kind] + [pa.int64()] * (len(COLUMNS) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], COLUMNS)

        for batch in batches:
            kind = batch["doc_id"].type
            for i, x in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                packer.add(i, encode(x or "") + END)
                if packer.pending >= group_tokens:
                    yield from rows_of()
        yield from rows_of(last=True)

    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    types = dict.fromkeys(COLUMNS, "long") | {"doc_id": dict(rows.dtypes)["doc_id"]}
    return rows.mapInArrow(run, ", ".join(f"{k} {v}" for k, v in types.items()))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the pieces of the documents that are left.

    Every row is packed: null and repeated ids like others, a null text as its end token; an empty table gives no rows.
    """
    return pack_documents(docs)
