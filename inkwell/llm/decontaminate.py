"""Operator 4: benchmark decontamination by greedy string tiling.

A benchmark item leaks into a document if tiles - non-overlapping common runs of at least ``least``
tokens, in any order - cover a given share of the item. Documents meet items over shared token seeds
(runs of ``least`` tokens). The seeds of an item that occur in the document bound what tiles can cover,
so only pairs whose seeds cover enough are tiled: running Karp-Rabin fingerprints give the longest match of every
place of the document, and the longest unmarked matches are marked first. A place keeps one match, not all of
them, and looks for its next best only when its turn comes and that match is taken; so a long run of one
repeated token, or a phrase that is repeated between other tokens, gives as many matches as the document has
places, not as many as there are pairs of places. Marked matches are compared token by token.

The benchmark is the small side of the seed join. It is sent to the tasks in blocks of ``block_chars``
characters, cut by running length (the last item of a block may go beyond). A task holds some
``GROUP_CHARS`` characters of documents at a time and takes them through one block after the other, so
memory is bounded by a block and a group, and every input row gives one row for any number of blocks.

Tokens are runs of word characters, lower-cased. Defined cases: a null text has no tokens; items
without tokens match nothing; items shorter than ``least`` tokens match as a whole; repeated documents
and items are judged each; of equal coverages the smallest item_id is named; empty tables: nothing is
contaminated, or no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .workspace import table

WORD = re.compile(r"\w+")
LEAST, SHARE, BLOCK_CHARS = 5, 0.5, 8_000_000
GROUP_CHARS = 32_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)


def window_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin fingerprints (mod 2^64) of all runs of ``n`` ids."""
    if len(ids) < n:
        return np.empty(0, np.uint64)
    x, out = ids.astype(np.uint64) + np.uint64(2), np.zeros(len(ids) - n + 1, np.uint64)
    part, size, done = x * np.uint64(0xD6E8FEB86659FD93) ^ (x << np.uint64(32)), 1, 0
    power = BASE
    while True:
        if n & size:
            out = out * power + part[done : done + len(out)]
            done += size
        if 2 * size > n:
            return out
        part, size = part[:-size] * power + part[size:], 2 * size
        power = np.uint64(int(power) ** 2 % 2**64)


class Prints:
    """Fingerprints of any run of ids of one text, from prefix sums."""

    def __init__(self, ids: np.ndarray):
        self.ids = ids
        x = ids.astype(np.uint64) + np.uint64(2)
        x = x * np.uint64(0xD6E8FEB86659FD93) ^ (x << np.uint64(32))
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.append(np.uint64(1), np.full(len(x), BASE)), dtype=np.uint64)
            self.sums = np.append(np.uint64(0), np.cumsum(x * self.power[:-1], dtype=np.uint64))

    def agree(self, at: np.ndarray, other: Prints, there: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the common run from ``at`` here and from ``there`` in the other text, up to ``most``."""
        low, high = np.zeros(len(at), np.int64), most.astype(np.int64)
        power = self.power if len(self.power) >= len(other.power) else other.power
        while (open_ := low < high).any():
            middle = np.where(open_, (low + high + 1) // 2, low)
            a, b = self.sums[at + middle] - self.sums[at], other.sums[there + middle] - other.sums[there]
            same = a * power[there] == b * power[at]
            low, high = np.where(same, middle, low), np.where(same, high, np.maximum(middle - 1, low))
        return low


def suffix_order(ids: np.ndarray) -> np.ndarray:
    """Places of a text in the order of what begins there, by doubling the length that is compared."""
    rank, size = np.unique(ids, return_inverse=True)[1].astype(np.int64), 1
    while len(ids) and rank.max() < len(ids) - 1:
        later = np.zeros(len(ids), np.int64)
        later[: len(ids) - size] = rank[size:] + 1
        rank = np.unique(rank * (len(ids) + 1) + later, return_inverse=True)[1].astype(np.int64)
        size *= 2
    return np.argsort(rank)


def longest_matches(doc: Prints, at: np.ndarray, item: Prints) -> tuple[np.ndarray, np.ndarray]:
    """Of each place in the document: the length of the longest run that is somewhere in the item, and its first place there.

    The document's suffix is looked up among the item's sorted suffixes; the longest match is with one that the
    search compares it to. The fingerprints of the item's runs of that length then tell the first that is the same.
    """
    order, size = suffix_order(item.ids), len(item.ids)
    low, high = np.zeros(len(at), np.int64), np.full(len(at), size)
    best, some = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    while (open_ := low < high).any():
        middle = np.minimum((low + high) // 2, size - 1)
        there = order[middle]
        n = doc.agree(at, item, there, np.minimum(len(doc.ids) - at, size - there))
        better = open_ & (n > best)
        best, some = np.where(better, n, best), np.where(better, there, some)
        ends_i, ends_d = there + n >= size, at + n >= len(doc.ids)
        token_d, token_i = doc.ids[np.minimum(at + n, len(doc.ids) - 1)], item.ids[np.minimum(there + n, size - 1)]
        after = ends_i | (~ends_d & (token_d > token_i))
        low, high = np.where(open_ & after, middle + 1, low), np.where(open_ & ~after, middle, high)
    first = np.zeros(len(at), np.int64)
    by = np.argsort(best, kind="stable")
    cuts = np.flatnonzero(np.append(True, best[by][1:] != best[by][:-1])) if len(by) else []
    for mine in np.split(by, cuts[1:]) if len(by) else []:
        if n := int(best[mine[0]]):
            _, where, same = np.unique(window_hashes(item.ids, n), return_index=True, return_inverse=True)
            first[mine] = where[same[some[mine]]]
    return best, first


def tiles(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (doc start, item start, length), the longest matches first, of equal ones the first in the document, then in the item.

    Every place of the document waits with its longest match. If that has been marked in part when its turn comes, the
    place's longest free match is looked for then, among the places of the item that begin alike. Places whose
    beginning has no free place left in the item are dropped together.
    """
    of_d, of_i = Prints(doc), Prints(item)
    starts_i = window_hashes(item, least)
    by = np.argsort(starts_i, kind="stable")
    keys, kind_i = np.unique(starts_i, return_inverse=True)
    bounds = np.searchsorted(starts_i[by], keys, "left"), np.searchsorted(starts_i[by], keys, "right")
    starts_d = window_hashes(doc, least)
    kind_d = np.searchsorted(keys, starts_d)
    hit = kind_d < len(keys)
    hit[hit] = keys[kind_d[hit]] == starts_d[hit]
    at = np.flatnonzero(hit)
    if not len(at):
        return []
    alike, one = _alike(doc, at, len(item))
    n, j = (x[alike] for x in longest_matches(of_d, one, of_i))
    waiting = np.lexsort((at, -n))
    waiting = waiting[n[waiting] >= least]
    at, n, j, kind, alike = at[waiting], n[waiting], j[waiting], kind_d[at[waiting]], alike[waiting]
    free_d, free_i, room_i = np.ones(len(doc), bool), np.ones(len(item), bool), _room(np.ones(len(item), bool))
    alive = np.ones(len(keys), bool)
    found, again, k = [], [], 0
    known: dict[int, tuple[int, int]] = {}  # since the last mark: of places that go on alike, the best free match
    while k < len(at) or again:
        if again and (k == len(at) or again[0] < (-n[k], at[k], j[k])):
            size, here, there, like = heapq.heappop(again)
            size = -size
        else:
            size, here, there, like = int(n[k]), int(at[k]), int(j[k]), int(alike[k])
            k += 1
        if not free_d[here] or not alive[kind_d[here]]:
            continue
        # What was marked before is as long as this or longer, so it covers an end of it or nothing.
        if free_d[here + size - 1] and free_i[there] and free_i[there + size - 1]:
            if (doc[here : here + size] == item[there : there + size]).all():
                free_d[here : here + size] = free_i[there : there + size] = False
                found.append((here, there, size))
                room_i = _room(free_i)
                left = np.bincount(kind_i[room_i[: len(kind_i)] >= least], minlength=len(keys)) > 0
                if (left != alive).any():
                    alive = left
                    keep = alive[kind[k:]]
                    at, n, j, kind, alike, k = at[k:][keep], n[k:][keep], j[k:][keep], kind[k:][keep], alike[k:][keep], 0
                known.clear()
            continue
        if like in known and free_d[here + size - 1]:
            if known[like][0] >= least:
                heapq.heappush(again, (-known[like][0], here, known[like][1], like))
            continue
        there = by[bounds[0][kind_d[here]] : bounds[1][kind_d[here]]]
        there = there[room_i[there] >= least]
        taken = np.flatnonzero(~free_d[here : here + size])
        most = np.minimum(room_i[there], taken[0] if len(taken) else size)
        same = of_d.agree(np.full(len(there), here), of_i, there, most)
        top = int(same.argmax()) if len(same) else -1
        best = (int(same[top]), int(there[top])) if len(same) else (0, 0)
        if not len(taken):
            known[like] = best
        if best[0] >= least:
            heapq.heappush(again, (-best[0], here, best[1], like))
    return found


def _alike(doc: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A number for each place, the same for places that go on alike for ``size`` tokens, and a place of each number."""
    whole = at + size <= len(doc)
    _, first, number = np.unique(window_hashes(doc, size)[at[whole]], return_index=True, return_inverse=True)
    out = np.empty(len(at), np.int64)
    out[whole] = number
    out[~whole] = len(first) + np.arange(int((~whole).sum()))
    return out, np.concatenate([at[whole][first], at[~whole]])


def _room(free: np.ndarray) -> np.ndarray:
    """Unmarked tokens from each place on."""
    at = np.arange(len(free))
    blocked = np.where(free, len(free), at)
    return np.minimum.accumulate(blocked[::-1])[::-1] - at


class Benchmark:
    """Seeds of a block of items, for use in tasks."""

    def __init__(self, items: list[tuple[object, str]], least: int):
        self.least, self.vocabulary = least, {}
        number = self.vocabulary.setdefault
        self.ids = [k for k, _ in items]
        self.tokens = [np.array([number(w, len(self.vocabulary)) for w in WORD.findall((t or "").lower())], np.int64) for _, t in items]
        seeds = defaultdict(list)
        for k, x in enumerate(self.tokens):
            n = min(least, len(x))
            for p, h in enumerate(window_hashes(x, n).tolist() if n else ()):
                seeds[n].append((h, k, p))
        self.seeds = {}
        for n, rows in seeds.items():
            rows.sort()
            h = np.array([r[0] for r in rows], np.uint64)
            self.seeds[n] = (h, np.array([r[1:] for r in rows], np.int64))

    def judge(self, texts: list[str | None], share: float) -> list[list[tuple[object, float, list]]]:
        """Per text: (item id, coverage, tiles) of the items that leak into it."""
        get = self.vocabulary.get
        docs = [[get(w, -1) for w in WORD.findall((t or "").lower())] for t in texts]
        flat = np.array([i for d in docs for i in (*d, -1)], np.int64)
        ends = np.cumsum([len(d) + 1 for d in docs])
        hits = defaultdict(list)
        for n, (keys, places) in self.seeds.items():
            known = np.concatenate([[0], np.cumsum(flat < 0)])
            at = np.flatnonzero(known[n:] == known[:-n])
            h = window_hashes(flat, n)[at]
            left = np.searchsorted(keys, h)
            inside = left < len(keys)
            inside[inside] = keys[left[inside]] == h[inside]
            of = np.searchsorted(ends, at[inside], "right")
            for d in np.unique(of):
                ours = np.unique(h[inside][of == d])
                a, b = np.searchsorted(keys, ours, "left"), np.searchsorted(keys, ours, "right")
                hits[int(d)].append((n, np.concatenate([places[x:y] for x, y in zip(a, b, strict=True)])))
        out: list[list] = [[] for _ in texts]
        for d, groups in hits.items():
            doc = np.array(docs[d], np.int64)
            for n, place in groups:
                place = place[np.lexsort((place[:, 1], place[:, 0]))]
                item, p = place[:, 0], place[:, 1]
                step = np.minimum(np.where(np.append(item[1:] == item[:-1], False), np.append(p[1:], 0) - p, n), n)
                for k, bound in zip(*_sums(item, step), strict=True):
                    size = len(self.tokens[k])
                    if bound >= share * size:
                        got = tiles(doc, self.tokens[k], n)
                        if (covered := sum(t[2] for t in got)) >= share * size:
                            out[d].append((self.ids[k], covered / size, got))
        return out


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[list[int], list[int]]:
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first].tolist(), np.add.reduceat(values, first).tolist()


def _blocks(items: DataFrame, chars: int) -> Iterator[list[tuple[object, str | None]]]:
    """The items in lists of ``chars`` characters, the last item of each included; one empty list if there are none."""
    block, size, none = [], 0, True
    for r in items.toLocalIterator():
        block.append((r.item_id, r.text))
        size += len(r.text or "")
        if size >= chars:
            yield block
            block, size, none = [], 0, False
    if block or none:
        yield block


def _groups(batches: Iterator) -> Iterator[list]:
    """Record batches of some ``GROUP_CHARS`` bytes of text together."""
    group, size = [], 0
    for batch in batches:
        group.append(batch)
        size += batch["text"].nbytes
        if size >= GROUP_CHARS:
            yield group
            group, size = [], 0
    if group:
        yield group


def _better(new: tuple[object, float], old: tuple[object, float] | None) -> bool:
    """Whether an item and its coverage go before the best so far: of equal coverages the smallest id, a null id last."""
    if old is None or new[1] != old[1]:
        return old is None or new[1] > old[1]
    return new[0] is not None and (old[0] is None or new[0] < old[0])


def _judged(sent: list, least: int, share: float, batches: Iterator) -> Iterator[tuple]:
    """(record batch, numbers of leaked items, best covered item and its coverage or None) for every batch."""
    index = None
    for group in _groups(batches):
        texts = [batch["text"].to_pylist() for batch in group]
        counts = [np.zeros(len(t), np.int64) for t in texts]
        best: list[list] = [[None] * len(t) for t in texts]
        for block in sent:
            if index is None or len(sent) > 1:
                index = None  # the last block's goes first
                # Read anew, so that a worker keeps one block; with encryption there is no path to read from.
                path = getattr(block, "_path", None)
                index = Benchmark(block.load_from_path(path) if path else block.value, least)
            for some, n, top in zip(texts, counts, best, strict=True):
                for k, found in enumerate(index.judge(some, share)):
                    n[k] += len(found)
                    for item, covered, _ in found:
                        if _better((item, covered), top[k]):
                            top[k] = (item, covered)
        yield from zip(group, counts, best, strict=True)


def _broadcast(benchmark: DataFrame, chars: int) -> list:
    items = benchmark.select("item_id", "text")
    return [benchmark.sparkSession.sparkContext.broadcast(block) for block in _blocks(items, chars)]


def decontaminate(
    df: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    least: int = LEAST,
    share: float = SHARE,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Per document: doc_id, n_items, item_id and coverage of the best covered item, contaminated."""
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, n_items long, item_id {dict(benchmark.dtypes)['item_id']}, coverage double"
    sent = _broadcast(benchmark, block_chars)
    kind = to_arrow_type(benchmark.schema["item_id"].dataType)

    def judge(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch, n, top in _judged(sent, least, share, batches):
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    pa.array(n),
                    pa.array([m[0] if m else None for m in top], kind),
                    pa.array([m[1] if m else None for m in top], pa.float64()),
                ],
                ["doc_id", "n_items", "item_id", "coverage"],
            )

    out = rows.mapInArrow(judge, schema)
    return out.withColumn("contaminated", F.col("n_items") > 0)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that hold no benchmark item.

    Each row is judged by its own text: rows with a null or repeated doc_id like all others. A null text stays,
    an empty table gives no rows.
    """
    sent = _broadcast(table(spark, sf_dir, "benchmark"), BLOCK_CHARS)

    def clean(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch, n, _ in _judged(sent, LEAST, SHARE, batches):
            yield batch.filter(pa.array(n == 0))

    return docs.mapInArrow(clean, docs.schema)
