"""Operator 8: substring deduplication with run-compressed suffix indexes.

A byte is removed if it lies in a string of ``length`` bytes that also starts in a document with a smaller
doc_id. Three passes find those strings without comparing everything with everything:

1. *Seeds.* In every window of ``length`` bytes the run of 16 bytes with the smallest fingerprint is its
   seed. Equal windows have equal seeds, and neighbouring windows mostly share theirs, so a text has one
   seed per 18 bytes or so. Tasks send only packed, sorted fingerprint prefixes of the seeds of a few
   megabytes of text at a time, dealt by ranges; the answer names the documents whose seed occurs in another one too.
   Seeds that several documents of one batch share are answered on the spot and sent once, so a passage
   that a third of all documents hold costs a row per batch.
2. *Indexes.* Only stretches of text around such seeds go on, dealt by seed. Of the stretches of a deal those are
   indexed that have a window whose first 32 bytes have the fingerprint of a later document's window, and those are
   streamed that have one of an earlier document, both cut to such windows. The index is
   a run-compressed Burrows-Wheeler transform with the suffix positions at both ends of every run, and the
   earliest document of each group of suffixes that agree in ``length`` bytes, as runs over the rows: all in
   proportion to the runs. Streaming a stretch backwards gives its matching statistics, for every byte the
   length of the longest match that starts there (up to ``length``) and a place of it in the indexed text:
   while the next byte continues the match it is a step within a run, else the nearest runs of that byte above
   and below are tried, and the text at their sampled positions tells which keeps more of the match. Where the
   length reaches ``length`` the window is marked if the earliest document at that place comes before its own.
   A hot seed, one with ``HOT`` different stretches or more, would make one deal too large: its windows are
   dealt one by one, by a hash of their own bytes, so that equal windows meet and the rest of its documents
   spread over all deals. Of equal windows in a few megabytes of text only the smallest document's goes on.
   Which seeds are hot is counted in a sample of the documents; it decides where windows meet, never which are
   removed.
3. The marked spans are joined with their documents, and what is left is written out.

Seeds are a filter only: a window is removed for equal bytes, never for an equal fingerprint.

Defined cases: a null text is empty; texts shorter than ``length`` keep everything; documents with a null
doc_id are neither compared nor cut; repeated rows are cut alike; different texts under one doc_id are parts
of one document: each is cut by its own spans, and what they share with each other stays (texts of one
doc_id are told apart by a 64-bit hash); matches inside one document do not count; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .expressions import fresh
from .grouping import map_groups
from .workspace import table

LENGTH, SEED = 50, 16
#: Symbols that are compared at a time.
PIECE = 16
#: Bytes of text that are hashed at a time (arrays of it stay in a core's cache), sent at a time and dealt to one group, and the least number of deals.
BLOCK, GATHER, BUCKET, DEALS = 131_072, 24_000_000, 32_000_000, 64
#: A deal's parts by bytes of text, and bytes of stretches that are indexed at a time, in as many parts as it takes.
PART, INDEX = 1_000_000, 8_000_000
#: Rows of bytes that are compared at a time.
ROWS = 65_536
#: Different stretches that make a seed hot, and the share of documents (one in so many) in which they are counted.
HOT, SAMPLE = 8192, 64
_BYTES = np.random.default_rng(77).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTOR = 0x9E3779B97F4A7C15


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(30))


def _polynomials(buf: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the ``size`` bytes (a power of two) from every place."""
    h, done = _BYTES[buf], 1
    while done < size:
        h = h[:-done] * np.uint64(pow(_FACTOR, done, 2**64)) + h[done:]
        done *= 2
    return h


def _block_seeds(buf: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    low, span = _mix(_polynomials(buf, SEED)), length - SEED + 1
    size = 1
    while 2 * size <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if span > size:
        low = np.minimum(low[: len(low) - (span - size)], low[span - size :])
    text = np.flatnonzero(sizes >= length)
    begin = (np.cumsum(sizes) - sizes)[text]
    end = begin + sizes[text] - length + 1
    new = np.append(True, low[1:] != low[:-1])
    new[begin] = True
    new[end[end < len(low)]] = True  # windows across two texts
    start = np.flatnonzero(new)
    stop = np.append(start[1:], len(low))
    k = np.searchsorted(begin, start, "right") - 1
    whole = (k >= 0) & (start < end[k])
    start, stop, k = start[whole], stop[whole], k[whole]
    times = -(-(stop - start) // span)
    if times.max(initial=1) > 1:
        start = np.repeat(start, times) + span * (np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times))
        stop, k = np.minimum(start + span, np.repeat(stop, times)), np.repeat(k, times)
    return _mix(low[start] * np.uint64(_FACTOR)), text[k], start, stop - 1


def seeds(buf: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of windows with one seed: fingerprint, text number, first and last window start.

    ``buf`` has the joined bytes of all texts, in which starts count. A stretch has at most as many windows as
    can share one seed.
    """
    none = np.empty(0, np.int64)
    out, first, lo = [(none.astype(np.uint64), none, none, none)], np.append(0, np.cumsum(sizes)), 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(first, first[lo] + BLOCK, "right")) - 1)
        if (sizes[lo:hi] >= length).any():
            print_, of, start, last = _block_seeds(buf[first[lo] : first[hi]], sizes[lo:hi], length)
            out.append((print_, of + lo, start + first[lo], last + first[lo]))
        lo = hi
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Joined bytes and sizes of an Arrow column of texts or binaries; null is empty."""
    import pyarrow as pa

    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return np.empty(0, np.uint8), np.empty(0, np.int64)
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if ends[0] == ends[-1]:
        return np.empty(0, np.uint8), np.diff(ends)
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]], np.diff(ends)


def _chunks(batches: Iterator) -> Iterator:
    """The rows in batches of about ``GATHER`` bytes of text, short batches together."""
    import pyarrow as pa

    def together():
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    held, size = [], 0
    for batch in batches:
        ends, lo = np.append(0, np.cumsum(_bytes(batch["text"])[1])), 0
        while lo < len(batch):
            hi = min(len(batch), max(lo + 1, int(np.searchsorted(ends, ends[lo] + GATHER - size))))
            held.append(batch.slice(lo, hi - lo))
            size += int(ends[hi] - ends[lo])
            lo = hi
            if size >= GATHER:
                yield together()
                held, size = [], 0
    if held:
        yield together()


def _pack(*arrays: np.ndarray) -> bytes:
    import pickle

    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(arrays, protocol=5))


def _unpack(blob: bytes) -> tuple:
    import pickle

    import zstandard

    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


def _small(x: np.ndarray) -> np.ndarray:
    """The same numbers in the smallest unsigned type."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def _sorted_pairs(key: np.ndarray, value: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Different pairs in order; keys have at most ``bits`` bits, values are small."""
    wide = np.uint64(max(1, int(value.max(initial=0)).bit_length()))
    if bits + int(wide) <= 64:
        both = np.sort((key << wide) | value.astype(np.uint64))
        both = both[np.append(True, both[1:] != both[:-1])[: len(both)]]
        return both >> wide, (both & ((np.uint64(1) << wide) - np.uint64(1))).astype(np.int64)
    order = np.lexsort((value, key))
    key, value = key[order], value[order]
    keep = np.append(True, (key[1:] != key[:-1]) | (value[1:] != value[:-1]))[: len(key)]
    return key[keep], value[keep].astype(np.int64)


def repeated_seeds(rows: DataFrame, length: int, deals: int, width: int) -> DataFrame:
    """doc_id, prefix: seeds (``width`` bytes of the fingerprint) that occur in another document too. A deal is a range of prefixes."""

    def send(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for chunk in _chunks(batches):
            print_, of, _, _ = seeds(*_bytes(chunk["text"]), length)
            doc, number = np.unique(chunk["doc_id"].to_numpy(), return_inverse=True)
            p, d = _sorted_pairs(print_ >> np.uint64(64 - 8 * width), number[of], 8 * width)
            new = np.append(True, p[1:] != p[:-1])[: len(p)]
            shared = ~(new & np.append(new[1:], True)[: len(p)])
            answered = [doc[d[shared]], p[shared].astype(np.int64)]
            # 0: several documents of this chunk, answered here; else one more than the document's number
            tag, p = np.where(shared, 0, d + 1)[new], p[new]
            bounds = np.searchsorted(((p >> np.uint64(8 * width - 32)) * np.uint64(deals)) >> np.uint64(32), np.arange(deals + 1, dtype=np.uint64))
            out = {"deal": [], "blob": []}
            for k in np.flatnonzero(np.diff(bounds)).tolist():
                mine = slice(bounds[k], bounds[k + 1])
                used, tags = np.unique(np.append(0, tag[mine]), return_inverse=True)
                planes = np.ascontiguousarray(p[mine].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
                out["deal"].append(k)
                out["blob"].append(_pack(planes, _small(tags[1:]), doc[used[1:] - 1]))
            for lo in range(0, len(answered[0]), 50_000):  # go through as they are
                out["deal"].append(int(doc[0]) % deals)
                out["blob"].append(_pack(answered[0][lo : lo + 50_000], answered[1][lo : lo + 50_000]))
            yield pa.RecordBatch.from_pydict({"deal": pa.array(out["deal"], pa.int32()), "blob": pa.array(out["blob"], pa.binary())})

    def answer(t, bounds):
        import pyarrow as pa

        docs, found = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        blobs = t["blob"]
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            prefix, tagged, names = [], [], []
            for k in range(lo, hi):
                parts = _unpack(blobs[int(k)].as_py())
                if len(parts) == 2:
                    docs.append(parts[0])
                    found.append(parts[1])
                    continue
                raw = np.zeros((parts[0].shape[1], 8), np.uint8)
                raw[:, :width] = parts[0].T
                prefix.append(raw.view("<u8")[:, 0])
                tagged.append(parts[1])
                names.append(parts[2])
            if not prefix:
                continue
            known, prefix = np.unique(np.concatenate(names)), np.concatenate(prefix)
            tag = np.concatenate([np.append(0, np.searchsorted(known, n) + 1)[x] for n, x in zip(names, tagged, strict=True)])
            base = prefix.min()
            prefix, tag = _sorted_pairs(prefix - base, tag, int(prefix.max() - base).bit_length())
            starts = np.flatnonzero(np.append(True, prefix[1:] != prefix[:-1]))
            times = np.diff(np.append(starts, len(prefix)))
            # Tags are in order: of several rows the first is 0, or the first and last are different documents.
            pick = np.repeat((times > 1) | (tag[starts] == 0), times) & (tag > 0)
            docs.append(known[tag[pick] - 1])
            found.append((prefix[pick] + base).astype(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(docs)), pa.array(np.concatenate(found))], ["doc_id", "prefix"])

    sent = rows.mapInArrow(send, "deal int, blob binary")
    return map_groups(sent, ["deal"], answer, "doc_id long, prefix long")


def _padded(buf: np.ndarray, first: np.ndarray, sizes: np.ndarray, length: int) -> np.ndarray:
    """Stretches as rows of one width: zeros behind their bytes, and their size in the last byte."""
    width = (2 * length - SEED) // 8 * 8 + 8
    rows = np.lib.stride_tricks.sliding_window_view(np.append(buf, np.zeros(width, np.uint8)), width)[first]
    rows[np.arange(width) >= sizes[:, None]] = 0
    rows[:, -1] = sizes
    return rows


def hot_seeds(rows: DataFrame, length: int) -> np.ndarray:
    """Sorted fingerprints of the seeds that have about ``HOT`` different stretches or more."""

    def stretches(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for chunk in _chunks(batches):
            buf, sizes = _bytes(chunk["text"])
            print_, _, first, last = seeds(buf, sizes, length)
            content = _row_hashes(_padded(buf, first, last + length - first, length))
            yield pa.RecordBatch.from_arrays([pa.array(print_.view(np.int64)), pa.array(content.view(np.int64))], ["print", "content"])

    sample = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).select("text")
    several = sample.mapInArrow(stretches, "print long, content long").distinct().groupBy("print").count()
    found = several.filter(F.col("count") >= max(2, HOT // SAMPLE)).select("print").toArrow()["print"]
    return np.sort(found.to_numpy().view(np.uint64))


def _row_hashes(rows: np.ndarray) -> np.ndarray:
    """Fingerprints of rows of bytes."""
    if rows.shape[1] % 8:
        rows = np.pad(rows, ((0, 0), (0, -rows.shape[1] % 8)))
    h = np.zeros(len(rows), np.uint64)
    for word in rows.view("<u8").T:
        h = (h ^ word) * np.uint64(_FACTOR)
        h ^= h >> np.uint64(29)
    return _mix(h)


def first_equal(prints: np.ndarray, docs: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each row an equal one of the smallest document, the same for all; ``prints`` only bring equal ones together."""
    order = np.lexsort((docs, prints))
    p = prints[order]
    starts = np.flatnonzero(np.append(True, p[1:] != p[:-1])[: len(p)])
    sizes = np.diff(np.append(starts, len(p)))
    head, several = order[np.repeat(starts, sizes)], np.repeat(sizes > 1, sizes)
    out = np.arange(len(docs))
    order, head = order[several], head[several]
    same = np.empty(len(order), bool)
    for lo in range(0, len(order), ROWS):
        part = slice(lo, lo + ROWS)
        same[part] = (rows[order[part]] == rows[head[part]]).all(1)
    out[order[same]] = head[same]
    if not same.all():  # different rows of one fingerprint
        found: dict = {}
        for k in order[~same].tolist():
            out[k] = found.setdefault(rows[k].tobytes(), k)
    return out


def earlier_windows(prints: np.ndarray, docs: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Whether a smaller document among these has the same window; ``prints`` only bring equal ones together."""
    return docs[first_equal(prints, docs, windows)] < docs


Spans = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _merged(doc: np.ndarray, version: np.ndarray, start: np.ndarray, stop: np.ndarray) -> Spans:
    """Spans of one text that overlap or touch as one."""
    by = np.lexsort((start, version, doc))
    doc, version, start, stop = doc[by], version[by], start[by], stop[by]
    if not len(doc):
        return doc, version, start, stop
    new = np.append(True, (doc[1:] != doc[:-1]) | (version[1:] != version[:-1]))
    group = np.cumsum(new) - 1
    shift = group * (int(stop.max()) + 1)
    reach = np.maximum.accumulate(stop + shift)
    cut = np.append(True, (start + shift)[1:] > reach[:-1]) | new
    ends = np.append(np.flatnonzero(cut)[1:], len(doc)) - 1
    return doc[cut], version[cut], start[cut], (reach - shift)[ends]


def _ranked(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys of ``bits`` bits, equal ones by place, and the rank of each from 1, equal ones alike.

    Where key and place fit into one number the numbers are sorted themselves, which takes a fraction of the time.
    """
    n = len(key)
    wide = np.uint64(max(1, n.bit_length()))
    if bits + int(wide) <= 64:
        both = np.sort((key << wide) | np.arange(n, dtype=np.uint64))
        order = (both & ((np.uint64(1) << wide) - np.uint64(1))).astype(np.int64)
        ordered = both >> wide
    else:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
    rank = np.empty(n, np.uint64)
    rank[order] = np.cumsum(np.append(True, ordered[1:] != ordered[:-1])[:n])
    return order, rank


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of many short stretches, each of one document.

    For each run: ``starts`` and ``stops`` its first row and the one behind it, ``heads`` its symbol, ``leads`` the row that its first symbol leads
    to, ``first`` and ``last`` the suffix positions at its two ends. ``by_symbol`` has the runs ordered by
    symbol, to find the nearest run of a symbol. ``earliest`` is the smallest document among the suffixes that
    agree in ``length`` bytes, as runs of rows that begin at ``earliest_starts``. Beside these stands the
    text itself, one small number per byte, in which matches are compared.
    """

    def __init__(self, stretches: list[bytes], docs: np.ndarray, length: int):
        sizes = np.array([len(s) for s in stretches], np.int64)
        raw = np.frombuffer(b"".join(s + b"\0" for s in stretches), np.uint8)
        ends = np.cumsum(sizes + 1) - 1
        n, place = len(raw), np.arange(len(raw))
        inside = np.ones(n, bool)
        inside[ends] = False
        used = np.zeros(256, bool)
        used[raw[inside]] = True
        # The bytes that occur, numbered from 1, others -1; ends of stretches sort before all bytes.
        self.symbol = np.where(used, np.cumsum(used), -1).astype(np.int64)
        joined = np.where(inside, self.symbol[raw], 0).astype(np.uint64)
        order, half, width = self._suffixes(joined, np.repeat(ends, sizes + 1) - place, int(sizes.max(initial=0)), length)
        # Groups of neighbouring suffixes that agree in `length` bytes: two overlapping pieces.
        full = (np.repeat(ends, sizes + 1) - place)[order] >= length
        a, b = half[order], half[np.minimum(order + length - width, n - 1)]
        same = np.append(False, full[1:] & full[:-1] & (a[1:] == a[:-1]) & (b[1:] == b[:-1]))
        # Shorter suffixes are nobody's match and join the group before them.
        groups = np.flatnonzero((full & ~same) | (np.arange(n) == 0))
        doc = np.where(full, np.repeat(docs, sizes + 1)[order], np.iinfo(np.int64).max)
        low = np.repeat(np.minimum.reduceat(doc, groups), np.diff(np.append(groups, n)))
        self.earliest_starts = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
        self.earliest = low[self.earliest_starts]
        before = joined[order - 1].astype(np.int64)
        before[order == 0] = 0
        self.starts = np.flatnonzero(np.append(True, before[1:] != before[:-1]))
        self.stops = np.append(self.starts[1:], n)
        self.heads, counts = before[self.starts], self.stops - self.starts
        self.first, self.last = order[self.starts], order[self.stops - 1]
        by = np.argsort(self.heads, kind="stable")
        self.by_symbol = self.heads[by] * len(by) + by
        times = np.bincount(joined.astype(np.int64))
        within = np.cumsum(counts[by]) - counts[by]
        begin = np.append(True, self.heads[by][1:] != self.heads[by][:-1])
        within -= np.maximum.accumulate(np.where(begin, within, 0))
        self.leads = np.empty(len(by), np.int64)
        self.leads[by] = (np.cumsum(times) - times)[self.heads[by]] + within
        self.text = np.append(joined, np.zeros(PIECE + length, np.uint64)).astype(np.min_scalar_type(int(joined.max(initial=0))))
        self.length = length

    @staticmethod
    def _suffixes(joined: np.ndarray, left: np.ndarray, longest: int, length: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Suffix order by prefix doubling, and the ranks by the first ``width`` symbols (at most ``length``).

        ``left`` has the symbols up to the end of the stretch, behind which nothing counts.
        """
        n, place = len(joined), np.arange(len(joined))
        bits = max(1, int(joined.max(initial=0)).bit_length())
        size = min(42 // bits, length)
        key, padded = np.zeros(n, np.uint64), np.append(joined, np.zeros(size, np.uint64))
        for k in range(size):
            key = (key << np.uint64(bits)) | np.where(left >= k, padded[k : k + n], np.uint64(0))
        order, rank = _ranked(key, bits * size)
        half, width = rank, size
        while size <= longest:
            wide = int(rank.max(initial=0)).bit_length()
            later = np.where(left >= size, rank[np.minimum(place + size, n - 1)], np.uint64(0))
            order, rank = _ranked((rank << np.uint64(wide)) | later, 2 * wide)
            size *= 2
            if size <= length:
                half, width = rank, size
        return order, half, width

    def _agree(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Symbols in which the texts from places a and b agree, up to ``most``."""
        out, on, done = np.zeros(len(a), np.int64), np.flatnonzero(most > 0), 0
        windows = np.lib.stride_tricks.sliding_window_view(self.text, PIECE)
        while len(on):
            differ = windows[a[on] + done] != windows[b[on] + done]
            whole = ~differ.any(1)
            out[on] = done + np.where(whole, PIECE, differ.argmax(1))
            on = on[whole & (most[on] > done + PIECE)]
            done += PIECE
        return np.minimum(out, most)

    def statistics(self, patterns: list[bytes]) -> Iterator[Spans]:
        """Matching statistics of all patterns, one byte further back at a time.

        (pattern numbers, starts, lengths of the longest match with the indexed text, up to ``length``, rows of
        its places); :meth:`before` tells the earliest document at a row.
        """
        sizes = np.array([len(s) for s in patterns], np.int64)
        stream, ends = self.symbol[np.frombuffer(b"".join(patterns), np.uint8)], np.cumsum(sizes)
        number, runs = np.arange(len(sizes)), len(self.starts)
        row, at, match = (np.zeros(len(sizes), np.int64) for _ in range(3))
        at += self.first[0]
        for step in range(1, int(sizes.max(initial=0)) + 1):
            on = sizes[number] >= step
            number, row, at, match = number[on], row[on], at[on], match[on]
            symbol = stream[ends[number] - step]
            run = np.searchsorted(self.starts, row, "right") - 1
            other = np.flatnonzero(self.heads[run] != symbol)
            wanted = symbol[other]
            k = np.searchsorted(self.by_symbol, wanted * runs + run[other])
            sides = []
            for near, sample in ((np.maximum(k - 1, 0), self.last), (np.minimum(k, runs - 1), self.first)):
                there = self.by_symbol[near] // runs == wanted
                place = self.by_symbol[near] % runs
                kept = np.full(len(other), -1)
                kept[there] = self._agree(at[other][there], sample[place[there]], match[other][there])
                sides.append((place, sample[place], kept))
            (up, up_at, up_kept), (down, down_at, down_kept) = sides
            below = down_kept > up_kept
            run[other] = np.where(below, down, up)
            row[other] = np.where(below, self.starts[down], self.stops[up] - 1)
            at[other], match[other] = np.where(below, down_at, up_at), np.maximum(up_kept, down_kept)
            none = match < 0  # the byte does not occur in the index
            row = np.where(none, 0, self.leads[run] + row - self.starts[run])
            at = np.where(none, self.first[0], at - 1)
            match = np.where(none, 0, np.minimum(match + 1, self.length))
            yield number, sizes[number] - step, match, row

    def before(self, rows: np.ndarray) -> np.ndarray:
        """The earliest document that holds the first ``length`` bytes of the suffix at each row."""
        return self.earliest[np.searchsorted(self.earliest_starts, rows, "right") - 1]

    def marks(self, patterns: list[bytes], docs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(pattern numbers, window starts) of the windows that start in an earlier document as well."""
        for number, start, match, row in self.statistics(patterns):
            long = np.flatnonzero(match >= self.length)
            hit = long[self.before(row[long]) < docs[number[long]]]
            yield number[hit], start[hit]


def common_parts(buf: np.ndarray, first: np.ndarray, sizes: np.ndarray, docs: np.ndarray, length: int) -> list[tuple]:
    """What of the stretches is worth indexing, and what is worth streaming: numbers of stretches, starts and ends in ``buf``.

    A filter: a window can only be another document's too if that one has a window whose first bytes have the
    same fingerprint. Stretches come in the order of their documents and are cut to such windows.
    """
    times = sizes - length + 1
    of = np.repeat(np.arange(len(sizes)), times)
    at = first[of] + np.arange(len(of)) - (np.cumsum(times) - times)[of]
    wide = np.uint64(max(1, len(of).bit_length()))
    blocks = [_mix(_polynomials(buf[lo : lo + BLOCK + 2 * SEED - 1], 2 * SEED)) for lo in range(0, len(buf) - 2 * SEED + 1, BLOCK)]
    both = np.sort((np.concatenate(blocks)[at] >> wide << wide) | np.arange(len(of), dtype=np.uint64))
    k, key = (both & ((np.uint64(1) << wide) - np.uint64(1))).astype(np.int64), both >> wide
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    counts = np.diff(np.append(starts, len(key)))
    doc = docs[of[k]]
    out = []
    for other in (np.repeat(doc[starts + counts - 1], counts) > doc, np.repeat(doc[starts], counts) < doc):
        window = np.sort(k[other])
        head = np.append(True, of[window][1:] != of[window][:-1])[: len(window)]
        out.append((of[window][head], at[window][head], at[window][np.append(head[1:], True)[: len(head)]] + length))
    return out


def resolve(buf: np.ndarray, sizes: np.ndarray, docs: np.ndarray, versions: np.ndarray, at: np.ndarray, length: int) -> Spans:
    """Removed spans (doc, version, start, stop) that the stretches of one deal show, joined in ``buf``.

    Equal stretches are taken once, under their first document.
    """
    first = np.cumsum(sizes) - sizes
    rows = _padded(buf, first, sizes, length)
    own = first_equal(_row_hashes(rows), docs, rows)
    later = docs[own] < docs
    out = [(docs[later], versions[later], at[later], at[later] + sizes[later])]
    each = np.unique(own)
    each = each[np.argsort(docs[each], kind="stable")]
    indexed, streamed = common_parts(buf, first[each], sizes[each], docs[each], length)
    marks = []
    if len(indexed[0]):
        data = buf.tobytes()
        parts = [[data[a:b] for a, b in zip(x[1].tolist(), x[2].tolist(), strict=True)] for x in (indexed, streamed)]
        index = RunIndex(parts[0], docs[each[indexed[0]]], length)
        marks = list(index.marks(parts[1], docs[each[streamed[0]]]))
    if marks:
        part, start = (np.concatenate(x) for x in zip(*marks, strict=True))
        seg = each[streamed[0]][part]
        start = start + streamed[1][part] - first[seg]
        by = np.lexsort((start, seg))
        seg, start = seg[by], start[by]
        lo, hi = np.searchsorted(seg, own[~later], "left"), np.searchsorted(seg, own[~later], "right")
        take = np.repeat(lo, hi - lo) + np.arange((hi - lo).sum()) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
        s = np.repeat(at[~later], hi - lo) + start[take]
        out.append((np.repeat(docs[~later], hi - lo), np.repeat(versions[~later], hi - lo), s, s + length))
    return _merged(*(np.concatenate(x) for x in zip(*out, strict=True)))


def _groups(deal: np.ndarray) -> list[tuple[int, int, int]]:
    """(deal, begin, end) of the runs of equal numbers."""
    starts = np.flatnonzero(np.append(True, deal[1:] != deal[:-1])[: len(deal)])
    return list(zip(deal[starts].tolist(), starts.tolist(), np.append(starts[1:], len(deal)).tolist(), strict=True))


def _together(ends: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Neighbouring parts that have up to ``most`` together, or one that has more; ``ends``: what lies before each part and before the end."""
    out, k = [], 0
    while k < len(ends) - 1:
        to = max(k + 1, int(np.searchsorted(ends, ends[k] + most, "right")) - 1)
        out.append((k, to))
        k = to
    return out


def dealt_stretches(rows: DataFrame, length: int, total: int) -> DataFrame:
    """deal, blob: packed stretches, and windows of hot seeds, that may occur in several documents.

    A deal has the stretches of some ``BUCKET`` bytes of text, sorted into parts of ``PART`` bytes that have their seeds
    to themselves: what is sent at a time makes a blob for each deal, and what is indexed at a time is smaller.
    """
    width = next(w for w in (4, 5, 6, 7) if w == 7 or total < 1 << (8 * w - 2))  # about 1 in 70 seeds agrees by chance
    asked = repeated_seeds(rows, length, max(8, total // BUCKET), width).groupBy("doc_id").agg(F.collect_set("prefix").alias("prefixes"))
    deals = max(DEALS, min(4 * DEALS, total // (BUCKET // 8)), total // BUCKET)
    parts = max(1, round(total / deals / PART))
    hot = rows.sparkSession.sparkContext.broadcast(hot_seeds(rows, length))

    def send(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for chunk in _chunks(batches):
            (buf, sizes), out = _bytes(chunk["text"]), {"deal": [], "blob": []}
            print_, of, first, last = seeds(buf, sizes, length)
            prefix = print_ >> np.uint64(64 - 8 * width)
            wanted = np.unique(chunk["prefixes"].flatten().to_numpy().view(np.uint64))
            pick = wanted_seeds(prefix, wanted)
            print_, of, first, last = print_[pick], of[pick], first[pick], last[pick]
            docs, versions = chunk["doc_id"].to_numpy()[of], chunk["version"].to_numpy()[of]
            where, n = first - (np.cumsum(sizes) - sizes)[of], last + length - first
            table = _padded(buf, first, n, length)
            later = earlier_windows(_row_hashes(table), docs, table)  # an earlier document of this chunk holds it
            spans = [(docs[later], versions[later], where[later], n[later])]
            apart = np.isin(print_, hot.value)
            left = np.flatnonzero(~later & ~apart)
            deal = print_[left] % np.uint64(deals)
            part = print_[left] // np.uint64(deals) % np.uint64(parts)
            by = np.argsort(deal * np.uint64(parts) + part, kind="stable")
            left, deal, part = left[by], deal[by].astype(np.int64), part[by].astype(np.int64)
            for k, lo, hi in _groups(deal):
                mine = left[lo:hi]
                data = table[mine][np.arange(table.shape[1]) < n[mine][:, None]]
                bounds = np.searchsorted(part[lo:hi], np.arange(parts + 1))
                out["deal"].append(k)
                out["blob"].append(_pack(docs[mine], versions[mine], _small(where[mine]), _small(n[mine]), data, bounds))
            del table
            single = np.flatnonzero(~later & apart)
            for lo in range(0, len(single), 20_000):
                mine = single[lo : lo + 20_000]
                times = (last - first)[mine] + 1
                mine, within = np.repeat(mine, times), np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                windows = np.lib.stride_tricks.sliding_window_view(buf, length)[first[mine] + within]
                doc, version, at, prints = docs[mine], versions[mine], where[mine] + within, _row_hashes(windows)
                again = earlier_windows(prints, doc, windows)
                text, which, start, stop = _merged(doc[again], version[again], at[again], at[again] + length)
                spans.append((text, which, start, stop - start))
                alone = np.flatnonzero(~again)
                to = (prints[alone] % np.uint64(deals)).astype(np.int64)
                by = np.argsort(to, kind="stable")
                alone = alone[by]
                for k, a, b in _groups(to[by]):
                    one = alone[a:b]
                    out["deal"].append(k)
                    out["blob"].append(_pack(doc[one], version[one], _small(at[one]), windows[one], np.array([length])))
            doc, version, at, size = (np.concatenate(x) for x in zip(*spans, strict=True))
            if len(doc):
                out["deal"].append(int(doc[0]) % deals)
                out["blob"].append(_pack(doc, version, _small(at), _small(size)))
            yield pa.RecordBatch.from_pydict({"deal": pa.array(out["deal"], pa.int32()), "blob": pa.array(out["blob"], pa.binary())})

    return rows.join(asked, "doc_id").select("doc_id", "prefixes", "version", "text").mapInArrow(send, "deal int, blob binary")


def wanted_seeds(prefix: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of the prefixes that are among ``wanted`` (sorted); most fail in a table of bits that is looked at first."""
    if not len(wanted):
        return np.empty(0, np.int64)
    some, low = np.zeros(1 << 22, bool), np.uint64((1 << 22) - 1)
    some[wanted & low] = True
    maybe = np.flatnonzero(some[prefix & low])
    return maybe[wanted[np.minimum(np.searchsorted(wanted, prefix[maybe]), len(wanted) - 1)] == prefix[maybe]]


def removed_spans(rows: DataFrame, length: int, total: int) -> DataFrame:
    """doc_id, version, start, stop of removed stretches, possibly overlapping; ``rows``: doc_id, version, text."""

    def mark(t, bounds):
        import pyarrow as pa

        found = [(np.empty(0, np.int64),) * 4]
        blobs = t["blob"]
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            sent, single = [], []
            for k in range(lo, hi):
                parts = _unpack(blobs[int(k)].as_py())
                if len(parts) == 4:
                    start = parts[2].astype(np.int64)
                    found.append((*parts[:2], start, start + parts[3]))
                elif len(parts) == 5:
                    single.append((*parts[:2], parts[2].astype(np.int64), parts[3]))
                else:
                    sent.append((*parts, np.append(0, np.cumsum(parts[3], dtype=np.int64))))
            for begin, end in _together(sum(x[6][x[5]] for x in sent), INDEX) if sent else ():
                mine = [(x, slice(x[5][begin], x[5][end])) for x in sent]
                docs, versions, at, sizes = (np.concatenate([x[c][rows] for x, rows in mine]).astype(np.int64) for c in range(4))
                data = np.concatenate([x[4][x[6][rows.start] : x[6][rows.stop]] for x, rows in mine])
                if len(docs):
                    found.append(resolve(data, sizes, docs, versions, at, length))
            if single:
                doc, version, start, windows = (np.concatenate(x) for x in zip(*single, strict=True))
                later = earlier_windows(_row_hashes(windows), doc, windows)
                found.append(_merged(doc[later], version[later], start[later], start[later] + length))
        columns = [pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*found, strict=True)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "version", "start", "stop"])

    return map_groups(dealt_stretches(rows, length, total), ["deal"], mark, "doc_id long, version long, start long, stop long")


def substring_dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """doc_id, text, spans array<struct<start, stop>> (bytes, maximal, sorted), kept (binary: what is left)."""
    if length < 2 * SEED or length > 56:
        raise ValueError("length must lie between 32 and 56")
    # Columns that need no new name stay as they are: then both joins below share one dealing of the texts.
    key = F.col(doc_id) if dict(df.dtypes)[doc_id] == "bigint" else F.col(doc_id).cast("long").alias("doc_id")
    every = df.select(
        key if doc_id == "doc_id" else key.alias("doc_id"), F.col(text) if text == "text" else F.col(text).alias("text")
    )
    rows = every.filter("doc_id IS NOT NULL").withColumn("version", F.xxhash64("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    spans = removed_spans(rows, length, total)
    listed = spans.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("version", "start", "stop"))).alias("spans"))

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        fields = [pa.field("start", pa.int64()), pa.field("stop", pa.int64())]
        for batch in batches:
            buf, sizes = _bytes(batch["text"])
            begin, version = np.cumsum(sizes) - sizes, batch["version"].to_numpy()
            listed = batch["spans"].fill_null([])
            of = np.repeat(np.arange(len(batch)), np.diff(listed.offsets.to_numpy()))
            every = listed.flatten()
            which, start, stop = (every.field(c).to_numpy() for c in ("version", "start", "stop"))
            own = which == version[of]
            of, _, start, stop = _merged(of[own], np.zeros(own.sum(), np.int64), start[own], stop[own])
            counts = np.append(0, np.cumsum(np.bincount(of, minlength=len(batch)))).astype(np.int32)
            merged = pa.ListArray.from_arrays(pa.array(counts), pa.StructArray.from_arrays([pa.array(start), pa.array(stop)], fields=fields))
            data = memoryview(buf)
            left = zip(np.append(0, begin[of] + stop).tolist(), np.append(begin[of] + start, len(buf)).tolist(), strict=True)
            kept = b"".join([data[a:b] for a, b in left])
            ends = np.append(0, np.cumsum(sizes - np.bincount(of, stop - start, len(batch)).astype(np.int64)))
            kept = pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(kept)])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text"], merged, kept], ["doc_id", "text", "spans", "kept"])

    # The same dealing of the documents by doc_id serves the join above and this one.
    joined = rows.join(listed, "doc_id", "left").select("doc_id", "text", "version", "spans")
    without_id = every.filter("doc_id IS NULL").withColumns(
        {"version": F.lit(0).cast("long"), "spans": F.lit(None).cast(dict(joined.dtypes)["spans"])}
    )
    return joined.unionByName(without_id).mapInArrow(
        cut, "doc_id long, text string, spans array<struct<start:long,stop:long>>, kept binary"
    )


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup(table(spark, sf_dir, "documents"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return done.select(
        "doc_id",
        size.alias("n_bytes"),
        (size - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts without what an earlier document holds; documents left without a word go.

    Where a cut splits a character its other bytes are dropped, so that texts stay valid; n_chars is the
    new length. Rows with a null doc_id keep their text; repeated rows all stay, cut alike; an empty table
    gives no rows.
    """

    def clean(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            text = [k.decode("utf-8", "ignore") for k in batch["kept"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["version"], pa.array(text, pa.string())], [doc, version, kept])

    names, kinds = docs.columns, dict(docs.dtypes)
    of, doc, version, kept = fresh(docs, "version_of", "doc", "version", "kept")
    # Rows without an id are not cut. The others meet their cut texts by plain keys, so those are dealt once.
    known = docs.filter("doc_id IS NOT NULL")
    left = substring_dedup(known).select("doc_id", F.xxhash64("text").alias("version"), "kept")
    left = left.mapInArrow(clean, f"{doc} long, {version} long, {kept} string").filter(F.col(kept).rlike(r"\S")).dropDuplicates([doc, version])
    new = {"text": F.col(kept)}
    if "n_chars" in names:
        new["n_chars"] = F.length(kept).cast(kinds["n_chars"])
    cut = known.withColumn(of, F.xxhash64("text")).join(left, (F.col("doc_id") == F.col(doc)) & (F.col(of) == F.col(version)))
    whole = docs.filter("doc_id IS NULL").withColumn(kept, F.col("text")).filter(F.col(kept).rlike(r"\S"))
    return cut.withColumns(new).select(*names).unionByName(whole.withColumns(new).select(*names))
