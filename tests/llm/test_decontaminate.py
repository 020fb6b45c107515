"""Greedy string tiling against a plain search for the longest matches."""

import time

import numpy as np

from inkwell.llm import decontaminate as D
from inkwell.llm.decontaminate import WORD, Benchmark, decontaminate, tiles

ITEM = " ".join(f"w{i}" for i in range(30))


def _plain(doc, item, least):
    a, b, out = list(doc), list(item), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] is not None and a[i + n] == b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        if best[0] < least:
            return sum(n for n, _, _ in out)
        n, i, j = best
        out.append(best)
        a[i : i + n] = [None] * n
        b[j : j + n] = [None] * n


def test_tiles_match_a_plain_search():
    rng = np.random.default_rng(3)
    for _ in range(60):
        item = rng.integers(0, 6, 18)
        doc = np.concatenate([item[9:], rng.integers(0, 6, 12), item[:9]])
        got = tiles(doc, item, 3)
        assert all((doc[i : i + n] == item[j : j + n]).all() and n >= 3 for i, j, n in got)
        for side, size in ((0, len(doc)), (1, len(item))):
            used = np.zeros(size, int)
            for t in got:
                used[t[side] : t[side] + t[2]] += 1
            assert used.max(initial=0) <= 1
        assert sum(t[2] for t in got) == _plain(doc.tolist(), item.tolist(), 3)


def test_tiles_of_repetitive_texts():
    rng = np.random.default_rng(6)
    for size in (1, 2, 3):
        for _ in range(40):
            doc, item = rng.integers(0, size, int(rng.integers(0, 40))), rng.integers(0, size, int(rng.integers(1, 25)))
            assert sum(t[2] for t in tiles(doc, item, 2)) == _plain(doc.tolist(), item.tolist(), 2)
    took = []
    for k in (1, 8):
        start = time.perf_counter()
        assert tiles(np.zeros(20_000 * k, np.int64), np.zeros(2000 * k, np.int64), 5) == [(0, 0, 2000 * k)]
        took.append(time.perf_counter() - start)
    assert took[1] < 40 * took[0] + 1


def test_item_ids_of_any_type(spark):
    bench = spark.createDataFrame([("q2", ITEM), ("q1", ITEM), (None, ITEM)], "item_id string, text string")
    got = decontaminate(spark.createDataFrame([(1, ITEM)], "doc_id long, text string"), bench).first()
    assert (got.n_items, got.item_id, got.contaminated) == (3, "q1", True)


def test_leaks(spark):
    words = ITEM.split()
    docs = [
        (1, f"intro {ITEM} outro"), (2, " ".join(words[15:] + ["x"] + words[:15]).upper()),
        (3, " ".join(words[:12])), (4, None), (5, ""), (6, "tiny item"), (7, " ".join(w for i, w in enumerate(words) if i % 4)),
        (8, "of " * 5000), (1, ITEM),
    ]
    df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(9, ITEM, 1), (3, "Tiny, item!", 1), (4, None, 1), (5, "", 1), (9, ITEM, 2)], "item_id long, text string, doc_id int")
    for chars in (8_000_000, 50):
        got = {(r.doc_id, r.contaminated, r.item_id) for r in decontaminate(df, bench, block_chars=chars).collect()}
        want = {(1, True, 9), (2, True, 9), (6, True, 3), *((k, False, None) for k in (3, 4, 5, 7, 8))}
        assert got == want
    assert decontaminate(df.filter("false"), bench).count() == 0
    assert decontaminate(df, bench.filter("false")).filter("contaminated").count() == 0


def test_seed_bound_is_no_smaller_than_the_tiles():
    index = Benchmark([(1, ITEM)], 5)
    text = " ".join(ITEM.split()[20:] + ITEM.split()[:20])
    assert index.judge([text, "nothing"], 0.5)[0][0][1] == 1.0
    assert WORD.findall("a-b c") == ["a", "b", "c"]


def test_every_row_is_judged_alike_for_any_number_of_blocks(spark, monkeypatch):
    other = " ".join(f"v{i}" for i in range(20))
    docs = [(1, f"{ITEM} {other}"), (1, ITEM), (1, "clean"), (None, ITEM), (None, "clean"), (None, None), (2, other), (2, other), (3, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    items = [(9, ITEM), (9, ITEM), (None, other), (None, ITEM), (4, other), (7, None)]
    bench = spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    want = sorted([
        (1, 5, 4, True), (1, 3, 9, True), (1, 0, None, False), (None, 3, 9, True), (None, 0, None, False), (None, 0, None, False),
        (2, 2, 4, True), (2, 2, 4, True), (3, 0, None, False),
    ], key=str)
    for chars in (8_000_000, 150, 1):
        monkeypatch.setattr(D, "GROUP_CHARS", 100 if chars == 1 else 32_000_000)
        got = [(r.doc_id, r.n_items, r.item_id, r.contaminated) for r in decontaminate(df, bench, block_chars=chars).collect()]
        assert sorted(got, key=str) == want


def test_blocks_are_cut_by_length_whatever_the_ids(spark):
    bench = spark.createDataFrame([(None, "x" * 40)] * 10 + [(5, "y" * 40)] * 10, "item_id long, text string")
    blocks = list(D._blocks(bench, 100))
    assert sum(map(len, blocks)) == 20 and max(map(len, blocks)) == 3


def _plain_tiles(doc, item, least):
    free_d, free_i, out = [True] * len(doc), [True] * len(item), []
    while True:
        best = (0, 0, 0)
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and free_d[i + n] and free_i[j + n]:
                    n += 1
                if n > best[2]:
                    best = (i, j, n)
        if best[2] < least:
            return out
        out.append(best)
        i, j, n = best
        free_d[i : i + n] = free_i[j : j + n] = [False] * n


def test_the_tiles_are_those_of_a_plain_search():
    rng = np.random.default_rng(12)
    for t in range(250):
        doc = rng.integers(-1 if t % 3 == 0 else 0, 2 + t % 4, int(rng.integers(1, 36)))
        item, least = rng.integers(0, 2 + t % 4, int(rng.integers(1, 24))), 1 + t % 4
        got = [tuple(map(int, x)) for x in tiles(doc, item, least)] if len(item) >= least else []
        assert got == (_plain_tiles(doc.tolist(), item.tolist(), least) if len(item) >= least else [])


def test_a_phrase_that_repeats_between_other_tokens():
    """Four thousand times in the document and two hundred times in the item: eight hundred thousand pairs of places."""
    text = lambda n, other: np.array([x for k in range(n // 6) for x in (1, 2, 3, 4, 5, other + k)])
    start = time.perf_counter()
    got = tiles(text(24_000, 10), text(1200, 10**7), 5)
    assert [(i, j, n) for i, j, n in got] == [(6 * k, 6 * k, 5) for k in range(200)] and time.perf_counter() - start < 3
    start = time.perf_counter()
    assert tiles(np.array([1, 2, 3, 4, 5, 6] * 50_000), np.array([1, 2, 3, 4, 5, 6, 9, 1, 2, 3, 4, 5]), 5) == [(0, 0, 6), (6, 7, 5)]
    assert tiles(np.ones(300_000, np.int64), np.append(np.ones(800, np.int64), np.arange(2, 400)), 5) == [(0, 0, 800)]
    assert time.perf_counter() - start < 5
