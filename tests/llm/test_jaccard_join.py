"""The join against brute force."""

import numpy as np
import pytest

from inkwell.llm import jaccard_join as j


def _brute(docs):
    sets = {}
    for i, t in docs:
        w = (t or "").split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    links = {i: [o for o in sets if o != i and sets[i] and len(sets[i] & sets[o]) * 5 >= 4 * len(sets[i] | sets[o])] for i in sets}
    out = {}
    for i in sorted(sets):
        todo, seen = [i], {i}
        while todo:
            for o in links[todo.pop()]:
                if o not in seen:
                    seen.add(o)
                    todo.append(o)
        out[i] = (min(seen), len(links[i]), len({frozenset(sets[o]) for o in links[i]} - {frozenset(sets[i])}))
    return out


def _docs():
    rng = np.random.default_rng(11)
    word = lambda k: [f"v{x}" for x in rng.integers(0, 5000, k)]
    passage, docs = word(40), []
    for g in range(60):
        base = word(int(rng.integers(20, 160)))
        if g % 3 == 0:
            base = passage + base
        for c in range(int(rng.integers(1, 6))):
            w = list(base)
            for _ in range(c):
                w[int(rng.integers(0, len(w)))] = f"x{rng.integers(0, 9999)}"
            docs.append(" ".join(w))
    big = word(200)
    for _ in range(90):
        w = list(big)
        for _ in range(3):
            w[int(rng.integers(0, 200))] = f"x{rng.integers(0, 99999)}"
        docs.append(" ".join(w))
    docs += [docs[0]] * 3 + [None, "", "  ", "one two", "one two", "one  two three", "z " * 3000, "z " * 4000]
    return list(enumerate(docs))


def test_join_equals_brute_force(spark, monkeypatch):
    docs = _docs()
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, size int")
    want = _brute(docs)
    for small, block in ((128, 750), (8, 20)):
        monkeypatch.setattr(j.candidate_links, "__defaults__", (small, 5, j.TARGET))
        monkeypatch.setattr(j, "BLOCK_DOCS", block)
        got = {r.doc_id: (r.class_id, r.n_links, r.n_similar_texts) for r in j.jaccard_join(df).collect()}
        assert got == want
    assert j.jaccard_join(df.filter("false")).count() == 0


def test_plan_meets_the_target():
    """Agreements of signatures are drawn, and the runs of the plan walked through them."""
    assert j.plan(80) == (12, 3) and j.plan(80, 0.99999) == (19, 3)
    for percent, target, pairs in ((80, j.TARGET, 400_000), (80, 0.99999, 600_000), (80, 0.99, 100_000), (60, 0.995, 100_000), (50, 0.99, 100_000), (95, 0.9999, 200_000)):
        runs, branches = j.plan(percent, target)
        lost, rng = 0, np.random.default_rng(percent)
        for _ in range(pairs // 100_000):
            agree = rng.random((j.COORDINATES, 100_000), dtype=np.float32) < percent / 100
            met = np.zeros(100_000, bool)
            for first, splits in j.routes(runs, branches):
                survives = agree[first].copy()
                for split in splits:
                    survives &= np.any([agree[b].all(0) for b in split], 0)
                met |= survives
            lost += int((~met).sum())
        most = (1 - target) * pairs
        assert lost <= most + 4 * most**0.5
        for first, splits in j.routes(runs, branches):
            used = [first, *(c for s in splits for b in s for c in b)]
            assert len(set(used)) == len(used) and max(used) < j.COORDINATES
    for percent in (30, 45):
        with pytest.raises(ValueError, match="coordinates"):
            j.plan(percent)
    assert j.plan(100)[1] == 1


def test_recall_where_every_bucket_is_large(spark, monkeypatch):
    """Texts that share a passage of half their length, in similar pairs, with buckets of four."""
    rng = np.random.default_rng(3)
    word = lambda k: [f"v{x}" for x in rng.integers(0, 90_000, k)]
    passage, docs = word(60), []
    for g in range(150):
        base = passage + word(60)
        for c in range(2):
            w = list(base)
            w[70 + 3 * c] = f"x{g}"
            docs.append((2 * g + c, " ".join(w)))
    monkeypatch.setattr(j.candidate_links, "__defaults__", (4, 5, j.TARGET))
    got = {r.doc_id: r.class_id for r in j.jaccard_join(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = {i: w[0] for i, w in _brute(docs).items()}
    assert sum(got[i] == want[i] for i in want) >= j.TARGET * len(want) and len(set(want.values())) == 150


def test_null_ids_repeated_rows_and_several_texts(spark):
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    near = a.replace("a59", "x")
    rows = [(3, a), (3, a), (3, b), (5, near), (None, a), (None, b), (None, b), (None, None), (4, ""), (4, "")]
    got = sorted([tuple(r) for r in j.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()], key=str)
    assert got == sorted([
        (3, 3, 2, 1), (3, 3, 2, 1), (3, 3, 2, 0), (5, 3, 2, 1), (None, 3, 2, 1), (None, 3, 2, 0), (None, 3, 2, 0),
        (None, None, 0, 0), (4, 4, 0, 0), (4, 4, 0, 0),
    ], key=str)


def test_near_copies_that_drift_apart(spark, monkeypatch):
    """A chain of 400 texts, each an edited copy of the one before, in buckets of eight."""
    rng = np.random.default_rng(5)
    w, docs = [f"v{x}" for x in rng.integers(0, 5000, 150)], []
    for k in range(400):
        for _ in range(1 + k % 2):
            w[int(rng.integers(0, 150))] = f"x{k}"
        docs.append((k, " ".join(w)))
    monkeypatch.setattr(j.candidate_links, "__defaults__", (8, 5, j.TARGET))
    monkeypatch.setattr(j, "BLOCK_DOCS", 100)
    got = {r.doc_id: (r.class_id, r.n_links, r.n_similar_texts) for r in j.jaccard_join(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == _brute(docs)
