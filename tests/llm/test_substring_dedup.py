"""Substring deduplication against brute force over all byte strings."""

import hashlib

import numpy as np
import pytest

from inkwell.llm import substring_dedup as S
from inkwell.llm.substring_dedup import RunIndex, _ranked, earlier_windows, op8_substring_dedup, substring_dedup


def _brute(docs, length=50):
    first, out = {}, {}
    for i, t in sorted((d for d in docs if d[0] is not None), key=lambda d: d[0]):
        raw = (t or "").encode()
        for p in range(len(raw) - length + 1):
            first.setdefault(raw[p : p + length], i)
    for i, t in docs:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - length + 1):
            if i is not None and first[raw[p : p + length]] < i:
                gone[p : p + length] = True
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        out[i] = (len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def _docs():
    rng = np.random.default_rng(9)
    word = lambda k: " ".join(rng.choice(["alpha", "béta", "gamma", "dé", "ε", "zeta\n", "eta"], k))
    passages, docs = [word(n) for n in (9, 14, 40, 80)], []
    for k in range(160):
        parts = [word(int(rng.integers(0, 30)))]
        for _ in range(int(rng.integers(0, 3))):
            p = passages[int(rng.integers(0, 4))]
            lo = int(rng.integers(0, 20))
            parts += [p[lo:], word(int(rng.integers(0, 12)))]
        docs.append(" ".join(parts))
    docs += [docs[3]] * 4 + [docs[5][:-1] + "!", None, "", "short", "a" * 400, "a" * 300, "ab" * 200, "ba" * 100, "\0" * 90, "x\0" * 60]
    order = rng.permutation(len(docs)).tolist()
    return [(int(i) * 3 - 40, docs[k]) for k, i in enumerate(order)]


def test_equals_brute_force(spark, tmp_path):
    docs = _docs()
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, spans int").repartition(3)
    want = _brute(docs)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op8_substring_dedup(spark, str(tmp_path)).collect()}
    assert got == want
    assert sum(w[1] for w in want.values()) > 1000
    assert substring_dedup(df.filter("false")).count() == 0


def test_null_ids_and_repeated_rows(spark):
    text = "the same sentence in every document, long enough to count " * 2
    rows = [(None, text), (4, text), (4, text), (9, text)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, bytes(r.kept).decode()) for r in substring_dedup(df).collect()]
    assert sorted(got, key=str) == sorted([(None, text), (4, text), (4, text), (9, "")], key=str)


@pytest.mark.parametrize("length, alphabet", [(32, b"a"), (50, b"ab"), (50, b"\0\xff\1"), (56, bytes(range(256)))])
def test_run_index_of_small_and_large_alphabets(length, alphabet):
    rng = np.random.default_rng(5)
    whole = bytes(rng.choice(list(alphabet), 300).tolist())
    starts, sizes = rng.integers(0, 200, 120), rng.integers(length, 2 * length - 15, 120)
    stretches = [whole[a : a + n] for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
    docs = rng.integers(0, 40, 120)
    first = {}
    for s, d in zip(stretches, docs.tolist(), strict=True):
        for p in range(len(s) - length + 1):
            first[s[p : p + length]] = min(d, first.get(s[p : p + length], d))
    expected = {
        (k, p) for k, s in enumerate(stretches) for p in range(len(s) - length + 1) if first[s[p : p + length]] < docs[k]
    }
    marks = RunIndex(stretches, docs, length).marks(stretches, docs)
    assert {(int(a), int(b)) for k, start in marks for a, b in zip(k, start, strict=True)} == expected


@pytest.mark.parametrize("alphabet", [b"a", b"ab", b"abcdefghijklmnop"])
def test_matching_statistics_of_texts_that_are_not_indexed(alphabet):
    rng = np.random.default_rng(8)
    whole = bytes(rng.choice(list(alphabet), 400).tolist())
    stretches = [whole[a : a + 70] for a in range(0, 300, 25)]
    docs = rng.integers(0, 9, len(stretches))
    patterns = [whole[20:90] + b"?" + whole[100:170], bytes(rng.choice(list(alphabet), 90).tolist()), whole[:30] + whole[200:290], b"zz"]
    index, seen = RunIndex(stretches, docs, 50), 0
    for number, start, match, row in index.statistics(patterns):
        for k, p, n, r, doc in zip(number.tolist(), start.tolist(), match.tolist(), row.tolist(), index.before(row).tolist(), strict=True):
            x = patterns[k][p : p + 50]
            assert n == max(m for m in range(len(x) + 1) if any(x[:m] in s for s in stretches))
            if n == 50:
                assert doc == min(d for s, d in zip(stretches, docs.tolist(), strict=True) if x in s)
            seen += 1
    assert seen == sum(map(len, patterns))


def test_the_index_follows_the_runs_of_a_repetitive_text():
    """Texts that differ from one text in a byte each, against as many that have nothing in common."""
    rng = np.random.default_rng(4)
    base = rng.integers(97, 123, 80)
    edited = []
    for place in range(80):
        for letter in range(65, 90):
            edited.append(bytes(np.where(np.arange(80) == place, letter, base).tolist()))
    alien = [bytes(rng.integers(97, 123, 80).tolist()) for _ in edited]
    parts = ("starts", "stops", "heads", "leads", "first", "last", "by_symbol", "earliest", "earliest_starts")
    few, many = (RunIndex(x, np.arange(len(x)), 50) for x in (edited, alien))
    assert len(few.text) == len(many.text) and 15 * len(few.starts) < len(many.starts)
    assert 10 * sum(getattr(few, k).nbytes for k in parts) < sum(getattr(many, k).nbytes for k in parts)


def test_different_texts_under_one_id(spark):
    a, b = "what the first text of the document says, in some sixty bytes. " * 2, "something else that nobody but this one text holds, also long " * 2
    rows = [(1, a), (5, a), (5, b), (5, b), (7, b)]
    got = [(r.doc_id, bytes(r.kept).decode()) for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == sorted([(1, a), (5, ""), (5, b), (5, b), (7, "")])


@pytest.mark.parametrize("bits", [20, 60])
def test_ranks_are_alike_for_equal_keys_and_ordered_by_place(bits):
    key = np.array([5, 3, 5, 0, (1 << bits) - 1, 3], np.uint64)
    order, rank = _ranked(key, bits)
    assert order.tolist() == [3, 1, 5, 0, 2, 4]
    assert rank.tolist() == [3, 2, 3, 1, 4, 2]
    # more places than fit beside 60 bits
    many = np.arange(100, dtype=np.uint64)[::-1] // np.uint64(2)
    order, rank = _ranked(many, bits)
    assert order[:4].tolist() == [98, 99, 96, 97] and rank[0] == 50


def _around_one_passage(n):
    """Documents that share the middle of their texts alone."""
    rng = np.random.default_rng(12)
    own = lambda k: bytes(rng.integers(97, 123, k).tolist()).decode()
    passage = own(120)
    return [(k, own(60) + passage[: 120 - k % 3] + own(60)) for k in range(n)]


def test_hot_seeds_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT", 4)
    monkeypatch.setattr(S, "SAMPLE", 1)
    docs = _docs() + [(10_000 + k, t) for k, t in _around_one_passage(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert len(S.hot_seeds(df.filter("doc_id IS NOT NULL"), 50)) > 2
    got = {r.doc_id: (r.n_removed, r.kept_sha256) for r in substring_dedup(df).selectExpr("doc_id", "octet_length(coalesce(text, '')) - octet_length(kept) AS n_removed", "sha2(kept, 256) AS kept_sha256").collect()}
    assert got == {i: (w[1], w[3]) for i, w in _brute(docs).items()}


def test_a_seed_of_very_many_documents_does_not_meet_in_one_deal(spark):
    df = spark.createDataFrame(_around_one_passage(12_000), "doc_id long, text string").selectExpr("*", "xxhash64(text) AS version").repartition(8)
    total = 12_000 * 240
    by_deal = {}
    for r in S.dealt_stretches(df, 50, total).collect():
        parts = S._unpack(bytes(r.blob))
        by_deal[r.deal] = by_deal.get(r.deal, 0) + (len(parts[0]) if len(parts) > 4 else 0)
    assert max(by_deal.values()) < 0.05 * sum(by_deal.values())


def test_windows_of_one_fingerprint_are_told_apart():
    windows = np.frombuffer(b"aabbaabbab", np.uint8).reshape(5, 2)
    docs = np.array([3, 1, 5, 2, 4])
    assert earlier_windows(np.zeros(5, np.uint64), docs, windows).tolist() == [False, False, True, True, False]


def test_what_is_sent_does_not_grow_with_the_number_of_indexes(spark):
    """A task that sends a little of a table of 10 GB, where every index has 2 MB of it."""
    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(97, 123, 1200).tolist()).decode() for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts + [x + "!" for x in texts])), "doc_id long, text string").selectExpr("*", "xxhash64(text) AS version")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = S.dealt_stretches(df.repartition(tasks, "doc_id"), 50, 10_000_000_000)
    assert sent.count() <= tasks * 320
    assert sent.select("deal").distinct().count() > 200


def test_deals_of_several_parts_equal_brute_force(spark, monkeypatch):
    for name, value in (("DEALS", 2), ("BUCKET", 12_000), ("PART", 700), ("INDEX", 9_000)):
        monkeypatch.setattr(S, name, value)
    docs = _docs()
    got = {r.doc_id: (r.n_removed, r.kept_sha256) for r in substring_dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).selectExpr("doc_id", "octet_length(coalesce(text, '')) - octet_length(kept) AS n_removed", "sha2(kept, 256) AS kept_sha256").collect()}
    assert got == {i: (w[1], w[3]) for i, w in _brute(docs).items()}


@pytest.mark.parametrize("block", [1, 200, 10**6])
def test_stretches_are_all_windows_once_and_follow_their_bytes(monkeypatch, block):
    monkeypatch.setattr(S, "BLOCK", block)
    texts = [(t or "").encode() for _, t in _docs()] + [b"a" * 49, b"a" * 50, b""]
    buf, sizes = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts])
    begin = np.cumsum(sizes) - sizes
    print_, of, first, last = S.seeds(buf, sizes, 50)
    windows, seed = [], {}
    for p, k, a, b in zip(print_.tolist(), of.tolist(), first.tolist(), last.tolist(), strict=True):
        assert 0 <= b - a < 35
        for at in range(a, b + 1):
            windows.append((k, at - int(begin[k])))
            assert seed.setdefault(texts[k][at - begin[k] : at - begin[k] + 50], p) == p
    assert windows == [(k, p) for k, n in enumerate(sizes.tolist()) for p in range(n - 49)]


def test_parts_hold_every_window_that_two_documents_share():
    stretches = sorted({(t or "").encode()[p : p + 70] for _, t in _docs() for p in range(0, len(t or "") - 70, 9)})
    rng = np.random.default_rng(2)
    docs = np.sort(rng.integers(0, 60, len(stretches)))
    sizes = np.array([len(s) for s in stretches])
    first = np.cumsum(sizes) - sizes
    indexed, streamed = S.common_parts(np.frombuffer(b"".join(stretches), np.uint8), first, sizes, docs, 50)
    places = {}
    for k, s in enumerate(stretches):
        for p in range(len(s) - 49):
            places.setdefault(s[p : p + 50], []).append((k, p))
    assert len(streamed[0]) < len(stretches)
    for (number, begin, end), need in ((indexed, max), (streamed, min)):
        cut = {k: (a - first[k], b - first[k]) for k, a, b in zip(number.tolist(), begin.tolist(), end.tolist(), strict=True)}
        for every in places.values():
            other = need(docs[k] for k, _ in every)
            assert all(cut[k][0] <= p and p + 50 <= cut[k][1] for k, p in every if docs[k] != other)


def test_seeds_that_are_wanted_and_parts_that_go_together():
    rng = np.random.default_rng(1)
    prefix, wanted = rng.integers(0, 1 << 40, 5000).astype(np.uint64), rng.integers(0, 1 << 40, 900).astype(np.uint64)
    wanted = np.unique(np.append(wanted, prefix[::7]))
    assert S.wanted_seeds(prefix, wanted).tolist() == np.flatnonzero(np.isin(prefix, wanted)).tolist()
    assert len(S.wanted_seeds(prefix, wanted[:0])) == 0
    assert S._together(np.array([0, 4, 6, 6, 30, 31, 33]), 10) == [(0, 3), (3, 4), (4, 6)]


@pytest.mark.parametrize("width", [5, 7])
def test_repeated_seeds_of_many_chunks(spark, width):
    texts = [(i, t) for i, t in _docs() if t]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(6)
    got = {(r.doc_id, r.prefix) for r in S.repeated_seeds(df, 50, 11, width).collect()}
    by = {}
    for i, t in texts:
        raw = np.frombuffer(t.encode(), np.uint8)
        for p in S.seeds(raw, np.array([len(raw)]), 50)[0].tolist():
            by.setdefault(p >> (64 - 8 * width), set()).add(i)
    assert got == {(i, p) for p, ids in by.items() if len(ids) > 1 for i in ids}


def test_rows_of_one_fingerprint_meet_their_equals_alone():
    rows = np.frombuffer(b"aabbaabbabaa", np.uint8).reshape(6, 2)
    docs = np.array([3, 1, 5, 2, 4, 3])
    own = S.first_equal(np.zeros(6, np.uint64), docs, rows)
    assert docs[own].tolist() == [3, 1, 3, 1, 4, 3] and own[0] == own[5] and (rows[own] == rows).all()
