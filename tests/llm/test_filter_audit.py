"""The audit of filters against plain counting, with copies, collisions and odd rows."""

import re
from itertools import permutations

from pyspark.sql import functions as F

from inkwell.llm import filter_audit as A

SCHEMA = "doc_id long, text string, source string, mask string"


def docs(spark):
    long = " ".join(f"word{k}" for k in range(250))
    rows = [
        (1, long, "a"), (2, long, "b"), (3, long + " X", "a"), (4, "few words", "a"), (5, "few words", None), (6, None, "a"), (7, "", "a"),
        (8, "SHOUT " * 300, "b"), (9, "a & b", "b"), (None, long, "a"), (None, "alone", ""), (10, "twice", "b"), (10, "twice", "b"), (11, "twice", "b"),
        (12, "w\x0b\x0cv u\r", "b"), (13, "😀A" * 30, "b"), (14, " ".join(f"v{k % 99}" for k in range(300)), "b"),
    ]
    rows += [(100 + k, f"{long} {k % 40}", "a") for k in range(160)]
    return spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)


def plain_masks(rows):
    texts = [(r.doc_id, r.source or "", r.text or "") for r in rows]
    first = {}
    for i, _, t in texts:
        if i is not None:
            first[t] = min(i, first.get(t, i))
    for i, part, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and i > first[t])
        yield i, part, sum(f << k for k, f in enumerate(fails))


def by_mask(rows):
    return sorted(rows, key=repr)


def test_masks_with_any_sketch_and_any_hash(spark):
    df = docs(spark)
    want = by_mask(plain_masks(df.collect()))
    for more in ({}, {"max_blocks": 1}, {"hashed": lambda t: F.length(t).cast("long")}):
        assert by_mask(tuple(r) for r in A.failure_masks(df, **more).select("doc_id", "part", "mask").collect()) == want
    assert A.failure_masks(df.filter("false")).count() == 0


def test_the_sketch_clears_most_single_texts_and_no_copy(spark):
    hashes = spark.range(20_000).select(F.xxhash64(F.when(F.col("id") < 2000, F.col("id") % 7).otherwise(F.col("id"))).alias("h"), "id")
    blocks = A.blocks_for(20_000)
    left = A.possible_repeats(hashes, A.sketch(hashes, blocks), blocks)
    assert left.filter("id < 2000").count() == 2000 and left.filter("id >= 2000").count() < 0.05 * 18_000
    assert A.blocks_for(0) == 1 and A.blocks_for(10**12) == A.MAX_BLOCKS


def test_every_step_of_every_order(spark):
    df = docs(spark)
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (2, 0, 1), (8, 0, 1), (999, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): r for r in A.audit(A.mask_counts(A.failure_masks(df), labels)).collect()}
    good, toxic = {1, 2}, {2, 8}
    parts = {}
    for i, part, mask in plain_masks(df.collect()):
        parts.setdefault(part, []).append((i, mask))
    assert len(got) == len(parts) * 600
    removed_by = {}
    for part, rows in parts.items():
        for order in map("".join, permutations("ABCDE")):
            left = rows
            for step, f in enumerate(order, 1):
                bit = 1 << "ABCDE".index(f)
                gone = [(i, m) for i, m in left if m & bit]
                r = got[part, order, step]
                fail = sum(bool(m & bit) for _, m in rows)
                assert (r.removed, r.redundant, r.unique_fails) == (len(gone), fail - len(gone), sum(m == bit for _, m in rows))
                assert (r.good_lost, r.toxic_lost) == (sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone))
                left = [(i, m) for i, m in left if not m & bit]
                assert r.kept == len(left)
                removed_by[part, f] = removed_by.get((part, f), 0) + len(gone)
    assert all(r.shapley == removed_by[part, order[step - 1]] for (part, order, step), r in got.items())
    assert A.audit(A.mask_counts(A.failure_masks(df.filter("false")))).count() == 0
