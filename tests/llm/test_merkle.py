"""The manifest against a plain tree, with proofs that verify and tampering that does not."""

from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from inkwell.llm import merkle as M

H = lambda s: sha256(s.encode()).hexdigest()


def plain_tree(nodes):
    """Root, and the siblings of every node with their side."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            near = nodes[i ^ 1] if i ^ 1 < len(nodes) else ""
            paths[k].append((near, "") if i & 1 else ("", near))
        nodes, at = [H("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)], [i // 2 for i in at]
    return nodes[0], paths


def check(spark, rows, **more):
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, lang string, leaf string, tree string")
    got = M.proofs(M.manifest(df, "lang", "doc_id", "leaf", **more)).collect()
    by = {}
    for i, lang, leaf in rows:
        by.setdefault(lang, []).append((i is not None, i or 0, leaf))
    keys = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {k: plain_tree([leaf for *_, leaf in sorted(by[k])]) for k in keys}
    root, uppers = plain_tree([trees[k][0] for k in keys])
    want = [
        (k, i if known else None, leaf, path + uppers[n], trees[k][0], root)
        for n, k in enumerate(keys) for (known, i, leaf), path in zip(sorted(by[k]), trees[k][1], strict=True)
    ]
    assert sorted(map(repr, ((r.key, r.order, r.leaf, [tuple(x) for x in r.path], r.subroot, r.root) for r in got))) == sorted(map(repr, want))


@pytest.mark.parametrize("n", [1, 2, 3, 255, 256, 257, 1500])
def test_trees_of_all_sizes(spark, n):
    check(spark, [(k * 7 % 9001, "en", H(str(k))) for k in range(n)] + [(k, "fr", H(f"f{k}")) for k in range(n // 3)])


def test_more_than_two_stored_levels_and_many_groups(spark):
    check(spark, [(k, "en", H(str(k))) for k in range(131)] + [(k, f"l{k % 37}", H(f"f{k}")) for k in range(90)], step=2)


def test_odd_rows(spark):
    rows = [(1, None, H("a")), (1, None, H("b")), (1, None, H("b")), (None, None, H("c")), (None, "", H("d")), (5, "é", H("e")), (5, "z", H("f")), (2, "", H("g"))]
    check(spark, rows)
    df = spark.createDataFrame([], "doc_id long, lang string, leaf string")
    assert M.proofs(M.manifest(df, "lang", "doc_id", "leaf")).count() == 0


def test_row_hash(spark):
    row = spark.createDataFrame([(12, None, "é", 7, "x" * 100_000)], "doc_id long, source string, lang string, n_chars long, text string")
    assert row.select(M.row_hash(*map(F.col, M.FIELDS)).alias("h")).first().h == H("2:12-2:é1:7100000:" + "x" * 100_000)


def test_tampering_shows(spark):
    df = spark.range(600).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("leaf"))
    df = df.withColumn("other", F.when(F.col("doc_id") % 5 == 0, F.sha2(F.lit(b"x"), 256)))
    every = M.proofs(M.manifest(df, "lang", "doc_id", "leaf", ("other",)))
    right = M.folded(F.coalesce("other", "leaf"), F.col("path")) == F.col("root")
    assert every.filter(right).count() == 480 and every.filter(right & (F.col("order") % 5 == 0)).count() == 0
