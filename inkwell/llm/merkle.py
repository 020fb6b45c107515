"""Operator 13: a Merkle manifest of a dataset, with proofs from checkpoints and recomputed interior nodes.

Rows are hashed to leaves. The leaves of a group (a language) stand in the order of their ids; every two
consecutive nodes become one (a last one alone becomes one as well) until one is left, the group's root. The
roots of the groups, in the order of their keys, form a tree in the same way, whose root stands for everything.

Of each tree only every ``STEP``-th level is stored, beginning with the leaves. A level is made from the stored
one below in one pass: an aligned subtree has at most 2^STEP stored nodes, which are dealt to one task by its
number, and gives one node. A proof is extracted from the top down: the task that gets a subtree's stored
nodes and the path of its top regenerates the levels between, emits for every stored node its siblings and the
path above, and forgets what it regenerated. So 10^10 rows take five passes, each over a 256th of the one
before, and no task holds more than one subtree.

Positions are given by sorted ranges: rows are ranged by group and id, numbered within their range, and moved up by
the rows of earlier ranges of the group; only counts, at most one for each range and group, meet in one task.
A language with most of the rows is spread over many ranges.

Defined cases: null fields are ``-``; a null language is a group of its own, before the others; leaves of equal ids
stand in the order of their hashes, those with null ids first; a single leaf is its group's root, and a single
group's root is the root; an empty table gives an empty manifest; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .grouping import sorted_groups
from .workspace import Workspace, table

STEP = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<left:string,right:string>>"


def row_hash(*columns: Column) -> Column:
    """Hash of a row: of each value ``-`` if it is null, else its UTF-8 bytes' number, a colon and the value."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*[part(c.cast("string")) for c in columns]).cast("binary"), 256)


def _equal(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    same = F.lit(True)
    for n in names:
        same = same & a[n].eqNullSafe(b[f"b_{n}"])
    return same


def positions(rows: DataFrame, group: list[str], order: list[str], space: Workspace, name: str, tie: str | None = None) -> DataFrame:
    """Adds pos, the place of each row in its group from 0, and size, the rows of its group.

    Rows are read twice, once for a sample of their order, so they should be a saved table. Of a text that decides
    between equal rows, ``tie``, the first characters are enough to tell ranges apart; the sample goes to the driver.
    """
    last = [tie] if tie else []
    cuts = [F.substring(c, 1, 8) for c in last]
    ranged = rows.repartitionByRange(*group, *order, *cuts).sortWithinPartitions(*group, *order, *last)
    low = (1 << 33) - 1  # the bits that number the rows of a partition
    marked = space.save(ranged.withColumns({"_at": F.spark_partition_id(), "_k": F.monotonically_increasing_id().bitwiseAND(low)}), name)
    runs = marked.groupBy("_at", *group).agg(F.min("_k").alias("_low"), F.count("*").alias("_n"))
    whole = Window.partitionBy(*group)
    before = whole.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        *[F.col(c).alias(f"b_{c}") for c in ("_at", *group)],
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_low")).alias("_shift"), F.sum("_n").over(whole).alias("size"),
    )
    found = marked.join(runs, _equal(marked, runs, ["_at", *group]))
    return found.select(*rows.columns, (F.col("_k") + F.col("_shift")).alias("pos"), "size")


def levels(nodes: list[str], height: int) -> list[list[str]]:
    """The nodes and the levels above them; two consecutive nodes, or a last one alone, are one node above."""
    out = [nodes]
    for _ in range(height):
        below = out[-1]
        out.append([sha256("".join(below[i : i + 2]).encode()).hexdigest() for i in range(0, len(below), 2)])
    return out


def _height(size: int, step: int) -> int:
    """Levels that a subtree of a tree with so many stored nodes on its level has above them."""
    return min(step, (size - 1).bit_length())


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows (tree, block, pos) dealt by aligned subtree, in order."""
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def _tops(step: int):
    """The work of a task that makes one node of each subtree."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for t, bounds in sorted_groups(batches, ["tree", "block"]):
            nodes, sizes = t["node"].to_pylist(), t["size"].to_numpy()
            top = [levels(nodes[a:b], _height(int(sizes[a]), step))[-1][0] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            first, size = pa.array(bounds[:-1]), -(-sizes[bounds[:-1]] // (1 << step))
            columns = [t["tree"].take(first).combine_chunks(), t["block"].take(first).combine_chunks(), pa.array(size, pa.int64()), pa.array(top, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["tree", "pos", "size", "node"])

    return run


def tiers(nodes: DataFrame, most: int, space: Workspace, name: str, step: int = STEP) -> list[DataFrame]:
    """The stored levels of trees (tree, pos, size, node), from the given one to that of the roots; ``most``: the largest size."""
    out = [nodes]
    while most > 1:
        keyed = out[-1].select("tree", F.shiftright("pos", step).alias("block"), "pos", "size", "node")
        made = _dealt(keyed).mapInArrow(_tops(step), "tree long, pos long, size long, node string")
        out.append(space.save(made, f"{name}-{len(out)}"))
        most = -(-most // (1 << step))
    return out


def _paths(extra: list[str], step: int):
    """The work of a task on subtrees: the first row of each holds the path above, the others get their own path."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        struct = pa.struct([("left", pa.string()), ("right", pa.string())])
        for t, bounds in sorted_groups(batches, ["tree", "block"]):
            nodes, sizes, above = t["node"].to_pylist(), t["size"].to_numpy(), t["path"]
            ends, left, right, keep = [0], [], [], []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                upper = above[int(a)].as_py()  # sorted first: its position is -1
                every = levels(nodes[a + 1 : b], height := _height(int(sizes[b - 1]), step))
                for k in range(b - a - 1):
                    for h in range(height):
                        at = k >> h
                        near = every[h][at ^ 1] if at ^ 1 < len(every[h]) else ""
                        left.append(near if at & 1 else "")
                        right.append("" if at & 1 else near)
                    for x in upper:
                        left.append(x["left"])
                        right.append(x["right"])
                    ends.append(len(left))
                keep.extend(range(a + 1, b))
            path = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], fields=list(struct)))
            t = t.take(pa.array(keep, pa.int64()))
            columns = [t[c].combine_chunks() for c in ("tree", "pos", "node", *extra)]
            yield pa.RecordBatch.from_arrays([*columns, path], ["tree", "pos", "node", *extra, "path"])

    return run


def _extract(stored: list[DataFrame], tops: DataFrame, extra: list[str], made: Manifest, name: str) -> DataFrame:
    """tree, pos, node, extra, path of every node of the lowest stored level; ``tops`` has tree and the path above each root."""
    above = tops.select("tree", F.lit(0).cast("long").alias("pos"), "path")
    for k in range(len(stored) - 1, -1, -1):
        more = extra if k == 0 else []
        kinds = {c: kind for c, kind in stored[k].dtypes if c in more}
        empty = {c: F.lit(None).cast(kind) for c, kind in kinds.items()}
        mine = stored[k].select("tree", F.shiftright("pos", made.step).alias("block"), "pos", "size", "node", *more, F.lit(None).cast(_PATH).alias("path"))
        upper = above.select("tree", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), F.lit(0).cast("long").alias("size"), F.lit(None).cast("string").alias("node"), *[v.alias(c) for c, v in empty.items()], "path")
        schema = ", ".join(["tree long, pos long, node string", *[f"`{c}` {kind}" for c, kind in kinds.items()], f"path {_PATH}"])
        above = _dealt(mine.unionByName(upper)).mapInArrow(_paths(more, made.step), schema)
        if k:
            above = made.space.save(above, f"{name}-paths-{k}")
    return above


@dataclass
class Manifest:
    """Stored levels of the groups' trees and of the tree over their roots; ``groups``: tree, key and root of each group."""

    space: Workspace
    leaves: list[DataFrame]
    upper: list[DataFrame]
    groups: DataFrame
    carried: list[str]
    step: int


def manifest(rows: DataFrame, key: str, order: str, leaf: str, carry: tuple[str, ...] = (), step: int = STEP) -> Manifest:
    """The trees over rows with a hash ``leaf``, grouped by ``key`` and ordered by ``order``; the columns ``carry`` stay with the leaves."""
    space = Workspace(rows.sparkSession, "merkle")
    named = rows.select(F.col(key).alias("_key"), F.col(order).alias("_order"), F.col(leaf).alias("node"), *carry)
    named = space.save(named, "hashed")  # the rows themselves are read here, and never again
    placed = positions(named, ["_key"], ["_order"], space, "ranged", tie="node")
    sizes = space.save(placed.filter("pos = 0").select("_key", "size"), "sizes")
    keys = positions(sizes.select("_key", F.col("size").alias("n")), [], ["_key"], space, "keys").select(F.col("_key").alias("b__key"), F.col("pos").alias("tree"))
    keys = space.save(keys, "trees")
    leaves = space.save(placed.join(keys, _equal(placed, keys, ["_key"])).select("tree", "pos", "size", "node", F.col("_order").alias("order"), *carry), "leaves")
    most = sizes.agg(F.max("size"), F.count("*")).first()
    lower = tiers(leaves, most[0] or 0, space, "level", step)
    roots = lower[-1].join(keys, "tree").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(most[1]).cast("long").alias("size"), "node", F.col("b__key").alias("key"))
    upper = tiers(space.save(roots, "roots"), most[1], space, "upper", step)
    groups = upper[0].select(F.col("pos").alias("tree"), "key", F.col("node").alias("subroot"))
    return Manifest(space, lower, upper, groups, list(carry), step)


def proofs(made: Manifest) -> DataFrame:
    """key, order, carried columns, leaf, path, subroot, root of every row.

    ``path`` has a level's siblings from the leaf to the root: what stands left and right of the own node in its run.
    """
    spark = made.leaves[0].sparkSession
    top = spark.createDataFrame([(0, [])], f"tree long, path {_PATH}")
    root = made.upper[-1].select(F.col("node").alias("root"), "tree")
    tops = _extract(made.upper, top, ["key"], made, "upper")
    groups = made.space.save(tops.join(root, "tree").select(F.col("pos").alias("tree"), "key", F.col("node").alias("subroot"), "root", "path"), "groups")
    every = _extract(made.leaves, groups.select("tree", "path"), ["order", *made.carried], made, "level")
    return every.join(groups.drop("path"), "tree").select("key", "order", *made.carried, F.col("node").alias("leaf"), "path", "subroot", "root")


def siblings(path: Column) -> Column:
    """The siblings of a path, level by level, left to right, as one text."""
    return F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a path lead to."""
    return F.aggregate(path, leaf, lambda node, x: F.sha2(F.concat(x["left"], node, x["right"]).cast("binary"), 256))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    more = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, row_hash(*more))
    rows = docs.select("doc_id", "lang", row_hash(*map(F.col, FIELDS)).alias("leaf"), tampered.alias("tampered"))
    every = proofs(manifest(rows, "lang", "doc_id", "leaf", ("tampered",)))
    done = every.select(
        F.col("order").alias("doc_id"), "leaf", "subroot", "root", F.sha2(siblings(F.col("path")).cast("binary"), 256).alias("proof_sha256"),
        folded(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"),
    )
    return done.withColumn("verified", F.col("folded_root") == F.col("root"))


def _part(value: str) -> str:
    return f"coalesce(strlen({value}) || ':' || {value}, '-')"


OP13_SQL = f"""
WITH RECURSIVE d AS (SELECT *, list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
        lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END)) AS crc FROM documents),
h AS (SELECT doc_id, lang, prefix || {_part("n_chars::VARCHAR")} || suffix AS a,
        prefix || {_part("(n_chars + (coalesce(xor(crc, 4294967295::BIGINT) % 7 = 0, false))::INT)::VARCHAR")} || suffix AS b
    FROM (SELECT doc_id, lang, n_chars, crc, {_part("doc_id::VARCHAR")} || {_part("source")} || {_part("lang")} AS prefix, {_part("text")} AS suffix FROM d)),
l AS (SELECT doc_id, lang, sha256(a) AS leaf, sha256(b) AS tampered, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS size FROM h),
t(lang, lvl, pos, size, node) AS (SELECT lang, 0, pos, size, leaf FROM l UNION ALL
    SELECT lang, lvl + 1, pos // 2, any_value((size + 1) // 2), sha256(string_agg(node, '' ORDER BY pos)) FROM t WHERE size > 1 GROUP BY lang, lvl, pos // 2),
r AS (SELECT lang, node, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS size FROM t WHERE size = 1),
u(lvl, pos, size, node) AS (SELECT 0, pos, size, node FROM r UNION ALL
    SELECT lvl + 1, pos // 2, any_value((size + 1) // 2), sha256(string_agg(node, '' ORDER BY pos)) FROM u WHERE size > 1 GROUP BY lvl, pos // 2),
f(doc_id, lang, leaf, subroot, upper, below, lvl, pos, own, size, proof) AS (
    SELECT doc_id, l.lang, leaf, r.node, false, r.pos, 0, l.pos, tampered, l.size, '' FROM l JOIN r ON l.lang IS NOT DISTINCT FROM r.lang
    UNION ALL SELECT doc_id, f.lang, leaf, subroot, f.upper OR f.size = 1, below, CASE WHEN f.size = 1 THEN 0 ELSE f.lvl + 1 END, CASE WHEN f.size = 1 THEN below ELSE f.pos // 2 END,
        CASE WHEN f.size = 1 THEN own WHEN f.pos % 2 = 1 THEN sha256(coalesce(t.node, u.node) || own) ELSE sha256(own || coalesce(t.node, u.node, '')) END,
        CASE WHEN f.size = 1 THEN (SELECT count(*) FROM r) ELSE (f.size + 1) // 2 END,
        CASE WHEN f.size = 1 THEN proof ELSE proof || coalesce(t.node, u.node, '') END
    FROM f LEFT JOIN t ON NOT f.upper AND f.size > 1 AND t.lang IS NOT DISTINCT FROM f.lang AND t.lvl = f.lvl AND t.pos = xor(f.pos, 1)
    LEFT JOIN u ON f.upper AND f.size > 1 AND u.lvl = f.lvl AND u.pos = xor(f.pos, 1) WHERE f.size > 1 OR NOT f.upper)
SELECT doc_id, leaf, subroot, u.node AS root, sha256(proof) AS proof_sha256, own AS folded_root, own = u.node AS verified
FROM f, (SELECT node FROM u WHERE size = 1) u WHERE f.upper AND f.size = 1
"""
