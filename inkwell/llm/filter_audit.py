"""Operator 11: how filters interact, counted in every order, with a counting-Bloom prepass for duplicates.

Five filters judge whole documents: four (A to D) look at one text, the fifth (E) fails a text that some
document with a smaller id has as well. Only E needs other rows, and few texts occur twice, so texts are first
run through a blocked counting Bloom filter: a text hashes to one block and to ``HASHES`` of its ``SLOTS``
slots. Each task counts its slots, the counts merge by addition, and of the merged sketch one bit a slot is
left: was it hit exactly once. A text with such a slot has no copy anywhere and needs no further look. Only
the others are shuffled with their texts, to the smallest id of every text. The texts themselves decide there;
the hash is used only to bring the answer back to the documents, and where two texts share a hash, those
documents are brought together by text again.

The failures of a document are a mask of five bits. Counts by part and mask (32 at most for a part) are all
that the audit needs: what any filter removes at any place of any order is a sum of them.

Scale: the sketch has ``PER_TEXT`` slots for every row, one byte a row when merged, and ``max_blocks`` blocks of
64 bytes at most, which bounds what is broadcast. Beyond some 130 million rows at the default the same blocks
fill up: fewer texts are cleared, more are shuffled, and the rows stay the same. A text with very many copies
gives a count, and one row of the groups, for each task.

Defined cases: a null text is an empty one, a null source is the part named by the empty string; a document
without id fails E never and makes no other fail it; rows with equal ids are judged one by one and none is a
copy of the other; labels of the same id count if one of them says so; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .expressions import let
from .quality_rules import SPACE
from .workspace import Workspace, table

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT, CAPITALS, SIGNS = 200, 50, 2, r"[#$%&*|]"
SLOTS, HASHES, PER_TEXT, MAX_BLOCKS = 512, 4, 8, 1 << 21
_COPY = 1 << FILTERS.index("E")


def text_failures(text: Column) -> Column:
    """Mask of the filters A to D that a text fails: few words, repeated words, capitals, signs."""

    def judged(words: Column) -> Column:
        n, capitals = F.size(words), F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
        fails = (
            n < MIN_WORDS, F.size(F.array_distinct(words)) * 100 < n * DISTINCT,
            capitals * 100 > F.length(text) * CAPITALS, text.rlike(SIGNS),
        )
        return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))

    return let(F.filter(F.split(text, SPACE), lambda w: w != ""), judged)


def _slots(h: Column) -> Column:
    bits = (SLOTS - 1).bit_length()
    return let(F.xxhash64(h), lambda x: F.array_distinct(F.array(*[F.shiftrightunsigned(x, bits * k).bitwiseAND(SLOTS - 1) for k in range(HASHES)])))


def blocks_for(rows: int, max_blocks: int = MAX_BLOCKS) -> int:
    """Blocks of a sketch, a power of two."""
    return min(max_blocks, 1 << max(0, (rows * PER_TEXT // SLOTS).bit_length()))


def sketch(hashes: DataFrame, blocks: int) -> DataFrame:
    """block, once: for every slot of a block that some text hits, whether it is hit exactly once, as bits of longs."""
    hit = hashes.select(F.col("h").bitwiseAND(blocks - 1).alias("block"), F.explode(_slots(F.col("h"))).alias("slot"))
    once = hit.groupBy("block", "slot").agg(F.count("*").alias("n")).filter("n = 1")
    bit = F.expr("shiftleft(1L, int(slot & 63))")
    words = [F.bit_or(F.when(F.shiftright("slot", 6) == k, bit).otherwise(0)) for k in range(SLOTS // 64)]
    return once.groupBy("block").agg(F.array(*words).alias("once"))


def possible_repeats(rows: DataFrame, merged: DataFrame, blocks: int) -> DataFrame:
    """Rows (column h) whose text the merged sketch does not clear."""
    keyed = rows.withColumn("block", F.col("h").bitwiseAND(blocks - 1))
    clear = F.exists(_slots(F.col("h")), lambda s: F.getbit(F.get("once", F.shiftright(s, 6).cast("int")), s.bitwiseAND(63).cast("int")) == 1)
    return keyed.join(F.broadcast(merged), "block", "left").filter(~F.coalesce(clear, F.lit(False))).drop("block", "once")


def failure_masks(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source", max_blocks: int = MAX_BLOCKS, hashed=F.xxhash64,
) -> DataFrame:
    """doc_id, part, mask of every row; ``hashed`` gives a long for a text."""
    space = Workspace(docs.sparkSession, "filter-audit")
    said = F.coalesce(F.col(text), F.lit(""))
    named = F.coalesce(F.col(part).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), named.alias("part"), said.alias("text")).withColumn("h", hashed(F.col("text")))
    base = space.save(rows.select("doc_id", "part", "h", text_failures(F.col("text")).alias("mask")), "base")
    blocks = blocks_for(base.count(), max_blocks)
    merged = space.save(sketch(base, blocks), "sketch")
    groups = possible_repeats(rows, merged, blocks).groupBy("h", "text").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    known = space.save(
        groups.groupBy("h").agg(F.min("first").alias("first"), F.max("copies").alias("copies"), F.count("*").alias("texts"))
        .filter("copies > 1 OR texts > 1"), "groups",
    )
    copy = F.when(F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)), _COPY).otherwise(0)
    mask = (F.col("mask") + copy).alias("mask")
    out = base.join(known, "h", "left").filter("coalesce(texts, 1) = 1").select("doc_id", "part", mask)
    shared = known.filter("texts > 1").select("h")
    if shared.take(1):
        both = rows.join(shared, "h", "left_semi").withColumn("mask", text_failures(F.col("text")))
        least = both.groupBy("h", "text").agg(F.min("doc_id").alias("first"))
        out = out.unionByName(both.join(least, ["h", "text"]).select("doc_id", "part", mask))
    return out


def mask_counts(masks: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """part, mask, n, good, toxic: documents by part and mask, and those among them labelled good or toxic."""
    if labels is None:
        masks = masks.withColumns({"good": F.lit(0), "toxic": F.lit(0)})
    else:
        said = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
            F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
        )
        masks = masks.join(said, "doc_id", "left")
    of = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return masks.groupBy("part", "mask").agg(F.count("*").alias("n"), of("good"), of("toxic"))


def _steps() -> Column:
    """Every step of every order: its filter's bit and the bits of the filters before it."""
    bit = {f: 1 << k for k, f in enumerate(FILTERS)}
    steps = [
        {"filter_order": "".join(o), "step": k + 1, "bit": bit[f], "before": sum(bit[x] for x in o[:k])}
        for o in permutations(FILTERS) for k, f in enumerate(o)
    ]
    return F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,bit:int,before:int>>")


def audit(counts: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts of what the step does, from the counts by mask."""
    each = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("m"))  # 32 at most
    rows = each.select("part", "m", F.explode(_steps()).alias("s")).select("part", "m", "s.*")
    bit, before = F.col("bit"), F.col("before")

    def total(which, value=lambda x: x["n"]) -> Column:
        return F.aggregate("m", F.lit(0).cast("long"), lambda acc, x: acc + F.when(which(x["mask"]), value(x)).otherwise(0))

    fails = lambda mask: mask.bitwiseAND(bit) != 0
    here = lambda mask: fails(mask) & (mask.bitwiseAND(before) == 0)
    orders = len(list(permutations(FILTERS)))
    # In the share orders / (failed filters) of all orders a filter comes first of those that a document fails.
    first = lambda x: x["n"] * (F.lit(orders) / F.bit_count(x["mask"])).cast("long")
    return rows.select(
        "part", "filter_order", "step",
        total(lambda mask: mask.bitwiseAND(bit.bitwiseOR(before)) == 0).alias("kept"),
        total(here).alias("removed"),
        total(lambda mask: fails(mask) & (mask.bitwiseAND(before) != 0)).alias("redundant"),
        total(lambda mask: mask == bit).alias("unique_fails"),
        total(here, lambda x: x["good"]).alias("good_lost"),
        total(here, lambda x: x["toxic"]).alias("toxic_lost"),
        total(fails, first).alias("shapley"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(mask_counts(failure_masks(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels")))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
m AS (SELECT doc_id, part, (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
        + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t))::INT
        + 8 * regexp_matches(t, '[#$%&*|]')::INT
        + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask FROM w),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT [a.f, b.f, c.f, d.f, e.f] AS o FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT array_to_string(o, '') AS filter_order, i::INT AS step, o[i] AS f, (1 << (ascii(o[i]) - 65))::INT AS bit,
        coalesce(list_sum(list_transform(o[:i - 1], lambda x: 1 << (ascii(x) - 65))), 0)::INT AS before FROM o, range(1, 6) AS r(i)),
x AS (SELECT part, filter_order, step, f,
        coalesce(sum(n) FILTER (mask & (bit | before) = 0), 0)::BIGINT AS kept,
        coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before <> 0), 0)::BIGINT AS redundant,
        coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
        coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
        coalesce(sum(toxic) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost
    FROM c, s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM x
"""
