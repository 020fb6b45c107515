"""Operator 10: n-gram Jaccard join by chosen paths.

Documents are sets of runs of five words. Sets that are equal become one representative with a number of
copies. Every representative gets a MinHash signature; equal signature values stand for shared tokens
that are sampled with a chance of the Jaccard similarity. The join is repeated in runs, each with a first
coordinate of its own: sets are split by the value there. Small buckets are compared by brute force on the
signatures, with a margin far below the threshold. A larger bucket is split on, into the values at several
further pairs of coordinates that no set on this path was split by before. Of a large bucket a few members,
drawn by hashes of the path, are compared with all others: those near enough to one of them need no further
split, since by the triangle inequality of the Jaccard distance every set similar to them lies within the sum
of both distances of the drawn member, and whatever is near enough for that is linked to it. What is still
large after the last split is linked as it is, so nothing is dropped.

The number of runs follows from ``target``, the share of pairs at the threshold that must meet: see
:func:`plan`. At 0.8 and 0.9998 three branches and 12 runs are needed (at 0.99999 19 runs); a pair all of whose meetings
lie five splits deep is missed with a chance of 1.8e-4, one that meets in buckets that are small at once with 4e-9. Runs take their coordinates from one signature, so they are not
independent; the plan counts that in, and a test holds it against drawn agreements.

The pairs found link sets to families (connected components). Within a family all pairs are verified
exactly on the sets of the whole texts, by matrix products; a large family is dealt to tasks by pairs of
blocks. Only counts and one link to the smallest linked member leave a task, never all pairs.

Result, one row per row of the table: doc_id, class_id (smallest doc_id reachable over links), n_links (other
documents of similarity at least 0.8, equal ones included), n_similar_texts (different sets among them).

Words are separated by white space and compared as they are; a text of one to four words is one run of
all its words. Defined cases: a null or blank text is a class of its own without links; different texts
under one doc_id count as documents each, repeated rows of one doc_id and set as one; rows with a null
doc_id are documents each, and a class of such rows alone has a null class_id; empty table: empty result;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .expressions import fresh
from .grouping import map_groups
from .workspace import Workspace, table

N, COORDINATES, TARGET = 5, 128, 0.9998
SMALL, SPLITS, MARGIN = 256, 5, 0.2
#: Coordinates that a branch is split by together, the chance at least with which a pair survives one split, and the
#: members of a large bucket that are compared with all others.
TOGETHER, SURVIVE, HEADS = 2, 0.95, 4
BLOCK_DOCS, BLOCK_SHINGLES = 750, 2_000_000
MIX = np.uint64(0xBF58476D1CE4E5B9)
_draw = np.random.default_rng(20_240_501)
FACTORS = _draw.integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _draw.integers(0, 2**63, COORDINATES, dtype=np.uint64)


def routes(runs: int, branches: int, splits: int = SPLITS) -> list[tuple[int, list[list[list[int]]]]]:
    """Of each run: its first coordinate, and the coordinates of every branch of every split.

    Each run shuffles all coordinates anew; its splits take disjoint slices, and so do the branches of a split, so that
    no coordinate comes twice on a path.
    """
    draw, out = np.random.default_rng(20_240_502), []
    first = draw.permutation(COORDINATES).tolist()
    width = (COORDINATES - 1) // splits
    for run in range(runs):
        rest = draw.permutation([c for c in range(COORDINATES) if c != first[run]]).tolist()
        slices = [rest[k * width : (k + 1) * width] for k in range(splits)]
        out.append((first[run], [[s[b * TOGETHER : (b + 1) * TOGETHER] for b in range(branches)] for s in slices]))
    return out


def missed(percent: int, runs: int, branches: int, splits: int = SPLITS) -> float:
    """The chance that a pair of this similarity that needs all splits meets in none of the runs.

    All runs read one signature. How many of its coordinates agree is binomial; given that number, the runs, which
    shuffle the coordinates, are taken as independent. A run succeeds if its first coordinate agrees and each split
    has a branch whose coordinates all agree.
    """
    j, out = percent / 100, 0.0
    for k in range(COORDINATES + 1):
        share = k / COORDINATES
        together = math.prod(max(k - i, 0) / (COORDINATES - i) for i in range(TOGETHER))
        deep = share * (1 - (1 - together) ** branches) ** splits
        out += math.comb(COORDINATES, k) * j**k * (1 - j) ** (COORDINATES - k) * (1 - deep) ** runs
    return out


def plan(percent: int, target: float = TARGET, splits: int = SPLITS) -> tuple[int, int]:
    """(runs, branches) such that a pair at the threshold meets with a chance of ``target`` at the least.

    A pair of similarity j survives a split into b branches of k coordinates with 1 - (1 - j^k)^b; b is the smallest
    number that makes this ``SURVIVE`` or more. The runs are as many as :func:`missed` asks for. Signatures of
    ``COORDINATES`` values have room for that from 50 per cent up; below, and for a target out of reach, it is a ValueError.
    """
    j = min(percent / 100, 1 - 1e-9)
    branches = math.ceil(math.log(1 - SURVIVE) / math.log(1 - j**TOGETHER))
    if branches * TOGETHER * splits < COORDINATES:
        for runs in range(1, COORDINATES + 1):
            if missed(percent, runs, branches, splits) <= 1 - target:
                return runs, branches
    raise ValueError(f"{percent} per cent and a recall of {target} need more than {COORDINATES} coordinates")


class Shingler:
    """Sets of word runs as sorted arrays of 64-bit hashes; the same hashes in every task."""

    def __init__(self, n: int, cache_entries: int = 1_000_000):
        self.n, self.cache, self.cache_entries = n, {}, cache_entries

    def __call__(self, text: str | None) -> np.ndarray:
        from xxhash import xxh3_64_intdigest

        words = (text or "").split()
        if len(self.cache) > self.cache_entries:
            self.cache.clear()
        cache = self.cache
        try:
            ids = [cache[w] for w in words]
        except KeyError:
            for w in words:
                if w not in cache:
                    cache[w] = xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
            ids = [cache[w] for w in words]
        x = np.array(ids, np.uint64)
        if not len(x):
            return x
        k = min(self.n, len(x))
        h = np.zeros(len(x) - k + 1, np.uint64)
        for j in range(k):
            h = (h ^ x[j : j + len(h)]) * MIX
            h ^= h >> np.uint64(29)
        return np.unique(h)


def signature(shingles: np.ndarray) -> np.ndarray:
    low = np.full(COORDINATES, 2**32 - 1, np.uint64)
    for at in range(0, len(shingles), 2048):
        x = shingles[at : at + 2048]
        low = np.minimum(low, ((FACTORS[:, None] * x + SHIFTS[:, None]) >> np.uint64(32)).min(1))
    return low


def sketches(df: DataFrame, n: int) -> DataFrame:
    """doc_id, version, size, h1, h2 (identity of the set), sig (128 values of 32 bits as int)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        shingle = Shingler(n)
        for batch in batches:
            sizes, ids, sigs = [], [], []
            for text in batch["text"].to_pylist():
                s = shingle(text)
                sizes.append(len(s))
                ids.append(np.frombuffer(xxh3_128_digest(s.tobytes()), np.int64))
                sigs.append(signature(s).astype(np.uint32).view(np.int32))
            h = np.array(ids, np.int64).reshape(-1, 2)
            flat = np.concatenate(sigs) if sigs else np.empty(0, np.int32)
            lists = pa.ListArray.from_arrays(np.arange(len(sigs) + 1, dtype=np.int32) * COORDINATES, flat)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["version"], pa.array(sizes, pa.int64()), pa.array(h[:, 0]), pa.array(h[:, 1]), lists],
                ["doc_id", "version", "size", "h1", "h2", "sig"],
            )

    return df.mapInArrow(run, "doc_id long, version long, size long, h1 long, h2 long, sig array<int>")


def _near(sig: np.ndarray, least: float) -> np.ndarray:
    """Matrix of the pairs whose signatures agree in at least that share of the coordinates."""
    return (sig[:, None, :] == sig[None, :, :]).mean(2) >= least


def _pair(sig: np.ndarray, least: float) -> np.ndarray:
    """Roots of a bucket of two at most."""
    return np.array([0, 0] if len(sig) == 2 and (sig[0] == sig[1]).mean() >= least else range(len(sig)))


def _roots(links: np.ndarray) -> np.ndarray:
    """Smallest index of the component of each index, from a symmetric matrix of links."""
    root, links = np.arange(len(links)), links | np.eye(len(links), dtype=bool)
    while True:
        new = np.where(links, root[None, :], len(root)).min(1)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def candidate_links(reps: DataFrame, space: Workspace, percent: int, small: int = SMALL, splits: int = SPLITS, target: float = TARGET) -> DataFrame:
    """Links (a, b) that join all representatives that may be similar; ``reps``: id, sig."""
    schema = "a long, b long"
    runs, branches = plan(percent, target, splits)
    least = percent / 100 - MARGIN
    # Sets with an estimate of ``settled`` or more with a drawn member are split no further; all that are similar to
    # them have ``around`` or more with it, a quarter of the margin taken off. Where the threshold is low, fewer are settled.
    settled = max(percent / 100 - MARGIN / 2, 1 - percent / 100 + 0.3 + MARGIN / 4)
    around = settled - (1 - percent / 100) - MARGIN / 4

    def bucket(t, bounds):
        import pyarrow as pa

        ids = t["id"].to_numpy()
        sig = t["sig"].combine_chunks().flatten().to_numpy().reshape(-1, COORDINATES)
        a, b = [], []
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            order = lo + np.argsort(ids[lo:hi])
            root = _roots(_near(sig[order], least)) if hi - lo > 2 else _pair(sig[order], least)
            linked = root != np.arange(len(root))
            a.append(ids[order][linked])
            b.append(ids[order][root[linked]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    links, ways = [], routes(runs, branches, splits)
    first = F.array(*[F.struct(F.lit(r).alias("run"), F.xxhash64(F.lit(r), F.get("sig", F.lit(way[0]))).alias("path")) for r, way in enumerate(ways)])
    paths = reps.select("id", F.explode(first).alias("p")).select("id", "p.*")
    for level in range(splits):
        # Written, so that the join below has plain exchanges on both sides and a hot path can be split.
        sizes = space.save(paths.groupBy("path").agg(F.count("*").alias("n")).filter("n > 1"), f"sizes-{level}")
        shared = space.save(paths.join(sizes, "path"), f"paths-{level}")
        few = shared.filter(F.col("n") <= small).join(reps, "id").select("path", "id", "sig")
        links.append(space.save(map_groups(few, ["path"], bucket, schema).distinct(), f"links-{level}"))
        many = shared.filter(F.col("n") > small)
        if not many.take(1):
            return _union(links)
        drawn = many.groupBy("path").agg(*[F.min_by("id", F.xxhash64("path", "id", F.lit(k))).alias(f"h{k}") for k in range(HEADS)])
        heads = drawn.select("path", F.explode(F.array_distinct(F.array(*[f"h{k}" for k in range(HEADS)]))).alias("id")).join(reps, "id")
        heads = space.save(heads.groupBy("path").agg(F.collect_list(F.struct("id", "sig")).alias("heads")), f"drawn-{level}")
        agree = lambda h: F.struct(
            h["id"].alias("head"),
            F.aggregate(F.zip_with("sig", h["sig"], lambda x, y: (x == y).cast("int")), F.lit(0), lambda x, y: x + y).alias("same"),
        )
        split = []
        for k in range(branches):
            value = F.col("path")
            for c in range(TOGETHER):
                at = F.get(F.lit([way[1][level][k][c] for way in ways]), F.col("run"))
                value = F.xxhash64(value, at, F.get("sig", at))
            split.append(value)
        met = space.save(
            many.join(reps, "id").join(heads, "path")
            .select("id", "run", F.transform("heads", agree).alias("heads"), F.array(*split).alias("next")),
            f"met-{level}",
        )
        near = met.select("id", F.explode(F.filter("heads", lambda h: h["same"] >= around * COORDINATES)).alias("h")).filter("id <> h.head")
        links.append(space.save(near.select(F.col("id").alias("a"), F.col("h.head").alias("b")).distinct(), f"heads-{level}"))
        on = met.filter(~F.exists("heads", lambda h: h["same"] >= settled * COORDINATES))
        paths = on.select("id", "run", F.explode("next").alias("path"))
    sizes = space.save(paths.groupBy("path").agg(F.min("id").alias("head")), "left")
    links.append(paths.join(sizes, "path").filter("id <> head").select(F.col("id").alias("a"), F.col("head").alias("b")))
    return _union(links)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def similar_pairs(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Matrix of the pairs with a Jaccard similarity of at least ``percent`` per cent, exactly."""
    size = np.array([len(s) for s in sets])
    of = np.repeat(np.arange(len(sets)), size)
    every, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    both = np.zeros((len(sets), len(sets)), np.float32)
    common = np.flatnonzero(times > 1)
    place = np.full(len(every), -1)
    place[common] = np.arange(len(common))
    col, row = place[at], of
    row, col = row[col >= 0], col[col >= 0]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    width = 4096
    for lo in range(0, len(common), width):
        a, b = np.searchsorted(col, [lo, lo + width])
        part = np.zeros((len(sets), min(width, len(common) - lo)), np.float32)
        part[row[a:b], col[a:b] - lo] = 1
        both += part @ part.T
    both = both.astype(np.int64)
    return both * 100 >= percent * (size[:, None] + size[None, :] - both)


def verified(texts: DataFrame, members: DataFrame, n: int, percent: int) -> DataFrame:
    """Per representative and block pair: id, root (smallest linked), n_similar, n_links.

    ``texts``: id, text; ``members``: id, family, docs and shingles of the family, copies of the representative.
    """
    blocks = F.greatest(F.ceil(F.col("docs") / BLOCK_DOCS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    dealt = (
        members.withColumn("blocks", blocks)
        .withColumn("own", F.pmod(F.xxhash64("id", F.lit("block")), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "id", "copies", "own", "family",
            F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        )
    )

    def verify(t, bounds):
        import pyarrow as pa

        shingle = Shingler(n)
        ids, own, copies, i, j = (t[c].to_numpy() for c in ("id", "own", "copies", "i", "j"))
        text, out = t["text"], []
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            at = lo + np.argsort(ids[lo:hi])
            links = similar_pairs([shingle(text[int(k)].as_py()) for k in at], percent)
            np.fill_diagonal(links, False)
            if i[lo] != j[lo]:  # pairs within a block are counted where the block meets itself
                links &= own[at][:, None] != own[at][None, :]
            out.append((ids[at], ids[at][_roots(links)], links.sum(1), links @ copies[at]))
        columns = [pa.array(np.concatenate(c)) for c in zip(*out, strict=True)]
        return pa.RecordBatch.from_arrays(columns, ["id", "root", "n_similar", "n_links"])

    met = texts.join(dealt, "id").select("family", "i", "j", "id", "own", "copies", "text")
    return map_groups(met, ["family", "i", "j"], verify, "id long, root long, n_similar long, n_links long")


def classified(df: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = N, percent: int = 80, target: float = TARGET) -> DataFrame:
    """Per row: doc_id, version (hash of the text), root (the class as a number, null for blank texts), class_id, n_links, n_similar_texts."""
    space = Workspace(df.sparkSession, "jaccard-join")
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("version"), F.col(text).alias("text"))
    sketch = space.save(sketches(rows, n), "sketches")
    same = ["h1", "h2", "size"]
    full = sketch.filter("size > 0")
    # A document counts once for each of its sets; without an id each row is one.
    counted = full.filter("doc_id IS NOT NULL").select("doc_id", "version", *same).dropDuplicates(["doc_id", *same])
    counted = counted.unionByName(full.filter("doc_id IS NULL").select("doc_id", "version", *same))
    shown = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "version")).alias("shown")
    reps = counted.groupBy(*same).agg(shown, F.count("*").alias("copies"))
    reps = space.save(reps.select(F.monotonically_increasing_id().alias("id"), *same, "copies", "shown.doc_id", "shown.version"), "reps")
    keys = reps.select("id", *same, F.col("doc_id").alias("_doc"), F.col("version").alias("_version"))
    is_shown = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("version") == F.col("_version"))
    signed = full.select("doc_id", "version", *[F.col(c).alias(f"_{c}") for c in same], "sig").join(
        keys, is_shown & F.expr(" AND ".join(f"{c} = _{c}" for c in same))
    )
    signed = space.save(signed.dropDuplicates(["id"]).select("id", "sig"), "signed")
    links = candidate_links(signed, space, percent, target=target)
    family = components(links, space, "families").withColumnRenamed("root", "family")
    members = family.join(reps.select("id", "size", "copies", "doc_id", "version"), "id")
    totals = space.save(members.groupBy("family").agg(F.count("*").alias("docs"), F.sum("size").alias("shingles")), "totals")
    members = space.save(members.join(totals, "family"), "members")
    wanted = members.select("id", F.col("doc_id").alias("_doc"), F.col("version").alias("_version"))
    texts = space.save(rows.join(wanted, is_shown).select("id", "text"), "texts")  # repeated rows give one each
    found = space.save(verified(texts.dropDuplicates(["id"]), members, n, percent), "verified")
    counts = found.groupBy("id").agg(F.sum("n_similar").alias("n_similar"), F.sum("n_links").alias("n_links"))
    classes = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")), space, "classes")
    of_rep = reps.join(counts, "id", "left").join(classes, "id", "left").select(
        *same, "doc_id", F.coalesce("root", "id").alias("root"),
        (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("n_similar", F.lit(0)).alias("n_similar_texts"),
    )
    of_rep = space.save(of_rep, "of-rep")
    smallest = space.save(of_rep.groupBy("root").agg(F.min("doc_id").alias("class_id")), "smallest")
    of_rep = of_rep.drop("doc_id").join(smallest, "root")
    out = ["doc_id", "version", "root", "class_id", "n_links", "n_similar_texts"]
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    alone = sketch.filter("size = 0").select(
        "doc_id", "version", none.alias("root"), F.col("doc_id").alias("class_id"), zero.alias("n_links"), zero.alias("n_similar_texts")
    )
    return full.select("doc_id", "version", *same).join(of_rep, same).select(*out).unionByName(alone)


def jaccard_join(df: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = N, percent: int = 80, target: float = TARGET) -> DataFrame:
    """doc_id, class_id, n_links, n_similar_texts for every row."""
    return classified(df, doc_id, text, n, percent, target).drop("version", "root")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class the document with the smallest doc_id, null ids last.

    Of repeated rows of one doc_id and text one stays; different texts under one doc_id are documents each;
    blank texts are classes of their own and stay; an empty table gives no rows.
    """
    of, doc, version = fresh(docs, "version_of", "doc", "version")
    found = classified(docs)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "version")).alias("m")
    first = found.filter("root IS NOT NULL").groupBy("root").agg(best).select("m.doc_id", "m.version")
    first = first.unionByName(found.filter("root IS NULL").select("doc_id", "version").distinct())
    first = first.select(F.col("doc_id").alias(doc), F.col("version").alias(version))
    marked = docs.withColumn(of, F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(of) == F.col(version))
    return marked.join(first, same, "left_semi").dropDuplicates(["doc_id", of]).select(*docs.columns)
