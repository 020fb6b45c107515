"""Connected components of a graph of long ids, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace


def components(edges: DataFrame, space: Workspace, name: str, most: int = 60) -> DataFrame:
    """Smallest id of the component of every id: (id, root). ``edges`` has long columns a and b.

    Large-star and small-star steps by turns: each step links the neighbours of a node to the smallest
    one. The smallest neighbour is aggregated before it is shuffled and written before it is joined, so that
    the join has plain exchanges on both sides and Spark can split a node with very many neighbours. Each round
    is written to the shared folder.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            both = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        low = space.save(low, f"{name}-low")
        out = both.join(low, "a")
        if large:
            return out.filter("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = out.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
                low.select("a", F.col("m").alias("b"))
            )
        return out.filter("a <> b").distinct()

    now = space.save(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    mark = None
    for k in range(1, most):
        wide = space.save(star(now, True), f"{name}-wide")
        new = space.save(star(wide, False), f"{name}-{k}")
        found = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        space.drop(f"{name}-{k - 1}")
        now = new
        if found == mark:
            break
        mark = found
    else:
        raise RuntimeError("components did not converge")
    roots = now.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
