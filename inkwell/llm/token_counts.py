"""Operator 5: token counts from an exact length histogram.

Texts are encoded in tasks; only their lengths leave them. Documents are aggregated by encoded length,
and suffix sums over that histogram answer, for every context limit, how many documents reach it, how
many tokens those hold, how many tokens stay when every document is truncated to it, and which quantile
of the lengths it is. The sums are taken within blocks of lengths and shifted by the sums of the longer
blocks, so no task sees the whole histogram.

Defined cases: a null text has 0 tokens; repeated rows count each; an empty table gives only the
requested limits with zeros and a null quantile; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tokens import TokenBytes, default_path
from .workspace import Workspace, table

BLOCK = 1024
LIMITS = tuple(2**k for k in range(7, 21))


def token_lengths(df: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, n_tokens of every row; ``path`` is a tokenizer file at the same place on every node."""
    path = path or default_path()

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encode = TokenBytes(path)
        for batch in batches:
            lengths = [len(encode(x)) // 4 if x else 0 for x in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(lengths, pa.int64())], ["doc_id", "n_tokens"])

    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(count, f"doc_id {dict(rows.dtypes)['doc_id']}, n_tokens long")


def length_histogram(lengths: DataFrame, limits: Sequence[int] = LIMITS) -> DataFrame:
    """Counts and suffix sums at every occurring length and every limit asked for."""
    spark = lengths.sparkSession
    asked = spark.createDataFrame([(int(x), 0) for x in limits], "n_tokens long, n_docs long")
    # Saved, since both the blocks and the rows read it: the texts are encoded once.
    counted = (
        lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))
        .unionByName(asked)
        .groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))
    )
    hist = (
        Workspace(spark, "length-histogram").save(counted, "counted")
        .withColumn("block", F.expr(f"n_tokens DIV {BLOCK}"))
        .withColumn("tokens", F.col("n_docs") * F.col("n_tokens"))
    )
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("b_docs"), F.sum("tokens").alias("b_tokens"))
    longer = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("b_docs").over(longer), F.lit(0)).alias("longer_docs"),
        F.coalesce(F.sum("b_tokens").over(longer), F.lit(0)).alias("longer_tokens"),
        F.sum("b_docs").over(whole).alias("total_docs"),
        F.sum("b_tokens").over(whole).alias("total_tokens"),
    )
    within = Window.partitionBy("block").orderBy(F.desc("n_tokens"))
    summed = hist.join(blocks, "block").select(
        "n_tokens", "n_docs", "total_docs", "total_tokens",
        (F.sum("n_docs").over(within) + F.col("longer_docs")).alias("docs_at_least"),
        (F.sum("tokens").over(within) + F.col("longer_tokens")).alias("tokens_at_least"),
    )
    return summed.select(
        "*",
        (F.col("total_tokens") - F.col("tokens_at_least") + F.col("docs_at_least") * F.col("n_tokens")).alias(
            "truncated_tokens"
        ),
        F.try_divide(
            F.col("total_docs") - F.col("docs_at_least") + F.col("n_docs"), F.col("total_docs")
        ).alias("quantile"),
    )


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(token_lengths(table(spark, sf_dir, "documents")))
