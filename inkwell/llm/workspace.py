"""Shared storage for intermediate tables.

Intermediate results that several jobs read are written once as Parquet below the folder that the
session names in ``spark.checkpoint.dir``; they survive lost executors and cut the lineage. Only where
that setting is missing (tests, notebooks) a local folder is chosen.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; in a session without it a temporary local one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="inkwell-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_opened: list[Workspace] = []


@contextmanager
def scratch(spark: SparkSession):
    """Deletes the tables of all operators called inside, once the caller has written what it needs of their results."""
    before = len(_opened)
    try:
        yield
    finally:
        while len(_opened) > before:
            _opened.pop().drop()


class Workspace:
    """Tables of one operator call: ``save`` writes and rereads, ``drop`` deletes what is no longer read.

    The result of an operator reads its tables when it is written, so they stay until :func:`scratch` ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        _opened.append(self)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
