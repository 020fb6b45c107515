"""Readers: every reader has an explicit schema, and where order is observable a position column."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import base_name, strip
from ..schemas import ARTICLE, CANDIDATE, CATALOG, EVENT, META


def batch(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of article records, with ``pos``."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(F.from_json("value", f"array<struct<{_struct(ARTICLE)}>>")).alias("pos", "a")).select("pos", "a.*")


def _struct(ddl: str) -> str:
    """A column list as the inside of a struct type."""
    return ", ".join(":".join(part.split(" ", 1)) for part in ddl.split(", "))


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """One row: updatedAt, articles."""
    return spark.read.schema(CATALOG).option("multiLine", True).json(path)


def catalog_articles(cat: DataFrame) -> DataFrame:
    return cat.select("updatedAt", F.posexplode("articles").alias("pos", "a")).select("updatedAt", "pos", "a.*")


def metas(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(META).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """slug, html of the HTML files of a folder (not of folders below)."""
    text = spark.read.option("pathGlobFilter", "*.html").text(folder, wholetext=True)
    return text.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.html$", "").alias("slug"), F.col("value").alias("html"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """path, value, pos of text lines in the order of each file; pos grows along a file."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value", F.monotonically_increasing_id().alias("pos"))


def events(df: DataFrame, observe: str | Observation | None = None) -> DataFrame:
    """Parse event lines (column value); lines that are no events are left out.

    With ``observe`` Spark counts them on the way, n lines and dropped of them, in the progress of a stream under that
    name, or in an observation. A global sort of the rows reads them twice and so counts them twice; see
    :func:`line_counts` for such plans.
    """
    parsed = df.withColumn("event", F.from_json("value", EVENT))
    if observe is not None:
        parsed = parsed.observe(observe, F.count(F.lit(1)).alias("n"), F.count_if(F.col("event.type").isNull()).alias("dropped"))
    return parsed.filter("event.type IS NOT NULL")


def line_counts(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Per key: n lines, and dropped, those among them that are no events."""
    none = F.from_json("value", EVENT)["type"].isNull()
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(none).alias("dropped"))


def listing(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """name, path, modificationTime, length of the files that match."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select(base_name(F.col("path")).alias("name"), "path", "modificationTime", "length")


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """pos, url of the bullets of a URL list."""
    return lines(spark, path).filter(F.col("value").startswith("- ")).select("pos", F.substr("value", F.lit(3)).alias("url"))


def template(spark: SparkSession, path: str) -> DataFrame:
    """A prompt template as one row."""
    return spark.read.text(path, wholetext=True)


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Results of a web search as JSON lines: url, status, corp_header, og_image, published, lang."""
    return spark.read.schema(CANDIDATE).json(folder)


def cell(spark: SparkSession, path: str) -> DataFrame:
    """A one-value state file, stripped."""
    return spark.read.text(path, wholetext=True).select(strip(F.col("value")).alias("value"))


def cell_text(path: str) -> str | None:
    """A one-value state file as a stripped string; None where it is missing or blank."""
    try:
        with open(path, encoding="utf-8") as f:
            return f.read().strip() or None
    except FileNotFoundError:
        return None


def arguments(spark: SparkSession, slugs: Sequence[str]) -> DataFrame:
    """pos, slug of a list given on the command line."""
    if not slugs:
        raise ValueError("usage: at least one slug")
    return spark.range(1).select(F.posexplode(F.lit(list(slugs))).alias("pos", "slug"))  # of known, small size


def status_lines(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(text.splitlines())), "pos int, line string")


def config(path: str) -> dict:
    """Strict: a missing or malformed file is an error."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def webhook_url(path: str) -> str | None:
    """Tolerant: None where the file is missing, malformed or has no URL."""
    try:
        return config(path).get("webhookUrl") or None
    except (OSError, ValueError, AttributeError):
        return None


def last_lines(df: DataFrame, n: int = 10) -> DataFrame:
    """The last lines of each file, in order."""
    from pyspark.sql import Window

    back = Window.partitionBy("path").orderBy(F.desc("pos"))
    return df.withColumn("_back", F.row_number().over(back)).filter(F.col("_back") <= n).orderBy("path", "pos").drop("_back")
