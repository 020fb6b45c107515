"""Catalog operators: projections, joins with slug lists, prepending, removal, ordered text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import missing
from ..schemas import META_COLUMNS


def page_url(site: str, slug: str = "slug") -> Column:
    return F.concat(F.lit(site.rstrip("/")), F.lit("/"), F.col(slug), F.lit(".html"))


def to_meta(df: DataFrame, site: str) -> DataFrame:
    """Draft metadata of batch records; the card bullets become the bullets, the thumbnail an image."""
    return df.select(
        "slug", page_url(site).alias("url"), "sourceUrl", "platforms", "viewpoint", "theme", "source", "date", "title",
        F.col("cardBullets").alias("bullets"),
        F.struct(F.lit("image").alias("type"), F.col("thumbnail").alias("url")).alias("thumbnail"),
    )


def in_list_order(slugs: DataFrame, df: DataFrame) -> DataFrame:
    """Rows of ``df`` for a list of slugs, with the list's position."""
    return slugs.join(df, "slug", "inner")


def prepend(promoted: DataFrame, catalog: DataFrame) -> DataFrame:
    """Catalog with promoted rows put in front one after another: the last of the list comes first."""
    new = promoted.select((-F.col("pos") - 1).cast("long").alias("pos"), *META_COLUMNS)
    return new.unionByName(catalog.select(F.col("pos").cast("long"), *META_COLUMNS))


def as_catalog(rows: DataFrame, today: str) -> DataFrame:
    """One row: updatedAt, articles in order."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", F.struct(*META_COLUMNS).alias("a"))), lambda x, y: (x["pos"] > y["pos"]).cast("int") - (x["pos"] < y["pos"]).cast("int"))
    return rows.agg(F.lit(today).alias("updatedAt"), F.transform(ordered, lambda x: x["a"]).alias("articles"))


def rejected(df: DataFrame, slugs: DataFrame) -> DataFrame:
    return df.join(slugs.select("slug"), "slug", "left_anti")


def existed(slugs: DataFrame, *tables: DataFrame) -> DataFrame:
    """pos, slug, existed: whether any of the tables has the slug."""
    out = slugs.select("pos", "slug")
    for k, t in enumerate(tables):
        out = out.join(t.select("slug").distinct().withColumn(f"_{k}", F.lit(True)), "slug", "left")
    found = F.coalesce(*[F.col(f"_{k}") for k in range(len(tables))], F.lit(False))
    return out.select("pos", "slug", found.alias("existed"))


def unused(candidates: DataFrame, used: DataFrame, url: str = "url") -> DataFrame:
    """Candidates whose exact URL is not in the list."""
    return candidates.join(used.select(url).distinct(), url, "left_anti")


def usable(candidates: DataFrame, today: str, days: int = 7) -> DataFrame:
    """Candidates that answer with 200, may be embedded, and are recent; the newest first."""
    return candidates.filter(
        (F.col("status") == 200)
        & ~F.coalesce(F.lower("corp_header"), F.lit("")).isin("same-site", "same-origin")
        & (F.col("published") >= F.date_sub(F.lit(today).cast("date"), days))
    ).orderBy(F.desc("published"), "url")


def unresolved_links(articles: DataFrame) -> DataFrame:
    """slug, related slug of links to articles that are not there."""
    links = articles.select("slug", F.explode("related").alias("r")).select("slug", F.col("r.slug").alias("related_slug"))
    return links.join(articles.select(F.col("slug").alias("related_slug")).distinct(), "related_slug", "left_anti")


def text_of(rows: DataFrame, line: Column, head: str = "", order: str = "pos", keys: tuple[str, ...] = (), sep: str = "\n") -> DataFrame:
    """keys, text: the lines in order below a head, one text per key. For texts of bounded length, such as a message."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda x: x["l"])
    return rows.groupBy(*keys).agg(F.concat(F.lit(head), F.array_join(lines, sep, "")).alias("text"))


def url_lines(catalog: DataFrame, url: str = "sourceUrl") -> DataFrame:
    """Adds ``line``, the entry in a URL list; rows without URL are left out, repeated URLs stay."""
    return catalog.filter(~missing(F.col(url))).withColumn("line", F.concat(F.lit("- "), F.col(url)))


def numbered(rows: DataFrame, order: str, keys: tuple[str, ...] = (), name: str = "number", width: int = 1 << 16) -> DataFrame:
    """Adds the number of each row, from 1, within its keys in the order of a whole number that is unique there.

    Rows are numbered within ranges of ``width`` values of ``order`` and moved up by the rows of the ranges
    before, which are counted first; so a key that holds most of the rows is spread over many tasks, and only
    the counts of its ranges meet in one.
    """
    ranged = rows.withColumn("_range", F.floor(F.col(order) / width))
    before = Window.partitionBy(*[f"_{k}" for k in keys]).orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_range").alias("_of")).agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    same = F.col("_range").eqNullSafe(F.col("_of"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    within = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(order))
    out = ranged.withColumn("_within", within).join(counts, same)
    return out.withColumn(name, (F.col("_within") + F.col("_before")).cast("long")).select(*rows.columns, name)


def notification(rows: DataFrame, head: str = "", keys: tuple[str, ...] = ()) -> DataFrame:
    """Numbered message on drafts, or one for each of the keys: title, labels and link of each."""
    said = lambda c: F.coalesce(F.col(c), F.lit(""))
    line = F.concat(
        F.col("number").cast("string"), F.lit(". *"), said("title"), F.lit("*\n   "), F.coalesce(F.array_join("platforms", "/", ""), F.lit("")),
        F.lit(" / "), said("viewpoint"), F.lit(" / "), said("theme"), F.lit(" / "), said("source"), F.lit(" / "), said("date"),
        F.lit("\n   下書き: "), said("draft_url"),
    )
    return text_of(numbered(rows, "pos", keys), line, head, keys=keys)


def newest(files: DataFrame, n: int = 1) -> DataFrame:
    return files.orderBy(F.desc("modificationTime"), "path").limit(n)


def new_files(after: DataFrame, before: DataFrame) -> DataFrame:
    """Files whose name, whatever its case, was not there before."""
    old = before.select(F.lower("name").alias("_n")).distinct()
    return after.join(old, F.lower(after["name"]) == F.col("_n"), "left_anti")


def stale_batches(status: DataFrame) -> DataFrame:
    """Names of untracked batch files in version-control status lines."""
    name = F.regexp_extract("line", r"(?i)^\?\? automation/(articles-batch-.*\.json)$", 1)
    return status.select("pos", name.alias("name")).filter("name <> ''")
