"""Validation: every rule yields rows (pos, rule, ord, message); all violations are reported, in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_digit, missing, one_decimal, present, width
from ..schemas import CARD_BULLETS, CARD_WIDTH, REQUIRED

LISTS = ("bullets", "cardBullets")


def _name() -> F.Column:
    return F.coalesce(present(F.col("slug")), F.lit("(no slug)"))


def required(df: DataFrame, fields: list[str] = REQUIRED) -> DataFrame:
    """Required fields that are null, empty or an empty list."""
    bad = F.array_compact(
        F.array(
            *[
                F.when(F.coalesce(F.size(F.col(f)), F.lit(0)) <= 0 if f in LISTS else missing(F.col(f)), F.struct(F.lit(k).alias("ord"), F.lit(f).alias("field")))
                for k, f in enumerate(fields)
            ]
        )
    )
    rows = df.select("pos", _name().alias("name"), F.explode(bad).alias("b"))
    return rows.select("pos", F.lit("required").alias("rule"), "b.ord", F.format_string('[%d] %s: no value for "%s"', "pos", "name", "b.field").alias("message"))


def card_bullets(df: DataFrame) -> DataFrame:
    """Exactly three card bullets, each at most 55 full-width units; the second rule only where the first holds."""
    n = F.coalesce(F.size("cardBullets"), F.lit(0))
    count = df.filter((n != CARD_BULLETS) | F.col("cardBullets").isNull()).select(
        "pos", F.lit("card_count").alias("rule"), F.lit(0).alias("ord"),
        F.format_string(f"[%d] %s: %d card bullets instead of {CARD_BULLETS}", "pos", _name(), n).alias("message"),
    )
    each = df.filter(n == CARD_BULLETS).select("pos", F.col("slug"), F.posexplode("cardBullets").alias("ord", "b"))
    wide = each.filter(width(F.col("b")) > CARD_WIDTH).select(
        "pos", F.lit("card_width").alias("rule"), "ord",
        F.format_string(
            f"[%d] %s: card bullet %d is %s units wide, {CARD_WIDTH} at most; to be written anew: %s",
            "pos", "slug", "ord", one_decimal(width(F.col("b"))), "b",
        ).alias("message"),
    )
    return count.unionByName(wide)


def without_digits(df: DataFrame) -> DataFrame:
    """Advisory: records none of whose bullets holds a digit."""
    return df.filter(F.col("bullets").isNotNull() & ~F.exists("bullets", lambda b: F.coalesce(has_digit(b), F.lit(False)))).select("pos", "slug")


def strict(df: DataFrame) -> None:
    """Raise with the ordered list of violations: required fields first, then card bullets."""
    for head, rule in (("records lack required fields", required), ("card bullets break the rules", card_bullets)):
        found = rule(df).orderBy("pos", "ord").collect()
        if found:
            raise ValueError("\n".join([head, *(r.message for r in found)]))


def promotable(slugs: DataFrame, drafts: DataFrame, metas: DataFrame, catalog: DataFrame) -> DataFrame:
    """pos, slug, problem of slugs that cannot be promoted (no draft, no meta, already there, named twice)."""
    mark = lambda d, c: d.select("slug").distinct().withColumn(c, F.lit(True))
    twice = slugs.groupBy("slug").agg(F.count("*").alias("times"))
    rows = slugs.join(mark(drafts, "d"), "slug", "left").join(mark(metas, "m"), "slug", "left").join(mark(catalog, "c"), "slug", "left").join(twice, "slug")
    problem = (
        F.when(F.col("d").isNull(), "draft not found").when(F.col("m").isNull(), "meta not found")
        .when(F.col("c"), "already published").when(F.col("times") > 1, "named twice")
    )
    return rows.select("pos", "slug", problem.alias("problem")).filter("problem IS NOT NULL")


def quality_report(df: DataFrame, keys: tuple[str, ...] = ("theme",), home: str = "ja") -> DataFrame:
    """Number of records and share of those in another language than ``home``, per theme or other keys."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg((F.col("lang") != home).cast("int")).alias("foreign_share"))
