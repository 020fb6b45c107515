"""Bulk migration of page markup: all old blocks must be there, else the page is skipped with a reason."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import html_theme, lookup, replace_first
from ..schemas import THEME_LABEL


def migrate(pages: DataFrame, blocks: list[tuple[str, str]], old_crumb: str, site: str) -> DataFrame:
    """slug, html, skip_reason; html is the new page, or null where it is skipped."""
    html, theme = F.col("html"), F.col("_theme")
    # Fixed value: the format of a page's breadcrumb.
    crumb = F.concat(
        F.lit(f'<p class="crumb"><a href="{site}">トップ</a><span>›</span><a href="{site}?theme='), theme, F.lit('">'),
        lookup(THEME_LABEL, theme), F.lit("</a><span>›</span>この記事</p>"),
    )
    whole = F.lit(True)
    for old, _ in blocks:
        whole = whole & F.contains(html, F.lit(old))
    reason = (
        F.when(~whole, "markup").when(theme.isNull(), "theme").when(~F.contains(html, F.lit(old_crumb)), "breadcrumb")
    )
    new = replace_first(html, F.lit(old_crumb), crumb)
    for old, fresh in blocks:
        new = replace_first(new, F.lit(old), F.lit(fresh))
    known = pages.select("slug", "html", html_theme(html).alias("_theme"))
    return known.select("slug", F.when(reason.isNull(), new).alias("html"), reason.alias("skip_reason"))


def report(done: DataFrame) -> DataFrame:
    """migrated, skipped: numbers of pages."""
    skipped = F.col("skip_reason").isNotNull()
    return done.agg(F.count_if(~skipped).alias("migrated"), F.count_if(skipped).alias("skipped"))


def skipped(done: DataFrame) -> DataFrame:
    """slug, skip_reason of the pages that were left as they are, in order."""
    return done.filter("skip_reason IS NOT NULL").select("slug", "skip_reason").orderBy("slug")
