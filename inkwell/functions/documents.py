"""Article documents: rendering from records and extraction from HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import PLATFORM_LABEL, THEME_LABEL
from .text import escape_html, html_theme, joined, lookup, missing, unescape_html


# The markup of a page below is a fixed format: existing pages have it and extract() reads it.


def render(df: DataFrame, site: str) -> DataFrame:
    """slug, html: a record as a draft page. A record without known theme has a null page."""
    e = lambda c: escape_html(F.coalesce(F.col(c), F.lit("")))
    theme = lookup(THEME_LABEL, F.col("theme"), fallback=False)
    platforms = joined(F.transform("platforms", lambda p: lookup(PLATFORM_LABEL, p)), "・")
    points = joined(F.transform("bullets", lambda b: F.concat(F.lit("    <li>"), escape_html(b), F.lit("</li>"))), "\n")
    related = joined(
        F.transform(
            "related",
            lambda r: F.concat(F.lit('    <a href="../'), escape_html(r["slug"]), F.lit('.html">'), escape_html(r["title"]), F.lit("</a>")),
        ),
        "\n",
    )
    original = F.when(missing(F.col("origTitle")), "").otherwise(F.concat(F.lit('  <p class="orig">原題: '), e("origTitle"), F.lit("</p>\n")))
    parts = [
        '<!DOCTYPE html>\n<html lang="ja">\n<head><meta charset="utf-8"><title>', e("title"), "</title></head>\n<body>\n",
        '<div class="wrap">\n  <p class="crumb"><a href="', site, '">トップ</a><span>›</span><a href="', site, "?theme=", e("theme"), '">', theme,
        "</a><span>›</span>この記事（下書き・未公開）</p>\n",
        '  <a class="thumb" href="', e("sourceUrl"), '"><img src="', e("thumbnail"), '" alt=""></a>\n  <div class="meta">\n',
        '    <span class="cat theme-', e("theme"), '">', theme, '</span>\n    <span class="platform">', escape_html(platforms),
        '</span>\n    <span class="src">', e("source"), '</span>\n    <span class="date">', e("dateDisplay"), "</span>\n  </div>\n  <h1>", e("title"), "</h1>\n",
        original, '  <h2>背景</h2>\n  <p class="background">', e("background"), '</p>\n  <h2>結論</h2>\n  <ul class="points">\n', points,
        '\n  </ul>\n  <div class="why">\n    <h2>メッセージ</h2>\n    <p>', e("meaning"), '</p>\n  </div>\n  <a class="source-link" href="', e("sourceUrl"),
        '">元記事を読む（', e("source"), '）↗</a>\n  <div class="related">\n    <h2>関連記事</h2>\n', related, "\n  </div>\n</div>\n</body>\n</html>\n",
    ]
    return df.select("slug", F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts]).alias("html"))


def page_title(html: Column) -> Column:
    return F.regexp_extract(html, "<title>([^<]*)</title>", 1)


def page_lang(html: Column) -> Column:
    """Language code of a page, null without one."""
    return F.nullif(F.regexp_extract(html, '<html lang="([a-z]+)"', 1), F.lit(""))


def page_links(html: Column) -> Column:
    """Link targets of a page in order."""
    return F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))


def extract(df: DataFrame, html: str = "html") -> DataFrame:
    """Adds the fields of an article page; a field that is not there is null."""
    h = F.col(html)
    one = lambda p: unescape_html(F.nullif(F.regexp_extract(h, "(?s)" + p, 1), F.lit("")))
    points = F.regexp_extract(h, r'(?s)<ul class="points">(.*?)</ul>', 1)
    links = F.regexp_extract(h, r'(?s)<div class="related">(.*?)</div>', 1)
    return df.withColumns(
        {
            "title": one(r"<h1>(.*?)</h1>"),
            "theme": html_theme(h),
            "platform_labels": F.split(one(r'<span class="platform">(.*?)</span>'), "・"),
            "source": one(r'<span class="src">(.*?)</span>'),
            "date_display": one(r'<span class="date">(.*?)</span>'),
            "orig_title": one(r'<p class="orig">原題: (.*?)</p>'),
            "background": one(r'<p class="background">(.*?)</p>'),
            "bullets": F.transform(F.regexp_extract_all(points, F.lit("(?s)<li>(.*?)</li>"), F.lit(1)), unescape_html),
            "message": one(r'<div class="why">.*?<p>(.*?)</p>'),
            "source_url": one(r'<a class="source-link" href="(.*?)"'),
            "thumbnail_url": one(r'<a class="thumb".*?<img src="(.*?)"'),
            "related": F.zip_with(
                F.regexp_extract_all(links, F.lit('<a href="(.*?)"'), F.lit(1)),
                F.regexp_extract_all(links, F.lit('(?s)<a href=".*?">(.*?)</a>'), F.lit(1)),
                lambda a, b: F.struct(unescape_html(a).alias("href"), unescape_html(b).alias("title")),
            ),
        }
    )
