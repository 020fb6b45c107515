"""String functions as column expressions; no Python runs on the executors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def missing(c: Column) -> Column:
    """Null or empty; a blank counts as present."""
    return c.isNull() | (c == "")


def present(c: Column) -> Column:
    return F.when(~missing(c), c)


def escape_html(c: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(raw), F.lit(entity))
    return c


def unescape_html(c: Column) -> Column:
    for raw, entity in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"), ("&", "&amp;")):
        c = F.replace(c, F.lit(entity), F.lit(raw))
    return c


def joined(items: Column, sep: str) -> Column:
    """Array elements joined in order; a null element counts as empty, a null array as no elements."""
    return F.coalesce(F.array_join(items, sep, ""), F.lit(""))


def lookup(table: dict[str, str], key: Column, fold: bool = False, fallback: bool = True) -> Column:
    """Label of a code, else the code itself (or null); ``fold`` ignores case."""
    labels = F.create_map(*[F.lit(x) for k, v in table.items() for x in ((k.lower() if fold else k), v)])
    found = F.try_element_at(labels, F.lower(key) if fold else key)
    return F.coalesce(found, key) if fallback else found


def first_present(*columns: Column) -> Column:
    return F.coalesce(*map(present, columns))


def width(c: Column) -> Column:
    """Full-width length: half a unit for printable ASCII, one for any other code point."""
    return F.length(c) - F.lit(0.5) * F.length(F.regexp_replace(c, r"[^\x20-\x7E]", ""))


def has_digit(c: Column) -> Column:
    return c.rlike("[0-9０-９]")


def one_decimal(c: Column) -> Column:
    return F.format_string("%.1f", c)


def strip(c: Column) -> Column:
    """Without any Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def truncate(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """An expression that names a value several times, which is evaluated once."""
    return F.transform(F.array(value), body)[0]


def replace_first(c: Column, old: Column, new: Column) -> Column:
    """Replace the first occurrence of a literal; the plan grows by one step for each of nested calls."""

    def cut(text: Column) -> Column:
        end = lambda at: F.concat(F.substr(text, F.lit(1), at - 1), new, F.substr(text, at + F.length(old)))
        return once(F.position(old, text), lambda at: F.when(at > 0, end(at)).otherwise(text))

    return once(c, cut)


def promote_links(c: Column) -> Column:
    """Relative links of a draft as they are one folder higher, without the draft label."""
    c = F.regexp_replace(c, r'href="\.\./([a-z0-9-]+\.html)"', 'href="$1"')
    c = F.replace(c, F.lit('href="../../index.html'), F.lit('href="../index.html'))
    c = F.replace(c, F.lit('src="../../assets/'), F.lit('src="../assets/'))
    return F.replace(c, F.lit("この記事（下書き・未公開）"), F.lit("この記事"))


def html_theme(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r'class="cat theme-(visibility|optimization|measurement)"', 1), F.lit(""))


def base_name(c: Column) -> Column:
    return F.regexp_extract(c, r"[^/\\]+$", 0)


def whole_number(c: Column, default: int = 10) -> Column:
    return F.coalesce(F.when(c.rlike(r"^\d+$"), c.try_cast("int")), F.lit(default))


def menu(table: dict[str, str], code: Column, default: str = "") -> Column:
    """The value of a menu code; a default for codes that are not on the menu."""
    return F.coalesce(lookup(table, strip(code), fallback=False), F.lit(default))


def or_default(c: Column, label: str = "既定") -> Column:
    """The value, or a label where it is null or empty."""
    return F.coalesce(present(c), F.lit(label))


def answer(c: Column) -> Column:
    return F.upper(strip(c))


def url_host(c: Column) -> Column:
    return F.try_parse_url(c, F.lit("HOST"))
