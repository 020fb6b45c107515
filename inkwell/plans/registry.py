"""Queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import documents as D
from ..functions import text as X
from ..functions import times as T
from ..operators import catalog as C
from ..operators import events as E
from ..operators import migrate as M
from ..operators import validate
from ..operators.runs import run_gaps

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@query(r"""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
    regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, len(regexp_extract_all(html, 'href="'))::INT AS n_links FROM pages""")
def page_catalog(spark, d):
    return _t(spark, d, "pages").select(
        "page_id", D.page_title(F.col("html")).alias("title"), X.url_host(F.col("url")).alias("host"),
        F.size(D.page_links(F.col("html"))).alias("n_links"),
    )


@query(r"""SELECT doc_id, length(text) - 0.5::DOUBLE * length(regexp_replace(text, '[^\x20-\x7E]', '', 'g')) AS units FROM documents""")
def text_fullwidth_length(spark, d):
    return _t(spark, d, "documents").select("doc_id", X.width(F.col("text")).alias("units"))


@query(r"""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, nullif(regexp_extract(html, '<html lang="([a-z]+)"', 1), '') AS lang FROM pages""")
def page_title_extract(spark, d):
    return _t(spark, d, "pages").select(
        "page_id", D.page_title(F.col("html")).alias("title"), D.page_lang(F.col("html")).alias("lang"),
    )


@query("""SELECT page_id, replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS escaped FROM pages""")
def html_escape_url(spark, d):
    return _t(spark, d, "pages").select("page_id", X.escape_html(F.col("url")).alias("escaped"))


@query("""SELECT page_id, (i - 1)::INT AS pos, l[i] AS href FROM (
    SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS l FROM pages))""")
def page_links_explode(spark, d):
    return _t(spark, d, "pages").select("page_id", F.posexplode(D.page_links(F.col("html"))).alias("pos", "href"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def event_props_json(spark, d):
    return _t(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("""SELECT user_id, day, CASE WHEN date_diff('day', p, day) > 1 THEN (date_diff('day', p, day) - 1)::INT END AS missed FROM (
    SELECT *, lag(day) OVER (PARTITION BY user_id ORDER BY day) AS p FROM (SELECT DISTINCT user_id, ts::DATE AS day FROM events))""")
def activity_gaps(spark, d):
    days = _t(spark, d, "events").select("user_id", F.to_date("ts").alias("day")).distinct()
    return run_gaps(days, ["user_id"])


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def latest_event_per_user(spark, d):
    line = F.to_json(F.struct(F.lit("result").alias("type"), F.col("event_type").alias("result")))
    rows = _t(spark, d, "events").select("user_id", F.col("event_id").alias("pos"), line.alias("value"))
    return E.last_result(rows, ("user_id",)).select("user_id", F.col("result").alias("event_type"), F.col("pos").alias("event_id"))


@query("SELECT event_id, round_even(value / 10, 0)::BIGINT AS tens FROM events")
def half_even_round(spark, d):
    return _t(spark, d, "events").select("event_id", T.seconds(F.col("value") * 100).alias("tens"))


@query("SELECT conv_id, string_agg(role, '/' ORDER BY turn) AS path, count(*) AS n FROM conversations GROUP BY conv_id")
def ordered_role_path(spark, d):
    rows = _t(spark, d, "conversations")
    path = C.text_of(rows, F.col("role"), order="turn", keys=("conv_id",), sep="/").withColumnRenamed("text", "path")
    return path.join(rows.groupBy("conv_id").agg(F.count("*").alias("n")), "conv_id")


@query("SELECT doc_id, CASE WHEN length(s) > 200 THEN substr(s, 1, 200) || '...' ELSE s END AS short FROM (SELECT doc_id, trim(text, chr(32) || chr(9) || chr(10) || chr(13) || chr(160) || chr(12288)) AS s FROM documents)")
def truncate_200(spark, d):
    return _t(spark, d, "documents").select("doc_id", X.truncate(X.strip(F.col("text")), 200).alias("short"))


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, nullif(regexp_extract(url, '[?]([^#]*)', 1), '') AS query, regexp_extract(regexp_extract(url, '^[^?#]*'), '[^/]+$') AS base FROM pages")
def url_host_query(spark, d):
    return _t(spark, d, "pages").select(
        "page_id", X.url_host(F.col("url")).alias("host"), F.try_parse_url("url", F.lit("QUERY")).alias("query"),
        X.base_name(F.regexp_extract("url", "^[^?#]*", 0)).alias("base"),
    )


@query("SELECT doc_id FROM documents WHERE NOT regexp_matches(text, '[0-9０-９]')")
def docs_without_digits(spark, d):
    rows = _t(spark, d, "documents").select(F.col("doc_id").alias("pos"), F.col("doc_id").alias("slug"), F.split("text", "\n").alias("bullets"))
    return validate.without_digits(rows).select(F.col("slug").alias("doc_id"))


@query("SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS number FROM documents")
def numbering(spark, d):
    return C.numbered(_t(spark, d, "documents").select("doc_id", "source"), "doc_id", ("source",))


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 4")
def newest_four(spark, d):
    rows = _t(spark, d, "events").select(F.col("event_id").alias("path"), F.col("ts").alias("modificationTime"))
    return C.newest(rows, 4).select(F.col("path").alias("event_id"), F.col("modificationTime").alias("ts"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def typed_counts(spark, d):
    return _t(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unlabelled_documents(spark, d):
    return C.unused(_t(spark, d, "documents").select("doc_id"), _t(spark, d, "labels"), "doc_id")


@query(r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)
SELECT doc_id, 'card_count' AS rule, 0 AS ord, printf('[%d] %d: %d card bullets instead of 3', doc_id, doc_id, len(a)) AS message FROM l WHERE len(a) <> 3
UNION ALL SELECT doc_id, 'card_width', (i - 1)::INT, printf('[%d] %d: card bullet %d is %.1f units wide, 55 at most; to be written anew: ', doc_id, doc_id, i - 1, w) || a[i]
FROM (SELECT *, length(a[i]) - 0.5::DOUBLE * length(regexp_replace(a[i], '[^\x20-\x7E]', '', 'g')) AS w FROM (SELECT doc_id, unnest(range(1, 4)) AS i, a FROM l WHERE len(a) = 3)) WHERE w > 55""")
def card_rule_violations(spark, d):
    rows = _t(spark, d, "documents").select(F.col("doc_id").alias("pos"), F.col("doc_id").cast("string").alias("slug"), F.split("text", "\n", -1).alias("cardBullets"))
    return validate.card_bullets(rows).select(F.col("pos").alias("doc_id"), "rule", "ord", "message")


@query("""SELECT doc_id, 'text' AS field FROM documents WHERE text IS NULL OR text = ''
UNION ALL SELECT doc_id, 'lang' FROM documents WHERE lang IS NULL OR lang = '' OR lang = 'es'""")
def required_fields(spark, d):
    """Empty fields, Spanish counted as an empty language so that there are some."""
    rows = _t(spark, d, "documents").select(F.col("doc_id").alias("pos"), F.lit("").alias("slug"), "text", F.when(F.col("lang") != "es", F.col("lang")).alias("lang"))
    fields = ["text", "lang"]
    return validate.required(rows, fields).select(F.col("pos").alias("doc_id"), F.get(F.array(*map(F.lit, fields)), "ord").alias("field"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'Click' WHEN 'view' THEN 'View' ELSE event_type END AS label FROM events")
def label_lookup_fallback(spark, d):
    return _t(spark, d, "events").select("event_id", X.lookup({"CLICK": "Click", "VIEW": "View"}, F.col("event_type"), fold=True).alias("label"))


@query("SELECT event_id, coalesce(nullif(CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END, ''), nullif(props, '')) AS detail FROM events")
def first_truthy_detail(spark, d):
    some = F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("event_type"))
    return _t(spark, d, "events").select("event_id", X.first_present(some, F.col("props")).alias("detail"))


@query("""SELECT event_id, code <> 0 OR err OR mark <> '' OR props = '' AS failed,
    CASE WHEN code <> 0 THEN 'exit code ' || code WHEN err THEN 'error: ' || props WHEN mark <> '' THEN mark WHEN props = '' THEN 'no output' ELSE '' END AS reason
FROM (SELECT event_id, props, (event_id % 7 = 0)::INT AS code, event_id % 5 = 0 AS err, regexp_extract(props, '"k": (9[0-9]*)', 1) AS mark FROM events)""")
def outcome_classifier(spark, d):
    i = F.col("event_id")
    done = E.classify((i % 7 == 0).cast("int"), i % 5 == 0, F.col("props"), F.regexp_extract("props", '"k": (9[0-9]*)', 1), F.col("props"))
    return _t(spark, d, "events").select("event_id", done.alias("o")).select("event_id", "o.*")


@query("""SELECT event_id, CASE WHEN t > ts THEN t ELSE t + INTERVAL 1 DAY END AS reset_at FROM (
    SELECT event_id, ts, date_trunc('day', ts) + to_hours((event_id % 12 + CASE WHEN event_id % 2 = 0 THEN 12 ELSE 0 END)::INT) + INTERVAL 5 MINUTE AS t FROM events)""")
def next_reset_time(spark, d):
    i = F.col("event_id")
    hour = F.when(i % 12 == 0, 12).otherwise(i % 12).cast("string")
    text = F.concat(F.lit("limit Resets "), hour, F.when(i % 2 == 0, "pm").otherwise("AM"), F.lit(" (local)"))
    return _t(spark, d, "events").select("event_id", T.reset_time(text, F.col("ts")).cast("timestamp_ntz").alias("reset_at"))


@query(r"""SELECT page_id, replace(replace(replace(regexp_replace(h, 'href="\.\./([a-z0-9-]+\.html)"', 'href="\1"', 'g'),
    'href="../../index.html', 'href="../index.html'), 'src="../../assets/', 'src="../assets/'), 'この記事（下書き・未公開）', 'この記事') AS html
FROM (SELECT page_id, replace(replace(html, 'href="/', 'href="../'), '">', '.html">') AS h FROM pages)""")
def link_rewrite(spark, d):
    draft = F.replace(F.replace("html", F.lit('href="/'), F.lit('href="../')), F.lit('">'), F.lit('.html">'))
    return _t(spark, d, "pages").select("page_id", X.promote_links(draft).alias("html"))


@query("""SELECT page_id, CASE WHEN i > 0 THEN substr(html, 1, i - 1) || '<br/>' || substr(html, i + 4) ELSE html END AS html
    FROM (SELECT page_id, html, instr(html, '<br>') AS i FROM pages)""")
def first_occurrence_replace(spark, d):
    return _t(spark, d, "pages").select("page_id", X.replace_first(F.col("html"), F.lit("<br>"), F.lit("<br/>")).alias("html"))


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN -doc_id - 1 ELSE doc_id END AS pos FROM documents")
def catalog_prepend(spark, d):
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("pos"), F.col("doc_id").cast("string").alias("slug"))
    full = docs.select("pos", "slug", *[F.lit(None).alias(c) for c in C.META_COLUMNS if c != "slug"])
    promoted = full.filter("pos % 10 = 0")
    rest = full.join(promoted.select("slug"), "slug", "left_anti")
    return C.prepend(promoted, rest).select(F.col("slug").cast("long").alias("doc_id"), "pos")


@query(r"""SELECT url FROM (SELECT regexp_extract(url, '^[a-z]+://[^/?#]*') || unnest(regexp_extract_all(html, 'href="(/[^"]*)"', 1)) AS url FROM pages
    UNION ALL SELECT regexp_extract(url, '^[^?#]*') FROM pages) WHERE url NOT IN (SELECT url FROM pages)""")
def exact_url_dedup(spark, d):
    """Links within the sites of all pages, and the pages' own URLs without query and fragment, less those that are a page's exact URL."""
    pages = _t(spark, d, "pages")
    links = F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), F.lit(1))
    candidates = pages.select(F.regexp_extract("url", "^[a-z]+://[^/?#]*", 0).alias("site"), F.explode(links).alias("link"))
    bare = pages.select(F.regexp_extract("url", "^[^?#]*", 0).alias("url"))
    return C.unused(candidates.select(F.concat("site", "link").alias("url")).unionByName(bare), pages)


@query("SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS number, '- ' || doc_id AS line FROM documents WHERE lang IN ('en', 'de')")
def url_list_by_source(spark, d):
    """The numbered lines of each source's list; Spanish documents have an empty URL, French ones none. No list is put together in one row."""
    url = F.when(F.col("lang") == "es", "").when(F.col("lang") != "fr", F.col("doc_id").cast("string"))
    rows = _t(spark, d, "documents").select("doc_id", "source", url.alias("sourceUrl"))
    return C.numbered(C.url_lines(rows), "doc_id", ("source",)).select("doc_id", "source", "number", "line")


@query("""SELECT page_id, CASE WHEN NOT contains(html, '</article>') OR NOT contains(html, '</nav>') THEN 'markup'
    WHEN nullif(regexp_extract(html, '<html lang="(en|fr|de)"', 1), '') IS NULL THEN 'theme' WHEN NOT contains(html, '</body>') THEN 'breadcrumb' END AS reason FROM pages""")
def migration_reasons(spark, d):
    html = F.col("html")
    for lang, theme in (("en", "visibility"), ("fr", "optimization"), ("de", "measurement")):
        html = F.replace(html, F.lit(f'<html lang="{lang}"'), F.lit(f'<html class="cat theme-{theme}"'))
    pages = _t(spark, d, "pages").select(F.col("page_id").alias("slug"), html.alias("html"))
    done = M.migrate(pages, [("</article>", ""), ("</nav>", "")], "</body>", "")
    return done.select(F.col("slug").alias("page_id"), F.col("skip_reason").alias("reason"))


@query("SELECT quality, lang, count(*) AS n, avg((lang <> 'en')::INT) AS foreign_share FROM documents JOIN labels USING (doc_id) GROUP BY quality, lang")
def balance_report(spark, d):
    rows = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id")
    return validate.quality_report(rows, ("quality", "lang"), home="en")
