"""Queries that run the operators on records made from the driver's tables, each with the SQL of its rows.

The tables hold no article records, so each query first forms them from columns of a table with built-in
expressions; the operator then does the work, and the SQL says the same from the table alone.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import documents as D
from ..functions import text as X
from ..functions import times as T
from ..operators import catalog as C
from ..operators import events as E
from ..operators import migrate as M
from ..operators import runs, validate
from ..schemas import TOOL_LABEL
from ..sources import readers, scratch, sinks
from ..sources.changes import Changes
from ..sources.storage import Store
from ..streaming import state, summary
from . import pipelines
from .registry import ORACLE_SQL, QUERIES, _t, query

SITE = "https://site.example/media"


def _articles(spark, d):
    """Article records of pages; every fourth has no known theme. They are related to their first link and to the page of twice their number."""
    page = F.col("page_id")
    themes = F.array(*map(F.lit, ("visibility", "optimization", "measurement", "other")))
    links = D.page_links(F.col("html"))
    return _t(spark, d, "pages").select(
        page.alias("pos"), page.cast("string").alias("slug"), D.page_title(F.col("html")).alias("title"),
        F.when(page % 2 == 0, F.concat(F.lit("<"), D.page_title(F.col("html")), F.lit("> & \"'"))).alias("origTitle"),
        F.col("url").alias("sourceUrl"), X.url_host(F.col("url")).alias("source"), F.lit("2024-02-01").alias("date"),
        F.lit("2024年2月1日").alias("dateDisplay"), F.array(F.lit("google"), F.lit("x")).alias("platforms"), F.lit("seller").alias("viewpoint"),
        F.get(themes, (page % 4).cast("int")).alias("theme"), F.lit("t.png").alias("thumbnail"), F.lit("why & how").alias("background"),
        links.alias("bullets"), F.slice(links, 1, 3).alias("cardBullets"), F.lit("<so>").alias("meaning"),
        F.transform(
            F.array(F.replace(F.get(links, 0), F.lit("/"), F.lit("")), (page * 2 + 1).cast("string")), lambda x: F.struct(x.alias("slug"), F.lit("R & D").alias("title"))
        ).alias("related"),
    )


_LINKS = "regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)"
_TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"


@query(f"""SELECT page_id::VARCHAR AS slug, {_TITLE} AS title, ['visibility', 'optimization', 'measurement'][(page_id % 4)::INT + 1] AS theme,
    'Google/x' AS platforms, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS source, '2024年2月1日' AS date_display,
    CASE WHEN page_id % 2 = 0 THEN '<' || {_TITLE} || '> & "''' END AS orig_title, 'why & how' AS background, '<so>' AS message,
    url AS source_url, 't.png' AS thumbnail_url, array_to_string({_LINKS}, ' ') AS bullets,
    '../' || replace({_LINKS}[1], '/', '') || '.html R & D ../' || 2 * page_id + 1 || '.html R & D' AS related
    FROM pages WHERE page_id % 4 < 3""")
def article_round_trip(spark, d):
    """Rendered pages, read again."""
    back = D.extract(D.render(_articles(spark, d), SITE).filter("html IS NOT NULL"))
    links = F.transform("related", lambda r: F.concat_ws(" ", r["href"], r["title"]))
    return back.select(
        "slug", "title", "theme", F.array_join("platform_labels", "/").alias("platforms"), "source", "date_display", "orig_title", "background",
        "message", "source_url", "thumbnail_url", F.array_join("bullets", " ").alias("bullets"), F.nullif(F.array_join(links, " "), F.lit("")).alias("related"),
    )


@query(f"""SELECT page_id::VARCHAR AS slug, '{SITE}/' || page_id || '.html' AS url, array_to_string({_LINKS}[1:3], ' ') AS bullets, 'image' AS kind FROM pages""")
def draft_metas(spark, d):
    done = C.to_meta(_articles(spark, d), SITE)
    return done.select("slug", "url", F.array_join("bullets", " ").alias("bullets"), F.col("thumbnail.type").alias("kind"))


@query("""SELECT doc_id AS pos, 'required' AS rule, k::INT AS ord, '[' || doc_id || '] ' || coalesce(nullif(source, ''), '(no slug)') || ': no value for "' || f || '"' AS message
    FROM (SELECT doc_id, source, 0 AS k, 'text' AS f FROM documents WHERE coalesce(text, '') = ''
    UNION ALL SELECT doc_id, source, 1, 'lang' FROM documents WHERE coalesce(lang, '') IN ('', 'es'))""")
def required_messages(spark, d):
    rows = _t(spark, d, "documents").select(F.col("doc_id").alias("pos"), F.col("source").alias("slug"), "text", F.nullif("lang", F.lit("es")).alias("lang"))
    return validate.required(rows, ["text", "lang"])


@query("""WITH s AS (SELECT doc_id, doc_id % 13 = 0 AS again FROM documents), asked AS (SELECT doc_id, count(*) OVER (PARTITION BY doc_id) AS n
        FROM (SELECT doc_id FROM s UNION ALL SELECT doc_id FROM s WHERE again))
    SELECT doc_id::VARCHAR AS slug, CASE WHEN doc_id NOT IN (SELECT doc_id FROM labels) THEN 'draft not found'
        WHEN doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 'meta not found'
        WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'already published' WHEN n > 1 THEN 'named twice' END AS problem
    FROM asked WHERE problem IS NOT NULL""")
def promotion_problems(spark, d):
    """Documents to promote, some named twice; labelled ones are drafts, good ones have metadata, toxic ones are in the catalog."""
    slug = lambda df: df.select(F.col("doc_id").cast("string").alias("slug"))
    docs, labels = _t(spark, d, "documents"), _t(spark, d, "labels")
    asked = slug(docs).unionByName(slug(docs.filter("doc_id % 13 = 0"))).withColumn("pos", F.col("slug").cast("long"))
    return validate.promotable(asked, slug(labels), slug(labels.filter("quality = 1")), slug(labels.filter("toxic = 1"))).select("slug", "problem")


#: What every page, most pages and some pages hold.
_OLD = ("</article>", "</body>", "<br><p>")


@query("""WITH h AS (SELECT page_id, replace(replace(html, '<html lang="en"', '<html class="cat theme-visibility"'), '<html lang="fr"', '<html class="cat theme-measurement"') AS h FROM pages),
    t AS (SELECT *, nullif(regexp_extract(h, 'class="cat theme-(visibility|measurement)"', 1), '') AS theme FROM h),
    r AS (SELECT *, CASE WHEN NOT contains(h, '</article>') OR NOT contains(h, '</body>') THEN 'markup' WHEN theme IS NULL THEN 'theme' WHEN NOT contains(h, '<br><p>') THEN 'breadcrumb' END AS reason FROM t),
    a AS (SELECT *, substr(h, 1, instr(h, '<br><p>') - 1) || '<p class="crumb"><a href="s">トップ</a><span>›</span><a href="s?theme=' || theme || '">'
        || CASE theme WHEN 'visibility' THEN '検索結果・購買導線の変化' ELSE '計測・分析' END || '</a><span>›</span>この記事</p>' || substr(h, instr(h, '<br><p>') + 7) AS b FROM r),
    c AS (SELECT *, substr(b, 1, instr(b, '</article>') - 1) || '<hr>' || substr(b, instr(b, '</article>') + 10) AS e FROM a)
    SELECT page_id::VARCHAR AS slug, reason AS skip_reason, CASE WHEN reason IS NULL THEN md5(substr(e, 1, instr(e, '</body>') - 1) || '<hr>' || substr(e, instr(e, '</body>') + 7)) END AS page FROM c""")
def migrated_pages(spark, d):
    return _migrated(spark, d).select("slug", "skip_reason", F.md5(F.col("html").cast("binary")).alias("page"))


def _migrated(spark, d):
    html = F.col("html")
    for lang, theme in (("en", "visibility"), ("fr", "measurement")):
        html = F.replace(html, F.lit(f'<html lang="{lang}"'), F.lit(f'<html class="cat theme-{theme}"'))
    pages = _t(spark, d, "pages").select(F.col("page_id").cast("string").alias("slug"), html.alias("html"))
    return M.migrate(pages, [(_OLD[0], "<hr>"), (_OLD[1], "<hr>")], _OLD[2], "s")


@query("""SELECT count(*) FILTER (ok) AS migrated, count(*) FILTER (NOT ok) AS skipped FROM (
    SELECT contains(html, '</article>') AND contains(html, '<br><p>') AND contains(html, '</body>') AND regexp_matches(html, '<html lang="(en|fr)"') AS ok FROM pages)""")
def migration_report(spark, d):
    return M.report(_migrated(spark, d))


_SITE_NAME = r"://(?:(?:www|m|blog)\.)?([^./]+)\."


def _sites(spark, d):
    """Of every site of the pages: its name, number of pages, and its front page, the one with the smallest id."""
    name = F.regexp_extract("url", _SITE_NAME, 1).alias("slug")
    front = [F.min_by(c, "page_id").alias(c) for c in ("url", "html")]
    return _t(spark, d, "pages").groupBy(name).agg(F.count("*").alias("n"), *front)


_SITES = f"SELECT regexp_extract(url, '{_SITE_NAME}', 1) AS slug, count(*) AS n, arg_min(url, page_id) AS url, arg_min(html, page_id) AS html FROM pages GROUP BY 1"


@query(f"""SELECT slug, md5(CASE WHEN contains(html, '</article>') AND contains(html, '<br><p>') AND theme <> '' THEN
        regexp_replace(replace(html, '</article>', '<hr>'), '<br><p>', '<p class="crumb"><a href="{SITE}">トップ</a><span>›</span><a href="{SITE}?theme=' || theme || '">'
            || CASE theme WHEN 'visibility' THEN '検索結果・購買導線の変化' ELSE '計測・分析' END || '</a><span>›</span>この記事</p>')
        ELSE html END) AS page FROM (SELECT slug, h AS html, regexp_extract(h, 'class="cat theme-(visibility|measurement)"', 1) AS theme FROM (
    SELECT slug, replace(replace(html, '<html lang="en"', '<html class="cat theme-visibility"'), '<html lang="fr"', '<html class="cat theme-measurement"') AS h FROM ({_SITES})))""")
def pages_migrated_in_place(spark, d):
    """A folder with a file for the front page of every site, migrated in place, and read again: changed pages and those left as they were."""
    html = F.col("html")
    for lang, theme in (("en", "visibility"), ("fr", "measurement")):
        html = F.replace(html, F.lit(f'<html lang="{lang}"'), F.lit(f'<html class="cat theme-{theme}"'))
    folder = scratch.folder(spark, "site")
    with Changes(Store(spark), folder) as change:
        change.files_by_key(_sites(spark, d).select("slug", html.alias("html")), folder, "slug", "html", ".html")
    pipelines.migrate(spark, folder, [(_OLD[0], "<hr>")], _OLD[2], SITE)
    return readers.pages(spark, folder).select("slug", F.md5(F.col("html").cast("binary")).alias("page"))


@query(f"""SELECT (row_number() OVER (ORDER BY slug DESC) - 1)::INT AS pos, slug, url AS "sourceUrl", {_TITLE} AS title, n || ' pages' AS background,
    (row_number() OVER (ORDER BY slug DESC) - 1)::INT AS url_pos FROM ({_SITES})""")
def published_catalog(spark, d):
    """An article on every site, from a batch file to drafts, and from drafts to published pages, catalog and URL list, which are read again."""
    folder, said = scratch.folder(spark, "articles"), F.concat(F.col("n").cast("string"), F.lit(" pages"))
    fixed = {"date": "2024-02-01", "dateDisplay": "2024年2月1日", "viewpoint": "seller", "theme": "visibility", "thumbnail": "t.png", "meaning": "<so>"}
    rows = _sites(spark, d).select(
        "slug", D.page_title(F.col("html")).alias("title"), F.col("url").alias("sourceUrl"), X.url_host(F.col("url")).alias("source"), said.alias("background"),
        F.array(F.lit("google")).alias("platforms"), F.array(said).alias("bullets"), F.array(*map(F.lit, "abc")).alias("cardBullets"),
        *[F.lit(v).alias(k) for k, v in fixed.items()],
    )
    batch = rows.agg(F.to_json(F.sort_array(F.collect_list(F.struct(*rows.columns)))).alias("value"))
    batch.coalesce(1).write.text(f"{folder}/batch")  # one file by its format
    pipelines.build(spark, f"{folder}/batch", f"{folder}/draft", f"{folder}/meta", SITE)
    slugs = sorted(r.slug for r in readers.metas(spark, f"{folder}/meta").select("slug").collect())  # as a command line has them
    store, site = Store(spark), f"{folder}/site"
    store.write(f"{site}/articles.json", '{"updatedAt": "2024-01-01", "articles": []}')
    pipelines.promote(spark, slugs, f"{folder}/draft", f"{folder}/meta", site, f"{site}/articles.json", f"{site}/urls.md", "2024-02-01")
    catalog = readers.catalog_articles(readers.catalog(spark, f"{site}/articles.json")).select("pos", "slug", "sourceUrl")
    shown = D.extract(readers.pages(spark, site)).select("slug", "title", "background", F.col("source_url").alias("shown"))
    listed = readers.url_list(spark, f"{site}/urls.md").select(F.col("url").alias("sourceUrl"), F.col("pos").cast("int").alias("url_pos"))
    both = catalog.join(shown, "slug").filter("shown = sourceUrl").join(listed, "sourceUrl")
    return both.select("pos", "slug", "sourceUrl", "title", "background", "url_pos")


@query(rf"""WITH p AS (SELECT *, regexp_extract(url, '{_SITE_NAME}', 1) AS slug, {_TITLE} AS title, coalesce(nullif(regexp_extract(html, '<html lang="([a-z]+)"', 1), ''), '') AS lang,
        regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages),
    k AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY page_id) - 1 AS k FROM p)
    SELECT slug, k // 15 AS batch, 'new:' || chr(10) || string_agg(k % 15 + 1 || '. *' || title || '*' || chr(10) || '   google/' || lang || ' / seller /  / ' || host || ' / '
        || chr(10) || '   下書き: {SITE}/' || page_id || '.html', chr(10) ORDER BY k) AS text FROM k GROUP BY slug, k // 15""")
def site_notifications(spark, d):
    """Messages on the pages of every site, as many to a message as a run may make, numbered anew in each."""
    rows = _t(spark, d, "pages").select(
        F.regexp_extract("url", _SITE_NAME, 1).alias("slug"), F.col("page_id").alias("pos"), D.page_title(F.col("html")).alias("title"),
        F.array(F.lit("google"), D.page_lang(F.col("html"))).alias("platforms"), F.lit("seller").alias("viewpoint"), F.lit(None).cast("string").alias("theme"),
        X.url_host(F.col("url")).alias("source"), F.lit(None).cast("string").alias("date"),
        F.concat(F.lit(f"{SITE}/"), F.col("page_id").cast("string"), F.lit(".html")).alias("draft_url"),
    )
    cut = C.numbered(rows, "pos", ("slug",), "k").withColumn("batch", F.expr(f"(k - 1) DIV {runs.quotas(10)[1]}")).drop("k")
    return C.notification(cut, "new:\n", ("slug", "batch"))


@query(f"""SELECT page_id::VARCHAR AS slug, '{{' || chr(10) || '  "slug": "' || page_id || '",' || chr(10) || '  "title": ' || to_json({_TITLE}) || ',' || chr(10)
    || CASE WHEN page_id % 2 = 0 THEN '  "origTitle": ' || to_json('<' || {_TITLE} || '> & "''') || ',' || chr(10) ELSE '' END
    || '  "bullets": ' || CASE WHEN len(b) = 0 THEN '[]' ELSE '[' || chr(10) || array_to_string(list_transform(b, lambda x: '    ' || to_json(x)), ',' || chr(10)) || chr(10) || '  ]' END
    || chr(10) || '}}' || chr(10) AS text FROM (SELECT *, {_LINKS} AS b FROM pages)""")
def pretty_json(spark, d):
    """Records as they are written to files of metadata: indented JSON without null fields."""
    return sinks.json_texts(_articles(spark, d).select("slug", "title", "origTitle", "bullets"), "slug")


def _event_lines(spark, d, rows=None):
    """Lines of agent logs, one run per user: results, tool calls, texts, failure marks and lines that are no events."""
    rows = _t(spark, d, "events") if rows is None else rows
    i = F.col("event_id")
    kind = F.col("event_type")
    tool = F.struct(F.lit("tool_use").alias("type"), F.lit("bASH").alias("name"), F.struct(F.lit("").alias("description"), F.col("props").alias("command")).alias("input"))
    said = F.struct(F.lit("text").alias("type"), F.concat(F.lit("　 "), kind, F.lit(" \n")).alias("text"))
    result = F.struct(
        F.lit("result").alias("type"), (i % 9).alias("num_turns"), (i % 20 * 500).alias("duration_ms"), (i % 15 == 0).alias("is_error"),
        F.concat(F.lit("resets "), (i % 12 + 1).cast("string"), F.lit("pm")).alias("result"),
    )
    message = lambda content: F.struct(F.lit("assistant").alias("type"), F.struct(F.array(content).alias("content")).alias("message"))
    value = (
        F.when(i % 5 == 0, F.to_json(result)).when(i % 5 == 1, F.to_json(message(tool))).when(i % 5 == 2, F.to_json(message(said)))
        .when(i % 35 == 3, F.concat(F.lit("x NIGHTLY_RESEARCH_FAILED: "), kind)).otherwise("no event")
    )
    return rows.select("user_id", i.alias("pos"), value.alias("value"), *(["at"] if "at" in rows.columns else []))


@query(r"""SELECT event_id AS pos, 0 AS block, CASE event_id % 5
        WHEN 0 THEN '処理完了。ターン数: ' || event_id % 9 || ' / 所要時間: ' || round_even(event_id % 20 * 500 / 1000.0, 0)::BIGINT || '秒'
        WHEN 1 THEN '  → コマンド実行' || CASE WHEN length(' - ' || props) > 100 THEN substr(' - ' || props, 1, 100) || '...' ELSE ' - ' || props END
        ELSE '  💬 ' || event_type END AS line FROM events WHERE event_id % 5 < 3""")
def event_summary_lines(spark, d):
    return E.summary_lines(_event_lines(spark, d).drop("user_id"))


@query("""SELECT conv_id, turn, '  💬 ' || CASE WHEN length(s) > 200 THEN substr(s, 1, 200) || '...' ELSE s END AS line
    FROM (SELECT *, trim(text, chr(32) || chr(9) || chr(10) || chr(13) || chr(160) || chr(12288)) AS s FROM conversations WHERE role = 'assistant') WHERE s <> ''""")
def conversation_summary_lines(spark, d):
    content = F.array(F.struct(F.lit("text").alias("type"), F.col("text")))
    value = F.to_json(F.struct(F.col("role").alias("type"), F.struct(content.alias("content")).alias("message")))
    return E.summary_lines(_t(spark, d, "conversations").select("conv_id", "turn", value.alias("value"))).drop("block")


@query("""SELECT event_id AS pos, (event_id % 9)::INT AS num_turns, (event_id % 20 * 500)::BIGINT AS duration_ms FROM events WHERE event_id % 5 = 0""")
def parsed_results(spark, d):
    found = readers.events(_event_lines(spark, d)).filter("event.type = 'result'")
    return found.select("pos", "event.num_turns", "event.duration_ms")


@query("""SELECT user_id, max(event_id) AS pos, arg_max(event_id % 15 = 0, event_id) AS is_error, arg_max('resets ' || event_id % 12 + 1 || 'pm', event_id) AS result
    FROM events WHERE event_id % 5 = 0 GROUP BY user_id""")
def last_result_per_user(spark, d):
    return E.last_result(_event_lines(spark, d), ("user_id",))


@query("""WITH u AS (SELECT user_id, arg_max(event_id % 15 = 0, event_id) FILTER (event_id % 5 = 0) AS err, arg_max('resets ' || (event_id % 12 + 1) || 'pm', event_id) FILTER (event_id % 5 = 0) AS result,
        arg_max((event_id % 12 + 1) % 12, event_id) FILTER (event_id % 5 = 0) AS hour, arg_min(event_type, event_id) FILTER (event_id % 35 = 3) AS mark FROM events GROUP BY user_id),
    o AS (SELECT *, coalesce(err, false) OR mark IS NOT NULL AS failed FROM u)
    SELECT user_id, failed, CASE WHEN err THEN 'error: ' || result ELSE coalesce(mark, '') END AS reason, result AS error_text,
        CASE WHEN failed AND hour IS NOT NULL THEN TIMESTAMP '2024-01-31 00:05:00' + to_hours((hour + 12)::INT) + CASE WHEN hour + 12 > 18 OR hour + 12 = 18 THEN INTERVAL 0 DAY ELSE INTERVAL 1 DAY END END AS retry_at FROM o""")
def run_outcomes(spark, d):
    """Outcome of each user's run, and when to try again after half past six in the evening's start."""
    done = E.run_outcome(_event_lines(spark, d), 0, ("user_id",))
    return E.retry_at(done, "2024-01-31 18:04:00").withColumn("retry_at", F.col("retry_at").cast("timestamp_ntz"))


@query(r"""SELECT doc_id AS pos, '  → コマンド実行' || CASE WHEN coalesce(text, '') = '' THEN '' WHEN length(' - ' || text) > 100 THEN substr(' - ' || text, 1, 100) || '...' ELSE ' - ' || text END AS line FROM documents""")
def document_tool_lines(spark, d):
    """Summary lines of tool calls with whole documents as their commands, most of them cut."""
    block = F.struct(F.lit("tool_use").alias("type"), F.lit("Bash").alias("name"), F.struct(F.col("text").alias("command")).alias("input"))
    value = F.to_json(F.struct(F.lit("assistant").alias("type"), F.struct(F.array(block).alias("content")).alias("message")))
    return E.summary_lines(_t(spark, d, "documents").select(F.col("doc_id").alias("pos"), value.alias("value"))).drop("block")


@query("""SELECT user_id, count(*) AS n, count(*) FILTER (event_id % 5 >= 3) AS dropped FROM events GROUP BY user_id""")
def dropped_lines(spark, d):
    """Lines of each user's run, and those among them that are no events."""
    return readers.line_counts(_event_lines(spark, d), ("user_id",))


@query("SELECT event_id AS pos, (event_id % 9)::INT AS num_turns FROM events WHERE event_id % 5 = 0")
def captured_results(spark, d):
    """Result events of a captured log that is written as text files and read back."""
    path = scratch.folder(spark, "captured")
    _event_lines(spark, d).select(F.concat(F.col("pos").cast("string"), F.lit("\t"), F.col("value")).alias("value")).write.text(path)
    cut = F.split("value", "\t", 2)
    lines = readers.lines(spark, path).select(cut[0].cast("long").alias("pos"), cut[1].alias("value"))
    return readers.events(lines).filter("event.type = 'result'").select("pos", "event.num_turns")


@query("SELECT user_id, event_id AS pos FROM events")
def raw_lines_kept_once(spark, d):
    """The raw table of a run whose first batch was written twice, the second time after the second batch."""
    lines, table = _event_lines(spark, d), scratch.folder(spark, "raw")
    early = F.col("pos") < 1000
    for k, part in ((0, lines.filter(early)), (1, lines.filter(~early)), (0, lines.filter(early))):
        sinks.keep_raw(part, table, "run", k)
    return spark.read.parquet(table).select("user_id", "pos")


_NOTICES = """SELECT user_id::VARCHAR AS key, strftime(last, '%Y-%m-%d') AS last_run_date, strftime(today, '%Y-%m-%d') AS today, (today - last - 1)::INT AS missed
    FROM (SELECT user_id, last, CASE WHEN day - last > 1 THEN day ELSE day + 3 END AS today FROM (
        SELECT user_id, day, lag(day) OVER (PARTITION BY user_id ORDER BY day) AS last FROM (SELECT DISTINCT user_id, ts::DATE AS day FROM events))) WHERE last IS NOT NULL"""


def _checks(spark, d, later=0):
    """A check of every user at every event, or some days later: the day with events before is the last run."""
    days = _t(spark, d, "events").select("user_id", F.to_date("ts").alias("day"))
    last = days.distinct().withColumn("last", F.lag("day").over(Window.partitionBy("user_id").orderBy("day")))
    text = lambda c: F.date_format(c, "yyyy-MM-dd")
    return days.join(last, ["user_id", "day"]).select(
        F.col("user_id").cast("string").alias("key"), text("last").alias("last_run_date"), text(F.date_add("day", later)).alias("today")
    )


@query(_NOTICES)
def run_notices(spark, d):
    """Missed days of every user, once for each day before them, though every event shows them, and again three days later."""
    return runs.notices(_checks(spark, d).unionByName(_checks(spark, d, 3))).select("key", "last_run_date", "today", "missed")


@query(_NOTICES)
def streamed_notices(spark, d):
    """The same from a stream with state, stopped after the checks of the days and started again for the later ones."""
    folder = scratch.folder(spark, "notices")
    for later in (0, 3):
        _checks(spark, d, later).write.mode("append").parquet(f"{folder}/checks")
        checks = spark.readStream.schema("key string, last_run_date string, today string").parquet(f"{folder}/checks")
        out = state.notices(checks).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
        out.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@query("""SELECT user_id::VARCHAR AS run, max(event_id) AS pos, arg_max(event_id % 15 = 0, event_id) AS is_error, arg_max('resets ' || event_id % 12 + 1 || 'pm', event_id) AS result
    FROM events WHERE event_id % 5 = 0 GROUP BY user_id""")
def streamed_last_results(spark, d):
    """The last result of each user's run as a stream of the table leaves it: the newest row of every run's updates."""
    folder = scratch.folder(spark, "results")
    rows = spark.readStream.schema(_t(spark, d, "events").schema).parquet(f"{d}/events.[p]arquet")  # a pattern, since the table may be one file
    rows = rows.withColumn("at", F.col("ts").cast("timestamp"))
    lines = _event_lines(spark, d, rows).select(F.col("user_id").alias("run"), F.col("at").alias("ts"), "pos", "value")

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    query = state.last_results(lines).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{folder}/state")
    query.trigger(availableNow=True).start().awaitTermination()
    done = spark.read.schema("run string, pos long, is_error boolean, result string, closed boolean, batch int").parquet(f"{folder}/out")
    newest = done.groupBy("run").agg(F.max_by(F.struct("pos", "is_error", "result"), F.struct("batch", "pos")).alias("r"))
    return newest.select("run", "r.*")


@query("""SELECT event_id, event_id % 11 < 2 AS ends FROM events""")
def terminal_lines(spark, d):
    i = F.col("event_id")
    line = F.when(i % 11 == 0, "自動リサーチが完了しました").when(i % 11 == 1, F.concat(F.lit("[09:00:00] 失敗: "), F.col("props"))).otherwise(F.concat(F.lit(" 失敗: "), F.col("event_type")))
    return _t(spark, d, "events").select("event_id", E.terminal(line).alias("ends"))


@query("""SELECT user_id, date_diff('day', last, DATE '2024-02-02') - 1 AS missed FROM (
    SELECT user_id, max(ts)::DATE AS last, max(ts) FILTER (event_type = 'error')::DATE AS notified FROM events GROUP BY user_id) WHERE last < DATE '2024-02-01' AND last IS DISTINCT FROM notified""")
def due_notices(spark, d):
    """Users by their last day with an event; those whose last day had an error were notified of it."""
    day = F.date_format("ts", "yyyy-MM-dd")
    error = F.when(F.col("event_type") == "error", day)
    state = _t(spark, d, "events").groupBy("user_id").agg(F.max(day).alias("last_run_date"), F.max(error).alias("notified_date"))
    return runs.due_notice(state.withColumn("today", F.lit("2024-02-02"))).select("user_id", F.col("missed").cast("long"))


@query("SELECT event_id, CASE WHEN event_id % 3 < 2 THEN ts::DATE END AS day FROM events")
def display_dates(spark, d):
    i = F.col("event_id")
    shown = F.when(i % 3 == 0, F.date_format("ts", "yyyy年M月d日")).when(i % 3 == 1, F.date_format("ts", "yyyy/MM/dd")).otherwise(F.date_format("ts", "dd.MM.yyyy"))
    return _t(spark, d, "events").select("event_id", T.display_date(shown).alias("day"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 10 ELSE (event_id % 500)::INT END AS n, upper(event_type) AS answer,
    CASE WHEN event_id % 4 = 0 THEN '既定' ELSE event_type END AS option FROM events""")
def given_answers(spark, d):
    """Numbers with a default, answers to a question, options with a label for none."""
    i, kind = F.col("event_id"), F.col("event_type")
    number = F.when(i % 3 == 0, kind).otherwise((i % 500).cast("string"))
    return _t(spark, d, "events").select(
        "event_id", X.whole_number(number).alias("n"), X.answer(F.concat(F.lit(" "), kind, F.lit("　"))).alias("answer"),
        X.or_default(F.when(i % 4 != 0, kind)).alias("option"),
    )


@query(f"SELECT page_id, array_to_string({_LINKS}, '・') AS links FROM pages")
def joined_links(spark, d):
    return _t(spark, d, "pages").select("page_id", X.joined(D.page_links(F.col("html")), "・").alias("links"))


@query("""SELECT event_id, ceil(date_diff('second', ts, TIMESTAMP '2024-02-01 00:00:00') / 60.0)::BIGINT AS left_minutes,
    round_even(date_diff('second', TIMESTAMP '2023-12-31 00:00:00', ts) / 60.0, 1)::DOUBLE AS since, strftime(ts, '%Y-%m-%d %H:%M:%S') AS log, strftime(ts, '%H:%M:%S') AS line,
    strftime(ts, '%Y%m%d-%H%M%S') AS file, (ts - INTERVAL 9 HOUR)::DATE AS utc_day, ceil(event_id % 50 * 1.5)::BIGINT AS most,
    round_even(event_id % 20 * 500 / 1000.0, 0)::BIGINT AS seconds FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)""")
def event_clock(spark, d):
    """Minutes, time stamps, the UTC day of a wall clock in Tokyo, quotas and seconds."""
    rows = _t(spark, d, "events").select("event_id", F.date_trunc("second", F.col("ts").cast("timestamp")).alias("ts"))
    at = lambda s: F.lit(s).cast("timestamp")
    ts, i = F.col("ts"), F.col("event_id")
    return rows.select(
        "event_id", T.minutes_left(ts, at("2024-02-01 00:00:00")).alias("left_minutes"), T.minutes_since(at("2023-12-31 00:00:00"), ts).alias("since"),
        *[T.stamp(ts, k).alias(k) for k in ("log", "line", "file")], T.utc_day(ts, "Asia/Tokyo").alias("utc_day"),
        T.most_items(i % 50).alias("most"), T.seconds(i % 20 * 500).alias("seconds"),
    )


def _candidates(spark, d):
    """Results of a search over the pages' URLs, written as JSON lines and read as such."""
    i, folder = F.col("page_id"), scratch.folder(spark, "candidates")
    _t(spark, d, "pages").select(
        "url", F.when(i % 5 == 0, 404).otherwise(200).alias("status"),
        F.when(i % 3 == 0, "Same-Site").when(i % 3 == 1, "cross-origin").alias("corp_header"),
        F.date_add(F.lit("2024-01-01").cast("date"), (i % 40).cast("int")).alias("published"),
    ).write.json(folder)
    return readers.candidates(spark, folder)


_USABLE = """SELECT url, published FROM (SELECT url, page_id, DATE '2024-01-01' + (page_id % 40)::INT AS published FROM pages)
    WHERE page_id % 5 <> 0 AND page_id % 3 <> 0 AND published >= DATE '2024-01-29'"""


@query(_USABLE)
def usable_candidates(spark, d):
    return C.usable(_candidates(spark, d), "2024-02-05").select("url", "published")


@query(f"{_USABLE} ORDER BY published DESC, url LIMIT 6")
def candidates_within_quota(spark, d):
    """As many as a run with a target of four may take."""
    return runs.within_quota(C.usable(_candidates(spark, d), "2024-02-05"), 4, F.desc("published"), "url").select("url", "published")


@query(f"""SELECT page_id::VARCHAR AS slug, s AS related_slug FROM (SELECT page_id, unnest([replace({_LINKS}[1], '/', ''), (2 * page_id + 1)::VARCHAR]) AS s FROM pages)
    WHERE s NOT IN (SELECT page_id::VARCHAR FROM pages)""")
def unresolved_links(spark, d):
    return C.unresolved_links(_articles(spark, d).select("slug", "related"))


@query("SELECT doc_id, -quality AS pos, source FROM labels JOIN documents USING (doc_id)")
def rows_in_list_order(spark, d):
    asked = _t(spark, d, "labels").select(F.col("doc_id").alias("slug"), (-F.col("quality")).alias("pos"))
    return C.in_list_order(asked, _t(spark, d, "documents").withColumnRenamed("doc_id", "slug")).select(F.col("slug").alias("doc_id"), "pos", "source")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def rejected_documents(spark, d):
    bad = _t(spark, d, "labels").filter("toxic = 1").select(F.col("doc_id").alias("slug"))
    return C.rejected(_t(spark, d, "documents").select(F.col("doc_id").alias("slug")), bad).select(F.col("slug").alias("doc_id"))


@query("SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) OR doc_id IN (SELECT conv_id FROM conversations) AS existed FROM documents")
def existing_slugs(spark, d):
    asked = _t(spark, d, "documents").select(F.col("doc_id").alias("pos"), F.col("doc_id").alias("slug"))
    tables = [_t(spark, d, t).select(F.col(c).alias("slug")) for t, c in (("labels", "doc_id"), ("conversations", "conv_id"))]
    return C.existed(asked, *tables).select(F.col("slug").alias("doc_id"), "existed")


@query("""SELECT lang || doc_id AS name FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def new_file_names(spark, d):
    """Names that were not there before, when they were written in capitals."""
    docs = _t(spark, d, "documents").select("doc_id", F.concat("lang", F.col("doc_id").cast("string")).alias("name"))
    before = docs.join(_t(spark, d, "labels"), "doc_id").select(F.upper("name").alias("name"))
    return C.new_files(docs.select("name"), before)


@query("""SELECT doc_id AS pos, 'articles-batch-' || lang || '.json' AS name FROM documents WHERE doc_id % 4 = 1""")
def stale_batches(spark, d):
    i = F.col("doc_id")
    name = F.concat(F.lit("automation/articles-batch-"), F.col("lang"), F.lit(".json"))
    line = F.when(i % 4 == 1, F.concat(F.lit("?? "), name)).when(i % 4 == 2, F.concat(F.lit(" M "), name)).otherwise("?? automation/other.json")
    return C.stale_batches(_t(spark, d, "documents").select(i.alias("pos"), line.alias("line")))


@query("""SELECT conv_id AS path, turn AS pos, text AS value FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 2""")
def last_lines(spark, d):
    rows = _t(spark, d, "conversations").select(F.col("conv_id").alias("path"), F.col("turn").alias("pos"), F.col("text").alias("value"))
    return readers.last_lines(rows, 2)


@query("SELECT page_id, ['visibility', 'optimization', 'measurement'][(page_id % 4)::INT + 1] AS theme FROM pages")
def page_themes(spark, d):
    html = F.concat(F.lit('<i class="cat theme-'), F.col("theme"), F.lit('">'))
    return _articles(spark, d).select(F.col("pos").alias("page_id"), X.html_theme(html).alias("theme"))


@query("""SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL""")
def hourly_counts(spark, d):
    """The windowed counts of the stream, over the table."""
    rows = _t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return summary.windowed_counts(rows).select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n")


@query("""SELECT source, count(*) AS n, count(*) FILTER (lang <> 'en') AS n_foreign, bool_and(quality = 1) AS all_ok FROM documents JOIN labels USING (doc_id) GROUP BY source""")
def final_report(spark, d):
    rows = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id")
    return runs.final_report(rows.select("source", (F.col("lang") != "en").alias("is_foreign"), (F.col("quality") == 1).alias("ok")), ("source",))


@query("SELECT DISTINCT user_id AS pid FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def live_processes(spark, d):
    pids = _t(spark, d, "events").select(F.col("user_id").alias("pid")).distinct()
    return runs.alive(pids, _t(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("pid")))


@query("""SELECT doc_id, replace(replace('{{MIN_COUNT}} to {{max_count}} of ' || source, '{{MIN_COUNT}}', '7'), '{{max_count}}', '11') AS value FROM documents""")
def filled_prompts(spark, d):
    text = F.concat(F.lit("{{MIN_COUNT}} to {{max_count}} of "), F.col("source"))
    return runs.prompt(_t(spark, d, "documents").select("doc_id", text.alias("value")), 7)


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'コマンド実行' WHEN 1 THEN 'Web検索' ELSE 'other' END AS label FROM events")
def tool_labels(spark, d):
    name = F.get(F.array(F.lit("BASH"), F.lit("webSearch"), F.lit("other")), (F.col("event_id") % 3).cast("int"))
    return _t(spark, d, "events").select("event_id", X.lookup(TOOL_LABEL, name, fold=True).alias("label"))


@query("SELECT event_id, CASE event_id % 4 WHEN 1 THEN 'low' WHEN 2 THEN 'high' ELSE '' END AS effort FROM events")
def menu_choices(spark, d):
    code = F.concat(F.lit(" "), (F.col("event_id") % 4).cast("string"))
    return _t(spark, d, "events").select("event_id", X.menu({"1": "low", "2": "high"}, code).alias("effort"))


@query("SELECT conv_id, string_agg(turn || ' ' || role, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def ordered_texts(spark, d):
    line = F.concat_ws(" ", F.col("turn").cast("string"), "role")
    return C.text_of(_t(spark, d, "conversations"), line, order="turn", keys=("conv_id",))


__all__ = ["ORACLE_SQL", "QUERIES"]
