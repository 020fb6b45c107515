"""End-to-end plans: build, promote, reject, notify, migrate, summarise, missed run.

Checks run on all inputs before the first side effect, unlike a loop that would stop half-way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.documents import render
from ..functions.text import promote_links
from ..operators import catalog as C
from ..operators import events, runs, validate
from ..operators import migrate as M
from ..sources import readers, sinks
from ..sources.changes import Changes, recover
from ..sources.storage import Store


def build(spark: SparkSession, path: str, drafts: str, metas: str, site: str) -> tuple[int, list[str]]:
    """Batch file to drafts and metadata; returns the number of records and slugs without digits."""
    batch = readers.batch(spark, path).cache()
    validate.strict(batch)
    warned = [r.slug for r in validate.without_digits(batch).orderBy("pos").collect()]
    last = batch.groupBy("slug").agg(F.max("pos").alias("pos"))  # of a slug named twice the last record counts
    rows = batch.join(last, ["slug", "pos"], "left_semi")
    store = Store(spark)
    recover(store, drafts)
    with Changes(store, drafts) as change:
        change.files_by_key(render(rows, site), drafts, "slug", "html", ".html")
        change.files_by_key(sinks.json_texts(C.to_meta(rows, site), "slug"), metas, "slug", "text", ".json")
    return batch.count(), warned


def promote(spark: SparkSession, slugs: Sequence[str], drafts: str, metas: str, published: str, catalog: str, url_list: str, today: str, head: str = "") -> int:
    """Move drafts to the published pages, put them in front of the catalog, renew the URL list: all of it or nothing."""
    store = Store(spark)
    recover(store, published)
    asked = readers.arguments(spark, slugs)
    have, meta = readers.pages(spark, drafts), readers.metas(spark, metas)
    old = readers.catalog_articles(readers.catalog(spark, catalog))
    bad = validate.promotable(asked, have, meta, old).orderBy("pos").collect()
    if bad:
        raise ValueError("; ".join(f"{r.slug}: {r.problem}" for r in bad))
    pages = C.in_list_order(asked, have).select("slug", promote_links(F.col("html")).alias("html"))
    rows = C.prepend(C.in_list_order(asked, meta), old).cache()
    [new] = C.as_catalog(rows, today).collect()  # the catalog is one file by its format
    with Changes(store, published) as change:
        change.files_by_key(pages, published, "slug", "html", ".html")
        change.put(catalog, sinks.pretty(new.asDict(recursive=True)))
        change.put(url_list, sinks.ordered_lines(C.url_lines(rows), "pos", head=head))
        for s in slugs:
            change.delete(f"{drafts}/{s}.html")
            change.delete(f"{metas}/{s}.json")
    return len(slugs)


def reject(spark: SparkSession, slugs: Sequence[str], drafts: str, metas: str) -> dict[str, bool]:
    """Delete drafts with their metadata, all of them or none; says of each slug whether anything was there."""
    if not slugs:
        raise ValueError("usage: at least one slug")
    store, there = Store(spark), {}
    recover(store, drafts)
    with Changes(store, drafts) as change:
        for s in dict.fromkeys(slugs):
            files = [f"{drafts}/{s}.html", f"{metas}/{s}.json"]
            there[s] = any(map(store.exists, files))
            for f in files:
                change.delete(f)
    return there


def notify(spark: SparkSession, slugs: Sequence[str], drafts: str, metas: str, draft_site: str, url: str, send: sinks.Transport, head: str = "") -> int:
    """Send the numbered message on drafts; 0 if it was taken."""
    asked, meta = readers.arguments(spark, slugs), readers.metas(spark, metas)
    lost = asked.join(readers.pages(spark, drafts), "slug", "left_anti").union(asked.join(meta, "slug", "left_anti"))
    if bad := lost.take(5):
        raise ValueError(f"no draft: {', '.join(r.slug for r in bad)}")
    rows = C.in_list_order(asked, meta).withColumn("draft_url", C.page_url(draft_site))
    return sinks.notify(send, url, C.notification(rows, head).first().text)


def migrate(spark: SparkSession, folder: str, blocks: list[tuple[str, str]], old_crumb: str, site: str, out: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rewrite the pages of a folder that match, in place and all at once, or write them to another folder.

    Returns the numbers of migrated and skipped pages, and the skipped ones. New pages are written beside the old ones
    before any is replaced, so Spark never overwrites what it reads.
    """
    store, out = Store(spark), out or folder
    recover(store, out)
    done = M.migrate(readers.pages(spark, folder), blocks, old_crumb, site).cache()
    done.count()  # read before a page is replaced; the reports below are of the old pages
    with Changes(store, out) as change:
        change.files_by_key(done.filter("skip_reason IS NULL"), out, "slug", "html", ".html")
    return M.report(done), M.skipped(done)


def summarise(spark: SparkSession, path: str, exit_code: int, now: str, no_retry: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Summary lines of a captured run, in order, its outcome with the time to retry, and its lines with those that are no events."""
    lines = readers.lines(spark, path)
    outcome = events.retry_at(events.run_outcome(lines, exit_code), now, no_retry)
    return events.summary_lines(lines).orderBy("pos", "block"), outcome, readers.line_counts(lines)


def missed_run(spark: SparkSession, folder: str, today: str, url: str | None, send: sinks.Transport) -> int | None:
    """Report missed days once per last run; returns their number. State cells: last-run, notified in ``folder``."""
    last, notified = (readers.cell_text(f"{folder}/{name}") for name in ("last-run", "notified"))
    state = spark.createDataFrame([(last, notified, today)], "last_run_date string, notified_date string, today string")
    due = runs.due_notice(state).first()
    if due is None:
        return None
    sinks.alert(send, url, f"{due.missed} days without a run (last run: {last})")
    sinks.put(f"{folder}/notified", last)
    return due.missed
