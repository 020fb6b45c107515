"""Functions, operators and plans of the core package on small records."""

import json
import os

import pytest
from pyspark.sql import functions as F

from inkwell import schemas as S
from inkwell.functions import documents as D
from inkwell.functions import text as X
from inkwell.functions import times as T
from inkwell.operators import catalog as C
from inkwell.operators import events as E
from inkwell.operators import runs, validate
from inkwell.plans import pipelines as P
from inkwell.sources import readers, sinks
from inkwell.streaming import summary

SITE = "https://site.example/media"


def article(slug, **more):
    return {
        "slug": slug, "title": f"Title <{slug}> & 'more'", "origTitle": None, "sourceUrl": f"https://s.example/{slug}?a=1&b=2", "source": "新聞",
        "date": "2026-09-01", "dateDisplay": "2026年9月1日", "platforms": ["google", "x", "other-ai"], "viewpoint": "seller", "theme": "measurement",
        "thumbnail": "https://s.example/t.png", "background": 'say "hi"', "bullets": ["一つ1", "二つ & more"], "cardBullets": ["a", "b", "c"],
        "meaning": "why", "related": [{"slug": "gone", "title": "R & D"}],
    } | more


def frame(spark, rows):
    return spark.createDataFrame([(k, *[r.get(c.split(" ")[0]) for c in S.ARTICLE.split(", ")]) for k, r in enumerate(rows)], f"pos int, {S.ARTICLE}")


def value(spark, column, **given):
    kinds = {int: "int", str: "string", float: "double", list: "array<string>"}
    row = spark.createDataFrame([tuple(given.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in given.items()))
    return row.select(column.alias("v")).first().v


def test_text_functions(spark):
    c = F.col("s")
    assert value(spark, X.escape_html(c), s="<a href=\"x\">'&amp;") == "&lt;a href=&quot;x&quot;&gt;&#39;&amp;amp;"
    assert value(spark, X.unescape_html(X.escape_html(c)), s="&lt; & <") == "&lt; & <"
    assert [value(spark, X.width(c), s=s) for s in ("aあ1", "ｱ", "😀", "")] == [2.0, 1.0, 1.0, 0.0]
    assert [value(spark, X.has_digit(c), s=s) for s in ("a1", "９", "三")] == [True, True, False]
    assert value(spark, X.strip(c), s="　\n a b \t　") == "a b"
    assert value(spark, F.length(X.truncate(c, 100)), s="x" * 101) == 103
    assert value(spark, X.truncate(c, 100), s="x" * 100) == "x" * 100
    assert value(spark, X.joined(F.col("a"), "/"), a=["x", None, "y"]) == "x//y"
    assert value(spark, X.replace_first(c, F.lit("b"), F.lit("$1")), s="abcb") == "a$1cb"
    assert value(spark, X.replace_first(c, F.lit("z"), F.lit("q")), s="abcb") == "abcb"
    assert value(spark, X.html_theme(c), s='<span class="cat theme-visibility">') == "visibility"
    assert value(spark, X.html_theme(c), s="none") is None
    assert value(spark, X.lookup(S.TOOL_LABEL, c, fold=True), s="bASH") == "コマンド実行"
    assert value(spark, X.lookup(S.PLATFORM_LABEL, c), s="GOOGLE") == "GOOGLE"
    assert value(spark, X.first_present(c, F.lit("b")), s="") == "b"
    assert [value(spark, X.whole_number(c), s=s) for s in ("12", "x", "")] == [12, 10, 10]
    assert value(spark, X.promote_links(c), s='<a href="../a-1.html"><a href="../../index.html#x"><img src="../../assets/l.svg">この記事（下書き・未公開）') == (
        '<a href="a-1.html"><a href="../index.html#x"><img src="../assets/l.svg">この記事'
    )


def test_time_functions(spark):
    at = lambda text, now: str(value(spark, T.reset_time(F.col("s"), F.lit(now).cast("timestamp")), s=text))
    assert at("limit RESETS 10pm (x)", "2026-01-01 21:00:00") == "2026-01-01 22:05:00"
    assert at("resets 12am", "2026-01-01 00:05:00") == "2026-01-02 00:05:00"
    assert at("resets 10:30pm", "2026-01-01 00:05:00") == "None"
    assert [value(spark, T.seconds(F.col("n")), n=n) for n in (2500, 3500)] == [2, 4]
    dates = [str(value(spark, T.display_date(F.col("s")), s=s)) for s in ("2026年9月1日", "2026/09/11", "x")]
    assert dates == ["2026-09-01", "2026-09-11", "None"]
    assert value(spark, T.most_items(F.col("n")), n=3) == 5
    gaps = [value(spark, T.missed_run(F.lit("2026-01-01").cast("date"), F.lit(t).cast("date")), n=0) for t in ("2025-12-30", "2026-01-01", "2026-01-02", "2026-01-06")]
    assert gaps == [None, None, None, 4]
    minutes = T.minutes_left(F.lit("2026-01-01 00:00:01").cast("timestamp"), F.lit("2026-01-01 00:02:00").cast("timestamp"))
    assert value(spark, minutes, n=0) == 2


def test_validation(spark):
    df = frame(spark, [article("ok"), article("a", title="", bullets=[]), article("", source=None, background=" "), article("c", cardBullets=["x"]), article("d", cardBullets=["あ" * 55, "あ" * 55 + "a", "z"], bullets=["三"])])
    got = [(r.pos, r.message) for r in validate.required(df).orderBy("pos", "ord").collect()]
    assert got == [(1, '[1] a: no value for "title"'), (1, '[1] a: no value for "bullets"'), (2, '[2] (no slug): no value for "slug"'), (2, '[2] (no slug): no value for "source"')]
    cards = validate.card_bullets(df).orderBy("pos").collect()
    assert [(r.pos, r.rule, r.ord) for r in cards] == [(3, "card_count", 0), (4, "card_width", 1)]
    assert "55.5" in cards[1].message and "1 card bullets" in cards[0].message
    assert [r.slug for r in validate.without_digits(df).collect()] == ["a", "d"]
    with pytest.raises(ValueError, match="title"):
        validate.strict(df)


def test_render_then_extract(spark):
    rows = [article("x", origTitle="O <1>"), article("y", related=None, theme="visibility")]
    back = {r.slug: r for r in D.extract(D.render(frame(spark, rows), SITE)).collect()}
    for a in rows:
        r = back[a["slug"]]
        assert (r.title, r.theme, r.source, r.background, r.message, r.orig_title) == (a["title"], a["theme"], a["source"], a["background"], a["meaning"], a["origTitle"])
        assert r.platform_labels == ["Google", "x", "その他AI検索"] and r.bullets == a["bullets"]
        assert (r.source_url, r.thumbnail_url, r.date_display) == (a["sourceUrl"], a["thumbnail"], a["dateDisplay"])
        assert [(x.href, x.title) for x in r.related] == [(f"../{q['slug']}.html", q["title"]) for q in a["related"] or []]


def write(path, text):
    sinks.put(str(path), text)
    return str(path)


def test_build_promote_notify_reject(spark, tmp_path):
    batch = write(tmp_path / "batch.json", json.dumps([article("a"), article("b"), article("c"), article("a", title="Later")]))
    drafts, metas, out = (str(tmp_path / x) for x in ("draft", "meta", "out"))
    n, warned = P.build(spark, batch, drafts, metas, SITE)
    assert n == 4 and warned == []
    assert "Later" in open(f"{drafts}/a.html").read()
    meta = json.load(open(f"{metas}/b.json"))
    assert meta["bullets"] == ["a", "b", "c"] and meta["thumbnail"] == {"type": "image", "url": "https://s.example/t.png"} and meta["url"] == f"{SITE}/b.html"
    cat = write(tmp_path / "cat.json", json.dumps({"updatedAt": "2026-01-01", "articles": [meta | {"slug": "old", "sourceUrl": None}]}))
    urls = str(tmp_path / "urls.md")
    for bad, why in ((["zz"], "draft not found"), (["a", "a"], "named twice"), ([], "usage")):
        with pytest.raises(ValueError, match=why):
            P.promote(spark, bad, drafts, metas, out, cat, urls, "2026-02-02")
    sent = []
    send = lambda url, body: (sent.append(json.loads(body)["text"]), (True, "ok"))[1]
    assert P.notify(spark, ["b", "a"], drafts, metas, f"{SITE}/draft", "hook", send, "head\n") == 0
    assert sent[0].startswith("head\n1. *Title <b> & 'more'*\n   google/x/other-ai / seller / measurement / 新聞 / 2026-09-01\n") and "2. *Later*" in sent[0]
    with pytest.raises(ValueError, match="no draft"):
        P.notify(spark, ["zz"], drafts, metas, SITE, "hook", send)
    assert P.promote(spark, ["a", "b"], drafts, metas, out, cat, urls, "2026-02-02", "# head\n") == 2
    now = json.load(open(cat))
    assert now["updatedAt"] == "2026-02-02" and [x["slug"] for x in now["articles"]] == ["b", "a", "old"]
    assert open(urls).read() == "# head\n- https://s.example/b?a=1&b=2\n- https://s.example/a?a=1&b=2\n"
    assert [r.url for r in readers.url_list(spark, urls).orderBy("pos").collect()] == ["https://s.example/b?a=1&b=2", "https://s.example/a?a=1&b=2"]
    assert "下書き" not in open(f"{out}/a.html").read() and not os.path.exists(f"{drafts}/a.html")
    assert P.reject(spark, ["c", "c", "zz"], drafts, metas) == {"c": True, "zz": False} and not os.path.exists(f"{drafts}/c.html")
    assert P.reject(spark, ["c"], drafts, metas) == {"c": False} and not os.path.exists(f"{metas}/c.json")


def test_migrate(spark, tmp_path):
    crumb = '<p class="crumb">old</p>'
    page = lambda theme="visibility", c=crumb, extra="<H><F>": f'{extra}<span class="cat theme-{theme}">{c}'
    for k, text in {"a": page(), "b": page("none"), "c": page(c="?"), "d": page(extra="<H>"), "e": page(extra="<H><F><F>")}.items():
        write(tmp_path / f"in/{k}.html", text)
    counts, left = P.migrate(spark, str(tmp_path / "in"), [("<H>", "<h/>"), ("<F>", "<f/>")], crumb, SITE, str(tmp_path / "new"))
    assert tuple(counts.first()) == (2, 3)
    assert [(p.slug, p.skip_reason) for p in left.collect()] == [("b", "theme"), ("c", "breadcrumb"), ("d", "markup")]
    assert open(tmp_path / "new/e.html").read().startswith("<h/><f/><F>")


EVENTS = [
    "not json",
    {"type": "assistant", "message": {"content": [{"type": "tool_use", "name": "bash", "input": {"description": "", "command": "ls"}}, {"type": "text", "text": "　 hi 　"}, {"type": "text", "text": " "}]}},
    {"type": "Assistant", "message": {"content": [{"type": "tool_use", "name": "Other", "input": {"url": "u" * 98}}]}},
    {"type": "user", "message": {"content": [{"type": "text", "text": "no"}]}},
    {"type": "result", "num_turns": 3, "duration_ms": 2500, "is_error": False, "result": "fine"},
    {"type": "result", "num_turns": 4, "duration_ms": 3500, "is_error": True, "result": "resets 10pm"},
]
WANT = ["  → コマンド実行 - ls", "  💬 hi", "  → Other - " + "u" * 97 + "...", "処理完了。ターン数: 3 / 所要時間: 2秒", "処理完了。ターン数: 4 / 所要時間: 4秒"]


def log(path, events=EVENTS):
    return write(path, "\n".join(e if isinstance(e, str) else json.dumps(e, separators=(",", ":"), ensure_ascii=False) for e in events) + "\n")


def test_event_logs(spark, tmp_path):
    lines, outcome, seen = P.summarise(spark, log(tmp_path / "r/1.jsonl"), 0, "2026-01-01 09:00:00")
    assert [r.line for r in lines.collect()] == WANT and tuple(seen.first()) == (6, 1)
    o = outcome.first()
    assert o.failed and o.reason == "error: resets 10pm" and str(o.retry_at) == "2026-01-01 22:05:00"
    of = lambda rows, code: P.summarise(spark, log(tmp_path / f"{len(rows)}{code}.jsonl", rows), code, "2026-01-01 09:00:00")[1].first()
    assert of(EVENTS[:5], 0).failed is False and of(EVENTS[:5], 2).reason == "exit code 2"
    assert of(["x NIGHTLY_RESEARCH_FAILED: why", "y"], 0).reason == "why"


def test_stream_equals_batch(spark, tmp_path):
    log(tmp_path / "in/1.jsonl")
    log(tmp_path / "in/2.jsonl", EVENTS[1:3])
    q = summary.summarise(summary.event_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    got = sorted(r.line for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted([*WANT, *WANT[:3]])
    assert summary.line_counts(q) == (8, 1)


def test_runs_and_lists(spark, tmp_path):
    sent = []
    send = lambda u, b: (sent.append(b), (True, "ok"))[1]
    state = str(tmp_path / "state")
    assert P.missed_run(spark, state, "2026-01-05", "hook", send) is None
    write(tmp_path / "state/last-run", " 2026-01-01\n")
    assert P.missed_run(spark, state, "2026-01-02", "hook", send) is None and not sent
    assert P.missed_run(spark, state, "2026-01-05", "hook", send) == 3 and len(sent) == 1
    assert P.missed_run(spark, state, "2026-01-06", "hook", send) is None and len(sent) == 1
    write(tmp_path / "state/last-run", "2026-01-03")
    assert P.missed_run(spark, state, "2026-01-06", "hook", send) == 2 and len(sent) == 2
    assert sinks.alert(lambda u, b: 1 / 0, "hook", "x") is False and sinks.alert(send, None, "x") is False
    status = readers.status_lines(spark, "?? automation/articles-batch-x.json\n M automation/articles-batch-y.json\n?? automation/other.json")
    assert [r.name for r in C.stale_batches(status).collect()] == ["articles-batch-x.json"]
    assert runs.quotas(10) == (10, 15) and runs.options("m", "") == ["--model", "m"]
    template = spark.createDataFrame([("{{MIN_COUNT}} to {{max_count}}",)], "value string")
    assert runs.prompt(template, 3).first().value == "3 to 5"
    for name in ("b.log", "a.log"):
        write(tmp_path / "l" / name, "x")
    files = readers.listing(spark, str(tmp_path / "l"), "*.log")
    before = spark.createDataFrame([("A.LOG",)], "name string")
    assert [r.name for r in C.new_files(files, before).collect()] == ["b.log"]
    assert readers.webhook_url(str(tmp_path / "none.json")) is None and readers.webhook_url(write(tmp_path / "bad.json", "{")) is None
    rows = [("u1", 200, None, "2026-01-05"), ("u2", 404, None, "2026-01-05"), ("u3", 200, "Same-Site", "2026-01-05"), ("u4", 200, None, "2025-12-01"), ("u5", 200, "cross-origin", "2026-01-06")]
    cand = spark.createDataFrame(rows, "url string, status int, corp_header string, published string").withColumn("published", F.col("published").cast("date"))
    assert [r.url for r in C.usable(cand, "2026-01-07").collect()] == ["u5", "u1"]
    arts = frame(spark, [article("a"), article("gone")])
    assert C.unresolved_links(arts.filter("slug = 'a'")).count() == 1 and C.unresolved_links(arts).count() == 0


def test_plans_stay_on_the_jvm(spark, tmp_path):
    df = frame(spark, [article("a")])
    for plan in (D.extract(D.render(df, SITE)), validate.required(df), E.summary_lines(spark.createDataFrame([("x",)], "value string"))):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in text and "Arrow" not in text


def test_lists_are_broadcast(spark, tmp_path):
    """Slugs, metadata, catalog and used URLs meet by broadcast joins, as they are small by their nature."""
    batch = write(tmp_path / "b.json", json.dumps([article("a"), article("b")]))
    P.build(spark, batch, str(tmp_path / "draft"), str(tmp_path / "meta"), SITE)
    cat = write(tmp_path / "cat.json", json.dumps({"updatedAt": "2026-01-01", "articles": []}))
    urls = write(tmp_path / "urls.md", "# head\n- https://s.example/a\n")
    asked, meta = readers.arguments(spark, ["a", "b"]), readers.metas(spark, str(tmp_path / "meta"))
    old = readers.catalog_articles(readers.catalog(spark, cat))
    candidates = spark.createDataFrame([("https://s.example/a", 200), ("x", 200)], "url string, status int")
    plans = [
        C.in_list_order(asked, meta), validate.promotable(asked, readers.pages(spark, str(tmp_path / "draft")), meta, old),
        C.unused(candidates, readers.url_list(spark, urls)), C.unresolved_links(readers.batch(spark, batch)),
    ]
    for plan in plans:
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text and "Python" not in text
