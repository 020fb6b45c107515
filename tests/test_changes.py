"""Staged changes: all or nothing under failures at every step, files byte for byte, on mounted and other paths."""

import json
import os
import stat

import pytest

from inkwell.plans import pipelines as P
from inkwell.sources import sinks
from inkwell.sources.changes import Changes, recover
from inkwell.sources.storage import Store

from test_core import SITE, article


class Failing:
    """A store whose n-th write, rename or delete fails; ``dead``: and all after it, as when the driver dies."""

    def __init__(self, store, n, dead):
        self.store, self.left, self.dead = store, n, dead

    def __getattr__(self, name):
        f = getattr(self.store, name)
        if name not in ("write", "rename", "delete"):
            return f

        def maybe(*a):
            self.left -= 1
            if self.left == 0 or self.left < 0 and self.dead:
                raise OSError("no")
            return f(*a)

        return maybe


def state(folder):
    return {n: open(f"{folder}/{n}").read() for n in sorted(os.listdir(folder)) if not n.startswith(".")}


@pytest.mark.parametrize("dead", [False, True])
def test_a_failure_at_any_step_leaves_the_old_or_the_new_state(spark, tmp_path, dead):
    store, seen = Store(spark), set()
    for n in range(1, 40):
        base = str(tmp_path / f"{n}")
        for name in "abc":
            sinks.put(f"{base}/{name}", f"old {name}")
        old, new = state(base), {"a": "new a", "c": "old c", "d": "new d", "e": "é\n"}
        failing = Failing(store, n, dead)
        try:
            with Changes(failing, base) as change:
                change.put(f"{base}/a", "new a")
                change.delete(f"{base}/b")
                change.put(f"{base}/d", ["new", " ", "d"])
                change.put(f"{base}/e", "é\n")
                change.delete(f"{base}/none")
            assert state(base) == new
        except OSError:
            undone = recover(store, base)
            assert state(base) in (old, new) and undone in (0, 1)
            seen.add(state(base) == new)
        assert not os.path.exists(f"{base}/.changes") or not os.listdir(f"{base}/.changes")
        if failing.left > 0:
            break
    else:
        raise AssertionError("more steps than tried")
    assert n > 12 and (False in seen) and (not dead or True in seen)


def test_files_by_key_are_the_texts_byte_for_byte(spark, tmp_path):
    base = str(tmp_path / "out")
    texts = {"a": "x\n", "b": "two\r\nlines\n\n", "c": "no end", "d": "", "é 1%": "😀", "e": "\n", "f=g": "x" * 100_000 + "}"}
    df = spark.createDataFrame([(*kv, "more") for kv in texts.items()], "slug string, html string, value string")
    with Changes(Store(spark), base) as change:
        assert change.files_by_key(df, base, "slug", "html", ".txt") == len(texts)
    got = {n: open(f"{base}/{n}", "rb").read().decode() for n in os.listdir(base) if not n.startswith(".changes")}
    assert got == {f"{k}.txt": v for k, v in texts.items()}
    assert {stat.S_IMODE(os.stat(f"{base}/{n}").st_mode) for n in got} == {0o644}
    sinks.put(str(tmp_path / "cell"), "x")
    assert stat.S_IMODE(os.stat(tmp_path / "cell").st_mode) == 0o644


@pytest.mark.parametrize(("rows", "why"), [([("a", None)], "without text"), ([(None, "x")], "None"), ([("", "x")], "no file"), ([("../a", "x")], "no file"), ([("a", "x"), ("a", "y")], "named twice")])
def test_bad_rows_are_refused_before_the_first_write(spark, tmp_path, rows, why):
    base = str(tmp_path)
    with pytest.raises(ValueError, match=why), Changes(Store(spark), base) as change:
        change.files_by_key(spark.createDataFrame([*rows, ("good", "z")], "k string, t string"), base, "k", "t", ".html")
    assert [os.listdir(f"{base}/{n}") for n in os.listdir(base)] in ([], [[]])


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    from pyspark.sql import functions as F

    df = spark.range(20).select(F.col("id").cast("string").alias("k"), F.when(F.col("id") == 19, F.raise_error(F.lit("broken"))).otherwise("text\n").alias("t"))
    with pytest.raises(Exception, match="broken"), Changes(Store(spark), str(tmp_path)) as change:
        change.files_by_key(df, str(tmp_path), "k", "t", ".html")
    assert state(str(tmp_path)) == {}


def test_a_path_that_only_spark_reads(spark, tmp_path):
    os.makedirs(tmp_path / "site")
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.shop.link./site", f"file://{tmp_path}/site")
    base, store = "viewfs://shop/site", Store(spark)
    with Changes(store, base) as change:
        change.files_by_key(spark.createDataFrame([("a", "A\n"), ("b", "B\n")], "k string, t string"), base, "k", "t", ".html")
        change.put(f"{base}/list.md", "- x\n")
    assert store.read(f"{base}/a.html") == "A\n" and store.names(base)[-3:] == ["a.html", "b.html", "list.md"]
    with Changes(store, base) as change:
        change.put(f"{base}/a.html", "new")
        change.delete(f"{base}/b.html")
    assert open(tmp_path / "site/a.html").read() == "new" and not store.exists(f"{base}/b.html")


def test_promotion_is_all_or_nothing(spark, tmp_path, monkeypatch):
    batch = str(tmp_path / "batch.json")
    sinks.put(batch, json.dumps([article("a"), article("b")]))
    drafts, metas, out, cat, urls = (str(tmp_path / x) for x in ("draft", "meta", "out", "out/cat.json", "out/urls.md"))
    P.build(spark, batch, drafts, metas, SITE)
    os.makedirs(out)
    sinks.put(cat, json.dumps({"updatedAt": "2026-01-01", "articles": []}))
    before = [state(x) for x in (drafts, metas, out)]
    renames = {"n": 0}
    rename = Store.rename

    def failing(self, old, new):
        renames["n"] += 1
        if renames["n"] == 5:
            raise OSError("no")
        return rename(self, old, new)

    monkeypatch.setattr(Store, "rename", failing)
    with pytest.raises(OSError, match="no"):
        P.promote(spark, ["a", "b"], drafts, metas, out, cat, urls, "2026-02-02")
    assert [state(x) for x in (drafts, metas, out)] == before
    assert P.promote(spark, ["a", "b"], drafts, metas, out, cat, urls, "2026-02-02") == 2
    assert state(drafts) == {} and sorted(state(out)) == ["a.html", "b.html", "cat.json", "urls.md"]


def test_a_record_without_theme_stops_the_build_before_a_file_is_written(spark, tmp_path):
    sinks.put(str(tmp_path / "batch.json"), json.dumps([article("a"), article("b", theme="none")]))
    with pytest.raises(ValueError, match="'b' without text"):
        P.build(spark, str(tmp_path / "batch.json"), str(tmp_path / "draft"), str(tmp_path / "meta"), SITE)
    assert not os.path.exists(tmp_path / "draft/a.html")


def test_migration_in_place(spark, tmp_path):
    crumb = '<p class="crumb">old</p>'
    page = lambda c=crumb: f'<H><span class="cat theme-visibility">{c}</span>'
    sinks.put(str(tmp_path / "a.html"), page())
    sinks.put(str(tmp_path / "b.html"), page("?"))
    counts, left = P.migrate(spark, str(tmp_path), [("<H>", "<h/>")], crumb, SITE)
    assert tuple(counts.first()) == (1, 1) and [r.slug for r in left.collect()] == ["b"]
    got = state(str(tmp_path))
    assert got["a.html"].startswith("<h/>") and "トップ" in got["a.html"] and got["b.html"] == page("?")
