"""Nulls, empty tables, repeated rows, ties and clashing column names."""

import hashlib
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.llm import chat_format as c
from inkwell.llm.quality_classifier import expectation_maximisation
from inkwell.llm.quality_rules import quality_rules
from inkwell.llm.workspace import Workspace, scratch
from inkwell.llm.url_filter import OP6_RULES_SQL, UNWANTED, labelled_urls, url_filter, url_parts, url_rules


def test_chat_round_trip(spark):
    odd = ["<|im_end|>", "\\", "\\<|", "<\\|", None, "", "<", "a\nb", "<|im_next|>x"]
    rows = [(1, k, "user" if k % 3 else "assistant", t, "x") for k, t in enumerate(odd)]
    rows += [(2, 0, "assistant", "b", "x"), (2, 0, "assistant", "a", "x"), (2, None, None, "n", "x"), (None, 1, "<|x", "y", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in c.read_back(c.format_chat(df)).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [(r[2], r[3] or "") for r in rows[:9]]
    assert got[1].loss_text == "".join((t or "") for k, t in enumerate(odd) if k % 3 == 0)
    assert [(t.role, t.text) for t in got[2].turns] == [("", "n"), ("assistant", "a"), ("assistant", "b")]
    assert [(t.role, t.text) for t in got[None].turns] == [("<|x", "y")]
    assert got[2].formatted.count(c.START) == 2 and c.format_chat(df.filter("false")).count() == 0
    assert hashlib.sha256(b"").hexdigest() != ""


def test_quality_rules_edge_cases(spark):
    clean = " ".join(f"word{k}" for k in range(60))
    rows = [(1, clean, "en", "s", 1), (1, clean, "en", "s", 1), (2, None, "en", "s", 1), (3, "", None, None, 1), (4, "of, " * 3000, "en", None, 1), (5, clean, None, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int")
    got = sorted((r.doc_id, r.n_words, r.n_repeat_words, r.base_failed, r.kept) for r in quality_rules(df).collect())
    assert got == [(1, 60, 0, False, True), (1, 60, 0, False, True), (2, 0, 0, True, False), (3, 0, 0, True, False), (4, 3000, 3000, True, False), (5, 60, 0, False, True)]
    assert quality_rules(df.filter("false")).count() == 0


def test_url_rules(spark):
    rows = [
        (1, "HTTP://M.Example.COM/en/7?x"), (2, "http://a.com/en/8"), (3, "https://badexample.net/de/8"), (4, "https://x.example.net/de/80#a"),
        (5, None), (6, "no scheme"), (7, "http://org/es/"), (8, "http://casino-win.example.net/fr/1"), (9, "x://É.net"), (9, "x://É.net"),
    ]
    df = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, host string")
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter(df).orderBy("page_id").collect()]
    assert got[:7] == [
        (1, "m.example.com", "/en/7", "example.com/en/7", "allow"), (2, "a.com", "/en/8", "com/en/", "block"), (3, "badexample.net", "/de/8", "net/de/", "allow"),
        (4, "x.example.net", "/de/80", "example.net/de/8", "block"), (5, "", "", None, got[4][4]), (6, "", "", None, got[5][4]), (7, "org", "/es/", "org/es/", "block"),
    ]
    assert got[7][3] is None and got[8] == got[9] == (9, "É.net", "", None, got[8][4])
    assert url_filter(df.filter("false")).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="the tables are not here")
def test_url_model_on_hosts_it_has_not_seen(spark):
    """The six unwanted hosts of the table, which share no four characters in a row with an unwanted labelled one, against all others."""
    names = ("spam-farm", "cheap-pills", "casino-win", "adult-x", "free-bets", "ads-track")
    grams = lambda words: {w[k : k + 4] for w in words for k in range(len(w) - 3)}
    assert not grams(names) & grams(UNWANTED)
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    stem = F.regexp_extract("host", r"^(?:(?:www|m|blog)\.)?([^.]+)\.", 1)
    known = labelled_urls(spark).select(url_parts(F.col("url"))[0].alias("host")).select(stem.alias("stem")).distinct()
    judged = url_filter(pages).select(stem.alias("stem"), "host", (F.col("score") >= 0.5).alias("bad")).cache()
    assert judged.join(known, "stem", "left_semi").count() == 0
    unwanted = F.col("stem").isin(*names)
    share = {r.unwanted: r.share for r in judged.groupBy(unwanted.alias("unwanted")).agg(F.avg(F.col("bad").cast("int")).alias("share")).collect()}
    assert share[True] > 0.6 and share[False] < 0.01


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the tables are not here")
def test_url_parts_and_rules_equal_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW pages AS SELECT * FROM '/root/testdata/sf0.01/pages.parquet'")
    want = con.execute(OP6_RULES_SQL).fetchall()
    got = url_filter(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()
    assert sorted((r.page_id, r.host, r.path, r.rule, r.verdict if r.rule else None) for r in got) == sorted(want, key=lambda r: r[0])



def test_scratch_deletes_the_tables_of_a_call(spark):
    kept = Workspace(spark, "kept")
    with scratch(spark):
        inner = Workspace(spark, "inner")
        assert inner.save(spark.range(3), "t").count() == 3
        again = kept.save(spark.range(2), "t")
    path = lambda w: w.root.removeprefix("file://")
    assert not os.path.exists(path(inner)) and os.path.exists(path(kept)) and again.count() == 2


def test_estimation_finds_the_good_side():
    post, right, share = expectation_maximisation(["111", "100", "001", "11-"], [80, 10, 2, 8])
    assert post[0] > 0.9 and post[1] < 0.1 and right.shape == (3, 2) and 0.5 < share < 1


def test_estimation_equals_a_plain_version():
    """One document at a time, straight from the formulas."""
    rng = np.random.default_rng(2)
    patterns = ["".join(rng.choice(list("01-"), 4)) for _ in range(40)]
    patterns = sorted(set(patterns))
    counts = rng.integers(1, 30, len(patterns)).tolist()
    start = []
    for p in patterns:
        cast = [c for c in p if c != "-"]
        good = cast.count("1") / len(cast) if cast else 0.5
        start.append(min(good, 0.3) if "0" in p else good)
    docs = [(p, q) for p, n, q in zip(patterns, counts, start, strict=True) for _ in range(n)]
    for _ in range(5):
        share = (sum(q for _, q in docs) + 1) / (len(docs) + 2)
        right = {}
        for j in range(4):
            for k in "01":
                weight = [q if k == "1" else 1 - q for _, q in docs]
                hits = sum(w for (p, _), w in zip(docs, weight, strict=True) if p[j] == k)
                right[j, k] = (hits + 1) / (sum(w for (p, _), w in zip(docs, weight, strict=True) if p[j] != "-") + 2)
        new = []
        for p, _ in docs:
            good, bad = share, 1 - share
            for j, c in enumerate(p):
                if c != "-":
                    good *= right[j, "1"] if c == "1" else 1 - right[j, "1"]
                    bad *= right[j, "0"] if c == "0" else 1 - right[j, "0"]
            new.append((p, good / (good + bad)))
        docs = new
    post, accuracy, estimate = expectation_maximisation(patterns, counts, steps=5)
    assert np.allclose([dict(docs)[p] for p in patterns], post) and abs(share - estimate) < 1e-9
    assert np.allclose(accuracy, [[right[j, "0"], right[j, "1"]] for j in range(4)])


def test_url_rules_of_any_number_and_skew(spark):
    """Twenty thousand rules, and a host with most of the URLs; every rule is looked up."""
    rules = [("block", f"h{k}.net", f"/{k % 7}") for k in range(20_000)] + [("allow", "hot.org", f"/a{k}/") for k in range(300)] + [("block", "org", ""), (None, "x", "/")]
    urls = [(k, f"https://www.h{k * 13}.net/{k * 13 % 7}/x") for k in range(500)] + [(1000 + k, f"http://hot.org/a{k % 600}/b") for k in range(3000)]
    got = {r.page_id: (r.rule, r.rule_verdict) for r in url_rules(spark.createDataFrame(urls, "page_id long, url string"), rules=rules).collect()}
    assert all(got[k] == (f"h{k * 13}.net/{k * 13 % 7}", "block") for k in range(500))
    assert all(got[1000 + k] == ((f"hot.org/a{k % 600}/", "allow") if k % 600 < 300 else ("org", "block")) for k in range(3000))


def test_a_very_long_url(spark):
    url = "https://" + "a." * 20_000 + "example.com/en/7" + "x/" * 50_000
    [row] = url_filter(spark.createDataFrame([(1, url)], "page_id long, url string")).collect()
    assert row.rule == "example.com/en/7" and row.verdict == "allow" and len(row.path) == 100_005
