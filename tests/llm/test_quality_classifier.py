"""The query against plain labellers and a plain estimation."""

import os
import re
import unicodedata
from collections import Counter

import numpy as np
import pytest

from inkwell.llm import quality_classifier as Q

FOLDER = "/root/testdata/sf0.001"


def plain_votes(text):
    text = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    n = len(w)
    windows = Counter(tuple(w[k : k + 8]) for k in range(n - 7))
    repeated = {k + j for k in range(n - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(8)}
    upper = sum(unicodedata.category(c) == "Lu" for c in text)
    letters = sum(c not in " \t\n\x0b\f\r" for c in text)
    of = {
        "n_symbols": sum(c in "#*$%&|<>" for c in text), "repeat": len(repeated), "function": sum(x.lower() in Q.FUNCTION_WORDS for x in w), "exclaims": text.count("!"),
        "bars": w.count("|"), "distinct": len(set(w)), "runs": sum(a == b for a, b in zip(w, w[1:], strict=False)),
    }
    over = lambda k, percent: of[k] * 100 > n * percent
    rules = {
        "length": (n < 20, n >= 40), "symbols": (over("n_symbols", 30), not over("n_symbols", 5)), "repeats": (over("repeat", 30), not over("repeat", 10)),
        "capitals": (upper * 2 > letters, upper * 5 < letters), "function_words": (not over("function", 1), over("function", 8)),
        "exclaims": (over("exclaims", 20), not over("exclaims", 3)), "tables": (over("bars", 10), not over("bars", 3)),
        "variety": (not over("distinct", 15), over("distinct", 35)), "runs": (over("runs", 25), not over("runs", 10)),
    }
    vote = lambda bad, good: "0" if bad else "1" if good else "-"
    return "".join(vote(*rules[k]) if n else "0" if k == "length" else "-" for k in Q.LABELLERS)


def plain_estimation(rows):
    """Expectation-maximisation over the single documents, not over counts of patterns."""
    v = [[{"0": 0, "1": 1, "-": None}[c] for c in r] for r in rows]
    post = []
    for r in v:
        cast = [x for x in r if x is not None]
        start = sum(cast) / len(cast) if cast else 0.5
        post.append(min(start, 0.3) if 0 in cast else start)
    for _ in range(100):
        right = []
        for j in range(len(Q.LABELLERS)):
            ok = [1.0, 1.0]
            every = [2.0, 2.0]
            for r, p in zip(v, post, strict=True):
                if r[j] is not None:
                    for k, w in ((0, 1 - p), (1, p)):
                        every[k] += w
                        ok[k] += w * (r[j] == k)
            right.append((ok[0] / every[0], ok[1] / every[1]))
        share = (sum(post) + 1) / (len(post) + 2)
        new = []
        for r in v:
            good, bad = share, 1 - share
            for x, (q0, q1) in zip(r, right, strict=True):
                if x is not None:
                    good *= q1 if x == 1 else 1 - q1
                    bad *= q0 if x == 0 else 1 - q0
            new.append(good / (good + bad))
        step = max(abs(a - b) for a, b in zip(new, post, strict=True))
        if step < 1e-9:
            break
        post = new
    return post


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the tables are not here")
def test_votes_and_posteriors_equal_a_plain_version(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    odd = [(-1, None), (-2, ""), (-3, " \n"), (-4, "A" * 500), (-5, "| " * 60), (-6, "la la " * 400), (-7, "É! " * 30), (-8, "a b c d e f g h " * 5), (-9, "x " * 200_000)]
    rows = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string")).unionByName(docs.filter("doc_id < 3"))
    got = sorted(((r.doc_id, r.pattern, r.posterior, r.score, r.kept) for r in Q.quality_classifier(rows).collect()), key=lambda r: r[:2])
    texts = sorted(((r.doc_id, plain_votes(r.text)) for r in rows.collect()))
    assert [r[:2] for r in got] == texts
    assert np.allclose([r[2] for r in got], plain_estimation([p for _, p in texts]), atol=1e-6)
    assert all(r[4] == (r[3] >= 0.5) for r in got)
