"""Stages of the corpus pipeline, and the whole, on small tables with null ids, repeated rows and no rows."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_decontaminate import _plain
from test_jaccard_join import _brute as _classes

import corpus_pipeline as P
from inkwell.llm.decontaminate import WORD
from inkwell.llm.quality_rules import OP3_SQL
from inkwell.llm.tokens import TokenBytes, default_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ITEM = " ".join(f"leak{i}" for i in range(20))


def _words(name, n=60):
    return " ".join(f"{name}{i}" for i in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").coalesce(1).write.parquet(f"{path}/benchmark.parquet")
    return path


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], SCHEMA)


def _kept(df):
    return sorted([(r.doc_id, r.text) for r in df.collect()], key=str)


def test_near_duplicates_stage_keeps_one_row_of_a_group(spark, folder):
    same, near = _words("a"), _words("a", 58)
    docs = _docs(spark, [(3, same), (3, same), (5, same), (7, near), (8, _words("b")), (None, _words("c"))])
    assert _kept(P.jaccard_join(spark, docs, folder)) == sorted([(3, same), (8, _words("b")), (None, _words("c"))], key=str)


def test_decontamination_judges_each_row_by_its_own_text(spark, folder):
    leak, clean = f"before {ITEM} after", _words("b")
    docs = _docs(spark, [(1, leak), (1, clean), (2, clean), (2, clean), (None, leak), (None, clean), (None, None)])
    got = P.decontamination(spark, docs, folder)
    assert got.columns == docs.columns
    assert _kept(got) == sorted([(1, clean), (2, clean), (2, clean), (None, clean), (None, None)], key=str)


def test_substring_stage_takes_what_an_earlier_document_holds(spark, folder):
    shared = _words("s", 30)
    docs = _docs(spark, [(1, f"{shared}"), (2, f"{shared}"), (4, f"{_words('o', 9)}|{shared}")])
    assert _kept(P.substring_dedup(spark, docs, folder)) == [(1, shared), (4, f"{_words('o', 9)}|")]


@pytest.mark.parametrize("stage", [s for _, s in P.STAGES], ids=[n for n, _ in P.STAGES])
def test_stages_of_an_empty_table(spark, folder, stage):
    assert stage(spark, _docs(spark, [(1, "x")]).filter("false"), folder).count() == 0


def test_quality_stage_judges_each_row(spark, folder):
    good, bad = _words("g"), "too short"
    docs = _docs(spark, [(1, good), (1, bad), (None, good), (None, bad), (2, good), (2, good), (3, None), (4, "")])
    assert _kept(P.quality_rules(spark, docs, folder)) == sorted([(1, good), (None, good), (2, good), (2, good)], key=str)


def test_substring_stage_of_odd_rows(spark, folder):
    shared, own = _words("s", 30), _words("o", 30)
    docs = _docs(spark, [(1, shared), (None, shared), (5, shared), (5, own), (5, own), (6, None), (7, "é" * 20)])
    assert _kept(P.substring_dedup(spark, docs, folder)) == sorted([(1, shared), (None, shared), (5, own), (5, own), (7, "é" * 20)], key=str)


CLASHING = ("_doc", "_version", "_version_of", "_kept", "_text_print", "_good_id", "version", "class_id", "n_words", "spans", "item_id", "start")


@pytest.mark.parametrize("stage", [s for _, s in P.STAGES[:-1]], ids=[n for n, _ in P.STAGES[:-1]])
def test_stages_keep_columns_of_any_name(spark, folder, stage):
    docs = _docs(spark, [(1, _words("a")), (2, _words("b")), (None, _words("c"))]).withColumns({c: F.lit('x') for c in CLASHING})
    got = stage(spark, docs, folder)
    assert got.columns == docs.columns and got.filter("_doc = 'x' AND spans = 'x'").count() == 3


def test_stages_take_a_very_long_text(spark, folder, tmp_path):
    rng = np.random.default_rng(1)
    long = " ".join(f"w{x}" for x in rng.integers(0, 10**6, 150_000))
    docs = _docs(spark, [(1, long), (2, _words("b")), (3, f"{long} {ITEM}")])
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    assert docs.filter("doc_id = 1").agg({"length": "sum"}).first()[0] == len(TokenBytes(default_path())(long)) // 4 + 1
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == {1, 2}


def _cut(docs):
    """Texts without the bytes of 50-byte strings that start in a smaller document; rows of texts that are blank then go."""
    first, out = {}, []
    for i, t in docs:
        raw = t.encode()
        for p in range(len(raw) - 49):
            first[raw[p : p + 50]] = min(first.get(raw[p : p + 50], i), i)
    for i, t in docs:
        raw = t.encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 49):
            if first[raw[p : p + 50]] < i:
                gone[p : p + 50] = True
        left = bytes(b for b, g in zip(raw, gone, strict=True) if not g).decode("utf-8", "ignore")
        if left.strip():
            out.append((i, left))
    return out


def _leaks(text):
    number = {}
    doc, item = ([number.setdefault(w, len(number)) for w in WORD.findall(t.lower())] for t in (text, ITEM))
    return _plain(doc, item, 5) >= 0.5 * len(item)


def test_run_equals_a_plain_chain(spark, tmp_path):
    rng = np.random.default_rng(21)
    word = lambda n: " ".join(f"v{x}" for x in rng.integers(0, 5000, n))
    passage, rows = word(25), []
    for _ in range(12):
        rows.append(word(60))
        rows.append(f"{word(30)} {passage} {word(30)}")
    rows += [rows[0], rows[0].replace("v1", "x1", 1), rows[3] + " more", "short", "of, " * 80, "", f"{word(20)} {ITEM} {word(20)}"]
    rows += [f"{word(20)} {' '.join(ITEM.split()[10:])} {word(5)} {' '.join(ITEM.split()[:10])}", "### $$$ %%% " * 4 + word(30)]
    docs = [(int(i), rows[k]) for k, i in enumerate(rng.permutation(len(rows)))]
    _docs(spark, docs).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    kept = {r[0] for r in con.execute(f"SELECT doc_id FROM ({OP3_SQL}) WHERE kept").fetchall()}
    left = [d for d in docs if d[0] in kept]
    classes = _classes(left)
    left = _cut([d for d in left if classes[d[0]][0] == d[0]])
    left = [d for d in left if not _leaks(d[1])]
    encode = TokenBytes(default_path())
    want = sorted((i, len(encode(t)) // 4 + 1) for i, t in left)
    got = P.run(spark, str(tmp_path)).filter("start = 0").select("doc_id", "doc_tokens").collect()
    assert sorted(tuple(r) for r in got) == want and 10 < len(want) < len(docs) - 6
