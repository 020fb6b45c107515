"""Nulls, repeated rows, clashing columns and empty tables in the classifiers and the length histogram."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.llm.quality_classifier import quality_classifier
from inkwell.llm.token_counts import length_histogram, token_lengths
from inkwell.llm.toxicity import telling_places, toxicity


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, "a b " * 30, "p", 1), (1, "a b " * 30, "p", 1), (1, None, None, 2), (None, "", "p", 1),
        (2, "you idiot scum " * 20, None, None),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, pattern string, _x int")


def test_quality_classifier(docs):
    found = sorted((r["doc_id"] or 0, r["pattern"]) for r in quality_classifier(docs).collect())
    assert found == [(0, "0--------"), (1, "0--------"), (1, "110101101"), (1, "110101101"), (2, "110101101")]
    assert quality_classifier(docs.limit(0)).collect() == []


def test_toxicity(spark, docs):
    rows = [(k, f"you idiot scum n{k}" if k % 2 else f"a fine text n{k}", k, "") for k in range(60)]
    rows += [(1, "you idiot scum n1", 0, ""), (101, "what an idiot", 0, ""), (102, "what a text", 0, ""), (103, None, 0, ""), (None, "scum idiot", 0, "")]
    many = spark.createDataFrame(rows, "doc_id long, text string, quality int, p_toxic string")
    known = [(k, k % 4 // 2, k % 2) for k in range(60)] + [(1, 0, 1), (None, 1, 1), (999, 1, 1), (3, 1, None), (5, None, 1)]
    labels = spark.createDataFrame(known, "doc_id long, quality int, toxic int")
    found = {(r["doc_id"], r["toxic"]) for r in toxicity(many, labels).filter("doc_id IS NULL OR doc_id <> 103").collect()}
    assert found == {*((k, k % 2 == 1) for k in range(60)), (101, True), (102, False), (None, True)}
    assert toxicity(many, labels).count() == 65 and toxicity(many.limit(0), labels).count() == 0
    few = toxicity(docs, labels.filter("doc_id IN (2, 4)"))  # one kind only
    assert {r["p_toxic"] for r in few.collect()} == {0.0}
    assert [r["toxic"] for r in toxicity(docs, labels.limit(0)).collect()] == [None] * 5


def test_telling_places():
    yes, no = np.array([30.0, 3, 0, 40, 0]), np.array([0.0, 2, 0, 98, 90])
    assert telling_places(yes, no, 40, 100).tolist() == [0, 4]
    assert telling_places(np.zeros(0), np.zeros(0), 1, 1).tolist() == []


def test_length_histogram(docs):
    assert length_histogram(token_lengths(docs), [4, 8]).count() == 5
    assert length_histogram(token_lengths(docs.limit(0)), [4]).first()["n_docs"] == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="the tables are not here")
def test_quality_agrees_with_labels_it_has_not_seen(spark):
    """The classifier is trained without labels; the table of labels judges it."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = quality_classifier(docs).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"), F.count("*").alias("n"))
    kept = {r.quality: r.kept for r in got.collect()}
    assert kept[1] > 0.9 and kept[0] < 0.2


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="the tables are not here")
def test_toxicity_on_documents_it_was_not_trained_on(spark):
    """Trained on the labels of three quarters of the documents, judged on the others and by text, so that copies do not help."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    part = docs.withColumn("_out", F.pmod(F.xxhash64("text"), F.lit(4)) == 0).select("doc_id", "_out")
    known = labels.join(part.filter("NOT _out"), "doc_id")
    judged = toxicity(docs, known).drop("toxic").join(labels, "doc_id").join(part.filter("_out"), "doc_id")
    share = {r.toxic: r.share for r in judged.groupBy("toxic").agg(F.avg((F.col("p_toxic") >= 0.5).cast("int")).alias("share")).collect()}
    assert share[1] > 0.8 and share[0] < 0.02
