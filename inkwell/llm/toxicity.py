"""Operator 9: toxicity by classifier chains.

Categories are predicted one after another with logistic regressions on hashed words; each later model
also gets the probabilities of the earlier categories. In training those probabilities come from
out-of-fold models (a document never sees a model that was trained on it), so the later models learn from
predictions as they will be at scoring time. Training uses at most about ``max_train`` labelled documents
(a hash sample); every document is scored.

The labelled table says of a document whether its quality is low and whether it is toxic. The categories of
the chain are ``CATEGORIES``, conditions over these columns: toxic text inside clutter, toxic text in good
prose, and toxic text of any kind, which leans on the links before it. No word list goes into them: a link
keeps the places of the hash table whose words go with its label (chi-square test, error ``LEVEL`` over all
places together, on the documents it is trained on) and learns their weights. Without that choice a model
with more words than documents leans on words that one document holds.

Defined cases: a null text has no words; a null label leaves the document out of the links that need it, and
labels of unknown documents are left out; repeated labels count each; a category with labels of one kind only
gets the share of that kind as its probability, one without telling words and without earlier links the share
of its label; a fold that has all labelled documents learns from 0.5; without any labelled document all
probabilities are null; repeated rows are judged alike and stay; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from multiprocessing.pool import ThreadPool
from statistics import NormalDist
from typing import NamedTuple

import numpy as np
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from .features import TASKS, bounded, fit, hashed, score, words
from .workspace import Workspace, table

SIZE = 1 << 18
LEVEL = 0.05
#: Models that are fitted at a time; each brings two vectors of ``SIZE`` numbers to the driver.
PARALLEL = 1
#: The links of the chain, in order, over the columns of the labelled table.
CATEGORIES = {
    "toxic_clutter": "toxic = 1 AND quality = 0",
    "toxic_prose": "toxic = 1 AND quality = 1",
    "toxic": "toxic = 1",
}


class Link(NamedTuple):
    """A learned link: a model over the words at some places, or one probability for all (None: unknown)."""

    places: list[int]
    model: LogisticRegressionModel | float | None


def telling_places(yes: np.ndarray, no: np.ndarray, n_yes: float, n_no: float, level: float = LEVEL) -> np.ndarray:
    """Places whose words go with a label: documents with a word there, with and without the label, and documents in all."""
    total, n = yes + no, n_yes + n_no
    seen = np.flatnonzero((total > 0) & (total < n))
    a, b = yes[seen], no[seen]
    chi = n * (a * (n_no - b) - b * (n_yes - a)) ** 2 / ((a + b) * (n - a - b) * n_yes * n_no)
    least = NormalDist().inv_cdf(1 - level / (2 * max(1, len(seen)))) ** 2
    return seen[chi > least]


def _with_earlier(df: DataFrame, places: list[int], earlier: list[str]) -> DataFrame:
    """Adds ``_z``, the features of a link: the words at its places, then the earlier probabilities."""
    if places:
        df = VectorSlicer(inputCol="_x", outputCol="_at", indices=places).transform(df)
    both = VectorAssembler(inputCols=["_at"] * bool(places) + earlier, outputCol="_z", handleInvalid="keep").transform(df)
    return both.withMetadata("_z", {}).drop("_at")


def _learn(train: DataFrame, label: str, earlier: list[str]) -> Link:
    """The link for ``label``; where that has one value only that value."""
    train = train.filter(F.col(label).isNotNull())
    rows = train.coalesce(TASKS).groupBy(label).agg(Summarizer.sum(F.col("_x"), F.col("_weight")).alias("s"), F.sum("_weight").alias("n")).collect()
    seen = {r[label]: (r["s"].toArray(), r["n"]) for r in rows}  # at most two
    if len(seen) < 2:
        return Link([], next(iter(seen), None))
    (no, n_no), (yes, n_yes) = seen[0.0], seen[1.0]
    places = telling_places(yes, no, n_yes, n_no).tolist()
    if not places and not earlier:
        return Link([], n_yes / (n_yes + n_no))
    return Link(places, fit(_with_earlier(train, places, earlier), "_z", label, weight="_weight", reg=1e-4, iterations=25))


def _judge(link: Link, df: DataFrame, earlier: list[str], name: str) -> DataFrame:
    """Adds the probability ``name`` that a learned link gives."""
    if not isinstance(link.model, LogisticRegressionModel):
        return df.withColumn(name, F.lit(link.model).cast("double"))
    return score(link.model, _with_earlier(df, link.places, earlier), "_z", name).drop("_z")


def classifier_chain(train: DataFrame, df: DataFrame, labels: list[str], space: Workspace, folds: int = 3) -> DataFrame:
    """Adds one probability ``p_<label>`` per label to ``df``.

    Both tables have features ``_x``; ``train`` has the label columns as 0.0 or 1.0, ``_weight`` and
    ``_fold``. The models of a link, of all folds and of each fold's complement, are fitted side by side.
    """
    spark, earlier = train.sparkSession, []
    for label in labels:
        name, last = f"p_{label}", label == labels[-1]
        sets = [train, *[train.filter(F.col("_fold") != k) for k in range(0 if last else folds)]]
        learn = inheritable_thread_target(spark)(lambda part, label=label, earlier=earlier: _learn(part, label, earlier))
        with ThreadPool(PARALLEL) as pool:
            whole, *others = pool.map(learn, sets)
        df = _judge(whole, df, earlier, name)
        if not last:
            parts = [
                _judge(link if link.model is not None else Link([], 0.5), train.filter(F.col("_fold") == k), earlier, name)
                for k, link in enumerate(others)
            ]
            out = parts[0]
            for p in parts[1:]:
                out = out.unionByName(p)
            train = space.save(out, f"after-{label}")
        earlier = [*earlier, name]
    return df


def toxicity(
    df: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    categories: dict[str, str] = CATEGORIES,
    flag: str = "toxic",
    max_train: int = 20_000,
    folds: int = 3,
    threshold: float = 0.5,
) -> DataFrame:
    """doc_id, p_<category> of every category, and whether that of ``flag`` reaches the threshold, for every document."""
    spark = df.sparkSession
    space = Workspace(spark, "toxicity")
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    chain = list(categories)
    said = labels.select("doc_id", *[F.expr(f"CAST({e} AS DOUBLE)").alias(k) for k, e in categories.items()])
    known = said.filter(F.col("doc_id").isNotNull() & F.coalesce(*chain).isNotNull())
    known = known.groupBy("doc_id", *chain).agg(F.count("*").cast("double").alias("_weight"))
    known = bounded(known, "doc_id", known.count(), max_train)
    # A few rows at most for each of about max_train documents.
    texts = rows.join(F.broadcast(known), "doc_id").withColumn("_words", words("text"))
    marked = texts.withColumn("_fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(folds)))
    train = space.save(hashed(marked, "_words", "_x", SIZE, binary=True, unit=False).select("_x", "_fold", "_weight", *chain), "train")
    every = hashed(rows.withColumn("_words", words("text")), "_words", "_x", SIZE, binary=True, unit=False)
    judged = classifier_chain(train, every.select("doc_id", "_x"), chain, space, folds)
    return judged.select("doc_id", *[f"p_{k}" for k in chain], (F.col(f"p_{flag}") >= threshold).alias("toxic"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
