"""Operator 2: quality classifier from weak labels.

Nine heuristic labellers vote good, bad or nothing on every document. Expectation-maximisation over the
votes estimates how often each labeller is right about good and about bad documents, without any true
label. Votes have at most 3^9 patterns, so the corpus is first counted by pattern in Spark and the
estimation runs on that bounded table; it uses all documents. The posterior of each pattern then labels
the documents, and a logistic regression on hashed words is trained on them, each document counting with
its posterior; at most about ``max_train`` documents (a hash sample) are used for that. The scorer
judges every document.

Defined cases: a null text has no words and is bad by its length; repeated rows are judged alike and
stay; if the posteriors of the sample are all on one side the posterior itself is the score; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .expressions import let
from .features import bounded, fit, hashed, score
from .quality_rules import SPACE, repeat_words
from .workspace import Workspace, table

SIZE = 1 << 15
#: Common function words of the four languages.
FUNCTION_WORDS = (
    "the of and to in is that it was for on are with as this be by from at he "
    "le la les de des et en un une du que qui dans pour est sur pas au avec "
    "der die das und den von zu mit sich des auf ist im dem nicht ein eine "
    "el los las y del se por con su para es lo una al como"
).split()
LABELLERS = ("length", "symbols", "repeats", "capitals", "function_words", "exclaims", "tables", "variety", "runs")


def votes(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``pattern``: one character per labeller, 1 good, 0 bad, - no vote."""
    whole = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(whole, SPACE, -1), lambda w: w != "")

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).alias("n_words"),
            repeat_words(w).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(FUNCTION_WORDS))).alias("_function"),
            F.size(F.filter(w, lambda x: x == "|")).alias("_bars"),
            F.size(F.array_distinct(w)).alias("_distinct"),
            F.size(F.filter(w, lambda x, i: x == F.get(w, i - 1))).alias("_runs"),
        )

    without = lambda signs: F.length(whole) - F.length(F.translate(whole, signs, ""))
    counted = df.withColumns(
        {
            "_of_words": let(words, of_words),
            "word_chars": F.length(F.translate(whole, " \t\n\x0b\f\r", "")),
            "n_symbols": without("#*$%&|<>"),
            "_upper": F.length(whole) - F.length(F.regexp_replace(whole, r"\p{Lu}", "")),
            "_exclaims": without("!"),
        }
    ).select("*", "_of_words.*")
    n = F.col("n_words")

    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, "0").when(good, "1").otherwise("-")

    share = lambda c, percent: F.col(c) * 100 > n * percent
    rules = {
        "length": vote(n < 20, n >= 40),
        "symbols": vote(share("n_symbols", 30), ~share("n_symbols", 5)),
        "repeats": vote(share("n_repeat_words", 30), ~share("n_repeat_words", 10)),
        "capitals": vote(F.col("_upper") * 2 > F.col("word_chars"), F.col("_upper") * 5 < F.col("word_chars")),
        "function_words": vote(~share("_function", 1), share("_function", 8)),
        "exclaims": vote(share("_exclaims", 20), ~share("_exclaims", 3)),
        "tables": vote(share("_bars", 10), ~share("_bars", 3)),
        "variety": vote(~share("_distinct", 15), share("_distinct", 35)),
        "runs": vote(share("_runs", 25), ~share("_runs", 10)),
    }
    pattern = F.concat(*[F.when(n > 0, rules[k]).otherwise("0" if k == "length" else "-") for k in LABELLERS])
    return counted.select(*df.columns, pattern.alias("pattern"))


def expectation_maximisation(patterns: list[str], counts: list[int], steps: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of good per pattern, accuracies (labeller, class bad/good), share of good documents."""
    v = np.array([[{"0": 0, "1": 1, "-": -1}[c] for c in p] for p in patterns]).reshape(len(patterns), -1)
    n = np.array(counts, float)
    cast = (v >= 0).sum(1)
    post = np.where(cast > 0, (v == 1).sum(1) / np.maximum(cast, 1), 0.5)
    # A single bad vote is strong evidence at the start: each heuristic looks for one kind of fault.
    post = np.where((v == 0).any(1), np.minimum(post, 0.3), post)
    for _ in range(steps):
        right = np.empty((v.shape[1], 2))
        for j in range(v.shape[1]):
            for k, w in ((0, 1 - post), (1, post)):
                right[j, k] = ((n * w)[v[:, j] == k].sum() + 1) / ((n * w)[v[:, j] >= 0].sum() + 2)
        share = ((n * post).sum() + 1) / (n.sum() + 2)
        good, bad = np.full(len(n), np.log(share)), np.full(len(n), np.log1p(-share))
        for j in range(v.shape[1]):
            good += np.select([v[:, j] == 1, v[:, j] == 0], [np.log(right[j, 1]), np.log1p(-right[j, 1])], 0)
            bad += np.select([v[:, j] == 1, v[:, j] == 0], [np.log1p(-right[j, 0]), np.log(right[j, 0])], 0)
        new = 1 / (1 + np.exp(np.clip(bad - good, -500, 500)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return post, right, float(share)


def quality_tokens(text: str) -> Column:
    """Words with marks for repetition, shouting and attached symbols."""
    raw = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def marked(w: Column) -> Column:
        shape = F.transform(
            w,
            lambda x, i: F.when(x == F.get(w, i - 1), "#same")
            .when(x.rlike(r"[#*$%&<>]"), "#sign").when(x == "|", "#bar").when(x.rlike("!!"), "#shout")
            .otherwise("#word"),
        )
        return F.concat(F.transform(w, F.lower), shape)

    return let(raw, marked)


def quality_classifier(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", max_train: int = 20_000, threshold: float = 0.5
) -> DataFrame:
    """doc_id, pattern, posterior, score, kept for every document."""
    spark = df.sparkSession
    space = Workspace(spark, "quality-classifier")
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    marked = rows.withColumn("_text", F.xxhash64("text"))
    voted = space.save(votes(marked).select("doc_id", "_text", "pattern"), "votes")
    found = voted.groupBy("pattern").count().orderBy("pattern").collect()  # at most 3^9 rows
    if not found:
        return voted.select("doc_id", "pattern", *[F.lit(None).cast(k).alias(c) for c, k in (("posterior", "double"), ("score", "double"), ("kept", "boolean"))])
    post, _, _ = expectation_maximisation([r["pattern"] for r in found], [r["count"] for r in found])
    known = F.broadcast(
        spark.createDataFrame([(r["pattern"], float(p)) for r, p in zip(found, post, strict=True)], "pattern string, posterior double")
    )
    features = lambda d: hashed(d.withColumn("_tokens", quality_tokens("text")), "_tokens", "_x", SIZE).drop("_tokens")

    total = sum(r["count"] for r in found)
    # The votes are not counted again: they meet texts and scores by document and hash of the text.
    once = voted.dropDuplicates(["doc_id", "_text"]).select(F.col("doc_id").alias("_doc"), F.col("_text").alias("_same"), "pattern")
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_text") == F.col("_same"))
    # About max_train rows at most.
    few = F.broadcast(bounded(once, "_doc", total, max_train))
    sample = features(bounded(marked, "doc_id", total, max_train).join(few, same).join(known, "pattern"))
    sides = F.explode(
        F.array(
            F.struct(F.lit(1.0).alias("y"), F.col("posterior").alias("w")),
            F.struct(F.lit(0.0).alias("y"), (1 - F.col("posterior")).alias("w")),
        )
    )
    train = space.save(sample.select("_x", sides.alias("s")).select("_x", "s.*").filter("w > 0.001"), "train")
    if train.select("y").distinct().count() == 2:
        scored = score(fit(train, "_x", "y", "w", reg=0.01, standardize=True), features(marked), "_x", "score")
        judged = scored.select("doc_id", "_text", "score").join(once, same).join(known, "pattern")
    else:
        judged = voted.join(known, "pattern").withColumn("score", F.col("posterior"))
    return judged.select("doc_id", "pattern", "posterior", "score", (F.col("score") >= threshold).alias("kept"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(table(spark, sf_dir, "documents"))
