"""Hashed features and linear models that several classifiers share (Spark ML, on the JVM)."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Training tables are bounded samples, so a fixed number of tasks reads them on each iteration.
TASKS = 4


def words(text: str) -> Column:
    """Lower-case runs of characters other than white space and ASCII punctuation; null text: none."""
    clean = F.lower(F.coalesce(F.col(text), F.lit("")))
    return F.filter(F.split(clean, r"[\s!-/:-@\[-`{-~]+"), lambda x: x != "")


def hashed(df: DataFrame, tokens: str, features: str, size: int, binary: bool = False, unit: bool = True) -> DataFrame:
    """Adds the hashed token counts, or with ``binary`` ones, scaled to length 1 with ``unit``."""
    if not unit:
        return HashingTF(inputCol=tokens, outputCol=features, numFeatures=size, binary=binary).transform(df)
    counts = HashingTF(inputCol=tokens, outputCol=f"_{features}", numFeatures=size, binary=binary)
    return Normalizer(inputCol=f"_{features}", outputCol=features).transform(counts.transform(df)).drop(f"_{features}")


def fit(train: DataFrame, features: str, label: str, weight: str | None = None, reg: float = 1e-4, iterations: int = 40, standardize: bool = False) -> LogisticRegressionModel:
    model = LogisticRegression(
        featuresCol=features, labelCol=label, regParam=reg, maxIter=iterations, standardization=standardize, tol=1e-4,
        **({"weightCol": weight} if weight else {}),
    )
    return model.fit(train.coalesce(TASKS))


def score(model: LogisticRegressionModel, df: DataFrame, features: str, name: str) -> DataFrame:
    """Adds column ``name``: the model's probability of label 1."""
    model = model.copy().setFeaturesCol(features).setProbabilityCol("_p").setRawPredictionCol("").setPredictionCol("")
    return model.transform(df).withColumn(name, vector_to_array("_p")[1]).drop("_p")


def hash_below(key: Column, share: float) -> Column:
    """A fixed pseudo-random selection of about ``share`` of the keys; the same on every run."""
    return F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30))


def bounded(df: DataFrame, key: str, count: int, most: int) -> DataFrame:
    """``df`` itself if it has at most ``most`` rows, else a hash sample of about that many."""
    return df if count <= most else df.filter(hash_below(F.col(key), most / count))
