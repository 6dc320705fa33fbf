"""Supervised head on score, severity and features."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, functions as F

from ..functions.features import FEATURE_NAMES, feature_columns
from ..functions.levels import severity
from ..runtime import number_ordered
from .evaluate import prf1

COLUMNS = ["score", "severity_scaled", *FEATURE_NAMES]


def feature_matrix(scored: DataFrame) -> DataFrame:
    """Score, severity / 7 and the fourteen features as plain columns."""
    out = scored.withColumn("severity_scaled", severity("level") / 7.0)
    return out.withColumns(feature_columns("level", "service", "message"))


def stratified_split(df: DataFrame, key: str, label: str = "label", test_size: float = 0.4, seed: int = 0) -> DataFrame:
    """Add ``is_test``: the first ``test_size`` of each label in hash order.

    Positions come from one distributed numbering of (label, hash, key), so a
    label may hold any share of the rows.
    """
    placed = number_ordered(df, [F.col(label), F.xxhash64(key, F.lit(seed)), F.col(key)], "_pos")
    spans = placed.groupBy(label).agg(F.min("_pos").alias("_from"), F.count(F.lit(1)).alias("_n"))
    return (placed.join(F.broadcast(spans), label)                       # one row per label
            .withColumn("is_test", F.col("_pos") - F.col("_from") < F.round(F.col("_n") * test_size))
            .drop("_pos", "_from", "_n"))


def balanced_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """n / (classes · class count) per row."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    n = counts.select(F.sum("_c").alias("n")).scalar()
    k = counts.select(F.count(F.lit(1)).alias("k")).scalar()
    return df.join(F.broadcast(counts), label).withColumn("weight", n / (k * F.col("_c"))).drop("_c")


def fit_head(train: DataFrame, model: str = "rf", label: str = "label", trees: int = 300, seed: int = 0, max_iter: int = 1000):
    """Random forest (``rf``) or logistic regression (``lr``) with balanced class weights."""
    assembler = VectorAssembler(inputCols=COLUMNS, outputCol="features")
    if model == "rf":
        clf = RandomForestClassifier(labelCol=label, featuresCol="features", weightCol="weight", numTrees=trees,
                                     maxDepth=12, featureSubsetStrategy="sqrt", seed=seed)
    elif model == "lr":
        clf = LogisticRegression(labelCol=label, featuresCol="features", weightCol="weight", maxIter=max_iter, regParam=1e-4)
    else:
        raise ValueError("model is 'rf' or 'lr'")
    return Pipeline(stages=[assembler, clf]).fit(balanced_weights(train, label))


def train_and_evaluate(labelled: DataFrame, key: str, label: str = "label", model: str = "rf", test_size: float = 0.4,
                       seed: int = 0, trees: int = 300) -> DataFrame:
    """Fit on 60 % and measure on 40 %: one row of confusion counts, P, R and F1."""
    # only the key, the label and the columns of the head travel, not the texts
    split = stratified_split(labelled.select(key, label, *COLUMNS), key, label, test_size, seed)
    fitted = fit_head(split.filter("not is_test"), model, label, trees, seed)
    predicted = fitted.transform(split.filter("is_test"))
    return prf1(predicted, label, F.col("prediction") > 0.5)
