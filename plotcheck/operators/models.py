"""Classifier training with grouped folds, scoring, and the table they learn from."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plotcheck.operators.evaluation import group_kfold
from plotcheck.operators.spatial import exclude_near


def balanced(rows: DataFrame, label: str) -> DataFrame:
    """Rows with a weight that gives each class the same sum."""
    n = rows.groupBy(label).agg(F.count("*").alias("of_class"))
    total, classes = F.sum("of_class").over(W.partitionBy()), F.count("*").over(W.partitionBy())
    n = n.select(label, (total / (classes * F.col("of_class"))).alias("weight"))
    return rows.join(F.broadcast(n), label)


def _forest(seed: int) -> RandomForestClassifier:
    return RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="weight", numTrees=20, maxDepth=5, seed=seed)


def fit(rows: DataFrame, seed: int = 1) -> RandomForestClassificationModel:
    """A class-balanced forest from rows (label, embedding)."""
    return _forest(seed).fit(balanced(rows.withColumn("features", array_to_vector(F.col("embedding").cast("array<double>"))), "label"))


def score(rows: DataFrame, model: RandomForestClassificationModel) -> DataFrame:
    out = model.transform(rows.withColumn("features", array_to_vector(F.col("embedding").cast("array<double>"))))
    return out.select("cand_id", F.col("prediction").cast("int").alias("predicted"), vector_to_array("probability").alias("p"))


def out_of_fold(rows: DataFrame, group: str, folds: int = 5) -> DataFrame:
    """Predictions of each row by a model that has not seen its group."""
    dealt = group_kfold(rows, group, folds, "folds").cache()
    parts = [score(dealt.filter(F.col("fold") == k), fit(dealt.filter(F.col("fold") != k))) for k in range(folds)]
    return reduce(lambda a, b: a.unionByName(b), parts)


def training_table(candidates: DataFrame, extra: DataFrame, contributions: DataFrame, test: DataFrame, r: float) -> DataFrame:
    """Candidates, further positives and contributions with their source, without those within ``r`` of test places."""
    rows = reduce(lambda a, b: a.unionByName(b), [d.select("id", "klasse", "x", "y", F.lit(name).alias("source")) for name, d in (("dev", candidates), ("extra", extra), ("contribution", contributions))])
    keyed = rows.withColumn("key", F.concat_ws(":", "source", "id"))
    return exclude_near(keyed, test, r, "key").select("id", "klasse", "x", "y", "source")
