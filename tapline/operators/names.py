"""Lexical features of domain names, and a linear classifier of generated ones."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapline.functions import columns as fn

#: Hashed letter pairs of a label.
BUCKETS = 32


def features(label: Column) -> Column:
    """An array of doubles: length, entropy, class ratios and runs, then shares of hashed letter pairs."""
    framed = F.concat(F.lit("^"), label, F.lit("$"))
    pairs = F.transform(F.sequence(F.lit(1), F.length(framed) - 1), lambda i: fn.fnv1a32(F.substring(framed, i, F.lit(2))) % BUCKETS)
    shares = F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda b: F.size(F.filter(pairs, lambda p: p == b)) / F.size(pairs))
    unique = F.size(F.array_distinct(F.split(label, ""))) / F.greatest(F.length(label), F.lit(1))
    plain = [F.length(label), fn.entropy(label), fn.class_ratio(label, "0-9"), fn.class_ratio(label, "aeiou"), fn.class_ratio(label, "bcdfghjklmnpqrstvwxyz"), fn.longest_run(label, "bcdfghjklmnpqrstvwxyz"), fn.longest_run(label, "0-9"), fn.class_ratio(label, "-") * F.length(label), unique, fn.class_ratio(label, "0-9a-f")]
    return F.concat(F.array(*(F.coalesce(c.cast("double"), F.lit(0.0)) for c in plain)), F.transform(shares, lambda x: F.coalesce(x, F.lit(0.0))))


def train(rows: DataFrame, penalty: float = 1e-3) -> LogisticRegressionModel:
    """A ridge logistic model on standardised features of rows (label string, generated 0 or 1)."""
    made = rows.select(F.col("generated").cast("double").alias("label"), array_to_vector(features(F.col("label"))).alias("features"))
    return LogisticRegression(regParam=penalty, standardization=True, maxIter=50).fit(made)


def score(rows: DataFrame, model: LogisticRegressionModel) -> DataFrame:
    """The rows with p, the probability that their label is generated."""
    made = model.transform(rows.withColumn("features", array_to_vector(features(F.col("label")))))
    return made.withColumn("p", F.element_at(vector_to_array("probability"), 2)).drop("features", "rawPrediction", "probability", "prediction")
