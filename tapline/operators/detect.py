"""Detectors in set form: distinct counts and sums over windows, with thresholds and column roles as parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distinct_peers(df: DataFrame, by: list[str], peer: str, threshold: int, name: str) -> DataFrame:
    """Groups with at least `threshold` distinct peers, and a severity: high from five times the threshold."""
    found = df.groupBy(*by).agg(F.countDistinct(peer).alias(name)).filter(F.col(name) >= threshold)
    return found.withColumn("severity", F.when(F.col(name) >= 5 * threshold, "high").otherwise("medium"))


def trailing(key: list[str], ms: str, horizon_ms: int):
    """The rows of a key from `horizon_ms` before a row's time up to it."""
    return Window.partitionBy(*key).orderBy(ms).rangeBetween(-horizon_ms, 0)


def beacon_regularity(df: DataFrame, pair: list[str], ms: str, least: int = 8) -> DataFrame:
    """n, median interval and robust variation (1.4826 * MAD / median) of each pair's distinct start times."""
    starts = df.select(*pair, ms).distinct()
    steps = starts.withColumn("iat", F.col(ms) - F.lag(ms).over(Window.partitionBy(*pair).orderBy(ms)))
    middle = steps.groupBy(*pair).agg(F.count("*").alias("n"), F.percentile("iat", F.lit(0.5)).alias("median")).filter((F.col("n") >= least) & (F.col("median") > 0))
    spread = steps.filter("iat IS NOT NULL").join(middle, pair).groupBy(*pair, "n", "median").agg(F.percentile(F.abs(F.col("iat") - F.col("median")), F.lit(0.5)).alias("mad"))
    return spread.withColumn("cv", 1.4826 * F.col("mad") / F.col("median"))


def weighted_indicators(df: DataFrame, indicators: dict[str, tuple[Column, float]], least: int = 3) -> DataFrame:
    """available, positive, score: positive weight over available weight; null with fewer than `least` available."""
    available = sum((F.when(c.isNotNull(), 1).otherwise(0) for c, _ in indicators.values()), F.lit(0))
    positive = sum((F.when(c, 1).otherwise(0) for c, _ in indicators.values()), F.lit(0))
    mass = sum((F.when(c.isNotNull(), w).otherwise(0.0) for c, w in indicators.values()), F.lit(0.0))
    hit = sum((F.when(c, w).otherwise(0.0) for c, w in indicators.values()), F.lit(0.0))
    return df.withColumn("available", available).withColumn("positive", positive).withColumn("score", F.when(available >= least, hit / mass))
