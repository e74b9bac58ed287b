"""Distinct counts that are exact for small sets and bounded for large ones: the k smallest hashes of a set.

Up to k - 1 members all hashes are there, and their number is the count. Beyond, the k-th smallest says how dense they
are: the count is estimated with a relative standard error of 1 / sqrt(k - 2). The k smallest of several sketches
are the sketch of the union, so sketches of seconds merge into those of any window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hashes of a sketch: counts below it are exact, the standard error beyond is 6.3%.
KEPT = 256
#: Parts in which a key's hashes are cut down first, so that a key with very many members spreads over tasks.
PARTS = 64


def _smallest(hashes: DataFrame, keys: list[str], kept: int) -> DataFrame:
    """keys, sketch (the `kept` smallest different hashes in order) from rows of keys and h."""
    rows = hashes.select(*keys, "h", F.pmod(F.xxhash64("h"), F.lit(PARTS)).alias("_part")).distinct()
    for by in ([*keys, "_part"], keys):
        rows = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy("h"))).filter(F.col("_rank") <= kept)
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list("h")).alias("sketch"))


def distinct_sketch(rows: DataFrame, keys: list[str], item: Column, kept: int = KEPT) -> DataFrame:
    """keys and the sketch of each key's items; null items don't count."""
    return _smallest(rows.select(*keys, F.when(item.isNotNull(), F.xxhash64(item)).alias("h")).dropna(subset=["h"]), keys, kept)


def merged(sketches: DataFrame, keys: list[str], kept: int = KEPT) -> DataFrame:
    """keys and the sketch of the union of their sketches."""
    return _smallest(sketches.select(*keys, F.explode("sketch").alias("h")), keys, kept)


def trailing(sketches: DataFrame, keys: list[str], bucket: str, width: int, kept: int = KEPT) -> DataFrame:
    """keys, bucket and the sketch of the last `width` buckets, at every bucket that has one of its own."""
    spread = sketches.select(*keys, F.explode(F.sequence(F.col(bucket), F.col(bucket) + width - 1)).alias(bucket), "sketch")
    own = sketches.select(*keys, bucket)
    return merged(spread.join(own, [*keys, bucket], "left_semi"), [*keys, bucket], kept)


def count_of(sketch: Column, kept: int = KEPT) -> Column:
    """The count: exact if the sketch isn't full, else estimated."""
    share = (F.element_at(sketch, -1).cast("double") + F.lit(float(2**63))) / F.lit(float(2**64))
    return F.when(F.size(sketch) < kept, F.size(sketch).cast("long")).otherwise(F.round((kept - 1) / share).cast("long"))


def is_estimate(sketch: Column, kept: int = KEPT) -> Column:
    return F.size(sketch) >= kept
