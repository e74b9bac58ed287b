"""Bounds on what is written: clean findings, limited quarantine, paced feature snapshots."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the alert contract: longest texts, and most entries of lists and maps.
LONGEST = {"explanation": 1024, "entity_key": 320, "name": 255, "detail": 200}
MOST_IDS, MOST_ENTRIES = 32, 16


def clean_score(score: Column) -> Column:
    """A score between 0 and 1 with six digits, half to even; null for what is no number."""
    usable = score.isNotNull() & ~F.isnan(score) & (F.abs(score) != float("inf"))
    return F.when(usable, F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6))


def clipped(text: Column, field: str) -> Column:
    return F.substring(text, 1, LONGEST[field])


def last_ids(ids: Column, most: int = MOST_IDS) -> Column:
    """The last distinct identifiers, in order of their last appearance being kept once."""
    distinct = F.array_distinct(ids)
    return F.slice(distinct, F.greatest(F.lit(1), F.size(distinct) - most + 1), most)


def capped_map(values: Column, most: int = MOST_ENTRIES) -> Column:
    """The first entries of a map by key."""
    return F.map_from_entries(F.slice(F.array_sort(F.map_entries(values)), 1, most))


def rate_limited(df: DataFrame, second: Column, order: list[str], most: int = 200) -> DataFrame:
    """At most `most` rows of each second, the first in order; the split by second keeps windows small."""
    rows = df.withColumn("_second", second)
    first = F.row_number().over(Window.partitionBy("_second").orderBy(*order))
    return rows.withColumn("_rank", first).filter(F.col("_rank") <= most).drop("_second", "_rank")


def paced(df: DataFrame, keys: list[str], at: str, interval: int) -> DataFrame:
    """Rows of each key that come at least `interval` after the last row kept; the first is always kept."""
    rest = [c for c in df.columns if c not in [*keys, at]]
    rows = df.repartition(*keys).sortWithinPartitions(*keys, at, *rest)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = None, None
        for batch in batches:
            keep = []
            for own, moment in zip(batch[keys].itertuples(index=False, name=None), batch[at]):
                fresh = own != key or moment - last >= interval
                key, last = own, moment if fresh else last
                keep.append(fresh)
            yield batch[keep]

    return rows.mapInPandas(run, df.schema)
