"""Exact running and trailing numbers without arrays of members: contacts as intervals, swept by sums of +1 and -1.

A member counts within a horizon from its first contact until the horizon after its last, and anew after a longer
pause. So the distinct members at a time are the intervals begun less those ended, a running sum over changes. Nothing
grows with the number of members. Every order is cut into blocks of time: sums run within blocks, and each block is
shifted by the totals of those before it, so a key that holds most of the rows still spreads over tasks.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Horizons in a block of time, if no width is given.
BLOCK_HORIZONS = 20


def running_sums(changes: DataFrame, keys: list[str], at: str, values: list[str], block: int, mark: str | None = None) -> DataFrame:
    """keys, at and the sum of each value over the key's rows at or before `at`: one row for each different time.

    Null values count as 0. Rows of one time count together; a boolean `mark` is kept, true if one of them has it.
    """
    named, marks = [f"_sum{i}" for i in range(len(values))], [mark] if mark else []
    steps = changes.groupBy(*keys, at).agg(*(F.coalesce(F.sum(v), F.lit(0)).alias(n) for v, n in zip(values, named)), *(F.max(m).alias(m) for m in marks))
    steps = steps.withColumn("_block", F.floor(F.col(at) / block))
    totals = steps.groupBy(*keys, "_block").agg(*(F.sum(n).alias(n) for n in named))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    shift = totals.select(*keys, "_block", *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{n}_before") for n in named))
    within = Window.partitionBy(*keys, "_block").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    rows = steps.select(*keys, at, "_block", *marks, *(F.sum(n).over(within).alias(n) for n in named))
    joined = rows.join(shift, [*keys, "_block"])
    return joined.select(*keys, at, *marks, *((F.col(n) + F.col(f"{n}_before")).alias(v) for v, n in zip(values, named)))


def intervals(contacts: DataFrame, keys: list[str], item: list[str], at: str, horizon: int, block: int | None = None) -> DataFrame:
    """keys, item, at, begins, ends of each contact: whether it opens or closes an interval of its member.

    A contact opens one if the one before is more than `horizon` back, and closes one if the next is as far ahead; of
    several at one time the first may open one, and the last close it.
    """
    block = block or BLOCK_HORIZONS * max(horizon, 1)
    own = [*keys, *item]
    rows = contacts.select(*own, at).withColumn("_block", F.floor(F.col(at) / block))
    edges = rows.groupBy(*own, "_block").agg(F.min(at).alias("_first"), F.max(at).alias("_last"))
    over = Window.partitionBy(*own).orderBy("_block")
    edges = edges.select(*own, "_block", F.lag("_last").over(over).alias("_before"), F.lead("_first").over(over).alias("_after"))
    near = Window.partitionBy(*own, "_block").orderBy(at)
    rows = rows.withColumns({"_lag": F.lag(at).over(near), "_lead": F.lead(at).over(near)}).join(edges, [*own, "_block"])
    back, ahead = F.col(at) - F.coalesce("_lag", "_before"), F.coalesce("_lead", "_after") - F.col(at)
    return rows.select(*own, at, F.coalesce(back > horizon, F.lit(True)).alias("begins"), F.coalesce(ahead > horizon, F.lit(True)).alias("ends"))


def trailing_distinct(contacts: DataFrame, keys: list[str], item: list[str], at: str, horizon: int, points: DataFrame | None = None, name: str = "n", block: int | None = None) -> DataFrame:
    """keys, at, n: the different items that the key met from `at` - horizon to `at`, at each time of a contact.

    With `points` (keys and at), at these times instead. Rows with a null key, item or time meet nothing.
    """
    rows = contacts.dropna(subset=[*keys, *item, at])
    spans = intervals(rows, keys, item, at, horizon, block)
    met = F.struct(F.col(at).alias(at), F.col("begins").cast("long").alias("_step"), F.lit(points is None).alias("_asked"))
    gone = F.struct((F.col(at) + horizon + 1).alias(at), F.lit(-1).cast("long").alias("_step"), F.lit(False).alias("_asked"))
    changes = spans.select(*keys, F.explode(F.when(F.col("ends"), F.array(met, gone)).otherwise(F.array(met))).alias("c")).select(*keys, "c.*")
    if points is not None:
        changes = changes.unionByName(points.select(*keys, at, F.lit(0).cast("long").alias("_step"), F.lit(True).alias("_asked")).dropna())
    counted = running_sums(changes, keys, at, ["_step"], block or BLOCK_HORIZONS * max(horizon, 1), "_asked")
    return counted.filter("_asked").select(*keys, at, F.col("_step").alias(name))


def bucket_distinct(contacts: DataFrame, keys: list[str], item: list[str], bucket: str, width: int, name: str = "n") -> DataFrame:
    """keys, bucket, n: the different items that the key met in the last `width` buckets, at each bucket it has rows in.

    In one bucket a member counts from there to its next bucket, at most for `width`; what is summed in order is one
    row for each bucket in which a key's count may change. Rows with a null key, item or bucket meet nothing and have a
    count all the same.
    """
    own = [*keys, *item]
    rows = contacts.select(*own, bucket).distinct()
    after = F.lead(bucket).over(Window.partitionBy(*own).orderBy(bucket))
    met = reduce(and_, (F.col(c).isNotNull() for c in (*own, bucket))).cast("long")
    rows = rows.select(*keys, bucket, F.least(F.col(bucket) + width, after).alias("_end"), met.alias("_step"))
    begun = F.struct(F.col(bucket).alias(bucket), F.col("_step").alias("_step"), F.lit(True).alias("_asked"))
    ended = F.struct(F.col("_end").alias(bucket), (-F.col("_step")).alias("_step"), F.lit(False).alias("_asked"))
    changes = rows.select(*keys, F.explode(F.array(begun, ended)).alias("c")).select(*keys, "c.*")
    steps = changes.groupBy(*keys, bucket).agg(F.sum("_step").alias("_step"), F.max("_asked").alias("_asked"))
    past = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumn(name, F.sum("_step").over(past)).filter("_asked").select(*keys, bucket, name)


def active_spans(contacts: DataFrame, keys: list[str], at: str, horizon: int, name: str = "span") -> DataFrame:
    """keys, at, span: the number of the key's active span at each contact; a pause beyond `horizon` starts a new one."""
    spans = intervals(contacts.dropna(subset=[*keys, at]), keys, [], at, horizon)
    return running_sums(spans.withColumn(name, F.col("begins").cast("long")), keys, at, [name], BLOCK_HORIZONS * max(horizon, 1))
