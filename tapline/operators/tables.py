"""Latest state, deduplication, ordering and exact ranks over keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_by_key(df: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """The row of each key with the largest version; a pre-aggregated maximum, no window."""
    rest = [c for c in df.columns if c not in keys]
    top = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("_top"))
    return top.select(*keys, *(F.col(f"_top.{c}").alias(c) for c in rest))


def dense_sequence(df: DataFrame, bucket: Column, order: list[str], name: str = "sequence") -> DataFrame:
    """Numbers 0, 1, ... in a global order that `bucket` is a monotone part of.

    Rows are numbered within buckets, and each bucket is shifted by the rows of those before it, so that no task
    sees the whole table; only the buckets' counts are summed in one place.
    """
    rows = df.withColumn("_bucket", bucket)
    sizes = rows.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_bucket", before.alias("_before"))
    within = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    return rows.withColumn("_rank", within).join(offsets, "_bucket").withColumn(name, F.col("_before") + F.col("_rank") - 1).drop("_bucket", "_rank", "_before")


def nearest_rank(df: DataFrame, value: str, shares: list[float], width: float = 1.0) -> DataFrame:
    """share, value at index floor(share * n) of the sorted values, at most n - 1.

    Values are counted in buckets of `width`; the bucket that holds an index is found from the counts, and only
    its values are ranked.
    """
    rows = df.filter(F.col(value).isNotNull()).select(F.col(value).alias("_v"), F.floor(F.col(value) / width).alias("_b"))
    distinct = rows.groupBy("_b", "_v").agg(F.count("*").alias("_n"))
    buckets = distinct.groupBy("_b").agg(F.sum("_n").alias("_n"))
    ends = buckets.withColumn("_end", F.sum("_n").over(Window.orderBy("_b"))).withColumn("_start", F.col("_end") - F.col("_n"))
    total = buckets.agg(F.sum("_n").alias("_total"))
    wanted = total.select("_total", F.explode(F.array(*map(F.lit, shares))).alias("share")).withColumn("_at", F.least(F.floor(F.col("share") * F.col("_total")), F.col("_total") - 1))
    placed = wanted.join(ends, (F.col("_at") >= F.col("_start")) & (F.col("_at") < F.col("_end"))).select("share", "_at", "_start", "_b")
    running = F.sum("_n").over(Window.partitionBy("share").orderBy("_v"))
    inside = distinct.withColumnRenamed("_n", "_c").join(F.broadcast(placed), "_b").withColumnRenamed("_c", "_n").withColumn("_end", F.col("_start") + running)
    return inside.filter((F.col("_at") < F.col("_end")) & (F.col("_at") >= F.col("_end") - F.col("_n"))).select("share", F.col("_v").alias("value"))


def classify_sequence(df: DataFrame, stream: list[str], sequence: str, arrival: list[str], window: int = 65536) -> DataFrame:
    """status (new, reordered, duplicate, stale) and gap of each arrival in its stream.

    New numbers exceed all before them and leave a gap of those they skip; numbers below the first, or a window
    behind the highest, are stale; others are duplicates if they came before, and reordered if not.
    """
    past = Window.partitionBy(*stream).orderBy(*arrival).rowsBetween(Window.unboundedPreceding, -1)
    again = F.row_number().over(Window.partitionBy(*stream, sequence).orderBy(*arrival)) > 1
    rows = df.withColumn("_high", F.max(sequence).over(past)).withColumn("_base", F.first(sequence).over(past)).withColumn("_again", again)
    s = F.col(sequence)
    status = F.when(F.col("_high").isNull() | (s > F.col("_high")), "new").when((s <= F.col("_high") - window) | (s < F.col("_base")), "stale").when(F.col("_again"), "duplicate").otherwise("reordered")
    return rows.withColumn("status", status).withColumn("gap", F.when(F.col("status") == "new", F.coalesce(s - F.col("_high") - 1, F.lit(0))).otherwise(0)).drop("_high", "_base", "_again")


def sessions(df: DataFrame, keys: list[str], ms: str, gap: Column) -> DataFrame:
    """start, end, n of runs of a key's rows in which no step exceeds the gap."""
    order = Window.partitionBy(*keys).orderBy(ms)
    fresh = F.when(F.col(ms) - F.lag(ms).over(order) <= gap, 0).otherwise(1)
    numbered = df.withColumn("_fresh", fresh).withColumn("_session", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_session").agg(F.min(ms).alias("start"), F.max(ms).alias("end"), F.count("*").alias("n")).drop("_session")
