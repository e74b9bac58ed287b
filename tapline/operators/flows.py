"""Cumulative flow counters as exactly-once deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def flow_deltas(df: DataFrame, flow: list[str], sequence: str, arrival: list[str], counters: list[str], terminal: str | None = None) -> DataFrame:
    """The records of each flow that advance it, with d_<counter> and new_flow.

    A snapshot counts if its sequence exceeds all before it in arrival order; repeated and late ones go. A delta is
    the growth over the largest value of the snapshots so far, 0 for a regression, and null where the counter is.
    A `terminal` record (a boolean column) needs no sequence and ends a flow that has snapshots: what comes after it goes.
    """
    past = Window.partitionBy(*flow).orderBy(*arrival).rowsBetween(Window.unboundedPreceding, -1)
    ends = F.coalesce(F.col(terminal), F.lit(False)) if terminal else F.lit(False)
    of_snapshots = lambda c: F.max(F.when(~ends, F.col(c))).over(past)
    rows = df.withColumns({"_high": of_snapshots(sequence), "_begun": F.coalesce(F.max(~ends).over(past), F.lit(False))})
    rows = rows.withColumn("_over", F.coalesce(F.max(ends & F.col("_begun")).over(past), F.lit(False)))
    accepted = rows.filter(~F.col("_over") & (ends | F.col("_high").isNull() | (F.col(sequence) > F.col("_high"))))
    out = accepted.withColumn("new_flow", ~F.col("_begun"))
    for c in counters:
        out = out.withColumn(f"d_{c}", F.greatest(F.col(c) - F.coalesce(of_snapshots(c), F.lit(0)), F.lit(0)))
        out = out.withColumn(f"d_{c}", F.when(F.col(c).isNotNull(), F.col(f"d_{c}")))
    return out.drop("_high", "_begun", "_over")
