"""Emit ladders: which of a key's candidate findings are reported, in time order.

Windows say how bad every moment is; a ladder reports only a worse severity or a doubled amount since the last
report. That depends on what was reported before, so rows pass one at a time in an order that Spark sorts, with one
small state in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def climbs(state: tuple | None, at: int, rank: int, amount: float, gap: int | None, doubling: bool) -> tuple[tuple, bool]:
    """The state (worst rank, last reported amount, last time) after a candidate, and whether it is reported.

    A gap longer than `gap` starts over. Amounts count as doubled from twice the last reported one, at least 1.
    """
    if state is not None and gap is not None and at - state[2] > gap:
        state = None
    worst, told, _ = state or (-1, None, at)
    reported = rank > worst or doubling and told is not None and amount >= 2 * max(1, told)
    return (max(worst, rank), amount if reported else told, at), reported


def reported(candidates: DataFrame, keys: list[str], at: str, rank: str = "rank", amount: str = "amount", gap: int | None = None, doubling: bool = True) -> DataFrame:
    """The candidates that a ladder per key reports, in the order of `at`; ties by all columns."""
    rest = [c for c in candidates.columns if c not in [*keys, at]]
    plain = [c for c, kind in candidates.dtypes if c in rest and not kind.startswith(("array", "map", "struct"))]
    rows = candidates.repartition(*keys).sortWithinPartitions(*keys, at, *plain)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            keep = []
            for own, moment, r, a in zip(batch[keys].itertuples(index=False, name=None), batch[at], batch[rank], batch[amount]):
                if own != key:
                    key, state = own, None
                state, say = climbs(state, moment, r, a, gap, doubling)
                keep.append(say)
            yield batch[keep]

    return rows.mapInPandas(run, candidates.schema)


def rank_of(severity) -> "F.Column":
    from tapline.functions.columns import severity_rank

    return severity_rank(severity)
