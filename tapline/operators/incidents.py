"""Findings to incidents: one open incident per class and entity, with a ladder of updates and an idle end.

The same small step runs in batch (over a key's findings in time order) and in a stream (state per key).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapline.functions.columns import uuid5

#: Milliseconds without findings after which an incident ends, between repeated updates, and by class.
IDLE_MS, COOLDOWN_MS = 300_000, 60_000
IDLE_BY_CLASS = {"beaconing": 1_800_000}
UPDATES = "threat_class string, entity_type string, entity_key string, window_start_ms long, update_seq int, status string, rank int, obs_ms long, evidence long"
KEYS = ["threat_class", "entity_type", "entity_key"]
STATE = "start long, seq int, rank int, emitted_ms long, seen_ms long, evidence long, emitted_evidence long, subtypes string"


def idle_of(threat_class: str, idle: int) -> int:
    return IDLE_BY_CLASS.get(threat_class, idle) if idle == IDLE_MS else idle


def advance(state: tuple | None, finding: tuple, idle: int, cooldown: int) -> tuple[tuple, list[tuple[int, int, str, int, int, int]]]:
    """The state after a finding (window_start_ms, obs_ms, rank, subtype, evidence), and updates to report.

    Updates are (start, seq, status, rank, obs_ms, evidence). A finding later than the idle time ends the incident and
    opens another. Severity never falls; a higher one escalates, a new subtype or, after the cooldown, more evidence
    updates; anything else stays silent.
    """
    start, at, rank, subtype, evidence = finding
    reports = []
    if state is not None and at > state[4] + idle:
        reports.append(closing(state))
        state = None
    if state is None:
        return (start, 1, rank, at, at, evidence, evidence, subtype), [*reports, (start, 1, "new", rank, at, evidence)]
    begun, seq, worst, emitted, seen, most, told, kinds = state
    known = kinds.split("|")
    seen, most = max(seen, at), max(most, evidence)
    fresh = subtype not in known
    if fresh:
        known = [*known, subtype][-8:]
    status = "escalated" if rank > worst else "updated" if fresh or at - emitted >= cooldown and most > told else None
    worst = max(worst, rank)
    if status:
        seq, emitted, told = seq + 1, at, most
        reports.append((begun, seq, status, worst, at, most))
    return (begun, seq, worst, emitted, seen, most, told, "|".join(known)), reports


def closing(state: tuple) -> tuple[int, int, str, int, int, int]:
    return (state[0], state[1] + 1, "resolved", state[2], state[4], state[5])


def typed(findings: DataFrame) -> DataFrame:
    return findings if "entity_type" in findings.columns else findings.withColumn("entity_type", F.lit("src_host"))


def correlate(findings: DataFrame, idle: int = IDLE_MS, cooldown: int = COOLDOWN_MS) -> DataFrame:
    """All updates of all incidents; every incident is resolved at the end of its findings.

    `findings` has threat_class, entity_type (src_host, if there is no such column), entity_key, window_start_ms, obs_ms,
    rank, subtype, evidence. A key's findings are sorted by Spark and pass through one at a time, so memory holds one state, not the key's history.
    """
    keys = KEYS
    order = [*keys, "obs_ms", "window_start_ms", "rank", "subtype", "evidence"]
    rows = typed(findings).select(*order).repartition(*keys).sortWithinPartitions(*order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        names = [c.split(" ")[0] for c in UPDATES.split(", ")]
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if (r.threat_class, r.entity_type, r.entity_key) != key:
                    if state is not None:
                        out.append((*key, *closing(state)))
                    key, state = (r.threat_class, r.entity_type, r.entity_key), None
                state, reports = advance(state, (r.window_start_ms, r.obs_ms, r.rank, r.subtype, r.evidence), idle_of(r.threat_class, idle), cooldown)
                out += [(*key, *x) for x in reports]
            yield pd.DataFrame(out, columns=names)
        if state is not None:
            yield pd.DataFrame([(*key, *closing(state))], columns=names)

    return identified(rows.mapInPandas(run, UPDATES))


def identified(updates: DataFrame) -> DataFrame:
    """Incident and update identifiers that depend on nothing but what they name, so that replays agree."""
    second = F.expr("cast(floor(window_start_ms / 1000) * 1000 as bigint)")
    named = updates.withColumn("incident_id", uuid5("incident", *(F.col(k) for k in KEYS), second))
    return named.withColumn("update_id", uuid5("update", F.col("incident_id"), F.col("update_seq")))
