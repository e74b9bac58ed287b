"""Beacons over many starts: as a plain computation has them, in time that grows with the starts alone."""

import random
import statistics
import time

import pytest
from test_detectors import FLOW, T0, flow

from pyspark.sql import functions as F

from tapline.operators import detectors
from tapline.operators.ladders import climbs


def expected(rows):
    """src, obs_ms, amount, score, size_cv of what a ladder reports, window by window."""
    found = []
    for src in sorted({r[0] for r in rows}):
        starts = sorted((r[5], r[11] if r[8] else None) for r in rows if r[0] == src)
        state = None
        for i, (at, _) in enumerate(starts):
            last = starts[max(0, i - 63) : i + 1]
            if len(last) < 8:
                continue
            steps = [b[0] - a[0] for a, b in zip(last, last[1:])]
            middle = statistics.median(steps)
            cv = 1.4826 * statistics.median(abs(s - middle) for s in steps) / middle
            if middle < 5_000 or cv > 0.15 or at - last[0][0] < 3 * middle:
                continue
            sizes = [s for _, s in last if s is not None]
            usual = statistics.median(sizes) if len(sizes) >= 4 else 0
            size_cv = 1.4826 * statistics.median(abs(s - usual) for s in sizes) / usual if usual > 0 else None
            state, say = climbs(state, at, 3 if cv <= 0.05 and len(last) >= 16 else 2, float(len(last)), None, True)
            if say:
                found.append((src, at, float(len(last)), 0.6 * (1 - cv / 0.15) + 0.4 * min(1.0, len(last) / 32), size_cv))
    return found


def test_many_starts(spark):
    r, rows = random.Random(5), []
    for src, n, jitter in (("long", 4000, 9_000), ("even", 300, 1_000), ("short", 20, 500), ("few", 9, 0)):
        rows += [(*flow(60_000 * i + r.randint(-jitter, jitter), src, "x", 443, out=r.randint(50, 150))[:8], r.random() < 0.7, *flow(0, src, "x", 443, out=r.randint(50, 150))[9:]) for i in range(n)]
    assert min(x[5] for x in rows) > T0 - 10_000
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")  # shorter than a window
    try:
        began = time.time()
        got = detectors.beacons(spark.createDataFrame(rows, FLOW), F.lit(False)).orderBy("src", "obs_ms").collect()
        took = time.time() - began
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    wanted = expected(rows)
    assert {x[0] for x in wanted} == {"long", "even", "short", "few"}
    assert [(x.src, x.obs_ms, x.amount) for x in got] == [x[:3] for x in wanted]
    for x, y in zip(got, wanted):
        assert x.score == pytest.approx(y[3], abs=1e-12) and x.size_cv == (y[4] if y[4] is None else pytest.approx(y[4], abs=1e-12))
    assert took < 20, f"{took:.0f} s for {len(rows)} starts"
