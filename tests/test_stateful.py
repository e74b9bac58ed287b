"""Streams with state against their batch twins, over several batches and restarts; the sweep against plain counts."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tapline.operators import flows, sweeps, tables
from tapline.streaming import queries as streams
from tapline.streaming import stateful


def in_batches(spark, folder, rows, schema, pieces):
    """The rows as a stream that takes one file a batch, in the order of the files, with event time from ms."""
    step = -(-len(rows) // pieces)
    for i in range(pieces):
        path = f"{folder}/{i}"
        spark.createDataFrame(rows[i * step : (i + 1) * step], schema).coalesce(1).write.parquet(path)
        for name in os.listdir(path):
            os.utime(f"{path}/{name}", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(str(folder))
    return stream.withColumn("ts", F.timestamp_millis("ms")).withWatermark("ts", "1 second")


def shown(frame):
    return sorted(tuple("" if x is None else str(x) for x in r) for r in frame.collect())


def test_flow_deltas_over_batches(spark, tmp_path):
    r, rows = random.Random(4), []
    for i in range(400):
        rows.append((r.choice("abcde"), i, 1000 * i + 5000, r.randint(1, 60), None if r.random() < 0.1 else r.randint(0, 5000), r.random() < 0.03))
    schema = "flow string, id long, ms long, seq long, bytes long, terminal boolean"
    stream = in_batches(spark, tmp_path, rows, schema, 4)
    columns = ["flow", "id", "new_flow", "d_bytes"]
    got = streams.drain(stateful.flow_deltas(stream, ["flow"], "seq", ["ms", "id"], ["bytes"], "terminal", "ms", 10**9, 10**9), "append").select(*columns)
    want = flows.flow_deltas(spark.createDataFrame(rows, schema), ["flow"], "seq", ["ms", "id"], ["bytes"], "terminal").select(*columns)
    assert shown(got) == shown(want) and len(shown(got)) > 20


def test_idle_flows_are_forgotten(spark, tmp_path):
    rows = [("a", 1, 10, 5, 100, False), ("b", 2, 900_000, 1, 1, False), ("a", 3, 1_000_000, 1, 30, False)]
    stream = in_batches(spark, tmp_path, rows, "flow string, id long, ms long, seq long, bytes long, terminal boolean", 3)
    got = streams.drain(stateful.flow_deltas(stream, ["flow"], "seq", ["ms", "id"], ["bytes"], "terminal", "ms"), "append")
    assert {(x.id, x.new_flow, x.d_bytes) for x in got.collect()} == {(1, True, 100), (2, True, 1), (3, True, 30)}


FLOW = "src string, dst string, dport int, proto string, port_key string, ms long, obs_ms long, new_flow boolean, terminal boolean, conn_state string, coverage string"


def test_scans_over_batches(spark, tmp_path):
    from tapline.operators import detectors

    r, rows, now = random.Random(8), [], 10
    for _ in range(600):
        now += r.choice((0, 200, 900, 3000, 12_000))
        host, port = f"h{r.randint(0, 9)}", r.choice((22, 80, 443))
        rows.append((r.choice("xy"), host, port, "tcp", f"{port}/tcp", now, now, r.random() < 0.9, r.random() < 0.8, r.choice(("S0", "SF", None)), r.choice(("both_directions", "originator_only"))))
    rows.sort(key=lambda x: x[5])
    stream = in_batches(spark, tmp_path, rows, FLOW, 5)
    columns = ["src", "obs_ms", "subtype", "severity", "rank", "amount", "score"]
    got = streams.drain(stateful.scans(stream, horizon_ms=9000, hosts=3, ports=2), "append").select(*columns)
    want = detectors.scans(spark.createDataFrame(rows, FLOW), horizon_ms=9000, hosts=3, ports=2).select(*columns)
    # rows of one moment that two batches share are counted together only by the batch operator
    assert len(set(shown(got)) ^ set(shown(want))) <= 4 and len(shown(want)) > 20


def test_scan_state_ends_with_the_horizon(spark, tmp_path):
    burst = lambda start: [("s", f"h{i}", 22, "tcp", "22/tcp", start + i, start + i, True, True, "S0", "both_directions") for i in range(4)]
    rows = burst(10) + burst(100_000)
    got = streams.drain(stateful.scans(in_batches(spark, tmp_path, rows, FLOW, 2), frozenset("t"), 9000, 3, 99), "append")
    assert sorted((x.obs_ms, x.amount) for x in got.collect()) == [(12, 3.0), (100_002, 3.0)]
    with stateful.rocks(spark):
        assert spark.conf.get(stateful.STORE) == stateful.ROCKS


@pytest.mark.parametrize("window", [8, 64])
def test_sequences_over_batches(spark, tmp_path, window):
    r = random.Random(window)
    numbers = [max(0, i + r.randint(-12, 12)) for i in range(300)] + [5000, 4999, 4990, 5000, 5000 + 3 * window, 5000]
    rows = [(s, i, 1000 * i + 10, n) for i, n in enumerate(numbers) for s in "ab"[: 1 + i % 2]]
    schema = "stream string, i long, ms long, number long"
    got = streams.drain(stateful.classify_sequence(in_batches(spark, tmp_path, rows, schema, 4), ["stream"], "number", ["i"], "ms", window), "append")
    want = tables.classify_sequence(spark.createDataFrame(rows, schema), ["stream"], "number", ["i"], window)
    columns = ["stream", "i", "number", "status", "gap"]
    assert shown(got.select(*columns)) == shown(want.select(*columns))
    assert {x.status for x in want.collect()} == {"new", "reordered", "duplicate", "stale"}


def test_full_window():
    ring = stateful.Received(stateful.SEQUENCES)
    assert ring.take(7) == ("new", 0) and ring.take(7 + 65_535) == ("new", 65_534) and ring.take(7) == ("duplicate", 0)
    assert ring.take(8 + 65_535) == ("new", 0) and ring.take(7) == ("stale", 0) and ring.take(8) == ("reordered", 0)
    again = stateful.Received(stateful.SEQUENCES, ring.state())
    assert again.take(8) == ("duplicate", 0) and len(ring.state()[2]) == 8192


@pytest.mark.parametrize("horizon, block", [(0, 1), (5, 3), (5, None), (40, 1000)])
def test_trailing_distinct(spark, horizon, block):
    r = random.Random(horizon)
    rows = [(r.choice("ab"), r.choice("pqrst"), r.randint(-50, 200)) for _ in range(300)] + [(None, "p", 3), ("a", None, 4), ("a", "p", None)]
    frame = spark.createDataFrame(rows, "k string, item string, at long")
    got = {(x.k, x.at): x.n for x in sweeps.trailing_distinct(frame, ["k"], ["item"], "at", horizon, block=block).collect()}
    whole = [x for x in rows if None not in x]
    want = {(k, at): len({i for k2, i, t in whole if k2 == k and at - horizon <= t <= at}) for k, _, at in whole}
    assert got == want
    points = spark.createDataFrame([("a", 7), ("b", 1000), ("c", 1)], "k string, at long")
    got = {(x.k, x.at): x.n for x in sweeps.trailing_distinct(frame, ["k"], ["item"], "at", horizon, points, block=block).collect()}
    assert got == {("a", 7): len({i for k, i, t in whole if k == "a" and 7 - horizon <= t <= 7}), ("b", 1000): 0, ("c", 1): 0}


def test_running_sums(spark):
    frame = spark.createDataFrame([("a", 1, 5), ("a", 1, None), ("a", 9, 2), ("b", -3, 1)], "k string, at long, v long")
    assert {(x.k, x.at): x.v for x in sweeps.running_sums(frame, ["k"], "at", ["v"], 4).collect()} == {("a", 1): 5, ("a", 9): 7, ("b", -3): 1}


def test_late_rows(spark, tmp_path):
    rows = [("a", 1, 10_000), ("a", 2, 30_000), ("a", 3, 27_500), ("b", 4, 28_001), ("b", 5, None), ("a", 6, 60_000), ("a", 7, 29_000), ("a", 8, 58_000), ("a", 9, 58_001), ("a", 10, 1)]
    stream = in_batches(spark, tmp_path, rows, "k string, id long, ms long", 5)
    kept, late = streams.split_late(stream, "ms", 2000)
    ids = lambda frame: sorted(r.id for r in frame.collect())
    assert ids(late) == [3, 7, 8, 10] and ids(kept) == [1, 2, 4, 5, 6, 9] and kept.columns == late.columns == stream.columns


def test_nothing_is_late_in_one_batch(spark, tmp_path):
    kept, late = streams.split_late(in_batches(spark, tmp_path, [("a", i, 1000 * (9 - i)) for i in range(9)], "k string, id long, ms long", 1), "ms", 0)
    assert kept.count() == 9 and late.count() == 0


def test_a_source_with_more_rows_than_a_piece(spark, tmp_path):
    """Rows of one batch pass in time order, however many a source has and in whatever order they come."""
    from tapline.operators import detectors

    r = random.Random(11)
    rows = [("x", f"h{r.randint(0, 30)}", p, "tcp", f"{p}/tcp", at, at, True, r.random() < 0.8, r.choice(("S0", "SF", None)), r.choice(("both_directions", "originator_only", None))) for at in range(10, 25_000_000, 1000) for p in (r.choice((22, 80, 443)),) if at % 1_000_000 < 900_000]
    r.shuffle(rows)
    columns = ["src", "obs_ms", "subtype", "severity", "rank", "amount", "score"]
    got = streams.drain(stateful.scans(in_batches(spark, tmp_path, rows, FLOW, 1), horizon_ms=9000, hosts=3, ports=2), "append").select(*columns)
    want = detectors.scans(spark.createDataFrame(rows, FLOW), horizon_ms=9000, hosts=3, ports=2).select(*columns)
    assert len(rows) > 20_000 and shown(got) == shown(want) and len(shown(want)) > 50


def test_store_calls_of_a_source():
    """Calls to the store are a matter of sources, not of their pairs or rows."""
    import pandas as pd

    calls, kept = [], {}

    class Value:
        def get(self):
            calls.append("get")
            return kept.get("value")

        def update(self, value):
            calls.append("update")
            kept["value"] = value

        def clear(self):
            calls.append("clear")
            kept.clear()

    class Handle:
        def getValueState(self, *_):
            return Value()

        def registerTimer(self, at):
            calls.append(at)

    class Timer:
        def __init__(self, at):
            self.getExpiryTimeInMs = lambda: at

    processor = stateful.ScanProcessor(9000, 3, 2, frozenset())
    processor.init(Handle())
    piece = lambda start: pd.DataFrame({"dst": [f"h{i}" for i in range(500)], "port_key": ["22/tcp"] * 500, "obs_ms": range(start, start + 500), "attempt": [1] * 500})
    made = pd.concat(processor.handleInputRows(("s",), iter([piece(1000), piece(0)]), None))
    assert made["obs_ms"].iloc[0] == 2 and made["amount"].tolist() == [3.0, 6.0, 12.0, 15.0, 30.0, 60.0, 120.0, 240.0, 480.0] and calls == ["get", "update", 1499 + 9001]
    assert len(kept["value"][-1]) == 500 and list(processor.handleExpiredTimer(("s",), None, Timer(1200 + 9000))) == [] and len(kept["value"][-1]) == 300
    assert list(processor.handleExpiredTimer(("s",), None, Timer(1499 + 9001))) == [] and not kept
