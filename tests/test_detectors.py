"""Detector scenarios: what must be reported, and what must stay quiet."""

import random

from pyspark.sql import functions as F

from tapline.operators import detectors

T0 = 1_788_256_800_000
FLOW = "src string, dst string, dport int, sport int, proto string, obs_ms long, start_ms long, new_flow boolean, terminal boolean, conn_state string, coverage string, orig_bytes long, resp_bytes long"


def flow(at, src, dst, dport, proto="tcp", state="SF", sport=40000, out=100, back=100):
    return (src, dst, dport, sport, proto, T0 + at, T0 + at, True, True, state, "both_directions", out, back)


def run(spark, rows, detector, *args, **kw):
    return detector(spark.createDataFrame(rows, FLOW), *args, **kw).orderBy("obs_ms", "subtype").collect()


def test_scans(spark):
    scan = [flow(50 * i, "10.0.0.9", f"10.1.0.{i}", 502, state="S0") for i in range(40)]
    polling = [flow(1000 * i, "10.0.0.1", f"10.2.0.{i % 3}", 502) for i in range(300)]
    got = run(spark, scan + polling, detectors.scans)
    assert [(r.src, r.subtype, r.severity, r.amount) for r in got] == [("10.0.0.9", "horizontal_scan", "medium", 20.0), ("10.0.0.9", "horizontal_scan", "high", 40.0)]
    allowed = spark.createDataFrame([("10.0.0.9",)], "src string")
    assert {r.severity for r in run(spark, scan, detectors.scans, allowed)} == {"info"}
    ports = [flow(50 * i, "a", "b", 1000 + i) for i in range(25)]
    assert [r.subtype for r in run(spark, ports, detectors.scans)] == ["vertical_scan"]


def test_floods(spark):
    r = random.Random(1)
    spoofed = [flow(2 * i, f"198.18.{r.randint(0, 255)}.{r.randint(0, 255)}", "10.0.0.5", 80, state="S0") for i in range(1500)]
    names = [x.subtype for x in run(spark, spoofed, detectors.floods)]
    assert names[0] == "syn_flood" and "spoofed_source_like_flood" in names
    few = [flow(3 * i, f"10.9.0.{i % 5}", "10.0.0.6", 80, state="S0") for i in range(400)]
    assert {x.subtype for x in run(spark, few, detectors.floods)} == {"syn_flood"}
    amplified = [flow(5 * i, f"203.0.113.{i}", "10.0.0.7", 4444, "udp", None, 123, 30_000, 0) for i in range(60)]
    assert [x.subtype for x in run(spark, amplified, detectors.floods)] == ["udp_amplification_like"]


def test_beacons(spark):
    r = random.Random(2)
    beacon = [flow(60_000 * i + r.randint(-800, 800), "10.0.0.4", "203.0.113.9", 443) for i in range(14)]
    polls = [flow(10_000 * i, "10.10.1.10", "10.10.2.5", 502) for i in range(40)]
    irregular = [flow(60_000 * i + r.randint(0, 50_000), "10.0.0.8", "203.0.113.8", 443) for i in range(14)]
    known = spark.createDataFrame([("10.10.1.10", "10.10.2.5", 502, "tcp")], "src string, dst string, dport int, proto string")
    got = run(spark, beacon + polls + irregular, detectors.beacons, F.col("dst").startswith("10."), known)
    assert {x.src for x in got} == {"10.0.0.4"} and [x.severity for x in got] == ["medium"] and got[0].amount == 8


def test_uploads(spark):
    steady = [flow(5_000 * i, "10.0.0.3", "203.0.113.7", 443, out=8_000_000) for i in range(8)]
    burst = [flow(100 * i, "10.0.0.2", "203.0.113.7", 443, out=8_000_000) for i in range(8)]
    assert {x.src for x in run(spark, steady + burst, detectors.uploads)} == {"10.0.0.3"}


def test_tls(spark):
    rows = [("a", "x", 8443, T0 + i, 4, 3, 0.8) for i in range(5)] + [("b", "y", 443, T0 + i, 6, 0, 0.0) for i in range(5)] + [("c", "z", 443, T0 + i, 2, 2, None) for i in range(5)]
    frame = spark.createDataFrame(rows, "src string, dst string, dport int, obs_ms long, available int, positive int, score double")
    got = detectors.tls_metadata(frame, F.lit(True)).collect()
    assert [(x.src, x.severity, x.amount) for x in got] == [("a", "low", 3.0)]


def test_dns(spark):
    r = random.Random(3)
    label = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz234567") for _ in range(n))
    rows = [("10.10.1.50", "exfil-example.org", label(40), T0 + 200 * i, False) for i in range(60)] + [("10.0.0.1", "example.com", f"w{i % 3}", T0 + 200 * i, False) for i in range(60)]
    frame = spark.createDataFrame(rows, "src string, registrable string, sub string, obs_ms long, looks_generated boolean")
    got = detectors.dns_tunnels(frame).collect()
    assert [(x.src, x.registrable, x.amount, x.severity) for x in got] == [("10.10.1.50", "exfil-example.org", 30.0, "medium")]
    burst = spark.createDataFrame([("h", label(16) + ".com", "", T0 + 300 * i, i % 2 == 0) for i in range(20)] + [("q", "one.com", "", T0 + i, True) for i in range(30)], "src string, registrable string, sub string, obs_ms long, looks_generated boolean")
    assert [(x.src, x.amount, x.score) for x in detectors.name_bursts(burst).collect()] == [("h", 10.0, 0.5)]


def test_evidence(spark):
    """The ratio of bytes out to bytes in, and how much a beacon's sizes vary."""
    known = [flow(5_000 * i, "a", "x", 443, out=8_000_000, back=1_000_000) for i in range(6)]
    silent = [flow(5_000 * i, "b", "x", 443, out=8_000_000, back=0) for i in range(6)]
    unseen = [(*flow(5_000 * i, "c", "x", 443, out=8_000_000, back=9)[:10], "originator_only" if i == 1 else "both_directions", 8_000_000, 9) for i in range(6)]
    got = run(spark, known + silent + unseen, detectors.uploads)
    assert {(x.src, x.ratio) for x in got} == {("a", 8.0), ("b", None), ("c", None)}
    even = [flow(60_000 * i, "a", "x", 443, out=100 + 10 * (i % 2)) for i in range(10)]
    few = [(*flow(60_000 * i, "b", "x", 443)[:8], i < 3, *flow(0, "b", "x", 443)[9:]) for i in range(10)]
    got = {(x.src, x.amount): x.size_cv for x in run(spark, even + few, detectors.beacons, F.lit(False))}
    assert abs(got["a", 8.0] - 1.4826 * 5 / 105) < 1e-9 and got["b", 8.0] is None
