"""Detectors against their learned baselines."""

from test_detectors import T0, flow, run

from tapline.operators import detectors


def test_flood_baseline(spark):
    usual = [(1000 * s + i, 10) for s in range(40) for i in range(10)]
    flood = [(1000 * s + i, 10) for s in range(40, 52) for i in range(100)]
    rows = [flow(at, "a", "busy", 80, out=n, back=0) for at, n in usual + flood]
    got = run(spark, rows, detectors.floods, flows=20, volume=1e9)
    assert [(x.subtype, x.obs_ms - T0, x.amount) for x in got] == [("volumetric_flood", 40_000, 140.0), ("volumetric_flood", 42_000, 320.0)]
    # a long flood doesn't raise its limit: the last second is as bad as the first
    assert {x.score for x in got} == {0.75}
    steady = [flow(1000 * s + i, "a", "warm", 80) for s in range(31) for i in range(10)] + [flow(31_000 + i, "a", "warm", 80) for i in range(25)]
    assert [x.obs_ms - T0 for x in run(spark, steady, detectors.floods, flows=5, volume=1e9)][0] == 0
    assert [x.obs_ms - T0 for x in run(spark, steady, detectors.floods, flows=11, volume=1e9)] == [31_000]  # 6 x the mean would be 60
    heavy = [flow(1000 * s, "a", "bytes", 80, out=90 + 20 * (s % 2), back=0) for s in range(40)] + [flow(40_000, "a", "bytes", 80, out=125, back=0)]
    assert run(spark, heavy, detectors.floods, volume=120.0) == []  # mean and six deviations lie above the fixed volume


def test_upload_baseline(spark):
    start = -T0 % 30_000
    cold = [flow(start + 30_000 * w + 9_000 * i, "h", "d", 443, out=(20 if w < 4 else 60)) for w in range(5) for i in range(3)]
    assert run(spark, cold, detectors.uploads, volume=100.0) != []
    warm = [(start + 30_000 * w + 9_000 * i, 20 if w < 8 else 60) for w in range(9) for i in range(3)]
    got = run(spark, [flow(at, "h", "d", 443, out=n) for at, n in warm], detectors.uploads, volume=150.0)
    assert got == []  # 10 times the mean of 60 a window is 600
