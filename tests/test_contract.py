"""The receiver's contract: records that pass, records that break one rule each, and adaptive distinct counts."""

import copy
import hashlib
import json
import uuid

import pytest
from pyspark.sql import functions as F

from tapline.functions.columns import NAMESPACES
from tapline.operators import sketches
from tapline.sources import contract

BOOT = "0b1d6c52-3f1e-4e6b-9c84-2a7f6d1c9e01"
PLACES = {"uid": "Cx1", "src_ip": "10.1.0.4", "src_port": 50000, "dst_ip": "2001:db8::7", "dst_port": 443}
FLOW = {**PLACES, "proto": "tcp", "service": "ssl", "duration_s": 1.5, "orig_bytes": 0, "resp_bytes": 10, "orig_pkts": 1, "resp_pkts": 1, "orig_ip_bytes": 40, "resp_ip_bytes": 50, "history": "ShAF"}
CONN = {**FLOW, "missed_bytes": 0, "conn_state": "SF", "local_orig": True, "local_resp": False}
DNS = {**PLACES, "proto": "udp", "trans_id": 7, "rtt_s": 0.25, "query": "a.example.org", "query_truncated": False, "qclass": 1, "qtype": 1, "qtype_name": "A", "rcode": 0, "rcode_name": "NOERROR", "aa": False, "tc": False, "rd": True, "ra": True, "answers": ["192.0.2.1"], "answers_truncated": False, "rejected": False}
SSL = {**PLACES, "version": "TLSv12", "cipher": "TLS_X", "curve": None, "server_name": None, "resumed": False, "established": True, "next_protocol": None, "ssl_history": "Cs", "validation_status": None, "cert_chain_len": 2, "sni_matches_cert": None}
WEIRD = {**dict.fromkeys(PLACES), "name": "odd_thing", "addl": None, "notice": False, "peer": "p", "source": None}


def event(log_type, payload, sequence=0, **over):
    line = over.pop("line", f'{{"ts":{sequence}}}')
    digest = hashlib.sha256(line.encode()).hexdigest()
    nulls = [k for k, v in payload.items() if v is None]
    out = {
        "event_schema_version": "1.0.0", "event_id": str(uuid.uuid5(uuid.UUID(NAMESPACES["event"]), f"s-1|{BOOT}|{sequence}|{digest}")), "sensor_id": "s-1", "sensor_boot_id": BOOT, "sequence": sequence,
        "replay_run_id": None, "replay_time_offset_us": -5, "log_type": log_type, "event_time": "2026-01-02T03:04:05.000001Z", "sensor_emitted_at": "2026-01-02T03:04:06Z", "receiver_received_at": "2026-01-02T03:04:06.5Z",
        "capture_mode": "passive_live", "observation_coverage": "both_directions", "original_record_sha256": digest, "original_record": line, "original_record_truncated": False,
        "availability": dict.fromkeys(nulls, "UNKNOWN"), "availability_reasons": dict.fromkeys(nulls[:1], "not_seen"), "payload": copy.deepcopy(payload),
    }
    return out | over


def changed(path, value, base=None):
    out = copy.deepcopy(base or event("conn", CONN))
    at = out
    *outer, last = path.split("/")
    for p in outer:
        at = at[p]
    if value is KeyError:
        del at[last]
    else:
        at[last] = value
    return out


VALID = [
    event("conn", CONN), event("conn", {**CONN, "service": None, "duration_s": None}, 1), event("conn", {**CONN, "resp_bytes": None, "conn_state": None}, 2, observation_coverage="originator_only"),
    event("flow_update", {**FLOW, "snapshot_seq": 2, "snapshot_interval_s": 5.0}, 3), event("dns", DNS, 4), event("dns", {**DNS, "answers": None, "rcode": None}, 5), event("ssl", SSL, 6), event("weird", WEIRD, 7),
    event("conn", CONN, 8, original_record=None, original_record_truncated=True), event("dns", DNS, 9, capture_mode="synthetic_log", replay_run_id="run-1", replay_time_offset_us=0),
    event("conn", {**CONN, "orig_bytes": 12.0}, 10), event("weird", {**WEIRD, **PLACES}, 11, line="ünïcode line"),
]
INVALID = [
    (changed("availability", {"orig_bytes": "UNKNOWN"}), ["availability_on_value"]), (changed("availability/orig_bytes", "AVAILABLE"), ["schema"]), (changed("capture_mode", "live"), ["schema"]), (changed("payload/src_ip", "10.0.0.256"), ["schema"]),
    (changed("payload/dst_port", KeyError), ["schema"]), (changed("sensor_id", KeyError), ["schema"]), (changed("payload/orig_bytes", -1), ["schema"]), (changed("payload/service", None), ["availability_null"]),
    (event("conn", CONN, original_record=None), ["original_record_null"]), (event("conn", CONN, line="x" * 4097), ["schema"]), (changed("payload/query", "q" * 256, event("dns", DNS)), ["schema"]), (changed("log_type", "dns"), ["schema"]),
    (changed("payload/src_port", 65536), ["schema"]), (changed("availability_reasons", {"service": "why"}), ["reason_without_availability"]), (changed("sensor_id", "S-1"), ["schema"]), (changed("sequence", "0"), ["schema"]),
    (changed("event_time", "2026-01-02T03:04:05+05:30"), ["schema"]), (changed("extra", 1), ["schema"]), (changed("log_type", "http"), ["schema"]), (changed("payload/extra", None), ["schema"]), (changed("event_schema_version", "2.0.0"), ["unsupported_schema_version"]),
    (changed("event_schema_version", KeyError), ["schema"]), (changed("payload/local_orig", 1), ["schema"]), (changed("payload/answers", ["x"] * 17, event("dns", DNS)), ["schema"]), (changed("payload/answers", [5], event("dns", DNS)), ["schema"]), (changed("payload/orig_bytes", 1.5), ["schema"]),
    (changed("availability", {"bogus": "MISSING"}), ["availability_unknown_field"]), (changed("event_id", BOOT), ["event_id_mismatch"]), (changed("original_record", "other"), ["digest_mismatch"]), (changed("availability", ["x"]), ["schema"]), (changed("payload", 5), ["schema"]), (changed("sequence", 2**53), ["schema"]),
    (changed("availability/orig_bytes", "UNKNOWN", event("conn", CONN, original_record=None)), ["availability_on_value", "original_record_null"]), (changed("sensor_id", "s-1\n"), ["schema"]), (changed("availability_reasons/service", 5, event("conn", {**CONN, "service": None})), ["schema"]),
]


def test_contract(spark):
    texts = [json.dumps(e) for e in VALID] + [json.dumps(e) for e, _ in INVALID] + ["not json", "[1]", "", None, '"text"']
    want = [[] for _ in VALID] + [c for _, c in INVALID] + [["json_parse_error"]] * 5
    rows = contract.validated(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, value string")).orderBy("i").collect()
    assert [(r.i, r.codes) for r in rows] == list(enumerate(want))
    assert all((r.reason is None) == (not r.codes) for r in rows)
    reasons = {c: r.reason for r in rows for c in r.codes[:1]}
    assert reasons["schema"] == reasons["digest_mismatch"] == reasons["event_id_mismatch"] == "schema_violation" and reasons["availability_null"] == "availability_violation"
    faults = {tuple(r.faults) for r in rows[len(VALID) :]}
    assert ("payload/src_ip",) in faults and ("payload/<unknown field>",) in faults and ("event_time",) in faults


def test_identity(spark):
    frame = spark.createDataFrame([(json.dumps(event("dns", DNS, 4)), "s-1", BOOT, 4), (json.dumps(event("dns", DNS, 4)), "s-2", BOOT, 4), (json.dumps(event("dns", DNS, 4)), "s-1", BOOT, 5)], "value string, s string, b string, n long")
    got = [r.codes for r in contract.validated(frame, "value", (F.col("s"), F.col("b"), F.col("n"))).collect()]
    assert got == [[], ["identity_mismatch", "event_id_mismatch"], ["identity_mismatch", "event_id_mismatch"]]


def test_small_sets_are_exact(spark):
    rows = [(k, i % (k or 1), s) for k in (1, 2, 63, 64, 65, 255) for i in range(2 * k) for s in range(2)] + [(7, None, 0)]
    made = sketches.distinct_sketch(spark.createDataFrame(rows, "k int, i long, s int"), ["k", "s"], F.col("i"))
    one = {(r.k, r.s): r.n for r in made.select("k", "s", sketches.count_of(F.col("sketch")).alias("n")).collect()}
    assert one == {(k, s): k for k in (1, 2, 63, 64, 65, 255) for s in range(2)}
    both = {r.k: r.n for r in sketches.merged(made, ["k"]).select("k", sketches.count_of(F.col("sketch")).alias("n")).collect()}
    assert both == {k: k for k in (1, 2, 63, 64, 65, 255)}


@pytest.mark.parametrize("n", [300, 10_000, 1_000_000])
def test_error_bound(spark, n):
    rows = spark.range(n).withColumn("sec", F.col("id") % 5).withColumn("k", F.lit(1))
    by_second = sketches.distinct_sketch(rows.unionByName(rows.filter("id % 3 = 0").withColumn("sec", (F.col("sec") + 1) % 5)), ["k", "sec"], F.col("id"))
    last = sketches.trailing(by_second, ["k"], "sec", 5).filter("sec = 4").select(sketches.count_of(F.col("sketch")).alias("n"), sketches.is_estimate(F.col("sketch")).alias("e"), F.size("sketch").alias("size")).first()
    assert abs(last.n - n) <= 4 * n / (sketches.KEPT - 2) ** 0.5 and last.e and last.size == sketches.KEPT
