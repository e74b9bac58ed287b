"""Functions, envelopes, flow deltas, incidents and storage on small inputs."""

import hashlib
import json
import math
import uuid

import pytest
from pyspark.sql import functions as F

from tapline.functions import columns as fn
from tapline.operators import incidents
from tapline.operators.flows import flow_deltas
from tapline.operators.tables import classify_sequence, nearest_rank
from tapline.sources import envelope, storage


def value(spark, column, *args):
    return spark.range(1).select(column(*map(F.lit, args)).alias("x")).first().x


def test_identifiers(spark):
    name = "scan|src_host|10.10.1.99|1788256800000"
    assert value(spark, lambda *p: fn.uuid5("incident", *p), *name.split("|")) == "a1fc3f70-e4d2-5474-a401-e2821a927b4c"
    assert value(spark, lambda a: fn.uuid5("invalid", a, F.lit(None)), "x") == str(uuid.uuid5(uuid.UUID(fn.NAMESPACES["invalid"]), "x|"))


@pytest.mark.parametrize("text", ["", "a", "aab", "x9k2q7zz", "a-b.c"])
def test_text_features(spark, text):
    shares = [text.count(c) / len(text) for c in set(text)]
    assert value(spark, fn.entropy, text) == pytest.approx(-sum(p * math.log2(p) for p in shares))
    h = 2166136261
    for b in text.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    assert value(spark, fn.fnv1a32, text) == h


def test_names(spark):
    for name, expected in (("www.example.com", "example.com"), ("a.b.co.uk", "b.co.uk"), ("co.uk", "co.uk"), ("a..com", None), ("12.34", None), ("host", None), ("x.local", None), ("1.2.3.4", None)):
        assert value(spark, fn.registrable, name) == expected
    assert value(spark, fn.normal_name, " WWW.Example.COM.. ") == "www.example.com" and value(spark, fn.normal_name, "...") is None
    assert value(spark, fn.ipv4_number, "10.0.0.1") == 167772161 and value(spark, fn.ipv4_number, "10.0.0.01") is None
    assert value(spark, lambda t: fn.bucket_up(t, 10), 20) == 30


def test_timestamps(spark):
    good, bad = "2026-09-01T10:00:00.5Z", ("2026-09-01T10:00:00", "2026-09-01T10:00:00+05:30", "2026-09-01T10:00:00.1234567Z", "x")
    assert value(spark, fn.strict_timestamp, good) is not None and all(value(spark, fn.strict_timestamp, b) is None for b in bad)


def record(**changes):
    made = {"event_schema_version": "1.0.0", "event_id": "e", "sensor_id": "s", "sensor_boot_id": "b", "sequence": 1, "replay_run_id": None, "replay_time_offset_us": -1500, "log_type": "conn", "event_time": "2026-09-01T10:00:00Z", "sensor_emitted_at": "2026-09-01T10:00:01Z", "receiver_received_at": "2026-09-01T10:00:02Z", "observation_coverage": "both_directions", "availability": {}, "availability_reasons": {}, "payload": {"uid": "u", "src_ip": "10.0.0.1", "duration_s": 2.0, "orig_bytes": 0}}
    return json.dumps({**made, **changes})


def test_envelopes(spark):
    lines = [record(), "nope", "[1]", record(event_schema_version="2.0.0"), record(log_type="http"), record(event_time="2026-09-01 10:00"), record(payload=None), record(log_type="dns")]
    rows = envelope.parsed(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert [r.reason for r in rows.collect()] == [None, "json_parse_error", "json_parse_error", "unsupported_schema_version", "unknown_log_type", "field_bound_violation", "field_bound_violation", None]
    conn = envelope.view(envelope.accepted(rows), "conn").first()
    dns = envelope.view(envelope.accepted(rows), "dns").first()
    assert conn.obs_ms - dns.obs_ms == 2000 and conn.orig_bytes == 0 and conn.resp_bytes is None
    bad = {r.raw_sha256: r for r in envelope.quarantined(rows).collect()}
    digest = hashlib.sha256(b"nope").hexdigest()
    assert len(bad) == 6 and bad[digest].invalid_id == str(uuid.uuid5(uuid.UUID(fn.NAMESPACES["invalid"]), f"detect|json_parse_error|{digest}|||"))
    codes = spark.createDataFrame([({"a": None, "b": "1"}, {"b": "UNKNOWN", "c": "MISSING"})], "v map<string,string>, a map<string,string>").select(envelope.availability_errors(F.col("v"), F.col("a")).alias("x")).first().x
    assert codes == ["availability_null", "availability_on_value", "availability_unknown_field"]


def test_flow_deltas(spark):
    rows = [("f", 1, 1, 1000), ("f", 2, 1, 1000), ("f", 3, 2, 900), ("f", 4, 9, 5000), ("f", 5, 3, 4000), ("g", 1, 1, None)]
    got = flow_deltas(spark.createDataFrame(rows, "flow string, t int, seq int, bytes long"), ["flow"], "seq", ["t"], ["bytes"]).orderBy("flow", "t").collect()
    assert [(r.t, r.d_bytes, r.new_flow) for r in got] == [(1, 1000, True), (3, 0, False), (4, 4000, False), (1, None, True)]


def test_terminal_records(spark):
    rows = [("f", 1, 1, 1000, False), ("f", 2, 1, 1000, False), ("f", 3, 2, 900, False), ("f", 4, None, 5000, True), ("f", 5, 3, 6000, False), ("g", 1, None, 70, True), ("g", 2, 1, 90, False)]
    frame = spark.createDataFrame(rows, "flow string, t int, seq int, bytes long, over boolean")
    got = flow_deltas(frame, ["flow"], "seq", ["t"], ["bytes"], "over").orderBy("flow", "t").collect()
    assert [(r.flow, r.t, r.d_bytes, r.new_flow) for r in got] == [("f", 1, 1000, True), ("f", 3, 0, False), ("f", 4, 4000, False), ("g", 1, 70, True), ("g", 2, 90, True)]
    assert sum(r.d_bytes for r in got if r.flow == "f") == 5000


def test_sequences(spark):
    rows = [("s", t, q) for t, q in enumerate([5, 6, 9, 7, 7, 4, 10])]
    got = classify_sequence(spark.createDataFrame(rows, "stream string, t int, seq long"), ["stream"], "seq", ["t"]).orderBy("t").collect()
    assert [(r.status, r.gap) for r in got] == [("new", 0), ("new", 0), ("new", 2), ("reordered", 0), ("duplicate", 0), ("stale", 0), ("new", 0)]


def test_nearest_rank(spark):
    data = sorted([1.5, 2.5, 2.5, 7.0, 100.0, 3.25])
    got = {r.share: r.value for r in nearest_rank(spark.createDataFrame([(x,) for x in data], "v double"), "v", [0.0, 0.5, 0.95, 1.0]).collect()}
    assert got == {p: data[min(len(data) - 1, int(p * len(data)))] for p in got}


FINDINGS = "threat_class string, entity_key string, window_start_ms long, obs_ms long, rank int, subtype string, evidence long"


def test_incident_ladder(spark):
    rows = [("scan", "h", 0, 1_000, 2, "a", 20), ("scan", "h", 0, 2_000, 2, "a", 20), ("scan", "h", 0, 3_000, 3, "a", 25), ("scan", "h", 0, 4_000, 2, "b", 25), ("scan", "h", 0, 70_000, 2, "b", 30), ("scan", "h", 400_000, 400_000, 2, "a", 5), ("beaconing", "h", 0, 1_000, 1, "p", 8), ("beaconing", "h", 0, 1_500_000, 1, "p", 9)]
    frame = spark.createDataFrame(rows, FINDINGS)
    got = [(r.threat_class, r.update_seq, r.status, r.rank) for r in incidents.correlate(frame).orderBy("threat_class", "window_start_ms", "update_seq").collect()]
    assert got == [("beaconing", 1, "new", 1), ("beaconing", 2, "updated", 1), ("beaconing", 3, "resolved", 1), ("scan", 1, "new", 2), ("scan", 2, "escalated", 3), ("scan", 3, "updated", 3), ("scan", 4, "updated", 3), ("scan", 5, "resolved", 3), ("scan", 1, "new", 2), ("scan", 2, "resolved", 2)]
    ids = lambda f: sorted(r.update_id for r in incidents.correlate(f).collect())
    assert ids(frame) == ids(frame.repartition(3)) and len(set(ids(frame))) == len(got)


def test_storage(spark, tmp_path):
    rows = spark.createDataFrame([("a", "new", 3), ("a", "new", 3), ("b", "updated", 4), ("c", "escalated", 3), ("d", "new", 1)], "update_id string, status string, rank int")
    due = storage.to_notify(rows, spark.createDataFrame([("c",)], "update_id string"))
    assert [r.update_id for r in due.collect()] == ["a"]
    made = storage.export_partition(rows, str(tmp_path / "day"))
    assert made[0] == 5 and storage.verify_archive(spark, str(tmp_path / "day"), rows.schema, made)
    assert not storage.verify_archive(spark, str(tmp_path / "day"), rows.schema, (5, made[1] + 1))


def test_normaliser(spark):
    from tapline.sources.normalise import CONN, DNS, normalised

    line = json.dumps({"ts": "1788256800.1234565", "uid": "u", "id.orig_h": "10.0.0.1", "id.orig_p": 70000, "orig_bytes": 0, "resp_bytes": 0, "proto": "tcp"})
    rows = spark.createDataFrame([(7, line), (8, "nope"), (9, '{"uid": "x"}')], "sequence long, value string")
    both = normalised(rows, CONN, "s", "b").collect()
    assert len(both) == 1 and both[0].event_us == 1788256800123457
    assert both[0].payload.orig_bytes == 0 and "orig_bytes" not in both[0].availability
    assert both[0].payload.src_port is None and both[0].availability["src_port"] == "UNKNOWN" and both[0].availability_reasons["src_port"] == "value_out_of_contract"
    assert both[0].availability["service"] == "UNKNOWN" and both[0].availability_reasons["service"] == "no_protocol_identified"
    assert both[0].availability["history"] == "MISSING"
    half = normalised(rows, CONN, "s", "b", "originator_only").first()
    assert half.payload.resp_bytes is None and half.availability["resp_bytes"] == "UNKNOWN" and half.payload.orig_bytes == 0
    assert normalised(rows, DNS, "s", "b").first().availability["query"] == "MISSING"
    assert both[0].event_id == str(uuid.uuid5(uuid.UUID(fn.NAMESPACES["event"]), f"s|b|7|{hashlib.sha256(line.encode()).hexdigest()}"))


def test_bounds(spark):
    from tapline.operators import records

    assert [value(spark, records.clean_score, x) for x in (0.1234565, 2.0, -1.0, float("nan"))] == [0.123456, 1.0, 0.0, None]
    ids = spark.createDataFrame([([1, 2, 2, 3, 4],)], "x array<int>").select(records.last_ids(F.col("x"), 2).alias("y")).first().y
    assert ids == [3, 4]


def test_addresses(spark):
    import ipaddress

    texts = ["1.2.3.4", "::1", "fe80::1", "1:2:3:4:5:6:7:8", "::ffff:1.2.3.4", "1::2::3", ":1::2", "12345::", "2001:db8::", "::", "1:2:3:4:5:6:7::", "1:2:3:4:5:6:7", "a", "", "1.2.3", "::1.2.3.400", "FD00::12", "1:2:3:4:5:6:1.2.3.4", "fe80::1%eth0", "::1:2:3:4:5:6:7:8", ":::", "0.0.0.0.", "g::"]
    nets = ["fd00::/7", "1.0.0.0/8", "2001:db8::/33"]

    def plain(text):
        try:
            return ipaddress.ip_address(text) if 2 <= len(text) <= 45 and "%" not in text else None
        except ValueError:
            return None

    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", fn.is_ip(F.col("t")).alias("ip"), fn.in_networks(F.col("t"), nets).alias("inside")).collect():
        address = plain(r.t)
        assert r.ip == (address is not None)
        assert r.inside == (address is not None and any(address in ipaddress.ip_network(n, strict=False) for n in nets))


def test_observed_names(spark):
    from tapline.operators import observe

    cases = {None: "query_unavailable", "host.corp.example": "allowlisted", "10.0.0.1.": "not_registrable", "fd00::1": "not_registrable", "single": "not_registrable", "x" * 254 + ".com": "query_out_of_range", "abc.com": "label_too_short", "www.longenough.co.uk": "model_unavailable"}
    rows = observe.named(spark.createDataFrame([(q,) for q in cases], "query string"), ["corp.example"]).collect()
    assert {r.query: r.reason for r in rows} == cases
    by = {r.query: r for r in rows}
    assert (by["abc.com"].registrable, by["abc.com"].lexical) == ("abc.com", None)
    assert (by["www.longenough.co.uk"].registrable, by["www.longenough.co.uk"].sub) == ("longenough.co.uk", "www")
    assert observe.named(spark.createDataFrame([("x9k2q7zzwv1bq.com",)], "query string"), []).first().looks_generated


def test_tls_indicators(spark):
    from tapline.operators import observe

    rows = [("TLSv10", None, "MISSING", 8080, None), ("TLSv13", "a.example", None, 443, "ok"), (None, None, "MISSING", None, None)]
    got = observe.tls_indicators(spark.createDataFrame(rows, "version string, server_name string, server_name_mark string, dst_port int, validation_status string"), F.lit(True)).collect()
    assert [(r.available, r.positive) for r in got] == [(5, 4), (6, 1), (1, 1)]
    assert got[0].score == pytest.approx(0.75 / 0.95) and got[1].score == pytest.approx(0.1 / 1.2) and got[2].score is None


def test_moments(spark):
    got = spark.createDataFrame([([4.0, 8.0, 2.0],)], "x array<double>").select(fn.ewma_moments(F.col("x"), 0.5).alias("s")).first().s
    assert (got.n, got.mean) == (3, 4.0) and got["var"] == pytest.approx(0.5 * (0.5 * 0.5 * 16 + 0.5 * 16))


def test_answers_and_sizes(spark):
    from tapline.sources.normalise import CONN, answers, normalised

    lines = [(json.dumps({"answers": ["a" * 300, *map(str, range(20))]}), True), ("{}", True), ("{}", False)]
    got = [r.x for r in spark.createDataFrame(lines, "v string, answered boolean").select(answers(F.col("v"), F.col("answered")).alias("x")).collect()]
    assert (len(got[0].answers), len(got[0].answers[0]), got[0].answers_truncated) == (16, 255, True)
    assert (got[1].answers, got[1].answers_truncated, got[2].answers) == ([], False, None)
    wide = [json.dumps({"ts": 1, "uid": "u", "x": "y" * n}) for n in (10, 4000, 5000)]
    kept = normalised(spark.createDataFrame(list(enumerate(wide)), "sequence long, value string"), CONN, "s", "b").orderBy("sequence").collect()
    assert [r.original_record_truncated for r in kept] == [False, False, True] and len({r.event_id for r in kept}) == 3


def test_incident_entity_types(spark):
    rows = [("flood", "dst_host", "h", 1_000, 1_000, 2, "a", 20), ("flood", "src_host", "h", 1_000, 1_000, 2, "a", 20)]
    got = incidents.correlate(spark.createDataFrame(rows, FINDINGS.replace("entity_key", "entity_type string, entity_key"))).filter("status = 'new'").collect()
    space = uuid.UUID(fn.NAMESPACES["incident"])
    assert {r.incident_id for r in got} == {str(uuid.uuid5(space, f"flood|{kind}|h|1000")) for kind in ("dst_host", "src_host")}
