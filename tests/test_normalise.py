"""Sensor lines: snapshots, the fields of every kind, and lines that are refused with a reason."""

import json

from tapline.sources import normalise as n

PLACES = {"ts": "1788256800.5", "uid": "C1", "id.orig_h": "10.0.0.1", "id.orig_p": 5, "id.resp_h": "fd00::2", "id.resp_p": 6, "proto": "udp"}


def made(spark, line, fields, coverage="both_directions"):
    return n.normalised(spark.createDataFrame([(1, json.dumps(line))], "sequence long, value string"), fields, "s", "b", coverage).first()


def test_snapshots(spark):
    line = PLACES | {"snapshot_seq": 2, "snapshot_interval": 5.0, "orig_ip_bytes": 10, "resp_ip_bytes": 0, "history": "ShA", "service": "ssl,http", "duration": 31_536_001}
    r = made(spark, line, n.FLOW_UPDATE, "originator_only")
    assert (r.payload.snapshot_seq, r.payload.snapshot_interval_s, r.payload.orig_ip_bytes, r.payload.resp_ip_bytes, r.payload.history, r.payload.service) == (2, 5.0, 10, None, "ShA", "ssl,http")
    assert r.availability["resp_ip_bytes"] == "UNKNOWN" and r.availability_reasons["duration_s"] == "value_out_of_contract" and "conn_state" not in r.payload.asDict()


def test_fields_of_every_kind(spark):
    dns = made(spark, PLACES | {"trans_id": 70000, "qtype": 1, "qtype_name": "A b", "AA": True, "RD": False}, n.DNS).payload
    assert (dns.trans_id, dns.qtype, dns.qtype_name, dns.aa, dns.rd, dns.ra, dns.rcode) == (None, 1, None, True, False, None, None)
    ssl = made(spark, PLACES | {"cert_chain_fps": ["a", "b"], "version": "TLSv12"}, n.SSL)
    assert ssl.payload.cert_chain_len == 2 and ssl.availability["server_name"] == "MISSING" and ssl.availability["next_protocol"] == "NOT_APPLICABLE"
    assert made(spark, PLACES | {"cert_chain_fps": ["x"] * 33}, n.SSL).availability_reasons["cert_chain_len"] == "value_out_of_contract"
    assert made(spark, PLACES, n.SSL).availability_reasons["cert_chain_len"] == "no_certificate_observed"
    weird = made(spark, {"ts": 1.5, "name": "odd name!" + "x" * 200}, n.WEIRD)
    assert weird.payload.name == "odd_name_" + "x" * 119 and weird.availability["src_ip"] == "NOT_APPLICABLE" and weird.availability_reasons["addl"] == "no_additional_info"
    assert made(spark, PLACES | {"proto": "gre", "conn_state": "??"}, n.CONN).payload.proto == "unknown_transport"


def test_no_line_is_lost(spark):
    good = PLACES | {"snapshot_seq": 1, "snapshot_interval": 1}
    lines = [json.dumps(good), "not json", "[1]", None, json.dumps(good | {"ts": "noon"}), json.dumps(good | {"uid": "a b"}), json.dumps(good | {"snapshot_seq": 0}), json.dumps({k: v for k, v in good.items() if k != "snapshot_interval"}), json.dumps(good | {"id.orig_h": "10.0.0.300"})]
    frame = spark.createDataFrame(list(enumerate(lines)), "sequence long, value string")
    out = {r.sequence: r for r in n.refused(frame, n.FLOW_UPDATE, strict=True).collect()}
    assert {i: r.reason_code for i, r in out.items()} == {1: "not_json", 2: "not_json", 3: "not_json", 4: "time_missing", 5: "uid_out_of_contract", 6: "snapshot_seq_out_of_contract", 7: "snapshot_interval_s_out_of_contract", 8: "src_ip_out_of_contract"}
    assert [r.sequence for r in n.normalised(frame, n.FLOW_UPDATE, "s", "b", strict=True).collect()] == [0]
    assert len({r.invalid_id for r in out.values()}) == 8 and out[1].raw_excerpt == "not json" and out[3].raw_size_bytes == 0
    loose = {r.sequence: r.reason_code for r in n.refused(frame, n.FLOW_UPDATE).collect()}
    assert loose == {1: "not_json", 2: "not_json", 3: "not_json", 4: "time_missing"}
    assert {r.reason_code for r in n.refused(frame, n.DNS, strict=True).collect()} >= {"not_json"} and n.refused(frame.limit(0), n.CONN).count() == 0
