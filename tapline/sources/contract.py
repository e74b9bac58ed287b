"""The receiver's contract: declared rules of an envelope and its payloads, compiled into Column predicates.

A record is parsed once into a variant, which keeps the types that JSON gave. Every field of the envelope and of the
record's own kind of payload is held against its rule; then nulls against the marks that explain them, the digest
against the original line, the identifier against what it is made of, and the identity against the link's. All codes
that apply are given. There is no user code in Python: the checks run where the rows are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapline.functions.columns import is_ip, strict_timestamp, uuid5
from tapline.sources.envelope import LARGEST, LOG_TYPES, STATES, VERSION, availability_errors


@dataclass(frozen=True)
class Rule:
    """What a value may be: `kind` is text, whole, number, flag, choice, address, time or texts."""

    kind: str
    pattern: str | None = None
    longest: int | None = None
    low: float = 0
    high: float = LARGEST
    choices: tuple[str, ...] = ()
    null: bool = False

    def ok(self, value: Column) -> Column:
        """Whether a variant follows the rule; an absent field (SQL null) never does."""
        made, text = F.schema_of_variant(value), F.try_variant_get(value, "$", "string")
        if self.kind in ("whole", "number"):
            x = F.try_variant_get(value, "$", "double")
            good = made.rlike(r"^(BIGINT|DOUBLE|DECIMAL)") & x.between(self.low, self.high)
            good = good & (x == F.floor(x)) if self.kind == "whole" else good
        elif self.kind == "flag":
            good = made == "BOOLEAN"
        elif self.kind == "choice":
            good = (made == "STRING") & text.isin(*self.choices)
        elif self.kind == "address":
            good = (made == "STRING") & is_ip(text)
        elif self.kind == "time":
            good = (made == "STRING") & strict_timestamp(text).isNotNull()
        elif self.kind == "texts":
            items = F.try_variant_get(value, "$", "array<variant>")
            good = made.startswith("ARRAY") & (F.size(items) <= int(self.high)) & F.forall(items, lambda x: (F.schema_of_variant(x) == "STRING") & (F.length(F.try_variant_get(x, "$", "string")) <= self.longest))
        else:
            good = made == "STRING"
            good = good & text.rlike(self.pattern) if self.pattern else good
            good = good & (F.length(text) <= self.longest) if self.longest else good
        good = F.coalesce(good, F.lit(False))
        return good | F.coalesce(made == "VOID", F.lit(False)) if self.null else good


def _or_null(rule: Rule) -> Rule:
    return Rule(**{**rule.__dict__, "null": True})


# Fixed values of the record contract.
UUID = Rule("text", r"\A[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z")
TIME, FLAG, COUNT, PORT = Rule("time"), Rule("flag"), Rule("whole", null=True), Rule("whole", high=65535, null=True)
MAYBE, SHORT, SECONDS = _or_null(FLAG), Rule("text", longest=64, null=True), Rule("number", high=31_536_000, null=True)
ENVELOPE = {
    "event_id": UUID,
    "sensor_id": Rule("text", r"\A[a-z0-9][a-z0-9-]{0,62}\z"),
    "sensor_boot_id": UUID,
    "sequence": Rule("whole"),
    "replay_run_id": Rule("text", r"\A[A-Za-z0-9._-]{1,64}\z", null=True),
    "replay_time_offset_us": Rule("whole", low=-LARGEST),
    "log_type": Rule("choice", choices=LOG_TYPES),
    "event_time": TIME,
    "sensor_emitted_at": TIME,
    "receiver_received_at": TIME,
    "capture_mode": Rule("choice", choices=("pcap_replay", "synthetic_log", "passive_live")),
    "observation_coverage": Rule("choice", choices=("both_directions", "originator_only", "responder_only", "unknown")),
    "original_record_sha256": Rule("text", r"\A[0-9a-f]{64}\z"),
    "original_record": Rule("text", longest=4096, null=True),
    "original_record_truncated": FLAG,
}
MAPS = ("availability", "availability_reasons")
PLACES = {"uid": Rule("text", r"\A[A-Za-z0-9]{1,32}\z"), "src_ip": Rule("address"), "src_port": PORT, "dst_ip": Rule("address"), "dst_port": PORT}
COUNTERS = {c: COUNT for c in ("orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts", "orig_ip_bytes", "resp_ip_bytes")}
FLOW = {
    **PLACES,
    "proto": Rule("choice", choices=("tcp", "udp", "icmp", "unknown_transport")),
    "service": Rule("text", r"\A[A-Za-z0-9_,.-]{1,64}\z", null=True),
    "duration_s": SECONDS,
    **COUNTERS,
    "history": Rule("text", r"\A[A-Za-z^]{0,64}\z", null=True),
}
PAYLOADS = {
    "conn": {
        **FLOW,
        "missed_bytes": COUNT,
        "conn_state": Rule("choice", choices=("S0", "S1", "SF", "REJ", "S2", "S3", "RSTO", "RSTR", "RSTOS0", "RSTRH", "SH", "SHR", "OTH"), null=True),
        "local_orig": MAYBE,
        "local_resp": MAYBE,
    },
    "flow_update": {**FLOW, "snapshot_seq": Rule("whole", low=1, high=1_000_000_000), "snapshot_interval_s": Rule("number", low=0.1, high=3600)},
    "dns": {
        **PLACES,
        "proto": Rule("choice", choices=("udp", "tcp")),
        "trans_id": PORT,
        "rtt_s": SECONDS,
        "query": Rule("text", longest=255, null=True),
        "query_truncated": FLAG,
        "qclass": PORT,
        "qtype": PORT,
        "qtype_name": Rule("text", r"\A[A-Za-z0-9_*-]{1,16}\z", null=True),
        "rcode": PORT,
        "rcode_name": Rule("text", r"\A[A-Za-z0-9_-]{1,32}\z", null=True),
        "aa": MAYBE,
        "tc": MAYBE,
        "rd": MAYBE,
        "ra": MAYBE,
        "answers": Rule("texts", longest=255, high=16, null=True),
        "answers_truncated": FLAG,
        "rejected": MAYBE,
    },
    "ssl": {
        **PLACES,
        "version": Rule("text", r"\A[A-Za-z0-9._ -]{1,16}\z", null=True),
        "cipher": Rule("text", r"\A[A-Za-z0-9_-]{1,128}\z", null=True),
        "curve": Rule("text", r"\A[A-Za-z0-9_-]{1,64}\z", null=True),
        "server_name": Rule("text", longest=255, null=True),
        "resumed": MAYBE,
        "established": MAYBE,
        "next_protocol": SHORT,
        "ssl_history": Rule("text", r"\A[A-Za-z]{0,64}\z", null=True),
        "validation_status": Rule("text", longest=128, null=True),
        "cert_chain_len": Rule("whole", high=32, null=True),
        "sni_matches_cert": MAYBE,
    },
    "weird": {
        **{name: _or_null(rule) for name, rule in PLACES.items()},
        "name": Rule("text", r"\A[A-Za-z0-9_./:-]{1,128}\z"),
        "addl": Rule("text", longest=256, null=True),
        "notice": MAYBE,
        "peer": SHORT,
        "source": SHORT,
    },
}
KEY, REASON = r"^[a-z][a-z0-9_]{0,63}$", r"^[a-z0-9_]{1,64}$"


def _field(name: str) -> Column:
    return F.try_variant_get("_v", f"$.{name}", "variant")


def _keys(text: Column) -> Column:
    return F.coalesce(F.json_object_keys(text), F.array().cast("array<string>"))


def _follows(pattern: str):
    """Whether a map's entry has a proper key and a value of the pattern."""
    return lambda e: e["key"].rlike(KEY) & F.coalesce(e["value"].rlike(pattern), F.lit(False))


def _schema_faults(raw: Column) -> Column:
    """The paths that break a rule: of the envelope, of the marks, and of the record's own payload."""
    faults = [F.when(~rule.ok(_field(name)), name) for name, rule in ENVELOPE.items()]
    strange = F.size(F.array_except(_keys(raw), F.array(*map(F.lit, ["event_schema_version", *ENVELOPE, *MAPS, "payload"])))) > 0
    faults.append(F.when(strange, "<unknown field>"))
    for name in MAPS:
        made, entries = F.schema_of_variant(_field(name)), F.map_entries(F.col(f"_{name}"))
        allowed = f"^({'|'.join(STATES)})$" if name == "availability" else REASON
        plain = made.startswith("OBJECT") & ~made.rlike(r": (BIGINT|DOUBLE|DECIMAL|BOOLEAN|VOID|OBJECT|ARRAY)") & (F.size(entries) <= 64)
        good = plain & F.forall(entries, _follows(allowed))
        faults.append(F.when(~F.coalesce(good, F.lit(False)), name))
    faults.append(F.when(~F.coalesce(F.schema_of_variant(_field("payload")).startswith("OBJECT"), F.lit(False)), "payload"))
    kind, shared = F.col("_kind"), {}
    for log_type, fields in PAYLOADS.items():
        for field, rule in fields.items():
            shared.setdefault((field, rule), []).append(log_type)
        beyond = F.size(F.array_except("_keys", F.array(*map(F.lit, fields)))) > 0
        faults.append(F.when((kind == log_type) & beyond, "payload/<unknown field>"))
    for (field, rule), types in shared.items():
        faults.append(F.when(kind.isin(*types) & ~rule.ok(_field(f"payload.{field}")), f"payload/{field}"))
    return F.array_compact(F.array(*faults))


def validated(raw: DataFrame, column: str = "value", identity: tuple[Column, Column, Column] | None = None) -> DataFrame:
    """The rows of `raw` with codes (all that apply), faults (paths that break a rule) and reason (null: accepted).

    `identity` is the link's sensor, boot and sequence. A record that is no JSON object, or has a name twice, has only
    json_parse_error; an unknown version only its own code; cross rules are asked of records that break no field's rule.
    A null or empty record is a parse error.
    """
    text, names = F.col(column), raw.columns
    rows = raw.withColumn("_v", F.try_parse_json(text)).withColumn("_object", F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False)))
    payload = F.get_json_object(text, "$.payload")
    as_map = lambda x: F.from_json(x, "map<string,string>")
    rows = rows.withColumns({"_kind": F.try_variant_get("_v", "$.log_type", "string"), "_keys": _keys(payload), "_values": as_map(payload), **{f"_{m}": as_map(F.get_json_object(text, f"$.{m}")) for m in MAPS}})
    version = F.schema_of_variant(_field("event_schema_version"))
    unsupported = version.isNotNull() & ~F.coalesce((version == "STRING") & (F.try_variant_get("_v", "$.event_schema_version", "string") == VERSION), F.lit(False))
    faults = F.concat(F.when(version.isNull(), F.array(F.lit("event_schema_version"))).otherwise(F.array().cast("array<string>")), _schema_faults(text))
    rows = rows.withColumn("faults", F.when(F.col("_object") & ~unsupported, faults).otherwise(F.array().cast("array<string>")))
    has = lambda name, kind="string": F.try_variant_get("_v", f"$.{name}", kind)
    marks, reasons, original, digest = F.col("_availability"), F.col("_availability_reasons"), has("original_record"), has("original_record_sha256")
    unexplained = F.exists(F.map_keys(reasons), lambda k: ~F.map_contains_key(marks, k))
    sensor, boot, sequence = identity or (has("sensor_id"), has("sensor_boot_id"), has("sequence", "long"))
    same = (has("sensor_id") == sensor) & (has("sensor_boot_id") == boot) & (has("sequence", "long") == sequence)
    crossed = F.concat(
        availability_errors(F.col("_values"), marks),
        F.array_compact(
            F.array(
                F.when(unexplained, "reason_without_availability"),
                F.when(original.isNull() & ~has("original_record_truncated", "boolean"), "original_record_null"),
                F.when(~F.coalesce(same, F.lit(False)), "identity_mismatch"),
                F.when(F.sha2(original, 256) != digest, "digest_mismatch"),
                F.when(uuid5("event", sensor, boot, sequence, digest) != has("event_id"), "event_id_mismatch"),
            )
        ),
    )
    codes = (
        F.when(~F.col("_object"), F.array(F.lit("json_parse_error")))
        .when(unsupported, F.array(F.lit("unsupported_schema_version")))
        .when(F.size("faults") > 0, F.array(F.lit("schema")))
        .otherwise(crossed)
    )
    first = F.try_element_at("codes", F.lit(1))
    violated = F.when(first.isin("schema", "identity_mismatch", "digest_mismatch", "event_id_mismatch"), "schema_violation")
    reason = violated.when(first.isin("json_parse_error", "unsupported_schema_version"), first).when(first.isNotNull(), "availability_violation")
    return rows.withColumn("codes", codes).select(*names, "codes", "faults", reason.alias("reason"))
