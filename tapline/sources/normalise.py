"""Sensor log lines to envelopes: typed values, and for every missing one why it is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapline.functions.columns import is_ip, uuid5

# Fixed values of the sensor's log format: its field of each payload key.
CONN = {
    "uid": ("uid", "string"), "src_ip": ("id.orig_h", "string"), "src_port": ("id.orig_p", "int"), "dst_ip": ("id.resp_h", "string"), "dst_port": ("id.resp_p", "int"),
    "proto": ("proto", "string"), "service": ("service", "string"), "duration_s": ("duration", "double"), "orig_bytes": ("orig_bytes", "long"), "resp_bytes": ("resp_bytes", "long"),
    "orig_pkts": ("orig_pkts", "long"), "resp_pkts": ("resp_pkts", "long"), "orig_ip_bytes": ("orig_ip_bytes", "long"), "resp_ip_bytes": ("resp_ip_bytes", "long"), "history": ("history", "string"),
    "missed_bytes": ("missed_bytes", "long"), "conn_state": ("conn_state", "string"), "local_orig": ("local_orig", "boolean"), "local_resp": ("local_resp", "boolean"),
}
#: Snapshots of open connections: what they have of a connection's fields, their number and how often they come.
FLOW_UPDATE = {k: v for k, v in CONN.items() if k not in ("missed_bytes", "conn_state", "local_orig", "local_resp")} | {"snapshot_seq": ("snapshot_seq", "long"), "snapshot_interval_s": ("snapshot_interval", "double")}
DNS = {
    "uid": ("uid", "string"), "src_ip": ("id.orig_h", "string"), "src_port": ("id.orig_p", "int"), "dst_ip": ("id.resp_h", "string"), "dst_port": ("id.resp_p", "int"),
    "proto": ("proto", "string"), "query": ("query", "string"), "qtype_name": ("qtype_name", "string"), "rcode_name": ("rcode_name", "string"), "rtt_s": ("rtt", "double"),
    "trans_id": ("trans_id", "int"), "qclass": ("qclass", "int"), "qtype": ("qtype", "int"), "rcode": ("rcode", "int"),
    "aa": ("AA", "boolean"), "tc": ("TC", "boolean"), "rd": ("RD", "boolean"), "ra": ("RA", "boolean"), "rejected": ("rejected", "boolean"),
}
SSL = {
    "uid": ("uid", "string"), "src_ip": ("id.orig_h", "string"), "src_port": ("id.orig_p", "int"), "dst_ip": ("id.resp_h", "string"), "dst_port": ("id.resp_p", "int"),
    "version": ("version", "string"), "cipher": ("cipher", "string"), "curve": ("curve", "string"), "server_name": ("server_name", "string"), "resumed": ("resumed", "boolean"), "established": ("established", "boolean"),
    "next_protocol": ("next_protocol", "string"), "ssl_history": ("ssl_history", "string"), "validation_status": ("validation_status", "string"), "sni_matches_cert": ("sni_matches_cert", "boolean"), "cert_chain_len": ("cert_chain_fps", "length"),
}
WEIRD = {
    "uid": ("uid", "string"), "src_ip": ("id.orig_h", "string"), "src_port": ("id.orig_p", "int"), "dst_ip": ("id.resp_h", "string"), "dst_port": ("id.resp_p", "int"),
    "name": ("name", "string"), "addl": ("addl", "string"), "notice": ("notice", "boolean"), "peer": ("peer", "string"), "source": ("source", "string"),
}
_RESPONDER, _ORIGINATOR = ("resp_bytes", "resp_pkts", "resp_ip_bytes"), ("orig_bytes", "orig_pkts", "orig_ip_bytes")
LARGEST = 2**53 - 1
# Fixed values of the contract: characters of a kept line, bytes of a whole record, answers and their characters.
LONGEST_LINE, MOST_BYTES, MOST_ANSWERS, LONGEST_ANSWER = 4096, 9600, 16, 255
# Fixed values of the contract: texts by pattern, numbers by bounds, transports, and why a field can be absent.
PATTERNS = {
    "service": r"\A[A-Za-z0-9_,.-]{1,64}\z", "history": r"\A[A-Za-z^]{0,64}\z", "ssl_history": r"\A[A-Za-z]{0,64}\z", "qtype_name": r"\A[A-Za-z0-9_*-]{1,16}\z", "rcode_name": r"\A[A-Za-z0-9_-]{1,32}\z",
    "version": r"\A[A-Za-z0-9._ -]{1,16}\z", "cipher": r"\A[A-Za-z0-9_-]{1,128}\z", "curve": r"\A[A-Za-z0-9_-]{1,64}\z", "conn_state": r"\A(S0|S1|SF|REJ|S2|S3|RSTO|RSTR|RSTOS0|RSTRH|SH|SHR|OTH)\z",
}
BOUNDS = {"snapshot_seq": (1, 1_000_000_000), "snapshot_interval_s": (0.1, 3600.0), "trans_id": (0, 65535), "qclass": (0, 65535), "qtype": (0, 65535), "rcode": (0, 65535), "cert_chain_len": (0, 32)}
TRANSPORTS, LONGEST_NAME = ("tcp", "udp", "icmp"), 128
ABSENT = {
    "service": ("UNKNOWN", "no_protocol_identified"), "local_orig": ("UNKNOWN", "site_networks_unconfigured"), "local_resp": ("UNKNOWN", "site_networks_unconfigured"), "rtt_s": ("MISSING", "no_response_observed"), "rcode": ("MISSING", "no_response_observed"), "rcode_name": ("MISSING", "no_response_observed"),
    "version": ("MISSING", "handshake_incomplete"), "cipher": ("MISSING", "handshake_incomplete"), "curve": ("UNKNOWN", "field_absent"), "server_name": ("MISSING", "not_sent_by_client"), "next_protocol": ("NOT_APPLICABLE", "alpn_not_negotiated"), "validation_status": ("UNKNOWN", "validation_not_configured"),
    "cert_chain_len": ("UNKNOWN", "no_certificate_observed"), "sni_matches_cert": ("UNKNOWN", "field_absent"), "addl": ("NOT_APPLICABLE", "no_additional_info"),
}


def _bounded(key: str, value: Column, kind: str) -> Column:
    """The value, or null where it is outside the contract."""
    if key == "proto":
        return F.when(value.isin(*TRANSPORTS), value).otherwise("unknown_transport")
    if key in PATTERNS:
        return F.when(value.rlike(PATTERNS[key]), value)
    if key in BOUNDS:
        return F.when(value.between(*BOUNDS[key]), value)
    if key.endswith("_port"):
        return F.when(value.between(0, 65535), value)
    if kind == "long":
        return F.when(value.between(0, LARGEST), value)
    if kind == "double":
        return F.when(value.between(0.0, 31_536_000.0), value)
    return F.when(F.length(value) <= 255, value) if kind == "string" else value


def clean_name(name: Column) -> Column:
    """A finding's name with characters outside the contract as '_', cut to 128; null for none."""
    return F.when(F.length(name) > 0, F.substring(F.regexp_replace(name, "[^A-Za-z0-9_./:-]", "_"), 1, LONGEST_NAME))


def _typed(raw: Column, source: str, kind: str) -> tuple[Column, Column]:
    """A field's text (null: absent) and its value of a kind; `length` is the number of a list's entries."""
    text = F.get_json_object(raw, f"$['{source}']")
    if kind == "length":
        entries = F.from_json(text, "array<string>")
        return F.when(F.substring(text, 1, 1) == "[", text), F.when(entries.isNotNull(), F.size(entries))
    return text, text.try_cast(kind)


def _absent(key: str, fields: dict[str, tuple[str, str]]) -> tuple[str, str]:
    """The mark and the reason of a field that a line of these fields doesn't have."""
    if fields is WEIRD and (key == "uid" or key.endswith(("_ip", "_port"))):
        return "NOT_APPLICABLE", "not_connection_scoped"
    if fields is WEIRD and key == "source":
        return "NOT_APPLICABLE", "field_absent"
    return ABSENT.get(key, ("MISSING", "field_absent"))


#: Fields without which a line is refused, by what its fields are.
_NEEDED = {"uid": r"\A[A-Za-z0-9]{1,32}\z", "snapshot_seq": None, "snapshot_interval_s": None}


def refusal(line: Column, fields: dict[str, tuple[str, str]], strict: bool = False) -> Column:
    """Why a line can't be expressed as a record of these fields; null if it can.

    It must be a JSON object with a time. With `strict`, it also needs what the contract never lets be null.
    """
    variant = F.try_parse_json(line)
    time = F.get_json_object(line, "$.ts").try_cast("decimal(20,9)")
    reason = F.when(F.coalesce(~F.schema_of_variant(variant).startswith("OBJECT"), F.lit(True)), "not_json").when(time.isNull(), "time_missing")
    if not strict:
        return reason
    if fields is not WEIRD:
        for key, pattern in _NEEDED.items():
            if key in fields:
                text, value = _typed(line, *fields[key])
                good = text.rlike(pattern) if pattern else _bounded(key, value, fields[key][1]).isNotNull()
                reason = reason.when(~F.coalesce(good, F.lit(False)), f"{key}_out_of_contract")
        for key in ("src_ip", "dst_ip"):
            reason = reason.when(~is_ip(_typed(line, *fields[key])[0]), f"{key}_out_of_contract")
        if fields is DNS:
            reason = reason.when(~F.coalesce(_typed(line, *fields["proto"])[0].isin("udp", "tcp"), F.lit(False)), "proto_out_of_contract")
    else:
        reason = reason.when(clean_name(F.get_json_object(line, "$.name")).isNull(), "name_out_of_contract")
    return reason


def refused(lines: DataFrame, fields: dict[str, tuple[str, str]], line: str = "value", sequence: str = "sequence", strict: bool = False) -> DataFrame:
    """invalid_id, reason_code, sequence, raw_sha256, raw_size_bytes, raw_excerpt of the lines that `normalised` leaves out.

    A null line is refused as not_json, with an empty excerpt.
    """
    raw, empty = F.coalesce(F.col(line), F.lit("")), F.lit(None).cast("string")
    bad = lines.select(F.col(sequence).cast("long").alias("sequence"), raw.alias("raw"), refusal(raw, fields, strict).alias("reason_code")).filter("reason_code IS NOT NULL")
    digest = F.sha2("raw", 256)
    named = uuid5("invalid", F.lit("sender"), F.col("reason_code"), digest, empty, empty, F.col("sequence"))
    return bad.select(named.alias("invalid_id"), "reason_code", "sequence", digest.alias("raw_sha256"), F.octet_length("raw").alias("raw_size_bytes"), F.substring("raw", 1, 2048).alias("raw_excerpt"))


def normalised(lines: DataFrame, fields: dict[str, tuple[str, str]], sensor: str, boot: str, coverage: str = "both_directions", line: str = "value", sequence: str = "sequence", strict: bool = False) -> DataFrame:
    """event_id, sequence, event_us, payload, availability, reasons of each line; those that `refusal` gives a reason for are left out.

    The identifier is named by sensor, boot, the line's own sequence and digest, so equal lines of one moment stay apart.
    A record keeps its line only up to 4096 characters, and only while the whole takes no more than 9600 bytes.

    A field that is absent is MISSING, or what ABSENT says of it, one outside its bounds UNKNOWN with a reason. Counters of a direction that the
    sensor doesn't see are null and UNKNOWN, even where it logged a zero: zero and unseen are different things. Times are
    decimal text, rounded half up to microseconds, never through a double.
    """
    raw = F.col(line)
    unseen = {"originator_only": _RESPONDER, "responder_only": _ORIGINATOR}.get(coverage, ())
    values, marks, reasons = [], [], []
    for key, (source, kind) in fields.items():
        text, typed = _typed(raw, source, kind)
        value = F.lit(None).cast(kind) if key in unseen else clean_name(typed) if key == "name" else _bounded(key, typed, kind)
        state, why = _absent(key, fields)
        mark = F.lit("UNKNOWN") if key in unseen else F.when(value.isNull(), F.when(text.isNull(), state).otherwise("UNKNOWN"))
        reason = F.lit("direction_not_observed") if key in unseen else F.when(value.isNull(), F.when(text.isNull(), why).otherwise("value_out_of_contract"))
        values.append(value.alias(key))
        marks.append(F.struct(F.lit(key).alias("key"), mark.alias("value")))
        reasons.append(F.struct(F.lit(key).alias("key"), reason.alias("value")))
    filled = lambda entries: F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))
    micros = F.round(F.get_json_object(raw, "$.ts").try_cast("decimal(20,9)") * 1_000_000).cast("long")
    rows = lines.select(F.col(sequence).cast("long").alias("sequence"), raw.alias("original_record"), refusal(raw, fields, strict).alias("refused"), micros.alias("event_us"), F.struct(*values).alias("payload"), filled(marks).alias("availability"), filled(reasons).alias("availability_reasons"))
    digest = F.sha2("original_record", 256)
    kept = rows.filter("refused IS NULL").drop("refused")
    named = kept.withColumns({"original_record_sha256": digest, "event_id": uuid5("event", F.lit(sensor), F.lit(boot), F.col("sequence"), digest), "observation_coverage": F.lit(coverage)})
    record = F.octet_length(F.to_json(F.struct(*(F.col(c) for c in named.columns))))
    fits = (F.length("original_record") <= LONGEST_LINE) & (record <= MOST_BYTES)
    return named.withColumns({"original_record": F.when(fits, F.col("original_record")), "original_record_truncated": ~fits})


def answers(line: Column, answered: Column) -> Column:
    """answers and answers_truncated of a name lookup: at most 16 texts of 255 characters each.

    A response without answers has an empty list; where there was no response (`answered` is false) the list is null.
    """
    raw = F.from_json(F.get_json_object(line, "$.answers"), "array<string>")
    cut = F.transform(F.slice(raw, 1, MOST_ANSWERS), lambda a: F.substring(a, 1, LONGEST_ANSWER))
    long = (F.size(raw) > MOST_ANSWERS) | F.exists(F.slice(raw, 1, MOST_ANSWERS), lambda a: F.length(a) > LONGEST_ANSWER)
    none = F.when(answered, F.array().cast("array<string>"))
    return F.struct(F.coalesce(cut, none).alias("answers"), F.coalesce(long, F.lit(False)).alias("answers_truncated"))
