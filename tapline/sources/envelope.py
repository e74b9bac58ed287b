"""Envelope records: strict parsing of JSON lines, quarantine of what fails, and typed payload views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapline.functions.columns import strict_timestamp, uuid5

# Fixed values of the record contract.
VERSION = "1.0.0"
LOG_TYPES = ("conn", "flow_update", "dns", "ssl", "weird")
STATES = ("MISSING", "NOT_APPLICABLE", "UNKNOWN")
LARGEST = 2**53 - 1

_ADDRESSES = "uid string, src_ip string, src_port int, dst_ip string, dst_port int"
#: One wide payload: the union of all log types' keys; a type's own view selects what it has.
PAYLOAD = (
    f"{_ADDRESSES}, proto string, service string, duration_s double, orig_bytes long, resp_bytes long, orig_pkts long, resp_pkts long, "
    "orig_ip_bytes long, resp_ip_bytes long, missed_bytes long, conn_state string, history string, local_orig boolean, local_resp boolean, "
    "snapshot_seq long, snapshot_interval_s double, query string, qtype_name string, rcode_name string, answers array<string>, rejected boolean, "
    "version string, cipher string, server_name string, resumed boolean, established boolean, next_protocol string, validation_status string, "
    "cert_chain_len int, sni_matches_cert boolean, name string, notice boolean, source string"
)


def envelope_schema() -> T.StructType:
    """The schema of an envelope; it is declared, never inferred."""
    names = "event_schema_version event_id sensor_id sensor_boot_id".split()
    out = T.StructType([T.StructField(n, T.StringType()) for n in names])
    out = out.add("sequence", T.LongType()).add("replay_run_id", T.StringType()).add("replay_time_offset_us", T.LongType())
    for n in "log_type event_time sensor_emitted_at receiver_received_at capture_mode observation_coverage original_record_sha256 original_record".split():
        out = out.add(n, T.StringType())
    marks = T.MapType(T.StringType(), T.StringType())
    return out.add("original_record_truncated", T.BooleanType()).add("availability", marks).add("availability_reasons", marks).add("payload", payload_schema())


def payload_schema() -> T.StructType:
    kinds = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "array<string>": T.ArrayType(T.StringType())}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (f.split(" ") for f in PAYLOAD.split(", "))])


def parsed(raw: DataFrame, column: str = "value") -> DataFrame:
    """raw, reason and, where reason is null, the envelope's fields with obs_us, the time all windows use.

    Observation time is event time plus the replay offset, plus the duration for finished connections. Unknown versions
    are refused, not coerced; a record that isn't a JSON object is a parse error.
    """
    text = F.col(column)
    rows = raw.select(text.alias("raw"), F.from_json(text, envelope_schema(), {"mode": "PERMISSIVE"}).alias("e"), F.try_parse_json(text).alias("v"))
    start, received = strict_timestamp(F.col("e.event_time")), strict_timestamp(F.col("e.receiver_received_at"))
    is_object = F.schema_of_variant("v").startswith("OBJECT")
    reason = (
        F.when(F.col("v").isNull() | ~is_object, "json_parse_error")
        .when(F.coalesce(F.col("e.event_schema_version"), F.lit("")) != VERSION, "unsupported_schema_version")
        .when(~F.coalesce(F.col("e.log_type"), F.lit("")).isin(*LOG_TYPES), "unknown_log_type")
        .when(start.isNull() | received.isNull() | F.col("e.event_id").isNull() | F.col("e.sensor_id").isNull() | F.col("e.sensor_boot_id").isNull() | F.col("e.replay_time_offset_us").isNull() | F.col("e.payload").isNull() | ~F.coalesce(F.col("e.sequence"), F.lit(0)).between(0, LARGEST), "field_bound_violation")
    )
    extra = F.when(F.col("e.log_type") == "conn", F.coalesce(F.bround(F.col("e.payload.duration_s") * 1_000_000).cast("long"), F.lit(0))).otherwise(0)
    observed = F.unix_micros(start) + F.col("e.replay_time_offset_us") + extra
    return rows.select("raw", reason.alias("reason"), "e.*", observed.alias("obs_us"))


def accepted(records: DataFrame) -> DataFrame:
    return records.filter("reason IS NULL").drop("raw", "reason").withColumn("obs_ms", F.expr("cast(floor(obs_us / 1000) as bigint)"))


def quarantined(records: DataFrame, stage: str = "detect") -> DataFrame:
    """invalid_id, reason_code, raw_sha256, raw_size_bytes, raw_excerpt of the records that were refused."""
    bad = records.filter("reason IS NOT NULL").select("reason", "raw", F.sha2("raw", 256).alias("digest"))
    empty = F.lit(None).cast("string")
    return bad.select(uuid5("invalid", F.lit(stage), F.col("reason"), F.col("digest"), empty, empty, empty).alias("invalid_id"), F.col("reason").alias("reason_code"), F.col("digest").alias("raw_sha256"), F.octet_length("raw").alias("raw_size_bytes"), F.substring("raw", 1, 2048).alias("raw_excerpt"))


def availability_errors(values: Column, availability: Column) -> Column:
    """Codes of a record whose null and marked fields disagree: a null needs a mark, a value must have none."""
    unmarked = F.exists(F.map_entries(values), lambda e: e["value"].isNull() & ~F.map_contains_key(availability, e["key"]))
    marked = F.exists(F.map_entries(values), lambda e: e["value"].isNotNull() & F.map_contains_key(availability, e["key"]))
    unknown = F.exists(F.map_keys(availability), lambda k: ~F.map_contains_key(values, k))
    return F.array_compact(F.array(F.when(unmarked, "availability_null"), F.when(marked, "availability_on_value"), F.when(unknown, "availability_unknown_field")))


def view(records: DataFrame, log_type: str) -> DataFrame:
    """The accepted records of one log type with their payload's fields beside the envelope's."""
    rows = records.filter(F.col("log_type") == log_type)
    return rows.select("event_id", "sensor_id", F.col("sensor_boot_id").alias("boot"), F.coalesce("replay_run_id", F.lit("")).alias("run"), "sequence", "observation_coverage", "obs_ms", "availability", "payload.*")
