"""Streaming queries over the events table, drained to the end, and the batch twin of the incident stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapline.operators import incidents
from tapline.operators.flows import flow_deltas
from tapline.operators.tables import classify_sequence
from tapline.plans.history import EV
from tapline.plans.ladders import SCANS_SQL, flows_of
from tapline.sources.tables import events
from tapline.streaming import queries as streams
from tapline.streaming import stateful

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query(f"SELECT day * 86400 AS start_s, event_type, count(*) AS n, max(value) AS largest FROM {EV} GROUP BY day, event_type")
def q_stream_tumbling(spark, d):
    return streams.drain(streams.tumbling_counts(streams.event_stream(spark, d)), "update", ["start_s", "event_type"])


@query("SELECT DISTINCT event_id, user_id, event_type FROM events")
def q_stream_dedup(spark, d):
    rows = streams.event_stream(spark, d)
    replayed = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("event_id") % 3 == 0).cast("int")))).drop("copy")
    return streams.drain(streams.deduplicated(replayed).select("event_id", "user_id", "event_type"), "append")


@query(f"""WITH g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) < 43200000000 THEN 0 ELSE 1 END AS fresh FROM {EV}), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, min(us) AS start_us, count(*) AS n FROM s GROUP BY user_id, session""")
def q_stream_session(spark, d):
    return streams.drain(streams.session_counts(streams.event_stream(spark, d)), "complete", ["user_id", "start_us"])


def findings(rows):
    """Events as findings: their type is the class, the user the entity, the value's size the severity."""
    rank = F.when(F.col("value") >= 300, 3).when(F.col("value") >= 100, 2).otherwise(1)
    return rows.select("ts", F.col("event_type").alias("threat_class"), F.col("user_id").cast("string").alias("entity_key"), F.col("ms").alias("window_start_ms"), F.col("ms").alias("obs_ms"), rank.alias("rank"), F.concat(F.lit("k"), (F.col("k") % 4).cast("string")).alias("subtype"), F.col("k").alias("evidence"))


HOURS = 3_600_000


@query(None)
def q_incident_updates(spark, d):
    return incidents.correlate(findings(events(spark, d)).drop("ts"), 48 * HOURS, 6 * HOURS)


@query(None)
def q_stream_incidents(spark, d):
    """The same incidents from state; those still open when the stream ends are not resolved."""
    rows = streams.event_stream(spark, d).withColumn("ms", F.expr("unix_micros(ts) div 1000")).withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return streams.drain(streams.incident_updates(findings(rows), 48 * HOURS, 6 * HOURS), "append")


def observed(rows):
    """Events as flow snapshots: a user's events of a type are a flow, the key its number, large keys its end."""
    rows = rows.withColumn("ms", F.expr("unix_micros(ts) div 1000")).withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return rows.select("ts", "user_id", "event_type", "event_id", "ms", "k", "value", (F.col("k") >= 95).alias("terminal"))


EVER_MS = 10**15
FLOW, ARRIVAL = ["user_id", "event_type"], ["ms", "event_id"]
PAST = "(PARTITION BY user_id, event_type ORDER BY ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
FLOW_DELTAS = f"""WITH e AS (SELECT user_id, event_type, event_id, ms, k, value, k >= 95 AS terminal FROM {EV}),
 a AS (SELECT *, max(CASE WHEN NOT terminal THEN k END) OVER w AS high, coalesce(bool_or(NOT terminal) OVER w, false) AS begun FROM e WINDOW w AS {PAST}),
 b AS (SELECT *, coalesce(bool_or(terminal AND begun) OVER w, false) AS done FROM a WINDOW w AS {PAST}), c AS (SELECT * FROM b WHERE NOT done AND (terminal OR high IS NULL OR k > high))
SELECT user_id, event_type, event_id, k, terminal, NOT begun AS new_flow, greatest(value - coalesce(max(CASE WHEN NOT terminal THEN value END) OVER w, 0), 0) AS d_value FROM c WINDOW w AS {PAST}"""
DELTA_COLUMNS = ["user_id", "event_type", "event_id", "k", "terminal", "new_flow", "d_value"]


@query(FLOW_DELTAS)
def q_terminal_deltas(spark, d):
    rows = observed(events(spark, d).withColumn("ts", F.timestamp_micros("us")))
    return flow_deltas(rows, FLOW, "k", ARRIVAL, ["value"], "terminal").select(*DELTA_COLUMNS)


@query(FLOW_DELTAS)
def q_stream_flow_delta(spark, d):
    """The same deltas from state, as snapshots come; flows are remembered to the end, as the batch operator does."""
    rows = observed(streams.event_stream(spark, d))
    made = stateful.flow_deltas(rows, FLOW, "k", ARRIVAL, ["value"], "terminal", "ms", EVER_MS, EVER_MS)
    return streams.drain(made, "append").select(*DELTA_COLUMNS)


@query(SCANS_SQL)
def q_stream_scans(spark, d):
    """Scan findings as their records come, with an expiring map of pairs for each source."""
    rows = flows_of(streams.event_stream(spark, d).withColumn("ms", F.expr("unix_micros(ts) div 1000")).withColumn("k", F.get_json_object("props", "$.k").cast("long")), "ts")
    found = stateful.scans(rows.withColumn("port_key", F.concat_ws("/", F.col("dport").cast("string"), "proto")), hosts=3, ports=2)
    return streams.drain(found, "append").withColumn("score", F.round("score", 6))


#: Numbers that the window of these queries holds, and the shuffled order in which events arrive, every third one twice.
SEQUENCES = 2048
ARRIVED = "(event_id * 7919 + copy * 3571) % 10007"
STATUSES = f"""WITH e AS (SELECT user_id, event_id, copy, {ARRIVED} AS arrived FROM events, unnest([0, 1]) AS c(copy) WHERE copy <= (event_id % 3 = 0)::INT),
 h AS (SELECT *, max(event_id) OVER w AS high, first_value(event_id) OVER w AS base, row_number() OVER (PARTITION BY user_id, event_id ORDER BY arrived, event_id, copy) > 1 AS again FROM e
 WINDOW w AS (PARTITION BY user_id ORDER BY arrived, event_id, copy ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 s AS (SELECT *, CASE WHEN high IS NULL OR event_id > high THEN 'new' WHEN event_id <= high - {SEQUENCES} OR event_id < base THEN 'stale' WHEN again THEN 'duplicate' ELSE 'reordered' END AS status FROM h)
SELECT user_id, event_id, copy, status, CASE WHEN status = 'new' THEN coalesce(event_id - high - 1, 0) ELSE 0 END AS gap FROM s"""
STATUS_COLUMNS = ["user_id", "event_id", "copy", "status", "gap"]


def arrivals(rows, *more):
    copies = rows.select(*more, "user_id", "event_id", F.explode(F.sequence(F.lit(0), (F.col("event_id") % 3 == 0).cast("int"))).alias("copy"))
    return copies.withColumn("arrived", F.expr(ARRIVED))


@query(STATUSES)
def q_sequence_window(spark, d):
    return classify_sequence(arrivals(events(spark, d)), ["user_id"], "event_id", ["arrived", "event_id", "copy"], SEQUENCES).select(*STATUS_COLUMNS)


@query(STATUSES)
def q_stream_sequence(spark, d):
    """The same statuses from a bitmap that slides with each user's highest number."""
    rows = arrivals(streams.event_stream(spark, d), "ts", F.expr("unix_micros(ts) div 1000").alias("ms"))
    return streams.drain(stateful.classify_sequence(rows, ["user_id"], "event_id", ["arrived", "event_id", "copy"], "ms", SEQUENCES), "append").select(*STATUS_COLUMNS)
