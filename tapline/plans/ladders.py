"""Exact detectors over events in the role of flows: an hour of theirs counts as a second."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapline.functions import columns as fn
from tapline.operators import detectors, lexical, names
from tapline.plans.history import EV
from tapline.sources.tables import events, hosts

QUERIES, SQL = {}, {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def flows_of(rows, *more):
    """Users are sources, keys destinations, event types ports; errors are refused connections."""
    kind = F.col("event_type")
    port = F.when(kind == "view", 123).when(kind == "click", 443).when(kind == "error", 502).when(kind == "purchase", 53).otherwise(80)
    ms = F.expr("ms div 3600")
    return rows.select(
        *more, F.col("user_id").cast("string").alias("src"), F.col("k").cast("string").alias("dst"), port.alias("dport"), port.alias("sport"), F.when(port.isin(53, 123), "udp").otherwise("tcp").alias("proto"),
        ms.alias("obs_ms"), ms.alias("start_ms"), F.lit(True).alias("new_flow"), F.lit(True).alias("terminal"), F.when(kind == "error", "S0").otherwise("SF").alias("conn_state"), F.lit("both_directions").alias("coverage"),
        F.round("value").cast("long").alias("orig_bytes"), F.lit(0).cast("long").alias("resp_bytes"),
    )


def flows(spark, d):
    return flows_of(events(spark, d))


FLOWS = f"""(SELECT user_id::VARCHAR AS src, k::VARCHAR AS dst, CASE event_type WHEN 'view' THEN '123/udp' WHEN 'click' THEN '443/tcp' WHEN 'error' THEN '502/tcp' WHEN 'purchase' THEN '53/udp' ELSE '80/tcp' END AS port_key,
 ms // 3600 AS obs_ms, (event_type = 'error')::INT AS lost FROM {EV})"""
SCANS_SQL = f"""WITH RECURSIVE g AS (SELECT *, CASE WHEN obs_ms - lag(obs_ms) OVER (PARTITION BY src ORDER BY obs_ms) <= 30000 THEN 0 ELSE 1 END AS fresh FROM {FLOWS}),
 s AS (SELECT *, sum(fresh) OVER (PARTITION BY src ORDER BY obs_ms RANGE UNBOUNDED PRECEDING) AS span FROM g),
 c AS (SELECT src, span, obs_ms, count(DISTINCT dst) OVER (PARTITION BY src, port_key ORDER BY obs_ms RANGE BETWEEN 30000 PRECEDING AND CURRENT ROW) AS hosts, count(DISTINCT port_key) OVER (PARTITION BY src, dst ORDER BY obs_ms RANGE BETWEEN 30000 PRECEDING AND CURRENT ROW) AS ports,
  sum(lost) OVER (PARTITION BY src, span ORDER BY obs_ms RANGE UNBOUNDED PRECEDING)::DOUBLE / count(*) OVER (PARTITION BY src, span ORDER BY obs_ms RANGE UNBOUNDED PRECEDING) AS failed FROM s),
 x AS (SELECT src, span, obs_ms, failed, 'horizontal_scan' AS subtype, hosts::DOUBLE AS amount, 3 AS least FROM c WHERE hosts >= 3 UNION ALL SELECT src, span, obs_ms, failed, 'vertical_scan', ports::DOUBLE, 2 FROM c WHERE ports >= 2),
 y AS (SELECT src, span, obs_ms, subtype, amount, CASE WHEN amount >= 5 * least OR failed >= 0.8 AND amount >= 2 * least THEN 3 ELSE 2 END AS rank, round(least(1, 0.5::DOUBLE + 0.5::DOUBLE * amount / (4 * least)), 6) AS score FROM x),
 o AS (SELECT *, row_number() OVER (PARTITION BY src, span, subtype ORDER BY obs_ms, rank DESC, amount, score) AS i FROM y),
 r AS (SELECT *, rank AS worst, amount AS told, true AS say FROM o WHERE i = 1 UNION ALL
  SELECT o.*, greatest(r.worst, o.rank), CASE WHEN o.rank > r.worst OR o.amount >= 2 * greatest(1, r.told) THEN o.amount ELSE r.told END, o.rank > r.worst OR o.amount >= 2 * greatest(1, r.told) FROM r JOIN o ON o.src = r.src AND o.span = r.span AND o.subtype = r.subtype AND o.i = r.i + 1)
SELECT src, obs_ms, subtype, CASE rank WHEN 3 THEN 'high' ELSE 'medium' END AS severity, rank, amount, score FROM r WHERE say"""


@query
def q_detect_scans(spark, d):
    return detectors.scans(flows(spark, d), hosts=3, ports=2).withColumn("score", F.round("score", 6))


SQL["q_detect_scans"] = SCANS_SQL


@query
def q_detect_floods(spark, d):
    return detectors.floods(flows(spark, d), flows=4, volume=500.0, syn=2, spoofed=6, amplified=150.0, reflectors=2)


@query
def q_detect_beacons(spark, d):
    by_user = flows(spark, d).withColumn("dst", F.lit("service")).withColumn("dport", F.lit(443)).withColumn("proto", F.lit("tcp"))
    return detectors.beacons(by_user, F.lit(False), interval_ms=1000, variation=1.0)


@query
def q_detect_uploads(spark, d):
    return detectors.uploads(flows(spark, d), volume=150.0, span_ms=5_000, records=2)


@query
def q_name_classifier(spark, d):
    """Labels of hosts against names made from digests: each half of the pages is scored by the model of the other."""
    rows = hosts(spark, d).filter("label <> ''").withColumn("half", F.pmod(F.xxhash64("page_id", "host"), F.lit(2)))
    made = rows.select("page_id", "half", F.substring(F.sha2("host", 256), 1, 14).alias("label"), F.lit(1).alias("generated"))
    both = rows.select("page_id", "half", "label", F.lit(0).alias("generated")).unionByName(made)
    one, other = (both.filter(F.col("half") == k) for k in (0, 1))
    scored = names.score(one, names.train(other)).unionByName(names.score(other, names.train(one)))
    return scored.select("page_id", "generated", F.round("p", 4).alias("p"))


_LABELS = "SELECT page_id, split_part(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), '.', 1) AS label FROM pages"
SQL["q_label_likelihood"] = f"""WITH l AS (SELECT page_id, label, '^' || regexp_replace(label, '[^a-z0-9-]', '?', 'g') || '$' AS framed FROM ({_LABELS}) WHERE label <> ''),
 g AS (SELECT page_id, substr(framed, i::INT, 1) AS a, substr(framed, i::INT, 2) AS pair FROM l, unnest(range(1, length(framed))) AS r(i)),
 n AS (SELECT pair, a, count(*) AS n FROM g GROUP BY ALL), t AS (SELECT a, sum(n) AS total FROM n GROUP BY a)
SELECT page_id, round(avg(ln((n + 1.0::DOUBLE) / (total + 40))), 6) AS likelihood FROM g JOIN n USING (pair) JOIN t ON t.a = g.a GROUP BY page_id"""


@query
def q_label_likelihood(spark, d):
    """How likely each host's label is under the transitions of all labels."""
    rows = hosts(spark, d).filter("label <> ''")
    return rows.select("page_id", F.round(lexical.log_probability(F.col("label"), lexical.transition_table(rows)), 6).alias("likelihood"))


@query
def q_lexical_scores(spark, d):
    """Hosts and names made from digests: each half of the pages is scored by the Newton model of the other half."""
    rows = hosts(spark, d).filter("label <> ''").withColumn("half", F.pmod(F.xxhash64("page_id", "host"), F.lit(2)))
    made = rows.select("page_id", "half", F.concat(F.substring(F.sha2("host", 256), 1, 14), F.lit(".com")).alias("name"), F.lit(1).alias("generated"))
    both = rows.select("page_id", "half", F.col("host").alias("name"), F.lit(0).alias("generated")).unionByName(made)
    out = None
    for half in (0, 1):
        taught = both.filter(F.col("half") != half)
        table = lexical.transition_table(taught.filter("generated = 0").select(fn.second_label(F.col("name")).alias("label")))
        model = lexical.fit(taught.select(lexical.vector(F.col("name"), table).alias("x"), F.col("generated").alias("y")), table)
        scored = lexical.guarded(both.filter(F.col("half") == half).withColumn("x", lexical.vector(F.col("name"), table)), model)
        out = scored if out is None else out.unionByName(scored)
    return out.select("page_id", "generated", F.round("p", 4).alias("p"), "reason")
