"""Detector queries: flows, scans, floods, beacons, uploads, TLS metadata, sessions, identifiers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapline.functions import columns as fn
from tapline.operators import detect, sweeps
from tapline.operators import tables as ops
from tapline.operators.flows import flow_deltas
from tapline.plans.history import EV
from tapline.sources.tables import events, table

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


RAW = "CASE WHEN event_id % 7 = 0 THEN 'not json' WHEN event_id % 11 = 0 THEN '{\"k\": \"x\"}' WHEN event_id % 13 = 0 THEN '{\"j\": 1}' ELSE props END"


@query(f"""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN NOT json_valid(raw) THEN 'json_parse_error' WHEN json_extract_string(raw, '$.k') IS NULL THEN 'missing_field'
 WHEN NOT regexp_full_match(json_extract_string(raw, '$.k'), '[0-9]+') THEN 'field_bound_violation' WHEN CAST(json_extract_string(raw, '$.k') AS BIGINT) > 90 THEN 'field_bound_violation' END AS reason
 FROM (SELECT {RAW} AS raw FROM events)) WHERE reason IS NOT NULL GROUP BY reason""")
def q_parse_quarantine(spark, d):
    rows = table(spark, d, "events").select(F.expr(RAW).alias("raw"))
    k = F.get_json_object("raw", "$.k")
    reason = F.when(F.try_parse_json(F.col("raw")).isNull(), "json_parse_error").when(k.isNull(), "missing_field").when(~k.rlike("^[0-9]+$"), "field_bound_violation").when(F.expr("try_cast(get_json_object(raw, '$.k') AS BIGINT)") > 90, "field_bound_violation")
    return rows.select(reason.alias("reason")).filter("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey, field, state FROM (SELECT c_custkey, unnest(['first_order', 'spent']) AS field, unnest([CASE WHEN first_order IS NULL THEN 'MISSING' ELSE 'PRESENT' END, CASE WHEN spent IS NULL THEN 'UNKNOWN' ELSE 'PRESENT' END]) AS state
 FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS first_order, CASE WHEN count(*) >= 8 THEN sum(o_totalprice) END AS spent FROM orders GROUP BY 1) ON c_custkey = o_custkey)""")
def q_availability_map(spark, d):
    spent = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderkey").alias("first_order"), F.when(F.count("*") >= 8, F.sum("o_totalprice")).alias("spent"))
    rows = table(spark, d, "customer").select("c_custkey").join(spent, "c_custkey", "left")
    states = F.create_map(F.lit("first_order"), F.when(F.col("first_order").isNull(), "MISSING").otherwise("PRESENT"), F.lit("spent"), F.when(F.col("spent").isNull(), "UNKNOWN").otherwise("PRESENT"))
    return rows.select("c_custkey", F.explode(states).alias("field", "state"))


ARRIVAL = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
DELTAS = f"""(WITH a AS (SELECT *, max(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY {', '.join(ARRIVAL)} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM lineitem), b AS (SELECT * FROM a WHERE high IS NULL OR l_linenumber > high)
 SELECT l_orderkey, l_linenumber, l_returnflag, high IS NULL AS new_flow, greatest(l_quantity - coalesce(max(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY {', '.join(ARRIVAL)} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS d_l_quantity FROM b)"""


def lineitem_deltas(spark, d):
    return flow_deltas(table(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber", ARRIVAL, ["l_quantity"])


@query(f"SELECT l_orderkey, l_linenumber, new_flow, d_l_quantity FROM {DELTAS}")
def q_flow_delta(spark, d):
    return lineitem_deltas(spark, d).select("l_orderkey", "l_linenumber", "new_flow", "d_l_quantity")


@query(f"SELECT l_returnflag, count(*) AS flows, sum(d_l_quantity) AS quantity FROM {DELTAS} WHERE new_flow GROUP BY l_returnflag")
def q_new_flows(spark, d):
    return lineitem_deltas(spark, d).filter("new_flow").groupBy("l_returnflag").agg(F.count("*").alias("flows"), F.sum("d_l_quantity").alias("quantity"))


@query(f"SELECT user_id, event_type, day, n_peers, CASE WHEN n_peers >= 10 THEN 'high' ELSE 'medium' END AS severity FROM (SELECT user_id, event_type, day, count(DISTINCT k) AS n_peers FROM {EV} GROUP BY ALL) WHERE n_peers >= 2")
def q_scan_horizontal(spark, d):
    return detect.distinct_peers(events(spark, d), ["user_id", "event_type", "day"], "k", 2, "n_peers")


@query(f"SELECT user_id, k, n_ports, CASE WHEN n_ports >= 10 THEN 'high' ELSE 'medium' END AS severity FROM (SELECT user_id, k, count(DISTINCT event_type) AS n_ports FROM {EV} GROUP BY ALL) WHERE n_ports >= 2")
def q_scan_vertical(spark, d):
    return detect.distinct_peers(events(spark, d), ["user_id", "k"], "event_type", 2, "n_ports")


@query(f"SELECT event_id, count(DISTINCT k) OVER (PARTITION BY user_id ORDER BY ms RANGE BETWEEN 21600000 PRECEDING AND CURRENT ROW) AS peers FROM {EV}")
def q_scan_trailing_distinct(spark, d):
    rows = events(spark, d)
    return rows.select("event_id", F.size(F.collect_set("k").over(detect.trailing(["user_id"], "ms", 21_600_000))).cast("long").alias("peers"))


@query(f"SELECT DISTINCT user_id, ms, count(DISTINCT k) OVER (PARTITION BY user_id ORDER BY ms RANGE BETWEEN 21600000 PRECEDING AND CURRENT ROW) AS peers FROM {EV}")
def q_contact_sweep(spark, d):
    """The same counts at each time, without arrays: contact intervals, summed."""
    return sweeps.trailing_distinct(events(spark, d), ["user_id"], ["k"], "ms", 21_600_000, name="peers")


@query(f"SELECT DISTINCT k, hour, ms, count(*) OVER w AS flows, sum((event_type = 'error')::INT) OVER w AS failed FROM {EV} WINDOW w AS (PARTITION BY k, hour ORDER BY ms RANGE UNBOUNDED PRECEDING)")
def q_flood_running_totals(spark, d):
    """Totals of a destination's hour so far, at every flow: what a flood is judged by before its second has closed."""
    rows = events(spark, d)
    totals = sweeps.running_sums(rows.withColumns({"flows": F.lit(1).cast("long"), "failed": (F.col("event_type") == "error").cast("long")}), ["k", "hour"], "ms", ["flows", "failed"], 600_000)
    return totals.select("k", "hour", "ms", "flows", "failed")


@query("SELECT user_id, count(*) FILTER (event_type = 'error') AS failed, count(*) AS known, round(count(*) FILTER (event_type = 'error') / count(*)::DOUBLE, 6) AS ratio FROM events GROUP BY user_id")
def q_failed_ratio(spark, d):
    rows = table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("failed"), F.count("*").alias("known"))
    return rows.withColumn("ratio", F.round(F.col("failed") / F.col("known"), 6))


@query(f"SELECT k, hour, flows, sum(flows) OVER (PARTITION BY k ORDER BY hour RANGE BETWEEN 4 PRECEDING AND CURRENT ROW)::BIGINT AS flows5 FROM (SELECT k, hour, count(*) AS flows FROM {EV} GROUP BY k, hour)")
def q_flood_second_buckets(spark, d):
    rows = events(spark, d).groupBy("k", "hour").agg(F.count("*").alias("flows"))
    return rows.withColumn("flows5", F.sum("flows").over(Window.partitionBy("k").orderBy("hour").rangeBetween(-4, 0)))


@query("SELECT o_custkey, CASE WHEN count(*) FILTER (q IS NULL) = 0 THEN sum(q) END AS quantity, count(*) AS n FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1) ON o_orderkey = l_orderkey GROUP BY o_custkey")
def q_flood_null_poison_bytes(spark, d):
    quantity = table(spark, d, "lineitem").filter("l_returnflag <> 'N'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("q"))
    return table(spark, d, "orders").join(quantity, "o_orderkey", "left").groupBy("o_custkey").agg(fn.poisoned_sum(F.col("q")).alias("quantity"), F.count("*").alias("n"))


@query(f"""SELECT k, day, CASE WHEN amp >= 150 AND srcs >= 2 THEN 'amplification' WHEN srcs >= 4 AND flows / srcs::DOUBLE <= 1.5 THEN 'spoofed' WHEN failed >= 2 AND failed >= 0.8 * flows THEN 'syn' WHEN flows >= 6 THEN 'volumetric' END AS subtype
 FROM (SELECT k, day, count(*) AS flows, count(DISTINCT user_id) AS srcs, count(*) FILTER (event_type = 'error') AS failed, coalesce(sum(value) FILTER (event_type = 'view'), 0) AS amp FROM {EV} GROUP BY k, day)""")
def q_flood_subtype(spark, d):
    kind = F.col("event_type")
    rows = events(spark, d).groupBy("k", "day").agg(F.count("*").alias("flows"), F.countDistinct("user_id").alias("srcs"), F.count_if(kind == "error").alias("failed"), F.coalesce(F.sum(F.when(kind == "view", F.col("value"))), F.lit(0.0)).alias("amp"))
    subtype = F.expr("CASE WHEN amp >= 150 AND srcs >= 2 THEN 'amplification' WHEN srcs >= 4 AND flows / srcs <= 1.5 THEN 'spoofed' WHEN failed >= 2 AND failed >= 0.8 * flows THEN 'syn' WHEN flows >= 6 THEN 'volumetric' END")
    return rows.select("k", "day", subtype.alias("subtype"))


@query(f"SELECT event_type, round(list_reduce(list(n::DOUBLE ORDER BY day), lambda a, x: a + 0.05 * (x - a)), 4) AS mean, count(*) AS days FROM (SELECT event_type, day, count(*) AS n FROM {EV} GROUP BY ALL) GROUP BY event_type")
def q_ewma_baseline(spark, d):
    daily = events(spark, d).groupBy("event_type", "day").agg(F.count("*").alias("n"))
    series = daily.groupBy("event_type").agg(F.array_sort(F.collect_list(F.struct("day", "n"))).alias("series"))
    return series.select("event_type", F.round(fn.ewma(F.col("series.n"), 0.05), 4).alias("mean"), F.size("series").cast("long").alias("days"))


@query(f"""WITH s AS (SELECT DISTINCT user_id, event_type, ms FROM {EV}), i AS (SELECT *, ms - lag(ms) OVER (PARTITION BY user_id, event_type ORDER BY ms) AS iat FROM s),
 m AS (SELECT user_id, event_type, count(*) AS n, median(iat) AS med FROM i GROUP BY ALL HAVING count(*) >= 8 AND median(iat) > 0)
SELECT user_id, event_type, n, med AS "median", round(1.4826 * median(abs(iat - med)) / med, 6) AS cv FROM i JOIN m USING (user_id, event_type) WHERE iat IS NOT NULL GROUP BY user_id, event_type, n, med""")
def q_beacon_iat(spark, d):
    rows = detect.beacon_regularity(events(spark, d), ["user_id", "event_type"], "ms")
    return rows.select("user_id", "event_type", "n", "median", F.round("cv", 6).alias("cv"))


@query(f"SELECT event_id, round(median(iat) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS BETWEEN 63 PRECEDING AND CURRENT ROW), 3) AS median_iat FROM (SELECT *, ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS iat FROM {EV})")
def q_beacon_trailing64(spark, d):
    order = Window.partitionBy("user_id").orderBy("ms", "event_id")
    rows = events(spark, d).withColumn("iat", F.col("ms") - F.lag("ms").over(order))
    return rows.select("event_id", F.round(F.percentile("iat", F.lit(0.5)).over(order.rowsBetween(-63, 0)), 3).alias("median_iat"))


@query("SELECT user_id, event_type, count(*) AS n FROM events e WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = e.user_id AND c.c_nationkey < 5 AND e.event_type = 'view') GROUP BY ALL")
def q_beacon_suppressed(spark, d):
    periodic = table(spark, d, "customer").filter("c_nationkey < 5").select(F.col("c_custkey").alias("user_id"), F.lit("view").alias("event_type"))
    return table(spark, d, "events").join(periodic, ["user_id", "event_type"], "left_anti").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query(f"SELECT event_id, round(sum(value) OVER w, 2) AS out_sum, count(*) OVER w AS records, ms - min(ms) OVER w AS span_ms FROM {EV} WINDOW w AS (PARTITION BY user_id ORDER BY ms RANGE BETWEEN 86400000 PRECEDING AND CURRENT ROW)")
def q_exfil_trailing_sum(spark, d):
    rows = events(spark, d)
    w = detect.trailing(["user_id"], "ms", 86_400_000)
    return rows.select("event_id", F.round(F.sum("value").over(w), 2).alias("out_sum"), F.count("*").over(w).alias("records"), (F.col("ms") - F.min("ms").over(w)).alias("span_ms"))


@query("""SELECT c_custkey, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
 WHERE r_name = 'ASIA' AND c_acctbal > 0 AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND s_suppkey = c_custkey % 100)""")
def q_exfil_eligible(spark, d):
    nations = table(spark, d, "nation").join(table(spark, d, "region").filter("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"))
    rows = table(spark, d, "customer").filter("c_acctbal > 0").join(nations, "c_nationkey", "left_semi").withColumn("partner", F.col("c_custkey") % 100)
    bulk = table(spark, d, "supplier").select(F.col("s_nationkey").alias("c_nationkey"), F.col("s_suppkey").alias("partner"))
    return rows.join(bulk, ["c_nationkey", "partner"], "left_anti").select("c_custkey", "c_acctbal")


NETS = [("10.0.0.0/8", 10 << 24, 8), ("172.16.0.0/12", (172 << 24) + (16 << 16), 12), ("192.168.0.0/16", (192 << 24) + (168 << 16), 16)]


@query("SELECT c_custkey, CASE WHEN a & 4278190080 = 167772160 THEN '10.0.0.0/8' WHEN a & 4293918720 = 2886729728 THEN '172.16.0.0/12' WHEN a & 4294901760 = 3232235520 THEN '192.168.0.0/16' END AS network FROM (SELECT c_custkey, (CASE c_custkey % 4 WHEN 0 THEN 167772160 WHEN 1 THEN 2886729728 WHEN 2 THEN 3232235520 ELSE 3325256704 END + c_custkey * 7919 % 131072)::BIGINT AS a FROM customer)")
def q_cidr_match(spark, d):
    address = F.expr("CASE c_custkey % 4 WHEN 0 THEN 167772160 WHEN 1 THEN 2886729728 WHEN 2 THEN 3232235520 ELSE 3325256704 END + c_custkey * 7919 % 131072").cast("long")
    rows = table(spark, d, "customer").select("c_custkey", address.alias("a"))
    network = F.coalesce(*(F.when(fn.in_network(F.col("a"), net, bits), name) for name, net, bits in NETS))
    return rows.select("c_custkey", network.alias("network"))


@query("""WITH i AS (SELECT o_orderkey, o_orderstatus = 'F' AS a, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority = '1-URGENT' END AS b, o_totalprice > 250000 AS c, CASE WHEN o_custkey % 3 > 0 THEN o_custkey % 2 = 0 END AS e FROM orders)
SELECT o_orderkey, (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT + (e IS NOT NULL)::INT AS available, coalesce(a, false)::INT + coalesce(b, false)::INT + coalesce(c, false)::INT + coalesce(e, false)::INT AS positive,
 CASE WHEN (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT + (e IS NOT NULL)::INT >= 3 THEN round((coalesce(a, false)::INT * 0.3::DOUBLE + coalesce(b, false)::INT * 0.25::DOUBLE + coalesce(c, false)::INT * 0.2::DOUBLE + coalesce(e, false)::INT * 0.25::DOUBLE)
 / ((a IS NOT NULL)::INT * 0.3::DOUBLE + (b IS NOT NULL)::INT * 0.25::DOUBLE + (c IS NOT NULL)::INT * 0.2::DOUBLE + (e IS NOT NULL)::INT * 0.25::DOUBLE), 6) END AS score FROM i""")
def q_tls_score(spark, d):
    rows = table(spark, d, "orders")
    indicators = {
        "a": (F.col("o_orderstatus") == "F", 0.3),
        "b": (F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority") == "1-URGENT"), 0.25),
        "c": (F.col("o_totalprice") > 250000, 0.2),
        "e": (F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey") % 2 == 0), 0.25),
    }
    return detect.weighted_indicators(rows, indicators).select("o_orderkey", "available", "positive", F.round("score", 6).alias("score"))


@query(f"""WITH g AS (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms, event_id) <= 43200000 THEN 0 ELSE 1 END AS fresh FROM {EV}), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, min(ms) AS "start", max(ms) AS "end", count(*) AS n FROM s GROUP BY user_id, session""")
def q_incident_sessions(spark, d):
    return ops.sessions(events(spark, d), ["user_id"], "ms", F.lit(43_200_000))


@query(f"""WITH h AS (SELECT event_id, sha1(from_hex('5d0c1c528a4e4f0e9a513e3b8f6f2a02') || encode('scan|src_host|' || user_id || '|' || ms)) AS x FROM {EV})
SELECT event_id, x[1:8] || '-' || x[9:12] || '-5' || x[14:16] || '-' || ['8', '9', 'a', 'b'][('0x' || x[17:17])::INT % 4 + 1] || x[18:20] || '-' || x[21:32] AS incident_id FROM h""")
def q_uuid5_ids(spark, d):
    return events(spark, d).select("event_id", fn.uuid5("incident", F.lit("scan"), F.lit("src_host"), F.col("user_id"), F.col("ms")).alias("incident_id"))


@query(f"""SELECT user_id, day, uniq, mean_len, CASE WHEN uniq >= 5 THEN 'high' WHEN uniq >= 3 THEN 'medium' END AS severity FROM (SELECT user_id, day, count(*) AS uniq, round(avg(length(name)), 4) AS mean_len FROM (SELECT DISTINCT user_id, day, event_type || '.' || k AS name FROM {EV}) GROUP BY user_id, day)""")
def q_tunnel_window(spark, d):
    names = events(spark, d).select("user_id", "day", F.concat_ws(".", "event_type", F.col("k").cast("string")).alias("name")).distinct()
    rows = names.groupBy("user_id", "day").agg(F.count("*").alias("uniq"), F.round(F.avg(F.length("name")), 4).alias("mean_len"))
    return rows.withColumn("severity", F.when(F.col("uniq") >= 5, "high").when(F.col("uniq") >= 3, "medium"))


@query(f"SELECT user_id, day, nx, alike, round(alike / nx::DOUBLE, 6) AS score FROM (SELECT user_id, day, count(DISTINCT k) AS nx, count(DISTINCT k) FILTER (k % 2 = 1) AS alike FROM {EV} WHERE event_type = 'error' GROUP BY user_id, day) WHERE nx >= 2 AND alike >= 1")
def q_nx_burst(spark, d):
    rows = events(spark, d).filter("event_type = 'error'").groupBy("user_id", "day").agg(F.countDistinct("k").alias("nx"), F.countDistinct(F.when(F.col("k") % 2 == 1, F.col("k"))).alias("alike"))
    return rows.filter("nx >= 2 AND alike >= 1").withColumn("score", F.round(F.col("alike") / F.col("nx"), 6))


@query(f"""SELECT detector, entity_key, n FROM (SELECT 'scan' AS detector, user_id::VARCHAR AS entity_key, count(DISTINCT k) AS n FROM {EV} GROUP BY user_id HAVING count(DISTINCT k) >= 10
 UNION ALL SELECT 'flood', k::VARCHAR, count(*) FROM {EV} GROUP BY k HAVING count(*) >= 100 UNION ALL SELECT 'burst', user_id::VARCHAR, count(*) FROM {EV} WHERE event_type = 'error' GROUP BY user_id HAVING count(*) >= 15)""")
def q_union_findings(spark, d):
    rows = events(spark, d)
    found = lambda name, by, n, least, source: source.groupBy(F.col(by).cast("string").alias("entity_key")).agg(n.alias("n")).filter(F.col("n") >= least).select(F.lit(name).alias("detector"), "entity_key", "n")
    scan = found("scan", "user_id", F.countDistinct("k"), 10, rows)
    flood = found("flood", "k", F.count("*"), 100, rows)
    return scan.unionByName(flood).unionByName(found("burst", "user_id", F.count("*"), 15, rows.filter("event_type = 'error'")))


@query(f"""WITH g AS (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY k ORDER BY ms, event_id) <= 7200000 THEN 0 ELSE 1 END AS fresh FROM {EV}), s AS (SELECT *, sum(fresh) OVER (PARTITION BY k ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT k, min(ms) AS "start", max(ms) AS "end", count(*) AS n FROM s GROUP BY k, session""")
def q_flood_episodes(spark, d):
    return ops.sessions(events(spark, d), ["k"], "ms", F.lit(7_200_000))


@query(f"""WITH RECURSIVE f AS (SELECT user_id, n, row_number() OVER (PARTITION BY user_id ORDER BY day) AS i, day FROM (SELECT user_id, day, count(*) AS n FROM {EV} GROUP BY ALL)),
 r AS (SELECT user_id, i, day, n, n AS emitted, true AS emit FROM f WHERE i = 1 UNION ALL SELECT f.user_id, f.i, f.day, f.n, CASE WHEN f.n >= 2 * r.emitted THEN f.n ELSE r.emitted END, f.n >= 2 * r.emitted FROM r JOIN f ON f.user_id = r.user_id AND f.i = r.i + 1)
SELECT user_id, day, n FROM r WHERE emit""")
def q_incident_status_ladder(spark, d):
    daily = events(spark, d).groupBy("user_id", "day").agg(F.count("*").alias("n"))
    series = daily.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("day", "n"))).alias("series"))
    empty = F.array().cast("array<struct<day:bigint,n:bigint>>")

    def step(out, x):
        last = F.when(F.size(out) > 0, F.element_at(out, -1)["n"]).otherwise(F.lit(0))
        return F.when((F.size(out) == 0) | (x["n"] >= 2 * last), F.concat(out, F.array(x))).otherwise(out)

    return series.select("user_id", F.explode(F.aggregate("series", empty, step)).alias("e")).select("user_id", "e.day", "e.n")
