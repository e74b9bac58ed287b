"""Queries over stored history: latest state, rates, distributions, search, evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapline.operators import tables as ops
from tapline.sources.tables import events, table

QUERIES, SQL = {}, {}
#: Days, hours and peers of events in SQL, as the reader of events has them.
EV = "(SELECT *, epoch_us(ts) AS us, epoch_us(ts)//1000 AS ms, epoch_us(ts)//86400000000 AS day, epoch_us(ts)//3600000000 AS hour, CAST(json_extract_string(props,'$.k') AS BIGINT) AS k FROM events)"


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query(f"SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us DESC, event_id DESC) AS rn FROM {EV}) WHERE rn = 1")
def q_latest_by_key(spark, d):
    return ops.latest_by_key(events(spark, d).select("user_id", "event_id", "event_type", "value", "us"), ["user_id"], ["us", "event_id"]).drop("us")


@query("SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM (SELECT DISTINCT event_id, event_type FROM (SELECT event_id, event_type FROM events UNION ALL SELECT event_id, event_type FROM events WHERE event_id % 3 = 0)) GROUP BY event_type")
def q_dedup_replay(spark, d):
    rows = table(spark, d, "events").select("event_id", "event_type")
    replayed = rows.unionByName(rows.filter("event_id % 3 = 0")).dropDuplicates(["event_id"])
    return replayed.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("""WITH h AS (SELECT o_custkey, o_orderkey, max(o_orderkey) OVER w AS high, first_value(o_orderkey) OVER w AS base FROM orders
 WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey % 97, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT o_custkey, o_orderkey, CASE WHEN high IS NULL OR o_orderkey > high THEN 'new' WHEN o_orderkey <= high - 65536 OR o_orderkey < base THEN 'stale' ELSE 'reordered' END AS status,
 CASE WHEN high IS NULL THEN 0 WHEN o_orderkey > high THEN o_orderkey - high - 1 ELSE 0 END AS gap FROM h""")
def q_seq_gap_classify(spark, d):
    rows = table(spark, d, "orders").withColumn("tie", F.col("o_orderkey") % 97)
    return ops.classify_sequence(rows, ["o_custkey"], "o_orderkey", ["o_orderdate", "tie", "o_orderkey"]).select("o_custkey", "o_orderkey", "status", "gap")


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS sequence FROM events")
def q_replay_order(spark, d):
    rows = events(spark, d).select("event_id", "us", "day")
    return ops.dense_sequence(rows, F.col("day"), ["us", "event_id"]).select("event_id", "sequence")


@query(f"SELECT severity, resolved, count(*) AS n FROM (SELECT CASE WHEN value >= 300 THEN 'high' WHEN value >= 100 THEN 'medium' ELSE 'low' END AS severity, event_type = 'purchase' AS resolved FROM {EV}) GROUP BY severity, resolved")
def q_severity_resolved(spark, d):
    v = F.col("value")
    rows = events(spark, d).select(F.when(v >= 300, "high").when(v >= 100, "medium").otherwise("low").alias("severity"), (F.col("event_type") == "purchase").alias("resolved"))
    return rows.groupBy("severity", "resolved").agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type")
def q_threat_counts(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type")


@query(f"SELECT us // 60000000 AS minute, count(*) AS n FROM {EV} WHERE event_type <> 'purchase' GROUP BY 1")
def q_alert_rate_minute(spark, d):
    return events(spark, d).filter("event_type <> 'purchase'").groupBy(F.expr("us div 60000000").alias("minute")).agg(F.count("*").alias("n"))


@query("SELECT event_type, CASE WHEN c IS NULL THEN -1 ELSE floor(c * 10) / 10 END AS bucket, count(*) AS n FROM (SELECT event_type, CASE WHEN event_id % 5 > 0 THEN (event_id % 100) / 100.0::DOUBLE END AS c FROM events) GROUP BY 1, 2")
def q_confidence_hist(spark, d):
    rows = table(spark, d, "events").select("event_type", F.when(F.col("event_id") % 5 > 0, (F.col("event_id") % 100) / F.lit(100.0)).alias("c"))
    bucket = F.when(F.col("c").isNull(), F.lit(-1.0)).otherwise(F.floor(F.col("c") * 10) / 10)
    return rows.groupBy("event_type", bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query(f"SELECT m // 60 AS hour, sum(n)::BIGINT AS n, max(n) AS busiest FROM (SELECT us // 60000000 AS m, count(*) AS n FROM {EV} GROUP BY 1) GROUP BY 1")
def q_hourly_rollup(spark, d):
    minutes = events(spark, d).groupBy(F.expr("us div 60000000").alias("m")).agg(F.count("*").alias("n"))
    return minutes.groupBy(F.expr("m div 60").alias("hour")).agg(F.sum("n").alias("n"), F.max("n").alias("busiest"))


@query("SELECT p AS share, list_sort(list(value))[least(floor(p * count(*)), count(*) - 1)::INT + 1] AS value FROM events, (SELECT unnest([0.5, 0.9, 0.95, 0.99]::DOUBLE[]) AS p) WHERE value IS NOT NULL GROUP BY p")
def q_latency_nearest_rank(spark, d):
    return ops.nearest_rank(table(spark, d, "events"), "value", [0.5, 0.9, 0.95, 0.99])


@query("SELECT count(*) AS n, max(value) AS longest, count(*) FILTER (value > 100) AS over_limit, round(avg(value), 4) AS mean FROM events")
def q_latency_summary(spark, d):
    return table(spark, d, "events").agg(F.count("*").alias("n"), F.max("value").alias("longest"), F.count_if(F.col("value") > 100).alias("over_limit"), F.round(F.avg("value"), 4).alias("mean"))


@query("SELECT event_type, count(*) AS n, min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) AS last_us, (max(epoch_us(ts)) - min(epoch_us(ts))) // 1000 AS span_ms FROM events GROUP BY event_type")
def q_run_span(spark, d):
    rows = events(spark, d).groupBy("event_type").agg(F.count("*").alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))
    return rows.withColumn("span_ms", F.expr("(last_us - first_us) div 1000"))


@query("SELECT doc_id, lang, n_chars FROM documents WHERE contains(lower(text), 'trash') AND lang = 'en' ORDER BY doc_id DESC LIMIT 200")
def q_incident_search(spark, d):
    found = table(spark, d, "documents").filter(F.contains(F.lower("text"), F.lit("trash")) & (F.col("lang") == "en"))
    return found.select("doc_id", "lang", "n_chars").orderBy(F.desc("doc_id")).limit(200)


@query(f"""WITH ranked AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY us DESC, event_id DESC) AS rn FROM {EV} WHERE event_type = 'error')
SELECT e.event_id, e.user_id, e.event_type, e.value FROM events e WHERE e.event_id IN (SELECT event_id FROM ranked WHERE rn <= 32)""")
def q_related_events(spark, d):
    rows = events(spark, d)
    last = Window.partitionBy("user_id").orderBy(F.desc("us"), F.desc("event_id"))
    recent = rows.filter("event_type = 'error'").withColumn("rn", F.row_number().over(last)).filter("rn <= 32")
    incidents = recent.groupBy("user_id").agg(F.collect_list("event_id").alias("ids"))
    wanted = incidents.select(F.explode("ids").alias("event_id"))
    return rows.join(wanted, "event_id", "left_semi").select("event_id", "user_id", "event_type", "value")


@query("""SELECT user_id, count(*) AS n, max(rank) AS worst, max(epoch_us(ts)) AS last_us FROM (SELECT *, CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 1 ELSE 0 END AS rank FROM events) GROUP BY user_id""")
def q_entity_rollup(spark, d):
    kind = F.col("event_type")
    rank = F.when(kind == "error", 3).when(kind == "purchase", 2).when(kind == "signup", 1).otherwise(0)
    return events(spark, d).groupBy("user_id").agg(F.count("*").alias("n"), F.max(rank).alias("worst"), F.max("us").alias("last_us"))


@query("SELECT user_id, arg_max(value, event_id) AS last_value, arg_min(value, event_id) AS first_value, max(event_id) AS last_seq FROM events GROUP BY user_id")
def q_argmax_progress(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("value", "event_id").alias("last_value"), F.min_by("value", "event_id").alias("first_value"), F.max("event_id").alias("last_seq"))


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY event_type) AS kinds FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY user_id")
def q_status_set(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"))


@query("""SELECT o_orderkey, l_linenumber, l_returnflag FROM (SELECT o_orderkey, l_linenumber, l_returnflag, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_shipdate, l_linenumber, l_returnflag) AS rn
 FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND list_contains(CASE o_orderstatus WHEN 'F' THEN ['A', 'R'] WHEN 'O' THEN ['N'] ELSE ['A', 'N', 'R'] END, l_returnflag)) WHERE rn = 1""")
def q_ground_truth_match(spark, d):
    status = F.col("o_orderstatus")
    expected = F.when(status == "F", F.array(F.lit("A"), F.lit("R"))).when(status == "O", F.array(F.lit("N"))).otherwise(F.array(F.lit("A"), F.lit("N"), F.lit("R")))
    episodes = table(spark, d, "orders").select("o_orderkey", expected.alias("expected"))
    alerts = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_shipdate")
    matched = episodes.join(alerts, (F.col("o_orderkey") == F.col("l_orderkey")) & F.array_contains("expected", F.col("l_returnflag")))
    first = matched.groupBy("o_orderkey").agg(F.min(F.struct("l_shipdate", "l_linenumber", "l_returnflag")).alias("m"))
    return first.select("o_orderkey", "m.l_linenumber", "m.l_returnflag")


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') AND l_returnflag <> 'N' GROUP BY l_orderkey")
def q_absent_expected(spark, d):
    absent = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, d, "lineitem").filter("l_returnflag <> 'N'").join(absent, "l_orderkey", "left_semi").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query(f"SELECT day, count(*) AS hot, min(event_id) AS first_id, max(event_id) AS last_id, sum(event_id)::BIGINT AS checksum FROM {EV} GROUP BY day")
def q_archive_manifest(spark, d):
    return events(spark, d).groupBy("day").agg(F.count("*").alias("hot"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"), F.sum("event_id").alias("checksum"))


@query(None)
def q_approx_distinct(spark, d):
    rows = events(spark, d).groupBy("day").agg(F.hll_sketch_agg("user_id", F.lit(12)).alias("users"))
    return rows.agg(F.hll_sketch_estimate(F.hll_union_agg("users")).alias("users"), F.count("*").alias("days"))


@query("SELECT sensor, sent, received, sent - received AS missing FROM (SELECT c_nationkey AS sensor, count(*) AS sent FROM customer GROUP BY 1) JOIN (SELECT s_nationkey AS sensor, count(*) AS received FROM supplier GROUP BY 1) USING (sensor)")
def q_sensor_difference(spark, d):
    sent = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("sensor")).agg(F.count("*").alias("sent"))
    received = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("sensor")).agg(F.count("*").alias("received"))
    return sent.join(received, "sensor").withColumn("missing", F.col("sent") - F.col("received"))


# ---- evaluation of a score --------------------------------------------------------------------------------------------

SCORED = "(SELECT least(n_chars, 3000) // 30 AS s, quality AS y FROM labels JOIN documents USING (doc_id))"


def scored(spark, d):
    """A stand-in score of labelled documents, 0 to 100, and their label."""
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return rows.select(F.expr("least(n_chars, 3000) div 30").alias("s"), F.col("quality").alias("y"))


def by_score(rows):
    """positives and negatives of each score: at most 101 rows, whatever the input."""
    return rows.groupBy("s").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))


@query(f"""WITH r AS (SELECT y, avg(rn) OVER (PARTITION BY s) AS rank FROM (SELECT s, y, row_number() OVER (ORDER BY s) AS rn FROM {SCORED}))
SELECT round((sum(rank) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0))::DOUBLE, 6) AS auc FROM r""")
def q_auc_tied(spark, d):
    below = F.coalesce(F.sum("neg").over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wins = by_score(scored(spark, d)).withColumn("wins", F.col("pos") * (below + F.col("neg") / 2))
    return wins.agg(F.round(F.sum("wins") / (F.sum("pos") * F.sum("neg")), 6).alias("auc"))


@query(f"""WITH c AS (SELECT s, sum(y) AS pos, count(*) AS n FROM {SCORED} GROUP BY s), r AS (SELECT pos, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS seen FROM c)
SELECT round(sum(pos * tp / seen::DOUBLE) / sum(pos), 6) AS average_precision FROM r""")
def q_pr_auc(spark, d):
    order = Window.orderBy(F.desc("s"))
    rows = by_score(scored(spark, d)).withColumn("tp", F.sum("pos").over(order)).withColumn("seen", F.sum(F.col("pos") + F.col("neg")).over(order))
    return rows.agg(F.round(F.sum(F.col("pos") * F.col("tp") / F.col("seen")) / F.sum("pos"), 6).alias("average_precision"))


@query(f"""WITH c AS (SELECT count(*) FILTER (y = 1 AND s >= 20) AS tp, count(*) FILTER (y = 0 AND s >= 20) AS fp, count(*) FILTER (y = 1 AND s < 20) AS fn, count(*) FILTER (y = 0 AND s < 20) AS tn FROM {SCORED})
SELECT tp, fp, fn, tn, round(tp / (tp + fp)::DOUBLE, 6) AS prec, round(tp / (tp + fn)::DOUBLE, 6) AS recall, round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) AS f1, round(fp / (fp + tn)::DOUBLE, 6) AS fpr FROM c""")
def q_confusion(spark, d):
    hit, y = F.col("s") >= 20, F.col("y")
    c = scored(spark, d).agg(F.count_if(hit & (y == 1)).alias("tp"), F.count_if(hit & (y == 0)).alias("fp"), F.count_if(~hit & (y == 1)).alias("fn"), F.count_if(~hit & (y == 0)).alias("tn"))
    share = lambda text, name: F.expr(f"round({text}, 6)").alias(name)
    return c.select("*", share("tp / (tp + fp)", "prec"), share("tp / (tp + fn)", "recall"), share("2 * tp / (2 * tp + fp + fn)", "f1"), share("fp / (fp + tn)", "fpr"))


@query(f"""WITH c AS (SELECT lang, sum(quality)::DOUBLE AS k, count(*)::DOUBLE AS n FROM labels JOIN documents USING (doc_id) GROUP BY lang)
SELECT lang, round((k / n + 1.9208 / n - 1.96 * sqrt(k / n * (1 - k / n) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n), 6) AS low, round((k / n + 1.9208 / n + 1.96 * sqrt(k / n * (1 - k / n) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n), 6) AS high FROM c""")
def q_wilson(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    c = rows.groupBy("lang").agg(F.sum("quality").cast("double").alias("k"), F.count("*").cast("double").alias("n"))
    bound = "(k / n + 1.9208D / n {} 1.96D * sqrt(k / n * (1 - k / n) / n + 0.9604D / (n * n))) / (1 + 3.8416D / n)"
    return c.select("lang", F.expr(f"round({bound.format('-')}, 6)").alias("low"), F.expr(f"round({bound.format('+')}, 6)").alias("high"))


@query(f"SELECT least(s // 10, 9) AS bin, count(*) AS n, round(avg(s / 100.0::DOUBLE), 6) AS predicted, round(avg(y), 6) AS observed FROM {SCORED} GROUP BY 1")
def q_reliability(spark, d):
    return scored(spark, d).groupBy(F.expr("least(s div 10, 9)").alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("s") / 100), 6).alias("predicted"), F.round(F.avg("y"), 6).alias("observed"))


@query(f"SELECT round(avg((s / 100.0::DOUBLE - y) * (s / 100.0::DOUBLE - y)), 6) AS brier, round(avg(s), 4) AS mean, round(stddev_pop(s), 4) AS std FROM {SCORED}")
def q_brier_zscore(spark, d):
    gap = F.col("s") / 100 - F.col("y")
    return scored(spark, d).agg(F.round(F.avg(gap * gap), 6).alias("brier"), F.round(F.avg("s"), 4).alias("mean"), F.round(F.stddev_pop("s"), 4).alias("std"))
