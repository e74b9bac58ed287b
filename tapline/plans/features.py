"""Lexical features of names and a linear model's scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapline.functions import columns as fn
from tapline.operators import observe
from tapline.sources.tables import events, hosts, table

QUERIES, SQL = {}, {}
HOSTS = "(SELECT *, string_split(host, '.')[1] AS label FROM (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host FROM pages))"
CHARS = f"(SELECT page_id, label, unnest(string_split(label, '')) AS c FROM {HOSTS})"
ENTROPY = f"(SELECT page_id, 0 - sum(n / t::DOUBLE * log2(n / t::DOUBLE)) AS e FROM (SELECT page_id, c, count(*) AS n, sum(count(*)) OVER (PARTITION BY page_id) AS t FROM {CHARS} GROUP BY page_id, c) GROUP BY page_id)"


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query(f"SELECT page_id, host, (host = 'example.com' OR ends_with(host, '.example.com') OR host = 'example.net' OR ends_with(host, '.example.net')) AS allowed FROM {HOSTS}")
def q_suffix_allowlist(spark, d):
    return hosts(spark, d).select("page_id", "host", fn.under_domain(F.col("host"), ["example.com", "example.net"]).alias("allowed"))


@query(f"SELECT page_id, string_split(host, '.')[-2] || '.' || string_split(host, '.')[-1] AS registrable FROM {HOSTS}")
def q_registrable_domain(spark, d):
    return hosts(spark, d).select("page_id", fn.registrable(fn.normal_name(F.col("host"))).alias("registrable"))


@query(f"SELECT page_id, round(e, 6) AS entropy FROM {ENTROPY}")
def q_entropy(spark, d):
    return hosts(spark, d).select("page_id", F.round(fn.entropy(F.col("label")), 6).alias("entropy"))


@query(f"SELECT page_id, round(length(regexp_replace(label, '[^0-9]', '', 'g')) / length(label)::DOUBLE, 6) AS digits, round(length(regexp_replace(label, '[^aeiou]', '', 'g')) / length(label)::DOUBLE, 6) AS vowels, round(length(regexp_replace(label, '[^0-9a-f]', '', 'g')) / length(label)::DOUBLE, 6) AS hex, length(label) - length(replace(label, '-', '')) AS hyphens FROM {HOSTS}")
def q_char_ratios(spark, d):
    label = F.col("label")
    ratio = lambda c, name: F.round(fn.class_ratio(label, c), 6).alias(name)
    return hosts(spark, d).select("page_id", ratio("0-9", "digits"), ratio("aeiou", "vowels"), ratio("0-9a-f", "hex"), (F.length(label) - F.length(F.replace(label, F.lit("-"), F.lit("")))).cast("long").alias("hyphens"))


@query(f"SELECT page_id, coalesce(list_max(list_transform(regexp_extract_all(label, '[bcdfghjklmnpqrstvwxyz]+'), lambda x: length(x))), 0) AS run FROM {HOSTS}")
def q_max_run(spark, d):
    return hosts(spark, d).select("page_id", fn.longest_run(F.col("label"), "bcdfghjklmnpqrstvwxyz").cast("long").alias("run"))


@query(f"SELECT page_id, h, h % 32 AS bucket FROM (SELECT page_id, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(label, ''), lambda c: ascii(c)::BIGINT)), lambda a, x: (xor(a, x) * 16777619) & 4294967295) AS h FROM {HOSTS})")
def q_fnv1a_bucket(spark, d):
    return hosts(spark, d).select("page_id", fn.fnv1a32(F.col("label")).alias("h")).withColumn("bucket", F.col("h") % 32)


@query(f"""SELECT page_id, (length(label) >= 10 AND e >= 3.3 AND (length(regexp_replace(label, '[^0-9]', '', 'g')) / length(label)::DOUBLE >= 0.2 OR coalesce(list_max(list_transform(regexp_extract_all(label, '[bcdfghjklmnpqrstvwxyz]+'), lambda x: length(x))), 0) >= 4)) AS generated FROM {HOSTS} JOIN {ENTROPY} USING (page_id)""")
def q_lexical_rule(spark, d):
    return hosts(spark, d).select("page_id", fn.generated_looking(F.col("label")).alias("generated"))


@query(f"""WITH b AS (SELECT unnest(list_transform(range(1, length(label) + 2), lambda i: ('^' || label || '$')[i:i+1])) AS bigram FROM {HOSTS}), c AS (SELECT bigram, count(*) AS n FROM b GROUP BY bigram)
SELECT bigram, n, round(ln((n + 1) / (sum(n) OVER (PARTITION BY bigram[1:1]) + 40)::DOUBLE), 6) AS logp FROM c""")
def q_bigram_table(spark, d):
    framed = hosts(spark, d).select(F.concat(F.lit("^"), "label", F.lit("$")).alias("w"))
    grams = framed.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda i: F.substring("w", i, F.lit(2)))).alias("bigram"))
    counted = grams.groupBy("bigram").agg(F.count("*").alias("n")).withColumn("first", F.substring("bigram", 1, 1))
    totals = counted.groupBy("first").agg(F.sum("n").alias("t"))
    return counted.join(totals, "first").select("bigram", "n", F.round(F.log((F.col("n") + 1) / (F.col("t") + 40)), 6).alias("logp"))


@query("""SELECT vec_id, position, c FROM (SELECT vec_id, position, c, row_number() OVER (PARTITION BY vec_id ORDER BY abs(c) DESC, position) AS rn FROM (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS position, round(unnest(embedding)::DOUBLE * ((generate_subscripts(embedding, 1) - 1) % 7 - 3), 6) AS c FROM embeddings)) WHERE rn <= 5""")
def q_topk_contrib(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x, i: F.struct(F.round(x.cast("double") * (i % 7 - 3), 6).alias("c"), i.cast("long").alias("position"))).alias("all"))
    ordered = F.array_sort("all", lambda a, b: F.when(F.abs(a["c"]) > F.abs(b["c"]), -1).when(F.abs(a["c"]) < F.abs(b["c"]), 1).otherwise((a["position"] - b["position"]).cast("int")))
    return rows.select("vec_id", F.explode(F.slice(ordered, 1, 5)).alias("x")).select("vec_id", "x.position", "x.c")


@query("SELECT vec_id, round(1 / (1 + exp(-z)), 5) AS p FROM (SELECT vec_id, 0.1 + sum(x * (i % 5 - 2) * 0.1) AS z FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY vec_id)")
def q_logistic_score(spark, d):
    z = F.lit(0.1) + F.aggregate(F.transform("embedding", lambda x, i: x.cast("double") * (i % 5 - 2) * F.lit(0.1)), F.lit(0.0), lambda a, x: a + x)
    return table(spark, d, "embeddings").select("vec_id", F.round(1 / (1 + F.exp(-z)), 5).alias("p"))


_SECOND = "string_split(host, '.')[-2]"
_RUN = f"coalesce(list_max(list_transform(regexp_extract_all({_SECOND}, '[bcdfghjklmnpqrstvwxyz]+'), lambda x: length(x))), 0)"


@query(f"""WITH h AS (SELECT page_id, host, {_SECOND} AS second, len(string_split(host, '.')) AS n, {_RUN} AS run FROM {HOSTS}),
 c AS (SELECT page_id, second, unnest(string_split(second, '')) AS c FROM h), e AS (SELECT page_id, 0 - sum(n / t::DOUBLE * log2(n / t::DOUBLE)) AS e FROM (SELECT page_id, c, count(*) AS n, sum(count(*)) OVER (PARTITION BY page_id) AS t FROM c GROUP BY page_id, c) GROUP BY page_id),
 r AS (SELECT *, CASE WHEN host = 'example.com' OR ends_with(host, '.example.com') THEN 'allowlisted' WHEN n < 2 OR regexp_matches(host, '^[0-9.]+$') THEN 'not_registrable' END AS early, length(second) >= 10 AND e >= 3.3 AND (length(regexp_replace(second, '[^0-9]', '', 'g')) / length(second)::DOUBLE >= 0.2 OR run >= 4) AS lex FROM h LEFT JOIN e USING (page_id))
SELECT page_id, CASE WHEN early IS NULL THEN second || '.' || string_split(host, '.')[-1] END AS registrable, CASE WHEN early IS NULL AND n > 2 THEN array_to_string(string_split(host, '.')[1:n-2], '.') END AS sub, CASE WHEN early IS NULL AND length(second) >= 6 THEN lex END AS lexical, coalesce(early, CASE WHEN length(second) < 6 THEN 'label_too_short' ELSE 'model_unavailable' END) AS reason FROM r""")
def q_name_observed(spark, d):
    """Hosts of pages as names asked for: what can be said of each without a model, or why nothing."""
    rows = observe.named(hosts(spark, d).select("page_id", F.col("host").alias("query")), ["example.com"])
    return rows.select("page_id", "registrable", "sub", "lexical", "reason")


_EVENTS = "(SELECT event_id, event_type, user_id, value, json_extract_string(props, '$.k')::BIGINT AS k FROM events)"


@query(f"""WITH s AS (SELECT event_id, CASE event_type WHEN 'signup' THEN NULL WHEN 'error' THEN 'TLSv10' ELSE 'TLSv13' END AS version, CASE WHEN k % 3 > 0 THEN CASE WHEN k % 5 = 0 THEN '10.0.0.1' ELSE 'host.example' END END AS name, k % 2 = 0 AS missing, CASE WHEN user_id % 4 > 0 THEN CASE WHEN user_id % 7 = 0 THEN 8080 ELSE 443 END END AS port, CASE WHEN value > 50 THEN 'ok' WHEN value > 20 THEN 'self signed' END AS validation, user_id % 2 = 0 AS outside FROM {_EVENTS}),
 i AS (SELECT event_id, [version = 'TLSv10', CASE WHEN name IS NOT NULL THEN false WHEN version IS NOT NULL AND missing THEN true END, CASE WHEN name IS NOT NULL THEN name = '10.0.0.1' WHEN version IS NOT NULL AND missing THEN false END, port = 8080, validation <> 'ok', outside] AS x FROM s),
 w AS (SELECT event_id, unnest(x) AS x, unnest([0.30, 0.25, 0.20, 0.10, 0.25, 0.10]) AS w FROM i)
SELECT event_id, available, positive, CASE WHEN available >= 3 THEN round(p / a, 6) END AS score FROM (SELECT event_id, count(x) AS available, count(*) FILTER (x) AS positive, coalesce(sum(w::DOUBLE) FILTER (x), 0.0) AS p, sum(w::DOUBLE) FILTER (x IS NOT NULL) AS a FROM w GROUP BY event_id)""")
def q_tls_indicators(spark, d):
    """Events in the role of TLS sessions: indicators from their fields, and the score over those that can be seen."""
    kind, k, user = F.col("event_type"), F.col("k"), F.col("user_id")
    rows = events(spark, d).select(
        "event_id", "user_id",
        F.when(kind == "signup", None).when(kind == "error", "TLSv10").otherwise("TLSv13").alias("version"),
        F.when(k % 3 > 0, F.when(k % 5 == 0, "10.0.0.1").otherwise("host.example")).alias("server_name"),
        F.when(k % 2 == 0, "MISSING").otherwise("UNKNOWN").alias("server_name_mark"),
        F.when(user % 4 > 0, F.when(user % 7 == 0, 8080).otherwise(443)).alias("dst_port"),
        F.when(F.col("value") > 50, "ok").when(F.col("value") > 20, "self signed").alias("validation_status"),
    )
    made = observe.tls_indicators(rows, F.col("user_id") % 2 == 0)
    return made.select("event_id", F.col("available").cast("long"), F.col("positive").cast("long"), F.round("score", 6).alias("score"))


_MOMENTS = "list_reduce(list_prepend({'n': 0, 'm': 0.0::DOUBLE, 'v': 0.0::DOUBLE}, list_transform(xs, lambda x: {'n': -1, 'm': x, 'v': 0.0::DOUBLE})), lambda s, x: {'n': s.n + 1, 'm': CASE WHEN s.n = 0 THEN x.m ELSE s.m + 0.1 * (x.m - s.m) END, 'v': CASE WHEN s.n = 0 THEN 0.0::DOUBLE ELSE 0.9 * (s.v + 0.1 * (x.m - s.m) * (x.m - s.m)) END})"


@query(f"SELECT k, s.n::BIGINT AS n, round(s.m, 6) AS mean, round(sqrt(s.v), 6) AS deviation FROM (SELECT k, {_MOMENTS} AS s FROM (SELECT k, list(n::DOUBLE ORDER BY day) AS xs FROM (SELECT json_extract_string(props, '$.k')::BIGINT AS k, epoch_us(ts) // 86400000000 AS day, count(*) AS n FROM events GROUP BY ALL) GROUP BY k))")
def q_ewma_variance(spark, d):
    """Exponentially weighted mean and deviation of each key's daily counts."""
    daily = events(spark, d).groupBy("k", "day").agg(F.count("*").alias("n"))
    series = daily.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("day", "n"))), lambda x: x["n"].cast("double")).alias("xs"))
    rows = series.withColumn("s", fn.ewma_moments(F.col("xs"), 0.1))
    return rows.select("k", F.col("s.n").cast("long").alias("n"), F.round("s.mean", 6).alias("mean"), F.round(F.sqrt("s.var"), 6).alias("deviation"))
