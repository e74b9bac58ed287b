"""Single observations: names asked for, and TLS sessions, with what can be said of each by itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapline.functions import columns as fn
from tapline.operators import lexical

# Fixed values of the contract: letters that a scored label has at least, TLS versions and ports, indicator weights.
LEAST_LABEL = 6
OLD_VERSIONS = ("SSLv2", "SSLv3", "TLSv10", "TLSv11")
TLS_PORTS = (443, 465, 563, 636, 853, 989, 990, 993, 995, 4843, 5061, 8443, 8883)
WEIGHTS = {"old_tls_version": 0.30, "sni_absent": 0.25, "sni_ip_literal": 0.20, "nonstandard_port": 0.10, "certificate_not_validated": 0.25, "dst_external": 0.10}


def named(queries: DataFrame, allowed: list[str], model: lexical.NameModel | None = None) -> DataFrame:
    """`queries` (with query) and registrable, sub, lexical, p, looks_generated, generated, top, reason.

    Names of allowed domains, addresses and names without a registrable domain say why they aren't scored, as do short
    labels, which still have their registrable domain. Without a model the reason is model_unavailable, and the lexical
    rule alone says whether a name looks generated; with one, p from a half on does. `generated` is stricter: p from the
    model's own threshold on. `top` has the five features that move the score most, either way, with what they add.
    """
    query = F.col("query")
    bare = F.regexp_replace(query, r"\.+$", "")
    early = F.when(query.isNull() | (query == ""), "query_unavailable").when(fn.under_domain(F.lower(bare), allowed), "allowlisted").when(fn.is_ip(bare), "not_registrable").when(fn.normal_name(query).isNull(), "query_out_of_range").when(fn.registrable(fn.normal_name(query)).isNull(), "not_registrable")
    rows = queries.withColumns({"_early": early, "_name": fn.normal_name(query)})
    usable = F.col("_early").isNull()
    rows = rows.withColumns({"registrable": F.when(usable, fn.registrable(F.col("_name"))), "sub": F.when(usable, fn.below_registrable(F.col("_name"))), "label": F.when(usable, fn.second_label(F.col("_name")))})
    short = F.length("label") < LEAST_LABEL
    rows = rows.withColumn("lexical", F.when(~short, fn.generated_looking(F.col("label"))))
    added = "array<struct<feature:string,adds:double>>"
    if model is None:
        rows = rows.withColumns({"p": F.lit(None).cast("double"), "generated": F.lit(False), "top": F.lit(None).cast(added)})
    else:
        # a generator keeps the optimiser from making the features anew for each use
        rows = rows.withColumn("_x", F.explode(F.array(F.when(F.col("lexical").isNotNull(), lexical.vector(query, model.table)))))
        shares = F.zip_with(F.lit(lexical.NAMES), model.contributions(F.col("_x")), lambda n, c: F.struct(n.alias("feature"), c.alias("adds")))
        largest = lambda x, y: F.when(F.abs(x["adds"]) > F.abs(y["adds"]), -1).when(F.abs(x["adds"]) < F.abs(y["adds"]), 1).otherwise(0)
        rows = rows.withColumns({"p": model.probability(F.col("_x")), "top": F.slice(F.array_sort(shares, largest), 1, 5).cast(added)}).drop("_x")
        rows = rows.withColumn("generated", F.coalesce(F.col("p") >= model.threshold, F.lit(False)))
    reason = F.coalesce("_early", F.when(short, "label_too_short"), F.when(F.col("p").isNull(), F.lit("model_unavailable")))
    alike = F.coalesce(F.col("p") >= 0.5, "lexical", F.lit(False))
    return rows.withColumns({"reason": reason, "looks_generated": alike}).drop("_early", "_name", "label")


def tls_indicators(sessions: DataFrame, external: Column) -> DataFrame:
    """`sessions` and the six indicators (null where unobservable), available, positive and score.

    Sessions have version, server_name, server_name_mark (why it is missing), dst_port and validation_status. A score is
    the weight of the positive indicators over that of the available ones; with fewer than three available it is null.
    """
    seen, name = F.col("version").isNotNull(), F.col("server_name")
    absent = seen & (F.col("server_name_mark") == "MISSING")
    made = {
        "old_tls_version": F.when(seen, F.col("version").isin(*OLD_VERSIONS)),
        "sni_absent": F.when(name.isNotNull(), False).when(absent, True),
        "sni_ip_literal": F.when(name.isNotNull(), fn.is_ip(name)).when(absent, False),
        "nonstandard_port": ~F.col("dst_port").isin(*TLS_PORTS),
        "certificate_not_validated": F.lower(F.trim("validation_status")) != "ok",
        "dst_external": external,
    }
    rows = sessions.withColumns(made)
    total = lambda value: sum((value(F.col(k), w) for k, w in WEIGHTS.items()), F.lit(0))
    one = lambda test, x: F.when(test, x).otherwise(F.lit(0 * x))
    rows = rows.withColumns({"available": total(lambda c, _: one(c.isNotNull(), 1)), "positive": total(lambda c, _: one(F.coalesce(c, F.lit(False)), 1))})
    weight = total(lambda c, w: one(F.coalesce(c, F.lit(False)), w)) / total(lambda c, w: one(c.isNotNull(), w))
    return rows.withColumn("score", F.when(F.col("available") >= 3, weight))
