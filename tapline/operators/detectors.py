"""Detectors over typed records: windows as Spark expressions, then an emit ladder.

Inputs are flow deltas (src, dst, dport, proto, obs_ms, new_flow, terminal, conn_state, coverage, orig_bytes and
resp_bytes as growth), TLS sessions and scored DNS queries. Every detector returns its key, obs_ms, subtype, severity,
rank, amount and score of the findings it reports. Thresholds are parameters; defaults are those of the data contract.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tapline.functions.columns import entropy
from tapline.operators.ladders import rank_of, reported
from tapline.operators.sweeps import BLOCK_HORIZONS, active_spans, running_sums, trailing_distinct

# Fixed values of the contract: failed connection states, and ports that amplify.
FAILED = ("S0", "REJ", "RSTOS0", "SH")
AMPLIFIERS = (19, 53, 111, 123, 137, 161, 389, 1900, 3702, 5353, 11211)


def _finish(rows: DataFrame, keys: list[str], severity: Column, evidence: tuple[str, ...] = (), **ladder) -> DataFrame:
    found = rows.withColumn("severity", severity).withColumn("rank", rank_of(F.col("severity")))
    return reported(found.select(*keys, "obs_ms", "subtype", "severity", "rank", "amount", "score", *evidence), [*keys, "subtype"], "obs_ms", **ladder)


def learned(state: tuple, x: float, alpha: float) -> tuple:
    """The state (count, exponentially weighted mean and variance) after a value; the first value starts the mean."""
    n, mean, var = state
    if n == 0:
        return 1, float(x), 0.0
    apart = x - mean
    return n + 1, mean + alpha * apart, (1 - alpha) * (var + alpha * apart * apart)


def scans(deltas: DataFrame, scanners: DataFrame | None = None, horizon_ms: int = 30_000, hosts: int = 20, ports: int = 25) -> DataFrame:
    """Sources that contact many hosts on a port (horizontal) or many ports of a host (vertical) within the horizon.

    Counts come from a sweep over contacts and are exact, so no cap on pairs is needed. The share of failed attempts and
    the ladder start over when a source made no contact for longer than the horizon.
    """
    rows = deltas.filter("new_flow").withColumn("port_key", F.concat_ws("/", F.col("dport").cast("string"), "proto"))
    known = F.col("terminal") & (F.col("coverage") == "both_directions") & F.col("conn_state").isNotNull()
    tried = rows.join(active_spans(rows, ["src"], "obs_ms", horizon_ms), ["src", "obs_ms"]).withColumns({"known": known.cast("long"), "lost": (known & F.col("conn_state").isin(*FAILED)).cast("long")})
    rates = running_sums(tried, ["src", "span"], "obs_ms", ["known", "lost"], BLOCK_HORIZONS * horizon_ms)
    out = None
    for name, keys, item, least in (("horizontal_scan", ["src", "port_key"], "dst", hosts), ("vertical_scan", ["src", "dst"], "port_key", ports)):
        counts = trailing_distinct(rows, keys, [item], "obs_ms", horizon_ms, name="amount").filter(F.col("amount") >= least)
        found = rows.join(counts, [*keys, "obs_ms"]).withColumn("amount", F.col("amount").cast("double"))
        found = found.withColumns({"subtype": F.lit(name), "least": F.lit(least), "score": F.least(F.lit(1.0), 0.5 + 0.5 * F.col("amount") / (4 * least))})
        out = found if out is None else out.unionByName(found)
    out = out.join(rates, ["src", "obs_ms"])
    failed = F.when(F.col("coverage") == "both_directions", F.col("lost") / F.nullif(F.col("known"), F.lit(0)))
    severe = (F.col("amount") >= 5 * F.col("least")) | (F.coalesce(failed, F.lit(0.0)) >= 0.8) & (F.col("amount") >= 2 * F.col("least"))
    severity = F.when(severe, "high").otherwise("medium")
    if scanners is not None:
        out = out.join(scanners.select("src", F.lit(True).alias("allowed")).distinct(), "src", "left")
        severity = F.when(F.col("allowed"), "info").otherwise(severity)
    return _finish(out, ["src", "span"], severity).drop("span")


def floods(deltas: DataFrame, flows: int = 200, volume: float = 20e6, syn: int = 100, spoofed: int = 500, amplified: float = 500e3, reflectors: int = 10) -> DataFrame:
    """Destinations under a flood, by second with five-second source counts; an episode ends after 30 quiet seconds.

    Thresholds of flows and bytes rise to the exponentially weighted mean plus six deviations of the destination's
    earlier seconds, anomalous ones left out, once there are 30. Seconds with an unknown count of bytes teach no bytes.
    """
    fresh, udp = F.col("new_flow"), (F.col("proto") == "udp") & F.col("sport").isin(*AMPLIFIERS)
    rows = deltas.withColumn("sec", F.expr("obs_ms div 1000")).withColumn("bytes", F.coalesce("orig_bytes", F.lit(0)) + F.coalesce("resp_bytes", F.lit(0)))
    by_source = rows.groupBy("dst", "sec", "src").agg(F.count_if(fresh).alias("flows"), F.count_if(fresh & (F.col("proto") == "tcp") & F.col("terminal") & (F.col("conn_state") == "S0")).alias("syn"), F.sum("bytes").alias("bytes"), F.max(F.col("orig_bytes").isNull() | F.col("resp_bytes").isNull()).alias("unknown"), F.sum(F.when(udp, F.col("bytes")).otherwise(0)).alias("amp"), F.count_if(udp).alias("amp_flows"))
    seconds = by_source.groupBy("dst", "sec").agg(F.sum("flows").alias("flows"), F.sum("syn").alias("syn"), F.sum("bytes").alias("bytes"), F.max("unknown").alias("unknown"), F.sum("amp").alias("amp"))
    five = Window.partitionBy("dst").orderBy("sec").rangeBetween(-4, 0)
    sources = lambda found, name: trailing_distinct(found, ["dst"], ["src"], "sec", 4, seconds, name)
    rows = seconds.withColumn("flows5", F.sum("flows").over(five))
    rows = rows.join(sources(by_source, "srcs5"), ["dst", "sec"]).join(sources(by_source.filter("amp_flows > 0"), "reflectors5"), ["dst", "sec"])
    numbers = ["flows", "syn", "bytes", "amp", "srcs5", "reflectors5", "flows5"]
    rows = rows.select("dst", "sec", "unknown", *(F.col(c).cast("double").alias(c) for c in numbers)).repartition("dst").sortWithinPartitions("dst", "sec")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, usual, heavy = None, None, None
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if usual is None or r.dst != key:
                    key, usual, heavy = r.dst, (0, 0.0, 0.0), (0, 0.0, 0.0)
                limit, most = float(flows), float(volume)
                if usual[0] >= 30:
                    limit, most = max(limit, usual[1] + 6 * usual[2] ** 0.5), max(most, heavy[1] + 6 * heavy[2] ** 0.5)
                subtype = None
                if r.amp >= amplified and r.reflectors5 >= reflectors:
                    subtype = "udp_amplification_like"
                elif r.srcs5 >= spoofed and r.flows5 / max(1, r.srcs5) <= 1.5 and r.flows >= limit / 2:
                    subtype = "spoofed_source_like_flood"
                elif r.syn >= syn and r.syn >= 0.8 * r.flows:
                    subtype = "syn_flood"
                elif r.flows >= limit or r.bytes >= most:
                    subtype = "volumetric_flood"
                if subtype:
                    factor = max(r.flows / limit, r.bytes / most, r.amp / amplified if subtype == "udp_amplification_like" else 0.0)
                    out.append((r.dst, r.sec, r.flows5, subtype, factor))
                else:
                    usual = learned(usual, r.flows, 0.05)
                    heavy = heavy if r.unknown else learned(heavy, r.bytes, 0.05)
            yield pd.DataFrame(out, columns=["dst", "sec", "amount", "subtype", "factor"])

    rows = rows.mapInPandas(run, "dst string, sec long, amount double, subtype string, factor double")
    rows = rows.withColumn("obs_ms", F.col("sec") * 1000).withColumn("score", F.least(F.lit(1.0), 0.5 + 0.05 * F.col("factor")))
    return _finish(rows, ["dst"], F.when(F.col("factor") >= 10, "critical").otherwise("high"), gap=30_000)


def _middles(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The median of the known values of each row; not a number where there are none."""
    n = known.sum(1)
    ordered, at = np.sort(np.where(known, values, np.nan), 1), np.arange(len(n))
    return np.where(n > 0, (ordered[at, np.maximum(n + 1, 2) // 2 - 1] + ordered[at, np.minimum(n // 2, values.shape[1] - 1)]) / 2.0, np.nan)


def _spread(values: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The median of each row's known values, and by how much they vary around it: their robust deviation by it."""
    middle = _middles(values, known)
    return middle, 1.4826 * _middles(np.abs(values - middle[:, None]), known) / middle


PACES = "amount double, length long, middle double, cv double, size_cv double"


def _paces(starts: DataFrame, keys: list[str], least: int, most: int, interval_ms: int, variation: float) -> DataFrame:
    """keys, obs_ms and, of the last `most` starts at each, their number, length, median step, and how steps and sizes vary.

    Windows of a batch are the rows of a matrix, sorted once for each median; `most` - 1 starts are carried to the next batch.
    """
    rows = starts.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("start_ms"))).select(*keys, "obs_ms", "start_ms", F.col("sent").cast("double"), "nth")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(most - 1, np.int64), np.zeros(most - 1, bool), np.zeros(most - 1), np.zeros(most - 1, bool)]
        back = np.arange(most - 1, -1, -1)
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = []
            for name in ("start_ms", "sent"):
                column = batch.column(name)
                columns += [column.fill_null(0).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)]
            held = [np.concatenate((h[len(h) - most + 1 :], c)) for h, c in zip(held, columns)]
            own = batch.column("nth").to_numpy(zero_copy_only=False)[:, None] > back
            times, timed, sizes, sized = (np.lib.stride_tricks.sliding_window_view(h, most) for h in held)
            timed, sized = timed & own, sized & own
            amount = timed.sum(1)
            with np.errstate(all="ignore"):
                middle, cv = _spread(np.diff(times).astype(float), timed[:, 1:] & timed[:, :-1])
                length = times[:, -1] - times[np.arange(len(times)), timed.argmax(1)]
                found = np.flatnonzero((amount >= least) & (middle >= interval_ms) & (cv <= variation) & (length >= 3 * middle))
                sized = sized[found]
                usual, size_cv = _spread(sizes[found], sized)
            told = (sized.sum(1) >= 4) & (usual > 0)
            made = [pa.array(amount[found].astype(float)), pa.array(length[found]), pa.array(middle[found]), pa.array(cv[found]), pa.array(size_cv, mask=~told)]
            kept = batch.select([*keys, "obs_ms"]).take(pa.array(found))
            yield pa.RecordBatch.from_arrays([*kept.columns, *made], names=[*keys, "obs_ms", *(c.split(" ")[0] for c in PACES.split(", "))])

    schema = StructType([rows.schema[c] for c in (*keys, "obs_ms")] + list(StructType.fromDDL(PACES)))
    return rows.mapInArrow(run, schema)


def beacons(deltas: DataFrame, local: Column, periodic: DataFrame | None = None, least: int = 8, most: int = 64, interval_ms: int = 5_000, variation: float = 0.15) -> DataFrame:
    """Pairs that connect at even intervals over their last starts; known periodic pairs are left out.

    size_cv says how much the bytes sent by the finished ones vary, if at least four of these starts have them. `local`
    is an expression over the pair's columns.
    """
    keys = ["src", "dst", "dport", "proto"]
    sent = F.min_by(F.when(F.col("terminal"), F.col("orig_bytes")), "obs_ms")
    starts = deltas.filter("new_flow").groupBy(*keys, "start_ms").agg(F.min("obs_ms").alias("obs_ms"), sent.alias("sent"))
    if periodic is not None:
        starts = starts.join(periodic.select(*keys), keys, "left_anti")
    rows = _paces(starts, keys, least, most, interval_ms, variation)
    severity = F.when(~local & (F.col("cv") <= 0.05) & (F.col("amount") >= 16), "high").when(~local, "medium").otherwise("low")
    score = 0.6 * F.greatest(F.lit(0.0), 1 - F.col("cv") / variation) + 0.4 * F.least(F.lit(1.0), F.col("amount") / 32)
    return _finish(rows.withColumn("subtype", F.lit("periodic_beacon")).withColumn("score", score), keys, severity, ("size_cv",))


def uploads(deltas: DataFrame, window_ms: int = 30_000, volume: float = 10e6, span_ms: int = 15_000, records: int = 3) -> DataFrame:
    """Sources whose bytes out over the trailing window are large and sustained, with the ratio of bytes out to bytes in.

    The ratio is null if a record of the window has no known bytes in, or didn't see both directions, or there were none.

    The volume rises to ten times the exponentially weighted mean of the source's earlier windows of the clock that had
    data and nothing to report, once there are six.

    `deltas` holds eligible rows alone: from local sources to others, without known bulk transfers.
    """
    rows = deltas.filter("orig_bytes > 0")
    w = Window.partitionBy("src").orderBy("obs_ms").rangeBetween(-window_ms, 0)
    rows = rows.withColumn("amount", F.sum("orig_bytes").over(w).cast("double")).withColumn("span", F.col("obs_ms") - F.min("obs_ms").over(w)).withColumn("n", F.count("*").over(w))
    first = F.min("obs_ms").over(Window.partitionBy("src", "dst")) == F.col("obs_ms")
    back = F.when(F.col("coverage") == "both_directions", F.col("resp_bytes"))
    got = F.when(F.count_if(back.isNull()).over(w) == 0, F.sum(back).over(w))
    rows = rows.withColumns({"new_dst": first, "ratio": F.col("amount") / F.nullif(got, F.lit(0))}).select("src", "obs_ms", F.col("orig_bytes").cast("double").alias("sent"), "amount", "span", "n", "new_dst", "ratio")
    rows = rows.repartition("src").sortWithinPartitions("src", "obs_ms", "sent", "new_dst")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, base = None, None
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if base is None or r.src != key:
                    key, base, window, sent, odd = r.src, (0, 0.0, 0.0), None, 0.0, False
                if window is not None and r.obs_ms // window_ms != window:
                    base = base if odd else learned(base, sent, 0.1)
                    sent, odd = 0.0, False
                window, sent = r.obs_ms // window_ms, sent + r.sent
                limit = max(float(volume), 10 * base[1]) if base[0] >= 6 else float(volume)
                if r.amount >= limit and r.span >= span_ms and r.n >= records:
                    odd = True
                    out.append((r.src, r.obs_ms, r.amount, r.amount >= 5 * limit or r.new_dst and r.amount >= 2 * limit, min(1.0, 0.5 + 0.1 * r.amount / limit), None if pd.isna(r.ratio) else r.ratio))
            yield pd.DataFrame(out, columns=["src", "obs_ms", "amount", "severe", "score", "ratio"])

    rows = rows.mapInPandas(run, "src string, obs_ms long, amount double, severe boolean, score double, ratio double")
    return _finish(rows.withColumn("subtype", F.lit("sustained_upload")), ["src"], F.when(F.col("severe"), "high").otherwise("medium"), ("ratio",))


def tls_metadata(sessions: DataFrame, external: Column, min_score: float = 0.6, positives: int = 2, least: int = 3) -> DataFrame:
    """Servers whose TLS sessions show several suspicious indicators; `sessions` has available, positive and score.

    Sessions with too few available indicators abstain. The best score so far and the number of scored sessions count.
    """
    keys = ["src", "dst", "dport"]
    past = Window.partitionBy(*keys).orderBy("obs_ms").rowsBetween(Window.unboundedPreceding, 0)
    rows = sessions.filter("score IS NOT NULL").withColumn("n", F.count("*").over(past)).withColumn("best", F.max(F.struct("score", "obs_ms", "positive")).over(past))
    rows = rows.filter((F.col("n") >= least) & (F.col("best.score") >= min_score) & (F.col("best.positive") >= positives))
    rows = rows.withColumn("score", F.col("best.score")).withColumn("amount", F.col("n").cast("double")).withColumn("subtype", F.lit("suspicious_tls_metadata"))
    return _finish(rows, keys, F.when((F.col("n") >= 10) & external, "medium").otherwise("low"), doubling=False)


def dns_tunnels(queries: DataFrame, window_ms: int = 60_000, unique: int = 30, mean_length: float = 20.0, mean_entropy: float = 3.3) -> DataFrame:
    """Sources that ask for many long, random names below one domain in a minute; `queries` has sub and registrable."""
    keys = ["src", "registrable", "minute"]
    rows = queries.filter("registrable IS NOT NULL AND sub <> ''").withColumn("minute", F.expr(f"obs_ms div {window_ms}"))
    firsts = rows.groupBy(*keys, "sub").agg(F.min("obs_ms").alias("obs_ms"))
    past = Window.partitionBy(*keys).orderBy("obs_ms", "sub").rowsBetween(Window.unboundedPreceding, 0)
    firsts = firsts.withColumn("n", F.count("*").over(past)).withColumn("length", F.avg(F.length("sub")).over(past)).withColumn("random", F.avg(entropy(F.replace("sub", F.lit("."), F.lit("")))).over(past)).withColumn("bytes", F.sum(F.length("sub") + F.length("registrable") + 1).over(past))
    found = firsts.filter((F.col("n") >= unique) & (F.col("length") >= mean_length) & (F.col("random") >= mean_entropy)).withColumn("amount", F.col("n").cast("double")).withColumn("subtype", F.lit("dns_tunnel_like"))
    score = F.least(F.lit(1.0), 0.4 + 0.3 * F.least(F.lit(1.0), F.col("n") / 120) + 0.3 * F.least(F.lit(1.0), F.col("random") / 4.5))
    return _finish(found.withColumn("score", score), keys, F.when((F.col("n") >= 150) | (F.col("bytes") >= 20_000), "high").otherwise("medium"), doubling=False)


def generated_domains(queries: DataFrame, window_ms: int = 60_000) -> DataFrame:
    """Sources that ask for a domain whose name the model takes for generated, more severe if it doesn't exist.

    `queries` has registrable, p, generated (from the model's threshold on; without a model nothing is) and nx. A
    domain is told again within a minute only if it gets more severe.
    """
    keys = ["src", "registrable", "minute"]
    found = queries.filter("registrable IS NOT NULL AND generated").withColumn("minute", F.expr(f"obs_ms div {window_ms}"))
    found = found.withColumns({"amount": F.lit(1.0), "subtype": F.lit("dga_domain"), "score": F.col("p")})
    return _finish(found, keys, F.when(F.coalesce("nx", F.lit(False)), "medium").otherwise("low"), doubling=False)


def name_bursts(queries: DataFrame, window_ms: int = 60_000, names: int = 10, alike: int = 5) -> DataFrame:
    """Sources with many unknown domains in a minute, enough of which look generated; once per minute, when it is so.

    `queries` has registrable and looks_generated of failed lookups.
    """
    keys = ["src", "minute"]
    rows = queries.filter("registrable IS NOT NULL").withColumn("minute", F.expr(f"obs_ms div {window_ms}"))
    firsts = rows.groupBy(*keys, "registrable").agg(F.min(F.struct("obs_ms", "looks_generated")).alias("f")).select(*keys, "registrable", "f.*")
    past = Window.partitionBy(*keys).orderBy("obs_ms", "registrable").rowsBetween(Window.unboundedPreceding, 0)
    counted = firsts.withColumn("n", F.count("*").over(past)).withColumn("k", F.count_if("looks_generated").over(past)).filter((F.col("n") >= names) & (F.col("k") >= alike))
    found = counted.withColumn("amount", F.col("n").cast("double")).withColumn("subtype", F.lit("nxdomain_burst")).withColumn("score", F.col("k") / F.col("n"))
    return _finish(found, keys, F.lit("high"), doubling=False)
