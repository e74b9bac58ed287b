"""Mixing sources to target weights by subset-sum budget fitting.

Every source has a word budget. Whole copies of the source fill what they can; what remains of the budget is
filled by choosing documents once more: Spark counts the documents of each exact length, a share of every
length is taken in proportion, and a bounded-knapsack dynamic programme over the counts that are left fits
the last words. Which documents of a length are chosen follows from a seeded hash of their ids.

Lengths of a hot source are counted before anything is grouped, and the choice within one length is split
over hash buckets, so that a source or a length that holds a third of all rows still spreads over tasks.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, whole_row, with_own

WEIGHTS = (5, 2, 1)
#: A source gives at most this many times its own words.
MOST_COPIES = 3
SEED = 20240501
#: Words that the dynamic programme covers; a proportional and a greedy part bring the budget below it.
KNAPSACK_WORDS = 1 << 16
#: Rows of one length in one hash bucket, roughly, at most.
BUCKET_ROWS = 20_000


def word_count(text) -> "F.Column":
    """Number of runs of characters other than space and 0x09-0x0D; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """key, source_size, target of every source, ranked in one task by one row a source; `sizes` has key ('' for null, else '=' and the name) and size.

    Sources by code point, null last, weigh `weights`, repeating. All words are shared by weight; a share above
    `most` times the source's words stops there and its excess is shared again. With the sources in order of the
    point at which they stop, those that stop come first, and one pass of running sums finds them.
    """
    totals = sizes.groupBy("key").agg(F.sum("size").cast("long").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("key") == "", "key")) - 1
    weighed = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (rank % len(weights) + 1).cast("int")))
    weighed = weighed.withColumn("stop", F.col("source_size") * float(most))
    before = Window.orderBy(F.col("stop") / F.col("weight"), "key").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    share = (F.sum("source_size").over(everything) - F.coalesce(F.sum("stop").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    capped = weighed.withColumn("capped", share * F.col("weight") > F.col("stop"))
    left = F.sum("source_size").over(everything) - F.sum(F.when(F.col("capped"), F.col("stop")).otherwise(0.0)).over(everything)
    open_weight = F.sum(F.when(~F.col("capped"), F.col("weight")).otherwise(0.0)).over(everything)
    target = F.when(F.col("capped"), F.col("stop")).otherwise(left / open_weight * F.col("weight"))
    return capped.withColumn("target", target.cast("double")).select("key", "source_size", "target")


def fit_lengths(counts: dict[int, int], budget: int, window: int = KNAPSACK_WORDS) -> dict[int, int]:
    """How many documents of each length to take so that their words come as near to `budget` as they can, from below.

    A proportional share of every length first, long documents next, then a bounded knapsack over bit sets of
    reachable sums for the last `window` words.
    """
    counts = {size: n for size, n in counts.items() if size > 0}
    total = sum(size * n for size, n in counts.items())
    if budget >= total:
        return counts
    take = {size: n * budget // total for size, n in counts.items()}
    left = budget - sum(size * n for size, n in take.items())
    for size in sorted(counts, reverse=True):
        if left <= window:
            break
        more = min(counts[size] - take[size], left // size, (left - window) // size + 1)
        take[size] += more
        left -= more * size
    window = min(left, window)
    full = (1 << window + 1) - 1
    reach, steps = 1, []
    for size in sorted(counts, reverse=True):
        spare, piece = min(counts[size] - take[size], window // size), 1
        while spare > 0 and not reach >> window & 1:
            piece = min(piece, spare)
            steps.append((size, piece, reach))
            reach |= reach << size * piece & full
            spare -= piece
            piece *= 2
    at = reach.bit_length() - 1
    for size, piece, earlier in reversed(steps):
        if not earlier >> at & 1:
            take[size] += piece
            at -= size * piece
    return take


def _plan(rows: pd.DataFrame) -> pd.DataFrame:
    source_size, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
    whole = min(int(target // source_size), MOST_COPIES) if source_size else 0
    take = fit_lengths(dict(zip(rows["size"].tolist(), rows["n"].tolist())), round(target - whole * source_size)) if whole < MOST_COPIES else {}
    return pd.DataFrame({"key": rows["key"], "size": rows["size"], "whole": whole, "extra": [take.get(s, 0) for s in rows["size"]]})


OWN = ["_size", "_source_size", "_target", "_copies"]


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The rows of `docs`, all columns, with _size, _source_size, _target and _copies (0 to 3) of each.

    Null text has no words and is never taken; sources share words by weight; an empty table gives an empty result.
    Rows are told apart by doc_id and text: of rows that repeat both, any may be the one taken. Input columns with one
    of the four names are replaced; others pass through, whatever their names.
    """
    return with_own(_mixed(docs, seed), docs.columns, OWN)


def _mixed(docs: DataFrame, seed: int) -> DataFrame:
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    hashed = F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(seed))
    narrow = cut(docs.select(key.alias("key"), word_count(F.col("text")).alias("size"), hashed.alias("h")))
    buckets = max(64, narrow.count() // BUCKET_ROWS)
    bucket = F.pmod(F.col("h"), F.lit(buckets))
    counted = cut(narrow.groupBy("key", "size", bucket.alias("bucket")).agg(F.count("*").alias("n")))
    lengths = counted.groupBy("key", "size").agg(F.sum("n").alias("n"))
    targets = cut(source_targets(narrow))
    plan = lengths.join(targets, "key").groupBy("key").applyInPandas(_plan, "key string, size long, whole long, extra long")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("key", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    share = F.greatest(F.lit(0), F.least(F.col("n"), F.col("extra") - before))
    allocated = counted.join(plan, ["key", "size"]).withColumn("share", share).join(targets, "key")
    allocated = allocated.select(F.col("key").alias("_key"), F.col("size").alias("_size"), F.col("bucket").alias("_bucket"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), "whole", "share")
    rows = docs.select(whole_row(docs), key.alias("_key"), word_count(F.col("text")).alias("_size"), hashed.alias("_h")).withColumn("_bucket", F.pmod("_h", F.lit(buckets)))
    placed = rows.join(allocated, ["_key", "_size", "_bucket"])
    order = F.row_number().over(Window.partitionBy("_key", "_size", "_bucket").orderBy("_h", "_all.doc_id"))
    copies = F.col("whole") + F.when(order <= F.col("share"), 1).otherwise(0)
    chosen = placed.withColumn("_copies", F.when(F.col("_size") > 0, copies).otherwise(0).cast("int"))
    return chosen.select("_all", *OWN)


def mixed_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix itself: each row of `docs`, with its columns, as often as the mix takes it."""
    taken = _mixed(docs, seed).filter("_copies > 0")
    return with_own(taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))), docs.columns, [])
