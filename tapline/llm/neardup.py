"""MinHash near-duplicates with bottom-k sketches from one hash function.

A document's set of word shingles keeps its k smallest hashes. Documents with equal sets become one class. The
retained values are inverted, and each class probes only its rarest ones: two sketches that overlap enough share one
of those (the prefix-filter argument, with rarity as the order). Short lists generate all their pairs. A list longer
than LONG_LIST is never paired: each of its classes meets the leader of the list's size stratum, and only those that
the leader doesn't link are compared with the rest, block by block inside tasks that emit nothing but likely links.
Candidate pairs are filtered by the similarity that the union of two sketches estimates, and confirmed on full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, encoded, maybe_in, shingle_sets, workspace
from .components import connected_components, star_links

#: Retained values of a sketch; the estimate that a pair must reach; the longest list that is paired.
K, ESTIMATE, LONG_LIST = 48, 0.55, 24
#: Retained values of the long sketches that classes of long lists get, and classes of a block.
LONG_K, BLOCK_ROWS = 512, 768
#: Pairs of one class that one copy of its text serves.
PAIRS_A_SLOT = 256


def sketches(docs: DataFrame, n: int, k: int) -> DataFrame:
    """doc_id, n_shingles, digest (of the whole set), sketch (its k smallest hashes, as signed longs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, kept = [], [], []
            for values in shingle_sets(encoded(batch.column(1)), n):
                sizes.append(len(values))
                digests.append(hashlib.blake2b(values.tobytes(), digest_size=16).digest() if len(values) else None)
                kept.append(values[:k].view(np.int64))
            flat = np.concatenate(kept) if kept else np.zeros(0, np.int64)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in kept])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["doc_id", "n_shingles", "digest", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, digest binary, sketch array<long>")


def _probes(classes: DataFrame, percent: int, k: int) -> DataFrame:
    """value, gid, n, df, m: the rarest retained values of each class, as many as the prefix filter asks for.

    Sets that a sketch holds whole, with any set they could match, must share `percent` of their values exactly; other
    sketches must share half. Values that one class alone retains come first in the order and match nothing.
    """
    size = F.size("sketch")
    need = F.when(F.col("n") <= k * percent // 100, F.ceil(size * percent / 100)).otherwise(F.ceil(size / 2))
    values = classes.select("gid", "n", size.alias("s"), (size - need + 1).alias("prefix"), F.explode("sketch").alias("value"))
    shared = cut(values.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1"))  # a table: the join can then split hot values
    known = maybe_in(values, F.col("value"), shared, F.col("value")).filter("_maybe").drop("_maybe").join(shared, "value")
    order = Window.partitionBy("gid").orderBy("df", "value")
    ranked = known.withColumn("rank", F.row_number().over(order)).withColumn("m", F.count("*").over(Window.partitionBy("gid")))
    return ranked.filter("rank <= prefix - (s - m)").select("value", "gid", "n", "df", "m")


def _alike_sizes(a, b, percent: int):
    return (F.least(a, b) * 100 >= F.greatest(a, b) * percent)


def _estimated(pairs: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """Pairs whose union sketch (the k smallest values of both) holds enough values that both have."""
    kept = lambda side: classes.select(F.col("gid").alias(side), F.col("sketch").alias(f"sketch_{side}"))
    both = pairs.join(kept("a"), "a").join(kept("b"), "b")
    union = F.slice(F.array_sort(F.array_union("sketch_a", "sketch_b")), 1, k)
    common = F.size(F.array_intersect(union, F.array_intersect("sketch_a", "sketch_b")))
    return both.filter(common >= ESTIMATE * F.size(union)).select("a", "b")


def confirmed(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough. `texts` has gid, text of every class.

    A class with many pairs has its text copied to as many slots as PAIRS_A_SLOT asks for, so that none holds all.
    """
    slots = cut(pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS_A_SLOT).cast("int").alias("slots")))
    dealt = pairs.join(slots, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("slots")).cast("int").alias("slot"))
    firsts = texts.select(F.col("gid").alias("a"), F.col("text").alias("text_a")).join(slots, "a")
    firsts = firsts.select("a", "text_a", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"))
    both = dealt.join(firsts, ["a", "slot"]).join(texts.select(F.col("gid").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None  # a gid can come with several texts
        for batch in batches:
            left, right = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = []
            for i, other in enumerate(shingle_sets(encoded(batch.column(3)), n)):
                text = batch.column(2)[i].as_py()
                if text != last or own is None:
                    last = text
                    own = next(shingle_sets([text.encode("utf-8", "surrogatepass")], n))
                shared = len(np.intersect1d(own, other, assume_unique=True))
                keep.append(shared * 100 >= percent * (len(own) + len(other) - shared))
            at = [i for i, k in enumerate(keep) if k]
            yield pa.RecordBatch.from_arrays([pa.array([left[i] for i in at], pa.int64()), pa.array([right[i] for i in at], pa.int64())], ["a", "b"])

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _stratum(n):
    """A class's size on a scale of steps of 1.25: classes alike enough are at most one step apart."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(1.25))).cast("int")


def _leaders(long_lists: DataFrame) -> DataFrame:
    """leader, gid, member: each class of a long list with the leader of its own and of both next size strata.

    A stratum's leader is the class that shares most of its retained values with others. Classes that several lists
    put together appear once.
    """
    rows = long_lists.withColumn("stratum", _stratum(F.col("n")))
    chosen = rows.groupBy("value", "stratum").agg(F.max(F.struct("m", (-F.col("gid")).alias("minus"))).alias("top"))
    leaders = cut(chosen.select("value", "stratum", (-F.col("top.minus")).alias("leader")))
    visits = rows.select("value", "gid", F.explode(F.array(F.col("stratum") - 1, F.col("stratum"), F.col("stratum") + 1)).alias("stratum"))
    return visits.join(leaders, ["value", "stratum"]).select("leader", "gid").distinct()


def _residual(clusters: DataFrame, found: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Likely links of the classes that aren't in their leader's component: each against all that share the leader.

    Both sides are dealt in blocks of hashed ids, so that no cluster is gathered whole. A task compares two blocks
    of long sketches, which hold most sets whole, and emits only pairs that the union sketch finds similar.
    """
    side = lambda name: found.select(F.col("node").alias(name), F.col("component").alias(f"in_{name}"))
    placed = clusters.filter("leader != gid").join(side("leader"), "leader", "left").join(side("gid"), "gid", "left")
    open_rows = cut(placed.filter(F.coalesce("in_leader", "leader") != F.coalesce("in_gid", "gid")).select("leader", "gid"))
    sizes = clusters.join(open_rows.select("leader").distinct(), "leader").groupBy("leader").agg(F.count("*").alias("rows"))
    blocks = cut(sizes.select("leader", F.ceil(F.col("rows") / BLOCK_ROWS).cast("int").alias("blocks")))
    wanted = clusters.join(blocks, "leader")
    needed = cut(wanted.select("gid").distinct())
    near = maybe_in(texts, F.col("gid"), needed, F.col("gid")).filter("_maybe")
    long_sketches = cut(sketches(near.join(needed, "gid").select(F.col("gid").alias("doc_id"), "text"), n, LONG_K).select(F.col("doc_id").alias("gid"), "n_shingles", "sketch"))
    spread = lambda salt: F.pmod(F.xxhash64("gid", F.lit(salt)), F.col("blocks")).cast("int")
    each = lambda name: F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias(name)
    # aliases give each side columns of its own, as both come from the same tables
    own = lambda df: df.select(*(F.col(c).alias(c) for c in ("leader", "x", "y", "gid", "n_shingles", "sketch")))
    asking = own(open_rows.join(blocks, "leader").select("leader", "gid", spread(1).alias("x"), each("y")).join(long_sketches, "gid"))
    asked = own(wanted.select("leader", "gid", spread(2).alias("y"), each("x")).join(long_sketches, "gid"))

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        a, b = similar_blocks(left, right, percent)
        return pd.DataFrame({"a": a, "b": b})

    keys = ["leader", "x", "y"]
    return asking.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(compare, "a long, b long").distinct()


def similar_blocks(left: pd.DataFrame, right: pd.DataFrame, percent: int, k: int = LONG_K) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of gids, one from each block, whose long sketches are similar; sets held whole are compared exactly.

    Overlaps come from a sorted list of the left block's values that the right block's sketches are looked up in.
    """
    none = np.zeros(0, np.int64)
    if left.empty or right.empty:
        return none, none
    left_ids, left_n = left["gid"].to_numpy(), left["n_shingles"].to_numpy()
    lengths = np.array([len(s) for s in left["sketch"]])
    values = np.concatenate(left["sketch"].to_list())
    owner = np.repeat(np.arange(len(left)), lengths)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    out_a, out_b = [], []
    for gid, n, sketch in zip(right["gid"], right["n_shingles"], right["sketch"]):
        sketch = np.asarray(sketch)
        low, high = np.searchsorted(values, sketch, "left"), np.searchsorted(values, sketch, "right")
        hit = high > low
        counts = high[hit] - low[hit]
        if not len(counts):
            continue
        at = np.repeat(low[hit] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
        overlap = np.bincount(owner[at], minlength=len(left))
        whole = (left_n <= k) & (n <= k)
        exact = overlap * 100 >= percent * (left_n + n - overlap)
        # at least one set is cut: the shared values among the k smallest of both, within four deviations
        rough = overlap >= (percent / 100 - 0.08) * np.minimum(np.minimum(left_n, n), k) * 0.9
        keep = np.flatnonzero(np.where(whole, exact, rough) & (left_ids != gid) & (np.minimum(left_n, n) * 100 >= percent * np.maximum(left_n, n)))
        out_a += left_ids[keep].tolist()
        out_b += [gid] * len(keep)
    return np.array(out_a, np.int64), np.array(out_b, np.int64)


def _joined_pairs(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """node, component of what confirmed `pairs` join: at first one pair for each class, with its smallest partner.

    Pairs whose classes those links already join say nothing new about components, and aren't compared.
    """
    first = cut(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    found = connected_components(confirmed(first, _of(texts, first), n, percent))
    side = lambda name: found.select(F.col("node").alias(name), F.col("component").alias(f"in_{name}"))
    apart = pairs.join(first, ["a", "b"], "left_anti").join(side("a"), "a", "left").join(side("b"), "b", "left")
    rest = cut(apart.filter(F.coalesce("in_a", "a") != F.coalesce("in_b", "b")).select("a", "b"))
    return found if rest.isEmpty() else connected_components(star_links(found).unionByName(confirmed(rest, _of(texts, rest), n, percent)))


def _of(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The texts (gid, text) of the classes in `pairs`."""
    needed = cut(pairs.select(F.explode(F.array("a", "b")).alias("gid")).distinct())
    return maybe_in(texts, F.col("gid"), needed, F.col("gid")).filter("_maybe").drop("_maybe").join(needed, "gid")


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, k: int = K) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id, kept.

    A document's set holds its distinct n-word shingles (A-Z in lower case); with fewer words, all its words as one.
    Documents whose sets reach `percent` similarity are linked; component_id is the smallest doc_id that links reach.
    Null text counts as empty; documents without words are linked with nothing and kept. Rows that repeat a doc_id
    are in the component of either text. A row without doc_id is never kept, nor smallest. Other columns are ignored.
    """
    with workspace(docs.sparkSession):
        return cut(_grouped(docs.select("doc_id", "text"), n, percent, k), keep=True)


def _grouped(docs: DataFrame, n: int, percent: int, k: int) -> DataFrame:
    made = cut(sketches(docs, n, k))
    some = made.filter("digest IS NOT NULL")
    counted = some.groupBy("digest").agg(F.min("doc_id").alias("gid"), F.count("*").alias("n"))
    repeated = cut(counted.filter("n > 1").select("digest", "gid"))
    # only documents whose set may be another's move
    dealt = maybe_in(some, F.col("digest"), repeated, F.col("digest"))
    still = dealt.filter("NOT _maybe").select("doc_id", "n_shingles", "sketch", F.col("doc_id").alias("gid"))
    moved = dealt.filter("_maybe").join(repeated, "digest", "left").select("doc_id", "n_shingles", "sketch", "digest", F.coalesce("gid", "doc_id").alias("gid"))
    members = made.filter("digest IS NULL").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("gid"))
    for part in (still, moved):
        members = members.unionByName(part.select("doc_id", "n_shingles", "gid"))
    # a doc_id that repeats with other texts can stand for two classes: links then go by id, which joins them rightly
    firsts = moved.filter("doc_id = gid").groupBy("gid", "digest").agg(F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    own = still.filter("gid IS NOT NULL").select("gid", F.col("n_shingles").alias("n"), "sketch")
    classes = cut(firsts.drop("digest").unionByName(own))
    probes = cut(_probes(classes, percent, k))
    short = probes.filter(F.col("df") <= LONG_LIST).select("value", "gid", "n")
    right = short.select("value", F.col("gid").alias("b"), F.col("n").alias("n_b"))
    paired = short.withColumnRenamed("gid", "a").join(right, "value").filter((F.col("a") < F.col("b")) & _alike_sizes(F.col("n"), F.col("n_b"), percent))
    candidates = _estimated(paired.select("a", "b").distinct(), classes, k)
    clusters = cut(_leaders(probes.filter(F.col("df") > LONG_LIST)))
    with_leaders = _estimated(clusters.filter("leader != gid").select(F.col("leader").alias("a"), F.col("gid").alias("b")), classes, k)
    pairs = cut(candidates.unionByName(with_leaders).distinct())
    texts = docs.withColumnRenamed("doc_id", "gid").withColumn("text", F.coalesce("text", F.lit("")))
    found = _joined_pairs(pairs, texts, n, percent)
    if not clusters.isEmpty():
        more = cut(_residual(clusters, found, texts, n, percent))
        if not more.isEmpty():
            found = connected_components(star_links(found).unionByName(star_links(_joined_pairs(more, texts, n, percent))))
    same = members.join(found.select(F.col("node").alias("gid"), "component"), "gid", "left")
    component = F.coalesce("component", "gid", "doc_id")
    out = same.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
