"""Exact top-k search by columnar branch and bound.

Vectors are cut into groups and queries into slots by hash; every (slot, group) pair is one task-sized piece
of work. Inside it the candidates lie in vertical layout. Inner products grow dimension block by dimension
block; what the remaining dimensions can add or take is bounded by the product of the remaining norms. After each
block the k-th best of the lower bounds is what a candidate must reach, and those whose upper bound doesn't are
compacted away.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Dimensions added between two compactions; candidates and queries of one piece of work.
BLOCK, GROUP_ROWS, SLOT_ROWS = 16, 16_384, 16_384
_NARROW, _LONG = float(2**31 - 1), 2**63 - 1


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, dims, vec (floor(scale * x) of every component), copies, of the vectors that take part.

    Vectors that are null or hold null or non-finite components are left out. Components are exact: 32-bit integers
    where all of a vector's fit, else doubles, which hold every float's floor. Equal rows are one row with `copies`.
    """
    schema = pa.schema([("vec_id", pa.int64()), ("dims", pa.int32()), ("vec", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims, out = [], [], []
            for vec_id, vector in zip(batch.column(0).to_pylist(), batch.column(1)):
                if vec_id is None or not vector.is_valid or vector.values.null_count:
                    continue
                x = vector.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(x).all():
                    ids.append(vec_id)
                    dims.append(len(x))
                    x = np.floor(x * scale)
                    out.append(x.astype("<i4" if (np.abs(x) <= _NARROW).all() else "<f8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], schema=schema)

    rows = vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, "vec_id long, dims int, vec binary")
    return rows.groupBy("vec_id", "dims", "vec").agg(F.count("*").alias("copies"))


def matrix(vecs, dims: int) -> np.ndarray:
    """Vectors as rows, in doubles."""
    rows = [np.frombuffer(v, "<i4" if len(v) == 4 * dims else "<f8") for v in vecs]
    return np.array(rows, np.float64).reshape(len(rows), dims)


def branch_and_bound(queries: np.ndarray, query_ids: np.ndarray, candidates: np.ndarray, ids: np.ndarray, k: int, copies: np.ndarray | None = None, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Each hit's query (its row), vec_id and score: the k best of `candidates` for each query, ties to smaller ids.

    A candidate counts `copies` times; one of those is the query itself where id and vector are the query's.
    """
    n, dims = candidates.shape
    copies = np.ones(n, np.int64) if copies is None else np.minimum(copies, k + 1)
    largest = float(np.abs(candidates).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(dims, 1)
    exact = largest < 2**52  # else whole numbers of any size
    whole = (lambda m: m) if exact else (lambda m: np.array([int(v) for v in m.ravel()], object).reshape(m.shape))
    tall = np.ascontiguousarray(whole(candidates.T))
    cuts = list(range(0, dims, block)) or [0]
    mass = [np.sqrt((candidates[:, c:] ** 2).sum(1)) for c in cuts[1:]]
    out_q, out_v, out_s = [], [], []
    for row, (query, query_id) in enumerate(zip(queries, query_ids.tolist())):
        left = copies
        own = np.flatnonzero(ids == query_id)
        own = own[(candidates[own] == query).all(1)]
        if len(own):
            left = copies.copy()
            left[own] -= 1
        alive = np.flatnonzero(left > 0)
        score, values = None, whole(query)
        for step, c in enumerate(cuts):
            part = values[c : c + block] @ (tall[c : c + block] if len(alive) == n else tall[c : c + block][:, alive]) if dims else np.zeros(len(alive))
            score = part if score is None else score + part
            if step + 1 < len(cuts) and len(alive) > k:
                so_far = score.astype(np.float64)
                reach = float(np.sqrt((query[c + block :] ** 2).sum())) * mass[step][alive] * (1 + 1e-9) + np.abs(so_far) * 1e-9 + 1e-6
                floor = np.partition(so_far - reach, -k)[-k]
                keep = so_far + reach >= floor
                alive, score = alive[keep], score[keep]
        best = np.lexsort((ids[alive], -score))[:k]
        best = np.repeat(best, left[alive[best]])[:k]
        out_q += [row] * len(best)
        out_v += ids[alive[best]].tolist()
        out_s += [int(s) for s in score[best]]
    return np.array(out_q, np.int64), np.array(out_v, np.int64), out_s


def exact_topk(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: for each vector whose id `every` divides, its k best of all other vectors.

    Every row is a query and a candidate of its own, also where rows repeat an id or are equal: the copies of a query
    are among its candidates. Ties go to smaller ids. Vectors of another length than the query's can't be compared and
    are passed over. Scores are ordered by their exact value; one beyond 64 bits is given as the nearest long. An
    empty table gives an empty result; other columns are ignored.
    """
    ready = quantised(vectors)
    spark = vectors.sparkSession
    rows = vectors.count()
    groups = max(2 * spark.sparkContext.defaultParallelism, -(-rows // GROUP_ROWS))
    slots = max(1, -(-rows // every // SLOT_ROWS))
    spread = lambda salt, n: F.pmod(F.xxhash64("vec_id", "vec", F.lit(salt)), F.lit(n)).cast("int")
    candidates = ready.withColumn("group", spread(1, groups)).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    asked = ready.filter(F.col("vec_id") % every == 0).withColumn("slot", spread(2, slots)).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def piece(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            row, vec_id, score = np.zeros(0, np.int64), np.zeros(0, np.int64), []
        else:
            dims = int(left["dims"].iloc[0])
            row, vec_id, score = branch_and_bound(matrix(left["vec"], dims), left["vec_id"].to_numpy(), matrix(right["vec"], dims), right["vec_id"].to_numpy(), k, right["copies"].to_numpy())
        found = left.iloc[row]
        narrow = [min(max(s, -_LONG - 1), _LONG) for s in score]
        # beyond 64 bits a double tells scores apart
        return pd.DataFrame({"query_id": found["vec_id"].to_numpy(), "query": found["vec"].to_numpy(), "copies": found["copies"].to_numpy(), "vec_id": vec_id, "score": np.array(narrow, np.int64), "beyond": [float(s) if s != t else 0.0 for s, t in zip(score, narrow)]})

    keys = ["slot", "group", "dims"]
    found = asked.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInPandas(piece, "query_id long, query binary, copies long, vec_id long, score long, beyond double")
    best = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    top = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return top.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("query_id", "rank", "vec_id", "score")
