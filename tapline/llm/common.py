"""Small helpers that the training-data operators share."""

from __future__ import annotations

import gc
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` under `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Only where that is unset, as in local tests, a temporary folder of this machine becomes the checkpoint folder.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if named is None and context.getCheckpointDir() is None:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tapline-checkpoint-"))
    return named or context.getCheckpointDir()


#: How tables of hashes are written: nothing in them repeats, so neither dictionaries nor compression gain anything.
PLAIN = {"compression": "uncompressed", "parquet.enable.dictionary": "false"}


def written(df: DataFrame, plain: bool = False) -> tuple[DataFrame, str]:
    """`df` written as a Parquet table in the shared folder, and the table's path; `plain` is for tables of hashes."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.options(**PLAIN if plain else {}).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


_SCOPES = threading.local()


def cut(df: DataFrame, keep: bool = False) -> DataFrame:
    """`df` written as a table: its lineage ends there, and its size is known from then on.

    In a workspace the table goes when that ends; with `keep` it stays for the one around it, or if there is none.
    """
    return _scoped(*written(df), keep)


def cut_plain(df: DataFrame) -> DataFrame:
    """`cut` for tables of hashes."""
    return _scoped(*written(df, plain=True), False)


def _scoped(out: DataFrame, path: str, keep: bool) -> DataFrame:
    scopes = getattr(_SCOPES, "open", [])
    if len(scopes) > keep:
        scopes[-1 - keep].append(path)
    return out


@contextmanager
def workspace(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A block at whose end the tables that `cut` wrote in it are removed; what leaves it is kept or written before."""
    if not hasattr(_SCOPES, "open"):
        _SCOPES.open = []
    _SCOPES.open.append([])
    try:
        yield cut
    finally:
        for path in _SCOPES.open.pop():
            remove_folder(spark, path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's file systems."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that nothing refers to any more, as after a table was written.

    It does so when the driver collects garbage, which it may not for long if its memory suffices.
    """
    gc.collect()
    spark._jvm.System.gc()


def whole_row(docs: DataFrame) -> "F.Column":
    """All columns of `docs` as one struct, _all, so that no name of theirs meets an operator's own."""
    return F.struct(*(F.col(f"`{n.replace('`', '``')}`") for n in docs.columns)).alias("_all")


def with_own(packed: DataFrame, names: list[str], own: list[str]) -> DataFrame:
    """The columns `names` of _all, and then the operator's `own`; where names clash, the operator's stand."""
    taken = {n.lower() for n in own}
    return packed.select(*(F.col("_all").getField(n).alias(n) for n in names if n.lower() not in taken), *own)


#: 64-bit words that a membership filter has: its broadcast takes no more rows than that.
FILTER_WORDS = 1 << 19


def maybe_in(rows: DataFrame, key: "F.Column", wanted: DataFrame, wanted_key: "F.Column") -> DataFrame:
    """The `rows` whose key some row of `wanted` may have, and all with _maybe: false only where none has it.

    The keys of `wanted` set bits of FILTER_WORDS words, which are broadcast: their size is bounded whatever the
    input. Rows that can't match then stay where they are, and a join after this moves few others.
    """
    spot = lambda k: (F.pmod(k, F.lit(FILTER_WORDS)).alias("_word"), F.shiftrightunsigned(k, 40).bitwiseAND(F.lit(63)).cast("int").alias("_bit"))
    word, bit = spot(F.xxhash64(F.lit(3), wanted_key))
    words = wanted.select(word, bit).groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits"))
    word, bit = spot(F.xxhash64(F.lit(3), key))
    marked = rows.withColumns({"_word": word, "_bit": bit}).join(F.broadcast(words), "_word", "left")
    hit = F.expr("shiftright(_bits, _bit)").bitwiseAND(F.lit(1)) == 1
    return marked.withColumn("_maybe", F.coalesce(hit, F.lit(False))).drop("_word", "_bit", "_bits")


def held_out_fold(doc_id) -> "F.Column":
    """crc32 of the document id's decimal text, modulo 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        grown = np.full(max(n, 2 * len(_POWERS), 64), _BASE, np.uint64)
        grown[0] = 1
        _POWERS = np.multiply.accumulate(grown)
    return _POWERS


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of `texts`, and how many words each text has.

    A word is a run of bytes other than space and 0x09-0x0D. The work is vectorised over the batch.
    """
    joined = b" ".join(texts)
    data = np.frombuffer(joined, np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    solid = ~_SPACE[data]
    edges = np.diff(np.concatenate(([0], solid.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    at = np.flatnonzero(solid)
    sizes = ends - starts
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    within = np.arange(len(at)) - np.repeat(first, sizes)
    value = (data[at].astype(np.uint64) + np.uint64(1)) * _powers(int(sizes.max()))[within]
    hashes = mix64(np.add.reduceat(value, first) + sizes.astype(np.uint64))
    text_ends = np.cumsum(lengths + 1)
    counts = np.diff(np.concatenate(([0], np.searchsorted(starts, text_ends, "left"))))
    return hashes, counts


def shingle_sets(texts: list[bytes], n: int, chunk_bytes: int = 2 << 20):
    """Yield for each text the sorted distinct 64-bit hashes of its n-word shingles, letters A-Z in lower case.

    A text of fewer than n words gives one shingle of all its words; a text without words none.
    """
    at = 0
    while at < len(texts):
        end, held = at, 0
        while end < len(texts) and (end == at or held + len(texts[end]) <= chunk_bytes):
            held += len(texts[end])
            end += 1
        hashes, counts = word_hashes([t.lower() for t in texts[at:end]])
        begin = 0
        for count in counts.tolist():
            words = hashes[begin : begin + count]
            begin += count
            if not count:
                yield words
                continue
            width = min(n, count)
            total = np.zeros(count - width + 1, np.uint64)
            for k in range(width):
                total = mix64(total * np.uint64(3) + words[k : count - width + 1 + k] + np.uint64(width))
            yield np.unique(total)
        at = end


def encoded(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null counts as empty."""
    return [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in column.to_pylist()]
