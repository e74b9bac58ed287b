"""The corpus pipeline: documents through five stages to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all that the stage before kept, and its
decisions take effect. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapline.llm import bpe, linededup, mixing, neardup, quality
from tapline.llm.common import cut, remove_folder, shared_folder, table, whole_row, with_own


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; null text is judged like empty text."""
    field = quality.train(docs, table(spark, sf_dir, "labels"))
    return with_own(quality.scored(docs, field).filter("_predicted = 1"), docs.columns, [])


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one, or are one to three edits from it by length, go; so do documents that lose all."""
    return linededup.deduped_documents(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, 0.8) the document with the smallest doc_id stays.

    Rows are told apart by doc_id and text; one without doc_id stays if its group has no other. Of rows that repeat
    both, any one stays, whatever its other columns, which may be of types without order. Documents without words all
    stay, and an empty table stays empty.
    """
    names = docs.columns
    keyed = docs.select(whole_row(docs), F.xxhash64("doc_id", "text").alias("_key"))
    groups = neardup.near_duplicates(keyed.select(F.col("_key").alias("doc_id"), F.col("_all.text").alias("text")))
    ids = keyed.select("_key", F.col("_all.doc_id").alias("id")).groupBy("_key").agg(F.min("id").alias("id"))
    rows = groups.groupBy(F.col("doc_id").alias("_key"), "component_id").agg(F.count("*").alias("_n"), F.max("n_shingles").alias("_words")).join(ids, "_key")
    first = rows.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "_key", "_n", "_words")).alias("x"))
    kept = cut(first.select("x._key", ((F.col("x._n") > 1) & (F.col("x._words") > 0)).alias("_several")))
    found = keyed.join(kept, "_key")
    once = found.filter("_several").groupBy("_key").agg(F.any_value("_all").alias("_all"))
    return with_own(found.filter("NOT _several").select("_all").unionByName(once.select("_all")), names, [])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mixed_documents(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids of each text, and their digests; null text has no tokens, repeated rows are encoded each."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES = [("quality", quality_stage), ("line_dedup", line_stage), ("near_dedup", near_duplicate_stage), ("mixing", mixing_stage), ("encoding", encoding_stage)]

#: Models and knapsack choices have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between two of them a Parquet table in the shared folder.

    A stage's table is removed when the next one's is written; the last one stays, as the result reads it.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}-{name}")
            if k:
                remove_folder(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
