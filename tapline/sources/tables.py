"""Readers of the engine's inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapline.functions.columns import host_of, micros


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with us and ms since 1970, day and hour numbers, and the peer key of their properties."""
    rows = table(spark, sf_dir, "events").withColumn("us", micros("ts")).withColumn("ms", F.expr("us div 1000"))
    return rows.withColumns({"day": F.expr("us div 86400000000"), "hour": F.expr("us div 3600000000"), "k": F.get_json_object("props", "$.k").cast("long")})


def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, label (the host's first label) of every page."""
    rows = table(spark, sf_dir, "pages").select("page_id", host_of("url").alias("host"))
    return rows.withColumn("label", F.element_at(F.split("host", r"\."), 1))
