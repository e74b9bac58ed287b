"""All registered queries of the telemetry engine, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tapline.plans import detection, features, history, ladders, records, streams

QUERIES = {**history.QUERIES, **detection.QUERIES, **features.QUERIES, **streams.QUERIES, **ladders.QUERIES, **records.QUERIES}
ORACLE_SQL = {**history.SQL, **detection.SQL, **features.SQL, **streams.SQL, **ladders.SQL, **records.SQL}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that contact several peers on one port in a day, with a severity."""
    return detection.q_scan_horizontal(spark, sf_dir)
