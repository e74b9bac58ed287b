"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset, as in local tests, a temporary folder."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if named is None and context.getCheckpointDir() is None:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tapline-checkpoint-"))
    return named or context.getCheckpointDir()


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder through Spark's file systems."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
