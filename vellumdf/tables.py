"""Reading tables and cutting lineage."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder; only the columns a query uses are read."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Write the rows to the checkpoint folder that all executors share and go on from there.

    The folder is the session's ``spark.checkpoint.dir``; one is set only where
    the session names none and the master is local, as in tests; on a cluster
    without one there is an error.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="vellumdf-"))
    return df.checkpoint(eager)
