"""Cutting lineage in loops."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def settle(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder that all executors see, so that a loop's plan stays short.

    The folder is the session's ``spark.checkpoint.dir``; only where it names none (tests) a local one is made.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="meridian-"))
    return df.checkpoint()
