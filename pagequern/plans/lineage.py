"""Cutting lineage with reliable checkpoints in the cluster's shared folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only in local mode where none is set."""
    folder = spark.conf.get(CONF, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"{CONF} must name a folder that all executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), "pagequern-checkpoints")
        spark.conf.set(CONF, folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and goes on from there."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)
