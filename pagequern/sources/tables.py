"""Parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.shipping import ship

DEAL = "spark.pagequern.deal"


def table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{data_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deals rows out to as many partitions as spark.pagequern.deal says, for work heavy in CPU.

    Without that setting, as on a cluster, rows stay in the splits they were read in
    and no text is exchanged.  It is for single files of a few row groups, which
    cannot be split further; the plan depends on the setting only, never on a size.
    """
    parts = df.sparkSession.conf.get(DEAL, None)
    return df.repartition(int(parts)) if parts else df
