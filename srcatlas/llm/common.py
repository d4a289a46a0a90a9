"""Small helpers that the operators of this folder share."""

from __future__ import annotations

from pyspark.sql import DataFrame

from srcatlas.session import tasks_for


def spread(df: DataFrame, per_core: int = 2) -> DataFrame:
    """Give a CPU-bound stage enough partitions: a scan that already has them is left alone, so no shuffle is added at scale."""
    want = tasks_for(df.sparkSession, per_core)
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want)
