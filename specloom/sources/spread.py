"""Spreads a scan with fewer partitions than the cluster has cores."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(rows: DataFrame) -> DataFrame:
    """rows over all cores: a scan of a few small files is dealt out once, a scan of many stays as it is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows._jdf.queryExecution().toRdd().getNumPartitions() >= cores else rows.repartition(cores)
