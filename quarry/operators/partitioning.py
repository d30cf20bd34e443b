"""Partitioning helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ensure_parallelism(df: DataFrame, factor: int = 2) -> DataFrame:
    """Spread a scan over the cluster when it arrives in fewer partitions than there are
    cores (e.g. a file written as a single row group, which only one task can read), so that
    CPU-heavy per-row work (regex splits, chunking, hashing of whole texts) runs in parallel.

    A large input already has far more partitions than cores, so this is a no-op at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores * factor)
    return df


MAX_BROADCAST_BYTES = 64 << 20


def planned_bytes(df: DataFrame) -> int:
    """The optimizer's size of ``df``: file sizes and literal rows carried through the plan. It is
    read from the plan, without a job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Mark ``df`` for broadcast when its planned size is at most ``max_bytes``; beyond that the
    join is left to the planner, which shuffles and may still convert at runtime from the sizes
    it has measured."""
    return F.broadcast(df) if planned_bytes(df) <= max_bytes else df
