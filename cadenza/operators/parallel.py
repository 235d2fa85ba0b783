"""Parallelism guard for CPU-heavy row-local operators."""

from __future__ import annotations

from pyspark.sql import DataFrame

SPLIT_BYTES = 128 << 20  # Spark's default size of a file split


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Round-robin a small ``df`` over ``partitions`` partitions (default: the
    context's default parallelism).

    A large scan already has thousands of splits and passes through; a small
    input (one Parquet row group) would otherwise run a heavy per-row kernel
    in a single task.  The size is the planner's estimate from file sizes, so
    nothing runs; rows are the same either way.  Streams pass through."""
    if df.isStreaming:
        return df
    target = partitions or df.sparkSession.sparkContext.defaultParallelism
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(target) if estimate < target * SPLIT_BYTES else df
