"""Sinks: clustered song tables and the keyed run-result store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_clustered(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write a clustered table partitioned by ``cluster`` (no index column).
    Reading one cluster back then prunes to one directory."""
    df.write.mode(mode).partitionBy("cluster").parquet(path)


def read_clustered(spark: SparkSession, path: str, cluster: int | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    if cluster is not None:
        df = df.filter(F.col("cluster") == cluster)  # partition pruning
    return df


def append_run(df: DataFrame, path: str, run_id: str) -> None:
    """Store a run's result keyed by ``run_id``: one write per run into its own
    partition, committed at its end.  A second try of a run replaces the first
    and leaves other runs alone; only a second try without rows leaves the
    first's."""
    (
        df.withColumn("run_id", F.lit(run_id))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_id")
        .parquet(path)
    )


def read_run(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("run_id") == run_id)
