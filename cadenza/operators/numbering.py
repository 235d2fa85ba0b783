"""Dense row numbers without a task for all rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.session import checkpoint_dir


def dense_number(df: DataFrame, order: list[str], group: list[str] | None = None, out: str = "row_number", start: int = 0) -> DataFrame:
    """``df`` with ``out``, the place of each row (from ``start``) in the order
    of ``order`` columns, within ``group`` columns if given.  Rows equal in
    ``order`` are numbered in no fixed order.

    Rows are range-partitioned into a table of the shared folder; places inside
    a partition are shifted by the rows of the group in the partitions before
    it, so a group of any size is spread over tasks."""
    spark, group = df.sparkSession, group or []
    path = f"{checkpoint_dir(spark).rstrip('/')}/numbered-{uuid.uuid4().hex[:12]}"
    keys = [F.col(c) for c in [*group, *order]]
    df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    parts = spark.read.parquet(path)
    sizes = parts.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"))  # a row for each partition and group in it
    before = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(*[F.col(c).alias(f"_{c}") for c in group], F.col("_part").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*order))
    same = F.col("_part") == F.col("_of")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return parts.withColumn("_inside", inside).join(shifts, same).select(*df.columns, (F.col("_shift") + F.col("_inside") - 1 + start).alias(out))
