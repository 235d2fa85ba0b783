"""A keyed result of a stream, stored as the rows that changed.

The aggregation runs in update mode, so a micro-batch holds only the keys it
changed.  Each micro-batch is written to a folder of its own number: a second
try of one replaces the first, and the bytes written follow the changed keys,
not the size of the result.  The result is read by folding: of each key the row
of the latest batch, a partial aggregation.  :func:`compact` folds what there
is into one table, which later reads start from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

BATCH = "_batch"
UPTO = "_upto"


def start_upserts(df: DataFrame, path: str, available_now: bool = True) -> StreamingQuery:
    """Start a streaming aggregation in update mode into the store at ``path``;
    its checkpoint lies there too, so a restart goes on where it stopped."""
    _empty(df.sparkSession, df.schema).write.mode("overwrite").parquet(f"{path}/changes/{BATCH}=-1")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/changes/{BATCH}={number}")

    writer = df.writeStream.outputMode("update").option("checkpointLocation", f"{path}/checkpoint").foreachBatch(keep)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def changes(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All rows written, with the number of their batch."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())])).parquet(f"{path}/changes")


def _folded(rows: DataFrame, schema: T.StructType, key: str) -> DataFrame:
    others = [c for c in schema.names if c != key]
    last = F.max_by(F.struct(*others), BATCH).alias("_last")
    return rows.groupBy(key).agg(last).select(*[F.col(key) if c == key else F.col("_last")[c].alias(c) for c in schema.names])


def read_upserts(spark: SparkSession, path: str, schema: T.StructType, key: str, base: str | None = None) -> DataFrame:
    """The result so far: a row for each key.  With ``base``, the path that
    :func:`compact` returned, only later batches are read besides."""
    rows = changes(spark, path, schema)
    if base is not None:
        held = spark.read.parquet(base)
        upto = int(base.rsplit("=", 1)[1])
        rows = rows.filter(F.col(BATCH) > upto).unionByName(held.withColumn(BATCH, F.lit(upto).cast("long")))  # prunes folders
    return _folded(rows, schema, key)


def compact(spark: SparkSession, path: str, schema: T.StructType, key: str, base: str | None = None) -> str:
    """Fold the store into one table and return its path.  Run it while no
    batch is being written."""
    upto = changes(spark, path, schema).agg(F.max(BATCH)).first()[0]
    upto = -1 if upto is None else upto
    out = f"{path}/base/{UPTO}={upto}"
    if base != out:
        read_upserts(spark, path, schema, key, base).write.mode("overwrite").parquet(out)
    return out
