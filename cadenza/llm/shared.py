"""Helpers of the operators: tables in the shared folder, words."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cadenza.session import checkpoint_dir

# Words are maximal runs of anything but these six characters; bytes.split()
# without arguments splits UTF-8 text at the same six.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the
    lineage, survives lost executors and keeps later readers from computing
    ``df`` again."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8 bytes; null has none."""
    return text.encode("utf-8").split() if text else []
