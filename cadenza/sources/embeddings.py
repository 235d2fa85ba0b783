"""Embedding tables: ``(song_id bigint, embedding array<float>)`` keyed by id.

The reference aligns vector *i* with table row *i*.  Spark has no row order,
so alignment is an explicit key and an equi-join; the key must be unique.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.sources.songs import table


def embeddings_from_table(emb: DataFrame) -> DataFrame:
    """Bind the ``embeddings`` test table: ``song_id = vec_id``,
    ``cluster = label``."""
    return emb.select(
        F.col("vec_id").alias("song_id"),
        F.col("embedding"),
        F.col("label").alias("cluster"),
    )


def load_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings_from_table(table(spark, sf_dir, "embeddings"))


def embedding_profile(emb: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """One-row profile: rows, distinct keys, min/max dimension, min/max L2 norm.
    A single partial+final aggregation, no collect."""
    n = F.sqrt(F.aggregate(F.transform(vec_col, lambda x: x.cast("double")),
                           F.lit(0.0).cast("double"), lambda a, x: a + x * x))
    return emb.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("song_id").alias("n_keys"),
        F.min(F.size(vec_col)).alias("min_dim"),
        F.max(F.size(vec_col)).alias("max_dim"),
        F.round(F.min(n), 6).alias("min_norm"),
        F.round(F.max(n), 6).alias("max_norm"),
    )


def vector_dim(emb: DataFrame, vec_col: str = "embedding") -> tuple[int, int]:
    """(rows, common dimension) of a vector column, (0, 0) without rows;
    raises on null or empty vectors and mixed dimensions."""
    size = F.coalesce(F.size(vec_col), F.lit(-1))
    row = emb.agg(F.min(size).alias("lo"), F.max(size).alias("hi"), F.count(F.lit(1)).alias("n")).first()
    if row["n"] and (row["lo"] != row["hi"] or row["lo"] < 1):
        raise ValueError(f"mixed or missing embedding dimensions: {row['lo']}..{row['hi']}")
    return int(row["n"]), int(row["hi"] or 0)


def join_embeddings(emb: DataFrame, songs: DataFrame) -> DataFrame:
    """Attach song metadata to vectors: inner 1:1 equi-join on ``song_id``
    (a shuffle join of two tables of the same size; AQE may turn it into a
    broadcast when one side turns out small at run time)."""
    return emb.join(songs, "song_id", "inner")
