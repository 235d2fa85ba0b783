"""Song tables: CSV reader with pandas-compatible null handling, and the
binding of the driver's parquet test tables onto the song schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.functions.text import null_na_strings

SONG_COLUMNS = ("artist_name", "song_title", "corpus", "song_url")

SONG_SCHEMA = T.StructType(
    [
        T.StructField("song_id", T.LongType(), False),
        T.StructField("artist_name", T.StringType(), True),
        T.StructField("song_title", T.StringType(), True),
        T.StructField("corpus", T.StringType(), True),
        T.StructField("song_url", T.StringType(), True),
    ]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet test tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_songs_csv(
    spark: SparkSession,
    path: str,
    columns=SONG_COLUMNS,
    mode: str = "PERMISSIVE",
    id_col: str | None = None,
) -> DataFrame:
    """Read a lyrics CSV the way the application's reader sees it.

    * header row, columns selected **by name** (the file's full column list
      is unknown; an explicit schema would bind by position);
    * quoted fields may hold newlines; ``""`` escapes a quote;
    * PERMISSIVE keeps over-long rows (extra fields ignored) and pads short
      rows with null -- the effective behaviour of the reference reader;
      ``mode="DROPMALFORMED"`` is offered but also drops short rows;
    * the pandas default NA strings become null.

    Without an id column in the file, ``song_id`` is a hash of the content,
    the file and the row's occurrence number among equal rows of that file:
    unique, and stable across runs and partitionings.

    Quoted newlines keep a file from being split, so a file is one task: write
    large collections as many files, or convert them to Parquet once.
    """
    raw = (
        spark.read.option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .option("mode", mode)
        .option("inferSchema", False)
        .csv(path)
    )
    fields = [null_na_strings(F.col(c)).alias(c) for c in columns]
    if id_col is not None:
        return raw.select(F.col(id_col).cast("bigint").alias("song_id"), *fields)
    hashed = raw.select(*fields, F.input_file_name().alias("_file")).withColumn(
        "_h", F.xxhash64(*columns, "_file"))
    occurrence = F.row_number().over(Window.partitionBy("_h", "_file").orderBy("_h"))
    return hashed.withColumn("_n", occurrence).select(
        F.xxhash64("_h", "_file", "_n").alias("song_id"), *columns)


def write_songs_csv(songs: DataFrame, path: str) -> None:
    """Write songs with their ids as CSV that :func:`read_songs_csv` reads back
    (``id_col="song_id"``): header, quotes doubled, newlines kept."""
    (songs.select("song_id", *SONG_COLUMNS).write.option("header", True).option("quoteAll", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def songs_from_documents(documents: DataFrame) -> DataFrame:
    """Bind the ``documents`` test table to the song schema:
    ``song_id = doc_id``, ``song_title = 'song_' || doc_id``,
    ``artist_name = source``, ``corpus = text``, ``song_url = '/song/' || doc_id``."""
    return documents.select(
        F.col("doc_id").alias("song_id"),
        F.col("source").alias("artist_name"),
        F.concat(F.lit("song_"), F.col("doc_id").cast("string")).alias("song_title"),
        F.col("text").alias("corpus"),
        F.concat(F.lit("/song/"), F.col("doc_id").cast("string")).alias("song_url"),
    )


def load_songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Songs of a test scale factor with the NA-string rule applied."""
    songs = songs_from_documents(table(spark, sf_dir, "documents"))
    return songs.select(
        "song_id",
        *[null_na_strings(F.col(c)).alias(c) for c in SONG_COLUMNS],
    )


def eligible_songs(songs: DataFrame, min_chars: int = 50) -> DataFrame:
    """Drop null corpus, keep texts strictly longer than ``min_chars`` code
    points (no trimming)."""
    return songs.filter(F.col("corpus").isNotNull() & (F.length("corpus") > min_chars))
