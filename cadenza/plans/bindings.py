"""Bindings of the driver's test tables onto the song-analytics data model,
in Spark and as SQL common-table expressions for the DuckDB oracle.

=============  ==============================================================
songs          documents: song_id = doc_id, song_title = 'song_' || doc_id,
               artist_name = source, corpus = text, song_url = '/song/' || doc_id
               (pandas NA strings -> null)
vectors        embeddings: song_id = vec_id, embedding, cluster = label
clustered      songs joined to vectors (the given labels are the clustering)
catalogue      labels joined to documents: track_id = 't' || doc_id,
               title = 'song_' || doc_id, artist = source,
               images = [{url: 'img/' || doc_id}] when quality = 1 else [],
               preview_url = 'preview/' || doc_id when toxic = 0 else null
requests       conversations: request_id = conv_id * 10 + turn;
               mode = 'lyrics' for user, 'song' for assistant, null for system;
               lyrics = text; song_name = 'song_' || conv_id ('' from turn 6);
               artist_name = 'src' || turn
events         events: session = user_id, step = event_type, progress = value,
               terminal record = event_type 'purchase'
=============  ==============================================================
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza import constants as K
from cadenza.sources.embeddings import load_embeddings
from cadenza.sources.songs import load_songs, table


def songs(spark: SparkSession, d: str) -> DataFrame:
    return load_songs(spark, d)


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return load_embeddings(spark, d)


def clustered(spark: SparkSession, d: str, with_vectors: bool = False) -> DataFrame:
    v = vectors(spark, d)
    cols = ["song_id", "cluster"] + (["embedding"] if with_vectors else [])
    return songs(spark, d).join(v.select(*cols), "song_id")


def catalogue(spark: SparkSession, d: str) -> DataFrame:
    lab = table(spark, d, "labels")
    docs = table(spark, d, "documents").select("doc_id", "source")
    return lab.join(docs, "doc_id").select(
        F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("track_id"),
        F.concat(F.lit("song_"), F.col("doc_id").cast("string")).alias("title"),
        F.col("source").alias("artist"),
        F.when(
            F.col("quality") == 1,
            F.array(F.struct(F.concat(F.lit("img/"), F.col("doc_id").cast("string")).alias("url"))),
        ).otherwise(F.array().cast("array<struct<url:string>>")).alias("images"),
        F.when(F.col("toxic") == 0, F.concat(F.lit("preview/"), F.col("doc_id").cast("string"))).alias("preview_url"),
    )


def requests(spark: SparkSession, d: str) -> DataFrame:
    return requests_of(table(spark, d, "conversations"))


def requests_of(c: DataFrame) -> DataFrame:
    """Requests of a conversations table or stream."""
    return c.select(
        (F.col("conv_id") * 10 + F.col("turn")).alias("request_id"),
        F.when(F.col("role") == "user", F.lit("lyrics"))
        .when(F.col("role") == "assistant", F.lit("song"))
        .alias("mode"),
        F.col("text").alias("lyrics"),
        F.when(F.col("turn") >= 6, F.lit("")).otherwise(
            F.concat(F.lit("song_"), F.col("conv_id").cast("string"))
        ).alias("song_name"),
        F.concat(F.lit("src"), F.col("turn").cast("string")).alias("artist_name"),
    )


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


# ------------------------------------------------------------------ SQL side


def _sql_str_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _na(col: str) -> str:
    return f"CASE WHEN {col} IN ({_sql_str_list(K.NA_STRINGS)}) THEN NULL ELSE {col} END"


SQL_SONGS = f"""songs AS (
  SELECT doc_id AS song_id,
         {_na('source')} AS artist_name,
         {_na("'song_' || CAST(doc_id AS VARCHAR)")} AS song_title,
         {_na('text')} AS corpus,
         {_na("'/song/' || CAST(doc_id AS VARCHAR)")} AS song_url
  FROM documents)"""

SQL_VECTORS = """vectors AS (
  SELECT vec_id AS song_id, embedding, label AS cluster FROM embeddings)"""

SQL_CLUSTERED = """clustered AS (
  SELECT s.*, v.cluster FROM songs s JOIN vectors v USING (song_id))"""

SQL_CATALOGUE = """catalogue AS (
  SELECT 't' || CAST(l.doc_id AS VARCHAR) AS track_id,
         'song_' || CAST(l.doc_id AS VARCHAR) AS title,
         d.source AS artist,
         CASE WHEN l.quality = 1 THEN 'img/' || CAST(l.doc_id AS VARCHAR) END AS first_image,
         CASE WHEN l.toxic = 0 THEN 'preview/' || CAST(l.doc_id AS VARCHAR) END AS preview_url
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"""

SQL_REQUESTS = """requests AS (
  SELECT conv_id * 10 + turn AS request_id,
         CASE role WHEN 'user' THEN 'lyrics' WHEN 'assistant' THEN 'song' END AS mode,
         text AS lyrics,
         CASE WHEN turn >= 6 THEN '' ELSE 'song_' || CAST(conv_id AS VARCHAR) END AS song_name,
         'src' || CAST(turn AS VARCHAR) AS artist_name
  FROM conversations)"""


def with_ctes(*names: str) -> str:
    """``WITH`` clause holding the named binding CTEs, in dependency order."""
    order = ["songs", "vectors", "clustered", "catalogue", "requests"]
    deps = {"clustered": {"songs", "vectors"}}
    need = set(names)
    for n in list(need):
        need |= deps.get(n, set())
    parts = {
        "songs": SQL_SONGS, "vectors": SQL_VECTORS, "clustered": SQL_CLUSTERED,
        "catalogue": SQL_CATALOGUE, "requests": SQL_REQUESTS,
    }
    return "WITH " + ",\n".join(parts[n] for n in order if n in need)
