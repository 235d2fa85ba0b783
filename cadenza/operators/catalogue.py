"""Track-catalogue lookups re-expressed as joins.

The application searches a music service for ``track:{title} artist:{artist}``
and takes the first hit; a miss or an error leaves the fields empty.  Here the
catalogue is a table; a search is a ``left`` equi-join on the normalised
(title, artist) pair against the catalogue deduplicated to its first entry
per pair.  The deduplication is a ``row_number() = 1`` window
(``WindowGroupLimit`` before the shuffle), so a pair repeated a million times
ships one row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza import constants as K
from cadenza.functions.scalars import first_image_url, track_url
from cadenza.functions.text import strip_ws


def norm_key(c) -> F.Column:
    """Normalised match key: lower case, surrounding whitespace removed."""
    return F.lower(strip_ws(c))


def first_hits(catalogue: DataFrame) -> DataFrame:
    """Catalogue ``(track_id, title, artist, images, preview_url)`` reduced to
    the first track (smallest ``track_id``) per normalised (title, artist)."""
    keyed = catalogue.select(
        "*", norm_key(F.col("title")).alias("_kt"), norm_key(F.col("artist")).alias("_ka")
    )
    w = Window.partitionBy("_kt", "_ka").orderBy(F.col("track_id").asc())
    return keyed.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1).drop("_r")


def lookup_tracks(requests: DataFrame, catalogue: DataFrame, title: str = "song_name",
                  artist: str = "artist_name", url_prefix: str = K.TRACK_URL_PREFIX) -> DataFrame:
    """Left-join requests to their first catalogue hit.  Adds ``found``,
    ``track_id``, ``track_url``, ``album_art`` (first image or null),
    ``preview_url``."""
    hits = first_hits(catalogue).select(
        "_kt", "_ka", "track_id",
        first_image_url(F.col("images")).alias("album_art"),
        "preview_url",
    )
    req = requests.select("*", norm_key(F.col(title)).alias("_kt"), norm_key(F.col(artist)).alias("_ka"))
    j = req.join(hits, ["_kt", "_ka"], "left")
    return j.select(
        *[F.col(c) for c in requests.columns],
        F.col("track_id").isNotNull().alias("found"),
        "track_id",
        F.when(F.col("track_id").isNotNull(), track_url(F.col("track_id"), url_prefix)).alias("track_url"),
        "album_art",
        "preview_url",
    )


def enrich_ranked(ranked: DataFrame, catalogue: DataFrame, max_rank: int = K.ENRICHED_ROWS,
                  url_prefix: str = K.TRACK_URL_PREFIX) -> DataFrame:
    """Playlist rows with catalogue fields for ``rank <= max_rank``; later
    ranks and misses keep them null.  Never drops a row."""
    head = ranked.filter(F.col("rank") <= max_rank)
    tail = ranked.filter(F.col("rank") > max_rank)
    looked = lookup_tracks(head, catalogue, url_prefix=url_prefix).drop("found", "track_id")
    nulls = [F.lit(None).cast("string").alias(c) for c in ("track_url", "album_art", "preview_url")]
    return looked.unionByName(tail.select("*", *nulls))


def first_playable(clustered: DataFrame, catalogue: DataFrame, draws: int = 3, seed: int = K.SEED) -> DataFrame:
    """Per cluster: draw ``draws`` seeded random songs; return the first one
    (in draw order) with a catalogue hit, or a miss row.  Output
    ``(cluster, status, draw, song_id, song_title, artist_name, track_id)``."""
    from cadenza.operators.clusters import random_per_cluster

    drawn = random_per_cluster(clustered, draws, seed).select(
        "cluster", "draw", "song_id", F.col("song_title").alias("song_name"), "artist_name"
    )
    looked = lookup_tracks(drawn, catalogue).filter("found")
    w = Window.partitionBy("cluster").orderBy("draw")
    best = looked.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1)
    clusters = clustered.select("cluster").distinct()
    return clusters.join(best, "cluster", "left").select(
        "cluster",
        F.when(F.col("track_id").isNotNull(), F.lit("found")).otherwise(F.lit("not_found")).alias("status"),
        F.col("draw").cast("int").alias("draw"),
        "song_id",
        F.col("song_name").alias("song_title"),
        "artist_name",
        "track_id",
    )
