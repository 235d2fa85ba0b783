""""Songs like this text": request validation, song resolution, top-k
playlist, catalogue enrichment and per-request summary, for a whole table of
requests at once.

Request schema: ``request_id bigint, mode string, lyrics string,
song_name string, artist_name string`` (missing mode means ``lyrics``; any
other value than ``lyrics`` is song mode).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza import constants as K
from cadenza.functions.text import strip_ws
from cadenza.operators.catalogue import enrich_ranked, norm_key
from cadenza.operators.encode import DEFAULT_DIM, hash_encode
from cadenza.operators.topk import topk_cosine
from cadenza.session import checkpoint_dir


REQUEST_BODY = "mode string, lyrics string, song_name string, artist_name string"


def parse_requests(bodies: DataFrame, id_col: str = "request_id", body: str = "body") -> DataFrame:
    """JSON request bodies to request columns: a missing mode is ``lyrics``,
    other missing fields are empty.  A body that is no JSON object counts as
    one without fields."""
    b = F.from_json(F.col(body), REQUEST_BODY)
    return bodies.select(
        F.col(id_col).alias("request_id"), F.coalesce(b["mode"], F.lit("lyrics")).alias("mode"),
        *[F.coalesce(b[c], F.lit("")).alias(c) for c in ("lyrics", "song_name", "artist_name")])


def form_requests(forms: DataFrame) -> DataFrame:
    """Form rows ``(request_id, user_input, song_name, artist_name)`` to
    request columns: the literal ``"None"`` as input means "no text, use the
    song fields"."""
    none = F.col("user_input") == K.NO_INPUT
    return forms.select(
        "request_id", F.when(none, F.lit("song")).otherwise(F.lit("lyrics")).alias("mode"),
        F.when(~none, F.col("user_input")).alias("lyrics"), "song_name", "artist_name")


def validate_requests(requests: DataFrame, min_chars: int = K.MIN_REQUEST_CHARS) -> DataFrame:
    """Adds ``eff_mode`` and ``status`` (``ok`` | ``too_short`` |
    ``missing_song_fields``) and an ``error`` message."""
    eff = F.when(F.coalesce(F.col("mode"), F.lit("lyrics")) == "lyrics", F.lit("lyrics")).otherwise(F.lit("song"))
    short = F.col("lyrics").isNull() | (F.length(strip_ws(F.col("lyrics"))) < min_chars)
    missing = (F.coalesce(F.col("song_name"), F.lit("")) == "") | (F.coalesce(F.col("artist_name"), F.lit("")) == "")
    status = (
        F.when(eff == "lyrics", F.when(short, F.lit("too_short")).otherwise(F.lit("ok")))
        .otherwise(F.when(missing, F.lit("missing_song_fields")).otherwise(F.lit("ok")))
    )
    error = (
        F.when(status == "too_short", F.lit(K.TOO_SHORT_MESSAGE.format(min_chars)))
        .when(status == "missing_song_fields", F.lit(K.MISSING_FIELDS_MESSAGE))
    )
    return requests.select("*", eff.alias("eff_mode"), status.alias("status"), error.alias("error"))


def resolve_song_requests(song_requests: DataFrame, songs: DataFrame) -> DataFrame:
    """Song-mode requests -> lyrics of the first song (smallest ``song_id``)
    with the same normalised (title, artist); ``not_found`` with a message
    otherwise.  Output ``(request_id, status, error, song_id, input_text)``.

    The first song per key is a partial ``min`` aggregation over keys only;
    texts are fetched by ``song_id`` for the matched requests alone, so the
    song texts are never shuffled for the lookup (the matched side is small
    and AQE broadcasts it at run time)."""
    first = songs.groupBy(
        norm_key(F.col("song_title")).alias("_kt"), norm_key(F.col("artist_name")).alias("_ka")
    ).agg(F.min("song_id").alias("song_id"))
    req = song_requests.select(
        "request_id", "song_name", "artist_name", norm_key(F.col("song_name")).alias("_kt"), norm_key(F.col("artist_name")).alias("_ka")
    )
    matched = req.join(first, ["_kt", "_ka"], "left").select("request_id", "song_id", "song_name", "artist_name")
    texts = songs.select("song_id", F.col("corpus").alias("input_text"))
    # misses have no song to join: they would all meet in the task of the null key
    hits = matched.filter(F.col("song_id").isNotNull()).join(texts, "song_id").select(
        "request_id", F.lit("ok").alias("status"), F.lit(None).cast("string").alias("error"), "song_id", "input_text")
    message = F.format_string(K.NOT_FOUND_MESSAGE, F.col("song_name"), F.col("artist_name"))
    misses = matched.filter(F.col("song_id").isNull()).select(
        "request_id", F.lit("not_found").alias("status"), message.alias("error"), "song_id",
        F.lit(None).cast("string").alias("input_text"))
    return hits.unionByName(misses)


def request_inputs(requests: DataFrame, songs: DataFrame) -> DataFrame:
    """Every request with its final ``status``, ``error`` and, when ok,
    ``input_text``."""
    v = validate_requests(requests)
    to_resolve = (F.col("eff_mode") == "song") & (F.col("status") == "ok")
    settled = v.filter(~to_resolve).select(
        "request_id", "status", "error", F.when(F.col("status") == "ok", F.col("lyrics")).alias("input_text"))
    return settled.unionByName(resolve_song_requests(v.filter(to_resolve), songs).drop("song_id"))


def playlist(queries: DataFrame, corpus: DataFrame, songs: DataFrame, k: int = K.PLAYLIST_SIZE,
             **topk_kw) -> DataFrame:
    """``(request_id, rank, song_id, song_name, artist_name, similarity)`` --
    top ``k`` corpus songs per query vector (ties by song_id)."""
    top = topk_cosine(queries, corpus, k, query_key="request_id", corpus_key="song_id", **topk_kw)
    meta = songs.select("song_id", F.col("song_title").alias("song_name"), "artist_name")
    return top.join(meta, "song_id", "left").select(
        "request_id", "rank", "song_id", "song_name", "artist_name", "similarity"
    )


def playlist_summary(ranked: DataFrame, inputs: DataFrame, dims: int, corpus_size: int,
                     model: str) -> DataFrame:
    """Per request: input length (code points), dimensions, corpus size,
    model, top and mean similarity over the returned rows (0 when none)."""
    agg = ranked.groupBy("request_id").agg(
        F.max("similarity").alias("top_similarity"), F.avg("similarity").alias("avg_similarity")
    )
    return inputs.join(agg, "request_id", "left").select(
        "request_id",
        F.length("input_text").alias("input_length"),
        F.lit(dims).alias("embedding_dimensions"),
        F.lit(corpus_size).cast("bigint").alias("corpus_size"),
        F.lit(model).alias("model"),
        F.round(F.coalesce("top_similarity", F.lit(0.0)), 6).alias("top_similarity"),
        F.round(F.coalesce("avg_similarity", F.lit(0.0)), 6).alias("avg_similarity"),
    )


def build_corpus_index(songs: DataFrame, path: str, dim: int = DEFAULT_DIM,
                       mode: str = "overwrite") -> None:
    """Encode the song corpus once and store ``(song_id, embedding)`` as
    parquet (under the shared folder), so repeated request batches score
    against stored vectors instead of re-encoding every text."""
    hash_encode(songs, "song_id", "corpus", dim).write.mode(mode).parquet(path)


def load_corpus_index(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


def recommend(requests: DataFrame, songs: DataFrame, catalogue: DataFrame, k: int = K.PLAYLIST_SIZE,
              dim: int = DEFAULT_DIM, corpus: DataFrame | None = None, model: str | None = None, **topk_kw):
    """Full recommendation job for a table of requests.  Returns
    ``(rows, summary)``: ``rows`` has one row per (ok request, rank) with
    catalogue fields for rank <= 10, plus one row per rejected/unresolved
    request (``rank`` null, ``error`` its message); ``summary`` one row per ok
    request (:func:`playlist_summary`).

    Resolved requests are written once to the shared folder and read by every
    later step; the corpus is encoded once, into an index there, unless
    ``corpus`` is a stored index."""
    spark = requests.sparkSession
    shared = checkpoint_dir(spark).rstrip("/")
    inputs_path = f"{shared}/requests-{uuid.uuid4().hex}"
    request_inputs(requests, songs).write.parquet(inputs_path)
    inputs = spark.read.parquet(inputs_path)
    if corpus is None:
        path = f"{shared}/corpus-index-{uuid.uuid4().hex}"
        build_corpus_index(songs, path, dim)
        corpus = load_corpus_index(spark, path)
    ok = inputs.filter(F.col("status") == "ok")
    qv = hash_encode(ok, "request_id", "input_text", dim)
    ranked_path = f"{shared}/ranked-{uuid.uuid4().hex}"
    playlist(qv, corpus, songs, k, **topk_kw).write.parquet(ranked_path)
    ranked = spark.read.parquet(ranked_path)
    enriched = enrich_ranked(ranked, catalogue)
    bad = inputs.filter(F.col("status") != "ok").select(
        "request_id",
        *[F.lit(None).cast(t).alias(c) for c, t in (
            ("rank", "int"), ("song_id", "bigint"), ("song_name", "string"), ("artist_name", "string"),
            ("similarity", "double"), ("track_url", "string"), ("album_art", "string"), ("preview_url", "string"))],
        "status", "error",
    )
    rows = enriched.withColumn("status", F.lit("ok")).withColumn("error", F.lit(None).cast("string")).unionByName(bad)
    return rows, playlist_summary(ranked, ok, dim, corpus.count(), model or f"hash-bow-{dim}")
