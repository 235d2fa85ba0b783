"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per
operator of the inventory.  Every query reads the test tables (through the
bindings in :mod:`cadenza.plans.bindings`) in full.

Output conventions shared with the SQL oracle (:mod:`cadenza.plans.oracle`):
integers are ``bigint`` unless the source column is ``int`` (cluster ids,
ranks, dims), doubles are rounded to 6 decimals, timestamps are exported as
epoch microseconds, and arrays are flattened to long form or joined strings.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza import constants as K
from cadenza.functions import text as TX
from cadenza.functions.scalars import cluster_id_from_name, epoch_micros, first_image_url, track_query
from cadenza.functions.vectors import cosine, euclidean
from cadenza.operators import catalogue as CAT
from cadenza.operators import clusters as CL
from cadenza.operators import encode as EN
from cadenza.operators import heavy_hitters as HH
from cadenza.operators import recommend as RC
from cadenza.operators import song_search as SS
from cadenza.operators import themes as TH
from cadenza.operators import vector_index as VI
from cadenza.operators.numbering import dense_number
from cadenza.operators.parallel import spread
from cadenza.operators.sample import bottom_k, merge_bottom_k, sample_exact
from cadenza.operators.silhouette import silhouette_exact, silhouette_squared
from cadenza.operators.topk import topk_cosine
from cadenza.plans import bindings as B
from cadenza.session import checkpoint_dir
from cadenza.sources import store
from cadenza.sources.embeddings import embedding_profile
from cadenza.sources.songs import eligible_songs, read_songs_csv, table, write_songs_csv
from cadenza.streaming import progress as PR

CARD_CLUSTERS = 12          # requested cluster count for cards / lookups (labels are 0..9)
ENCODE_DIM = EN.DEFAULT_DIM
MODEL_NAME = "hash-bow-64"  # the built-in encoder's registry name


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


# ------------------------------------------------------------ sources, filters


def q_load_songs(spark, d):
    return B.songs(spark, d)


def q_load_songs_csv(spark, d):
    path = _scratch(spark, "songs-csv")
    write_songs_csv(B.songs(spark, d), path)
    return read_songs_csv(spark, path, id_col="song_id")


def q_eligible_songs(spark, d):
    return eligible_songs(B.songs(spark, d)).select(
        "song_id", "song_title", "artist_name", F.length("corpus").cast("bigint").alias("n_chars")
    )


def q_sample_songs(spark, d):
    s = eligible_songs(B.songs(spark, d)).select("song_id", "song_title", "artist_name")
    return sample_exact(s, K.DEFAULT_SAMPLES, K.SEED, "song_id")


def q_load_embeddings(spark, d):
    return embedding_profile(B.vectors(spark, d))


def q_join_embeddings(spark, d):
    v = B.vectors(spark, d).select("song_id", "cluster", F.size("embedding").cast("int").alias("dim"))
    s = B.songs(spark, d).select("song_id", "song_title", "artist_name")
    return v.join(s, "song_id")


def _clustered_light(spark, d):
    return B.clustered(spark, d).select("song_id", "song_title", "artist_name", "song_url", "cluster")


def q_scan_clustered(spark, d):
    path = _scratch(spark, "clustered")
    store.write_clustered(_clustered_light(spark, d), path)
    return store.read_clustered(spark, path, cluster=3).select("song_id", "song_title", "artist_name", "song_url")


def q_sink_roundtrip(spark, d):
    path = _scratch(spark, "roundtrip")
    store.write_clustered(_clustered_light(spark, d), path)
    back = store.read_clustered(spark, path)
    return back.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("song_id").cast("bigint").alias("sum_id"),
        F.min("song_title").alias("min_title"),
    )


def q_run_summary(spark, d):
    songs = B.songs(spark, d).agg(F.count(F.lit(1)).alias("total_songs"))
    vec = B.vectors(spark, d).agg(
        F.count(F.lit(1)).alias("corpus_size"),
        F.max(F.size("embedding")).cast("int").alias("embedding_dimensions"),
        F.count_distinct("cluster").alias("n_clusters"),
    )
    # two one-row aggregates stacked and folded (no join needed)
    return songs.unionByName(vec, allowMissingColumns=True).agg(
        F.max("total_songs").alias("total_songs"),
        F.max("corpus_size").alias("corpus_size"),
        F.max("embedding_dimensions").alias("embedding_dimensions"),
        F.max("n_clusters").alias("n_clusters"),
    )


def _with_centroid(spark, d):
    # a centroid row for each cluster; the planner broadcasts them when small
    v = B.vectors(spark, d)
    return v.join(CL.centroids(v).select("cluster", "centroid"), "cluster")


def q_cosine_scores(spark, d):
    j = _with_centroid(spark, d)
    return j.select("song_id", "cluster", F.round(cosine("embedding", "centroid"), 6).alias("cosine"))


def q_pairwise_euclidean(spark, d):
    j = _with_centroid(spark, d)
    return j.select("song_id", "cluster", F.round(euclidean("embedding", "centroid"), 6).alias("distance"))


def _file_names(spark, d):
    e = B.events(spark, d)
    k = F.get_json_object("props", "$.k")
    name = (
        F.when(F.col("event_type") == "view", F.concat(F.lit("demo_cluster_"), k, F.lit(".png")))
        .when(F.col("event_type") == "click", F.concat(F.lit("cluster_"), k, F.lit(".png")))
        .when(F.col("event_type") == "error", F.lit("x.png"))
        .otherwise(F.concat(F.col("event_type"), F.lit("_cluster"), k, F.lit(".jpg")))
    )
    return e.select("event_id", name.alias("file_name"))


def q_parse_cluster_id(spark, d):
    return _file_names(spark, d).select("event_id", "file_name", cluster_id_from_name("file_name").alias("cluster_id"))


def q_first_image(spark, d):
    return B.catalogue(spark, d).select("track_id", first_image_url("images").alias("album_art"))


def q_parse_json_props(spark, d):
    e = B.events(spark, d)
    return e.select("event_id", F.from_json("props", "k bigint").getField("k").alias("k"))


# ------------------------------------------------------------------- text


def q_clean_tokens(spark, d):
    s = spread(B.songs(spark, d))
    toks = TX.split_ws(F.lower("corpus"))
    kept = TX.theme_tokens(F.col("corpus"))
    return s.select(
        "song_id",
        F.size(toks).cast("bigint").alias("n_tokens"),
        F.size(kept).cast("bigint").alias("n_kept"),
        F.array_join(kept, " ").alias("clean_text"),
    )


def q_clean_corpus(spark, d):
    s = spread(B.songs(spark, d).filter(F.col("corpus").isNotNull()))
    return s.select("song_id", TX.drop_stopwords_keep_case("corpus", TX.offline_stopwords()).alias("corpus_clean"))


def q_stopword_union(spark, d):
    words = TX.offline_stopwords()
    toks = spread(B.songs(spark, d)).select(F.explode(TX.split_ws(F.lower("corpus"))).alias("word"))
    return toks.filter(F.col("word").isin(words)).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def q_sample_merged(spark, d):
    # a stored sketch for each artist, merged: the sample of q_sample_songs
    path = _scratch(spark, "sketches")
    bottom_k(eligible_songs(B.songs(spark, d)).select("song_id", "artist_name"), K.DEFAULT_SAMPLES, K.SEED, part=["artist_name"]).write.parquet(path)
    return merge_bottom_k(spark.read.parquet(path), K.DEFAULT_SAMPLES).select("song_id")


def q_song_numbers(spark, d):
    return dense_number(eligible_songs(B.songs(spark, d)).select("song_id", "song_title"), ["song_id"])


def q_song_search(spark, d):
    # free texts as people type them: other case, a letter left out, spaces
    text = F.concat_ws("  ", F.upper(F.regexp_replace("song_name", "song_", "sng ")), "artist_name")
    asked = B.requests(spark, d).select("request_id", text.alias("text"))
    return SS.search_songs(asked, B.catalogue(spark, d)).select("request_id", "found", "track_id", F.round("similarity", 6).alias("similarity"))


def q_cluster_terms_sketched(spark, d):
    return HH.top_terms(B.clustered(spark, d), K.THEME_TERMS)[0]


def q_cluster_terms(spark, d):
    return TH.cluster_terms(B.clustered(spark, d), K.THEME_TERMS)


def q_cluster_bigrams(spark, d):
    return TH.cluster_bigrams(B.clustered(spark, d), K.THEME_TERMS)


def q_term_counts_antijoin(spark, d):
    stop = spark.createDataFrame([(w,) for w in K.theme_stopwords()], "word string")
    return TH.term_counts_antijoin(B.songs(spark, d), stop)


# ------------------------------------------------------ given-label analytics


def q_cluster_distribution(spark, d):
    return CL.cluster_distribution(B.clustered(spark, d))


def q_cluster_artist_describe(spark, d):
    return CL.describe_by_cluster(B.clustered(spark, d), "artist_name")


def q_songs_by_cluster(spark, d):
    return CL.songs_in_order(B.clustered(spark, d))


def q_cluster_samples(spark, d):
    return CL.first_n_per_cluster(B.clustered(spark, d), K.SAMPLE_SONGS_PER_CARD).select(
        "cluster", F.col("pos").cast("int").alias("pos"), "song_id", "song_title"
    )


def q_cluster_cards(spark, d):
    return CL.cluster_cards(B.clustered(spark, d), CARD_CLUSTERS, K.SAMPLE_SONGS_PER_CARD)


def q_cluster_songs(spark, d):
    return _clustered_light(spark, d).filter(F.col("cluster") == 3).drop("cluster")


def q_cluster_lookup(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("song_id"), F.col("lang").alias("run_id"))
    stored = docs.join(B.vectors(spark, d).select("song_id", "cluster"), "song_id")
    runs = stored.select("run_id").distinct()
    sizes = stored.groupBy("run_id", "cluster").agg(F.count(F.lit(1)).alias("n_songs"))
    ev = B.events(spark, d)
    req = ev.select(
        "event_id",
        F.when(F.col("event_type") == "view", "en").when(F.col("event_type") == "click", "fr")
        .when(F.col("event_type") == "signup", "de").when(F.col("event_type") == "error", "es")
        .otherwise("none").alias("session_id"),
        F.floor(F.col("value") / 25).cast("int").alias("cluster_id"),
    )
    # few (session, cluster) pairs are asked for, each many times: answer the
    # pairs, then hand the small answer to the requests
    j = (
        req.select("session_id", "cluster_id").distinct()
        .join(runs.select(F.col("run_id").alias("session_id"), F.lit(True).alias("_run")), "session_id", "left")
        .join(sizes.select(F.col("run_id").alias("session_id"), F.col("cluster").alias("cluster_id"), "n_songs"),
              ["session_id", "cluster_id"], "left")
    )
    status = (
        F.when(F.col("_run").isNull(), F.lit("session_not_found"))
        .when((F.col("cluster_id") < 0) | (F.col("cluster_id") >= CARD_CLUSTERS), F.lit("cluster_not_found"))
        .when(F.col("n_songs").isNull(), F.lit("empty_cluster"))
        .otherwise(F.lit("ok"))
    )
    answers = j.select("session_id", F.col("cluster_id").alias("asked"), status.alias("status"),
                       F.coalesce("n_songs", F.lit(0)).cast("bigint").alias("n_songs"))
    return req.join(answers.withColumnRenamed("session_id", "of"), (F.col("session_id") == F.col("of"))
                    & F.col("cluster_id").eqNullSafe(F.col("asked"))).select(
        "event_id", "session_id", "cluster_id", "status", "n_songs")


def q_random_song_per_cluster(spark, d):
    return CL.random_per_cluster(B.clustered(spark, d), 1, K.SEED).select(
        "cluster", "song_id", "song_title", "artist_name"
    )


def q_first_playable(spark, d):
    return CAT.first_playable(B.clustered(spark, d), B.catalogue(spark, d), 3, K.SEED)


def q_inertia(spark, d):
    v = B.vectors(spark, d)
    return CL.inertia(v, CL.centroids(v))


def q_silhouette(spark, d):
    return silhouette_exact(B.vectors(spark, d))


def q_silhouette_squared(spark, d):
    v = B.vectors(spark, d)
    score = silhouette_squared(v)
    return v.agg(F.count(F.lit(1)).alias("n_points")).select(
        "n_points", F.round(F.lit(score), 6).alias("silhouette")
    )


def q_assign_clusters(spark, d):
    v = B.vectors(spark, d)
    return CL.assign_nearest(v, CL.centroids(v))


def q_kmeans_lloyd_step(spark, d):
    v = B.vectors(spark, d)
    return CL.centroid_long(CL.lloyd_step(v, CL.centroids(v)))


# -------------------------------------------------------------- encoding


def q_encode_hash(spark, d):
    return EN.hash_encode_long(B.songs(spark, d), "song_id", "corpus", ENCODE_DIM).select(
        "song_id", "dim", F.round("weight", 6).alias("weight")
    )


def q_encode_tfidf(spark, d):
    return EN.tfidf_encode(B.songs(spark, d), "song_id", "corpus").select(
        "song_id", "dim", F.round("weight", 6).alias("weight"))


def _song_vectors(spark, d):
    return EN.hash_encode(B.songs(spark, d), "song_id", "corpus", ENCODE_DIM)


def q_recommend_text(spark, d):
    req = B.requests(spark, d).filter(F.col("mode") == "lyrics")
    qv = EN.hash_encode(req, "request_id", "lyrics", ENCODE_DIM)
    top = topk_cosine(qv, _song_vectors(spark, d), K.PLAYLIST_SIZE)
    return top.select("request_id", "rank", "song_id", F.round("similarity", 6).alias("similarity"))


def _ok_inputs(spark, d):
    return RC.request_inputs(B.requests(spark, d), B.songs(spark, d)).filter(F.col("status") == "ok")


def _ranked(spark, d):
    qv = EN.hash_encode(_ok_inputs(spark, d), "request_id", "input_text", ENCODE_DIM)
    return RC.playlist(qv, _song_vectors(spark, d), B.songs(spark, d), K.PLAYLIST_SIZE)


def q_validate_requests(spark, d):
    return RC.validate_requests(B.requests(spark, d)).select("request_id", "eff_mode", "status", "error")


def q_resolve_song_requests(spark, d):
    v = RC.validate_requests(B.requests(spark, d))
    ok_song = v.filter((F.col("eff_mode") == "song") & (F.col("status") == "ok"))
    return RC.resolve_song_requests(ok_song, B.songs(spark, d)).select("request_id", "status", "error", "song_id")


def q_parse_requests(spark, d):
    r = B.requests(spark, d)
    bodies = r.select("request_id", F.to_json(F.struct("mode", "lyrics", "song_name", "artist_name")).alias("body"))
    v = RC.validate_requests(RC.parse_requests(bodies))
    return v.select("request_id", "mode", F.md5("lyrics").alias("lyrics_md5"), "song_name", "artist_name", "eff_mode", "status")


def q_form_requests(spark, d):
    r = B.requests(spark, d)
    # assistant turns come without a text, as the form sends them
    forms = r.select("request_id", F.when(F.col("mode") == "song", K.NO_INPUT).otherwise(F.col("lyrics")).alias("user_input"),
                     "song_name", "artist_name")
    return RC.request_inputs(RC.form_requests(forms), B.songs(spark, d)).select(
        "request_id", "status", "error", F.length("input_text").cast("bigint").alias("n_chars"))


def q_playlist_top20(spark, d):
    v = B.vectors(spark, d)
    q = v.filter(F.col("song_id") == 0).select(F.col("song_id").alias("request_id"), "embedding")
    top = topk_cosine(q, v, K.PLAYLIST_SIZE)
    meta = B.songs(spark, d).select("song_id", F.col("song_title").alias("song_name"), "artist_name")
    return top.join(meta, "song_id", "left").select(
        "rank", "song_id", "song_name", "artist_name", F.round("similarity", 6).alias("similarity")
    )


def q_playlist_topk(spark, d):
    return _ranked(spark, d).withColumn("similarity", F.round("similarity", 6))


def q_playlist_indexed(spark, d):
    # the playlists of q_playlist_topk through the stored inverted file
    index = VI.build_vector_index(_song_vectors(spark, d), _scratch(spark, "vector-index"))
    qv = EN.hash_encode(_ok_inputs(spark, d), "request_id", "input_text", ENCODE_DIM)
    top, _ = VI.search(index, qv, K.PLAYLIST_SIZE)
    meta = B.songs(spark, d).select("song_id", F.col("song_title").alias("song_name"), "artist_name")
    return top.join(meta, "song_id", "left").select(
        "request_id", "rank", "song_id", "song_name", "artist_name", F.round("similarity", 6).alias("similarity"))


def q_enrich_topk(spark, d):
    path = _scratch(spark, "ranked")  # ranked once: looked up in part, passed on in part
    _ranked(spark, d).write.parquet(path)
    e = CAT.enrich_ranked(spark.read.parquet(path), B.catalogue(spark, d))
    return e.select("request_id", "rank", "song_id", "track_url", "album_art", "preview_url")


def q_playlist_summary(spark, d):
    inputs = _ok_inputs(spark, d)
    corpus_size = B.songs(spark, d).count()
    return RC.playlist_summary(_ranked(spark, d), inputs, ENCODE_DIM, corpus_size, MODEL_NAME)


def q_track_lookup(spark, d):
    s = B.songs(spark, d).select("song_id", F.col("song_title").alias("song_name"), "artist_name")
    return CAT.lookup_tracks(s, B.catalogue(spark, d)).select(
        "song_id", track_query(F.col("song_name"), F.col("artist_name")).alias("search_key"),
        "found", "track_id", "track_url", "album_art", "preview_url",
    )


def _recommended(rows):
    return rows.select(
        "request_id", "status", "error", "rank", "song_id", "song_name", "artist_name",
        F.round("similarity", 6).alias("similarity"), "track_url", "album_art", "preview_url",
    )


def q_recommend_requests(spark, d):
    rows, _ = RC.recommend(B.requests(spark, d), B.songs(spark, d), B.catalogue(spark, d),
                           K.PLAYLIST_SIZE, ENCODE_DIM)
    return _recommended(rows)


def q_recommend_indexed(spark, d):
    # the summary of requests scored against a stored index
    path = _scratch(spark, "index")
    RC.build_corpus_index(B.songs(spark, d), path, ENCODE_DIM)
    _, summary = RC.recommend(B.requests(spark, d), B.songs(spark, d), B.catalogue(spark, d), K.PLAYLIST_SIZE,
                              ENCODE_DIM, corpus=RC.load_corpus_index(spark, path), model=MODEL_NAME)
    return summary


# -------------------------------------------------------- progress events


def q_latest_per_session(spark, d):
    e = B.events(spark, d).select("user_id", "event_id", "ts", "event_type", "value")
    return PR.latest_per_key(e).select(
        "user_id", "event_id", epoch_micros("ts").alias("ts_us"), "event_type", "value"
    )


def q_session_status(spark, d):
    req = table(spark, d, "customer").select(F.col("c_custkey").cast("bigint").alias("session_id"))
    return PR.session_status(req, B.events(spark, d))


def q_session_timeout(spark, d):
    t = PR.session_timeout(B.events(spark, d))
    return t.select(
        "user_id", epoch_micros("first_ts").alias("first_us"),
        epoch_micros("terminal_ts").alias("terminal_us"), "status",
    )


def q_stage_timings(spark, d):
    return PR.stage_timings(B.events(spark, d))


def _throttled(spark, d, delta):
    e = B.events(spark, d).select("user_id", "ts", "event_id", "event_type", "value")
    return PR.throttle(e, delta).select("user_id", "event_id", "event_type", "value")


def q_event_throttle(spark, d):
    return _throttled(spark, d, K.THROTTLE_DELTA)


def q_event_throttle_wide(spark, d):
    return _throttled(spark, d, 100.0)


def q_event_throttle_one_run(spark, d):
    # all events as one session in one step: a single run over all partitions
    e = B.events(spark, d).select("ts", "event_id", "value").withColumns({"user_id": F.lit(0).cast("bigint"), "event_type": F.lit("all")})
    return PR.throttle(e, K.THROTTLE_DELTA).select("event_id", "value")


def q_session_feed(spark, d):
    e = B.events(spark, d).select("user_id", "ts", "event_id", "event_type", "value")
    return PR.session_feed(e, K.THROTTLE_DELTA, K.STREAM_TIMEOUT_SECONDS)


def q_session_feed_day(spark, d):
    # the same feed with a one-day limit: sessions in the test data are sparse,
    # so this variant exercises long throttled runs and completions
    e = B.events(spark, d).select("user_id", "ts", "event_id", "event_type", "value")
    return PR.session_feed(e, K.THROTTLE_DELTA, 86400)


def q_progress_json(spark, d):
    return PR.feed_payloads(q_session_feed_day(spark, d))


QUERIES = {
    "load_songs": q_load_songs,
    "load_songs_csv": q_load_songs_csv,
    "eligible_songs": q_eligible_songs,
    "sample_songs": q_sample_songs,
    "sample_merged": q_sample_merged,
    "song_numbers": q_song_numbers,
    "song_search": q_song_search,
    "cluster_terms_sketched": q_cluster_terms_sketched,
    "load_embeddings": q_load_embeddings,
    "join_embeddings": q_join_embeddings,
    "scan_clustered": q_scan_clustered,
    "sink_roundtrip": q_sink_roundtrip,
    "run_summary": q_run_summary,
    "cosine_scores": q_cosine_scores,
    "pairwise_euclidean": q_pairwise_euclidean,
    "parse_cluster_id": q_parse_cluster_id,
    "first_image": q_first_image,
    "parse_json_props": q_parse_json_props,
    "clean_tokens": q_clean_tokens,
    "clean_corpus": q_clean_corpus,
    "stopword_union": q_stopword_union,
    "cluster_terms": q_cluster_terms,
    "cluster_bigrams": q_cluster_bigrams,
    "term_counts_antijoin": q_term_counts_antijoin,
    "cluster_distribution": q_cluster_distribution,
    "cluster_artist_describe": q_cluster_artist_describe,
    "songs_by_cluster": q_songs_by_cluster,
    "cluster_samples": q_cluster_samples,
    "cluster_cards": q_cluster_cards,
    "cluster_songs": q_cluster_songs,
    "cluster_lookup": q_cluster_lookup,
    "random_song_per_cluster": q_random_song_per_cluster,
    "first_playable": q_first_playable,
    "inertia": q_inertia,
    "silhouette": q_silhouette,
    "silhouette_squared": q_silhouette_squared,
    "assign_clusters": q_assign_clusters,
    "kmeans_lloyd_step": q_kmeans_lloyd_step,
    "encode_hash": q_encode_hash,
    "encode_tfidf": q_encode_tfidf,
    "recommend_text": q_recommend_text,
    "validate_requests": q_validate_requests,
    "parse_requests": q_parse_requests,
    "form_requests": q_form_requests,
    "recommend_indexed": q_recommend_indexed,
    "resolve_song_requests": q_resolve_song_requests,
    "playlist_top20": q_playlist_top20,
    "playlist_topk": q_playlist_topk,
    "playlist_indexed": q_playlist_indexed,
    "enrich_topk": q_enrich_topk,
    "playlist_summary": q_playlist_summary,
    "track_lookup": q_track_lookup,
    "recommend_requests": q_recommend_requests,
    "latest_per_session": q_latest_per_session,
    "session_status": q_session_status,
    "session_timeout": q_session_timeout,
    "stage_timings": q_stage_timings,
    "event_throttle": q_event_throttle,
    "event_throttle_wide": q_event_throttle_wide,
    "event_throttle_one_run": q_event_throttle_one_run,
    "session_feed": q_session_feed,
    "session_feed_day": q_session_feed_day,
    "progress_json": q_progress_json,
}
