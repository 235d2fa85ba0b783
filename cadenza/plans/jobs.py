"""End-to-end jobs, and registered queries over KMeans fits and streams.

theme_discovery       load -> filter -> (sample) -> encode -> best-of-n KMeans
                      -> metrics -> terms -> cards
cluster_describe_job  clean (keep case) -> encode -> KMeans -> partitioned
                      write -> per-cluster artist describe and term table

Labels of an MLlib fit are not reproducible in SQL, so the registered queries
over one report what does not depend on them: counts, violations, totals over
clusters.  Those over the seeded fit return labels, cards, terms and scores.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza import constants as K
from cadenza.functions import text as TX
from cadenza.operators import clusters as CL
from cadenza.operators import encode as EN
from cadenza.operators import kmeans as KM
from cadenza.operators import kmeans_seeded as KS
from cadenza.operators import recommend as RC
from cadenza.operators import themes as TH
from cadenza.operators import vector_index as VI
from cadenza.operators.estimator import MiniBatchKMeans, MiniBatchKMeansModel
from cadenza.operators.kmeans import relabel_by_min_member
from cadenza.operators.sample import sample_exact
from cadenza.operators.silhouette import silhouette_exact, silhouette_squared
from cadenza.plans import bindings as B
from cadenza.session import checkpoint_dir
from cadenza.sources import store
from cadenza.sources.songs import eligible_songs
from cadenza.streaming import progress as PR
from cadenza.streaming.upserts import read_upserts, start_upserts
from cadenza.streaming.reorder import rocksdb_state, session_feed_late, throttle_late


def clamp_run_params(n_samples: int = K.DEFAULT_SAMPLES, n_clusters: int = K.DEFAULT_CLUSTERS,
                     cap_samples: bool = False) -> tuple[int, int]:
    """The application's parameter clamps, for callers that want them: samples
    at least 100 (at most 5000 only with ``cap_samples``, a single-machine
    limit), clusters 2..15.  No job of this module applies them by itself."""
    n = max(K.SAMPLES_FLOOR, n_samples)
    if cap_samples:
        n = min(n, K.SAMPLES_CAP)
    return n, min(max(n_clusters, K.CLUSTERS_MIN), K.CLUSTERS_MAX)


@dataclass
class ThemeRun:
    cards: DataFrame
    terms: DataFrame
    assignments: DataFrame
    metrics: dict = field(default_factory=dict)


def _stored(df: DataFrame, name: str) -> DataFrame:
    """Written once to the shared folder, read by every later step."""
    path = _scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def theme_discovery(songs: DataFrame, n_samples: int | None = None, n_clusters: int = K.DEFAULT_CLUSTERS,
                    n_init: int = K.KMEANS_RESTARTS, seed: int = K.SEED, dim: int = EN.DEFAULT_DIM,
                    silhouette: str | None = "exact", top_terms: int | None = K.THEME_TERMS,
                    clamp: bool = False, fit=KM.cluster_points) -> ThemeRun:
    """The theme-discovery run.  Returns cards, terms, assignments and run
    metrics (with stage timings).

    ``fit`` clusters: MLlib's KMeans, or
    :func:`~cadenza.operators.kmeans_seeded.cluster_seeded`, whose labels any
    engine can recompute.

    All eligible songs take part; with ``n_samples`` an exact seeded sample of
    them.  ``silhouette`` is ``"exact"`` (O(n^2)), ``"squared"`` (O(n k)) or
    None.  ``clamp`` applies :func:`clamp_run_params`; otherwise parameters
    that cannot work raise."""
    if clamp:
        n_clusters = clamp_run_params(n_clusters=n_clusters)[1]
        n_samples = n_samples and clamp_run_params(n_samples)[0]
    if n_clusters < 2 or (n_samples is not None and n_samples < n_clusters):
        raise ValueError(f"{n_clusters} clusters of {n_samples or 'all'} songs")
    if silhouette not in ("exact", "squared", None):
        raise ValueError(f"unknown silhouette {silhouette!r}")
    timings = {}
    t0 = time.time()
    sample = eligible_songs(songs)
    if n_samples is not None:
        sample = sample_exact(sample, n_samples, seed, "song_id")
    sample = _stored(sample, "theme-songs")
    total = sample.count()
    timings["data_loading"] = time.time() - t0

    t0 = time.time()
    vecs = _stored(EN.hash_encode(sample, "song_id", "corpus", dim), "theme-vectors")
    timings["encoding"] = time.time() - t0

    t0 = time.time()
    labelled, _, cost, _ = fit(vecs, n_clusters, n_init, seed)
    labelled = _stored(labelled, "theme-labels")
    points = vecs.join(labelled, "song_id")
    metrics = {
        "total_songs": total,
        "n_clusters": n_clusters,
        "embedding_dimensions": dim,
        "model_used": "hash-bow-%d" % dim,
        "inertia": round(cost, 2),
    }
    if silhouette == "exact":
        metrics["silhouette_score"] = round(silhouette_exact(points).first()["silhouette"], 4)
    elif silhouette == "squared":
        metrics["silhouette_score"] = round(silhouette_squared(points), 4)
    timings["clustering"] = time.time() - t0

    t0 = time.time()
    clustered = sample.join(labelled, "song_id")
    terms = TH.cluster_terms(clustered, top_terms)
    best = terms.filter(F.col("rank") <= 10).groupBy("cluster").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), " ")
        .alias("top_terms")
    )
    cards = CL.cluster_cards(clustered, n_clusters, K.SAMPLE_SONGS_PER_CARD).join(
        best.withColumnRenamed("cluster", "id"), "id", "left"
    )
    timings["themes"] = time.time() - t0
    metrics["timings"] = timings
    metrics["total_time"] = sum(timings.values())
    return ThemeRun(cards=cards, terms=terms, assignments=labelled, metrics=metrics)


@dataclass
class DescribeRun:
    describe: DataFrame
    terms: DataFrame
    clustered: DataFrame


def cluster_describe_job(songs: DataFrame, out_path: str, k: int = K.DEFAULT_CLUSTERS, seed: int = K.SEED,
                         dim: int = EN.DEFAULT_DIM, n_init: int = 1,
                         top_terms: int | None = K.OFFLINE_TERMS, fit=KM.cluster_points) -> DescribeRun:
    """Offline job: drop null corpus, clean keeping case, encode, cluster,
    write the clustered table partitioned by cluster, describe artists and
    list each cluster's ``top_terms`` terms (None: all)."""
    base = _stored(songs.filter(F.col("corpus").isNotNull()).select(
        "song_id", "song_title", "artist_name", "song_url", TX.drop_stopwords_keep_case("corpus", TX.offline_stopwords()).alias("corpus_clean")
    ), "describe-songs")
    vecs = EN.hash_encode(base, "song_id", "corpus_clean", dim)
    labelled, _, _, _ = fit(_stored(vecs, "describe-vectors"), k, n_init, seed)
    clustered = base.join(labelled, "song_id")
    store.write_clustered(clustered.select("song_id", "song_title", "artist_name", "song_url",
                                           "corpus_clean", "cluster"), out_path)
    back = store.read_clustered(base.sparkSession, out_path)
    return DescribeRun(CL.describe_by_cluster(back, "artist_name"),
                       TH.cluster_terms(back, top_terms, text_col="corpus_clean"), back)


def clustering_audit(labelled: DataFrame, points: DataFrame | None = None, model=None) -> DataFrame:
    """One row about a clustering: points, labels, labels out of order of
    their smallest members and, for a KMeans ``model`` over ``points``, points
    that are not with those nearest to the same centre."""
    spark = labelled.sparkSession
    firsts = labelled.groupBy("cluster").agg(F.min("song_id").alias("first"), F.count(F.lit(1)).alias("n"))
    placed = F.row_number().over(Window.orderBy("first")) - 1  # a row for each cluster
    out = firsts.withColumn("moved", (placed != F.col("cluster")).cast("bigint")).agg(
        F.sum("n").alias("n_points"), F.count(F.lit(1)).alias("n_labels"), F.sum("moved").alias("n_out_of_order"))
    if model is None:
        return out
    centres = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(model.clusterCenters())],
                                    "cluster int, centroid array<double>")
    nearest = CL.assign_nearest(points, centres, out="nearest")
    pairs = labelled.join(nearest, "song_id").groupBy("cluster", "nearest").agg(F.count(F.lit(1)).alias("n"))
    apart = pairs.groupBy("cluster").agg((F.sum("n") - F.max("n")).alias("apart")).agg(F.sum("apart").alias("n_misplaced"))
    return out.unionByName(apart, allowMissingColumns=True).agg(
        *[F.max(c).alias(c) for c in ("n_points", "n_labels", "n_out_of_order", "n_misplaced")])


# ------------------------------------------------------------ registrations


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def q_kmeans_fit(spark, d):
    points = B.vectors(spark, d).select("song_id", "embedding")
    labelled, model, _, _ = KM.cluster_points(points, K.DEFAULT_CLUSTERS, K.KMEANS_RESTARTS, K.SEED)
    return clustering_audit(_stored(labelled, "kmeans"), points, model)


def q_cluster_pluggable(spark, d):
    from pyspark.ml.clustering import BisectingKMeans

    return clustering_audit(KM.fit_estimator(B.vectors(spark, d), BisectingKMeans(k=K.DEFAULT_CLUSTERS, seed=K.SEED)))


def q_cluster_corpus(spark, d):
    vecs = _stored(EN.hash_encode(B.songs(spark, d), "song_id", "corpus", EN.DEFAULT_DIM), "corpus-vectors")
    labelled, model, _, _ = KM.cluster_points(vecs, K.DEFAULT_CLUSTERS, 1, K.SEED)
    return clustering_audit(_stored(labelled, "corpus-labels"), vecs, model)


def q_theme_discovery(spark, d):
    run = theme_discovery(B.songs(spark, d), silhouette="squared")  # theme_metrics has the exact one
    return run.cards.agg(F.count(F.lit(1)).alias("n_cards"), F.sum("song_count").alias("total_songs"),
                         F.sum((F.col("top_terms").isNull() & (F.col("song_count") > 0)).cast("bigint")).alias("n_without_terms"))


def q_theme_metrics(spark, d):
    m = theme_discovery(B.songs(spark, d)).metrics  # the job as it is by default
    fine = m["inertia"] > 0 and -1 <= m["silhouette_score"] <= 1 and m["total_time"] >= max(m["timings"].values())
    return spark.createDataFrame(
        [(m["total_songs"], m["n_clusters"], m["embedding_dimensions"], m["model_used"], ",".join(sorted(m["timings"])), fine)],
        "total_songs bigint, n_clusters int, embedding_dimensions int, model_used string, stages string, in_range boolean")


def q_theme_terms(spark, d):
    terms = theme_discovery(B.songs(spark, d), silhouette=None, n_init=1, top_terms=None).terms
    return terms.groupBy("term").agg(F.sum("n").alias("n"))


def q_theme_assignments(spark, d):
    run = theme_discovery(B.songs(spark, d), silhouette=None, n_init=1)
    artists = eligible_songs(B.songs(spark, d)).select("song_id", "artist_name")
    return run.assignments.join(artists, "song_id").groupBy("artist_name").agg(F.count(F.lit(1)).alias("n_songs"))


def q_cluster_describe_job(spark, d):
    run = cluster_describe_job(B.songs(spark, d), _scratch(spark, "describe"))
    return run.describe.agg(F.count(F.lit(1)).alias("n_clusters"), F.sum("count").alias("n_songs"))


def q_describe_terms(spark, d):
    run = cluster_describe_job(B.songs(spark, d), _scratch(spark, "describe"), top_terms=None)
    return run.terms.groupBy("term").agg(F.sum("n").alias("n"))


def _seeded_run(spark, d, silhouette=None):
    return theme_discovery(B.songs(spark, d), n_init=1, silhouette=silhouette, fit=KS.cluster_seeded)


def q_kmeans_labels(spark, d):
    return KS.cluster_seeded(B.vectors(spark, d).select("song_id", "embedding"), n_init=1)[0].select("song_id", "cluster")


def q_cluster_minibatch(spark, d):
    # fitted, saved and loaded again
    points = B.vectors(spark, d).select("song_id", "embedding")
    path = _scratch(spark, "minibatch")
    MiniBatchKMeans(batchRows=MINIBATCH_ROWS, featuresCol="embedding").fit(points).save(path)
    return relabel_by_min_member(MiniBatchKMeansModel.load(path).transform(points)).select("song_id", "cluster")


def recommend_stream(requests: DataFrame, songs: DataFrame, index: VI.VectorIndex, path: str, k: int = K.PLAYLIST_SIZE, dim: int = EN.DEFAULT_DIM):
    """Answer a stream of requests against a stored vector index: each
    micro-batch is validated, resolved, encoded and searched, and its ranked
    songs are written to a folder of its number, so a second try replaces the
    first.  An index does not change once written: a new version has a path of
    its own, which a restarted query is given."""
    spark = requests.sparkSession

    def answer(batch: DataFrame, number: int) -> None:
        inputs = RC.request_inputs(batch, songs).filter(F.col("status") == "ok")
        found, _ = VI.search(index, EN.hash_encode(inputs, "request_id", "input_text", dim), k)
        found.write.mode("overwrite").parquet(f"{path}/ranked/batch={number}")

    spark.createDataFrame([], RANKED).write.mode("overwrite").parquet(f"{path}/ranked/batch=-1")
    return requests.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(answer).start()


ANSWERED_FILES = 16  # in a micro-batch at most: each looks through the songs and the index once
RANKED = "request_id long, song_id long, similarity double, rank int"


def q_playlist_stream(spark, d):
    songs = B.songs(spark, d)
    index = VI.build_vector_index(EN.hash_encode(songs, "song_id", "corpus", EN.DEFAULT_DIM), _scratch(spark, "vector-index"))
    path = _scratch(spark, "playlist-stream")
    recommend_stream(B.requests_of(_stream_of(spark, d, "conversations", ANSWERED_FILES)), songs, index, path).awaitTermination()
    ranked = spark.read.schema(RANKED).parquet(f"{path}/ranked")
    meta = songs.select("song_id", F.col("song_title").alias("song_name"), "artist_name")
    return ranked.join(meta, "song_id", "left").select(
        "request_id", "rank", "song_id", "song_name", "artist_name", F.round("similarity", 6).alias("similarity"))


def q_theme_labels(spark, d):
    return _seeded_run(spark, d).assignments.select("song_id", "cluster")


def q_theme_cards(spark, d):
    return _seeded_run(spark, d).cards.select("id", "song_count", "heading", "badge", "subtitle", "sample_titles", "top_terms")


def q_theme_cluster_terms(spark, d):
    return _seeded_run(spark, d).terms


def q_theme_scores(spark, d):
    m = _seeded_run(spark, d, "exact").metrics
    return spark.createDataFrame([(m["total_songs"], m["inertia"], m["silhouette_score"])], "total_songs bigint, inertia double, silhouette_score double")


def q_describe_clusters(spark, d):
    return cluster_describe_job(B.songs(spark, d), _scratch(spark, "describe"), fit=KS.cluster_seeded).describe


def q_describe_cluster_terms(spark, d):
    return cluster_describe_job(B.songs(spark, d), _scratch(spark, "describe"), fit=KS.cluster_seeded).terms


def _stream_of(spark: SparkSession, d: str, name: str, files: int = 1):
    schema = spark.read.parquet(f"{d}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{d}/{name}*.parquet")


def run_stream(df: DataFrame, name: str) -> DataFrame:
    """Run a stream over what is available and return its result, appended as
    Parquet to the shared folder."""
    path = _scratch(df.sparkSession, f"stream-{name}")
    df.writeStream.outputMode("append").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).format(
        "parquet").start(f"{path}/rows").awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/rows")


def run_upserts(df: DataFrame, name: str, key: str) -> DataFrame:
    """Run a keyed streaming aggregation over what is available and return its
    result, kept in the shared folder as the rows that changed."""
    path = _scratch(df.sparkSession, f"upserts-{name}")
    start_upserts(df, path).awaitTermination()
    return read_upserts(df.sparkSession, path, df.schema, key)


def run_late(events: DataFrame, make, name: str, lateness_seconds: int, pieces: int = 3, key: str = "user_id", ts: str = "ts",
             tie: str = "event_id") -> DataFrame:
    """What ``make(stream)`` gives when ``events`` arrive out of order: each row
    up to ``lateness_seconds`` after its time (by a hash of ``tie``), in
    ``pieces`` deliveries.  The stream is stopped and started again from its
    checkpoint between deliveries; a last row far ahead moves the watermark
    past all others and is not in the result."""
    spark = events.sparkSession
    path = _scratch(spark, f"late-{name}")
    arrival = F.unix_micros(F.col(ts).cast("timestamp")) / 1_000_000 + F.pmod(F.xxhash64(tie), F.lit(lateness_seconds))
    late = events.withColumn("arrival", arrival)
    cuts = late.agg(F.percentile_approx("arrival", [i / pieces for i in range(1, pieces)])).first()[0] or []
    piece = sum(((F.col("arrival") > c).cast("int") for c in cuts), F.lit(0))
    end = events.agg(F.max(ts).alias(ts)).select(*[
        (F.col(ts) + F.make_dt_interval(F.lit(30))).alias(ts) if c == ts else
        F.lit(-1).cast(t).alias(c) if c == key else F.lit(None).cast(t).alias(c) for c, t in events.dtypes])
    deliveries = [late.filter(piece == i).drop("arrival") for i in range(pieces)] + [end.withColumn(tie, F.lit(-1).cast("bigint"))]
    out = None
    for rows in deliveries:
        rows.write.mode("append").parquet(f"{path}/in")
        stream = make(spark.readStream.schema(events.schema).parquet(f"{path}/in"))
        with rocksdb_state(spark):
            stream.writeStream.outputMode("append").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).format(
                "parquet").start(f"{path}/out").awaitTermination()
        out = stream.schema
    return spark.read.schema(out).parquet(f"{path}/out").filter(F.col(key) != -1)


MINIBATCH_ROWS = 200  # of the test vectors, 500 and more
LATENESS_SECONDS = 2 * 86400  # of the test events, which span a month


def _event_columns(spark, d):
    return B.events(spark, d).select("user_id", "ts", "event_id", "event_type", "value")


def q_event_throttle_late(spark, d):
    out = run_late(_event_columns(spark, d), lambda s: throttle_late(s, f"{LATENESS_SECONDS} seconds"), "throttle", LATENESS_SECONDS)
    return out.select("user_id", "event_id", "event_type", "value")


def q_session_feed_late(spark, d):
    feed = lambda s: session_feed_late(s, f"{LATENESS_SECONDS} seconds", limit_seconds=86400, tombstone_seconds=366 * 86400)
    return run_late(_event_columns(spark, d), feed, "feed", LATENESS_SECONDS)


def q_event_throttle_stream(spark, d):
    ev = _stream_of(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value")
    out = run_stream(PR.throttle_stream(ev, K.THROTTLE_DELTA), "throttle")
    return out.select("user_id", "event_id", "event_type", "value")


def q_session_feed_stream(spark, d):
    ev = _stream_of(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return run_stream(PR.session_feed_stream(ev, K.THROTTLE_DELTA, 86400), "feed")


def q_latest_per_session_stream(spark, d):
    ev = _stream_of(spark, d, "events").select("user_id", "event_id", "ts", "event_type", "value")
    out = run_upserts(PR.latest_per_key_stream(ev), "latest", "user_id")
    return out.select("user_id", "event_id", "event_type", "value")


def q_assign_clusters_stream(spark, d):
    static = B.vectors(spark, d)
    cents = CL.centroids(static)
    arriving = _stream_of(spark, d, "embeddings").select(F.col("vec_id").alias("song_id"), "embedding")
    return run_stream(CL.assign_nearest(arriving, cents), "assign")


JOB_QUERIES = {
    "kmeans_fit": q_kmeans_fit,
    "cluster_pluggable": q_cluster_pluggable,
    "cluster_corpus": q_cluster_corpus,
    "theme_discovery": q_theme_discovery,
    "theme_metrics": q_theme_metrics,
    "theme_terms": q_theme_terms,
    "theme_assignments": q_theme_assignments,
    "cluster_describe_job": q_cluster_describe_job,
    "describe_terms": q_describe_terms,
    "kmeans_labels": q_kmeans_labels,
    "cluster_minibatch": q_cluster_minibatch,
    "playlist_stream": q_playlist_stream,
    "theme_labels": q_theme_labels,
    "theme_cards": q_theme_cards,
    "theme_cluster_terms": q_theme_cluster_terms,
    "theme_scores": q_theme_scores,
    "describe_clusters": q_describe_clusters,
    "describe_cluster_terms": q_describe_cluster_terms,
    "event_throttle_stream": q_event_throttle_stream,
    "event_throttle_late": q_event_throttle_late,
    "session_feed_late": q_session_feed_late,
    "assign_clusters_stream": q_assign_clusters_stream,
    "session_feed_stream": q_session_feed_stream,
    "latest_per_session_stream": q_latest_per_session_stream,
}
