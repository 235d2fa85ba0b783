"""Operators over a clustered song table (``song_id, cluster, ...``).

Every per-cluster result is built from partial (map-side) aggregations or
``row_number() <= n`` windows that Spark plans as ``WindowGroupLimit`` before
and after the shuffle, so a cluster holding a third of all rows never has to
fit in one task's memory.  Nothing collects a whole cluster.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza import constants as K
from cadenza.functions.scalars import sample_key
from cadenza.operators.numbering import dense_number
from cadenza.operators.parallel import spread
from cadenza.functions.vectors import sq_euclidean
from cadenza.sources.embeddings import vector_dim

# A centroid table is k x d doubles.  Points are assigned against blocks of it
# of at most this many bytes, each broadcast.
MAX_CENTROID_BYTES = 64 << 20


def cluster_distribution(clustered: DataFrame) -> DataFrame:
    """``{label: count}`` as rows ``(cluster, n_songs)``."""
    return clustered.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_songs"))


def describe_by_cluster(clustered: DataFrame, col: str = "artist_name") -> DataFrame:
    """pandas ``groupby(cluster)[col].describe()`` for a string column:
    non-null count, distinct count, most frequent value (tie -> smallest),
    its frequency.  Two partial aggregations; no group is collected."""
    per_value = (
        clustered.filter(F.col(col).isNotNull())
        .groupBy("cluster", col)
        .agg(F.count(F.lit(1)).alias("freq"))
    )
    return per_value.groupBy("cluster").agg(
        F.sum("freq").alias("count"),
        F.count(F.lit(1)).alias("unique"),
        F.min_by(F.col(col), F.struct((-F.col("freq")).alias("nf"), F.col(col).alias("v"))).alias("top"),
        F.max("freq").alias("freq"),
    )


def first_n_per_cluster(clustered: DataFrame, n: int, order=None) -> DataFrame:
    """First ``n`` rows of each cluster by ``order`` (default ``song_id``),
    with ``pos`` 1..n."""
    order = order if order is not None else [F.col("song_id").asc()]
    w = Window.partitionBy("cluster").orderBy(*order)
    return clustered.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= n)


def songs_in_order(clustered: DataFrame) -> DataFrame:
    """Every song with ``pos``, its place (from 1) in its cluster by
    ``song_id``; missing title and artist become ``Unknown``, a missing url is
    empty.  Long form: no cluster is collected or sorted in one task
    (:func:`~cadenza.operators.numbering.dense_number`)."""
    named = clustered.select(
        "cluster", "song_id", F.coalesce("song_title", F.lit(K.UNKNOWN_NAME)).alias("song_title"),
        F.coalesce("artist_name", F.lit(K.UNKNOWN_NAME)).alias("artist_name"), F.coalesce("song_url", F.lit("")).alias("song_url"))
    return dense_number(named, ["song_id"], ["cluster"], "pos", 1).select("cluster", "pos", "song_id", "song_title", "artist_name", "song_url")


def random_per_cluster(clustered: DataFrame, n: int, seed: int, id_col: str = "song_id") -> DataFrame:
    """``n`` seeded random rows per cluster (all rows when fewer), ``draw``
    1..n.  Order is md5 of ``seed:id`` then id -- independent of partitioning."""
    w = Window.partitionBy("cluster").orderBy(sample_key(id_col, seed), F.col(id_col))
    return clustered.withColumn("draw", F.row_number().over(w)).filter(F.col("draw") <= n)


def cluster_cards(clustered: DataFrame, n_clusters: int, samples: int = 5) -> DataFrame:
    """One card per cluster id 0..n_clusters-1, empty clusters included:
    ``id, song_count, heading, badge, subtitle, sample_titles``."""
    spark = clustered.sparkSession
    counts = cluster_distribution(clustered)
    firsts = (
        first_n_per_cluster(clustered, samples)
        .groupBy("cluster")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "song_title"))).alias("s"))  # <= samples per group
        .select("cluster", F.transform("s", lambda x: x["song_title"]).alias("titles"))
    )
    ids = spark.range(n_clusters).select(F.col("id").cast("int").alias("cluster"))
    return (
        ids.join(counts, "cluster", "left")
        .join(firsts, "cluster", "left")
        .select(
            F.col("cluster").alias("id"),
            F.coalesce("n_songs", F.lit(0)).cast("bigint").alias("song_count"),
            F.concat(F.lit("Vibe "), (F.col("cluster") + 1).cast("string")).alias("heading"),
            F.concat(F.coalesce("n_songs", F.lit(0)).cast("string"), F.lit(" songs")).alias("badge"),
            F.concat(
                F.array_join(F.slice(F.coalesce("titles", F.array().cast("array<string>")), 1, 2), ", "),
                F.lit("..."),
            ).alias("subtitle"),
            F.array_join(F.coalesce("titles", F.array().cast("array<string>")), " | ").alias("sample_titles"),
        )
    )


# ---------------------------------------------------------------- centroids


def centroids(points: DataFrame, vec: str = "embedding", label: str = "cluster") -> DataFrame:
    """Per-label mean vector ``(cluster, centroid array<double>, n bigint)``.

    Uses MLlib's ``Summarizer`` -- a JVM aggregate with map-side partial
    sums -- so a large cluster is summed in parallel and never collected."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    return (
        points.select(F.col(label).alias("cluster"), array_to_vector(F.col(vec)).alias("_v"))
        .groupBy("cluster")
        .agg(Summarizer.mean(F.col("_v")).alias("_m"), F.count(F.lit(1)).alias("n"))
        .select("cluster", vector_to_array("_m").alias("centroid"), "n")
    )


def centroid_blocks(cents: DataFrame, max_bytes: int = MAX_CENTROID_BYTES):
    """A centroid table as ``(ids, matrix)`` blocks of at most ``max_bytes``,
    ids ascending over all blocks.  Raises without centroids, on null ones and
    on mixed dimensions."""
    n, dim = vector_dim(cents, "centroid")
    if not n:
        raise ValueError("no centroids")
    rows = max(1, max_bytes // (8 * dim))
    ids, vectors = [], []
    for r in cents.select("cluster", "centroid").orderBy("cluster").toLocalIterator():
        ids.append(r["cluster"])
        vectors.append(np.asarray(r["centroid"], dtype=np.float64))
        if len(ids) == rows:
            yield np.array(ids), np.stack(vectors)
            ids, vectors = [], []
    if ids:
        yield np.array(ids), np.stack(vectors)


def assign_nearest(points: DataFrame, cents: DataFrame, vec: str = "embedding",
                   out: str = "cluster", keep=("song_id",), max_bytes: int = MAX_CENTROID_BYTES) -> DataFrame:
    """Label each point with its nearest centroid (Euclidean; a tie goes to
    the lowest id).  Centroids are broadcast in blocks of bounded bytes and
    points are scored in place by ``mapInArrow``, no shuffle; a point carries
    its best label and distance from one block to the next.  Works on
    streaming DataFrames too."""
    spark = points.sparkSession
    src = spread(points.select(*keep, F.col(vec).alias("_vec"), F.lit(None).cast("int").alias("_label"),
                               F.lit(float("inf")).alias("_d2")))
    fields = src.schema.names

    def scored(src: DataFrame, ids, mat) -> DataFrame:
        bc = spark.sparkContext.broadcast((ids, mat))

        def assign(batches):
            cid, cm = bc.value
            c2 = np.einsum("ij,ij->i", cm, cm)
            for b in batches:
                if b.num_rows == 0:
                    continue
                x = b.column("_vec").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, cm.shape[1])
                d2 = (np.einsum("ij,ij->i", x, x)[:, None] + c2[None, :]) - 2.0 * (x @ cm.T)
                at = np.argmin(d2, axis=1)
                best, before = d2[np.arange(len(x)), at], b.column("_d2").to_numpy(zero_copy_only=False)
                closer = best < before
                label = b.column("_label").to_pandas().fillna(0).to_numpy(dtype=np.int32)
                made = {"_label": pa.array(np.where(closer, cid[at], label).astype(np.int32), pa.int32()),
                        "_d2": pa.array(np.where(closer, best, before), pa.float64())}
                yield pa.RecordBatch.from_arrays([made.get(f, b.column(f)) for f in fields], names=fields)

        return src.mapInArrow(assign, src.schema)

    for ids, mat in centroid_blocks(cents, max_bytes):
        src = scored(src, ids, mat)
    return src.select(*keep, F.col("_label").alias(out))


def inertia(points: DataFrame, cents: DataFrame, vec: str = "embedding") -> DataFrame:
    """Sum of squared distances of each point to its own cluster's centroid
    (``inertia`` rounded to 2 like the application, ``inertia_exact`` to 6).
    The centroid side has a row for each cluster; the planner broadcasts it
    when it is small."""
    total = points.join(cents.select("cluster", "centroid"), "cluster").agg(F.sum(sq_euclidean(vec, "centroid")).alias("s"))
    return total.select(F.round("s", 2).alias("inertia"), F.round("s", 6).alias("inertia_exact"))


def lloyd_step(points: DataFrame, cents: DataFrame, vec: str = "embedding") -> DataFrame:
    """One Lloyd iteration: reassign to the nearest centroid, recompute means.
    Returns the new centroid table."""
    assigned = assign_nearest(points, cents, vec=vec, out="cluster", keep=("song_id", vec))
    return centroids(assigned, vec=vec, label="cluster")


def centroid_long(cents: DataFrame) -> DataFrame:
    """``(cluster, dim, value)`` long form of a centroid table."""
    return cents.select("cluster", F.posexplode("centroid").alias("dim", "value")).select(
        "cluster", F.col("dim").cast("int").alias("dim"), F.round("value", 6).alias("value")
    )
