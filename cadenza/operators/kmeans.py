"""KMeans with restarts, stable cluster ids and pluggable estimators (MLlib).

MLlib has no ``n_init``: ``fit_best`` draws the starting centres of each seed
(``seed, seed+1, ...``) with MLlib, as concurrent jobs over one cached feature
table, then moves the centres of *all* restarts in the same passes over the
points.  A pass costs one job whatever the number of restarts; a restart that
has converged takes no further part.  The lowest training cost wins and
becomes a ``KMeansModel``.

Cluster ids out of KMeans are arbitrary; ``relabel_by_min_member`` renumbers
them 0..k-1 by each cluster's smallest ``song_id`` so reruns compare.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza import constants as K
from cadenza.operators.parallel import spread
from cadenza.operators.topk import _list_to_matrix

BLOCK_BYTES = 4 << 20
DIRECT_TASKS = 64  # whose sums go to the driver as they are


def features(points: DataFrame, vec: str = "embedding") -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return points.withColumn("features", array_to_vector(F.col(vec)))


def _centres_model(feats: DataFrame, k: int, seed: int, init_mode: str, tol: float):
    """MLlib's KMeans without a Lloyd step: its centres are those it starts from."""
    from pyspark.ml.clustering import KMeans

    return KMeans(k=k, seed=seed, maxIter=0, initMode=init_mode, tol=tol, solver="row",
                  featuresCol="features", predictionCol="cluster").fit(feats)


def _blocks(points: DataFrame, vec: str, dim: int) -> RDD:
    """The vectors as matrices of about ``BLOCK_BYTES``, of the column's own precision."""
    kind = np.dtype("f4" if isinstance(points.schema[vec].dataType.elementType, T.FloatType) else "f8")
    rows = max(1, BLOCK_BYTES // (kind.itemsize * dim))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, rows):
                x = _list_to_matrix(b.column(0).slice(at, rows), dim)
                yield pa.RecordBatch.from_arrays([pa.array([x.astype(kind).tobytes()], pa.binary())], names=["block"])

    return points.select(vec).mapInArrow(pack, "block binary").rdd.map(lambda r: np.frombuffer(r["block"], kind).reshape(-1, dim))


def _step(blocks: RDD, starts: dict[int, np.ndarray]) -> tuple[dict[int, np.ndarray], dict[int, float]]:
    """One pass for all ``starts``: the means of the points nearest to each
    centre (a centre without points stays) and the costs before the move."""
    spans, at = {}, 0
    for s, c in starts.items():
        spans[s] = slice(at, at + len(c))
        at += len(c)
    centres = np.vstack(list(starts.values()))

    def sums(xs: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
        c2 = np.einsum("ij,ij->i", centres, centres)
        out = np.zeros((len(centres), 2 + centres.shape[1]))  # cost, size, sum
        for x in xs:
            x = x.astype(np.float64, copy=False)
            d2 = c2 - 2.0 * (x @ centres.T)
            hot, x2, rows = np.zeros_like(d2), np.einsum("ij,ij->i", x, x), np.arange(len(x))
            for span in spans.values():
                nearest = span.start + d2[:, span].argmin(axis=1)
                hot[rows, nearest] = 1.0
                out[span.start, 0] += np.maximum(x2 + d2[rows, nearest], 0.0).sum()
            out[:, 1] += hot.sum(axis=0)
            out[:, 2:] += hot.T @ x
        yield out

    # a matrix from each task; those of many tasks are added up in tasks first
    total = blocks.mapPartitions(sums).treeReduce(np.add, depth=1 if blocks.getNumPartitions() <= DIRECT_TASKS else 2)
    sizes = total[:, 1:2]
    moved = {s: np.where(sizes[span] > 0, total[span, 2:] / np.maximum(sizes[span], 1.0), starts[s]) for s, span in spans.items()}
    return moved, {s: float(total[span.start, 0]) for s, span in spans.items()}


def lloyd_together(blocks: RDD, starts: list[np.ndarray], max_iter: int, tol: float) -> tuple[list[np.ndarray], list[float]]:
    """Centres and training cost of each restart.  As in MLlib a restart ends
    after ``max_iter`` steps, or when no centre moved further than ``tol``."""
    centres, costs = list(starts), [0.0] * len(starts)
    live = list(range(len(starts)))
    for _ in range(max_iter):
        moved, cost = _step(blocks, {s: centres[s] for s in live})
        far = [s for s in live if (np.square(moved[s] - centres[s]).sum(axis=1) > tol * tol).any()]
        for s in live:
            centres[s], costs[s] = moved[s], cost[s]
        live = far
        if not live:
            break
    return centres, costs


def fit_best(points: DataFrame, k: int = K.DEFAULT_CLUSTERS, n_init: int = K.KMEANS_RESTARTS,
             seed: int = K.SEED, max_iter: int = K.KMEANS_MAX_ITER, vec: str = "embedding",
             init_mode: str = "k-means||", tol: float = 1e-4, parallel: int = 10):
    """Best of ``n_init`` KMeans fits by training cost (inertia).

    Returns ``(model, cost, costs)``.  Raises ``ValueError`` when there are
    fewer points than clusters."""
    spark = points.sparkSession
    dealt = spread(points.select("song_id", vec))
    feats = features(dealt, vec).select("song_id", "features").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = feats.count()
        if n < k:
            raise ValueError(f"{n} points cannot form {k} clusters")
        seeds = [seed + i for i in range(n_init)]
        with ThreadPoolExecutor(max_workers=max(1, min(parallel, n_init))) as ex:
            starts = list(ex.map(lambda s: np.vstack(_centres_model(feats, k, s, init_mode, tol).clusterCenters()), seeds))
    finally:
        feats.unpersist()
    blocks = _blocks(dealt, vec, starts[0].shape[1]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        centres, costs = lloyd_together(blocks, starts, max_iter, tol)
    finally:
        blocks.unpersist()
    best = min(range(n_init), key=lambda i: (costs[i], i))
    # MLlib's random start over no more points than centres takes each of them
    final = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres[best])], "song_id long, centre array<double>")
    model = _centres_model(features(final, "centre"), k, seeds[best], "random", tol)
    return model, costs[best], costs


def predict(model, points: DataFrame, vec: str = "embedding", keep=("song_id",)) -> DataFrame:
    """``model.transform`` -> ``(*keep, cluster)``.  Works on streaming
    DataFrames too."""
    src = features(points.select(*keep, vec), vec)
    return model.transform(src).select(*keep, F.col("cluster").cast("int").alias("cluster"))


def relabel_by_min_member(labelled: DataFrame, id_col: str = "song_id") -> DataFrame:
    """Renumber clusters 0..k-1 in order of their smallest member id.  The
    mapping table has a row for each cluster; the planner broadcasts it when
    it is small."""
    firsts = labelled.groupBy("cluster").agg(F.min(id_col).alias("_first"))
    mapping = firsts.select(
        "cluster", (F.row_number().over(Window.orderBy("_first")) - 1).cast("int").alias("_new")
    )
    return labelled.join(mapping, "cluster").drop("cluster").withColumnRenamed("_new", "cluster")


def cluster_points(points: DataFrame, k: int = K.DEFAULT_CLUSTERS, n_init: int = K.KMEANS_RESTARTS,
                   seed: int = K.SEED, vec: str = "embedding", **kw):
    """Fit, predict, relabel: ``(song_id, cluster)`` plus the model and cost.
    One engine at every size: all restarts move in the same passes over one
    persisted table; the best one is returned as a ``KMeansModel``."""
    model, cost, costs = fit_best(points, k, n_init, seed, vec=vec, **kw)
    labelled = relabel_by_min_member(predict(model, points, vec))
    return labelled, model, cost, costs


def fit_estimator(points: DataFrame, estimator, vec: str = "embedding") -> DataFrame:
    """Any MLlib clustering estimator (``BisectingKMeans``,
    ``GaussianMixture``, ``KMeans``...) with ``featuresCol='features'``:
    fit, predict and relabel -> ``(song_id, cluster)``."""
    feats = features(points.select("song_id", vec), vec)
    est = estimator.copy()
    est.setFeaturesCol("features")
    est.setPredictionCol("cluster")
    model = est.fit(feats)
    labelled = model.transform(feats).select("song_id", F.col("cluster").cast("int").alias("cluster"))
    return relabel_by_min_member(labelled)
