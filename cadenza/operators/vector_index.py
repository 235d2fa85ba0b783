"""Exact top-k cosine over a stored inverted file, with triangle bounds.

The corpus is stored by cell (nearest of the index's centroids), inside a cell
by distance from the centroid, in blocks of at most ``block_rows``.  A block
knows its cell and its least and largest distance from the centroid, so for a
query at distance D from the centroid no member is nearer than

    max(D - largest, least - D, 0)

Unit vectors at Euclidean distance d have cosine 1 - d*d/2, so this bounds the
similarity from above.  A search has two rounds.  The first scores, for each
query, the nearest cells that hold at least ``first_rows`` rows: the k-th best
of these is a threshold.  The second scores the blocks whose bound reaches the
threshold and that the first left out; all others are skipped, which is exact,
ties included.  Cells that no query needs are not read (partition pruning).
Where bounds do not help, the second round is a scan of the whole index.

A task decides for itself which queries need a block, from the broadcast
queries and centroids; there is no table of (query, block) pairs.  Corpus and
queries are stored before the passes over them, so neither is encoded again.
Blocks are scored in single precision against the threshold, and what reaches
it exactly, as :mod:`~cadenza.operators.topk` does; a task of the second round
returns only rows that reach the threshold.  Rows are cut into blocks where they lie after a range partitioning, so a cell
with a third of the corpus is many tasks and many blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.operators.sample import sample_exact
from cadenza.operators.topk import MAX_BROADCAST_BYTES, RunningTopK, _list_to_matrix, _unit_rows, _written, first_copies
from cadenza.sources.embeddings import vector_dim

FIT_ROWS = 20_000  # vectors that the centroids are fitted to
FIT_ROUNDS = 8
MAX_CELLS = 4096
BLOCK_ROWS = 2048
MAX_BLOCKS = 1 << 18  # rows of the block table; blocks grow beyond
SLACK = 1e-7  # above the rounding of distances, far below what matters
ROUNDED = 4e-12  # of squared distances, by the rounding of similarities
TILE_QUERIES = 1024  # whose distances to all centroids are held at once
FOUND = "qkey long, ckey long, similarity double"
ROWS = "cell int, block long, ckey long, dist double, cvec array<double>"


def _fit_centroids(x: np.ndarray, cells: int, seed: int) -> np.ndarray:
    """A few rounds of k-means over a bounded sample; any centroids give exact
    results, good ones skip more."""
    draw = np.random.default_rng(seed)
    centres = x[draw.permutation(len(x))[:cells]]
    for _ in range(FIT_ROUNDS if len(x) else 0):
        near = np.argmax(x @ centres.T - 0.5 * np.einsum("ij,ij->i", centres, centres), axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        counts = np.bincount(near, minlength=len(centres))
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    d2 = np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", centres, centres) - 2.0 * (x @ centres.T)
    return np.sqrt(np.maximum(d2, 0.0))


@dataclass(frozen=True)
class VectorIndex:
    path: str
    n: int
    dim: int
    centres: np.ndarray
    blocks: pd.DataFrame  # block, cell, rows, least, largest

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(ROWS).parquet(f"{self.path}/rows")


@dataclass
class Work:
    """How much of (query, row) pairs and of the cells a search looked at."""

    pairs: int = 0
    scored: int = 0
    cells: int = 0
    cells_read: int = 0

    @property
    def skipped(self) -> float:
        return 1 - self.scored / self.pairs if self.pairs else 0.0


def build_vector_index(corpus: DataFrame, path: str, key: str = "song_id", vec: str = "embedding", cells: int | None = None,
                       block_rows: int = BLOCK_ROWS, seed: int = 42) -> VectorIndex:
    """Store the index of a corpus at ``path``.  Raises on null vectors, mixed
    dimensions and repeated keys at the cut of the sample.  A zero vector has
    a cell of its own."""
    spark = corpus.sparkSession
    src = _written(corpus.select(F.col(key).cast("long").alias("ckey"), F.col(vec).cast("array<double>").alias("cvec")), "index-corpus")
    n, dim = vector_dim(src, "cvec")
    cells = min(cells or max(1, math.isqrt(n)), MAX_CELLS)
    block_rows = max(block_rows, -(-n // MAX_BLOCKS))
    sample = sample_exact(src, FIT_ROWS, seed, "ckey").sort("ckey").toArrow() if n else None  # FIT_ROWS at most
    fitted = _unit_rows(_list_to_matrix(sample.column("cvec"), dim)) if n else np.zeros((0, dim))
    centres = _fit_centroids(fitted[fitted.any(axis=1)], cells, seed)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            raw = _list_to_matrix(b.column("cvec"), dim)
            x = _unit_rows(raw)
            d = _distances(x, centres) if len(centres) else np.zeros((len(x), 1))
            cell = d.argmin(axis=1)
            dist, zero = d[np.arange(len(x)), cell], ~x.any(axis=1)
            cell[zero], dist[zero] = -1, 0.0
            vectors = pa.ListArray.from_arrays(np.arange(0, raw.size + 1, dim, dtype=np.int32), raw.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), b.column("ckey"), pa.array(dist), vectors], names=["cell", "ckey", "dist", "cvec"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, held, last = TaskContext.get().partitionId() << 32, 0, None
        for b in batches:
            cell = b.column("cell").to_numpy()
            if not len(cell):
                continue
            begins = np.concatenate(([True], cell[1:] != cell[:-1]))
            at = np.arange(len(cell))
            place = at - np.maximum.accumulate(np.where(begins, at, 0))
            if cell[0] == last:  # the cell goes on from the batch before
                place[np.cumsum(begins) == 1] += held
            blocks = block + np.cumsum(place % block_rows == 0)
            block, held, last = int(blocks[-1]), int(place[-1]) + 1, cell[-1]
            yield pa.RecordBatch.from_arrays([b.column("cell"), pa.array(blocks), b.column("ckey"), b.column("dist"), b.column("cvec")],
                                             names=["cell", "block", "ckey", "dist", "cvec"])

    placed = src.mapInArrow(assigned, "cell int, ckey long, dist double, cvec array<double>")
    order = ["cell", "dist", "ckey"]
    placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(cut, ROWS).write.partitionBy("cell").parquet(f"{path}/rows")
    blocks = spark.read.schema(ROWS).parquet(f"{path}/rows").groupBy("block", "cell").agg(
        F.count(F.lit(1)).alias("rows"), F.min("dist").alias("least"), F.max("dist").alias("largest"))
    blocks.write.parquet(f"{path}/blocks")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centroid array<double>").write.parquet(f"{path}/centroids")
    spark.createDataFrame([(n, dim)], "n long, dim int").write.parquet(f"{path}/size")
    return open_vector_index(spark, path)


def open_vector_index(spark: SparkSession, path: str) -> VectorIndex:
    size = spark.read.parquet(f"{path}/size").first()
    centres = spark.read.parquet(f"{path}/centroids").sort("cell").toPandas()  # MAX_CELLS rows
    matrix = np.vstack(centres["centroid"].to_numpy()) if len(centres) else np.zeros((0, size["dim"]))
    blocks = spark.read.parquet(f"{path}/blocks").sort("block").toPandas()  # MAX_BLOCKS rows and one for each cell and task
    return VectorIndex(path, size["n"], size["dim"], matrix, blocks)


def _needed(index: VectorIndex, cell: int, least: float, largest: float, to_centre: np.ndarray, limit: np.ndarray, done: np.ndarray | None) -> np.ndarray:
    """The queries that need a block: those with a bound within ``limit``, but
    for the cells the first round has scored (centroid within ``done``)."""
    if cell < 0:  # zero vectors are similar to nothing; the first round has them
        return np.arange(len(limit)) if done is None else np.zeros(0, dtype=np.int64)
    if done is None:
        return np.flatnonzero(to_centre <= limit + SLACK)
    near = np.maximum(np.maximum(to_centre - largest, least - to_centre), 0.0) - SLACK
    return np.flatnonzero((near <= limit) & (to_centre > done + SLACK))


def _to_cell(index: VectorIndex, vectors: np.ndarray, cell: int) -> np.ndarray:
    return _distances(vectors, index.centres[cell:cell + 1])[:, 0] if cell >= 0 and len(index.centres) else np.zeros(len(vectors))


def search(index: VectorIndex, queries: DataFrame, k: int, query_key: str = "request_id", corpus_key: str = "song_id", vec: str = "embedding",
           first_rows: int | None = None, max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> tuple[DataFrame, Work]:
    """``(query_key, corpus_key, similarity, rank)`` as
    :func:`~cadenza.operators.topk.topk_cosine` has them, and the work done.
    Queries are taken in chunks of at most ``max_broadcast_bytes``."""
    spark = queries.sparkSession
    q = _written(queries.select(F.col(query_key).cast("long").alias("qkey"), F.col(vec).cast("array<double>").alias("qvec")), "index-queries")
    n_q, dim = vector_dim(q, "qvec")
    work, found = Work(pairs=n_q * index.n, cells=index.blocks["cell"].nunique()), spark.createDataFrame([], FOUND)
    if n_q and index.n:
        if dim != index.dim:
            raise ValueError(f"queries of {dim} dimensions for an index of {index.dim}")
        chunks = math.ceil(n_q * (8 * dim + 16 * k + 64) / max_broadcast_bytes)
        reached = _reach(index, q, first_rows or max(4 * k, BLOCK_ROWS))
        first = _written(_score(index, reached, k, None, chunks, work), "first-round")
        by_score = Window.partitionBy("qkey").orderBy(F.col("similarity").desc(), F.col("ckey").asc())
        kth = first.withColumn("place", F.row_number().over(by_score)).filter(F.col("place") == k).select(F.col("qkey").alias("of"), F.col("similarity").alias("kth"))
        least = F.coalesce("kth", F.lit(-1.0))
        limits = _written(reached.join(kth, F.col("qkey").eqNullSafe(F.col("of")), "left").select(
            "qkey", "qvec", (F.sqrt(F.greatest(2 - 2 * least, F.lit(0.0)) + ROUNDED) + SLACK).alias("limit"), F.col("limit").alias("done"), least.alias("least")), "index-limits")
        found = first.unionByName(_score(index, limits, k, "done", chunks, work))
    best = Window.partitionBy("qkey").orderBy(F.col("similarity").desc(), F.col("ckey").asc())
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select(F.col("qkey").alias(query_key), F.col("ckey").alias(corpus_key), "similarity", F.col("rank").cast("int").alias("rank")), work


def _reach(index: VectorIndex, q: DataFrame, first_rows: int) -> DataFrame:
    """Queries with the distance to the last of the nearest centroids whose
    cells hold ``first_rows`` rows (``limit``), stored."""
    in_cell = index.blocks[index.blocks["cell"] >= 0].groupby("cell")["rows"].sum()
    sizes = np.zeros(max(1, len(index.centres)), dtype=np.int64)
    sizes[in_cell.index.to_numpy(dtype=np.int64)] = in_cell.to_numpy()

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, TILE_QUERIES):
                part = b.slice(at, TILE_QUERIES)
                x = _unit_rows(_list_to_matrix(part.column("qvec"), index.dim))
                d = _distances(x, index.centres) if len(index.centres) else np.zeros((len(x), 1))
                order = np.argsort(d, axis=1, kind="stable")
                enough = (np.cumsum(sizes[order], axis=1) >= first_rows).argmax(axis=1)
                if sizes.sum() < first_rows:
                    enough[:] = d.shape[1] - 1
                limit = np.take_along_axis(d, order, axis=1)[np.arange(len(x)), enough]
                limit[~x.any(axis=1)] = np.inf  # a zero query is as near to everything
                yield pa.RecordBatch.from_arrays([part.column("qkey"), part.column("qvec"), pa.array(limit)], names=["qkey", "qvec", "limit"])

    return _written(q.mapInArrow(reach, "qkey long, qvec array<double>, limit double"), "index-reach")


def _asked(index: VectorIndex, q: DataFrame, done: str | None) -> dict[int, int]:
    """How many queries need each block."""
    places = list(index.blocks[["block", "cell", "least", "largest"]].itertuples(index=False, name=None))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = np.zeros(len(places), dtype=np.int64)
        for b in batches:
            for at in range(0, b.num_rows, TILE_QUERIES):
                part = b.slice(at, TILE_QUERIES)
                x = _unit_rows(_list_to_matrix(part.column("qvec"), index.dim))
                limit, before = part.column("limit").to_numpy(), part.column(done).to_numpy() if done else None
                d = _distances(x, index.centres) if len(index.centres) else np.zeros((len(x), 1))
                for i, (_, cell, least, largest) in enumerate(places):
                    asked[i] += len(_needed(index, cell, least, largest, d[:, cell], limit, before))
        at = np.flatnonzero(asked)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(asked[at])], names=["at", "n"])

    rows = q.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()  # a row for each block at most
    return {places[r["at"]][0]: r["n"] for r in rows}


def _score(index: VectorIndex, q: DataFrame, k: int, done: str | None, chunks: int, work: Work) -> DataFrame:
    """The k best rows of each query in each task, among the blocks it needs."""
    spark = q.sparkSession
    asked = _asked(index, q, done)
    needed = index.blocks[index.blocks["block"].isin(asked.keys())]
    work.scored += sum(asked[block] * rows for block, rows in needed[["block", "rows"]].itertuples(index=False, name=None))
    cells = sorted(needed["cell"].unique().tolist())
    work.cells_read = max(work.cells_read, len(cells))
    found = spark.createDataFrame([], FOUND)
    if not cells:
        return found
    places = {block: place for block, *place in needed[["block", "cell", "least", "largest"]].itertuples(index=False, name=None)}
    rows = index.rows(spark)
    if len(cells) < work.cells:
        rows = rows.filter(F.col("cell").isin(cells))
    for chunk in range(chunks):
        table = (q.filter(F.pmod(F.xxhash64("qkey"), F.lit(chunks)) == chunk) if chunks > 1 else q).toArrow()  # at most max_broadcast_bytes
        if table.num_rows:
            of = [table.column(c).to_numpy() for c in ("limit", *((done, "least") if done else ()))]
            held = spark.sparkContext.broadcast((table.column("qkey").combine_chunks(), _unit_rows(_list_to_matrix(table.column("qvec"), index.dim)), places, *of))
            found = found.unionByName(rows.select("block", "ckey", "cvec").mapInArrow(_scorer(index, held, k), FOUND))
    return found


def _scorer(index: VectorIndex, held, k: int):
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, vectors, places, limit, *second = held.value
        done, least = second or (None, None)
        best, near = RunningTopK(len(keys), k, least), (None, None)
        for b in batches:
            blocks, ids = b.column("block").to_numpy(), b.column("ckey").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(blocks)) + 1
            for at, to in zip([0, *cuts.tolist()], [*cuts.tolist(), len(blocks)]):
                if at == to or int(blocks[at]) not in places:
                    continue
                cell, smallest, largest = places[int(blocks[at])]
                if near[0] != cell:
                    near = cell, _to_cell(index, vectors, cell)
                if not len(of := _needed(index, cell, smallest, largest, near[1], limit, done)):
                    continue
                x, some = first_copies(_unit_rows(_list_to_matrix(b.column("cvec").slice(at, to - at), index.dim)), ids[at:to], k)
                best.score(of, vectors, x, some)
        rows, found, scores = best.rows()
        yield pa.RecordBatch.from_arrays([keys.take(pa.array(rows)), pa.array(found, pa.int64()), pa.array(scores, pa.float64())], names=["qkey", "ckey", "similarity"])

    return scored
