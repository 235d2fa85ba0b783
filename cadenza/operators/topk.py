"""Exact top-k cosine similarity of many query vectors against a corpus.

A few queries are broadcast and the corpus is scored where it lies.  Many
queries meet the corpus in a grid: both are stored once, dealt into parts of
bounded bytes, and a task takes one part of the corpus and one of the queries.
No side passes through the driver, and a query has at most ``k`` candidates
for each part of the corpus, however many tasks there are.

A task scores tiles in single precision and keeps what reaches the k-th best of
its query less the rounding of that product; only those few pairs are scored in
double precision, rounded to 1e-12 and ranked.  The order is (similarity
descending, id ascending) throughout, so ties are cut by id and the result is
exact.  Of equal vectors only the ``k`` of least id can be among the best.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.operators.parallel import spread
from cadenza.session import checkpoint_dir
from cadenza.sources.embeddings import vector_dim

RANK_DECIMALS = 12
MAX_BROADCAST_BYTES = 256 << 20
SCAN_BYTES = 16 << 20  # queries that a scan of the corpus is worth; more meet it in a grid
PART_BYTES = 64 << 20  # of the corpus in a part of the grid; of queries, which a task reads in batches, four times that
BLOCK_BYTES = 2 << 20  # of scores at once; stays in a core's cache
TILE_QUERIES = 256
PAIRS = 1 << 15  # scored exactly at once
SIDES = "cell int, side int, key long, vec array<double>"
FOUND = "qkey long, found array<struct<away: double, ckey: long>>"


def _unit_rows(m: np.ndarray) -> np.ndarray:
    n = np.sqrt(np.einsum("ij,ij->i", m, m))
    out = np.zeros_like(m)
    nz = n > 0
    out[nz] = m[nz] / n[nz, None]
    return out


def _list_to_matrix(arr: pa.Array, dim: int) -> np.ndarray:
    """Arrow ``list<float|double>`` column -> dense float64 matrix."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    sizes = arr.value_lengths()
    if arr.null_count or not pa.compute.all(pa.compute.equal(sizes, dim)).as_py():
        raise ValueError(f"vectors must all have {dim} dimensions")
    flat = arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(arr), dim)


class RunningTopK:
    """The best ``k`` (score, id) of each query so far: score descending, then
    id ascending.  Memory: queries x k x 16 bytes.  ``least`` has scores below
    which nothing can be among the best of a query; such are not kept."""

    def __init__(self, n_queries: int, k: int, least: np.ndarray | None = None):
        self.k = k
        self.least = np.full(n_queries, -np.inf) if least is None else least
        self.scores = np.full((n_queries, k), -np.inf)
        self.ids = np.full((n_queries, k), np.iinfo(np.int64).max)

    def add(self, first: int | np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores`` (rows x queries from ``first`` on, or the queries
        ``first`` lists); ``ids`` ascending."""
        n, t = scores.shape
        k, tile = min(self.k, n), first if isinstance(first, np.ndarray) else slice(first, first + t)
        kth = np.partition(scores, n - k, axis=0)[n - k]
        above = scores > kth
        tied = scores == kth
        room = k - above.sum(axis=0)
        keep = (above | (tied & (np.cumsum(tied, axis=0, dtype=np.int32) <= room))) & (scores >= self.scores[tile, -1])
        row, col = np.nonzero(keep)
        if not len(row):
            return
        q = np.concatenate([np.repeat(np.arange(t), self.k), col])
        s = np.concatenate([self.scores[tile].ravel(), scores[row, col]])
        i = np.concatenate([self.ids[tile].ravel(), ids[row]])
        order = np.lexsort((i, -s, q))
        starts = np.searchsorted(q[order], np.arange(t))
        best = order[starts[:, None] + np.arange(self.k)]
        self.scores[tile], self.ids[tile] = s[best], i[best]

    def score(self, of: slice | np.ndarray, queries: np.ndarray, x: np.ndarray, ids: np.ndarray, block_bytes: int = BLOCK_BYTES) -> None:
        """Add the unit rows ``x`` for the queries ``of`` of unit ``queries``."""
        places = np.arange(len(queries))[of]
        x32, slack = x.astype(np.float32), (x.shape[1] + 8) * 2.0**-23
        tile = max(1, min(TILE_QUERIES, block_bytes // 4))
        step = max(1, block_bytes // (4 * tile))
        for to in range(0, len(places), tile):
            at = places[to:to + tile]
            q, waiting, n = queries[at], [], 0
            floor_of = lambda: (np.maximum(self.scores[at, -1], self.least[at]) - slack).astype(np.float32)
            q32, floor = q.astype(np.float32), floor_of()
            for begin in range(0, len(x), step):
                near = q32 @ x32[begin:begin + step].T
                if near.shape[1] > self.k and np.isneginf(floor).any():  # no k rows seen yet
                    kth = np.partition(near, near.shape[1] - self.k, axis=1)[:, near.shape[1] - self.k]
                    np.maximum(floor, kth - np.float32(2 * slack), out=floor)
                found = np.flatnonzero(near >= floor[:, None])
                if not len(found):
                    continue
                waiting.append((found // near.shape[1], begin + found % near.shape[1]))
                n += len(found)
                if n >= len(at) * self.k:
                    self._merge(at, q, x, ids, waiting)
                    waiting, n, floor = [], 0, np.maximum(floor, floor_of())
            if waiting:
                self._merge(at, q, x, ids, waiting)

    def _merge(self, at: np.ndarray, q: np.ndarray, x: np.ndarray, ids: np.ndarray, waiting: list) -> None:
        """Score pairs (place in ``at``, row) exactly and keep the best."""
        col, row = (np.concatenate(p) for p in zip(*waiting))
        s = np.empty(len(col))
        for i in range(0, len(col), PAIRS):
            s[i:i + PAIRS] = np.einsum("ij,ij->i", q[col[i:i + PAIRS]], x[row[i:i + PAIRS]])
        s, i = np.round(s, RANK_DECIMALS) + 0.0, ids[row]
        last, last_id = self.scores[at, -1][col], self.ids[at, -1][col]
        better = ((s > last) | ((s == last) & (i < last_id))) & (s >= self.least[at][col])
        col, s, i = col[better], s[better], i[better]
        if not len(col):
            return
        of, col = np.unique(col, return_inverse=True)
        places = at[of]
        col = np.concatenate([np.repeat(np.arange(len(of)), self.k), col])
        s = np.concatenate([self.scores[places].ravel(), s])
        i = np.concatenate([self.ids[places].ravel(), i])
        order = np.lexsort((i, -s, col))
        best = order[np.searchsorted(col[order], np.arange(len(of)))[:, None] + np.arange(self.k)]
        self.scores[places], self.ids[places] = s[best], i[best]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of all entries that are taken."""
        q, at = np.nonzero(self.scores > -np.inf)
        return q, self.ids[q, at], self.scores[q, at]


def first_copies(x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows by id, of equal vectors only the first ``k``."""
    order = np.argsort(ids, kind="stable")
    x, ids = np.ascontiguousarray(x[order]), ids[order]
    x += 0.0  # no negative zeros
    if len(x) <= k:
        return x, ids
    same = np.unique(x.view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel(), return_inverse=True)[1].ravel()
    by_vector = np.argsort(same, kind="stable")
    begins = np.searchsorted(same[by_vector], same[by_vector])
    if len(x) == same.max() + 1:
        return x, ids
    keep = np.sort(by_vector[np.arange(len(x)) - begins < k])
    return x[keep], ids[keep]


def topk_cosine(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    query_key: str = "request_id",
    corpus_key: str = "song_id",
    query_vec: str = "embedding",
    corpus_vec: str = "embedding",
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
    block_bytes: int = BLOCK_BYTES,
    scan_bytes: int = SCAN_BYTES,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """Return ``(query_key, corpus_key, similarity double, rank int)`` with the
    ``k`` most cosine-similar corpus rows per query, ranked by similarity
    descending then ``corpus_key`` ascending.  A zero vector scores 0.  Raises
    on null vectors and mixed dimensions among the queries, and in the task
    that meets one in the corpus.

    Up to ``scan_bytes`` of queries are broadcast, in chunks of at most
    ``max_broadcast_bytes``; more meet the corpus in a grid of parts of about
    ``part_bytes``."""
    spark = queries.sparkSession
    q = queries.select(F.col(query_key).cast("long").alias("qkey"), F.col(query_vec).cast("array<double>").alias("qvec"))
    c = corpus.select(F.col(corpus_key).cast("long").alias("ckey"), F.col(corpus_vec).cast("array<double>").alias("cvec"))
    q = _written(q, "queries")
    n_q, dim = vector_dim(q, "qvec")
    size = n_q * (dim * 8 + k * 16)
    if not n_q:
        found = spark.createDataFrame([], FOUND)
    elif size > scan_bytes:
        found = _grid(q, c, k, n_q, dim, part_bytes, block_bytes)
    else:
        chunks, found = math.ceil(size / max_broadcast_bytes), None
        for chunk in range(chunks):
            part = q if chunks == 1 else q.filter(F.pmod(F.xxhash64("qkey"), F.lit(chunks)) == chunk)
            scored = _chunk_candidates(part, c, k, dim, block_bytes)
            found = scored if found is None else found.unionByName(scored)
    best = found.groupBy("qkey").agg(F.slice(F.sort_array(F.flatten(F.collect_list("found"))), 1, k).alias("found"))  # k for each part
    return best.select("qkey", F.posexplode("found").alias("at", "hit")).select(
        F.col("qkey").alias(query_key), F.col("hit.ckey").alias(corpus_key), (0.0 - F.col("hit.away")).alias("similarity"),
        (F.col("at") + 1).cast("int").alias("rank"))


def _written(df: DataFrame, name: str) -> DataFrame:
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _hits(keys: pa.Array, best: RunningTopK) -> pa.RecordBatch:
    """A row for each query that has any."""
    taken = best.scores > -np.inf
    counts = taken.sum(axis=1)
    hits = pa.StructArray.from_arrays([pa.array(0.0 - best.scores[taken]), pa.array(best.ids[taken])], names=["away", "ckey"])
    found = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(counts))).astype(np.int32), hits)
    return pa.RecordBatch.from_arrays([keys, found], names=["qkey", "found"]).filter(pa.array(counts > 0))


def _grid(q: DataFrame, c: DataFrame, k: int, n_q: int, dim: int, part_bytes: int, block_bytes: int) -> DataFrame:
    """Candidates of every query in every part of the corpus.  A row goes to
    all cells of its row or column of the grid, a cell is one task."""
    c = _written(c, "corpus")
    n_c, dim_c = vector_dim(c, "cvec")
    if n_c and dim_c != dim:
        raise ValueError(f"queries of {dim} dimensions for a corpus of {dim_c}")
    down = max(1, math.ceil(n_c * dim * 8 / part_bytes))
    tasks = 2 * q.sparkSession.sparkContext.defaultParallelism
    across = min(n_q, max(math.ceil(n_q * dim * 2 / part_bytes), math.ceil(tasks / down)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda key, vec, n: F.pmod(F.xxhash64(key, vec), F.lit(n)).cast("int")
    given = c.select(F.lit(0).alias("side"), F.col("ckey").alias("key"), F.col("cvec").alias("vec"), place("ckey", "cvec", down).alias("d"), every(across).alias("a"))
    asked = q.select(F.lit(1).alias("side"), F.col("qkey").alias("key"), F.col("qvec").alias("vec"), every(down).alias("d"), place("qkey", "qvec", across).alias("a"))
    sides = given.unionByName(asked).select((F.col("a") * down + F.col("d")).cast("int").alias("cell"), "side", "key", "vec")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, x, ids = None, [], None, None
        for b in batches:
            cells, sides = b.column("cell").to_numpy(), b.column("side").to_numpy()
            cuts = np.flatnonzero((np.diff(cells) != 0) | (np.diff(sides) != 0)) + 1
            for at, to in zip([0, *cuts.tolist()], [*cuts.tolist(), len(cells)]):
                if at == to:
                    continue
                if cells[at] != cell:
                    cell, held, x = cells[at], [], None
                part = b.slice(at, to - at)
                vectors = _unit_rows(_list_to_matrix(part.column("vec"), dim))
                if not sides[at]:  # of a cell the corpus comes first
                    held.append((vectors, part.column("key").to_numpy(zero_copy_only=False)))
                    continue
                if x is None:
                    x, ids = np.concatenate([np.zeros((0, dim)), *(v for v, _ in held)]), np.concatenate([np.zeros(0, dtype=np.int64), *(i for _, i in held)])
                    held = []
                    x, ids = first_copies(x, ids, k)
                best = RunningTopK(len(vectors), k)
                best.score(slice(None), vectors, x, ids, block_bytes)
                yield _hits(part.column("key"), best)

    return sides.repartitionById(down * across, F.col("cell")).sortWithinPartitions("cell", "side").mapInArrow(score, FOUND)


def _chunk_candidates(q: DataFrame, c: DataFrame, k: int, dim: int, block_bytes: int) -> DataFrame:
    tbl = q.toArrow()  # at most max_broadcast_bytes
    keys = tbl.column("qkey").combine_chunks()
    bc = q.sparkSession.sparkContext.broadcast((keys, _unit_rows(_list_to_matrix(tbl.column("qvec"), dim))))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, queries = bc.value
        best = RunningTopK(len(keys), k)
        for b in batches:
            if b.num_rows and len(keys):
                x, ids = first_copies(_unit_rows(_list_to_matrix(b.column("cvec"), dim)), b.column("ckey").to_numpy(zero_copy_only=False), k)
                best.score(slice(None), queries, x, ids, block_bytes)
        yield _hits(keys, best)

    return spread(c).mapInArrow(score, FOUND)
