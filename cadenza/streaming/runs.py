"""The throttle rule inside one run of any length, over many tasks.

Inside a run a row is emitted when it differs from the last *emitted* row by
``delta`` or more.  Row by row that is a recurrence, but each row alone settles
which row would follow it: the first later one at such a distance.  These
pointers, and where following them leaves a piece of the run, need no carry:

* :class:`Pointers` finds them for the values of one partition, from range
  minima and maxima (of rows inside a block, then of blocks), and follows them
  to the partition's end by pointer doubling.
* A partition that lies inside a run thereby maps the value that is pending
  before it to the one after it.  The values that can be pending after such
  partitions are the nodes of a graph, and :func:`pending_values` doubles its
  pointers with joins until the orbit of the run's first row is marked, in
  as many rounds as the number of partitions has binary digits.

Only partitions that a run fills from end to end take part in the second step.
What reaches the driver is a few numbers for each partition.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.session import checkpoint_dir

BLOCK = 4096
BLOCKS_AT_ONCE = 64
ASKED = 1_000_000  # values that one task looks up in a partition


def _range_tables(low: np.ndarray, high: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Level k holds minima and maxima of 2**k neighbours along the last axis."""
    tables, width = [(low, high)], 1
    while 2 * width <= low.shape[-1]:
        lo, hi = tables[-1]
        tables.append((np.minimum(lo[..., :-width], lo[..., width:]), np.maximum(hi[..., :-width], hi[..., width:])))
        width *= 2
    return tables


class Pointers:
    """For the values of consecutive rows of one run: the first later row at
    distance ``delta`` or more.  Values that are no numbers are at no distance."""

    def __init__(self, vals: np.ndarray, delta: float):
        self.vals, self.delta, self.n = vals, delta, len(vals)
        blocks = max(1, -(-self.n // BLOCK))
        padded = np.full(blocks * BLOCK, np.nan)
        padded[:self.n] = vals
        self.low = np.where(np.isnan(padded), np.inf, padded).reshape(blocks, BLOCK)
        self.high = np.where(np.isnan(padded), -np.inf, padded).reshape(blocks, BLOCK)
        self.block_tables = _range_tables(self.low.min(axis=1), self.high.max(axis=1))
        self.down, self.up = np.minimum.accumulate(self.low, axis=1), np.maximum.accumulate(self.high, axis=1)

    def _far(self, low, high, x) -> np.ndarray:
        return (high - x >= self.delta) | (x - low >= self.delta)

    def _lifted(self, tables, at: np.ndarray, x: np.ndarray, size: int) -> np.ndarray:
        """From ``at`` on, past all places that are near ``x``: by the largest
        power of two first.  ``size`` if all that follow are near."""
        for k in reversed(range(len(tables))):
            low, high = tables[k]
            fits = at + (1 << k) <= size
            clipped = np.minimum(at, low.shape[-1] - 1)
            at = np.where(fits & ~self._far(low[clipped], high[clipped], x), at + (1 << k), at)
        return at

    def entry(self, x: np.ndarray, block: np.ndarray | None = None) -> np.ndarray:
        """The first row from the start (of block ``block``) on that is far from ``x``; ``n`` if none is."""
        x = np.asarray(x, dtype=np.float64)
        start = np.zeros(len(x), dtype=np.int64) if block is None else block
        n_blocks = len(self.low)
        found = self._lifted(self.block_tables, start, x, n_blocks)
        hit = found < n_blocks
        at = np.minimum(found, n_blocks - 1)
        least, most = np.zeros(len(x), dtype=np.int64), np.full(len(x), BLOCK - 1)
        while (least < most).any():  # by the running extremes of the block
            mid = (least + most) // 2
            far = self._far(self.down[at, mid], self.up[at, mid], x)
            least, most = np.where(far | (least >= most), least, mid + 1), np.where(far, mid, most)
        return np.where(hit, at * BLOCK + least, self.n)

    def following(self) -> np.ndarray:
        """For each row the first later row far from it; ``n`` if none is."""
        out = np.empty(self.low.size, dtype=np.int64)
        for a in range(0, len(self.low), BLOCKS_AT_ONCE):
            part = slice(a, a + BLOCKS_AT_ONCE)
            low, high = self.low[part], self.high[part]
            x = np.where(np.isinf(low), np.nan, low)
            at = np.tile(np.arange(1, BLOCK + 1), (len(low), 1))
            rows = np.arange(len(low))[:, None]
            for k, (lo, hi) in reversed(list(enumerate(_range_tables(low, high)))):
                clipped = np.minimum(at, lo.shape[1] - 1)
                near = (at + (1 << k) <= BLOCK) & ~self._far(lo[rows, clipped], hi[rows, clipped], x)
                at = np.where(near, at + (1 << k), at)
            block = np.arange(a, a + len(low))[:, None]
            beyond = at >= BLOCK
            place = block * BLOCK + at
            if beyond.any():
                place[beyond] = self.entry(x[beyond], np.broadcast_to(block + 1, at.shape)[beyond])
            out[a * BLOCK:(a + len(low)) * BLOCK] = place.ravel()
        return np.minimum(out[:self.n], self.n)

    def exits(self) -> np.ndarray:
        """For each row the last row that is emitted if it is: pointers doubled
        until none leads further."""
        follow = self.following()
        jump = np.where(follow < self.n, follow, np.arange(self.n))
        while True:
            twice = jump[jump]
            if np.array_equal(twice, jump):
                return jump
            jump = twice

    def step_function(self) -> tuple[np.ndarray, np.ndarray]:
        """(rows that can be the first emitted one, the value pending at the end
        then): the rows that exceed all before them on either side."""
        down, up = np.minimum.accumulate(self.low.ravel())[:self.n], np.maximum.accumulate(self.high.ravel())[:self.n]
        record = np.ones(self.n, dtype=bool)
        record[1:] = (down[1:] < down[:-1]) | (up[1:] > up[:-1])
        rows = np.flatnonzero(record & ~np.isnan(self.vals))
        return rows, self.vals[self.exits()[rows]]


class Chains:
    """The partitions that runs fill, in order, with their runs and values'
    ranges: a few numbers for each partition."""

    def __init__(self, inner: dict[int, int], ranges: dict[int, tuple[float, float]], delta: float):
        self.pids = np.array(sorted(inner), dtype=np.int64)
        self.runs = np.array([inner[p] for p in self.pids.tolist()], dtype=np.int64)
        low, high = np.array([ranges[p] for p in self.pids.tolist()], dtype=np.float64).reshape(-1, 2).T
        self.pointers = Pointers(np.zeros(0), delta)
        self.tables = _range_tables(np.where(np.isnan(low), np.inf, low), np.where(np.isnan(high), -np.inf, high))

    def next_far(self, run: np.ndarray, pid: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The first partition after ``pid`` that is of the run and has a value far from ``x``; -1 if none is."""
        at = self.pointers._lifted(self.tables, np.searchsorted(self.pids, pid, side="right"), x, len(self.pids))
        clipped = np.minimum(at, len(self.pids) - 1)
        return np.where((at < len(self.pids)) & (self.runs[clipped] == run), self.pids[clipped], -1)


def _first_record(low: np.ndarray, high: np.ndarray, x: np.ndarray, delta: float) -> np.ndarray:
    """The first place where running extremes are far from ``x``; one is."""
    least, most = np.zeros(len(x), dtype=np.int64), np.full(len(x), len(low) - 1)
    while (least < most).any():
        mid = (least + most) // 2
        far = (high[mid] - x >= delta) | (x - low[mid] >= delta)
        least, most = np.where(far | (least >= most), least, mid + 1), np.where(far, mid, most)
    return least


def _stored(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pending_values(parts: DataFrame, value: str, inner: dict[int, int], starts: dict[int, tuple[int, float]],
                   ranges: dict[int, tuple[float, float]], delta: float) -> dict[int, float]:
    """The values that are pending after partitions that lie inside a run.

    ``parts`` is checkpointed, its partitions in order.  ``inner`` maps each
    partition that a run fills and goes beyond to the run's number, ``starts``
    a run to the partition where it begins and the value pending after that,
    ``ranges`` an inner partition to its least and largest value.  Partitions
    in which nothing is emitted are not in the result: what was pending before
    them still is."""
    from pyspark import TaskContext

    spark = parts.sparkSession
    chains = Chains(inner, ranges, delta)

    def mapped(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pid = TaskContext.get().partitionId()
        if pid in inner:
            vals = np.concatenate([np.zeros(0), *(pdf[value].to_numpy(dtype=np.float64) for pdf in pdfs)])
            rows, after = Pointers(vals, delta).step_function()
            yield pd.DataFrame({"pid": pid, "run": inner[pid], "row": rows, "at": vals[rows], "after": after})

    @F.pandas_udf("int")
    def next_far(run: pd.Series, pid: pd.Series, x: pd.Series) -> pd.Series:
        return pd.Series(chains.next_far(run.to_numpy(), pid.to_numpy(), x.to_numpy()))

    steps = _stored(parts.select(value).mapInPandas(mapped, "pid int, run int, row long, at double, after double"), "run-steps")
    first = spark.createDataFrame([(pid, run, x) for run, (pid, x) in starts.items()], "pid int, run int, x double")
    # nodes are the values that can be pending after a partition; each leads to the next partition with a value far from it
    nodes = steps.select("pid", "run", F.col("after").alias("x")).distinct().unionByName(first).filter(~F.isnan("x"))
    aimed = _stored(nodes.withColumn("at", next_far("run", "pid", "x")).filter(F.col("at") >= 0), "run-nodes")
    sizes = aimed.groupBy("at").agg(F.ceil(F.count(F.lit(1)) / ASKED).cast("int").alias("salts"))  # a row for each partition
    asked = aimed.join(sizes, "at").select("pid", "x", "at", F.pmod(F.xxhash64("pid", "x"), F.col("salts")).cast("int").alias("salt"))
    given = steps.withColumnRenamed("pid", "to").join(sizes.withColumnRenamed("at", "to"), "to").select(
        "to", "row", F.col("at").alias("value"), "after", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))

    def entered(asked: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        given = given.sort_values("row")
        at, x = given["value"].to_numpy(), asked["x"].to_numpy()
        place = _first_record(np.minimum.accumulate(at), np.maximum.accumulate(at), x, delta)
        return pd.DataFrame({"pid": asked["pid"], "x": x, "to_pid": asked["at"], "to_x": given["after"].to_numpy()[place]})

    jumps = _stored(asked.groupBy("at", "salt").cogroup(given.groupBy("to", "salt")).applyInPandas(
        lambda a, g: entered(a, g) if len(a) else pd.DataFrame({"pid": [], "x": [], "to_pid": [], "to_x": []}),
        "pid int, x double, to_pid int, to_x double"), "run-jumps")
    marked = _stored(first.select("pid", "x"), "run-marks")
    while not jumps.isEmpty():  # pointers double, and each is longer than a partition
        onward = marked.join(jumps, ["pid", "x"]).select(F.col("to_pid").alias("pid"), F.col("to_x").alias("x"))
        marked = _stored(marked.unionByName(onward).distinct(), "run-marks")
        second = jumps.toDF("to_pid", "to_x", "far_pid", "far_x")
        jumps = _stored(jumps.join(second, ["to_pid", "to_x"]).select("pid", "x", F.col("far_pid").alias("to_pid"), F.col("far_x").alias("to_x")),
                        "run-jumps")
    return {r["pid"]: r["x"] for r in marked.collect() if r["pid"] in inner}  # one for each partition at most
