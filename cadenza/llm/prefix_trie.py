"""Prefix trie of conversations in tables of minimal-perfect-hash slots.

A node is a distinct sequence of first turns.  Its digest is the sum of its
turns' hashes times powers of a base, modulo a prime, in four lanes: such sums
can be continued from any place, so a conversation is cut into segments of at
most ``SEGMENT`` turns that lie in different tasks, and none is walked as a
whole.

1. Turns are range-partitioned and sorted; each task packs its runs of a
   conversation into segments.  Everything after this handles segments.
2. Rebuilt conversations are segments too: the borrowed head and what is left
   of the conversation's own.  Running sums over a conversation's segments give
   each the digest before it.
3. Each shard enumerates the distinct digests of its segments, gives each a
   slot of a minimal perfect hash, verified against the stored digest, and
   scatters its rows into flat arrays by slot.  Partial nodes are summed by
   digest; a node whose members differ in parent or last turn would be a
   collision of digests, and the whole is then done again with another base.
4. With each node's smallest member known, a second pass scatters the
   characters that a member does not own (its node has a smaller member) and
   the leaves that it owns, and adds them up through the parents' slots, deepest
   first.  What a conversation has beyond its segment comes along as one
   number, so partial sums of different shards add up to those of the subtree.

Shards hold bounded slices of segments, whatever shares a prefix; a prefix of
all conversations is one partial row for each slice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.shared import shared_table

PRIME = 2**31 - 1
LANES = 4
SEEDS = 4  # bases to try, should digests ever collide
SEGMENT = 1024  # turns in a packed row
SPAN = 65_536  # turns of a conversation in one shard
SLICE_TURNS = 500_000  # turns that a shard holds at once
GROUP = 100  # conversations that borrow from the same one
MAX_BORROWED = 5
CHUNK_IDS = 4096  # member ids in a packed row
KEY_BYTES = 32


class Slots:
    """A minimal perfect hash of distinct keys (columns of int64): level by
    level, keys alone in their cell take it, the others go on.  A slot is the
    rank of its cell; ``find`` compares the key stored there."""

    def __init__(self, columns: list[np.ndarray]):
        n = len(columns[0])
        slot, left, taken, self.levels = np.full(n, -1, dtype=np.int64), np.arange(n), 0, []
        while len(left):
            size = 2 * len(left)
            cell = self._cells([c[left] for c in columns], len(self.levels), size)
            alone = np.bincount(cell, minlength=size)[cell] == 1
            bits = np.zeros(size, dtype=bool)
            bits[cell[alone]] = True
            rank = np.cumsum(bits) - 1 + taken
            slot[left[alone]] = rank[cell[alone]]
            self.levels.append((size, bits, rank))
            taken += int(alone.sum())
            left = left[~alone]
        self.stored = [np.empty_like(c) for c in columns]
        for kept, c in zip(self.stored, columns):
            kept[slot] = c

    def __len__(self) -> int:
        return len(self.stored[0])

    @staticmethod
    def _cells(columns: list[np.ndarray], level: int, size: int) -> np.ndarray:
        h = np.full(len(columns[0]), 0x9E3779B97F4A7C15 * (2 * level + 1) % 2**64, dtype=np.uint64)
        for c in columns:
            h = (h ^ c.view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
            h = h * np.uint64(0x94D049BB133111EB)
            h ^= h >> np.uint64(32)
        return (h % np.uint64(size)).astype(np.int64)

    def find(self, columns: list[np.ndarray]) -> np.ndarray:
        """Slots of keys; -1 for keys that are not stored."""
        out, left = np.full(len(columns[0]), -1, dtype=np.int64), np.arange(len(columns[0]))
        for level, (size, bits, rank) in enumerate(self.levels):
            part = [c[left] for c in columns]
            cell = self._cells(part, level, size)
            at = np.where(bits[cell], rank[cell], 0)
            hit = bits[cell]
            for kept, c in zip(self.stored, part):
                hit &= kept[at] == c
            out[left[hit]] = at[hit]
            left = left[~hit]
            if not len(left):
                break
        return out


def _bases(seed: int) -> np.ndarray:
    draws = hashlib.sha256(f"prefix trie {seed}".encode()).digest()
    return np.frombuffer(draws, dtype="<u4")[:LANES].astype(np.int64) % (PRIME - 1000) + 500


def _terms(keys: np.ndarray, depths: np.ndarray, seed: int) -> np.ndarray:
    """What each turn at its depth adds to the digest: (rows, lanes)."""
    lanes = keys[:, :LANES].astype(np.int64) % PRIME
    for lane, base in enumerate(_bases(seed)):
        power, square, left = np.ones(len(depths), dtype=np.int64), int(base), depths.copy()
        while left.any():
            power = np.where(left & 1, power * square % PRIME, power)
            square, left = square * square % PRIME, left >> 1
        lanes[:, lane] = lanes[:, lane] * power % PRIME
    return lanes


def _turn_keys(packed) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(x) for x in packed), dtype="<u4").reshape(-1, KEY_BYTES // 4)


def _positions(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(segment, place in it from 0) of each row of segments of ``counts`` rows."""
    seg = np.repeat(np.arange(len(counts)), counts)
    return seg, np.arange(len(seg)) - np.repeat(np.cumsum(counts) - counts, counts)


# --- segments -----------------------------------------------------------------------

PACKED = "conv_id long, part int, seq long, n long, keys binary, lens array<long>"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, seq = TaskContext.get().partitionId(), 0
    for batch in batches:
        conv = batch.column("conv_id").to_numpy()
        keys, lens = batch.column("key").to_pylist(), batch.column("len").to_pylist()
        cuts = np.flatnonzero(np.diff(conv)) + 1
        begins = np.concatenate(([0], cuts)) if len(conv) else cuts
        ends = np.append(cuts, len(conv))
        spans = [(a, min(a + SEGMENT, e)) for b, e in zip(begins.tolist(), ends.tolist()) for a in range(b, e, SEGMENT)]
        if spans:
            yield pa.RecordBatch.from_pydict({
                "conv_id": pa.array([conv[a] for a, _ in spans], pa.int64()),
                "part": pa.array([part] * len(spans), pa.int32()),
                "seq": pa.array(range(seq, seq + len(spans)), pa.int64()),
                "n": pa.array([e - a for a, e in spans], pa.int64()),
                "keys": pa.array([b"".join(keys[a:e]) for a, e in spans], pa.binary()),
                "lens": pa.array([lens[a:e] for a, e in spans], pa.list_(pa.int64()))})
        seq += len(spans)


def pack_turns(conversations: DataFrame) -> DataFrame:
    """Segments of each conversation's original turns, in order of turn, null
    first, equal turns by the SHA-256 of role and text."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    key = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), key.alias("key"),
        F.length(text).cast("long").alias("len"), F.rand(7).alias("salt"))  # the salt deals out repeated rows
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("key"), F.col("salt")]
    packed = turns.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "key", "len").mapInArrow(_packed, PACKED)
    return shared_table(packed, "trie-turns")


def _base(conv: Column) -> Column:
    return conv - conv % GROUP


def _borrowed(conv: Column) -> Column:
    return F.crc32(conv.cast("string").cast("binary")) % (MAX_BORROWED + 1)


def rebuilt_segments(turns: DataFrame, seed: int = 0) -> DataFrame:
    """(conv_id, base, head, start, n, n_all, keys, lens, c0..c3, e0..e3): the
    segments of the rebuilt conversations; ``start`` turns lie before one,
    whose digest is c; e is the digest at its end.  Each conversation has one
    head segment, maybe empty, that also stands for the root."""
    by_place = Window.partitionBy("conv_id").orderBy("part", "seq")
    conv = F.col("conv_id")
    placed = turns.withColumn("end", F.sum("n").over(by_place)).withColumn("start", F.col("end") - F.col("n")).withColumn("h", _borrowed(conv))
    firsts = (
        placed.filter((conv % GROUP == 0) & (F.col("start") < MAX_BORROWED))
        .select(conv.alias("base"), "start", "keys", "lens",
                F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("n"), MAX_BORROWED - F.col("start")))).alias("i"))
        .select("base", F.struct((F.col("start") + F.col("i")).alias("pos"),
                                 F.expr(f"substring(keys, cast({KEY_BYTES} * (i - 1) + 1 as int), {KEY_BYTES})").alias("key"),
                                 F.expr("element_at(lens, cast(i as int))").alias("len")).alias("turn"))
        .groupBy("base").agg(F.sort_array(F.collect_list("turn")).alias("first")))  # MAX_BORROWED at most
    none = F.expr(f"cast(array() as {firsts.schema['first'].dataType.simpleString()})")
    convs = turns.groupBy("conv_id").agg(F.sum("n").alias("n_own")).withColumn("h", _borrowed(conv)).withColumn("base", _base(conv))
    convs = convs.join(firsts, "base", "left").withColumn("taken", F.coalesce(F.expr("slice(first, 1, cast(h as int))"), none))
    convs = convs.withColumn("k", F.size("taken").cast("long")).withColumn(
        "n_all", F.col("k") + F.greatest(F.lit(0).cast("long"), F.col("n_own") - F.col("h")))
    heads = convs.select(
        "conv_id", "base", F.lit(True).alias("head"), F.lit(0).cast("long").alias("start"), F.col("k").alias("n"), "n_all",
        F.expr("aggregate(taken, X'', (a, x) -> concat(a, x.key))").alias("keys"), F.expr("transform(taken, x -> x.len)").alias("lens"))
    drop = F.greatest(F.lit(0).cast("long"), F.col("h") - F.col("start"))
    own = placed.filter(F.col("end") > F.col("h")).withColumn("drop", drop).join(convs.select("conv_id", "base", "k", "n_all"), "conv_id").select(
        "conv_id", "base", F.lit(False).alias("head"), (F.col("k") + F.greatest(F.lit(0).cast("long"), F.col("start") - F.col("h"))).alias("start"),
        (F.col("n") - F.col("drop")).alias("n"), "n_all",
        F.expr(f"substring(keys, cast({KEY_BYTES} * drop + 1 as int), cast({KEY_BYTES} * n as int))").alias("keys"),
        F.expr("slice(lens, cast(drop as int) + 1, cast(n as int))").alias("lens"))

    @F.pandas_udf("s0 long, s1 long, s2 long, s3 long")
    def digest_sums(keys: pd.Series, start: pd.Series, n: pd.Series) -> pd.DataFrame:
        counts = n.to_numpy(dtype=np.int64)
        seg, place = _positions(counts)
        out = np.zeros((len(counts), LANES), dtype=np.int64)
        if len(seg):
            np.add.at(out, seg, _terms(_turn_keys(keys), start.to_numpy(dtype=np.int64)[seg] + place + 1, seed))
        return pd.DataFrame(out % PRIME, columns=[f"s{i}" for i in range(LANES)])

    segments = heads.unionByName(own).withColumn("s", digest_sums("keys", "start", "n"))
    along = Window.partitionBy("conv_id").orderBy(F.col("head").desc(), "start")
    sums = {}
    for i in range(LANES):
        upto = F.sum(f"s.s{i}").over(along.rowsBetween(Window.unboundedPreceding, 0))
        sums[f"e{i}"] = upto % PRIME
        sums[f"c{i}"] = (upto - F.col(f"s.s{i}")) % PRIME
    return shared_table(segments.withColumns(sums).drop("s"), "trie-segments")


# --- shards -------------------------------------------------------------------------

class Shard:
    """The rows of some segments: one for each turn, and the root before a head."""

    def __init__(self, pdf: pd.DataFrame, seed: int):
        head, start, n = pdf["head"].to_numpy(dtype=bool), pdf["start"].to_numpy(dtype=np.int64), pdf["n"].to_numpy(dtype=np.int64)
        counts = n + head
        self.seg, place = _positions(counts)
        self.depth = (start + ~head)[self.seg] + place
        turn = self.depth > 0
        keys = np.zeros((len(self.seg), KEY_BYTES // 4), dtype="<u4")
        keys[turn] = _turn_keys(pdf["keys"])
        self.length = np.zeros(len(self.seg), dtype=np.int64)
        if turn.any():
            self.length[turn] = np.concatenate([np.asarray(x, dtype=np.int64) for x in pdf["lens"]])
        terms = _terms(keys, self.depth, seed)
        terms[~turn] = 0
        first = np.cumsum(counts) - counts
        last = np.cumsum(counts) - 1
        total = np.cumsum(terms, axis=0)
        before = np.where((first > 0)[:, None], total[np.maximum(first, 1) - 1], 0)
        carry = pdf[[f"c{i}" for i in range(LANES)]].to_numpy(dtype=np.int64)
        lanes = (total - before[self.seg] + carry[self.seg]) % PRIME
        parent = np.zeros_like(lanes)
        parent[1:] = lanes[:-1]
        parent[first] = carry
        self.d0, self.d1 = lanes[:, 0] << 31 | lanes[:, 1], lanes[:, 2] << 31 | lanes[:, 3]
        self.p0, self.p1 = parent[:, 0] << 31 | parent[:, 1], parent[:, 2] << 31 | parent[:, 3]
        self.k0, self.k1 = (np.ascontiguousarray(keys[:, i:i + 2]).view(np.int64).ravel() for i in (0, 2))
        self.conv, self.n_all = pdf["conv_id"].to_numpy(dtype=np.int64)[self.seg], pdf["n_all"].to_numpy(dtype=np.int64)[self.seg]
        # segments that go on where the one before ends are one run
        conv = pdf["conv_id"].to_numpy(dtype=np.int64)
        goes_on = np.zeros(len(conv), dtype=bool)
        goes_on[1:] = (conv[1:] == conv[:-1]) & ~head[1:] & (start[1:] == start[:-1] + n[:-1])
        top = np.where(goes_on, 0, np.where(head, 0, start + 1))
        run = np.cumsum(~goes_on) - 1
        self.top = top[~goes_on][run][self.seg]
        ends_run = np.append(~goes_on[1:], True)
        self.run_ends, self.run_end_seg = last[ends_run], np.flatnonzero(ends_run)

    def slots(self, with_top: bool) -> tuple[Slots, np.ndarray, np.ndarray]:
        """(slots, slot of each row, a row of each slot).  With ``with_top``
        rows of runs that begin at different depths have slots of their own."""
        key = [self.d0, self.d1, self.depth] + [self.top] * with_top
        order = np.lexsort(key)
        new = np.ones(len(order), dtype=bool)
        new[1:] = np.any([c[order][1:] != c[order][:-1] for c in key], axis=0)
        slots = Slots([c[order[new]] for c in key])
        found = slots.find(key)
        if len(found) and found.min() < 0:
            raise AssertionError("a stored prefix digest was not found")
        sample = np.empty(len(slots), dtype=np.int64)
        sample[found] = np.arange(len(found))
        return slots, found, sample


def _slices(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The segments of a shard in slices of about ``SLICE_TURNS`` turns."""
    held, turns = [], 0
    for pdf in pdfs:
        if not len(pdf):
            continue
        upto = turns + np.cumsum(pdf["n"].to_numpy(dtype=np.int64) + 1)
        cuts = (np.flatnonzero(np.diff(upto // SLICE_TURNS)) + 1).tolist()
        for i, (begin, end) in enumerate(zip([0, *cuts], [*cuts, len(pdf)])):
            if i:
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(pdf.iloc[begin:end])
        turns = int(upto[-1] % SLICE_TURNS)
    if held:
        yield pd.concat(held, ignore_index=True)


def _dealt(segments: DataFrame) -> DataFrame:
    """Segments by shard: those that borrow from one conversation together, a
    long conversation by spans."""
    return segments.repartition("base", F.floor(F.col("start") / SPAN)).sortWithinPartitions("conv_id", F.col("head").desc(), "start")


NODE = ["depth", "d0", "d1"]
WITNESS = ["p0", "p1", "k0", "k1"]


def trie_nodes(segments: DataFrame, seed: int = 0) -> DataFrame:
    """A row for each node: its digest, the parent's (p0, p1), n_convs, the
    smallest member, ``deepest`` (turns of its longest member) and whether all
    members agree on parent and last turn (``sound``)."""
    schema = ", ".join(f"{c} long" for c in NODE + WITNESS + ["n_convs", "conv_id", "deepest"]) + ", sound boolean"

    def local(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _slices(pdfs):
            shard = Shard(pdf, seed)
            slots, at, row = shard.slots(with_top=False)
            least = np.full(len(slots), np.iinfo(np.int64).max)
            np.minimum.at(least, at, shard.conv)
            deepest = np.zeros(len(slots), dtype=np.int64)
            np.maximum.at(deepest, at, shard.n_all)
            sound = np.ones(len(slots), dtype=bool)
            for c in WITNESS:
                v = getattr(shard, c)
                sound[at[v != v[row][at]]] = False
            yield pd.DataFrame({
                "depth": slots.stored[2], "d0": slots.stored[0], "d1": slots.stored[1],
                **{c: getattr(shard, c)[row] for c in WITNESS}, "n_convs": np.bincount(at, minlength=len(slots)),
                "conv_id": least, "deepest": deepest, "sound": sound})

    parts = _dealt(segments).mapInPandas(local, schema)
    nodes = parts.groupBy(*NODE).agg(
        F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("deepest").alias("deepest"),
        F.every("sound").alias("sound"), *[F.min(c).alias(c) for c in WITNESS], *[F.max(c).alias(f"{c}_max") for c in WITNESS])
    agree = F.col("sound")
    for c in WITNESS:
        agree = agree & (F.col(c) == F.col(f"{c}_max"))
    return shared_table(nodes.select(*NODE, "p0", "p1", "n_convs", "conv_id", "deepest", agree.alias("sound")), "trie-nodes")


def subtree_sums(segments: DataFrame, nodes: DataFrame, seed: int = 0) -> DataFrame:
    """(depth, d0, d1, saved_tokens, n_leaves), a row for each node.

    A member owns the nodes whose smallest member it is: a last part of its
    path.  Each member adds the characters of the turns that it does not own,
    and a leaf if it owns one, to all its nodes above."""
    owners = nodes.groupBy("conv_id").agg(F.min("depth").alias("own_from"), F.max_by(F.col("deepest") == F.col("depth"), "depth").alias("leaf"))
    with_owner = segments.join(owners, "conv_id", "left").withColumn(
        "own_from", F.coalesce("own_from", F.col("n_all") + 1)).withColumn("leaf", F.coalesce("leaf", F.lit(False)))
    foreign = F.expr("aggregate(slice(lens, 1, cast(least(n, greatest(0, own_from - 1 - start)) as int)), 0L, (a, x) -> a + x)")
    along = Window.partitionBy("conv_id").orderBy(F.col("head").desc(), "start")
    tailed = with_owner.withColumn("foreign", foreign).withColumn(
        "beyond", F.coalesce(F.sum("foreign").over(along.rowsBetween(1, Window.unboundedFollowing)), F.lit(0)))
    schema = ", ".join(f"{c} long" for c in NODE + ["saved_tokens", "n_leaves"])

    def local(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _slices(pdfs):
            shard = Shard(pdf, seed)
            slots, at, row = shard.slots(with_top=True)
            own_from, beyond, leaf = (pdf[c].to_numpy(dtype=np.int64) for c in ("own_from", "beyond", "leaf"))
            saved, leaves = np.zeros(len(slots), dtype=np.int64), np.zeros(len(slots), dtype=np.int64)
            np.add.at(saved, at, np.where(shard.depth < own_from[shard.seg], shard.length, 0))
            np.add.at(saved, at[shard.run_ends], beyond[shard.run_end_seg])
            np.add.at(leaves, at[shard.run_ends], leaf[shard.run_end_seg])
            # the row before is the parent's, but for the first row of a run
            depth, top = slots.stored[2], slots.stored[3]
            parent = np.where(depth > top, at[np.maximum(row, 1) - 1], -1)
            order = np.argsort(-depth, kind="stable")
            for level in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
                level = level[parent[level] >= 0]
                np.add.at(saved, parent[level], saved[level])
                np.add.at(leaves, parent[level], leaves[level])
            yield pd.DataFrame({"depth": depth, "d0": slots.stored[0], "d1": slots.stored[1], "saved_tokens": saved, "n_leaves": leaves})

    return _dealt(tailed).mapInPandas(local, schema).groupBy(*NODE).agg(
        F.sum("saved_tokens").alias("saved_tokens"), F.sum("n_leaves").alias("n_leaves"))


def ends_digests(segments: DataFrame) -> DataFrame:
    """(depth, d0, d1, ends_sha256) of the nodes where conversations end.

    A SHA-256 is computed in one go, so the ids of one node are hashed by one
    task; they come to it in order, as packed rows of ``CHUNK_IDS`` ids, and
    are held one batch at a time."""
    lane = [F.col(f"e{i}") for i in range(LANES)]
    ends = segments.filter(F.col("start") + F.col("n") == F.col("n_all")).select(
        F.col("n_all").alias("depth"), (F.shiftleft(lane[0], 31) + lane[1]).alias("d0"), (F.shiftleft(lane[2], 31) + lane[3]).alias("d1"), "conv_id")

    def packed(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            if not len(pdf):
                continue
            cols = [pdf[c].to_numpy() for c in NODE]
            ids = pdf["conv_id"].to_numpy()
            cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
            begins, ends_ = np.concatenate(([0], cuts)), np.append(cuts, len(pdf))
            spans = [(a, min(a + CHUNK_IDS, e)) for b, e in zip(begins.tolist(), ends_.tolist()) for a in range(b, e, CHUNK_IDS)]
            at = np.array([a for a, _ in spans])
            yield pd.DataFrame({**{c: v[at] for c, v in zip(NODE, cols)}, "first": ids[at],
                                "ids": [",".join(map(str, ids[a:e].tolist())) for a, e in spans]})

    def hashed(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, state = None, None
        for pdf in pdfs:
            out = []
            for key, ids in zip(pdf[NODE].itertuples(index=False, name=None), pdf["ids"]):
                if key == node:
                    state.update(b",")
                else:
                    if node is not None:
                        out.append((*node, state.hexdigest()))
                    node, state = key, hashlib.sha256()
                state.update(ids.encode())
            yield pd.DataFrame(out, columns=[*NODE, "ends_sha256"])
        if node is not None:
            yield pd.DataFrame([(*node, state.hexdigest())], columns=[*NODE, "ends_sha256"])

    longs = ", ".join(f"{c} long" for c in NODE)
    order = [*NODE, "conv_id"]
    chunks = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(packed, f"{longs}, first long, ids string")
    return chunks.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInPandas(hashed, f"{longs}, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256), a row for each node of the rebuilt
    conversations.

    Null roles and texts are empty; null turns come first; turns of one number
    and repeated rows all count, in the order of their SHA-256.  Rows without
    conv_id belong to no conversation.  Empty input: no rows.  Other columns
    are not read."""
    turns = pack_turns(conversations)
    for seed in range(SEEDS):
        segments = rebuilt_segments(turns, seed)
        nodes = trie_nodes(segments, seed)
        if nodes.filter(~F.col("sound")).isEmpty():
            break
    else:
        raise RuntimeError(f"prefix digests collide with {SEEDS} bases")
    parent = [F.col(c).alias(p) for c, p in zip(NODE, ["up", "p0", "p1"])]
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p0").alias("d0"), F.col("p1").alias("d1")).agg(
        F.count(F.lit(1)).alias("n_children"))
    named = nodes.withColumn("up", F.col("depth") - 1).join(
        nodes.select(*parent, F.col("conv_id").alias("parent_conv_id")), ["up", "p0", "p1"], "left")
    out = named.join(children, NODE, "left").join(subtree_sums(segments, nodes, seed), NODE, "left").join(ends_digests(segments), NODE, "left")
    zero = F.lit(0).cast("long")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
