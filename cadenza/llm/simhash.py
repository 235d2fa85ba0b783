"""SimHash near-duplicates with a Gray-order hierarchical index.

A fingerprint has 64 bits; fingerprints link at ``max_bits`` or fewer
differing bits.  Linking works on distinct fingerprints:

1. They are range-partitioned by their rank in the reflected Gray code, in
   which neighbours differ in few bits.  A partition is a *region*; it is cut
   into *blocks* of ``block`` fingerprints and those into *leaves*.
2. Regions, blocks and leaves are the levels of the index.  A node keeps the
   bits on which all its fingerprints agree (mask and pattern).
3. Every block is also a batch of queries.  It is routed to regions, then to
   the blocks of each region, then to leaves; a query's differences on shared
   bits are accumulated on the way down, and a node is pruned for the queries
   that exceed ``max_bits`` there.  Only the last step compares fingerprints.
4. A task unites what it linked and emits a spanning forest, never all pairs
   of a group; connected components are then taken over those edges.

Sizes: the driver and each task hold one node for each region, at most
``MAX_REGIONS``; everything else moves as rows of at most ``block``
fingerprints or of one region's nodes.  Identical fingerprints are one row,
so a group of exact copies of any size costs one query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.components import connected_components
from cadenza.llm.shared import shared_table

SHINGLE_WORDS = 3
MAX_BITS = 2
HASH_SEED = 42
BLOCK = 512
LEAF = 16
MAX_REGIONS = 4096
FOREST_NODES = 1_000_000  # a task hands its forest on before it grows beyond
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, shingle: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit SimHash of a whole text: A-Z lower-cased, word shingles
    with repeats, XXH64 with seed 42, a bit set if over half the hashes have
    it.  Fewer words than a shingle: the whole sequence; none (or null): 0."""
    words = text.encode("utf-8").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, HASH_SEED)], dtype=np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        n = len(words) - shingle + 1
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(joined[a:b], HASH_SEED) for a, b in zip(starts[:n].tolist(), ends[shingle - 1:].tolist())),
                             dtype=np.uint64, count=n)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at:at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.flatnonzero(2 * ones > len(hashes))
    return sum(1 << int(b) for b in bits)


def fingerprint_column(text: Column | str, shingle: int = SHINGLE_WORDS) -> Column:
    """The fingerprint as a long with the same 64 bits."""

    @F.pandas_udf("long")
    def fingerprints(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))

    return fingerprints(text)


def gray_order(bits: Column) -> Column:
    """Rank of a code in the reflected Gray code, shifted so that the order of
    signed longs is the order of ranks."""
    for by in (1, 2, 4, 8, 16, 32):
        bits = bits.bitwiseXOR(F.shiftrightunsigned(bits, by))
    return bits.bitwiseXOR(F.lit(-(2**63)).cast("long"))


def _shared(ands: np.ndarray, ors: np.ndarray) -> np.ndarray:
    """Mask of the bits on which all fingerprints of a node agree; its pattern
    is ``ands``, which has the agreed ones."""
    return ~(ands ^ ors)


def _u64(x) -> np.ndarray:
    return np.asarray(x, dtype=np.int64).view(np.uint64)


def _blocks(block: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One region, sorted by rank, as rows of up to ``block`` fingerprints."""
    parts = [b for b in batches if len(b)]
    if not parts:
        return
    region = int(parts[0]["region"].iloc[0])
    rank = np.concatenate([b["rank"].to_numpy() for b in parts])
    codes = _u64(np.concatenate([b["fp"].to_numpy() for b in parts]))[np.argsort(rank)]
    for k, at in enumerate(range(0, len(codes), block)):
        own = codes[at:at + block]
        yield pd.DataFrame({
            "region": [region], "block": [region * 2**32 + k], "codes": [own.tobytes()],
            "b_and": np.array([np.bitwise_and.reduce(own)]).view(np.int64), "b_or": np.array([np.bitwise_or.reduce(own)]).view(np.int64)})


def _to_regions(nodes: tuple, max_bits: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks, as queries, to the regions at or after their own."""
    regions, ands, masks = nodes
    for batch in batches:
        out = []
        for own, block, a, o, raw in zip(batch["region"], batch["block"], _u64(batch["b_and"]), _u64(batch["b_or"]), batch["codes"]):
            # the block's own shared bits prune whole regions for all its queries
            far = np.bitwise_count((a ^ ands) & masks & _shared(a, o)) > max_bits
            codes = np.frombuffer(raw, dtype=np.uint64)
            for r in np.flatnonzero(~far & (regions >= own)):
                diff = np.bitwise_count((codes ^ ands[r]) & masks[r])
                if (near := diff <= max_bits).any():
                    out.append((int(regions[r]), int(block), codes[near].tobytes(), diff[near].astype(np.uint8).tobytes()))
        if out:
            yield pd.DataFrame(out, columns=["region", "query_block", "queries", "diffs"])


def _to_blocks(max_bits: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Routed queries of a region to its blocks at or after their own."""
    for batch in batches:
        out = []
        for own, raw, diffs, r_and, r_or, blocks, ands, ors in zip(*(batch[c] for c in (
                "query_block", "queries", "diffs", "r_and", "r_or", "blocks", "ands", "ors"))):
            codes, acc = np.frombuffer(raw, dtype=np.uint64), np.frombuffer(diffs, dtype=np.uint8)
            above = _shared(*_u64([r_and, r_or]))
            ands, ors = _u64(ands), _u64(ors)
            masks = _shared(ands, ors) & ~above  # what the region has not compared yet
            for b, pattern, mask in zip(blocks, ands, masks):
                if b >= own:
                    near = acc + np.bitwise_count((codes ^ pattern) & mask) <= max_bits
                    if near.any():
                        out.append((int(b), codes[near].tobytes()))
        if out:
            yield pd.DataFrame(out, columns=["block", "queries"])


def near_pairs(queries: np.ndarray, codes: np.ndarray, max_bits: int, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """Indices (query, code) of all pairs within ``max_bits``: leaves of
    ``leaf`` codes are pruned by their shared bits first."""
    edges = np.arange(0, len(codes), leaf)
    ands, ors = np.bitwise_and.reduceat(codes, edges), np.bitwise_or.reduceat(codes, edges)
    masks = _shared(ands, ors)
    q, at = np.nonzero(np.bitwise_count((queries[:, None] ^ ands) & masks) <= max_bits)
    where = at[:, None] * leaf + np.arange(leaf)
    inside = where < len(codes)
    where = np.minimum(where, len(codes) - 1)
    hit = inside & (np.bitwise_count(queries[q][:, None] ^ codes[where]) <= max_bits)
    row, col = np.nonzero(hit)
    return q[row], where[row, col]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (a, b) as stars around the smallest member of each component."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = index[:len(a)], index[len(a):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        while not np.array_equal(new, nxt := new[new]):
            new = nxt
        new = new[root]
        if np.array_equal(new, root):
            break
        root = new
    leaves = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[leaves], nodes[root[leaves]]


def _match(max_bits: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Joined (queries, codes) rows to forest edges of the whole task."""
    a = b = np.empty(0, dtype=np.uint64)
    for batch in batches:
        found = [(a, b)]
        for raw_q, raw_c in zip(batch["queries"], batch["codes"]):
            queries, codes = np.frombuffer(raw_q, dtype=np.uint64), np.frombuffer(raw_c, dtype=np.uint64)
            i, j = near_pairs(queries, codes, max_bits)
            i, j = queries[i], codes[j]
            if (proper := i != j).any():
                found.append(forest(i[proper], j[proper]))
        a, b = forest(np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]))
        if len(a) > FOREST_NODES:
            yield pd.DataFrame({"src": a.view(np.int64), "dst": b.view(np.int64)})
            a = b = np.empty(0, dtype=np.uint64)
    if len(a):
        yield pd.DataFrame({"src": a.view(np.int64), "dst": b.view(np.int64)})


def hamming_edges(codes: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """``codes`` (fp long, distinct).  Edges (src, dst) whose components are
    those of all pairs within ``max_bits`` bits.  No codes: no edges."""
    spark = codes.sparkSession
    n = codes.count()
    regions = max(1, min(MAX_REGIONS, math.ceil(math.sqrt(n / block))))
    ranked = codes.select("fp", gray_order(F.col("fp")).alias("rank")).repartitionByRange(regions, "rank")
    blocks = shared_table(
        ranked.withColumn("region", F.spark_partition_id().cast("long")).mapInPandas(
            lambda batches: _blocks(block, batches), "region long, block long, codes binary, b_and long, b_or long"), "gray-blocks")
    region_nodes = shared_table(blocks.groupBy("region").agg(
        F.bit_and("b_and").alias("r_and"), F.bit_or("b_or").alias("r_or"),
        F.array_sort(F.collect_list(F.struct("block", "b_and", "b_or"))).alias("own"),
    ).select("region", "r_and", "r_or", F.col("own.block").alias("blocks"), F.col("own.b_and").alias("ands"),
             F.col("own.b_or").alias("ors")), "gray-regions")
    top = region_nodes.select("region", "r_and", "r_or").toPandas()  # one node for each region
    ands = _u64(top["r_and"])
    nodes = (top["region"].to_numpy(), ands, _shared(ands, _u64(top["r_or"])))
    routed = blocks.mapInPandas(lambda batches: _to_regions(nodes, max_bits, batches),
                                "region long, query_block long, queries binary, diffs binary")
    routed = routed.join(region_nodes, "region").mapInPandas(
        lambda batches: _to_blocks(max_bits, batches), "block long, queries binary")
    matched = routed.join(blocks.select("block", "codes"), "block")
    return matched.select("queries", "codes").mapInPandas(lambda batches: _match(max_bits, batches), "src long, dst long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> tuple[DataFrame, DataFrame]:
    """Fingerprints and near-duplicate components of whole texts.

    Returns two tables of the shared folder: (doc_id, fp) with a row for each
    input row, and (fp, component, component_id) with a row for each distinct
    fingerprint: ``component`` is the least fingerprint (as a long) reachable,
    ``component_id`` the least doc_id.

    Null and empty texts have fingerprint zero and link like any other.  Rows
    with a null id take part; their id is never the least unless no member
    has one (then null).  Repeated rows each keep a row.  Empty input: empty
    tables.  Other columns are not read."""
    fps = shared_table(docs.select(F.col(id_col).alias("doc_id"), fingerprint_column(F.col(text_col), shingle).alias("fp")),
                       "simhash-fp")
    distinct = shared_table(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-distinct")
    linked = connected_components(hamming_edges(distinct.select("fp"), max_bits))
    known = shared_table(
        distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left")
        .select("fp", "least_id", F.coalesce("component", "fp").alias("component")), "simhash-known")
    least = known.groupBy("component").agg(F.min("least_id").alias("component_id"))
    classes = shared_table(known.select("fp", "component").join(least, "component"), "simhash-classes")
    return fps, classes.select("fp", "component", "component_id")


def simhash_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                            shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint of 16 hex digits, component_id), a row for each
    document; see :func:`simhash_components` for nulls, ties and empties."""
    fps, classes = simhash_components(docs, id_col, text_col, shingle, max_bits)
    return fps.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                           shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each near-duplicate component: the one with the
    least id (a null id only where no member has one; of rows that share that
    id, one).  All columns are returned as they were.

    Rows with an id of their own are told apart by it: texts move once, in an
    anti-join with the ids that go.  Only rows that share an id or have none
    are told apart by fingerprint and component."""
    fps, classes = simhash_components(docs, id_col, text_col, shingle, max_bits)
    shared_ids = shared_table(fps.groupBy("doc_id").count().filter("doc_id IS NOT NULL AND count > 1").select("doc_id"), "simhash-shared-ids")
    copies = fps.join(classes, "fp").filter(F.col("doc_id") != F.col("component_id")).select("doc_id")
    going = shared_table(copies.unionByName(shared_ids).distinct().withColumnRenamed("doc_id", "going"), "simhash-going")
    # the ids grow with the documents, so they are never broadcast
    own = docs.filter(F.col(id_col).isNotNull())
    own = own.join(going.hint("merge"), own[id_col] == going["going"], "left_anti")
    row = F.struct(*docs.columns)
    held = docs.select(row.alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("held_text"))
    alike = held.filter("id IS NULL").unionByName(held.join(shared_ids, held["id"] == shared_ids["doc_id"], "left_semi"))
    best = alike.select("row", "id", fingerprint_column(F.col("held_text"), shingle).alias("fp")).join(classes, "fp").filter(
        F.col("id").eqNullSafe(F.col("component_id")))
    return own.unionByName(best.dropDuplicates(["component"]).select("row.*"))
