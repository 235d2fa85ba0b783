"""Ranked lexical search over hashed max-sketches.

The index has a row for each document: its number of terms, its distinct terms
with their occurrences, and a sketch.  A sketch has at least two cells for each
distinct term; a term is hashed to one, and a cell keeps the most occurrences
of any of its terms, 255 for 255 and more.  A term's impact grows with its
occurrences, so the impact of a cell's maximum is at least that of each of its
terms, and the sum over the cells of a query's terms is an upper bound of the
document's score.

Queries are looked up in blocks: for each slice of documents one gather gives
the bounds of all queries of the block.  Documents are scored exactly in
descending order of their bounds until these fall below the score of the k-th
best so far.  A first round over every ``FIRST_SHARE``-th document (by hash)
gives a score that the k-th best of all cannot fall below; every task of the
second round, over all documents, starts from it.  Bounds and scores are
integers, nothing is rounded, and documents whose bound equals the threshold
are scored too, so ties are resolved by id.

A document's row is handled by the task that has it and a query's candidates
are at most k for each task, so neither a frequent word nor many copies make
one task long.  Blocks hold at most ``BLOCK_TERMS`` query terms (one query at
least), which bounds what is broadcast.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.shared import shared_table

TOP = 50
LEAST_CELLS = 64
FULL = 255  # of a cell: so many occurrences or more
FIRST_SHARE = 64
BLOCK_TERMS = 50_000
GATHER = 2_000_000  # values of a gathered slice
WEIGHT_SCALE = 1000
IMPACT = 1_000_000_000

_SPACED = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text: maximal runs of ASCII letters, digits and
    characters beyond ASCII, A-Z in lower case; null has none."""
    return bytes(text).translate(_SPACED).split() if text is not None else []


def sketch_of(terms: list[bytes], counts: np.ndarray) -> np.ndarray:
    """The cells of a document's distinct terms."""
    cells = np.zeros(max(LEAST_CELLS, 1 << (2 * len(terms) - 1).bit_length() if terms else 0), dtype=np.uint8)
    np.maximum.at(cells, hashes_of(terms) & (len(cells) - 1), np.minimum(counts, FULL).astype(np.uint8))
    return cells


def hashes_of(terms: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, terms), dtype=np.int64, count=len(terms))


INDEX = "doc_id long, n long, sketch binary, terms binary, counts binary"


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index, a written table with a row for each document that has a term."""

    def described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, text in enumerate(batch["text"]):
                found = Counter(terms_of(text))
                if found:
                    terms, counts = list(found), np.fromiter(found.values(), dtype=np.uint32, count=len(found))
                    rows.append((i, int(counts.sum(dtype=np.int64)), sketch_of(terms, counts).tobytes(), b" ".join(terms), counts.tobytes()))
            at, n, sketch, terms, counts = zip(*rows) if rows else [()] * 5
            yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[list(at)].to_numpy(), "n": list(n), "sketch": list(sketch),
                                "terms": list(terms), "counts": list(counts)})

    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return shared_table(read.mapInPandas(described, INDEX), "search-index")


@dataclass(frozen=True)
class Block:
    """Queries that are looked up together."""

    numbers: list[int]
    vocabulary: dict[bytes, int]
    queries: list[np.ndarray]  # places in the vocabulary

    @staticmethod
    def of(numbers: list[int], queries: list[list[bytes]]) -> Block:
        vocabulary: dict[bytes, int] = {}
        return Block(numbers, vocabulary, [np.array([vocabulary.setdefault(t, len(vocabulary)) for t in q], dtype=np.int64) for q in queries])


def query_table(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(q, item_id, terms): a written row for each item; q numbers them."""

    @F.pandas_udf("binary")
    def distinct_terms(texts: pd.Series) -> pd.Series:
        return pd.Series([b" ".join(dict.fromkeys(terms_of(t))) for t in texts], dtype=object)

    rows = items.select(F.col(id_col).alias("item_id"), distinct_terms(F.col(text_col).cast("binary")).alias("terms"))
    return shared_table(rows.withColumn("q", F.monotonically_increasing_id()), "search-queries")


def blocks(queries: DataFrame, block_terms: int = BLOCK_TERMS) -> Iterator[Block]:
    numbers, held, size = [], [], 0
    for row in queries.filter(F.length("terms") > 0).select("q", "terms").toLocalIterator():
        terms = bytes(row["terms"]).split()
        if held and size + len(terms) > block_terms:
            yield Block.of(numbers, held)
            numbers, held, size = [], [], 0
        numbers.append(row["q"])
        held.append(terms)
        size += len(terms)
    if held:
        yield Block.of(numbers, held)


def document_frequencies(index: DataFrame, vocabulary: dict[bytes, int]) -> np.ndarray:
    """In how many documents each word of a vocabulary occurs."""
    held = index.sparkSession.sparkContext.broadcast(vocabulary)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = held.value
        df = np.zeros(len(words), dtype=np.int64)
        for batch in batches:
            for terms in batch["terms"]:
                for t in words.keys() & bytes(terms).split():
                    df[words[t]] += 1
        at = np.flatnonzero(df)
        yield pd.DataFrame({"word": at, "df": df[at]})

    out = np.zeros(len(vocabulary), dtype=np.int64)
    for row in index.select("terms").mapInPandas(counted, "word long, df long").groupBy("word").agg(F.sum("df").alias("df")).collect():
        out[row["word"]] = row["df"]  # a row for each word of the block
    return out


def impact(tf, m):
    return IMPACT * tf // (1000 * tf + 20 * m)


class Searcher:
    """The best documents of each query of a block among those seen so far."""

    def __init__(self, block: Block, weights: np.ndarray, floor: np.ndarray, k: int):
        self.block, self.weights, self.k = block, weights, k
        self.words = list(block.vocabulary)
        self.hashes = hashes_of(self.words)
        self.flat = np.concatenate(block.queries)
        self.starts = np.cumsum([0] + [len(q) for q in block.queries[:-1]])
        self.by_query = [[(self.words[i], int(weights[i])) for i in q.tolist() if weights[i]] for q in block.queries]
        self.best: list[list[tuple]] = [[] for _ in block.queries]
        self.least = np.maximum(floor, 1)  # scores below are of no use

    def bounds(self, cells: np.ndarray, m: np.ndarray) -> np.ndarray:
        """(documents, queries): upper bounds from sketches of one length."""
        tf = cells[:, self.hashes & (cells.shape[1] - 1)]
        table = impact(np.arange(FULL + 1, dtype=np.int64)[None, :], m[:, None])
        table[:, FULL] = IMPACT // 1000  # more than any number of occurrences has
        weighted = np.take_along_axis(table, tf.astype(np.int64), axis=1) * self.weights
        return np.add.reduceat(weighted[:, self.flat], self.starts, axis=1)

    def add(self, batch: pd.DataFrame, m: np.ndarray) -> None:
        sketches = batch["sketch"].tolist()
        sizes = np.array([len(s) for s in sketches], dtype=np.int64)
        ids, terms, counts = batch["doc_id"].tolist(), batch["terms"].tolist(), batch["counts"].tolist()
        for size in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == size)
            step = max(1, GATHER // max(len(self.flat), size, FULL))
            for a in range(0, len(rows), step):
                part = rows[a:a + step]
                cells = np.frombuffer(b"".join(bytes(sketches[i]) for i in part), dtype=np.uint8).reshape(len(part), size)
                self._rescore(self.bounds(cells, m[part]), part, m, ids, terms, counts)

    def _rescore(self, bounds, part, m, ids, terms, counts) -> None:
        held: dict[int, dict[bytes, int]] = {}
        for q in np.flatnonzero((bounds >= self.least).any(axis=0)).tolist():
            likely = np.flatnonzero(bounds[:, q] >= self.least[q])
            best = self.best[q]
            for at in likely[np.argsort(-bounds[likely, q], kind="stable")].tolist():
                if bounds[at, q] < self.least[q]:
                    break  # so are all that follow
                i = int(part[at])
                if i not in held:
                    held[i] = dict(zip(bytes(terms[i]).split(), np.frombuffer(bytes(counts[i]), dtype=np.uint32).tolist()))
                document, dm, score = held[i], int(m[i]), 0
                for word, weight in self.by_query[q]:
                    if tf := document.get(word):
                        score += weight * impact(tf, dm)
                if score < self.least[q]:
                    continue
                null = ids[i] is None or ids[i] != ids[i]
                entry = (score, float("inf") if null else -int(ids[i]))
                if len(best) < self.k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
                if len(best) == self.k:
                    self.least[q] = max(self.least[q], best[0][0])

    def rows(self) -> pd.DataFrame:
        out = [(n, None if key == float("inf") else -key, score) for n, best in zip(self.block.numbers, self.best) for score, key in best]
        return pd.DataFrame(out, columns=["q", "doc_id", "score"], dtype=object)


def _look_up(index: DataFrame, block: Block, weights: np.ndarray, floor: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(q, doc_id, score): the k best documents of each query in each task."""
    held = index.sparkSession.sparkContext.broadcast((block, weights, floor))

    def searched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        searcher = Searcher(*held.value, k)
        for batch in batches:
            n = batch["n"].to_numpy(dtype=np.int64)
            searcher.add(batch, 50 + (50 * n * n_docs) // n_terms)
        yield searcher.rows()

    return index.mapInPandas(searched, "q long, doc_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def search(index: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "item_id", text_col: str = "text",
           block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of an index for
    each item, equal scores by ascending doc_id, null first.

    Null and empty items, and items without a word of the index, have no rows.
    Items with one id, and rows of documents with one id, are ranked each on
    its own.  Empty input: no rows.  Other columns are not read."""
    totals = index.agg(F.count(F.lit(1)).alias("N"), F.sum("n").alias("L")).first()
    queries = query_table(items, id_col, text_col)
    found = None
    for block in blocks(queries, block_terms) if totals["N"] else ():
        df = document_frequencies(index, block.vocabulary)
        weights = np.where(df > 0, np.floor(WEIGHT_SCALE * np.log((2 * totals["N"] + 2) / (2 * df + 1))), 0).astype(np.int64)
        args = block, weights
        first = index.filter(F.pmod(F.xxhash64("doc_id"), F.lit(FIRST_SHARE)) == 0)
        start = _ranked(_look_up(first, *args, np.zeros(len(block.queries), dtype=np.int64), totals["N"], totals["L"], k), k)
        floor = dict.fromkeys(block.numbers, 0)
        for row in start.filter(F.col("rank") == k).collect():  # a row for each query of the block
            floor[row["q"]] = row["score"]
        part = _look_up(index, *args, np.array([floor[q] for q in block.numbers], dtype=np.int64), totals["N"], totals["L"], k)
        part = shared_table(_ranked(part, k), "search-ranked")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = index.sparkSession.createDataFrame([], "q long, doc_id long, score long, rank int")
    return found.join(queries.select("q", "item_id"), "q").select("item_id", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """Index ``docs`` and :func:`search` them."""
    return search(build_index(docs), items, k)
