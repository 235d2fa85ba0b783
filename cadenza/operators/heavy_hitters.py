"""The top terms of each cluster without shuffling the vocabulary.

Each task keeps, for each cluster, a summary of at most ``capacity`` terms
(Misra-Gries, merged batch by batch): when there are more, the count of the one
after is taken off all, and terms left without a count go.  A term's true count
is at most its summary's count plus what was taken off.  Summaries of all tasks
add up, and so do the amounts taken off.

The terms whose upper bound reaches the n-th largest summed count are the
candidates; they alone are counted exactly.  If the n-th exact count of a
cluster exceeds all that was taken off there, no other term can be among its top
n, and the result is proven; a cluster where it does not is counted in full.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza import constants as K
from cadenza.functions.text import theme_tokens
from cadenza.session import checkpoint_dir

CAPACITY = 4096


def _reduced(counts: pd.Series, capacity: int) -> tuple[pd.Series, int]:
    """A summary cut to its capacity, and what was taken off each term."""
    if len(counts) <= capacity:
        return counts, 0
    off = int(np.partition(counts.to_numpy(), len(counts) - capacity - 1)[len(counts) - capacity - 1])
    counts = counts - off
    return counts[counts > 0], off


def _written(df: DataFrame, name: str) -> DataFrame:
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def term_summaries(tokens: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``(cluster, term, n, off, chars)``: the summaries of all tasks over
    ``(cluster, terms)``; a row with a null term has a task's amount taken off,
    its tokens (n) and their characters."""

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for pdf in batches:
            for cluster, part in pdf.groupby("cluster", dropna=False):
                words = np.concatenate([np.zeros(0, dtype=object), *part["terms"].dropna().to_numpy()])
                if not len(words):
                    continue
                counts, off, n, chars = held.get(cluster, (pd.Series(dtype="int64"), 0, 0, 0))
                new = pd.Series(words, dtype=object).value_counts()
                chars += int((new.index.str.len().to_numpy() * new.to_numpy()).sum())
                counts, taken = _reduced(counts.add(new, fill_value=0).astype("int64"), capacity)
                held[cluster] = counts, off + taken, n + len(words), chars
        for cluster, (counts, off, n, chars) in held.items():
            yield pd.DataFrame({"cluster": cluster, "term": [None, *counts.index], "n": [n, *counts.to_numpy()],
                                "off": [off] + [0] * len(counts), "chars": [chars] + [0] * len(counts)})

    return tokens.mapInPandas(summarise, f"cluster {tokens.schema['cluster'].dataType.simpleString()}, term string, n long, off long, chars long")


def top_terms(clustered: DataFrame, top: int = K.THEME_TERMS, text_col: str = "corpus", min_chars: int = K.MIN_THEME_CHARS, stopwords=None,
              capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """What :func:`~cadenza.operators.themes.cluster_terms` returns, and how
    many clusters had to be counted in full."""
    listed = _written(clustered.select("cluster", theme_tokens(F.col(text_col), stopwords).alias("terms")), "cluster-tokens")  # the texts move once
    summed = _written(term_summaries(listed, capacity).groupBy("cluster", "term").agg(
        F.sum("n").alias("n"), F.sum("off").alias("off"), F.sum("chars").alias("chars")), "term-summaries")
    totals = summed.filter("term IS NULL").filter(F.col("chars") + F.col("n") - 1 >= min_chars).select("cluster", F.col("off").alias("taken_off"))
    kept = summed.filter("term IS NOT NULL").select("cluster", "term", "n").join(totals, "cluster")
    place = F.row_number().over(Window.partitionBy("cluster").orderBy(F.col("n").desc()))
    least = kept.withColumn("place", place).filter(F.col("place") <= top).groupBy("cluster").agg(
        F.when(F.count(F.lit(1)) == top, F.min("n")).otherwise(1).alias("least"))
    # stored, so that the planner knows how few they are and the tokens stay where they lie
    candidates = _written(kept.join(least, "cluster").filter(F.col("n") + F.col("taken_off") >= F.col("least")).select("cluster", "term"), "term-candidates")
    tokens = listed.select("cluster", F.explode("terms").alias("term"))
    counted = tokens.join(candidates, ["cluster", "term"], "left_semi").groupBy("cluster", "term").agg(F.count(F.lit(1)).alias("n"))
    by_count = Window.partitionBy("cluster").orderBy(F.col("n").desc(), F.col("term").asc())
    ranked = counted.withColumn("rank", F.row_number().over(by_count)).filter(F.col("rank") <= top)
    ends = totals.join(ranked.groupBy("cluster").agg(F.max("rank").alias("m"), F.min("n").alias("last")), "cluster", "left")
    # where nothing was taken off all terms are candidates; else the last of a full list must exceed what others can have
    unproven = (F.col("taken_off") > 0) & ~F.coalesce((F.col("m") >= top) & (F.col("last") > F.col("taken_off")), F.lit(False))
    full = [r["cluster"] for r in ends.filter(unproven).select("cluster").collect()]
    if full:
        whole = tokens.filter(F.col("cluster").isin(full)).groupBy("cluster", "term").agg(F.count(F.lit(1)).alias("n"))
        again = whole.withColumn("rank", F.row_number().over(by_count)).filter(F.col("rank") <= top)
        ranked = ranked.filter(~F.col("cluster").isin(full)).unionByName(again)
    weight = F.round(F.col("n") / F.max("n").over(Window.partitionBy("cluster")), 6)
    return ranked.select("cluster", F.col("rank").cast("int").alias("rank"), "term", "n", weight.alias("weight")), len(full)
