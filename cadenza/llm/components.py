"""Connected components by alternating star contraction, DataFrame-only.

Each round runs a large-star step (every node hands its larger neighbours to
the smallest node around it) and a small-star step (the same for its smaller
neighbours); O(log^2 n) rounds end in stars around the smallest node of each
component.  A round is two aggregations with partial sums and two equi-joins
whose both sides are plain tables, so the skew handling of joins can split
the neighbours of a hub.  Every step is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.shared import shared_table


def _state(edges: DataFrame) -> tuple:
    """What tells whether a round changed anything: one row."""
    h = F.xxhash64("src", "dst")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.shiftright(h, 20)), F.sum(h.bitwiseAND(F.lit(0xFFFFF)))).first())


def _star(pairs: DataFrame, larger: bool) -> DataFrame:
    """``pairs`` (u, v): each v beside u is handed to the least node of u and
    its neighbours; with ``larger`` only the v above u, else all v and u."""
    least = shared_table(
        pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-least")
    moved = (pairs.filter("v > u") if larger else pairs).join(least, "u").select(F.col("v").alias("src"), F.col("m").alias("dst"))
    if not larger:
        moved = moved.unionByName(least.select(F.col("u").alias("src"), F.col("m").alias("dst")))
    return shared_table(moved.filter("src <> dst").distinct(), "cc-edges")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges`` (src, dst), any orientation, repeats, loops and null ends
    allowed (loops and nulls are ignored).  Returns (node, component) for each
    node of a proper edge; ``component`` is its smallest node.  No edges: no
    rows.  Raises if ``max_rounds`` do not suffice, rather than return
    components that are not finished."""
    cur = shared_table(edges.select("src", "dst").filter("src <> dst").distinct(), "cc-edges")
    state = _state(cur)
    for _ in range(max_rounds):
        if not state[0]:
            break
        both = cur.select(F.col("src").alias("u"), F.col("dst").alias("v")).unionByName(
            cur.select(F.col("dst").alias("u"), F.col("src").alias("v")))
        cur = _star(both, larger=True)
        down = cur.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        cur = _star(down, larger=False)
        before, state = state, _state(cur)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    leaves = cur.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    roots = cur.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    return leaves.unionByName(roots)
