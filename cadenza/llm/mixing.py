"""Mixing sources to target weights by entropy balancing.

Every document gets the rate that stays closest, in relative entropy over
words, to one copy of everything, while the words taken from each constrained
level (a source, or several margins such as source and language) meet their
target.  The solution is an exponential tilt, rate = exp(sum of the duals of
the document's levels), and the duals minimise a convex function.

* The sufficient statistics are the words of each cell (combination of
  levels): one aggregation with partial sums.
* Newton steps on the dual run over those cells as DataFrames.  Levels of one
  margin are disjoint, so its Hessian block is diagonal and every level takes
  its Newton steps at once; margins take turns until all targets are met.
  Duals are never collected; the driver sees the largest violation.
* Rates become whole copies by error diffusion inside buckets of about
  ``BUCKET_DOCS`` documents of a source, largest first, so the words missed in
  a bucket are about those of its smallest document.  Buckets are a salt: a
  source with a third of all rows is spread over many.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.shared import WORD_PATTERN, shared_table
from cadenza.operators.numbering import dense_number

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
BUCKET_DOCS = 1024
NEWTON_STEPS = 80
TOLERANCE = 1e-9


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long"), F.lit(0).cast("long"))


def capped_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_COPIES) -> DataFrame:
    """(source, source_size, target) from (source, source_size), a row for
    each source.  Sources in code point order, null last, weigh ``weights``,
    repeating, and share all words; a target stops at ``cap`` times its
    source's size and the excess goes to the others by weight.

    That is one water level: target = min(cap * size, weight * level).  The
    level rises from all words over all weights; each round takes the sources
    that it fills out of the sum, until no more are.  Sources are numbered over
    ranges, so a table of millions of them is no single task."""
    numbered = dense_number(sources.select("source", "source_size", F.col("source").isNull().alias("_last")), ["_last", "source"], out="k")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("k") % len(weights) + 1).cast("int")).cast("double")
    rows = shared_table(numbered.select("source", "source_size", weight.alias("w"), (cap * F.col("source_size")).cast("double").alias("most")), "mix-sources")
    total, level, filled = float(rows.agg(F.sum("source_size")).first()[0] or 0), 0.0, -1
    while True:  # a row each; ends as no source is ever put back
        over = (F.col("most") <= F.col("w") * level) & F.lit(filled >= 0)
        now, full, left = rows.agg(F.sum(over.cast("int")), F.sum(F.when(over, F.col("most")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("w")))).first()
        if not left or now == filled:
            break
        filled, level = now, (total - full) / left
    return rows.select("source", "source_size", F.least(F.col("most"), F.col("w") * level).alias("target"))


def _newton(mass: Column, target: Column) -> Column:
    """The step d of one level with mass * exp(d) = target, by damped Newton
    iterations on the convex dual mass * exp(d) - target * d."""
    step = lambda d, _: d + F.least(F.lit(2.0), target / (mass * F.exp(d)) - 1)
    found = F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON_STEPS)), F.lit(0.0), step)
    return F.when((mass > 0) & (target > 0), found).otherwise(F.lit(0.0))


def entropy_balance(docs: DataFrame, size_col: str, targets: dict[str, DataFrame], max_sweeps: int = 50,
                    tolerance: float = TOLERANCE) -> DataFrame:
    """Duals of the levels of each margin.

    ``targets`` maps a column of ``docs`` (a margin) to a table with that
    column (its levels, null allowed) and ``target`` words.  Returns the cells:
    the margin columns, ``mass`` (words), ``dual`` (sum of the duals of its
    levels) and ``rate`` (0 where a level's target is 0, or where a cell's
    level has no target).  Raises if the targets of several margins cannot be
    met together."""
    margins = list(targets)
    cells = docs.groupBy(*margins).agg(F.sum(size_col).cast("double").alias("mass"))
    for i, m in enumerate(margins):
        goal = targets[m].select(F.col(m).alias(f"_level{i}"), F.col("target").cast("double").alias(f"_target{i}"))
        cells = cells.join(goal, F.col(m).eqNullSafe(F.col(f"_level{i}")), "left").drop(f"_level{i}")
    asked = reduce(lambda a, b: a & b, (F.coalesce(F.col(f"_target{i}") > 0, F.lit(False)) for i in range(len(margins))))
    state = shared_table(cells.withColumn("asked", asked).withColumn("dual", F.lit(0.0)), "mix-cells")
    for _ in range(max_sweeps):
        for i, m in enumerate(margins):
            level = Window.partitionBy(m)
            taken = F.sum(F.when(F.col("asked"), F.col("mass") * F.exp("dual")).otherwise(0.0)).over(level)
            state = state.withColumn("dual", F.col("dual") + _newton(taken, F.col(f"_target{i}")))
        state = shared_table(state, "mix-cells")
        worst = 0.0
        for i, m in enumerate(margins):
            taken = F.sum(F.when(F.col("asked"), F.col("mass") * F.exp("dual")).otherwise(0.0))
            by = state.groupBy(m).agg(taken.alias("taken"), F.first(f"_target{i}").alias("target"))
            worst = max(worst, by.filter("taken > 0").agg(F.max(F.abs(F.col("taken") / F.col("target") - 1))).first()[0] or 0.0)
        if worst <= tolerance:
            break
    else:
        raise RuntimeError(f"targets missed by a factor of {worst:.3g} after {max_sweeps} sweeps")
    return state.select(*margins, "mass", "dual", F.when(F.col("asked"), F.exp("dual")).otherwise(0.0).alias("rate"))


def diffuse(sizes: np.ndarray, rate: float, cap: int, start: float) -> np.ndarray:
    """Copies, 0 to ``cap``, of documents in falling order of size, so that
    the words taken follow ``rate``: what a document misses or exceeds is
    carried to the next.  ``start`` in [0, 1) shifts where rounding begins."""
    copies, carry = np.zeros(len(sizes), dtype=np.int64), (start - 0.5) * (sizes[-1] if len(sizes) else 0)
    for i, size in enumerate(sizes.tolist()):
        if size:
            want = rate * size + carry
            copies[i] = min(cap, max(0, int(want / size + 0.5)))
            carry = want - int(copies[i]) * size
    return copies


def _planned(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], cap: int,
             bucket_docs: int) -> tuple[DataFrame, DataFrame]:
    """(ticket, source, size) of every row, and for each source (planned) its
    size, target, rate and number of buckets; both in the shared folder."""
    rows = shared_table(docs.select(
        F.col(id_col).cast("string").alias("ticket"), F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col)).alias("size"), F.monotonically_increasing_id().alias("place")), "mix-sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    targets = shared_table(capped_targets(sources.select("source", "source_size"), weights, cap), "mix-targets")
    rates = entropy_balance(rows, "size", {"source": targets.select("source", "target")}).select(
        F.col("source").alias("s1"), F.least(F.col("rate"), F.lit(float(cap))).alias("rate"))
    plan = shared_table(
        targets.join(rates, F.col("source").eqNullSafe(F.col("s1"))).drop("s1")
        .join(sources.select(F.col("source").alias("s2"), F.ceil(F.col("n") / bucket_docs).alias("buckets")),
              F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
        .withColumnRenamed("source", "planned"), "mix-plan")
    return rows, plan


def _dealt(rows: DataFrame, plan: DataFrame, bucket_docs: int) -> DataFrame:
    """Rows with their source's plan and a bucket.  Rows that share source, id
    and size beyond a bucket's number are spread by their place in the written
    table; all others have the bucket of their hash."""
    many = shared_table(rows.groupBy(*[F.col(c).alias(f"m_{c}") for c in ("source", "ticket", "size")]).agg(F.count(F.lit(1)).alias("m")).filter(
        F.col("m") > bucket_docs).withColumn("salts", F.ceil(F.col("m") / bucket_docs)), "mix-many")
    salted = rows.withColumn("salt", F.lit(0).cast("long"))
    if not many.isEmpty():
        same = F.col("source").eqNullSafe(F.col("m_source")) & F.col("ticket").eqNullSafe(F.col("m_ticket")) & (F.col("size") == F.col("m_size"))
        salted = rows.join(many, same, "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("place"), F.col("salts")), F.lit(0))).drop(
            "m_source", "m_ticket", "m_size", "m", "salts")
    hashed = F.when(F.col("salt") == 0, F.xxhash64("ticket", "size")).otherwise(F.xxhash64("ticket", "size", "salt"))
    return salted.join(plan, F.col("source").eqNullSafe(F.col("planned"))).drop("planned").withColumn(
        "bucket", F.xxhash64("source", F.pmod(hashed, F.col("buckets"))))


def _rounded(rows: DataFrame, plan: DataFrame, cap: int, bucket_docs: int) -> DataFrame:
    """(ticket, size, source_size, target, copies) for each row."""

    def rounded(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "ticket"], ascending=[False, True], kind="stable")
        start = xxhash.xxh64_intdigest(str(int(group["bucket"].iloc[0]))) / 2**64
        copies = diffuse(group["size"].to_numpy(), float(group["rate"].iloc[0]), cap, start)
        return group[["ticket", "size", "source_size", "target"]].assign(copies=copies)

    return _dealt(rows, plan, bucket_docs).groupBy("source", "bucket").applyInPandas(
        rounded, "ticket string, size long, source_size long, target double, copies long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_COPIES, bucket_docs: int = BUCKET_DOCS) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken), a row for each
    document; ``taken`` = ``copies`` * ``size``, at most ``cap`` * ``size``.

    Null and empty texts have size 0 and no copies.  A null source is a
    source of its own, last in order.  Sources of size 0 have target 0.
    Repeated rows each keep a row.  Rerunning gives the same result.  Empty
    input: no rows.  Other columns are not read."""
    rows, plan = _planned(docs, id_col, text_col, source_col, weights, cap, bucket_docs)
    kind = docs.select(id_col).schema[0].dataType
    return _rounded(rows, plan, cap, bucket_docs).select(
        F.col("ticket").cast(kind).alias("doc_id"), "size", "source_size", "target", "copies",
        (F.col("copies") * F.col("size")).alias("taken"))


def mixed_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                 weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_COPIES, bucket_docs: int = BUCKET_DOCS) -> DataFrame:
    """``docs`` as the mix takes them: each row once for each of its copies,
    with all its columns and ``copy`` (1, 2, ...).  An input column of that
    name is replaced.  Rows that share an id share their copies' number: the
    largest that :func:`mix` gives one of them."""
    rows, plan = _planned(docs, id_col, text_col, source_col, weights, cap, bucket_docs)
    given = shared_table(_rounded(rows, plan, cap, bucket_docs).groupBy("ticket").agg(F.max("copies").alias("n"))
                         .filter("n > 0").withColumnRenamed("ticket", "of"), "mix-copies")
    held = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("string").alias("ticket"))
    # the ids grow with the documents, so they are never broadcast
    taken = held.join(given.hint("merge"), F.col("ticket").eqNullSafe(F.col("of")))
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c != "copy"]
    return taken.select(F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"), "row").select(*kept, "copy")
